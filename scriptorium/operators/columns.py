"""Tokens of many documents at once, in numpy columns.

A document is a row, and everything about a token follows from its document
alone; so tokens, and what is computed from neighbouring tokens, need no shuffle
and no sort. One regular expression cuts lexemes; the rest is a few array
operations over all lexemes of a batch. The relational plans, which make the
same tokens with SQL windows, are what this is tested against.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scriptorium.functions import markers as mk
from scriptorium.functions.numbers import number_at
from scriptorium.operators.scan import Token
from scriptorium.plans.tokens import LEXEME, MOST, NUMBERED

KINDS = ("Text", "Newline", "OptBreak", "Whitespace", "Marker", "EndMarker", "Milestone", "MilestoneEnd", "AttributeList", "Number", "BookCode")
TEXT, NEWLINE, BREAK, SPACE, MARKER, END, MILESTONE, MILESTONE_END, ATTRIBUTES, NUMBER, BOOK = range(len(KINDS))
NUMBER_KINDS = ("Single", "Range", "Sequence", "SequenceWithRange")
#: Bytes of source text that one pass takes; a longer document is a pass by itself.
PASS_BYTES = 1 << 20

_LEXEME = re.compile(LEXEME.encode())
_BOOK = re.compile(rb"[A-Za-z0-9]{3}[\x00-\x7f]*")
_PLAIN = re.compile(rb"[0-9]+(?![-,0-9A-Za-z\x80-\xff])")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + column.offset + 1)[column.offset :].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return values[off[0] : off[-1]], off - off[0]


def passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows: first row, row past the last, bytes, offsets."""
    data, off = utf8(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Rows:
    """Rows in order within documents, and windows over them."""

    def __init__(self, counts: np.ndarray):
        self.counts = np.asarray(counts, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.n = int(self.first[-1])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.lo = self.first[:-1][self.doc]
        self.hi = self.first[1:][self.doc]
        self.at = np.arange(self.n)

    def last(self, mask: np.ndarray) -> np.ndarray:
        """The last row up to each row, in its document, that is in mask; else -1."""
        got = np.maximum.accumulate(np.where(mask, self.at, -1)) if self.n else self.at
        return np.where(got >= self.lo, got, -1)

    def before(self, mask: np.ndarray) -> np.ndarray:
        """The last such row before each row."""
        got = np.concatenate([[-1], np.maximum.accumulate(np.where(mask, self.at, -1))[:-1]]) if self.n else self.at
        return np.where(got >= self.lo, got, -1)

    def after(self, mask: np.ndarray) -> np.ndarray:
        """The first such row after each row."""
        if not self.n:
            return self.at
        got = np.minimum.accumulate(np.where(mask, self.at, self.n)[::-1])[::-1]
        got = np.concatenate([got[1:], [self.n]])
        return np.where(got < self.hi, got, -1)

    def step(self, by: int) -> np.ndarray:
        """The row so many places on in the same document; else -1."""
        to = self.at + by
        return np.where((to >= self.lo) & (to < self.hi), to, -1)

    def count(self, mask: np.ndarray, inclusive: bool = True) -> np.ndarray:
        """How many rows of the document up to each row are in mask."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.at + inclusive] - total[self.lo]


def pick(values: np.ndarray, at: np.ndarray, other) -> np.ndarray:
    """values[at], and other where at is -1."""
    if not len(values):
        return np.full(len(at), other)
    return np.where(at >= 0, values[at], other)


class Tokens(Rows):
    """Tokens of some documents: data[start:end] is each one's text, and these follow on each other."""

    _sids: list[str | None] | None = None
    _ids: list[str | None] | None = None
    _known: tuple[np.ndarray, list[str]] | None = None

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.raw, self.offsets = data, data.tobytes(), offsets
        self.names: list[str] = []
        self._tokens(*self._attach(*self._pieces(*self._lexemes())))
        self._carry()

    def _lexemes(self) -> tuple:
        cut = _LEXEME.findall
        lens, counts = [], []
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            found = cut(self.raw, a, b) if a < b else []
            lens.extend(map(len, found))
            counts.append(len(found))
        end = np.cumsum(np.array(lens, dtype=np.int64))
        start = end - np.array(lens, dtype=np.int64)
        rows = Rows(np.array(counts))
        data, first = self.data, self.data[start] if rows.n else np.zeros(0, dtype=np.uint8)
        last = data[end - 1] if rows.n else first
        long = end - start > 1
        second = np.where(long, data[np.minimum(start + 1, len(data) - 1)], 0) if rows.n else first
        kind = np.full(rows.n, TEXT, dtype=np.int8)
        kind[(first == 32) | (first == 9)] = SPACE
        kind[(first == 13) | (first == 10)] = NEWLINE
        kind[first == 124] = ATTRIBUTES
        kind[(first == 47) & long] = BREAK
        slash = (first == 92) & long
        kind[slash] = MARKER
        kind[slash & (last == 42)] = END
        kind[slash & (second == 42)] = MILESTONE_END
        dash = slash & ((last == 115) | (last == 101))
        kind[dash & (data[np.maximum(end - 2, 0)] == 45)] = MILESTONE
        marker = np.full(rows.n, -1, dtype=np.int32)
        named = np.flatnonzero(slash & (second != 42))
        ids: dict[bytes, int] = {}
        raw = self.raw
        marker[named] = [ids.setdefault(raw[s:e], len(ids)) for s, e in zip((start[named] + 1).tolist(), (end - (kind == END))[named].tolist())]
        self.names = [x.decode() for x in ids]
        return rows, start, end, kind, marker

    def is_name(self, *names: str) -> np.ndarray:
        """Of each marker's number whether it is one of these names; -1 is none."""
        own = frozenset(names)
        return np.array([x in own for x in self.names] + [False])

    def by_name(self, f: Callable[[str], object], other: object = None) -> np.ndarray:
        """f of each marker's name, by its number."""
        out = np.empty(len(self.names) + 1, dtype=object)
        out[:] = [*(f(x) for x in self.names), other]
        return out

    def _pieces(self, rows: Rows, start: np.ndarray, end: np.ndarray, kind: np.ndarray, marker: np.ndarray) -> tuple:
        """Lexemes with book codes and numbers cut off their text."""
        self.lexeme_kind, self.lexeme_counts = kind, rows.counts
        waits = rows.before((kind != SPACE) & (kind != NEWLINE))
        waits = np.where(pick(kind, waits, -1) == MARKER, pick(marker, waits, -1), -1)
        text = kind == TEXT
        load, raw = np.zeros(rows.n, dtype=np.int64), self.raw
        own, value, low, shape = np.full(rows.n, TEXT, dtype=np.int8), np.zeros(rows.n, dtype=np.int64), np.zeros(rows.n, dtype=np.int64), np.zeros(rows.n, dtype=np.int8)
        for k in np.flatnonzero(text & self.is_name("id")[waits]).tolist():
            if _BOOK.fullmatch(raw, start[k], end[k]):
                load[k], own[k] = 3, BOOK
        for k in np.flatnonzero(text & self.is_name(*NUMBERED)[waits] & (self.data[start] - 48 < 10 if rows.n else text)).tolist():
            s, e = start[k], end[k]
            if m := _PLAIN.match(raw, s, e):
                size, number, body = m.end() - s, m[0], None
            else:
                body = number_at(raw[s:e].decode("utf-8", "replace"))
                number, size = re.match("[0-9]+", body)[0], len(body.encode())
            if 0 < int(number[:18]) <= MOST:
                load[k], own[k], value[k] = size, NUMBER, int(number[:18]) if len(number) <= 18 else 0
                if body is not None:
                    shape[k] = ("-" in body) + 2 * ("," in body)
                    ends = re.match(r".*-([0-9]+)", body)
                    low[k] = int(ends[1]) if ends and int(ends[1]) < 1 << 63 else 0
        whole = load == end - start
        twice = (load > 0) & ~whole
        at = np.repeat(np.arange(rows.n), 1 + twice)
        second = np.concatenate([[False], at[1:] == at[:-1]]) if len(at) else np.zeros(0, dtype=bool)
        p_start = start[at] + np.where(second, load[at], 0)
        p_end = np.where(second | ~twice[at], end[at], start[at] + load[at])
        p_kind = np.where(second, TEXT, np.where(load[at] > 0, own[at], kind[at])).astype(np.int8)
        counts = np.bincount(rows.doc[at], minlength=len(rows.counts))
        number = np.where(second, -1, at)
        self._numbers = value, low, shape
        return Rows(counts), p_start, p_end, p_kind, marker[at], number

    def _attach(self, rows: Rows, start: np.ndarray, end: np.ndarray, kind: np.ndarray, marker: np.ndarray, number: np.ndarray) -> tuple:
        """White space goes to the token after it, or before it if a line break or attributes follow; texts in a row are one."""
        back, on, on2 = (rows.step(k) for k in (-1, 1, 2))
        pk, nk, nnk = pick(kind, back, -1), pick(kind, on, -1), pick(kind, on2, -1)
        glued = np.array([k in (NEWLINE, ATTRIBUTES) for k in range(len(KINDS))] + [False])
        from_ = np.where((pk == SPACE) & ~glued[kind], pick(start, back, 0), start)
        to = np.where((nk == SPACE) & ((on2 < 0) | glued[nnk]), pick(end, on, 0), end)
        kept = np.flatnonzero((kind != SPACE) | ((back < 0) & ((on < 0) | glued[nk])))
        kind = np.where(kind == SPACE, TEXT, kind)[kept]
        rows = Rows(np.bincount(rows.doc[kept], minlength=len(rows.counts)))
        new = ~((kind == TEXT) & (pick(kind, rows.step(-1), -1) == TEXT))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], rows.n)[: len(head)] - 1
        return Rows(np.bincount(rows.doc[head], minlength=len(rows.counts))), from_[kept][head], to[kept][tail], kind[head], marker[kept][head], number[kept][head], start[kept][head], end[kept][head]

    def _tokens(self, rows: Rows, start, end, kind, marker, number, piece_start, piece_end) -> None:
        super().__init__(rows.counts)
        self.start, self.end, self.kind, self.marker = start, end, kind, marker
        self.piece_start, self.piece_end = piece_start, piece_end
        value, low, shape = self._numbers
        is_number = kind == NUMBER
        self.num_start = np.where(is_number, value[number], 0) if len(value) else np.zeros(self.n, dtype=np.int64)
        self.num_end = np.where(is_number, low[number], 0) if len(value) else self.num_start
        self.num_shape = np.where(is_number, shape[number], 0) if len(value) else self.num_start
        self.idx = self.at - self.lo
        self.tag = np.where(marker >= 0, kind.astype(np.int64) * (len(self.names) + 1) + marker + 1, kind.astype(np.int64) * (len(self.names) + 1))

    def _carry(self) -> None:
        """Book, chapter and verse of each token; they change at a book code and at a chapter's or verse's marker."""
        is_book, on = self.kind == BOOK, self.step(1)
        numbered = (self.kind == MARKER) & (pick(self.kind, on, -1) == NUMBER)
        opens_c, opens_v = numbered & self.is_name("c")[self.marker], numbered & self.is_name("v")[self.marker]
        value = pick(self.num_start, on, 0)
        running = pick(value, self.last(opens_c), 0)
        event = is_book | opens_c | opens_v
        at = self.last(event)
        self.book_at = self.last(is_book)
        self.first_book = np.full(len(self.counts), -1)
        books = np.flatnonzero(is_book)[::-1]
        self.first_book[self.doc[books]] = books
        self.chapter = pick(np.where(is_book, 0, running), at, 0)
        self.verse = pick(np.where(opens_v, value, 0), at, 0)

    @classmethod
    def given(cls, counts: list[int], kinds: list[str], texts: list[str], markers: list[str | None], sids: list[str | None] | None = None, ids: list[str | None] | None = None) -> Tokens:
        """Tokens as they are given, not made from a source; references and ids too, where they are given."""
        t = cls.__new__(cls)
        raw = [x.encode() for x in texts]
        size = np.array([len(x) for x in raw], dtype=np.int64)
        t.raw = b"".join(raw)
        t.data = np.frombuffer(t.raw, dtype=np.uint8)
        names: dict[str, int] = {}
        marker = np.array([-1 if m is None else names.setdefault(m, len(names)) for m in markers], dtype=np.int32)
        t.names = list(names)
        kind = np.array([KINDS.index(k) for k in kinds], dtype=np.int8)
        Rows.__init__(t, np.array(counts, dtype=np.int64))
        end = np.cumsum(size)
        value, low, shape = (np.zeros(t.n, dtype=np.int64) for _ in range(3))
        for k in np.flatnonzero(kind == NUMBER).tolist():
            text = texts[k].strip()
            if text and number_at(text) == text and len(digits := re.match("[0-9]+", text)[0]) <= 18:
                value[k], shape[k] = int(digits), ("-" in text) + 2 * ("," in text)
                ends = re.match(r".*-([0-9]+)", text)
                low[k] = int(ends[1]) if ends else 0
        t._numbers = value, low, shape
        lead = np.array([len(x) - len(x.lstrip()) for x in raw], dtype=np.int64)
        t.offsets = np.concatenate([[0], end])[t.first]
        t._tokens(Rows(t.counts), end - size, end, kind, marker, t.at, end - size + lead, end)
        t._carry()
        t._sids, t._ids = sids, ids
        return t

    def listed(self, d: int) -> list[Token]:
        """One document's tokens as records."""
        a, b = int(self.first[d]), int(self.first[d + 1])
        raw, names = self.raw, self.names
        codes, books = self._books()
        book = codes[self.book_at[a:b]].tolist()
        rows = zip(self.kind[a:b].tolist(), self.start[a:b].tolist(), self.end[a:b].tolist(), self.marker[a:b].tolist(), book, self.chapter[a:b].tolist(), self.verse[a:b].tolist(), self.num_start[a:b].tolist())
        return [Token(KINDS[k], raw[s:e].decode(), names[m] if m >= 0 else None, books[bk] if bk >= 0 else None, c, v, n if k == NUMBER else None) for k, s, e, m, bk, c, v, n in rows]

    def text(self, k: int) -> str:
        return self.raw[self.start[k] : self.end[k]].decode()

    def code(self, k: int) -> str:
        return self.raw[self.piece_start[k] : self.piece_end[k]].decode()

    # ---- columns

    def strings(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """Texts of byte ranges."""
        size = end - start
        offsets = np.concatenate([[0], np.cumsum(size)])
        if len(start) and (start[1:] == end[:-1]).all():
            values = self.data[start[0] : end[-1]]
        else:
            values = self.data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

    def texts(self) -> pa.Array:
        return self.strings(self.start, self.end)

    def kinds(self, at: np.ndarray | None = None) -> pa.Array:
        return pa.array(KINDS).take(pa.array(self.kind if at is None else self.kind[at]))

    def marker_names(self, at: np.ndarray | None = None) -> pa.Array:
        return named(self.marker if at is None else self.marker[at], self.names)

    def _books(self) -> tuple[np.ndarray, list[str]]:
        """For each token that is a book code its book's number, and the books."""
        if self._known is not None:
            return self._known
        of: dict[str, int] = {}
        out = np.full(self.n + 1, -1, dtype=np.int64)
        for k in np.flatnonzero(self.kind == BOOK).tolist():
            out[k] = of.setdefault(self.code(k).strip(), len(of))
        self._known = out, list(of)
        return self._known

    def books(self) -> pa.Array:
        number, names = self._books()
        return named(number[self.book_at], names)

    def ids(self, at: np.ndarray | None = None) -> pa.Array:
        """Book and place; before the first book code, its book."""
        at = self.at if at is None else at
        if self._ids is not None:
            return pa.array(self._ids, pa.string()).take(pa.array(at))
        number, names = self._books()
        own = np.where(self.book_at[at] >= 0, self.book_at[at], self.first_book[self.doc[at]])
        book = named(np.where(number[own] >= 0, number[own], len(names)), [*names, "unknown"])
        return pc.binary_join_element_wise(book, pa.array(self.idx[at]).cast(pa.string()), "-")

    def references(self, at: np.ndarray | None = None, style: str = "lint") -> pa.Array:
        """GEN 1:2; before the first verse lint writes GEN 1, diff GEN 1:0."""
        at = self.at if at is None else at
        if self._sids is not None:
            given = pa.array(self._sids, pa.string()).take(pa.array(at))
            return given if style == "diff" else pc.replace_substring_regex(given, ":0$", "")
        number, names = self._books()
        book = named(number[self.book_at[at]], names)
        chapter, verse = (pa.array(x[at]).cast(pa.string()) for x in (self.chapter, self.verse))
        full = pc.binary_join_element_wise(pc.binary_join_element_wise(book, chapter, " "), verse, ":")
        return full if style == "diff" else pc.if_else(pa.array(self.verse[at] == 0), pc.binary_join_element_wise(book, chapter, " "), full)

    def sid_groups(self) -> np.ndarray:
        """A number for each token's reference; equal ones in a document have equal numbers only while nothing changes between."""
        number, _ = self._books()
        if self._sids is not None and self.n:
            sids = np.unique(np.array([x or "" for x in self._sids]), return_inverse=True)[1]
            return np.concatenate([[0], np.cumsum((sids[1:] != sids[:-1]) | (self.doc[1:] != self.doc[:-1]))])
        key = np.stack([self.doc, number[self.book_at], self.chapter * (self.book_at >= 0), self.verse * (self.book_at >= 0)])
        return np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))]) if self.n else self.at


def named(number: np.ndarray, names: Iterable[str]) -> pa.Array:
    """Names by number; a negative one is null."""
    number = np.asarray(number)
    return pa.array([*names], pa.string()).take(pa.array(number, pa.int64(), mask=number < 0))


def where(values: np.ndarray, valid: np.ndarray, type_: pa.DataType) -> pa.Array:
    return pa.array(values, type_, mask=~valid)


SCHEMA = (
    "idx int, id string, kind string, text string, span_start bigint, span_end bigint, book string, chapter bigint, verse bigint, marker string, nested boolean, "
    "num_start bigint, num_end bigint, num_kind string, book_code string, book_valid boolean"
)


def token_columns(t: Tokens) -> list[pa.Array]:
    """The columns of SCHEMA."""
    has_book, number, book = t.book_at >= 0, t.kind == NUMBER, t.kind == BOOK
    base = t.offsets[:-1][t.doc]
    codes, names = t._books()
    nested = np.append(np.array([x.startswith("+") for x in t.names], dtype=bool), False)
    valid = np.array([x in mk.BOOKS for x in names] + [False])
    return [
        pa.array(t.idx, pa.int32()), t.ids(), t.kinds(), t.texts(), pa.array(t.start - base), pa.array(t.end - base), t.books(),
        where(t.chapter, has_book, pa.int64()), where(t.verse, has_book, pa.int64()), t.marker_names(), pa.array(nested[t.marker]),
        where(t.num_start, number, pa.int64()), where(t.num_end, number & (t.num_shape % 2 == 1), pa.int64()), named(np.where(number, t.num_shape, -1), NUMBER_KINDS),
        named(codes[: t.n], names), where(valid[codes[: t.n]], book, pa.bool_()),
    ]
