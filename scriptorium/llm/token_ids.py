"""Token ids ranked by frequency, in byte-aligned variable-length coding.

Texts are tokenized with a public byte-level BPE vocabulary (a ``.tiktoken``
file, whose path is a parameter). Ids are then replaced by their rank in the
whole corpus, 0 for the most frequent token, so most fit one byte. A document's
ranks are stored in two binary columns: ``control`` has two bits a value, four
values a byte, for its length of 1 to 4 bytes; ``data`` has the values' bytes,
least first. Decoding looks the lengths up in a table of 256 rows. The token of
each rank is in the metadata of the column ``data``, which Parquet files keep, so
decode_texts() needs the coded rows and the vocabulary alone.

Null text gives null columns, empty text zero tokens and empty binaries;
repeated rows are each encoded; other columns are not looked at.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import keep, texts, with_id
from scriptorium.llm.textkernel import HashTable, passes, span_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is split before pairs are merged; contractions, then letters, digits, the rest and spaces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces, and bytes of them, whose tokens a worker remembers before it starts afresh.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20

_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[list(range(65, 91)) + list(range(97, 123))] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[128:192] = _LETTER  # the second byte of a letter; other uses have a lead byte that is _HARD
_KIND[192:256] = _HARD
_KIND[0xC3:0xCA] = _LETTER
_CONTRACTED = np.zeros(256, dtype=bool)
_CONTRACTED[list(b"strvmld")] = True


#: Bits of a 64-bit number that its first 0 to 8 bytes have.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_SLACK = np.zeros(8, dtype=np.uint8)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes of a from at on are those of b from bt on; either has 8 bytes more than are compared."""
    wide_a, wide_b = (np.lib.stride_tricks.sliding_window_view(x, 8).view("<u8")[:, 0] for x in (a, b))
    out = np.ones(len(size), dtype=bool)
    left, done = np.flatnonzero(size > 0), 0
    while len(left):
        tail = _TAIL[np.minimum(size[left] - done, 8)]
        out[left] &= (wide_a[at[left] + done] ^ wide_b[bt[left] + done]) & tail == 0
        done += 8
        left = left[(size[left] > done) & out[left]]
    return out


class Pieces:
    """Tokens of text pieces by a byte-level BPE; pieces met before are looked up.

    Words and marks, whose borders the kinds of bytes tell, are such pieces. What
    lies between the white space around other bytes or contractions is one piece
    too, whose tokens come from the library's own splitter.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.known = 0
        self.late, self.late_row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.table, self.row_of = HashTable(np.zeros(0, dtype=np.uint64)), np.zeros(1, dtype=np.int64)
        self.start, self.count = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.flat, self.used = np.zeros(4096, dtype=self.dtype), 0
        self.text_at, self.size_of = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.text, self.text_used = np.zeros(1 << 16, dtype=np.uint8), 0

    def _room(self, n: int, tokens: int, size: int) -> None:
        if n > len(self.start):
            grow = max(n, 2 * len(self.start))
            self.start, self.count, self.text_at, self.size_of = (np.resize(x, grow) for x in (self.start, self.count, self.text_at, self.size_of))
        if tokens > len(self.flat):
            self.flat = np.resize(self.flat, max(tokens, 2 * len(self.flat)))
        if size + len(_SLACK) > len(self.text):
            self.text = np.resize(self.text, max(size + len(_SLACK), 2 * len(self.text)))

    def _encode(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, hard: np.ndarray) -> list[list[int]]:
        plain, split = self.encoding._core_bpe.encode_single_piece, self.encoding.encode_ordinary
        return [split(raw[s:e].decode("utf-8", "replace")) if h else plain(raw[s:e]) for s, e, h in zip(starts.tolist(), ends.tolist(), hard.tolist())]

    def _learn(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """Encode pieces and note their bytes; their rows."""
        ids = self._encode(raw, starts, ends, hard)
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        size = ends - starts
        n, m, total, bytes_ = self.known, len(ids), int(count.sum()), int(size.sum())
        self._room(n + m, self.used + total, self.text_used + bytes_)
        self.count[n : n + m], self.size_of[n : n + m] = count, size
        self.start[n : n + m] = self.used + np.cumsum(count) - count
        self.text_at[n : n + m] = self.text_used + np.cumsum(size) - size
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), dtype=self.dtype, count=total)
        self.text[self.text_used : self.text_used + bytes_] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(bytes_)]
        self.known, self.used, self.text_used = n + m, self.used + total, self.text_used + bytes_
        return np.arange(n, n + m)

    def rows(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """For each piece its row in start and count, which lead to its tokens in flat.

        A piece that is found by its hash is compared byte by byte with the one
        that is remembered; if another one has its hash, it is encoded by itself.
        """
        if self.known > REMEMBERED or self.text_used > REMEMBERED_BYTES:
            self._forget()
        raw = data.tobytes()
        row = self.table.find(hashes)
        out = np.where(row >= 0, self.row_of[row], -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            at = np.searchsorted(self.late, new)
            at[at == len(self.late)] = 0
            met = self.late[at] == new if len(self.late) else np.zeros(len(new), dtype=bool)
            where = np.empty(len(new), dtype=np.int64)
            where[met] = self.late_row[at[met]]
            fresh = np.flatnonzero(~met)
            if len(fresh):
                at = miss[first[fresh]]
                where[fresh] = self._learn(data, raw, starts[at], ends[at], hard[at])
                late = np.concatenate([self.late, new[fresh]])
                order = np.argsort(late)
                self.late, self.late_row = late[order], np.concatenate([self.late_row, where[fresh]])[order]
                if len(self.late) > 1000 + 0.1 * len(self.table.keys):
                    self._index()
            out[miss] = where[back]
        size = ends - starts
        same = self.size_of[out] == size
        like = np.flatnonzero(same)
        same[like] = same_bytes(np.concatenate([data, _SLACK]), starts[like], self.text, self.text_at[out[like]], size[like])
        other = np.flatnonzero(~same)
        if len(other):
            out[other] = self._learn(data, raw, starts[other], ends[other], hard[other])
        return out

    def _index(self) -> None:
        """Move what was learnt lately into the table."""
        self.row_of = np.concatenate([self.row_of[: len(self.table.keys)], self.late_row])
        self.table = HashTable(np.concatenate([self.table.keys, self.late]))
        self.late, self.late_row = self.late[:0], self.late_row[:0]

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the texts one after the other, and the number of each text's."""
        n = len(data)
        if n == 0:
            return np.zeros(0, dtype=self.dtype), np.zeros(len(offsets) - 1, dtype=np.int64)
        kind = _KIND[data]
        hard = kind == _HARD
        after_c3 = np.flatnonzero(data[:-1] == 0xC3) + 1
        hard[after_c3[(data[after_c3] == 0x97) | (data[after_c3] == 0xB7)]] = True
        quote = np.flatnonzero(data[:-1] == 39)
        hard[quote[_CONTRACTED[data[quote + 1]]]] = True

        cut = np.empty(n + 1, dtype=bool)
        cut[0] = cut[n] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
        border = np.zeros(n + 1, dtype=bool)
        border[offsets] = True
        cut |= border
        whole = np.zeros(0, dtype=np.int64)
        if hard.any():
            # a text may always be cut before white space that follows a letter, digit or mark of one byte, or a plain letter of two
            solid = (kind[:-1] != _SPACE) & ((data[:-1] < 128) | (kind[:-1] == _LETTER))
            lead = np.flatnonzero(data[:-1] >= 0xC0)
            unsure = lead[kind[lead] == _HARD]
            for k in (1, 2, 3):  # the later bytes of a character that isn't a plain letter
                more = unsure[unsure + k < n - 1] + k
                solid[more[(data[more] & 0xC0) == 0x80]] = False
            edge = border.copy()
            edge[1:n] |= solid & (kind[1:] == _SPACE)
            edges = np.flatnonzero(edge)
            part = np.unique(np.searchsorted(edges, np.flatnonzero(hard), side="right")) - 1
            inside = np.zeros(n + 2, dtype=np.int32)
            np.add.at(inside, edges[part] + 1, 1)
            np.add.at(inside, edges[part + 1], -1)
            inside = np.cumsum(inside)[: n + 1] > 0
            whole = edges[part]
        runs = np.flatnonzero(cut)
        ends = runs[1:]
        spaces = (kind[runs[:-1]] == _SPACE) & ~border[ends]
        ends = ends[spaces]
        cut[ends - 1] = True
        cut[ends[data[ends - 1] == 32]] = False
        if len(whole):
            cut[inside] = False
            cut[whole] = True
            cut[edges[part + 1]] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        first = np.searchsorted(starts, offsets)
        split = np.zeros(len(starts), dtype=bool)
        split[np.searchsorted(starts, whole)] = True
        row = self.rows(span_hashes(data, starts, ends), data, starts, ends, split)
        count = self.count[row]
        before = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.start[row] - before[:-1], count) + np.arange(before[-1])
        return self.flat[at], np.diff(before[first])


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _binary(data: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends])
    if offsets[-1] >= 1 << 31:
        raise ValueError("one batch gives more than 2 GB")
    valid = pa.array(~null).buffers()[1] if null.any() else None
    return pa.Array.from_buffers(pa.binary(), len(ends), [valid, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def tokenize(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens): ids as little-endian 2-byte integers, 4-byte ones for over 65,536 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pieces(path)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, data, offsets in passes(texts):
                out, counts = bpe.tokens(data, offsets)
                null = texts.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                packed = _binary(out, np.cumsum(counts) * out.itemsize, null)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed], ["doc_id", "tokens"])

    src = texts(docs, id_col, text_col)
    return src.mapInArrow(run, with_id(src, "tokens binary"))


def token_counts(tokens: DataFrame, wide: bool = False) -> DataFrame:
    """(token, n): how often each token occurs in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            _, offsets, data = batch.column(0).buffers()
            off = np.frombuffer(offsets, dtype=np.int32, count=batch.column(0).offset + batch.num_rows + 1)[batch.column(0).offset :]
            if data is not None and off[-1] > off[0]:
                ids = np.frombuffer(data, dtype=np.uint8, count=off[-1])[off[0] :].view(np.uint32 if wide else np.uint16)
                n = np.bincount(ids, minlength=len(total))
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    return tokens.select("tokens").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every token of the vocabulary, by falling count, then by id; and the tokens that occur, by rank."""
    n = np.zeros(size, dtype=np.int64)
    for row in counts.collect():  # no more rows than the vocabulary has tokens
        n[row["token"]] = row["n"]
    order = np.lexsort((np.arange(size), -n))
    rank = np.empty(size, dtype=np.uint32)
    rank[order] = np.arange(size)
    return rank, order[: int((n > 0).sum())].astype(np.uint32)


def encode(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and where each document's end, data bytes and where each document's end."""
    v = values.astype(np.uint32)
    code = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    groups = np.cumsum((counts + 3) // 4)
    last = np.cumsum(counts)
    shift = (groups - (counts + 3) // 4) * 4 - (last - counts)
    padded = np.zeros(int(groups[-1]) * 4 if len(groups) else 0, dtype=np.uint8)
    padded[np.arange(len(v)) + np.repeat(shift, counts)] = code
    quad = padded.reshape(-1, 4)
    control = quad[:, 0] | (quad[:, 1] << 2) | (quad[:, 2] << 4) | (quad[:, 3] << 6)
    ends = np.cumsum(code.astype(np.int64) + 1)
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    at = ends - code - 1
    data[at] = v & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(code >= k)
        if len(more):
            data[at[more] + k] = (v[more] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control, groups, data, np.concatenate([[0], ends])[last]


#: Lengths of the four values that each control byte tells.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that encode() wrote."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    out = np.zeros(n, dtype=np.uint32)
    for k in range(4):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


def encode_tokens(tokens: DataFrame, rank: np.ndarray, wide: bool = False) -> DataFrame:
    """(doc_id, n_tokens, control, data) of tokenize()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                col = part.column(1)
                _, offsets, data = col.buffers()
                off = np.frombuffer(offsets, dtype=np.int32, count=col.offset + len(col) + 1)[col.offset :].astype(np.int64)
                raw = np.frombuffer(data, dtype=np.uint8, count=off[-1])[off[0] :] if data is not None else np.zeros(0, np.uint8)
                ids = raw.view(np.uint32 if wide else np.uint16)
                counts = np.diff(off) // ids.itemsize
                null = col.is_null().to_numpy(zero_copy_only=False)
                control, c_ends, coded, d_ends = encode(rank[ids], counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64(), mask=null), _binary(control, c_ends, null), _binary(coded, d_ends, null)],
                    ["doc_id", "n_tokens", "control", "data"],
                )

    return tokens.mapInArrow(run, with_id(tokens, "n_tokens long, control binary, data binary"))


def token_ids(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, control, data): every row's ranks, coded as the module says.

    The text is tokenized once; counting and coding read the tokens from the
    shared folder. Ids may be of any type. An empty table gives no rows.
    """
    bpe = pieces(path)
    wide = bpe.dtype == np.uint32
    tokens = keep(tokenize(docs, path, id_col, text_col))
    rank, by_rank = ranked(token_counts(tokens, wide), bpe.size)
    note = {RANKS: base64.b64encode(zlib.compress(by_rank.tobytes())).decode()}
    return encode_tokens(tokens, rank, wide).withColumn("data", F.col("data").alias("data", metadata=note))


#: Where the metadata of the column data has the tokens by rank.
RANKS = "tokens_by_rank"


def tokens_by_rank(coded: DataFrame) -> np.ndarray:
    """The token of each rank, from the metadata of a table of coded rows."""
    return np.frombuffer(zlib.decompress(base64.b64decode(coded.schema["data"].metadata[RANKS])), dtype=np.uint32)


def decode_texts(coded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows that token_ids() coded, also after they were written and read; null stays null."""
    token = tokens_by_rank(coded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = pieces(path).encoding.decode
        for batch in batches:
            _, n, control, data = (c.to_pylist() for c in batch.columns)
            texts_ = [None if k is None else back(token[decode(c, d, k)].tolist()) for k, c, d in zip(n, control, data)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "n_tokens", "control", "data").mapInArrow(run, with_id(coded, "text string"))
