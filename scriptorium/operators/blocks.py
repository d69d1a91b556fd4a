"""Blocks of one reference, their differences between two versions of a document, and reverts.

A block is a maximal run of tokens with one reference; its id is the reference
and its first token's id. Blocks of both versions are matched by their ids in
order, as many as can be; deleted and added ones of the same reference are then
paired in order.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from typing import NamedTuple

import numpy as np

from scriptorium.operators.columns import Tokens


class Block(NamedTuple):
    block_id: str
    semantic_sid: str
    begin: int
    end: int
    previous: str | None
    text: str


class Difference(NamedTuple):
    block_id: str
    semantic_sid: str
    status: str
    original: Block | None
    current: Block | None
    original_text: str
    current_text: str
    original_text_only: str
    current_text_only: str
    is_whitespace_change: bool
    is_usfm_structure_change: bool

    @property
    def undo_side(self) -> str:
        return "Original" if self.status == "Deleted" else "Current"


def borders(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """First token of each block, and the one past its last."""
    group = t.sid_groups()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, t.n), dtype=bool), group[1:] != group[:-1]]))
    return first, np.append(first[1:], t.n)[: len(first)]


def named(sids: list[str | None], ids: list[str | None], begins: list[int], ends: list[int], texts: list[str]) -> list[Block]:
    """One document's blocks; without a first token's id they are counted for each reference."""
    out: list[Block] = []
    seen: dict[str, int] = defaultdict(int)
    for sid, id_, a, b, text in zip(sids, ids, begins, ends, texts):
        sid = sid or ""
        if id_ is None:
            id_ = f"{sid}#{seen[sid]}"
            seen[sid] += 1
        else:
            id_ = f"{sid}::{id_}"
        out.append(Block(id_, sid, a, b, out[-1].block_id if out else None, text))
    return out


def of_tokens(tokens: list[tuple[str | None, str | None, str]], allow_empty: bool = True) -> list[Block]:
    """Blocks of a stream of (reference, id, text); without ``allow_empty`` tokens that have no reference part blocks and are in none."""
    rows, k = [], 0
    while k < len(tokens):
        sid = tokens[k][0] or ""
        end = k + 1
        while end < len(tokens) and (tokens[end][0] or "") == sid:
            end += 1
        if sid or allow_empty:
            rows.append((sid, tokens[k][1], k, end, "".join(x[2] for x in tokens[k:end])))
        k = end
    return named(*map(list, zip(*rows))) if rows else []


def of_documents(t: Tokens) -> list[list[Block]]:
    """The blocks of each document."""
    first, end = borders(t)
    sids, ids = t.references(first, "diff").to_pylist(), t.ids(first).to_pylist()
    base = t.first[:-1][t.doc[first]]
    begins, ends = (first - base).tolist(), (end - base).tolist()
    texts = [t.raw[a:b].decode() for a, b in zip(t.start[first].tolist(), t.end[end - 1].tolist())]
    cut = np.searchsorted(first, t.first).tolist()
    return [named(sids[a:b], ids[a:b], begins[a:b], ends[a:b], texts[a:b]) for a, b in zip(cut, cut[1:])]


_MARKER = re.compile(r"\\[A-Za-z][A-Za-z0-9]*\*?")
_FLAT = re.compile(r"[ \t]+")
#: Unicode's white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[{WHITE}]+")


def _tight(text: str) -> str:
    return _SPACES.sub("", text)


def plain(text: str) -> str:
    """Text without markers, for display."""
    if "\\" in text:
        text = _MARKER.sub("", text)
    return (_FLAT.sub(" ", text) if "  " in text or "\t" in text else text).strip(WHITE)


def _changed(block_id: str, a: Block | None, b: Block | None) -> Difference:
    if b is None:
        x = plain(a.text)
        return Difference(block_id, a.semantic_sid, "Deleted", a, None, a.text, "", x, "", False, not x)
    y = plain(b.text)
    if a is None:
        return Difference(block_id, b.semantic_sid, "Added", None, b, "", b.text, "", y, False, not y)
    if a.text == b.text:
        return Difference(block_id, a.semantic_sid, "Unchanged", a, b, a.text, b.text, y, y, False, False)
    x, space = plain(a.text), _tight(a.text) == _tight(b.text)
    return Difference(block_id, a.semantic_sid, "Modified", a, b, a.text, b.text, x, y, space, not space and _tight(x) == _tight(y))


def in_order(places: list[int]) -> list[int]:
    """Positions of a longest rising run of places."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(places)
    for k, p in enumerate(places):
        j = bisect_left(tails, p)
        back[k] = at[j - 1] if j else -1
        tails[j : j + 1], at[j : j + 1] = [p], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


Pair = tuple[str, Block | None, Block | None]  # id, original and current


def matched(original: list[Block], current: list[Block]) -> list[Pair]:
    """Every block of either version, in order: what stays, and between that first what goes, then what comes."""
    where = {b.block_id: k for k, b in enumerate(current)}
    both = [k for k, b in enumerate(original) if b.block_id in where]
    pairs = [(both[j], where[original[both[j]].block_id]) for j in in_order([where[original[k].block_id] for k in both])]
    out: list[Pair] = []
    gone, come = defaultdict(list), defaultdict(list)
    i = j = 0
    for x, y in [*pairs, (len(original), len(current))]:
        for b in original[i:x]:
            gone[b.semantic_sid].append(len(out))
            out.append((b.block_id, b, None))
        for b in current[j:y]:
            come[b.semantic_sid].append(len(out))
            out.append((b.block_id, None, b))
        if x < len(original):
            out.append((original[x].block_id, original[x], current[y]))
        i, j = x + 1, y + 1
    skip = set()
    for sid, rows in gone.items():
        for x, y in zip(rows, come.get(sid, ())):
            out[x] = (out[x][0], out[x][1], out[y][2])
            skip.add(y)
    return [p for k, p in enumerate(out) if k not in skip] if skip else out


def status(a: Block | None, b: Block | None) -> str:
    return "Deleted" if b is None else "Added" if a is None else "Unchanged" if a.text == b.text else "Modified"


def diff(original: list[Block], current: list[Block]) -> list[Difference]:
    """matched(), with what differs."""
    return [_changed(*p) for p in matched(original, current)]


def by_chapter(baseline: list[Block], current: list[Block], book: str = "unknown") -> dict[str, dict[int, list[Difference]]]:
    """Differences by book and chapter, each chapter's blocks compared among themselves only."""
    sides: dict[tuple[str, int], tuple[list[Block], list[Block]]] = defaultdict(lambda: ([], []))
    for side, blocks in enumerate((baseline, current)):
        for b in blocks:
            m = re.match(r"([^ ]*) ([0-9]+)", b.semantic_sid)
            sides[(m[1], int(m[2])) if m else (book, 0)][side].append(b)
    out: dict[str, dict[int, list[Difference]]] = {}
    for name, chapter in sorted(sides):
        if found := diff(*sides[name, chapter]):
            out.setdefault(name, {})[chapter] = found
    return out


def replaced(diffs: dict, book: str, chapter: int, new: list) -> dict:
    """The map with a chapter's differences replaced; chapters and books without any are left out."""
    out = {b: dict(c) for b, c in diffs.items() if b != book}
    own = {c: d for c, d in diffs.get(book, {}).items() if c != chapter}
    if new:
        own[chapter] = list(new)
    if own:
        out[book] = dict(sorted(own.items()))
    return dict(sorted(out.items()))


def replaced_many(diffs: dict, chapters: list[tuple[str, int, list]]) -> dict:
    for book, chapter, new in chapters:
        diffs = replaced(diffs, book, chapter, new)
    return diffs


def flattened(diffs: dict) -> list:
    return [d for book in diffs.values() for chapter in book.values() for d in chapter]


Stream = list[tuple[str | None, str | None, str]]  # reference, id and text of each token


def _of_sid(block_id: str, blocks: list[Block]) -> Block | None:
    sid = block_id.split("::")[0] if "::" in block_id else block_id.rsplit("#", 1)[0]
    return next((b for b in blocks if b.semantic_sid == sid), None) if block_id else None


class _Link:
    """A block of a text that is being changed, between its neighbours."""

    __slots__ = ("block_id", "sid", "parts", "rank", "left", "right")

    def __init__(self, block_id: str, sid: str, parts: list, rank: int = 0):
        self.block_id, self.sid, self.parts, self.rank = block_id, sid, parts, rank
        self.left: _Link | None = None
        self.right: _Link | None = None


#: Ranks that lie between neighbours at first.
_ROOM = 1 << 32


class _Chain:
    """Blocks in order, found by id (the last) and by reference (the first); neighbours of one reference are one block."""

    def __init__(self, blocks: list[Block], parts: list):
        self.by_id: dict[str, set[_Link]] = defaultdict(set)
        self.by_sid: dict[str, set[_Link]] = defaultdict(set)
        self.edge = last = _Link("", "", [])
        for b, p in zip(blocks, parts):
            link = _Link(b.block_id, b.semantic_sid, [p])
            last.right, link.left, last = link, last, link
            self._enter(link)
        self._number()

    def _enter(self, x: _Link) -> None:
        self.by_id[x.block_id].add(x)
        self.by_sid[x.sid].add(x)

    def _number(self) -> None:
        x, k = self.edge, 0
        while x is not None:
            x.rank, x, k = k, x.right, k + _ROOM

    def find(self, block_id: str) -> _Link | None:
        return max(self.by_id.get(block_id) or (), key=lambda x: x.rank, default=None)

    def first(self, sid: str) -> _Link | None:
        return min(self.by_sid.get(sid) or (), key=lambda x: x.rank, default=None)

    def drop(self, x: _Link) -> _Link:
        """Take a block out; gives its left neighbour."""
        self.by_id[x.block_id].discard(x)
        self.by_sid[x.sid].discard(x)
        x.left.right = x.right
        if x.right is not None:
            x.right.left = x.left
        return x.left

    def put(self, after: _Link, x: _Link) -> _Link:
        """Put a block in; gives the block that it is in."""
        x.left, x.right, after.right = after, after.right, x
        x.rank = after.rank + _ROOM
        if x.right is not None:
            x.right.left = x
            x.rank = (after.rank + x.right.rank) // 2
            if x.rank == after.rank:
                self._number()
        self._enter(x)
        return self.join(after) or x

    def join(self, x: _Link) -> _Link | None:
        """Make a block and its right neighbour one, if they have one reference."""
        y = x.right
        if x is self.edge or y is None or x.sid != y.sid:
            return None
        self.drop(y)
        x.parts += y.parts
        return x

    def all(self) -> list:
        out, x = [], self.edge.right
        while x is not None:
            out += x.parts
            x = x.right
        return out


def _sid_of(block_id: str) -> str:
    return block_id.split("::")[0] if "::" in block_id else block_id.rsplit("#", 1)[0]


def reverted(block_ids: list[str], old: list[Block], new: list[Block], old_parts: list, new_parts: list) -> list:
    """Parts (one for each block, of any kind) of new with these blocks reverted in turn, as revert() does it.

    Only a block's neighbourhood changes with each, so the work grows with the
    number of blocks and not with its square. Blocks have the id of their first token.
    """
    old_by = {b.block_id: k for k, b in enumerate(old)}
    old_first: dict[str, int] = {}
    for k, b in enumerate(old):
        old_first.setdefault(b.semantic_sid, k)
    chain = _Chain(new, new_parts)
    for block_id in block_ids:
        sid = _sid_of(block_id) if block_id else None
        k = old_by.get(block_id)
        k = old_first.get(sid) if k is None else k
        now = chain.find(block_id) or chain.first(sid)
        if k is None and now is None:
            continue
        if now is not None:
            after = chain.drop(now)
        else:
            anchor, tried = old[k].previous, set()
            while anchor is not None and (found := chain.find(anchor)) is None:
                tried.add(anchor)
                anchor = old[old_by[anchor]].previous if anchor in old_by else None
                anchor = None if anchor in tried else anchor  # ids that are there twice can lead round
            after = chain.edge if anchor is None else found
        chain.join(chain.put(after, _Link(old[k].block_id, old[k].semantic_sid, [old_parts[k]])) if k is not None else after)
    return chain.all()


def revert(block_ids: list[str], baseline: Stream, current: Stream) -> Stream:
    """current with each of these blocks, in turn, as it is in baseline.

    A block that isn't there by its id is the first of its reference. One that only
    baseline has comes after its nearest predecessor that current has, else first;
    one that only current has goes.
    """
    old, new = of_tokens(baseline), of_tokens(current)
    if any(stream[b.begin][1] is None for stream, own in ((baseline, old), (current, new)) for b in own):
        return _revert_counted(block_ids, baseline, current)
    cut = lambda stream, own: [stream[b.begin : b.end] for b in own]
    return [x for part in reverted(block_ids, old, new, cut(baseline, old), cut(current, new)) for x in part]


def _revert_counted(block_ids: list[str], baseline: Stream, current: Stream) -> Stream:
    """As revert(), where blocks without an id are counted for each reference, so that any change may rename others."""
    old = of_tokens(baseline)
    old_by = {b.block_id: b for b in old}
    for block_id in block_ids:
        new = of_tokens(current)
        new_by = {b.block_id: b for b in new}
        was = old_by.get(block_id) or _of_sid(block_id, old)
        now = new_by.get(block_id) or _of_sid(block_id, new)
        if was is None and now is None:
            continue
        if now is None:
            anchor = was.previous
            while anchor is not None and anchor not in new_by:
                anchor = old_by[anchor].previous if anchor in old_by else None
            at = end = 0 if anchor is None else new_by[anchor].end
        else:
            at, end = now.begin, now.end
        current = current[:at] + (baseline[was.begin : was.end] if was else []) + current[end:]
    return current
