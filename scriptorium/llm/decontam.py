"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised: capitals folded, each run of other than letters, digits
and underscores one space. An item of n bytes may be found with e = RATE * n
edits. An occurrence with at most e edits shares n - Q + 1 - Q * e of the item's
q-grams (the q-gram lemma), all on diagonals that are no more than e apart; so
they lie in one of the overlapping bands of 2 * (e + 1) diagonals, one starting
every e + 1. Bands with so many distinct shared q-grams are retained, and
verified by an alignment within the band.

Up to half the needed q-grams of an item, those that most items have, are left
out of the count, and the bound is lowered by their number: the filter still
loses nothing.

Items of under SHORTEST bytes may have as many edits as leave one q-gram that must
be shared. Those without an edit are found by the hash of their bytes from each
word's start on, where a word ends with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.spread import spread
from scriptorium.llm.storage import texts as id_and_text
from scriptorium.llm.storage import with_id
from scriptorium.llm.textkernel import _WORD, HashTable, fold, mix, passes, span_hashes

Q = 8
RATE = 0.08
#: Normalised bytes under which an item's edits are lowered until it must share a q-gram; without edits it is looked for as whole words.
SHORTEST = 32
#: Bytes of benchmark text that are searched for in one pass over the documents.
CHUNK_BYTES = 32 << 20


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, the place in data of each, and the new offsets."""
    if not len(data):
        return data, np.zeros(0, dtype=np.int64), offsets
    inside = _WORD[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    keep[begin] = inside[begin]
    at = np.flatnonzero(keep)
    low = fold(data)[at]
    low[~inside[at]] = 32
    return low, at, np.searchsorted(at, offsets)


def grams(low: np.ndarray) -> np.ndarray:
    """The Q = 8 bytes from each place on, scrambled."""
    n = max(0, len(low) - Q + 1)
    out = np.empty(n, dtype=np.uint64)
    raw = low.tobytes()
    for k in range(min(Q, n)):
        own = out[k::Q]
        own[:] = np.frombuffer(raw, dtype="<u8", count=len(own), offset=k)
    return mix(out)


class Items:
    """The benchmark's items and an index of their q-grams."""

    def __init__(self, ids: list[int], texts: list[str], rate: float = RATE):
        self.ids, self.texts = [], []
        exact: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, t in zip(ids, texts):
            raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
            low = normalise(raw, np.array([0, len(raw)]))[0]
            low = np.frombuffer(low.tobytes().strip(), dtype=np.uint8)
            if i is None or not len(low):
                continue
            if len(low) < SHORTEST and min(int(len(low) * rate), (len(low) - Q) // Q) < 1:
                exact.setdefault(len(low), []).append((i, low))
            else:
                self.ids.append(i)
                self.texts.append(low)
        self.n = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.edits = (self.n * rate).astype(np.int64)
        self.edits = np.where(self.n < SHORTEST, np.minimum(self.edits, (self.n - Q) // Q), self.edits)
        self.exact = []
        self.bytes_of: dict[int, np.ndarray] = {}
        for size, own in sorted(exact.items()):
            place = len(self.ids) + np.arange(len(own))
            self.ids += [i for i, _ in own]
            at = np.arange(len(own)) * size
            keys, first, which, count = np.unique(span_hashes(np.concatenate([t for _, t in own]), at, at + size), return_index=True, return_inverse=True, return_counts=True)
            self.bytes_of[size] = np.stack([own[k][1] for k in first])
            self.exact.append((size, HashTable(keys), place[np.argsort(which, kind="stable")], np.cumsum(count) - count, count))
        need = self.n - Q + 1 - Q * self.edits
        if (need < 1).any():
            raise ValueError("the edit rate leaves no q-gram that must be shared")
        per = [grams(t) for t in self.texts]
        item = np.repeat(np.arange(len(per)), [len(g) for g in per])
        place = np.concatenate([np.arange(len(g)) for g in per]) if per else item
        gram = np.concatenate(per) if per else np.zeros(0, dtype=np.uint64)
        keys, which, count = np.unique(gram, return_inverse=True, return_counts=True)
        order = np.lexsort((-count[which], item))
        nth = np.arange(len(order)) - np.repeat(np.cumsum(self.n - Q + 1) - (self.n - Q + 1), self.n - Q + 1)
        drop = np.zeros(len(order), dtype=bool)
        drop[order] = (nth < (need // 2)[item[order]]) & (count[which[order]] > 1)
        self.need = need - np.bincount(item[drop], minlength=len(per))
        item, place, which = item[~drop], place[~drop], which[~drop]
        order = np.argsort(which, kind="stable")
        self.item, self.place = item[order], place[order]
        used, per_key = np.unique(which, return_counts=True)
        self.table = HashTable(keys[used])
        self.size = per_key
        self.first = np.cumsum(per_key) - per_key


def align(windows: list[np.ndarray], patterns: list[np.ndarray], widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern within its window, and the window place where such a match ends.

    Row i, diagonal d stands for window place i + d; diagonals 0 to widths - 1 are
    in the band. A match may start and end on any of them.
    """
    k, wide, rows = len(windows), int(widths.max()), max(len(p) for p in patterns)
    far = np.int32(1 << 20)
    pat = np.zeros((k, rows), dtype=np.uint8)
    win = np.full((k, rows + wide), 255, dtype=np.uint8)
    for x, (w, p) in enumerate(zip(windows, patterns)):
        pat[x, : len(p)] = p
        win[x, : min(len(w), rows + wide)] = w[: rows + wide]
    length = np.array([len(p) for p in patterns])
    step = np.arange(wide, dtype=np.int32)
    out_of_band = step[None, :] >= widths[:, None]
    now = np.where(out_of_band, far, np.int32(0)).astype(np.int32)
    best, end = np.full(k, far), np.zeros(k, dtype=np.int64)
    for i in range(rows):
        nxt = now + (win[:, i : i + wide] != pat[:, i : i + 1])
        nxt[:, :-1] = np.minimum(nxt[:, :-1], now[:, 1:] + 1)
        nxt[out_of_band] = far
        now = np.minimum.accumulate(nxt - step, axis=1) + step
        done = np.flatnonzero(length == i + 1)
        if len(done):
            d = now[done].argmin(axis=1)
            best[done], end[done] = now[done, d], i + 1 + d
    return best, end


def search(column: pa.Array, items: Items) -> Iterator[tuple[np.ndarray, ...]]:
    """For each pass: row, item, begin, end (in characters) and edits of what is found."""
    n_items = len(items.texts)
    for lo, _, data, offsets in passes(column):
        low, at, ends = normalise(data, offsets)
        for d, i, begin, end in _exact(low, ends, items):
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            start = chars[offsets[d]]
            yield lo + d, i, chars[at[begin]] - start, chars[at[end - 1] + 1] - start, np.zeros(len(d), dtype=np.int64)
        if not n_items or len(low) < Q:
            continue
        row = items.table.find(grams(low))
        pos = np.flatnonzero(row >= 0)
        row = row[pos]
        doc = np.searchsorted(ends, pos, side="right") - 1
        whole = pos + Q <= ends[doc + 1]
        pos, row, doc = pos[whole], row[whole], doc[whole]
        size = items.size[row]
        post = np.repeat(items.first[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pos, doc, item, place = np.repeat(pos, size), np.repeat(doc, size), items.item[post], items.place[post]
        key = doc * n_items + item
        if (len(ends) - 1) * n_items <= 4 * len(key):
            count = np.bincount(key)[key]
        else:
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            count = count[back]
        many = np.flatnonzero(count >= items.need[item])
        if not len(many):
            continue
        pos, doc, item, place = pos[many], doc[many], item[many], place[many]
        stride = items.edits[item] + 1
        band = (pos - ends[doc] - place + items.n[item]) // stride  # not negative
        triple = np.empty((2 * len(pos), 4), dtype=np.int64)
        for half in (0, 1):
            triple[half::2] = np.column_stack([doc, item, band - half, place])
        triple = np.unique(triple, axis=0)
        bands, count = np.unique(triple[:, :3], axis=0, return_counts=True)
        bands = bands[count >= items.need[bands[:, 1]]]
        if not len(bands):
            continue
        same = (bands[1:, :2] == bands[:-1, :2]).all(axis=1) & (bands[1:, 2] - bands[:-1, 2] <= 1)
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(begin[1:], len(bands)) - 1
        d, i = bands[begin, 0], bands[begin, 1]
        stride = items.edits[i] + 1
        low_diag = bands[begin, 2] * stride - items.n[i] - items.edits[i]
        width = (bands[last, 2] + 2) * stride - items.n[i] + items.edits[i] + 1 - low_diag
        found = []
        for part in range(0, len(d), 256):
            s = slice(part, part + 256)
            found.append(_verify(low, ends, d[s], i[s], low_diag[s], width[s], items))
        d, i, begin, end, edits = (np.concatenate(x) for x in zip(*found))
        if len(d):
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            start = chars[offsets[d]]
            yield lo + d, i, chars[at[begin]] - start, chars[at[end - 1] + 1] - start, edits


def _exact(low: np.ndarray, ends: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length, where items without edits stand as whole words: doc, item, begin, end."""
    if not items.exact or not len(low):
        return
    first = np.concatenate([[True], low[:-1] == 32])
    first[ends[:-1][ends[:-1] < len(low)]] = True
    pos = np.flatnonzero(first & (low != 32))
    last = ends[np.searchsorted(ends, pos, side="right")]
    for size, table, item, begin, count in items.exact:
        fits = pos + size <= last
        p = pos[fits]
        p = p[(p + size == last[fits]) | (low[np.minimum(p + size, len(low) - 1)] == 32)]
        row = table.find(span_hashes(low, p, p + size))
        p, row = p[row >= 0], row[row >= 0]
        if len(p):
            n = count[row]
            same = (low[p[:, None] + np.arange(size)] == items.bytes_of[size][row]).all(axis=1)
            p, row, n = p[same], row[same], n[same]
            which = item[np.repeat(begin[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            p = np.repeat(p, n)
            yield np.searchsorted(ends, p, side="right") - 1, which, p, p + size


def _verify(low: np.ndarray, ends: np.ndarray, doc: np.ndarray, item: np.ndarray, low_diag: np.ndarray, width: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Those of the regions that hold their item within its edits: doc, item, begin, end, edits."""
    pats = [items.texts[k] for k in item]
    wins = []
    for k, d in enumerate(doc):
        a = ends[d] + low_diag[k]
        b = a + width[k] + items.n[item[k]]
        text = low[max(a, ends[d]) : max(ends[d], min(b, ends[d + 1]))]
        wins.append(np.concatenate([np.full(max(0, ends[d] - a), 255, dtype=np.uint8), text]))
    edits, end = align(wins, pats, width)
    ok = np.flatnonzero((edits <= items.edits[item]) & (edits < items.n[item]))
    if not len(ok):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    back = [np.concatenate([wins[k][: end[k]], np.full(max(0, end[k] - len(wins[k])), 255, dtype=np.uint8)])[::-1] for k in ok]
    _, size = align(back, [pats[k][::-1] for k in ok], np.minimum(width[ok], 2 * items.edits[item[ok]] + 1))
    stop = ends[doc[ok]] + low_diag[ok] + end[ok]
    start = np.maximum(stop - size, ends[doc[ok]])
    return doc[ok], item[ok], start, np.minimum(stop, ends[doc[ok] + 1]), edits[ok].astype(np.int64)


def _benchmark(items: DataFrame, rate: float) -> Iterator[Items]:
    """The benchmark in parts of at most about CHUNK_BYTES, each small enough to send to every task."""
    src = items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // CHUNK_BYTES) or 1
    for k in range(parts):
        rows = src.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).orderBy("id", "text").collect()
        yield Items([r["id"] for r in rows], [r["text"] for r in rows], rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, begin, end, edits): where documents hold items, in characters.

    One row for each region of neighbouring bands, with its best match. Null and
    empty texts hold nothing, and items that are null or without a word are
    not looked for; repeated rows are each searched; an empty benchmark or table
    gives no rows. Other columns are not looked at.
    """
    src = id_and_text(docs)
    out = None
    for items in _benchmark(benchmark, rate):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            ids = np.array(items.ids, dtype=np.int64)
            for batch in batches:
                for row, item, begin, end, edits in search(batch.column(1), items):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(ids[item]), pa.array(begin), pa.array(end), pa.array(edits)], ["doc_id", "item_id", "begin", "end", "edits"])

        part = src.mapInArrow(run, with_id(src, "item_id long, begin long, end long, edits long"))
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns; no shuffle."""
    at = docs.columns.index("text")
    for items in _benchmark(benchmark, rate):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(at)
                if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
                    column = column.cast(pa.string())
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, *_ in search(column, items):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = spread(docs).mapInArrow(run, docs.schema)
    return docs
