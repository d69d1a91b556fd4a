"""Near-duplicate groups by MinHash and a multi-index Hamming join.

A document's features are its words of at least ``LONG`` bytes, its pairs of
neighbouring words with such a word among them, its pairs of a word with itself,
and, for each other pair, the three words that begin with it (at the end of a
text, that end with it). So every word is in a feature, but none is as common as
short words and their pairs are, which unrelated texts share. A text of one or
two short words has these and their pair. The n-th occurrence
of a feature is a feature of its own, so repeats count. ``K`` minima over the
features, ``B`` bits kept of each, are the signature. The distance of two
signatures is the number of places in which they differ; J = 1 - distance / K
estimates the (multiset) Jaccard similarity of the features.

The signature is cut into ``CHUNKS`` chunks of ``WIDTH`` symbols. Were each
chunk of a pair to differ in two or more places, the pair would be at distance
2 * CHUNKS or more; so a pair within ``RADIUS`` = 2 * CHUNKS - 1 has a chunk with
at most one error. All allowed errors of a chunk are enumerated by leaving out
one symbol at a time; a pair within the radius then shares one of those keys
*for certain*. Signatures that share a key are compared in full.

Keys are counted before anything is gathered. Those of at most ``MOST``
signatures are gathered and compared. The signatures of a larger one are each
compared with its least member; those that aren't within the radius of it are
compared, in blocks of about ``MOST``, among each other and with the rest, so no
task holds more than two blocks and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from scriptorium.functions.spread import spread
from scriptorium.llm.storage import drop, id_of, keep, small
from scriptorium.llm.textkernel import Words, mix, passes

K, B, WIDTH = 80, 16, 5
CHUNKS = K // WIDTH
RADIUS = 2 * CHUNKS - 1
LONG = 6
#: Signatures of one key that are gathered in one row.
MOST = 512

_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, K, dtype=np.uint32)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes ordered by text, and the number of features of each text."""
    h, n = words.hashes, len(words.hashes)
    doc = words.doc_of()
    if n == 0:
        return h, np.zeros(len(words.counts), dtype=np.int64)
    long = (words.ends - words.starts) >= LONG
    same = words.next_in_text()
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ np.uint64(0x632BE59BD9B4E019)))
    pair_ok = same & (long[:-1] | long[1:] | (h[:-1] == h[1:]))
    short = np.flatnonzero(same & ~pair_ok)
    inner = np.append(same, False)
    three = np.where(inner[short + 1], short, short - 1)
    three = three[inner[three]]  # at -1 inner is False
    triple = mix(pair[three] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[three + 2] ^ np.uint64(0x165667B19E3779F9)))
    some = np.zeros(len(words.counts), dtype=bool)
    some[doc[long]] = True
    some[doc[:-1][pair_ok]] = True
    some[doc[three]] = True
    bare = ~some[doc]
    feats = np.concatenate([h[long | bare], pair[pair_ok | (same & bare[:-1])], triple])
    where = np.concatenate([doc[long | bare], doc[:-1][pair_ok | (same & bare[:-1])], doc[three]])
    order = np.argsort(mix(where.astype(np.uint64) + np.uint64(1)) ^ feats)
    feats, where = feats[order], where[order]
    run = np.flatnonzero(np.concatenate([[True], (feats[1:] != feats[:-1]) | (where[1:] != where[:-1])]))
    nth = np.arange(len(feats)) - np.repeat(run, np.diff(np.append(run, len(feats))))
    feats = feats + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(where.astype(np.int32), kind="stable")
    return feats[order], np.bincount(where, minlength=len(words.counts))


def signatures(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a word, and their signatures, one row of K symbols each."""
    feats, counts = features(words)
    feats = (feats >> np.uint64(32)).astype(np.uint32)
    rows = np.flatnonzero(counts)
    out = np.empty((len(rows), K), dtype=np.uint16)
    if len(rows):
        begin = (np.cumsum(counts) - counts)[rows]
        buffer = np.empty_like(feats)
        for j in range(K):
            np.multiply(feats, _MULTIPLY[j], out=buffer)
            np.add(buffer, _ADD[j], out=buffer)
            out[:, j] = mix(np.minimum.reduceat(buffer, begin).astype(np.uint64)) & np.uint64(0xFFFF)
    return rows, out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, _, data, offsets in passes(batch.column(1)):
            rows, sig = signatures(Words(data, offsets))
            flat = pa.py_buffer(sig.tobytes())
            size = sig.shape[1] * 2
            ends = pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows + lo)), pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, flat])],
                ["id", "sig"],
            )


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig) of every document with an id, a whole number, and at least one word."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return spread(src.where("id IS NOT NULL AND text IS NOT NULL")).mapInArrow(_sign, "id long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :]
    return np.frombuffer(data, dtype=np.uint16, count=off[-1] // 2)[off[0] // 2 :].reshape(len(column), K)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """CHUNKS * WIDTH keys a row: each chunk with each of its symbols left out.

    For one place the key is a bijection of the four symbols, so it adds no
    false match there; those between places are found in the full comparison.
    """
    s = sig.reshape(-1, CHUNKS, WIDTH)
    out = np.empty((len(s), CHUNKS, WIDTH), dtype=np.int64)
    for gap in range(WIDTH):
        a, b, c, d = (s[:, :, k].astype(np.uint64) for k in range(WIDTH) if k != gap)
        symbols = (a << np.uint64(48)) | (b << np.uint64(32)) | (c << np.uint64(16)) | d
        place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(gap + 1)
        out[:, :, gap] = mix(symbols ^ mix(place)[None, :]).view(np.int64)
    return out.reshape(len(s), CHUNKS * WIDTH)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 8192):
            part = batch.slice(lo, 8192)
            keys = chunk_keys(_matrix(part.column(1)))
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])


def link(ids: np.ndarray, sig: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(least id, other id) for each component of the graph of pairs within the radius.

    A member that is reached isn't looked for again, so a group of n copies
    costs about n comparisons, and only what stays apart is compared with all.
    """
    order = np.argsort(ids, kind="stable")
    ids, sig = ids[order], sig[order]
    left, out = np.arange(len(ids)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = (sig[left] != sig[front.pop()]).sum(axis=1) <= radius
            found = left[near]
            out.extend((int(ids[root]), int(ids[x])) for x in found)
            front.extend(found.tolist())
            left = left[~near]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        members = column.flatten()
        ids = members.field(0).to_numpy(zero_copy_only=False)
        sig = _matrix(members.field(1))
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        two = (ends - begin) == 2
        p = begin[two]
        p = p[(sig[p] != sig[p + 1]).sum(axis=1) <= RADIUS] if len(p) else p
        a, b = np.minimum(ids[p], ids[p + 1]), np.maximum(ids[p], ids[p + 1])
        more = [e for s, t in zip(begin[~two], ends[~two]) for e in link(ids[s:t], sig[s:t])]
        if more:
            m = np.array(more, dtype=np.int64)
            a, b = np.concatenate([a, m[:, 0]]), np.concatenate([b, m[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distance of each row's two signatures in their place."""
    for batch in batches:
        d = (_matrix(batch.column(3)) != _matrix(batch.column(4))).sum(axis=1) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(d.astype(np.int32))], ["key", "id", "first", "d"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each cell: among its far members, and one from each of them to a near one."""
    for batch in batches:
        column = batch.column(0)
        members = column.flatten()
        ids, near = (members.field(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        sig = _matrix(members.field(1))
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        found: list[tuple[int, int]] = []
        for s, t in zip([0, *ends], ends):
            own, others = s + np.flatnonzero(near[s:t]), s + np.flatnonzero(~near[s:t])
            if not len(own):
                found += link(ids[s:t], sig[s:t])
                continue
            for k in others:
                hit = np.flatnonzero((sig[own] != sig[k]).sum(axis=1) <= RADIUS)
                found += [(int(ids[k]), int(ids[own[hit[0]]]))] if len(hit) else []
        a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _hot_links(members: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Links (a, b) among the members (key, id, first) of keys that are too large to gather.

    The near ones, within the radius of ``first``, are linked to it and so with each
    other. Every other one is compared with all others and all near ones; all near
    ones are one component already, so one link to them is enough.
    """
    signed = members.join(classes, "id")
    heads = classes.select(F.col("id").alias("first"), F.col("sig").alias("head"))
    firsts = members.select("first").distinct().join(heads, "first")
    far = keep(signed.join(small(firsts), "first").select("key", "id", "first", "sig", "head").mapInArrow(_far, "key long, id long, first long, d int"))
    star = far.where((F.col("d") <= RADIUS) & (F.col("id") != F.col("first"))).select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = F.col("d") <= RADIUS
    sizes = far.groupBy("key").agg(F.count(F.when(~near, 1)).alias("out"), F.count(F.when(near, 1)).alias("in")).where("out > 0")
    sizes = sizes.select("key", F.ceil(F.col("out") / most).cast("int").alias("outs"), F.ceil(F.col("in") / most).cast("int").alias("ins"))
    sizes = keep(sizes)
    if sizes.isEmpty():
        return star
    rest = far.join(small(sizes), "key").withColumn("near", near).withColumn("block", F.pmod(F.xxhash64("id"), F.when(near, F.col("ins")).otherwise(F.col("outs"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("outs") - 1)
    with_near = F.when(F.col("ins") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("ins"), F.lit(1)) - 1), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j"))))
    cells = F.when(F.col("near"), F.transform(others, lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j"))))
    cells = cells.otherwise(F.concat(F.transform(others, lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"))), F.coalesce(with_near, F.array().cast("array<struct<i:int,j:int>>"))))
    placed = rest.select("key", "id", "near", F.explode(cells).alias("cell")).join(classes, "id")
    grouped = placed.groupBy("key", "cell").agg(F.collect_list(F.struct("id", "sig", "near")).alias("m"))
    return star.unionAll(grouped.select("m").mapInArrow(_cells, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id reachable from each id of the edges (a, b).

    Alternating large-star and small-star steps. Least neighbours are found by an
    aggregate, which is combined before its shuffle, and joined back, so an id
    with very many neighbours is in no single task. Each round's edges are
    written to the shared folder, and the loop ends when a round changes none.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def with_least(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("u").agg(F.min("v").alias("m")), "u")

    mark = state(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = keep(large)
        links = with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        last, now, old = now, keep(links.select("e.*").where("u <> v").distinct()), mark
        mark = state(now)
        drop(last)
        drop(large)
        if mark == old:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """(name, id): numbers, in the order of the ids, for ids that aren't whole numbers."""
    ids = docs.select(F.col(f"`{id_col}`").alias("name")).where("name IS NOT NULL").distinct()
    return keep(ids.orderBy("name").withColumn("id", F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, keeper_id) for every document that repeats the keeper of its group.

    Groups are the connected components of all pairs within the radius; the
    keeper is the least id of a group and has no row itself. Ids may be of any
    type that can be sorted. Rows without an id or without a word join no group.
    Repeated rows of one id are one document (its signature is compared once for
    each differing text). An empty table gives no rows. Other columns are not
    looked at.
    """
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return _near_duplicates(docs, id_col, text_col, most)
    names = numbered(docs, id_col)
    own = docs.select(F.col(f"`{id_col}`").alias("name"), F.col(f"`{text_col}`").alias("text")).join(names, "name")
    out = _near_duplicates(own, "id", "text", most)
    gone, keeper = (names.withColumnsRenamed({"name": n, "id": k}) for n, k in (("of", "doc_id"), ("by", "keeper_id")))
    return out.join(gone, "doc_id").join(keeper, "keeper_id").select(F.col("of").alias("doc_id"), F.col("by").alias("keeper_id"))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    signed = keep(sign(docs, id_col, text_col))
    classes = keep(signed.groupBy("sig").agg(F.min("id").alias("id")))
    keys = classes.select("id", "sig").mapInArrow(_keys, "key long, id long")
    # of keys with the same members one is enough; they are told by two hashes over the members
    ways = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"), *ways).where("n > 1")
    shared = keep(shared.groupBy("n", "first", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n", "first"))
    members = keep(keys.join(small(shared), "key"))
    few = members.where(F.col("n") <= most).join(classes, "id").groupBy("key").agg(F.collect_list(F.struct("id", "sig")).alias("m"))
    edges = few.select("m").mapInArrow(_verify, "a long, b long")
    if not shared.where(F.col("n") > most).isEmpty():
        edges = edges.unionAll(_hot_links(members.where(F.col("n") > most).select("key", "id", "first"), classes, most))
    roots = components(edges)
    by_sig = classes.withColumnRenamed("id", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("root", "rep").alias("keeper_id"))
    out = signed.join(by_sig, "sig").where("id <> keeper_id")
    return out.select(F.col("id").alias("doc_id"), "keeper_id").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """The documents that no group drops; all columns stay as they are."""
    gone = keep(near_duplicates(docs, id_col, text_col, most).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(small(gone), id_of(docs, id_col) == gone["__gone"], "left_anti")
