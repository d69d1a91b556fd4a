"""Language-model scoring by a Brown class-based bigram model.

The vocabulary has every word that occurs ``LEAST`` times, so it grows with the
corpus. Its frequent words, those whose share of the corpus is at least ``SHARE``
(the ``FREQUENT`` most frequent ones at most), are assigned to ``CLASSES`` classes
by the exchange algorithm: in turn, each word goes to the class that raises the
likelihood of the corpus most, until none moves. Each other word of the vocabulary
then goes to the one of these classes under which its occurrences, with the
classes of their neighbours, are likeliest. Words seen once belong to ``RARE``
shape classes by their last two bytes. The model is

    p(w | v) = p(class(w) | class(v)) * p(w | class(w))

with add-one smoothed transitions and, within a class, add-one smoothed words
(in a shape class every word type is equally likely). Unigram and bigram counts
are those of the whole corpus; every document is scored in whole. Words are told
apart by 64-bit hashes.

The driver has the frequent words and their pairs only, whose number is bounded.
The other words stay a table: each block of documents is coded with the numbers
of its own distinct words, these are joined with the table, and the block gets
back the classes and counts of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.llm.storage import keep, texts, with_id
from scriptorium.llm.textkernel import HashTable, Words, mix, passes, utf8

SHARE, FREQUENT = 5e-5, 4096
LEAST = 2
CLASSES = 48
RARE = 16


def shapes(words: Words) -> np.ndarray:
    """The shape class, 0 to RARE - 1, of each word."""
    last = words.low[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.low[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    return (mix(last * np.uint64(256) + before) >> np.uint64(32)).astype(np.int64) % RARE


#: Entries that a task gathers before it adds them up and hands them on, and words of a block.
GATHERED, BLOCK = 1 << 20, 1 << 19
#: Words of the corpus for each range of hashes that a task handles at a time.
RANGE = 1 << 20


def _added_up(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sums of counts by key, from parts (key, count, ...) of which several are gathered; what else a key has is kept."""

    def merged() -> tuple[np.ndarray, ...]:
        key, n, *more = (np.concatenate(x) for x in zip(*held))
        key, first, back = np.unique(key, return_index=True, return_inverse=True)
        return key, np.bincount(back, n, minlength=len(key)).astype(np.int64), *(x[first] for x in more)

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > GATHERED:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for _, _, data, offsets in passes(batch.column(0)):
                words = Words(data, offsets)
                key, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                yield key, n, shapes(words)[first]

    for key, n, shape in _added_up(parts()):
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(n)], ["word", "shape", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, shape, n) of every word form of the corpus; word is its 64-bit hash."""
    counts = texts(docs).where("text IS NOT NULL").select("text").mapInArrow(_count_words, "word long, shape int, n long")
    return counts.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


class Vocabulary:
    """Word numbers: the shape classes first, then one for the start of a text, then the frequent words."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = HashTable(keys.view(np.uint64))
        self.size = RARE + 1 + len(keys)

    def numbers(self, words: Words) -> np.ndarray:
        row = self.table.find(words.hashes).astype(np.int64)
        return np.where(row >= 0, row + RARE + 1, shapes(words))


def bigram_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(a, b, n): how often number b follows number a; RARE follows nothing and starts each text."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for _, _, data, offsets in passes(batch.column(0)):
                words = Words(data, offsets)
                now = vocabulary.numbers(words)
                before = np.concatenate([[RARE], now[:-1]])
                before[words.first[:-1][words.counts > 0]] = RARE
                yield np.unique(before * vocabulary.size + now, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _added_up(parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

    pairs = texts(docs).where("text IS NOT NULL").select("text").mapInArrow(run, "pair long, n long")
    size = vocabulary.size
    return pairs.groupBy("pair").agg(F.sum("n").alias("n")).select(F.expr(f"pair div {size}").alias("a"), F.expr(f"pair % {size}").alias("b"), "n")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, classes: int = CLASSES, rounds: int | None = None) -> np.ndarray:
    """Class of each of the ``size`` word numbers.

    Numbers up to RARE keep a class of their own; the others start in turn in
    the free classes, most frequent first, and are exchanged until a round moves
    none (or for so many rounds). Of equally good classes a word stays in its own,
    or goes to the first. The objective is the class bigrams' mutual information.
    """
    fixed = RARE + 1
    total = np.bincount(b, n, minlength=size)
    order = fixed + np.argsort(-total[fixed:], kind="stable")
    of = np.arange(size)
    of[order] = fixed + np.arange(len(order)) % classes
    k = fixed + classes
    grid = np.bincount(of[a] * k + of[b], n, minlength=k * k).reshape(k, k)
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    at_a, at_b = np.searchsorted(a[by_a], np.arange(size + 1)), np.searchsorted(b[by_b], np.arange(size + 1))
    free = np.arange(fixed, k)
    least_gain, turn = 1e-12 * max(1.0, float(_xlogx(total.astype(float)).sum())), 0
    while rounds is None or turn < rounds:
        moved, turn = 0, turn + 1
        for w in order:
            out_, in_ = by_a[at_a[w] : at_a[w + 1]], by_b[at_b[w] : at_b[w + 1]]
            to, by = b[out_], a[in_]
            self_n = n[out_][to == w].sum()
            right = np.bincount(of[to[to != w]], n[out_][to != w], minlength=k)
            left = np.bincount(of[by[by != w]], n[in_][by != w], minlength=k)
            old = of[w]
            grid[old] -= right
            grid[:, old] -= left
            grid[old, old] -= self_n
            rows, cols = grid.sum(axis=1), grid.sum(axis=0)
            # gain of adding w to class c: changes of x log x over row c, column c and the margins
            to_, by_ = np.flatnonzero(right), np.flatnonzero(left)  # the other columns and rows stay as they are
            over, down = grid[fixed:, to_], grid[by_, fixed:]
            gain = (_xlogx(over + right[to_]) - _xlogx(over)).sum(axis=1) + (_xlogx(down + left[by_, None]) - _xlogx(down)).sum(axis=0)
            d = grid[free, free]
            r, f = right[free], left[free]
            gain += _xlogx(d + r + f + self_n) - _xlogx(d + r) - _xlogx(d + f) + _xlogx(d)
            row, col = rows[free] + f, cols[free] + r  # what the neighbours' margins get wherever w goes
            gain -= _xlogx(row + right.sum() + self_n) - _xlogx(row) + _xlogx(col + left.sum() + self_n) - _xlogx(col)
            best = int(free[gain.argmax()])
            if gain[best - fixed] <= gain[old - fixed] + least_gain:
                best = int(old)
            of[w] = best
            moved += best != old
            grid[best] += right
            grid[:, best] += left
            grid[best, best] += self_n
        if not moved:
            break
    return of


def _befores(words: Words, of_each: np.ndarray) -> np.ndarray:
    """What stands before each word, RARE at the start of a text."""
    before = np.concatenate([[RARE], of_each[:-1]])
    before[words.first[:-1][words.counts > 0]] = RARE
    return before


def assign(docs: DataFrame, first: Model, least: int = LEAST, words_in_all: int = 0) -> DataFrame:
    """(word, of, n): class and count of each word that has ``least`` occurrences and isn't frequent.

    Each occurrence gives a byte for its left neighbour's class and one for its
    right one's; a word's bytes meet in one task. Words of one range of hashes share
    a row; there are so many ranges that each has the bytes of about RANGE words.
    """
    ranges = max(64, min(1 << 30, words_in_all // RANGE))
    vocabulary, of_number, k = first.vocabulary, first.of, len(first.transition)
    free = np.arange(RARE + 1, k)
    width = 2 * k
    wide = np.uint8 if width <= 256 else np.uint16
    weight = np.concatenate([first.transition[:, free], first.transition[free].T])
    size = first.inside[free]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for _, _, data, offsets in passes(batch.column(0)):
                words = Words(data, offsets)
                now = vocabulary.numbers(words)
                c = of_number[now]
                before, follows = _befores(words, c), words.next_in_text()
                at = np.flatnonzero(now < RARE)
                next_ = at[at < len(now) - 1]
                next_ = next_[follows[next_]]
                yield np.concatenate([words.hashes[at], words.hashes[next_]]), np.concatenate([before[at], k + c[next_ + 1]]).astype(wide)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> pa.RecordBatch:
            word, code = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(word)
            word, code = word[order], code[order]
            begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), dtype=bool), word[1:] != word[:-1]]))
            size = np.diff(np.append(begin, len(word)))
            word = word[begin]
            range_ = ((word >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), dtype=bool), range_[1:] != range_[:-1]]))

            def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
                ends = (edges * values.itemsize).astype(np.int32)
                return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])

            edges = np.append(cut, len(word))
            columns = [packed(word, edges), packed(size.astype(np.uint32), edges), packed(code, np.concatenate([[0], np.cumsum(size)])[edges])]
            return pa.RecordBatch.from_arrays([pa.array(range_[cut]), *columns], ["range", "words", "sizes", "near"])

        held, gathered_ = [], 0
        for part in parts(batches):
            held.append(part)
            gathered_ += len(part[0])
            if gathered_ > GATHERED:
                yield merged()
                held, gathered_ = [], 0
        if held:
            yield merged()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(word: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
            n = near[:, :k].sum(axis=1)
            word, near, n = word[n >= least], near[n >= least], n[n >= least]
            score = near @ weight + n[:, None] * (np.log(n + 1.0)[:, None] - np.log(size[None, :] + n[:, None] + 1.0))
            of = free[score.argmax(axis=1)] if len(word) else np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(of.astype(np.int16)), pa.array(n.astype(np.int64))], ["word", "of", "n"])

        def added(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
            word, size, code = (np.concatenate([np.frombuffer(h[k], dtype=t) for h in held]) for k, t in enumerate((np.int64, np.uint32, wide)))
            word, back = np.unique(word, return_inverse=True)
            row = np.repeat(back, size)
            return chosen(word, np.bincount(row * width + code, minlength=len(word) * width).reshape(len(word), width).astype(np.float64))

        held, now = [], None
        for batch in batches:
            for range_, *parts_ in zip(*(c.to_pylist() for c in batch.columns)):
                if held and range_ != now:
                    yield added(held)
                    held = []
                now = range_
                held.append(tuple(parts_))
        if held:
            yield added(held)

    near = texts(docs).where("text IS NOT NULL").select("text").mapInArrow(gathered, "range long, words binary, sizes binary, near binary")
    return near.repartition("range").sortWithinPartitions("range").mapInArrow(classes, "word long, of short, n long")


@dataclass
class Model:
    vocabulary: Vocabulary
    of: np.ndarray  # class of each word number
    transition: np.ndarray  # natural logarithms, [class before, class]
    emission: np.ndarray  # natural logarithms, by word number
    inside: np.ndarray  # occurrences of each class's words and one more for each word
    tail: DataFrame | None = None  # the vocabulary's other words


def _binaries(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of numbers, all first ones first: the later ones are nearly all 0 and take next to no room compressed."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _blocks(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Blocks of whole documents as numbers: of frequent words, then of the block's own distinct other words.

    ``block`` tells the blocks of one written table apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[tuple], nth: int) -> pa.RecordBatch:
            numbers, hashes = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            other = np.flatnonzero(numbers < RARE)
            words, first, back = np.unique(hashes[other], return_index=True, return_inverse=True)
            shape = numbers[other[first]].astype(np.uint8)
            numbers[other] = vocabulary.size + back
            ids = pa.concat_arrays([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            block = pa.array([(TaskContext.get().partitionId() << 32) + nth], pa.int64())
            return pa.RecordBatch.from_arrays([block, ids, *(_binaries([x]) for x in (counts, _planes(numbers), words, shape))], ["block", "ids", "counts", "numbers", "words", "shapes"])

        held, size, nth = [], 0, 0
        for batch in batches:
            for lo, hi, data, offsets in passes(batch.column(1)):
                words = Words(data, offsets)
                held.append((batch.column(0).slice(lo, hi - lo), words.counts, vocabulary.numbers(words), words.hashes))
                size += len(words.hashes) + hi - lo
                if size > BLOCK:
                    yield made(held, nth)
                    held, size, nth = [], 0, nth + 1
        if held:
            yield made(held, nth)

    src = texts(docs)
    schema = StructType.fromDDL("block long, ids array<long>, counts binary, numbers binary, words binary, shapes binary")
    schema["ids"].dataType.elementType = src.schema["doc_id"].dataType
    return src.mapInArrow(run, schema)


def code(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, classes, emitted): a byte for the class of each word, and the sum of their log probabilities within these."""
    blocks = keep(_blocks(docs, model.vocabulary))
    of_number, emission, inside = model.of, model.emission, model.inside

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                word = np.frombuffer(words, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.full(len(word), block)), pa.array(np.arange(len(word), dtype=np.int32))], ["word", "block", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, found = batch.column(1)[row].values, batch.column(6)[row].values
                counts, shape = (np.frombuffer(batch.column(c)[row].as_py(), dtype=t) for c, t in ((2, np.int64), (5, np.uint8)))
                numbers = _from_planes(batch.column(3)[row].as_py())
                of, each = shape.astype(np.int64), emission[shape]
                if found is not None:
                    at, c, n = (found.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                    of[at], each[at] = c, np.log(n + 1.0) - np.log(inside[c])
                c = np.concatenate([of_number, of])[numbers].astype(np.uint8)
                total = np.concatenate([[0.0], np.cumsum(np.concatenate([emission, each])[numbers])])
                ends = np.concatenate([[0], np.cumsum(counts)])
                binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(c.tobytes())])
                yield pa.RecordBatch.from_arrays([ids, binary, pa.array(total[ends[1:]] - total[ends[:-1]])], ["doc_id", "classes", "emitted"])

    if model.tail is None:
        known = blocks.withColumn("found", F.lit(None).cast("array<struct<at:int,of:smallint,n:bigint>>"))
    else:
        words = blocks.select("block", "words").mapInArrow(spread, "word long, block long, at int").join(model.tail, "word")
        found = words.groupBy("block").agg(F.collect_list(F.struct("at", "of", "n")).alias("found"))  # no more than a block's words
        known = blocks.join(found, "block", "left").select(*blocks.columns, "found")
    schema = StructType.fromDDL("doc_id long, classes binary, emitted double")
    schema["doc_id"].dataType = blocks.schema["ids"].dataType.elementType
    return keep(known.mapInArrow(run, schema))


def _classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all words, those before them, and where each document's begin."""
    data, offsets = utf8(column)
    c = data.astype(np.int64)
    before = np.concatenate([[RARE], c[:-1]])[: len(c)]
    start = offsets[:-1]
    before[start[start < len(c)]] = RARE
    return c, before, offsets


def class_counts(coded: DataFrame, k: int) -> np.ndarray:
    """How often each class follows each, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            c, before, _ = _classes(batch.column(0))
            grid += np.bincount(before * k + c, minlength=k * k)
        at = np.flatnonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(grid[at])], ["pair", "n"])

    out = np.zeros(k * k)
    for r in coded.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(k, k)


def fit(docs: DataFrame, share: float = SHARE, classes: int = CLASSES, frequent: int = FREQUENT, least: int = LEAST) -> tuple[Model, DataFrame]:
    """The model, and the documents it was fitted to, coded.

    The driver gets the frequent words and the counts of pairs of them and the
    shape classes, at most (frequent + RARE + 1) squared.
    """
    k = RARE + 1 + classes
    if k > 256:
        raise ValueError("a class must fit a byte")
    counts = keep(word_counts(docs))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(share * total, least)).orderBy(F.desc("n"), "word").limit(frequent).collect()
    types = np.ones(RARE)
    for r in counts.where(F.col("n") < least).groupBy("shape").agg(F.count("*").alias("types")).collect():
        types[r["shape"]] = r["types"]
    vocabulary = Vocabulary(np.array([r["word"] for r in rows], dtype=np.int64))
    pairs = bigram_counts(docs, vocabulary).orderBy("a", "b").toArrow()
    a, b, n = (pairs.column(c).to_numpy() for c in ("a", "b", "n"))
    of = exchange(a, b, n, vocabulary.size, classes)
    model = estimate(vocabulary, of, a, b, n, types, k)
    tail = keep(assign(docs, model, least, int(total)))
    for r in tail.groupBy("of").agg(F.sum(F.col("n") + 1).alias("n")).collect():
        model.inside[r["of"]] += r["n"]
    model.emission = emissions(of, np.bincount(b, n, minlength=vocabulary.size), model.inside, types)
    model.tail = tail
    coded = code(docs, model)
    model.transition = transitions(class_counts(coded, k))
    return model, coded


def transitions(follow: np.ndarray) -> np.ndarray:
    """Log probabilities, add-one smoothed, from how often each class follows each."""
    grid = follow + 1.0
    grid[:, RARE] = 0  # no word is the start of a text
    return np.log(np.where(grid > 0, grid / grid.sum(axis=1, keepdims=True), 1.0))


def emissions(of: np.ndarray, seen: np.ndarray, inside: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Log probability of each word number within its class."""
    out = np.log(seen + 1.0) - np.log(inside[of])
    out[:RARE] = -np.log(types)
    out[RARE] = 0.0
    return out


def estimate(vocabulary: Vocabulary, of: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, types: np.ndarray, k: int) -> Model:
    """The model of the frequent words, from the counts of pairs."""
    follow = np.bincount(of[a] * k + of[b], n, minlength=k * k).reshape(k, k)
    seen = np.bincount(b, n, minlength=vocabulary.size)
    inside = np.bincount(of, seen + 1.0, minlength=k)
    return Model(vocabulary, of, transitions(follow), emissions(of, seen, inside, types), inside)


def scored(coded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of coded documents."""

    transition = model.transition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, before, offsets = _classes(batch.column(1))
            n, total = np.diff(offsets), np.concatenate([[0.0], np.cumsum(transition[before, c])])
            log_prob = total[offsets[1:]] - total[offsets[:-1]] + batch.column(2).to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.exp(-log_prob / n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(log_prob), pa.array(p, pa.float64(), mask=n == 0)], ["doc_id", "n_words", "log_prob", "perplexity"])

    return coded.mapInArrow(run, with_id(coded, "n_words long, log_prob double, perplexity double"))


def perplexity(docs: DataFrame, share: float = SHARE, classes: int = CLASSES, frequent: int = FREQUENT, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every document.

    A text without words, null ones too, has 0 words, log probability 0 and null
    perplexity. Repeated rows are counted and scored each; other columns are not
    looked at, and ids may be of any type. An empty table gives no rows.
    """
    model, coded = fit(docs, share, classes, frequent, least)
    return scored(coded, model)
