"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents. Token labels are derived from them: a word form
or opening that more toxic training documents hold than chance would give it, by
an exact test relative to the sample, and next to no clean ones, marks its tokens
toxic. Near copies count as one document. Each language is tested by itself and
all together, stratified, so a form needs few documents where few are labelled; a
phrase counts as any other form, since only documents are counted. A two-state chain is then trained
on these token labels by gradient ascent on its conditional likelihood; its
features are word forms and openings, and its marginals, by the forward-backward
recursion, give each document's score and the offending offsets. A message is a
ratio of odds, and a step of the recursion a linear fraction of it; such steps
compose, so a long text is cut into blocks that advance together.

Training reads at most ``TRAIN_DOCS`` labelled documents of each class, chosen by
a hash of their ids, as many of each language as there are or as leaves the others
the same number; one of more than ``TRAIN_CHARS`` characters is left out. Scoring
reads every document in whole, and each token has its marginal.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.spread import spread
from scriptorium.llm.near_dup import link, signatures
from scriptorium.llm.storage import join_keys, texts, with_id
from scriptorium.llm.textkernel import HashTable, Words, mix, passes, span_hashes

#: Labelled documents of each class that training reads at most.
TRAIN_DOCS = 1000
TRAIN_CHARS = 1_000_000
#: Share of falsely found forms that is expected among those that mark tokens, and share of the clean documents that may have a form, relative to that of the toxic ones.
FALSE_SHARE, CLEAN_SHARE = 0.05, 0.02
#: Bytes of the openings of a word that are features, next to the word itself.
OPENINGS = (4, 5, 6)
#: Occurrences in training from which a word is known by itself; openings are features of other words only.
COMMON = 20
WINDOW, ROUNDS, RATE, DECAY = 48, 30, 0.5, 1e-6
#: Training goes on beyond ROUNDS until the tokens on the wrong side of THRESHOLD are less than this share of the toxic ones, MOST_ROUNDS at most.
MISFIT, MOST_ROUNDS = 0.05, 300
#: Marginal from which a token is toxic, and score from which a document is.
THRESHOLD = 0.5
#: Log odds beyond which a token's own features count no more.
LIMIT = 60.0
#: Tokens of a block; chains of more are cut.
BLOCK = 2048


def word_features(words: Words) -> np.ndarray:
    return mix(words.hashes ^ np.uint64(1))


def opening_features(words: Words, rows: np.ndarray) -> np.ndarray:
    """Feature hashes of the words of these rows, one column an opening; 0 for a word that isn't longer."""
    out = np.zeros((len(rows), len(OPENINGS)), dtype=np.uint64)
    for k, size in enumerate(OPENINGS):
        long = np.flatnonzero((words.ends - words.starts)[rows] > size)
        start = words.starts[rows[long]]
        out[long, k] = mix(span_hashes(words.low, start, start + size) ^ np.uint64(2 + k))
    return out


@dataclass
class Chain:
    """Weights of features by hash, the features of common words, the toxic state's bias, and transition scores [from, to]."""

    keys: np.ndarray
    weights: np.ndarray
    common: np.ndarray
    bias: float
    turn: np.ndarray

    def __post_init__(self) -> None:
        self.table, self.known = HashTable(self.keys), HashTable(self.common)

    def emissions(self, words: Words) -> np.ndarray:
        """Log odds that each token's own features give to the toxic state."""
        padded = np.append(self.weights, 0.0)
        feats = word_features(words)
        out = self.bias + padded[self.table.find(feats)]
        rare = np.flatnonzero(self.known.find(feats) < 0)
        openings = opening_features(words, rare)
        for k in range(openings.shape[1]):
            out[rare] += padded[self.table.find(openings[:, k])]
        return out


def _advance(x: np.ndarray, e: np.ndarray, w: np.ndarray) -> np.ndarray:
    return e * (w[0, 1] + w[1, 1] * x) / (w[0, 0] + w[1, 0] * x)


def _run(e: np.ndarray, first: np.ndarray, n: np.ndarray, w: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Messages along each block of n tokens from its first on; entry is the message before it, -1 where a chain starts."""
    order = np.argsort(-n, kind="stable")
    n, first, entry = n[order], first[order], entry[order]
    x = e.copy()
    later = np.flatnonzero((entry >= 0) & (n > 0))
    x[first[later]] = _advance(entry[later], e[first[later]], w)
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), side="left").tolist()
    now = x[first[: alive[0]]] if longest else x
    for t in range(1, longest):
        at = first[: alive[t]] + t
        now = _advance(now[: alive[t]], e[at], w)
        x[at] = now
    return x


def _through(e: np.ndarray, first: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each block the 2 x 2 matrix that takes (clean, toxic) weights before it to those after it, up to a factor."""
    order = np.argsort(-n, kind="stable")
    n, first = n[order], first[order]
    m = np.tile(np.eye(2), (len(n), 1, 1))  # [block, state after, state before]
    alive = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()
    for t, k in enumerate(alive):
        clean = w[0, 0] * m[:k, 0] + w[1, 0] * m[:k, 1]
        toxic = e[first[:k] + t][:, None] * (w[0, 1] * m[:k, 0] + w[1, 1] * m[:k, 1])
        top = np.maximum(clean, toxic).max(axis=1)[:, None]
        m[:k, 0], m[:k, 1] = clean / top, toxic / top
    out = np.empty_like(m)
    out[order] = m
    return out


def messages(e: np.ndarray, counts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Odds of the forward messages of chains laid end to end, from the tokens' own odds and the transitions' weights.

    All chains advance together, so a step is one operation on the chains that
    are still running. Chains of more than BLOCK tokens are cut into blocks; the
    message before each comes from the product of the steps of those before it.
    """
    start = np.cumsum(counts) - counts
    long = np.flatnonzero(counts > BLOCK)
    blocks = np.ones(len(counts), dtype=np.int64)
    blocks[long] = -(-counts[long] // BLOCK)
    chain = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = start[chain] + nth * BLOCK
    n = np.minimum(np.where(blocks[chain] > 1, BLOCK, counts[chain]), start[chain] + counts[chain] - first)
    entry = np.full(len(chain), -1.0)
    if len(long):
        inner = np.flatnonzero((blocks[chain] > 1) & (nth + 1 < blocks[chain]))
        heads = inner[nth[inner] == 0]
        last = _run(e, first[heads], n[heads], w, entry[heads])[first[heads] + n[heads] - 1]
        entry[heads + 1] = last
        inner = inner[nth[inner] > 0]
        if len(inner):
            through = _through(e, first[inner], n[inner], w)
            for k in range(1, int(nth[inner].max()) + 1):
                own = np.flatnonzero(nth[inner] == k) if len(long) > 1 else np.array([k - 1])
                m, x = through[own], entry[inner[own]]
                entry[inner[own] + 1] = (m[:, 1, 0] + m[:, 1, 1] * x) / (m[:, 0, 0] + m[:, 0, 1] * x)
    return _run(e, first, n, w, entry)


def forward_backward(e: np.ndarray, counts: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of the forward, backward and full messages of chains laid end to end."""
    odds, w = np.exp(np.clip(e, -LIMIT, LIMIT)), np.exp(turn)
    ahead = messages(odds, counts, w)
    back = messages(odds[::-1], counts[::-1], w.T)[::-1] / odds
    r, s = np.log(ahead), np.log(back)
    return r, s, r + s


def folded(texts: list[str]) -> np.ndarray:
    """For each text, the number of the text of whose near copies it is one."""
    rows, sigs = [], []
    for lo, _, data, offsets in passes(pa.array(texts, pa.large_string())):
        row, sig = signatures(Words(data, offsets))
        rows.append(row + lo)
        sigs.append(sig)
    out = np.arange(len(texts))
    for a, b in link(np.concatenate(rows), np.concatenate(sigs)) if rows else []:
        out[b] = a
    return out


def chance(bad: np.ndarray, good: np.ndarray, of_bad: np.ndarray, of_good: np.ndarray) -> np.ndarray:
    """Log probability, for each form, that no more of its documents would be clean by chance.

    ``bad`` and ``good`` are its toxic and clean documents by language (a row each),
    ``of_bad`` and ``of_good`` all documents of each language. Within a language the
    number of clean ones is hypergeometric; the languages' numbers are added up.
    """
    f = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, (of_bad + of_good).max() + 1)))])

    def choose(n: int, k: np.ndarray) -> np.ndarray:
        at = np.clip(k, 0, n)
        return np.where(at == k, f[n] - f[at] - f[n - at], -np.inf)

    total = good.sum(axis=0)
    most = int(total.max(initial=0)) + 1
    sums = np.full((bad.shape[1], most), -np.inf)
    sums[:, 0] = 0.0
    for b, g, all_b, all_g in zip(bad, good, of_bad, of_good):
        n, clean = (b + g)[:, None], np.arange(most)[None, :]
        own = choose(all_g, clean) + choose(all_b, n - clean) - choose(all_b + all_g, n)
        new = np.full_like(sums, -np.inf)
        for k in range(most):
            new[:, k:] = np.logaddexp(new[:, k:], sums[:, : most - k] + own[:, k : k + 1])
        sums = new
    return np.logaddexp.accumulate(sums, axis=1)[np.arange(len(total)), total]


def marks(bad: np.ndarray, good: np.ndarray, of_bad: np.ndarray, of_good: np.ndarray) -> np.ndarray:
    """Which forms toxic documents have beyond chance; arguments as in chance().

    The forms that too few documents have to be found at all don't count as tested
    (Tarone); among the others the share of false ones is held at FALSE_SHARE
    (Benjamini and Hochberg).
    """
    out = np.zeros(bad.shape[1], dtype=bool)
    least = np.minimum(bad + good, of_bad[:, None])  # toxic documents, were as many toxic as can be
    shapes, which = np.unique(np.concatenate([least, bad + good - least]), axis=1, return_inverse=True)
    seen = shapes[len(of_bad) :].sum(axis=0) <= CLEAN_SHARE * of_good.sum()
    best = np.zeros(shapes.shape[1])
    best[seen] = chance(shapes[: len(of_bad), seen], shapes[len(of_bad) :, seen], of_bad, of_good)
    best = np.sort(best[which.ravel()])
    tested = 1
    while np.searchsorted(best, np.log(FALSE_SHARE / tested), side="right") > tested:
        tested += max(1, tested // 16)
    some = np.flatnonzero((bad.sum(axis=0) >= 2) & (good.sum(axis=0) * of_bad.sum() <= CLEAN_SHARE * bad.sum(axis=0) * of_good.sum()))
    p = chance(bad[:, some], good[:, some], of_bad, of_good)
    order = np.argsort(p, kind="stable")
    low = np.flatnonzero(p[order] <= np.log(FALSE_SHARE * np.arange(1, len(p) + 1) / tested))
    if len(low):
        out[some[order[: low[-1] + 1]]] = True
    return out


def token_labels(feats: np.ndarray, doc: np.ndarray, toxic: np.ndarray, copies: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Whether each token of the training documents is toxic.

    For each document, ``toxic`` is its label, ``copies`` the number of its group of
    near copies, and ``lang`` the number of its language.
    """
    langs = int(lang.max()) + 1
    kinds, kind = np.unique(np.column_stack([copies, lang, toxic]), axis=0, return_inverse=True)
    kind = kind.ravel()
    of = np.bincount(kinds[:, 1] * 2 + kinds[:, 2], minlength=2 * langs).reshape(langs, 2)
    ways = [[k] for k in range(langs)] + [list(range(langs))] * (langs > 1)
    out = np.zeros(len(feats), dtype=bool)
    for k in range(feats.shape[1]):
        keys, which = np.unique(feats[:, k], return_inverse=True)
        pair = np.unique(which.astype(np.uint64) << np.uint64(32) | kind[doc].astype(np.uint64))
        form, group = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cell = kinds[group, 1] * 2 + kinds[group, 2]
        count = np.bincount(form * 2 * langs + cell, minlength=len(keys) * 2 * langs).reshape(len(keys), langs, 2)
        count[keys == 0] = 0
        for way in ways:
            bad, good = count[:, way, 1].T, count[:, way, 0].T
            own = np.flatnonzero(marks(bad, good, of[way, 1], of[way, 0]))
            found = np.zeros((len(keys), langs), dtype=bool)
            found[np.ix_(own, way)] = True
            out |= found[which, lang[doc]]
    return out & toxic[doc]


def train(texts: list[str], toxic: list[bool], lang: list[str | None] | None = None) -> Chain:
    """Fit a chain; without toxic training documents, or a form that tells them from clean ones, it finds nothing toxic."""
    turn = np.zeros((2, 2))
    if lang is None:
        lang = [None] * len(texts)
    langs = np.unique([x or "" for t, x in zip(texts, lang) if t], return_inverse=True)[1]
    pairs = [(t, x) for t, x in zip(texts, toxic) if t]
    nothing = np.zeros(0, dtype=np.uint64)
    none = Chain(nothing, np.zeros(0), nothing, -12.0, turn)
    if not any(x for _, x in pairs):
        return none
    feats, counts = [], []
    for _, _, data, offsets in passes(pa.array([t for t, _ in pairs], pa.large_string())):
        words = Words(data, offsets)
        feats.append(np.column_stack([word_features(words), opening_features(words, np.arange(len(words.starts)))]))
        counts.append(words.counts)
    feats, counts = np.concatenate(feats), np.concatenate(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    forms, which, seen = np.unique(feats[:, 0], return_inverse=True, return_counts=True)
    common = forms[seen >= COMMON]
    feats[seen[which] >= COMMON, 1:] = 0
    label = token_labels(feats, doc, np.array([bool(x) for _, x in pairs]), folded([t for t, _ in pairs]), langs)
    if not label.any():
        warnings.warn("no word form tells toxic training documents from clean ones; nothing will be found toxic", stacklevel=2)
        return none
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.unique(doc.astype(np.int64) * (1 << 32) + place // WINDOW, return_inverse=True)[1]
    pieces = np.bincount(window)
    keys, which, seen = [], np.empty(feats.shape, dtype=np.int32), []
    for k in range(feats.shape[1]):  # one kind at a time, for less memory
        own, back, count = np.unique(feats[:, k], return_inverse=True, return_counts=True)
        which[:, k] = back + sum(map(len, keys))
        keys.append(own)
        seen.append(count)
    del feats, forms
    keys, seen = np.concatenate(keys), np.concatenate(seen)
    ok = (seen >= 3) & (keys != 0)
    weight, total = np.zeros(len(keys)), np.full(len(keys), 1e-6)
    bias, bias_total = -3.0, 1e-6
    turn_total = np.full((2, 2), 1e-6)
    later = np.flatnonzero(np.concatenate([[False], window[1:] == window[:-1]]))
    seen_turns = np.bincount(label[later - 1] * 2 + label[later], minlength=4).reshape(2, 2)
    for turns in range(MOST_ROUNDS):
        e = bias + sum(weight[which[:, k]] for k in range(which.shape[1]))
        r, s, odds = forward_backward(e, pieces, turn)
        gap = label - 1.0 / (1.0 + np.exp(-np.clip(odds, -50, 50)))
        if turns >= ROUNDS and (np.abs(gap) > 1 - THRESHOLD).sum() <= MISFIT * label.sum():
            break
        grad = sum(np.bincount(which[:, k], gap, minlength=len(keys)) for k in range(which.shape[1])) * ok - DECAY * weight
        total += grad**2
        weight += RATE * grad / np.sqrt(total)
        bias_total += gap.sum() ** 2
        bias += RATE * gap.sum() / np.sqrt(bias_total)
        x, y = r[later - 1], e[later] + s[later]
        joint = np.stack([np.full(len(x), turn[0, 0]), turn[0, 1] + y, turn[1, 0] + x, turn[1, 1] + x + y])
        joint = np.exp(joint - joint.max(axis=0))
        step = seen_turns - (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        turn_total += step**2
        turn = np.clip(turn + 0.1 * step / np.sqrt(turn_total), -4, 4)
    strong = ok & (np.abs(weight) > 0.05)
    return Chain(keys[strong], weight[strong], common, float(bias), turn)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, lang, toxic) of the bounded training sample; without a column lang there is one language."""
    own, other = join_keys(docs, labels, "doc_id")
    tagged = labels.select(other.alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    tagged = tagged.groupBy("id").agg(F.max("toxic").alias("toxic"))
    src = docs.select(own.alias("id"), F.col("text").cast("string").alias("text"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")).where("text IS NOT NULL")
    known = src.select("id", "lang").join(tagged.where("toxic IN (0, 1)"), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("lang").alias("lang"))
    known = known.withColumn("nth", F.row_number().over(Window.partitionBy("toxic", "lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("nth") <= TRAIN_DOCS)
    chosen = [known.where(c).orderBy("nth", F.xxhash64("id"), "id").limit(TRAIN_DOCS) for c in ("toxic = 1", "toxic = 0")]
    chosen = chosen[0].unionAll(chosen[1]).select("id", "toxic")
    rows = src.where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
    return rows.select("id", "t.text", "t.lang", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of the training sample. One task has its 2 * TRAIN_DOCS texts at most; the driver gets the weights only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if b.num_rows]):
            return
        columns = pa.Table.from_batches(held).to_pydict()
        c = train(columns["text"], [x == 1 for x in columns["toxic"]], columns["lang"])
        parts = [pa.array([x.tobytes()], pa.binary()) for x in (c.keys, c.weights, c.common, c.turn)]
        yield pa.RecordBatch.from_arrays([*parts, pa.array([c.bias])], ["keys", "weights", "common", "turn", "bias"])

    sample = training_rows(docs, labels).repartition(1).sortWithinPartitions("id")
    row = sample.mapInArrow(run, "keys binary, weights binary, common binary, turn binary, bias double").first()
    if row is None:
        return train([], [])
    keys, weights, common, turn = (np.frombuffer(row[n], dtype=t) for n, t in (("keys", np.uint64), ("weights", float), ("common", np.uint64), ("turn", float)))
    if not len(keys):
        warnings.warn("the labelled documents tell toxic forms from clean ones nowhere; nothing will be found toxic", stacklevel=3)
    return Chain(keys, weights, common, row["bias"], turn.reshape(2, 2))


def score_texts(column: pa.Array, chain: Chain) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Score, expected toxic tokens, and toxic spans (in characters) of each text."""
    n = len(column)
    score, expected = np.zeros(n), np.zeros(n)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for lo, hi, data, offsets in passes(column):
        words = Words(data, offsets)
        if not len(words.starts):
            continue
        _, _, odds = forward_backward(chain.emissions(words), words.counts, chain.turn)
        p = 1.0 / (1.0 + np.exp(-odds))
        some = np.flatnonzero(words.counts)
        score[lo + some] = np.maximum.reduceat(p, words.first[some])
        expected[lo + some] = np.add.reduceat(p, words.first[some])
        bad = np.flatnonzero(p >= THRESHOLD)
        if not len(bad):
            continue
        of = np.searchsorted(words.first, bad, side="right") - 1
        cut = np.flatnonzero((np.diff(bad) > 1) | (np.diff(of) > 0))
        from_, to = bad[np.concatenate([[0], cut + 1])], bad[np.concatenate([cut, [len(bad) - 1]])]
        of = of[np.concatenate([[0], cut + 1])]
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        start = chars[offsets[of]]
        for row, x, y in zip((lo + of).tolist(), (chars[words.starts[from_]] - start).tolist(), (chars[words.ends[to]] - start).tolist()):
            spans[row].append((x, y))
    return score, expected, spans


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, toxic_tokens, toxic, spans) of every document, toxic or not.

    ``score`` is the highest marginal of a token, ``toxic_tokens`` the sum of all
    marginals, ``spans`` the character ranges of neighbouring toxic tokens. Null and
    empty texts score 0; repeated rows are each scored; other columns are not
    looked at, and ids may be of any type. Labels without an id or a label don't
    count; of several labels of one document the toxic one does, and of several
    texts the first in order is trained on.
    """
    chain = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, expected, spans = score_texts(batch.column(1), chain)
            found = pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(expected), pa.array(score >= THRESHOLD), found], ["doc_id", "score", "toxic_tokens", "toxic", "spans"])

    src = texts(docs)
    return src.mapInArrow(run, with_id(src, "score double, toxic_tokens double, toxic boolean, spans array<struct<begin: int, end: int>>"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with all their columns; one pass, no shuffle."""
    chain = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
                column = column.cast(pa.string())
            yield batch.filter(pa.array(score_texts(column, chain)[0] < THRESHOLD))

    return spread(docs).mapInArrow(run, docs.schema)
