"""Quality classifier by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled documents, one of each
class. A text is compressed in blocks of ``BLOCK`` bytes with either; the
normalised difference of the sizes, (bad - good) / (bad + good), is turned into
a probability by a logistic curve that is fitted to other labelled documents.

Training reads at most ``TRAIN_DOCS`` labelled documents of each class, chosen by
a hash of their ids: half for the dictionaries, half for the curve; one of more
than ``TRAIN_CHARS`` characters is left out. Scoring reads every document in whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import join_keys, texts, with_id
from scriptorium.llm.textkernel import utf8

#: Labelled documents of each class that training reads at most.
TRAIN_DOCS = 1000
TRAIN_CHARS = 1_000_000
DICTIONARY_BYTES, BLOCK, LEVEL = 64 << 10, 2048, 3
THRESHOLD = 0.5


def blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the blocks, or their plain text where they are too few for that."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float = 0.0
    shift: float = 0.0

    def compressors(self) -> list:
        out = []
        for d in (self.good, self.bad):
            made = zstandard.ZstdCompressionDict(d)
            made.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * x + self.shift, -50, 50)))


def difference(text: bytes, compress: list) -> float:
    """(bad - good) / (bad + good) over all blocks; 0 for empty text."""
    parts = blocks(text)
    good, bad = (sum(len(c(p)) for p in parts) for c in compress)
    return (bad - good) / (bad + good) if parts else 0.0


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve, by Newton's method with a faint prior."""
    scale = np.abs(x).max() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-3 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def train(good: list[str], bad: list[str], prior: float) -> Model:
    """A model from texts of either class; prior is the share of good ones among all labelled."""
    good, bad = ([t.encode() for t in texts if t] for texts in (good, bad))
    if not good or not bad:
        return Model(b"", b"", 0.0, 30.0 if good or not bad else -30.0)
    model = Model(dictionary(good[0::2]), dictionary(bad[0::2]))
    held = [good[1::2] or good, bad[1::2] or bad]
    compress = model.compressors()
    x = np.array([difference(t, compress) for texts in held for t in texts])
    y = np.repeat([1.0, 0.0], [len(t) for t in held])
    weight = np.where(y == 1, prior / len(held[0]), (1 - prior) / len(held[1])) * len(y)
    model.slope, model.shift = fit_curve(x, y, weight)
    return model


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str], float]:
    """Texts of good and of bad documents of the bounded sample, and the share of good labels."""
    own, other = join_keys(docs, labels, "doc_id")
    tagged = labels.select(other.alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL AND quality IS NOT NULL")
    tagged = tagged.groupBy("id").agg(F.min("quality").alias("quality"))
    prior = tagged.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    chosen = [tagged.where(c).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS) for c in ("quality = 1", "quality = 0")]
    chosen = chosen[0].unionAll(chosen[1])
    src = docs.select(own.alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = src.where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "id").groupBy("id", "quality").agg(F.min("text").alias("text"))
    rows = rows.orderBy("id").collect()  # 2 * TRAIN_DOCS texts at most
    return [r["text"] for r in rows if r["quality"] == 1], [r["text"] for r in rows if r["quality"] == 0], 0.5 if prior is None else prior


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, difference, score, keep) of every document.

    ``score`` is the calibrated probability that the text is good, ``keep`` whether
    it is at least one half. A null text has null values, an empty one difference
    0. Repeated rows are each scored; other columns are not looked at, and ids may be
    of any type. Of several labels of one document the worst counts, and of several
    texts the first in order is trained on. With labels of one class only, all
    documents are of that class; without labels all are kept.
    """
    model = train(*training_rows(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = model.compressors() if model.good else None
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw, off = data.tobytes(), off.tolist()
            x = np.array([difference(raw[a:b], compress) if compress else 0.0 for a, b in zip(off, off[1:])])
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            p = model.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64(), mask=null), pa.array(p, pa.float64(), mask=null), pa.array(p >= THRESHOLD, pa.bool_(), mask=null)], ["doc_id", "difference", "score", "keep"])

    src = texts(docs)
    return src.mapInArrow(run, with_id(src, "difference double, score double, keep boolean"))
