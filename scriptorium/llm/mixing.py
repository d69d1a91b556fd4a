"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of the token budget. Where its share covers the whole
source once or more, every document is taken in so many complete epochs; what
remains of the share is filled by weighted sampling without replacement: a
document's key is an exponential variate divided by its quality weight, keys
are sorted within the source, and documents are taken while the running sum of
their tokens is within the rest.

The running sum never needs a whole source in one task. Keys fall into
``BUCKETS`` ordered buckets, whose token sums alone tell in which bucket a
source's rest ends; only the documents of that bucket are sorted, which gives
the last key taken, and every other document is decided by comparing its key.
Of repeated rows of one key, so many are taken as the rest has room for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.spread import spread
from scriptorium.llm.storage import id_of, keep, small

BUCKETS = 4096
#: Parts in which the repeated rows of one key are counted off.
PARTS = 1024
#: Characters that running prose has few of.
MARKS = "0123456789#$%&*|!@<>{}[]=_~^/+"
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    """Tokens parted by single spaces; none in null or empty text."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1.0, by the share of characters that aren't MARKS; 0.1 for null or empty text."""
    share = F.length(F.translate(text, MARKS, "")).cast("double") / F.length(text).cast("double")
    return F.when(F.length(text) > 0, F.lit(0.1) + F.lit(0.9) * share).otherwise(F.lit(0.1))


def sampling_key(id_: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, with u in (0, 1] from a hash of the seed and the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    return -F.ln((bits + 1).cast("double") / F.lit(float(1 << 52))) / weight


def plan(keyed: DataFrame, budget_share: float = 1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, epochs, b, in_bucket, edge, room): whole epochs of each source, and what its partial one takes.

    That is all buckets before ``b``, of b all up to the (key, id, tokens) of ``in_bucket``, and ``room`` of the
    repeated rows that are ``edge``, where there is room for some of them only.

    Target weights are those given by source (others get nothing), or in
    proportion to the whole part of the square root of the source's tokens.
    """
    spark = keyed.sparkSession
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int")
    sums = keep(keyed.groupBy("source", bucket.alias("bucket")).agg(F.sum("n").alias("n")))
    source = sums.groupBy("source").agg(F.sum("n").alias("total"))
    if weights is None:
        source = source.withColumn("share", F.floor(F.sqrt("total")).cast("decimal(13,0)"))
    else:
        given = spark.createDataFrame([(k, int(round(v * 1_000_000))) for k, v in weights.items()], "name string, ppm long")
        source = source.join(given, F.col("source") == F.col("name"), "left").withColumn("share", F.coalesce("ppm", F.lit(0)).cast("decimal(13,0)"))
    whole = source.agg(F.sum("total").alias("all"), F.sum("share").alias("shares")).first()
    budget, shares = math.floor(float(whole["all"] or 0) * budget_share), int(whole["shares"] or 0)
    source = source.withColumn("aim", F.expr(f"cast({budget} as decimal(25,0)) * share div cast({shares} as decimal(25,0))") if shares else F.lit(0))
    source = source.select("source", F.expr("if(total > 0, aim div total, 1)").alias("epochs"), F.expr("if(total > 0, aim % total, 0)").alias("rest"))
    source = keep(source)
    up_to = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    ends = sums.withColumn("before", up_to - F.col("n")).withColumn("up_to", up_to)
    ends = ends.withColumnRenamed("source", "s").join(source, F.col("s").eqNullSafe(F.col("source")))
    ends = ends.where("before <= rest AND up_to > rest").select("s", F.col("bucket").alias("b"), "before", "rest")
    inside = keyed.withColumn("bucket", bucket).join(small(ends, source), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = inside.groupBy("source", "key", "id", "n", "before", "rest").agg(F.count("*").alias("times"))
    order = Window.partitionBy("source").orderBy("key", "id", "n").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("run", F.col("before") + F.sum(F.col("n") * F.col("times")).over(order))
    here, fits = F.struct("key", "id", "n"), F.col("run") <= F.col("rest")
    room = F.expr("cast(times - (run - rest + n - 1) div nullif(n, 0) as long)")
    edge = F.min(F.when(~fits, F.struct("key", "id", "n", room.alias("room"))))
    last = inside.groupBy(F.col("source").alias("s")).agg(F.max(F.when(fits, here)).alias("in_bucket"), edge.alias("e"))
    last = last.select("s", "in_bucket", F.when(F.col("e.room") > 0, F.struct("e.key", "e.id", "e.n")).alias("edge"), F.col("e.room").alias("room"))
    first = ends.withColumnRenamed("s", "z")
    out = source.join(last, F.col("source").eqNullSafe(F.col("s")), "left").join(first, F.col("source").eqNullSafe(F.col("z")), "left")
    return keep(out.select("source", "epochs", "b", "in_bucket", "edge", "room"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    text, id_ = F.col(f"`{text_col}`"), id_of(docs, id_col)
    return [id_.alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_tokens(text).alias("n"), sampling_key(id_, quality_weight(text), seed).alias("key")]


def _bucket() -> Column:
    return F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int")


def _taken(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """rows (id, source, n, key, ...) with ``copies``, how often each is taken under its source's plan."""
    here = F.struct("key", "id", "n")
    rows = rows.withColumn("bucket", _bucket()).join(small(aims.withColumnRenamed("source", "s"), aims), F.col("source").eqNullSafe(F.col("s")))
    partial = (F.col("bucket") < F.col("b")) | ((F.col("bucket") == F.col("b")) & F.col("in_bucket").isNotNull() & (here <= F.col("in_bucket")))
    rows = rows.withColumn("copies", (F.col("epochs") + F.when(partial, 1).otherwise(0)).cast("long"))
    if aims.where("room > 0").isEmpty():
        return rows
    # rows of the edge are all alike; they are counted off in parts, so that no task has all of them
    split = F.col("edge").isNotNull() & F.col("edge").eqNullSafe(here)
    edge = keep(rows.where(split).withColumn("part", F.floor(F.rand(1) * PARTS)))
    sizes = edge.groupBy("source", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("part")) - F.col("size")
    sizes = sizes.select(F.col("source").alias("s2"), F.col("part").alias("p2"), before.alias("ahead"))
    edge = edge.join(sizes, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2"))).withColumn("nth", F.row_number().over(Window.partitionBy("source", "part").orderBy("n")))
    edge = edge.withColumn("copies", F.col("copies") + F.when(F.col("ahead") + F.col("nth") <= F.col("room"), 1).otherwise(0))
    return rows.where(~split).unionByName(edge.select(*rows.columns))


def mix_sources(docs: DataFrame, budget_share: float = 1.0, weights: dict[str, float] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document that is taken at least once.

    A null source is a source of its own; null and empty texts have no tokens,
    and a source without any is taken once. Documents of one key go by id, null
    first, then by tokens. Repeated rows each count, and where the budget ends
    among them, as many are taken as fit. An empty table gives no rows.
    """
    keyed = keep(spread(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col, source_col))))).select(*_keyed(docs, id_col, text_col, source_col, seed)))
    out = _taken(keyed, plan(keyed, budget_share, weights))
    return out.select(F.col("id").alias("doc_id"), "source", F.col("n").alias("n_tokens"), "copies").where("copies > 0")


def mixed(docs: DataFrame, budget_share: float = 1.0, weights: dict[str, float] | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, each row as often as it is taken, with their own columns."""
    keyed = keep(docs.select(*_keyed(docs, id_col, text_col, source_col, seed)))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _taken(docs.select(own, *_keyed(docs, id_col, text_col, source_col, seed)), plan(keyed, budget_share, weights)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = f"""
WITH t AS (
  SELECT doc_id, source, text,
    CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END AS n_tokens,
    CASE WHEN length(text) > 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * (length(translate(text, '{MARKS}', ''))::DOUBLE / length(text)::DOUBLE) ELSE 0.1::DOUBLE END AS w,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 1)::DOUBLE / {1 << 52}::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, text, n_tokens, -ln(u) / w AS key FROM t),
s AS (SELECT source, sum(n_tokens)::HUGEINT AS total, floor(sqrt(sum(n_tokens)))::HUGEINT AS share FROM k GROUP BY source),
a AS (SELECT source, total, CASE WHEN (SELECT sum(share) FROM s) > 0 THEN ((SELECT sum(total) FROM s)::HUGEINT * share) // (SELECT sum(share) FROM s)::HUGEINT ELSE 0 END AS aim FROM s),
p AS (SELECT source, CASE WHEN total > 0 THEN aim // total ELSE 1 END AS epochs, CASE WHEN total > 0 THEN aim % total ELSE -1 END AS rest FROM a),
r AS (SELECT k.*, p.epochs, p.rest, sum(n_tokens) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS run
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
"""
