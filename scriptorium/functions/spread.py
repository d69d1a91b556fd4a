"""Work for all cores from tables in few files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_MOVES = re.compile(r"\b(Join|Aggregate|Sort|Window|Repartition\w*|RebalancePartitions|Distinct|\w*Limit|Generate|Union|Expand|MapInArrow|FlatMap\w*)\b")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a plain scan would use no more than half of them.

    A file with one row group is read by one task. Only scans with projections and
    filters are looked at, since only their partitions are known without running
    anything; a large table has more partitions than cores and is left alone.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().optimizedPlan()
    if _MOVES.search("\n".join(line.lstrip(" :+-").split("(")[0].split(" ")[0] for line in plan.toString().splitlines())):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df
