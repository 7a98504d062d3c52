"""Results kept by content key: a run computes only what no run before it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(store: str, like: DataFrame, runs: int) -> DataFrame:
    """Results of the first ``runs`` runs, with ``part`` (the key's first digits) and ``run``."""
    schema = ", ".join(f"`{c}` {t}" for c, t in like.dtypes) + ", part STRING, run INT"
    return like.sparkSession.read.schema(schema).option("basePath", store).parquet(*[f"{store}/run={i}" for i in range(runs)])


def compute_new(requests: DataFrame, compute: Callable[[DataFrame], DataFrame], store: str, run: int, key: str = "key") -> DataFrame:
    """``requests`` with their results, of which only those whose key no run before ``run`` has stored are computed.

    requests: a hexadecimal ``key`` and what ``compute`` reads; of equal keys one goes to ``compute``, which gives the key and its results. New results
    are appended as a run of their own, by ranges of the key (its first two digits), so a join with the store reads the
    ranges that it needs; a run that is tried again replaces what it wrote. Runs are numbered from 0."""
    part = F.substring(key, 1, 2)
    once = requests.dropDuplicates([key])
    like = compute(once)
    if run:
        known = stored(store, like, run).select(key, "part")
        once = once.withColumn("part", part).join(known, [key, "part"], "left_anti").drop("part")
    compute(once).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{store}/run={run}")
    found = stored(store, like, run + 1)
    return requests.withColumn("part", part).join(found, [key, "part"]).drop("part")
