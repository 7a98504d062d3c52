"""Annual figures from filing entries (``cik, tag, pos, start, end, val, form, fp, filed``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_DAYS, YEARS = 300, 3
# Each concept's candidate tags in order, and whether it is a balance at a date.
CONCEPTS = [
    ("revenue", ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"], False), ("net_income", ["NetIncomeLoss"], False),
    ("gross_profit", ["GrossProfit"], False), ("operating_income", ["OperatingIncomeLoss"], False), ("assets", ["Assets"], True), ("liabilities", ["Liabilities"], True),
    ("equity", ["StockholdersEquity"], True), ("operating_cash_flow", ["NetCashProvidedByUsedInOperatingActivities"], False),
]


def concept_table(spark: SparkSession, concepts=CONCEPTS) -> DataFrame:
    rows = [(c, t, i, balance) for c, tags, balance in concepts for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "concept string, tag string, tag_order int, balance boolean")


def fiscal_year(end: Column | str) -> Column:
    """Closes in January belong to the year before."""
    return (F.year(end) - (F.month(end) == 1).cast("int")).cast("bigint")


def annual_entries(entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Entries of annual reports for known concepts; flows need a period of over 300 days, balances none.
    Dates that don't parse drop their row."""
    types = dict(entries.dtypes)
    d = lambda c: F.col(c) if types[c] == "date" else F.to_date(F.try_to_timestamp(F.col(c).cast("string"))).alias(c)
    e = entries.where("form = '10-K' AND fp = 'FY' AND val IS NOT NULL").withColumns({c: d(c) for c in ("start", "end", "filed")}).where("`end` IS NOT NULL")
    return e.join(F.broadcast(concepts), "tag").where(F.col("balance") | (F.datediff("end", "start") > MIN_DAYS))


def latest_per_close(annual: DataFrame) -> DataFrame:
    """Of entries for one close the one filed last; on a tie the later in the array."""
    best = F.max_by(F.struct("val", "filed", "start"), F.struct("filed", "pos"))
    return annual.groupBy("cik", "concept", "tag", "tag_order", "end").agg(best.alias("x")).select("cik", "concept", "tag", "tag_order", "end", "x.*")


def annual_facts(entries: DataFrame, concepts: DataFrame, years: int = YEARS) -> DataFrame:
    """``cik, concept, tag, end, fy, val``: per concept the tag with the most recent close (ties: the first),
    and its newest closes."""
    e = latest_per_close(annual_entries(entries, concepts))
    by_tag = e.groupBy("cik", "concept", "tag", "tag_order").agg(F.max("end").alias("newest"))
    chosen = by_tag.groupBy("cik", "concept").agg(F.max_by("tag", F.struct("newest", -F.col("tag_order"))).alias("tag"))
    nth = F.row_number().over(Window.partitionBy("cik", "concept").orderBy(F.desc("end")))
    return e.join(chosen, ["cik", "concept", "tag"]).withColumn("nth", nth).where(F.col("nth") <= years).select("cik", "concept", "tag", "end", fiscal_year("end").alias("fy"), "val")


def filers_with_facts(filers: DataFrame, facts: DataFrame) -> DataFrame:
    n = facts.groupBy("cik").agg(F.count("*").alias("facts"))
    return filers.join(n, "cik", "left").withColumn("facts", F.coalesce("facts", F.lit(0)).cast("bigint"))


def facts_by_concept(facts: DataFrame) -> DataFrame:
    """``cik, concept, line``: values newest first, in millions."""
    one = F.concat(F.lit("FY"), F.col("fy").cast("string"), F.lit(": "), F.format_number(F.col("val") / 1e6, 2), F.lit(" M"))
    newest = F.transform(F.sort_array(F.collect_list(F.struct("end", one.alias("s"))), asc=False), lambda x: x["s"])
    return facts.groupBy("cik", "concept").agg(F.concat_ws("; ", newest).alias("line"))
