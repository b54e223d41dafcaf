"""Quality gates, tiers and release checks as nested conditions; limits come from the configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _reasons(*tests: Column) -> Column:
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def publishable(auc: Column, boyce: Column, pairs: Sequence[tuple[float, float]]) -> Column:
    """Whether both skills reach one of the pairs; null skills don't."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ((auc >= a) & (boyce >= b))
    return F.coalesce(out, F.lit(False))


def evaluate(df: DataFrame, limits: dict) -> DataFrame:
    """tier, confidence, publishable, hard, soft, grade from n, auc, boyce, area, recall, status, unrecorded, gap, survey."""
    n, auc, area = F.col("n"), F.col("auc"), F.col("area")
    hard = _reasons(
        F.when(n < limits["records"], F.lit("records")),
        F.when(auc.isNull(), F.lit("no skill")).when(auc < limits["auc_floor"], F.lit("skill below floor")),
        F.when(F.col("status") == "missing", F.lit("no range check")).when(F.col("status") == "fail", F.lit("range check failed")),
        F.when(area <= 0, F.lit("empty range")).when(F.col("recall") < limits["recall"], F.lit("recall")),
    )
    enough = n >= limits["records"]
    soft = _reasons(
        F.when(enough & (n < limits["low_records"]), F.lit("few records")),
        F.when((area < limits["narrow_km2"]) & enough & (n < limits["narrow_records"]), F.lit("narrow range")),
        F.when((auc >= limits["auc_floor"]) & (auc < limits["auc_ok"]), F.lit("low discrimination")),
        F.when(F.col("unrecorded") > limits["unrecorded_warn"], F.lit("unrecorded area")),
        F.when(F.col("gap") > limits["check_gap_pp"], F.lit("check model disagrees")),
    )
    out = df.withColumn("hard", hard).withColumn("soft", soft)
    out = out.withColumn("tier", F.when(F.size("hard") > 0, F.lit("C")).when(F.col("survey"), F.lit("A")).otherwise(F.lit("B")))
    flagged = F.size("soft") > 0
    out = out.withColumn("confidence", F.when((F.col("tier") != "C") & flagged, F.lit("low")).otherwise(F.lit("standard")))
    grade = F.when(F.col("tier") == "C", F.lit("not shown")).when(flagged, F.lit("uncertain")).when(F.col("tier") == "A", F.lit("well supported")).otherwise(F.lit("supported"))
    return out.withColumn("publishable", publishable(auc, F.col("boyce"), limits["publish"]) | (F.col("tier") == "A")).withColumn("grade", grade)


def withheld(share: Column, limits: dict) -> Column:
    """Whether a scenario's numbers are withheld for novelty."""
    return F.coalesce(share > limits["novel"], F.lit(False))


def release_report(df: DataFrame, by: Sequence[str], limits: dict) -> DataFrame:
    """n, moved_share, change (median), routine for each group of rows (before, after, moved)."""
    share, change = F.avg(F.when(F.col("moved"), 1).otherwise(0)), F.median(F.abs(F.col("after") - F.col("before")))
    return df.groupBy(*by).agg(F.count("*").alias("n"), share.alias("moved_share"), change.alias("change"), ((share <= limits["moved_share"]) & (change <= limits["median_change"])).alias("routine"))


def corroborated(values: Column, alone: bool) -> Column:
    """The second largest of the sources' values; a single one decides alone, or gives null."""
    known = F.sort_array(F.filter(values, lambda x: x.isNotNull()), asc=False)
    return F.when(F.size(known) >= 2, F.get(known, F.lit(1))).when(F.lit(alone) & (F.size(known) == 1), F.get(known, F.lit(0)))
