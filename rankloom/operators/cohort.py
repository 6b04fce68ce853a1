"""Clinical cohorts: flags, shares and the final comparison table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.operators.joins import anchor_wins


def cohort_flags(df: DataFrame) -> DataFrame:
    """Cohort membership; a missing value never satisfies a condition, so `not chr17_pos`
    holds for a missing CHR17."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    her2_pos, her2_neg = sure(F.col("HER2") == "positive"), sure(F.col("HER2") == "negative")
    chr17_pos, jak2_pos = sure(F.col("CHR17") >= 2), sure(F.col("JAK2_RPPA") >= 0)
    germline = sure(F.col("BRCA_germline"))
    tnbc = her2_neg & ~chr17_pos & sure(F.col("ER") == "negative") & sure(F.col("PR") == "negative")
    return df.select("*", her2_pos.alias("her2_pos"), chr17_pos.alias("chr17_pos"), tnbc.alias("tnbc"),
                     (tnbc & germline).alias("tnbc_mbrca"), (tnbc & jak2_pos).alias("tnbc_jak2"))


def share(cohort: Column, flag: Column) -> Column:
    """Share of the cohort where the flag holds; NULL for an empty cohort."""
    return F.count_if(cohort & flag) / F.nullif(F.count_if(cohort), F.lit(0))


def cohort_share(df: DataFrame, cohort: str, flag: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(share(F.col(cohort), F.col(flag)).alias("share"))


def wins_all(wins: DataFrame, items: list, by: str = "g", item: str = "i") -> DataFrame:
    """TRUE where the anchor beats every listed item."""
    return (wins.where(F.col(item).isin(items)).groupBy(by)
            .agg(F.bool_and("win").alias("wins_all")))


def cohort_report(scored: DataFrame, clinical: DataFrame, anchor, combined: list, single: list,
                  by: str = "g", item: str = "i", combined_name: str = "combined") -> DataFrame:
    """Win share of the anchor per compared item and cohort, plus one row for beating all
    `combined` items.  Combined items report the mBRCA column, single items the JAK2 one."""
    wins = anchor_wins(scored, anchor, [*combined, *single], by, item)
    every = wins_all(wins, combined, by, item)
    rows = wins.select(by, F.col(item).cast("string").alias("item"), "win",
                       F.col(item).isin(combined).alias("__c")).unionByName(
        every.select(by, F.lit(combined_name).alias("item"), F.col("wins_all").alias("win"),
                     F.lit(True).alias("__c")))
    flags = cohort_flags(clinical).select(by, "her2_pos", "tnbc_mbrca", "tnbc_jak2")
    win = F.col("win")
    return (rows.join(flags, by).groupBy("item", "__c")
            .agg(share(F.col("her2_pos"), win).alias("her2_pos"),
                 share(F.col("tnbc_mbrca"), win).alias("__m"), share(F.col("tnbc_jak2"), win).alias("__j"))
            .select("item", "her2_pos", F.when(F.col("__c"), F.col("__m")).alias("tnbc_mbrca"),
                    F.when(~F.col("__c"), F.col("__j")).alias("tnbc_jak2")))
