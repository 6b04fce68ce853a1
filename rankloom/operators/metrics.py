"""Ranking metrics per group over observed labels: gain 2^y - 1, discount 1 / log(rank + 1).

Cut-off metrics only look at the first k rows of two orders, so they keep k rows per group
and map task before any shuffle.  Full-list metrics use `grouped_rank`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.scalars import gain
from rankloom.operators.ordering import grouped_rank, score_order, top_k

LOGS = {"log2": F.log2, "ln": F.log}


def observed(df: DataFrame, label: str = "y") -> DataFrame:
    return df.where(F.col(label).isNotNull())


def _discounted(rank: Column, label: str, log: str) -> Column:
    return gain(label) / LOGS[log](rank + F.lit(1.0))


def _label_order(label: str, item: str) -> list[Column]:
    return [F.col(label).desc_nulls_last(), F.col(item).asc()]


def cutoff_metrics(df: DataFrame, ks: list[int], by: list[str] = ["g"], item: str = "i",
                   label: str = "y", score: str = "s", log: str = "log2") -> DataFrame:
    """One row per group with dcg_k, idcg_k, ndcg_k and precision_k for every k at once.

    Missing labels sort behind all others, so a group without any label keeps its row and
    the observed count below the widest k comes from the same k rows."""
    ks = sorted(set(ks))
    if ks[0] < 0:
        raise ValueError("k must not be negative")
    widest = max(max(ks), 1)
    rows = df.select(*by, item, label, score)
    none = F.lit(None).cast("int")
    by_score = top_k(observed(rows, label), by, score_order(score, item), widest, "rs").select(
        *by, item, label, "rs", none.alias("ry"))
    by_label = top_k(rows.select(*by, item, label), by, _label_order(label, item), widest, "ry").select(
        *by, item, label, none.alias("rs"), "ry")
    both = (by_score.unionByName(by_label).groupBy(*by, item)
            .agg(F.max(label).alias(label), F.max("rs").alias("rs"), F.max("ry").alias("ry")))
    zero = F.lit(0.0)
    sums = both.groupBy(*by).agg(
        F.count(F.when(F.col("ry").isNotNull(), F.col(label))).alias("__n"),
        *[e for k in ks for e in (
            F.coalesce(F.sum(F.when(F.col("rs") <= k, _discounted(F.col("rs"), label, log))), zero)
            .alias(f"dcg_{k}"),
            F.coalesce(F.sum(F.when(F.col("ry") <= k, _discounted(F.col("ry"), label, log))), zero)
            .alias(f"idcg_{k}"),
            F.count_if((F.col("rs") <= k) & (F.col("ry") <= k)).alias(f"__c_{k}"))])
    return sums.select(*by, *[c for k in ks for c in (
        F.col(f"dcg_{k}"), F.col(f"idcg_{k}"),
        (F.col(f"dcg_{k}") / F.nullif(F.col(f"idcg_{k}"), zero)).alias(f"ndcg_{k}"),
        (F.col(f"__c_{k}") / F.nullif(F.least(F.lit(k), F.col("__n")), F.lit(0))).alias(f"precision_{k}"),
    )])


def dcg(df: DataFrame, k: int | None = None, full: bool = False, by: list[str] = ["g"], item: str = "i",
        label: str = "y", score: str = "s", log: str = "log2", out: str = "dcg") -> DataFrame:
    """DCG@k by predicted order, or over the whole list; 0 for a group with no label."""
    rows = df.select(*by, item, label, *({score} - {label}))
    order = [F.col(label).isNull().asc(), *score_order(score, item)]
    ranked = grouped_rank(rows, by, order, "__r") if full else top_k(rows, by, order, k, "__r")
    return ranked.groupBy(*by).agg(
        F.coalesce(F.sum(_discounted(F.col("__r"), label, log)), F.lit(0.0)).alias(out))


def ndcg(df: DataFrame, k: int | None = None, full: bool = False, by: list[str] = ["g"], item: str = "i",
         label: str = "y", score: str = "s", log: str = "log2", out: str = "ndcg") -> DataFrame:
    """DCG over the DCG of the true order; NULL when that is 0."""
    if not full:
        wide = cutoff_metrics(df, [k], by, item, label, score, log)
        return wide.select(*by, F.col(f"ndcg_{k}").alias(out))
    rows = df.select(*by, item, label, score)
    order = [F.col(label).isNull().asc(), *score_order(score, item)]
    both = grouped_rank(grouped_rank(rows, by, order, "rs"), by, _label_order(label, item), "ry")
    return both.groupBy(*by).agg(
        (F.sum(_discounted(F.col("rs"), label, log))
         / F.nullif(F.sum(_discounted(F.col("ry"), label, log)), F.lit(0.0))).alias(out))


def full_ranks(df: DataFrame, by: list[str] = ["g"], item: str = "i", label: str = "y",
               score: str = "s") -> DataFrame:
    """Observed rows with rs, the 1-based predicted rank, and ry, the 1-based true rank."""
    seen = observed(df, label)
    return grouped_rank(grouped_rank(seen, by, score_order(score, item), "rs"),
                        by, _label_order(label, item), "ry")


def exact_avg_ndcg(df: DataFrame, by: list[str] = ["g"], **cols) -> DataFrame:
    """Whole-list NDCG averaged over groups, a missing or zero ideal counting as 0."""
    per = ndcg(df, full=True, by=by, log="ln", **cols)
    return per.agg(F.avg(F.coalesce("ndcg", F.lit(0.0))).alias("avg_ndcg"))


def mean_ndcg(df: DataFrame, k: int | None = None, full: bool = False, by: list[str] = ["g"],
              **cols) -> DataFrame:
    return ndcg(df, k, full, by, **cols).agg(F.avg("ndcg").alias("mean_ndcg"))


def ndcg_from_position(df: DataFrame, masked: str, position: str, k: int | None = None,
                       by: list[str] = ["g"], item: str = "i", label: str = "y",
                       score: str = "s", out: str = "ndcg") -> DataFrame:
    """NDCG of the candidates left (not `masked`) when the first free place is `position`
    (a 0-based column, constant per group); only places before k count."""
    left = df.where(~F.col(masked))
    both = full_ranks(left, by, item, label, score)
    place = lambda r: F.col(r) + F.col(position)
    inside = lambda r: F.lit(True) if k is None else place(r) <= k
    sums = both.groupBy(*by).agg(
        F.sum(F.when(inside("rs"), _discounted(place("rs"), label, "log2"))).alias("__d"),
        F.sum(F.when(inside("ry"), _discounted(place("ry"), label, "log2"))).alias("__b"))
    return sums.select(*by, (F.col("__d") / F.nullif(F.col("__b"), F.lit(0.0))).alias(out))


def precision_at_k(df: DataFrame, k: int, by: list[str] = ["g"], item: str = "i", label: str = "y",
                   score: str = "s", out: str = "precision") -> DataFrame:
    wide = cutoff_metrics(df, [k], by, item, label, score)
    return wide.select(*by, F.col(f"precision_{k}").alias(out))


def _ahead_of(df: DataFrame, pick: DataFrame, by: list[str], item: str, key: str) -> DataFrame:
    """Per group, how many rows come before the picked row in descending `key`."""
    floor = lambda c: F.coalesce(c, F.lit(float("-inf")))
    mine, theirs = floor(F.col(key)), floor(F.col("__key"))
    ahead = (mine > theirs) | ((mine == theirs) & (F.col(item) < F.col("__item")))
    target = pick.select(*by, F.col(key).alias("__key"), F.col(item).alias("__item"))
    return df.join(target, by).groupBy(*by).agg(F.count_if(ahead).alias("position"))


def _nth(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return top_k(df, by, order, n, "__n").where(F.col("__n") == n).drop("__n")


def rank_of_best(df: DataFrame, which: int = 0, by: list[str] = ["g"], item: str = "i",
                 label: str = "y", score: str = "s") -> DataFrame:
    """0-based predicted position of the truly `which`-th best item."""
    seen = observed(df, label).select(*by, item, label, score)
    return _ahead_of(seen, _nth(seen, by, _label_order(label, item), which + 1), by, item, score)


def rank_of_prediction(df: DataFrame, which: int = 0, by: list[str] = ["g"], item: str = "i",
                       label: str = "y", score: str = "s") -> DataFrame:
    """0-based true position of the `which`-th predicted item."""
    seen = observed(df, label).select(*by, item, label, score)
    return _ahead_of(seen, _nth(seen, by, score_order(score, item), which + 1), by, item, label)


def percentiles(df: DataFrame, k: int, by: list[str] = ["g"], item: str = "i", label: str = "y",
                score: str = "s") -> DataFrame:
    """For which = 0 .. k-1, true rank / n of the which-th predicted item; NULL past the list."""
    seen = observed(df, label).select(*by, item, label, score)
    true = grouped_rank(seen.select(*by, item, label), by, _label_order(label, item), "__ry")
    picks = top_k(seen, by, score_order(score, item), k, "__rs").select(*by, item, "__rs")
    sizes = df.groupBy(*by).agg(F.count(label).alias("__n"))
    hits = picks.join(true, [*by, item]).select(*by, (F.col("__rs") - 1).alias("which"), "__ry")
    slots = sizes.select(*by, "__n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("which"))
    return (slots.join(hits, [*by, "which"], "left")
            .select(*by, "which", ((F.col("__ry") - 1) / F.col("__n")).alias("percentile")))


def positions_of_label(df: DataFrame, value, by: list[str] = ["g"], item: str = "i",
                       label: str = "y", score: str = "s") -> DataFrame:
    """0-based predicted positions, among all rows, of the items whose label equals `value`."""
    ranked = grouped_rank(df.select(*by, item, label, score), by, score_order(score, item), "__r")
    return (ranked.where(F.col(label) == value)
            .select(*by, item, (F.col("__r") - 1).alias("position")))


def exact_rank(df: DataFrame, col: str, by: list[str] = ["g"], item: str = "i", out: str = "rank") -> DataFrame:
    return grouped_rank(df, by, score_order(col, item), out).withColumn(out, F.col(out) - 1)


def step_reward(df: DataFrame, by: list[str] = ["g"], item: str = "i", label: str = "y",
                score: str = "s", out: str = "reward") -> DataFrame:
    """Reward of placing each observed item at its predicted rank."""
    ranked = exact_rank(observed(df, label), score, by, item, "rank")
    return ranked.withColumn(out, gain(label) / F.log2(F.col("rank") + F.lit(2.0)))


def path_rewards(df: DataFrame, by: list[str] = ["g"], item: str = "i", label: str = "y",
                 score: str = "s") -> DataFrame:
    """Total reward of the predicted order and of the best order."""
    both = full_ranks(df, by, item, label, score)
    return both.groupBy(*by).agg(
        F.sum(_discounted(F.col("rs"), label, "log2")).alias("achieved"),
        F.sum(_discounted(F.col("ry"), label, "log2")).alias("best"))


METRICS = {
    "ndcg": lambda df, k, by: ndcg(df, k, by=by).withColumnRenamed("ndcg", f"ndcg_{k}"),
    "dcg": lambda df, k, by: dcg(df, k, by=by).withColumnRenamed("dcg", f"dcg_{k}"),
    "precision": lambda df, k, by: precision_at_k(df, k, by).withColumnRenamed("precision", f"precision_{k}"),
}


def evaluate_metrics(df: DataFrame, wanted: list[tuple[str, int]], by: list[str] = ["g"],
                     registry: dict = METRICS) -> DataFrame:
    """Any list of (metric name, k).  Built-in cut-off metrics share one pass; callables a
    user adds to the registry are joined on the group key."""
    shared = [(m, k) for m, k in wanted if registry.get(m) is METRICS.get(m) and m in METRICS]
    other = [(m, k) for m, k in wanted if (m, k) not in shared]
    parts = []
    if shared:
        wide = cutoff_metrics(df, sorted({k for _, k in shared}), by)
        parts.append(wide.select(*by, *[f"{m}_{k}" for m, k in shared]))
    parts += [registry[m](df, k, by) for m, k in other]
    return reduce(lambda a, b: a.join(b, by), parts)


