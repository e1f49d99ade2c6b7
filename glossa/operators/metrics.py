"""Classification metrics from counts: one aggregation by (keys, true, predicted), everything else on its few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def confusion_pairs(rows: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """n by keys, y and pred; the only pass over the lines."""
    return rows.groupBy(*keys, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """support, tp, fp, fn by keys and label, over true and predicted labels; an empty prediction is a miss of its label only."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), hit.cast("long").alias("tp"), zero.alias("predicted")),
        F.struct(F.col("pred").alias("label"), zero.alias("support"), zero.alias("tp"), F.col("n").alias("predicted")),
    )
    rows = pairs.select(*keys, F.explode(sides).alias("side")).select(*keys, "side.*").filter("label is not null")
    sums = rows.groupBy(*keys, "label").agg(*(F.sum(c).alias(c) for c in ("support", "tp", "predicted")))
    return sums.select(*keys, "label", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"))


def class_scores(rows: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """class_counts with precision, recall and f1 (0 / 0 is 0)."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    counts = class_counts(confusion_pairs(rows, keys, y, pred), keys)
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1_of(tp, fp, fn)})


def summary(classes: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, micro_f1 (over all labels), macro_f1 and macro_fpr (over true labels) by keys."""
    total = F.sum("support").over(Window.partitionBy(*keys))
    fpr = ratio(F.col("fp"), total - F.col("support"))
    true = F.col("support") > 0
    return classes.withColumn("fpr", fpr).groupBy(*keys).agg(
        F.sum("support").alias("n"),
        F.round(F.sum("tp") / F.sum("support"), 9).alias("accuracy"),
        F.round(f1_of(F.sum("tp"), F.sum("fp"), F.sum("fn")), 9).alias("micro_f1"),
        F.round(F.avg(F.when(true, F.col("f1"))), 9).alias("macro_f1"),
        F.round(F.avg(F.when(true, F.col("fpr"))), 9).alias("macro_fpr"),
    )


def binned(value: Column, edges: list[int], labels: list[str]) -> Column:
    """The label of the left-closed bin [edges[i], edges[i + 1])."""
    out = F.when(value < edges[1], labels[0])
    for edge, label in zip(edges[2:], labels[1:-1], strict=True):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


# Left edges of the bins and their names.
LENGTH_EDGES, LENGTH_LABELS = [0, 30, 75, 150, 300], ["<30", "30--75", "75--150", "150--300", "300+"]
RESOURCE_EDGES, RESOURCE_LABELS = [0, 500, 1000, 12000, 18000, 35000], ["<500", "500--1k", "1k--12k", "12k--18k", "18k--35k", "35k+"]
TOP_SCRIPTS = ["Latn", "Cyrl", "Arab", "Grek", "Deva", "Hang", "Hebr", "Beng", "Jpan", "Armn"]


def length_bin(value: Column) -> Column:
    return binned(value, LENGTH_EDGES, LENGTH_LABELS)


def resource_bin(value: Column) -> Column:
    return binned(value, RESOURCE_EDGES, RESOURCE_LABELS)


def script_group(script: Column) -> Column:
    return F.when(script.isin(TOP_SCRIPTS), script).otherwise("Other")


def rank_auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Chance that a positive's score is above a negative's, ties counting half.

    Ranks come from counts by distinct score; quantiles cut the scores into parts, and sums over these give what lies
    below each, so no task sorts all rows.
    """
    by_score = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("v")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    edges = by_score.approxQuantile("v", [i / 64 for i in range(1, 64)], 0.005)
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e <= F.col("v"))) if edges else F.lit(0)
    ranged = by_score.withColumn("part", part)
    sums = ranged.groupBy("part").agg(F.sum("n").alias("in_part"))
    below = sums.select("part", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = ranged.withColumn("inner", inner).join(F.broadcast(below), "part")
    return wins.agg(
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"),
        F.round(F.try_divide(F.sum(F.col("p") * (F.col("before") + F.col("inner") + F.col("n") / 2)), F.sum("p") * F.sum("n")), 9).alias("auc"),
    )


def error_overlap(rows: DataFrame, models: list[str]) -> DataFrame:
    """One row: n, any_wrong, all_wrong, all_same_wrong, and wrong_<m>, only_<m> for each model."""
    wrong = {m: ~F.col("y").eqNullSafe(F.col(f"pred_{m}")) for m in models}
    every, some = F.lit(True), F.lit(False)
    for w in wrong.values():
        every, some = every & w, some | w
    same = F.lit(True)
    for m in models[1:]:
        same = same & F.col(f"pred_{models[0]}").eqNullSafe(F.col(f"pred_{m}"))
    only = {}
    for m in models:
        only[m] = wrong[m]
        for other in models:
            if other != m:
                only[m] = only[m] & ~wrong[other]
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(some).alias("any_wrong"), F.count_if(every).alias("all_wrong"), F.count_if(every & same).alias("all_same_wrong"),
        *(F.count_if(wrong[m]).alias(f"wrong_{m}") for m in models), *(F.count_if(only[m]).alias(f"only_{m}") for m in models),
    )


def transition(old: Column, new: Column, y: Column) -> Column:
    """What a change of systems does to a line: correct, fixed, introduced, same_wrong or other_wrong."""
    good_old, good_new = y.eqNullSafe(old), y.eqNullSafe(new)
    return (
        F.when(good_old & good_new, "correct").when(good_new, "fixed").when(good_old, "introduced")
        .when(old.eqNullSafe(new), "same_wrong").otherwise("other_wrong")
    )


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; by empty: of all rows, without a global window."""
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def delta_summary(rows: DataFrame, by: Column) -> DataFrame:
    """n, mean, median and the shares of fewer, the same and more tokens of `delta`."""
    share = lambda c: F.avg(c.cast("int"))
    d = F.col("delta")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), share(d < 0).alias("fewer"), share(d == 0).alias("same"), share(d > 0).alias("more"))


def one_sample_t(rows: DataFrame) -> DataFrame:
    """n, t and Cohen's d of `delta` against 0; null without spread."""
    n, mean, spread = F.count("delta"), F.avg("delta"), F.stddev_samp("delta")
    return rows.agg(n.alias("n"), F.try_divide(mean, spread / F.sqrt(n)).alias("t"), F.try_divide(mean, spread).alias("cohen_d"))


def signed_rank(rows: DataFrame) -> DataFrame:
    """n of deltas that aren't 0, rank sums of both signs, and z; ranks average over ties and come from counts by distinct size."""
    d = rows.filter("delta <> 0").groupBy(F.abs("delta").alias("size")).agg(F.count_if(F.col("delta") > 0).alias("plus"), F.count_if(F.col("delta") < 0).alias("minus"))
    both = F.col("plus") + F.col("minus")
    before = F.coalesce(F.sum(both).over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a distinct size
    sums = d.withColumn("rank", before + (both + 1) / 2).agg(
        F.coalesce(F.sum(both), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("plus")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * F.col("minus")), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(both * both * both - both), F.lit(0)).alias("ties"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return sums.withColumn("z", F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, spread)).drop("ties")


def macro_correct(pred: Column, macro: Column, gold: Column, *equivalent: tuple[str, str]) -> Column:
    """Whether a predicted label is the tag, has the tag as its macrolanguage, or stands with the tag in a pair (tag, label)."""
    same = (pred == gold) | F.coalesce(macro == gold, F.lit(False))
    for tag, label in equivalent:
        same = same | ((gold == tag) & (pred == label))
    return F.coalesce(same, F.lit(False))
