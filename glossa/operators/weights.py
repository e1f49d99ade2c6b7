"""Transforms of model weights; each takes and returns the long form (y, token, n, total, p, w, seen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row():
    """The window of a label's weights."""
    return Window.partitionBy("y")


def renormalise(model: DataFrame) -> DataFrame:
    """w less its row's log-sum-exp. The two windows share one shuffle by label."""
    top = model.withColumn("top", F.max("w").over(row()))
    return top.withColumn("w", F.col("w") - F.col("top") - F.log(F.sum(F.exp(F.col("w") - F.col("top"))).over(row()))).drop("top")


def clamp(model: DataFrame, floor: float | None) -> DataFrame:
    return model if floor is None else model.withColumn("w", F.greatest("w", F.lit(floor)))


def equalise_floor(model: DataFrame, target: float) -> DataFrame:
    """Unseen tokens go down to `target` in the rows whose least weight is above it; nothing is renormalised, no floor is raised."""
    least = F.min("w").over(row())
    return model.withColumn("least", least).withColumn("w", F.when((F.col("least") > target) & ~F.col("seen"), F.lit(target)).otherwise(F.col("w"))).drop("least")


def good_turing(model: DataFrame, budget: float = 1.0) -> DataFrame:
    """Unseen mass becomes the share of singletons where that is less; seen weights are shifted so that rows keep their sum."""
    stats = {
        "mass": F.sum(F.when(~F.col("seen"), F.col("p")).otherwise(0.0)).over(row()),
        "unseen": F.sum((~F.col("seen")).cast("int")).over(row()),
        "once": F.sum((F.col("n") == 1).cast("int")).over(row()),
    }
    target = F.least(F.col("mass"), budget * F.col("once") / F.col("total"))
    rows = model.withColumns(stats).withColumn("goal", target)
    moved = F.when(F.col("seen"), F.col("w") + F.log((budget - F.col("goal")) / (budget - F.col("mass")))).otherwise(F.log(F.col("goal") / F.col("unseen")))
    usable = (F.col("once") > 0) & (F.col("unseen") > 0)
    return rows.withColumn("w", F.when(usable, moved).otherwise(F.col("w"))).drop(*stats, "goal")


def background_floor(model: DataFrame, base: DataFrame, mean: float = -21.0) -> DataFrame:
    """Unseen tokens get the base's log-probability plus a constant that puts the base's mean at `mean`."""
    shift = base.select("token", (F.log("p_base") + mean - F.avg(F.log("p_base")).over(Window.partitionBy())).alias("floor"))
    return model.join(F.broadcast(shift), "token").withColumn("w", F.when(F.col("seen"), F.col("w")).otherwise(F.col("floor"))).drop("floor")


def backbone_mean(model: DataFrame, group: str, n_lines: str, bar: int, cap: int, near: DataFrame | None = None) -> DataFrame:
    """(y, token, prior): mean of the probabilities of the other rows of y's group with at least `bar` lines, by lines up to `cap`.

    near (y, other) lists rows that don't count for y. Sums by group less a row's own (and its near ones') part give
    the means, so no row is paired with another.
    """
    weight = F.when(F.col(n_lines) >= bar, F.least(F.col(n_lines), F.lit(cap))).otherwise(0).cast("double")
    rows = model.withColumn("k", weight)
    over = Window.partitionBy(group, "token")
    rows = rows.withColumns({"num": F.sum(F.col("k") * F.col("p")).over(over) - F.col("k") * F.col("p"), "den": F.sum("k").over(over) - F.col("k")})
    if near is not None:
        out = rows.select(F.col("y").alias("other"), "token", (F.col("k") * F.col("p")).alias("kp"), F.col("k").alias("k2"))
        lost = F.broadcast(near).join(out, "other").groupBy("y", "token").agg(F.sum("kp").alias("kp"), F.sum("k2").alias("k2"))
        rows = rows.join(lost, ["y", "token"], "left")
        rows = rows.withColumns({"num": F.col("num") - F.coalesce("kp", F.lit(0.0)), "den": F.col("den") - F.coalesce("k2", F.lit(0.0))})
    return rows.filter("den > 0.5").select("y", "token", (F.col("num") / F.col("den")).alias("prior"))


def back_off(model: DataFrame, prior: DataFrame, n_lines: str, alpha: float, mode: str = "lift") -> DataFrame:
    """Mix with a prior by alpha / (lines + alpha): unseen tokens only and never down (lift), or all (full)."""
    share = alpha / (F.col(n_lines) + alpha)
    rows = model.join(prior, ["y", "token"], "left")
    mixed = (1 - share) * F.col("p") + share * F.col("prior")
    new = F.when(~F.col("seen"), F.greatest(F.col("p"), share * F.col("prior"))).otherwise(F.col("p")) if mode == "lift" else mixed
    new = F.when(F.col("prior").isNull(), F.col("p")).otherwise(new)
    return rows.withColumn("w", F.log(F.greatest(new, F.lit(1e-30)))).drop("prior")


def shrink(model: DataFrame, prior: DataFrame, share: Column) -> DataFrame:
    """(1 - share) p + share prior where there is a prior."""
    rows = model.join(prior, ["y", "token"], "left")
    new = F.when(F.col("prior").isNull(), F.col("p")).otherwise((1 - share) * F.col("p") + share * F.col("prior"))
    return rows.withColumn("w", F.log(F.greatest(new, F.lit(1e-30)))).drop("prior")


def sharpen(model: DataFrame, beta: float) -> DataFrame:
    return renormalise(model.withColumn("w", beta * F.col("w")))


def interpolate(model: DataFrame, partner: DataFrame, share: float) -> DataFrame:
    """share p + (1 - share) p of the partner row; partner: (y, other)."""
    other = model.select(F.col("y").alias("other"), "token", F.col("p").alias("p_other"))
    linked = F.broadcast(partner).join(other, "other").select("y", "token", "p_other")
    rows = model.join(linked, ["y", "token"], "left")
    return rows.withColumn("w", F.log(F.greatest(F.when(F.col("p_other").isNull(), F.col("p")).otherwise(share * F.col("p") + (1 - share) * F.col("p_other")), F.lit(1e-30)))).drop("p_other")


def script_average(model: DataFrame, script: str, small: Column, share: float) -> DataFrame:
    """The rows that are `small` mixed with the mean of all rows of their script."""
    mean = F.avg("p").over(Window.partitionBy(script, "token"))
    rows = model.withColumn("mean", mean)
    return rows.withColumn("w", F.log(F.when(small, share * F.col("p") + (1 - share) * F.col("mean")).otherwise(F.col("p")))).drop("mean")


def tie(model: DataFrame, tied: Column, n_lines: str, by: str | None = None, alpha: float | None = None) -> DataFrame:
    """Tied tokens get the mean over rows weighted by lines (all rows, or those of a script); with alpha only that share alpha / (lines + alpha)."""
    over = Window.partitionBy("token") if by is None else Window.partitionBy("token", by)
    rows = model.withColumn("mean", F.try_divide(F.sum(F.col(n_lines) * F.col("p")).over(over), F.sum(n_lines).over(over)))
    new = F.col("mean") if alpha is None else F.col("p") + alpha / (F.col(n_lines) + alpha) * (F.col("mean") - F.col("p"))
    return rows.withColumn("w", F.when(tied & F.col("mean").isNotNull(), F.log(new)).otherwise(F.col("w"))).drop("mean")


def discriminate(model: DataFrame, setup: str, strength: float, base: DataFrame | None = None) -> DataFrame:
    """Weights of a cluster's rows by the variance of each token over them, renormalised.

    a: tokens above the median positive variance gain strength * variance; b: all move by the z-score; c: a sigmoid of
    the variance keeps the row's weight or takes the base's.
    """
    var = model.groupBy("token").agg(F.var_pop("w").alias("v"))
    whole = var.agg(F.median(F.when(F.col("v") > 0, F.col("v"))).alias("mid"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    rows = model.join(F.broadcast(var.crossJoin(F.broadcast(whole))), "token")
    if setup == "a":
        new = F.when(F.col("v") > F.coalesce("mid", F.lit(0.0)), F.col("w") + strength * F.col("v")).otherwise(F.col("w"))
    elif setup == "b":
        new = F.when(F.col("sd") < 1e-10, F.col("w")).otherwise(F.col("w") + strength * (F.col("v") - F.col("mean")) / F.col("sd"))
    else:
        gate = 1 / (1 + F.exp(-strength * (F.col("v") - F.coalesce("mid", F.lit(0.0)))))
        rows = rows.join(F.broadcast(base), "token")
        new = F.col("w") * gate + F.log("p_base") * (1 - gate)
    return renormalise(rows.withColumn("w", new).select(*model.columns))


def mixed(first: DataFrame, second: DataFrame, use_first: Column) -> DataFrame:
    """Rows of `first` where use_first holds, those of `second` elsewhere."""
    return first.filter(use_first).unionByName(second.filter(~use_first))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many cells of two models differ (a pass that does nothing must give 0) and how far."""
    both = a.select("y", "token", F.col("w").alias("wa")).join(b.select("y", "token", F.col("w").alias("wb")), ["y", "token"], "full")
    return both.agg(F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("wa").eqNullSafe(F.col("wb"))).alias("differing"))
