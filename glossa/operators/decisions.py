"""Decision rules over candidates: for each line an array of (score, label, n_lines), best first, the lesser label on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.model import require
from glossa.operators.sampling import first_by

PLACES = 4  # scores are rounded before they are compared, so that the order of a sum decides nothing


def candidates(scores: DataFrame, k: int | None = 5, value: Column | None = None) -> DataFrame:
    """line_idx, y and cands of scores that stand one label a row: the k best by `value` (the score), ties by label."""
    value = F.col("score") if value is None else value
    entry = F.struct((-value).alias("minus"), F.col("label"), F.col("n_lines"))
    sorted_all = F.array_sort(F.collect_list(entry))
    best = F.transform(sorted_all if k is None else F.slice(sorted_all, 1, k), lambda c: F.struct((-c["minus"]).alias("score"), c["label"].alias("label"), c["n_lines"].alias("n_lines")))
    return scores.groupBy("line_idx", "y").agg(best.alias("cands"))


def top(n: int = 1, field: str = "label") -> Column:
    return F.try_element_at("cands", F.lit(n))[field]


def gap() -> Column:
    """Score of the first less that of the second; infinite with one candidate."""
    return F.when(F.size("cands") < 2, F.lit(float("inf"))).otherwise(F.round(top(1, "score") - top(2, "score"), PLACES))


def thresholds(rows: DataFrame, share: float | Column, least: int, most: int = 2000, stop: bool = False) -> DataFrame:
    """(label, n_own, n_won, tau, excluded): a quantile of the gaps of each label's own lines that it wins.

    At most `most` own lines a label are looked at, those of smallest md5. Under `least` finite gaps, or with a
    share of 0, a label is excluded (tau null); with `stop`, too few gaps raise instead.
    """
    own = first_by(rows, ["y"], [F.md5(F.col("line_idx").cast("string"))], most)
    won = (top() == F.col("y")) & (gap() != float("inf"))
    stats = own.groupBy(F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n_own"), F.count_if(won).alias("n_won"), F.array_sort(F.collect_list(F.when(won, gap()))).alias("gaps"), F.max("own_lines").alias("own_lines"))
    share = F.lit(share) if not isinstance(share, Column) else share
    at = share * (F.size("gaps") - 1)
    low = F.floor(at).cast("int")
    value = F.get("gaps", low) + (at - low) * (F.coalesce(F.get("gaps", low + 1), F.get("gaps", low)) - F.get("gaps", low))
    if stop:
        stats = require(stats, F.col("n_won") < least, f"a label has under {least} gaps")
    excluded = (F.col("n_won") < least) | (share <= 0)
    return stats.select("label", "n_own", "n_won", F.when(~excluded, value).alias("tau"), excluded.alias("excluded"))


def gate(rows: DataFrame, taus: DataFrame, target: str, bar: int = 0, reach: float | None = None) -> DataFrame:
    """rows with `pred` and `outcome` (kept, moved, blocked_by_proximity, no_candidate) under a gate.

    A line whose gap is under its first label's tau goes to the second candidate (target "second"), or to the first of
    ranks 2 to 5 with at least `bar` lines (target "head") whose score is at most `reach` below the first.
    """
    rows = rows.withColumn("first", top()).withColumn("gap", gap())
    rows = rows.join(F.broadcast(taus.select(F.col("label").alias("first"), "tau")), "first", "left")
    open_gate = F.coalesce(F.col("gap") < F.col("tau"), F.lit(False))
    others = F.slice("cands", 2, 4)
    fit = F.slice("cands", 2, 1) if target == "second" else F.filter(others, lambda c: c["n_lines"] >= bar)
    near = fit if reach is None else F.filter(fit, lambda c: top(1, "score") - c["score"] <= reach)
    outcome = F.when(~open_gate, "kept").when(F.size(near) > 0, "moved").when(F.size(fit) > 0, "blocked_by_proximity").otherwise("no_candidate")
    rows = rows.withColumns({"outcome": outcome, "goal": F.get(near, F.lit(0))["label"]})
    return rows.withColumn("pred", F.when(F.col("outcome") == "moved", F.col("goal")).otherwise(F.col("first"))).drop("goal", "tau")


def agreeing(rows: DataFrame, saved: DataFrame, least: float = 0.99) -> DataFrame:
    """rows whose first label is the saved one (line_idx, saved); an agreement under `least` over all rows raises.

    The agreement is one number, which is counted before any row is passed on.
    """
    both = rows.join(saved.select("line_idx", "saved"), "line_idx", "left").withColumn("same", top().eqNullSafe(F.col("saved")))
    share = both.agg(F.avg(F.col("same").cast("int"))).first()[0]
    if share is not None and share < least:
        raise ValueError(f"only {share:.4f} of the labels equal the saved ones, under {least}")
    return both.filter("same").drop("same", "saved")


def macro_decision(rows: DataFrame, macro: DataFrame) -> DataFrame:
    """(line_idx, y, macro, pred): the group of largest log-sum-exp over its candidates, and its best member."""
    flat = rows.select("line_idx", "y", F.explode("cands").alias("c")).select("line_idx", "y", "c.*").join(F.broadcast(macro), "label")
    best = flat.groupBy("line_idx", "y", "macro").agg(F.max("score").alias("top"), F.sort_array(F.collect_list("score")).alias("all"), F.min(F.struct(-F.col("score"), "label")).alias("m"))
    lse = F.round(F.col("top") + F.log(F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))), PLACES)
    first = best.withColumn("lse", lse).groupBy("line_idx", "y").agg(F.min(F.struct(-F.col("lse"), "macro", F.col("m.label").alias("pred"))).alias("f"))
    return first.select("line_idx", "y", "f.macro", "f.pred")


def learn_bias(rows: DataFrame, labels: list[str], centre: dict[str, float], l2: float = 1e-2, steps: int = 60, memory: int = 8):
    """Label biases that minimise the mean softmax loss over candidates plus l2 (b - centre)^2, by L-BFGS.

    Only lines whose label is among their candidates count. Each step is one aggregation: loss and gradient by label,
    as many rows as labels. Returns (biases, losses).
    """
    import numpy as np

    at = {x: i for i, x in enumerate(labels)}
    rows = rows.filter(F.exists("cands", lambda c: c["label"] == F.col("y"))).select("y", "cands")
    n = rows.count()
    mid = np.array([centre.get(x, 0.0) for x in labels])

    def loss_and_gradient(b):
        table = F.create_map(*(F.lit(v) for x in labels for v in (x, float(b[at[x]]))))
        logits = F.transform("cands", lambda c: F.struct(c["label"].alias("label"), (c["score"] + table[c["label"]]).alias("v")))
        step = rows.select("y", logits.alias("c")).withColumn("top", F.array_max(F.transform("c", lambda c: c["v"])))
        step = step.withColumn("z", F.aggregate("c", F.lit(0.0), lambda s, c: s + F.exp(c["v"] - F.col("top"))))
        parts = F.transform("c", lambda c: F.struct(c["label"].alias("label"), (F.exp(c["v"] - F.col("top")) / F.col("z") - (c["label"] == F.col("y")).cast("double")).alias("g"), F.when(c["label"] == F.col("y"), F.log("z") + F.col("top") - c["v"]).otherwise(0.0).alias("l")))
        sums = step.select(F.explode(parts).alias("p")).groupBy("p.label").agg(F.sum("p.g"), F.sum("p.l")).collect()  # a row a label
        g, loss = np.zeros(len(labels)), 0.0
        for label, dg, dl in sums:
            g[at[label]], loss = dg / max(n, 1), loss + dl / max(n, 1)
        return loss + l2 * ((b - mid) ** 2).sum(), g + 2 * l2 * (b - mid)

    b = mid.copy()
    value, g = loss_and_gradient(b)
    losses, s_list, y_list = [value], [], []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if s_list:
            q *= s_list[-1] @ y_list[-1] / (y_list[-1] @ y_list[-1])
        for (s, y), a in zip(zip(s_list, y_list, strict=True), reversed(alphas), strict=True):
            q += s * (a - y @ q / (s @ y))
        length, moved = 1.0, False
        for _ in range(12):
            new_value, new_g = loss_and_gradient(b - length * q)
            if new_value <= value - 1e-4 * length * (g @ q):
                moved = True
                break
            length /= 2
        if not moved:
            break
        s, y = -length * q, new_g - g
        if s @ y > 1e-12:
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        done = abs(value - new_value) < 1e-9
        b, value, g = b + s, new_value, new_g
        losses.append(value)
        if done:
            break
    return dict(zip(labels, b.tolist(), strict=True)), losses
