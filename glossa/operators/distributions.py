"""Divergences and flatness of the labels' token distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kl(p: Column, q: Column) -> Column:
    """Divergence in nats of grouped columns."""
    return F.sum(p * F.log(p / q))


def entropy(model: DataFrame) -> DataFrame:
    """Entropy, peak and number of entries above the least of each row."""
    least = F.min("w").over(Window.partitionBy("y"))
    return model.withColumn("least", least).groupBy("y").agg(
        F.max("total").alias("total"), (-F.sum(F.col("p") * F.log("p"))).alias("h"), F.max("p").alias("peak"), F.count_if(F.col("w") > F.col("least")).alias("above")
    )


CHUNK = 512  # tokens whose weights under all labels are one product


def pairwise(model: DataFrame, pairs: DataFrame | None = None, parts: int = 16) -> DataFrame:
    """(a, b, sym_kl) for a < b, or for the given pairs (a, b).

    A list of pairs is joined by token. All pairs come from products: tokens are dealt into `parts`, a task goes through
    its own some at a time, adds up p ln q of all labels against all, and passes on one row a pair. The model is never
    in one place, and no row a pair and token is made. A label that lacks a token is an error.
    """
    if pairs is not None:
        a = model.select(F.col("y").alias("a"), "token", F.col("p").alias("pa"))
        b = model.select(F.col("y").alias("b"), "token", F.col("p").alias("pb"))
        joined = a.join(F.broadcast(pairs), "a").join(b, ["b", "token"])
        return joined.groupBy("a", "b").agg(((kl(F.col("pa"), F.col("pb")) + kl(F.col("pb"), F.col("pa"))) / 2).alias("sym_kl"))
    labels = sorted(r[0] for r in model.select("y").distinct().collect())  # few by nature
    names, at = np.array(labels, object), {y: i for i, y in enumerate(labels)}
    upper = np.triu_indices(len(labels), 1)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(labels), len(labels)))
        rest = None
        for last, batch in ends_marked(batches):
            rows = pa.Table.from_batches([batch]) if batch is not None else None
            rows = rows if rest is None else rest if rows is None else pa.concat_tables([rest, rows])
            if rows is None or not len(rows):
                continue
            whole = len(rows) if last else len(rows) // len(labels) * len(labels)
            if not last and whole < CHUNK * len(labels):
                rest = rows
                continue
            rest = rows.slice(whole)
            y = np.array([at[x] for x in rows["y"].slice(0, whole).to_pylist()])
            if len(y) % len(labels) or (np.sort(y.reshape(-1, len(labels)), axis=1) != np.arange(len(labels))).any():
                raise ValueError("the model lacks weights of some labels and tokens")
            p = rows["p"].slice(0, whole).to_numpy().reshape(-1, len(labels))
            p = np.take_along_axis(p, np.argsort(y.reshape(-1, len(labels)), axis=1), axis=1)
            total += p.T @ np.log(p)
        own = np.diag(total)
        sym = (own[:, None] + own[None] - total - total.T)[upper] / 2
        yield pa.RecordBatch.from_arrays([pa.array(names[upper[0]], pa.string()), pa.array(names[upper[1]], pa.string()), pa.array(sym)], names=["a", "b", "sym_kl"])

    dealt = model.select("y", "token", "p").repartition(parts, "token").sortWithinPartitions("token")
    return dealt.select("y", "p").mapInArrow(products, "a string, b string, sym_kl double").groupBy("a", "b").agg(F.sum("sym_kl").alias("sym_kl"))


def ends_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    """(False, batch) for each batch and (True, None) at the end."""
    for batch in batches:
        yield False, batch
    yield True, None


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sym_kl"))


def against_base(model: DataFrame, base: DataFrame) -> DataFrame:
    """KL from the base, Pearson correlation of log-scores and mean absolute difference."""
    rows = model.join(F.broadcast(base), "token")
    return rows.groupBy("y").agg(kl(F.col("p"), F.col("p_base")).alias("kl"), F.corr("w", F.log("p_base")).alias("corr"), F.avg(F.abs(F.col("w") - F.log("p_base"))).alias("mad"))


def robust_z(rows: DataFrame, value: str, group: str, least: int = 3) -> DataFrame:
    """(value - median) / (1.4826 MAD + 1e-9) within groups of at least `least`, else 0."""
    middle = rows.groupBy(group).agg(F.median(value).alias("mid"), F.count(F.lit(1)).alias("members"))
    off = rows.join(F.broadcast(middle), group).withColumn("off", F.abs(F.col(value) - F.col("mid")))
    spread = off.groupBy(group).agg(F.median("off").alias("mad"))
    z = (F.col(value) - F.col("mid")) / (1.4826 * F.col("mad") + 1e-9)
    return off.join(F.broadcast(spread), group).withColumn("z", F.when(F.col("members") >= least, z).otherwise(0.0)).drop("mid", "mad", "off", "members")


def richer(labels: DataFrame) -> DataFrame:
    """(a, b): for each label (y, script, n_lines) the labels of its script that have more lines.

    A range join by buckets: sizes fall into buckets by powers of two, a label meets the members of its own script's
    higher buckets by equality, and only within its own bucket sizes are compared. Labels without lines have bucket -1;
    a null script meets nothing.
    """
    sized = labels.select("y", "script", F.col("n_lines").alias("n"), F.when(F.col("n_lines") > 0, F.floor(F.log2("n_lines"))).otherwise(-1).cast("int").alias("bucket"))
    highest = sized.groupBy("script").agg(F.max("bucket").alias("highest"))
    asks = sized.join(F.broadcast(highest), "script").select(F.col("y").alias("a"), "script", F.col("n").alias("own"), F.col("bucket").alias("low"), F.explode(F.sequence("bucket", "highest")).alias("bucket"))
    found = asks.join(sized.withColumnRenamed("y", "b"), ["script", "bucket"])
    return found.filter((F.col("bucket") > F.col("low")) | (F.col("n") > F.col("own"))).select("a", "b")
