"""Seeded draws by hash order, splits, bootstraps and adoption rules.

A draw orders rows by md5 of "seed:id", so any engine repeats it; it isn't a draw of a library's generator.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.model import require
from glossa.sources.store import table

CELLS = 64  # parts that a hot key is cut into
# Cumulative probabilities of Poisson(1).
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def hash_order(seed: int, key: str = "line_idx") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_fraction(seed: int, key: str = "line_idx") -> Column:
    """A number in [0, 1) by the first 8 hex digits."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("double") / float(16**8)


def uniform_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the first in hash order, which each partition cuts to n before they meet."""
    return rows.orderBy(hash_order(seed), "line_idx").limit(n)


def first_by(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The `most` first rows of each key; hash cells cut a hot key before its rows meet in one task."""
    cell = F.pmod(F.xxhash64(*order), F.lit(CELLS))
    cut = rows.withColumn("_cell", cell)
    cut = cut.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order))).filter(F.col("_k") <= most)
    return cut.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= most).drop("_cell", "_k")


def rank_in(rows: DataFrame, keys: list[str], order: str, name: str = "rank") -> DataFrame:
    """rows, written, with the rank (from 1) in their key by a column of any ordered type.

    Rows are dealt by sampled ranges of (keys, order), so neither a hot key nor far or hashed values fill one task,
    and sorted there; the runs of a key, one a partition at most, give each run's offset. Nulls come first; the order
    among equal values is open.
    """
    by = [*keys, order]
    dealt = rows.repartitionByRange(*by, F.xxhash64(*rows.columns)).sortWithinPartitions(*by)
    dealt = table(dealt.withColumn("_seen", F.monotonically_increasing_id()), "ranks").withColumn("_part", F.shiftright("_seen", 33))
    runs = dealt.groupBy(*keys, "_part").agg(F.min("_seen").alias("_start"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_part").alias("_run"), (before - F.col("_start") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return dealt.join(F.broadcast(runs), same).withColumn(name, F.col("_seen") + F.col("_shift")).select(*rows.columns, name)  # partitions and keys together, at most


def balanced_draw(rows: DataFrame, seed: int, most: int = 100, share: float = 0.5, exclude: DataFrame | None = None) -> DataFrame:
    """min(most, floor(share * pool)) lines a label, the pool without the lines of `exclude`."""
    pool = rows if exclude is None else rows.join(exclude.select("line_idx"), "line_idx", "left_anti")
    sizes = pool.groupBy("y").agg(F.count(F.lit(1)).alias("pool"))  # a row a label
    order = [hash_order(seed), F.col("line_idx")]
    first = first_by(pool, ["y"], order, most).join(F.broadcast(sizes), "y")
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy(*order)))  # at most `most` rows a label
    return first.filter(F.col("k") <= F.floor(share * F.col("pool"))).select(*rows.columns)


def poisson_weights(draws: int, seed: int, key: str) -> Column:
    """For each draw, how often the row is taken (Poisson with mean 1, by hash): array of ints.

    A resample needs no second copy of the rows and no shuffle of its own.
    """
    u = lambda b: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), b, F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(16**8)
    return F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda b: F.aggregate(F.array(*map(F.lit, POISSON)), F.lit(0), lambda k, s: k + (u(b) >= s).cast("int")))


MEANS = [1, 4, 16, 64]  # of the draws that a number of equal rows is cut into


def poisson_table(mean: int) -> list[float]:
    """Cumulative probabilities of a Poisson law from 0 on, up to where 52 bits see no more: its terms, added up."""
    term, total, k, out = math.exp(-mean), math.exp(-mean), 0, []
    while total < 1 and (term > 2**-60 or k < mean):
        out.append(total)
        k += 1
        term *= mean / k
        total += term
    return out


RUN = 64  # pieces of a row that are drawn together


def poisson_pieces(n: Column) -> Column:
    """n as a sum of MEANS: an array of (mean, of, first, end), runs of at most RUN pieces of mean `of`, numbered from 0 (end exclusive); `mean` is the run's."""
    def runs(of: int, whole: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(0).cast("long"), F.floor(whole / RUN)), lambda r: r * RUN < whole)
        ends = F.transform(numbers, lambda r: F.struct((r * RUN).alias("first"), F.least((r + 1) * RUN, whole).alias("end")))
        return F.transform(ends, lambda e: F.struct((of * (e["end"] - e["first"])).alias("mean"), F.lit(of).alias("of"), e["first"].alias("first"), e["end"].alias("end")))

    pieces, left = [], n.cast("long")
    for mean in reversed(MEANS):
        whole = F.floor(left / mean)
        pieces.append(runs(mean, whole))
        left = left - whole * mean
    return F.concat(*pieces)


def poisson_draws(counts: DataFrame, key: Column, draws: int, seed: int) -> DataFrame:
    """counts (…, n) with draw and k for every run of pieces: the k of a row's runs add up to a Poisson(n) number, how often n equal rows are taken together.

    Each piece is an exact inverse draw by a 52-bit hash of seed, draw, key, mean and piece, and a sum of Poisson
    numbers is one again; nothing is approximated for large n. The counts are few, so they lie in one part; their runs
    are dealt to all cores, and a run's pieces add up in its task.
    """
    keep = [c for c in counts.columns if c != "n"]
    runs = counts.select(*keep, key.alias("_key"), F.explode(poisson_pieces(F.col("n"))).alias("_run")).select(*keep, "_key", "_run.of", "_run.first", "_run.end")
    tables = {mean: np.array(poisson_table(mean)) for mean in MEANS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = pa.array(np.arange(draws, dtype=np.int32))
        for batch in batches:
            rows = batch.select(["_key", "of", "first", "end"]).to_pylist()
            for at, row in enumerate(rows):
                tail = "".join(f"{x}:" for x in (row["_key"], row["of"]) if x is not None)
                pieces = [str(i).encode() for i in range(row["first"], row["end"])]
                heads = (f"{seed}:{d}:{tail}".encode() for d in range(draws))
                digests = b"".join([hashlib.md5(head + i, usedforsecurity=False).digest() for head in heads for i in pieces])
                u = (np.frombuffer(digests, ">u8")[::2] >> 12).astype(np.float64) / 2.0**52  # the first 13 hex digits
                k = np.searchsorted(tables[row["of"]], u, side="right").reshape(draws, len(pieces)).sum(axis=1)
                same = pa.array(np.full(draws, at))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in keep), draw, pa.array(k, pa.int64())], names=[*keep, "draw", "k"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*keep).schema)
    return runs.repartition(2 * counts.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"{schema}, draw int, k long")


def bootstrap_counts(values: DataFrame, value: str, draws: int, seed: int) -> DataFrame:
    """As `bootstrap_interval`, for a value that takes few distinct ones: rows are counted once, and n equal rows are taken Poisson(n) times together."""
    counts = values.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    taken = poisson_draws(counts, F.col("v").cast("string"), draws, seed)
    means = taken.groupBy("draw").agg(F.try_divide(F.sum(F.col("k") * F.col("v")), F.sum("k")).alias("mean"))
    ends = means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return counts.agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean")).crossJoin(ends)


def bootstrap_macro_f1(rows: DataFrame, base: str, cand: str, draws: int, seed: int) -> DataFrame:
    """mean, low and high (2.5 and 97.5 percentiles) of macro-F1(cand) - macro-F1(base) over resamples of the lines (y, base, cand).

    Both systems are scored on the same resample. Lines are counted by (y, base, cand) once; each draw takes its cells
    and scores the labels that it has lines of. An empty prediction (null) misses its label and is no false positive.
    """
    cells = rows.groupBy("y", F.col(base).alias("a"), F.col(cand).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    taken = poisson_draws(cells, F.concat_ws("|", "y", F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))), draws, seed).filter("k > 0")
    none = F.lit(0).cast("long")
    side = lambda label, support, a, b: F.struct(F.col(label).alias("label"), support.alias("support"), a.alias("pred_a"), b.alias("pred_b"))
    k = F.col("k")
    sides = F.array(side("y", k, none, none), side("a", none, k, none), side("b", none, none, k))
    right = [F.when(F.col("s.label").eqNullSafe(F.col("y")) & (F.col("s.support") > 0) & F.col(c).eqNullSafe(F.col("y")), k).otherwise(none) for c in ("a", "b")]
    each = taken.withColumn("s", F.explode(sides)).filter("s.label IS NOT NULL")
    by = each.select("draw", "s.*", right[0].alias("tp_a"), right[1].alias("tp_b")).groupBy("draw", "label").agg(*(F.sum(c).alias(c) for c in ("support", "pred_a", "pred_b", "tp_a", "tp_b")))
    f1 = lambda c: 2.0 * F.col(f"tp_{c}") / (F.col("support") + F.col(f"pred_{c}"))
    deltas = by.filter("support > 0").groupBy("draw").agg(F.avg(f1("b") - f1("a")).alias("delta"))
    return deltas.agg(F.avg("delta").alias("mean"), F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"))


def accept(rows: DataFrame, value: str, published: float, tolerance: float = 0.005) -> DataFrame:
    """rows with `accepted`; a value further than the tolerance from the published one raises."""
    far = ~(F.abs(F.col(value) - published) <= tolerance)
    return require(rows, F.coalesce(far, F.lit(True)), f"a value is over {tolerance} from the published one").withColumn("accepted", F.lit(True))


def bootstrap_interval(values: DataFrame, value: str, key: str, draws: int, seed: int) -> DataFrame:
    """Mean of a value over rows, with the 2.5 and 97.5 percentiles of its resampled means."""
    taken = values.select(F.col(value).alias("v"), F.posexplode(poisson_weights(draws, seed, key)).alias("draw", "k"))
    means = taken.groupBy("draw").agg(F.try_divide(F.sum(F.col("k") * F.col("v")), F.sum("k")).alias("mean"))
    ends = means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return values.agg(F.avg(value).alias("mean")).crossJoin(ends)


def passes_guard(strata: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """strata (stratum, base, cand, with a row "overall"): overall must rise and none may fall by more than the tolerance."""
    overall = F.max(F.when(F.col("stratum") == "overall", F.col("cand") > F.col("base")))
    return strata.agg((F.coalesce(overall, F.lit(False)) & F.bool_and(F.col("cand") >= F.col("base") - tolerance)).alias("passes"))


def two_sided(strata: DataFrame, per_label: DataFrame, tol: float = 0.01, wide: float = 0.03, widest: float = 0.05, ratio: float = 5.0, collapse: float = 0.10, support: int = 10, outliers: int = 2) -> DataFrame:
    """One row: adopted, and the clauses that failed.

    strata: (stratum, base, cand, gain), gain being the change of the stratum's global mean F1 (null where none is
    kept). per_label: (label, base_f1, cand_f1, support). A stratum with a gain may fall by `wide` if the gain is
    above its loss, by `widest` if above `ratio` times; others by `tol`.
    """
    loss = F.col("base") - F.col("cand")
    allowed = F.when(F.col("gain") > ratio * F.greatest(loss, F.lit(0.0)), widest).when(F.col("gain") > F.greatest(loss, F.lit(0.0)), wide).otherwise(tol)
    a = strata.agg(F.count_if(loss > allowed).alias("within"), F.count_if(F.col("gain") < 0).alias("global"))
    drop = F.col("base_f1") - F.col("cand_f1")
    b = per_label.agg((F.avg("cand_f1") < F.avg("base_f1") - tol).alias("macro"), F.count_if((F.col("support") >= support) & (drop > collapse)).alias("collapsed"))
    both = a.crossJoin(b)
    return both.withColumn("adopted", (F.col("within") == 0) & (F.col("global") == 0) & ~F.col("macro") & (F.col("collapsed") <= outliers))


def near_ties(configs: DataFrame, value: str = "overall", band: float = 0.001) -> DataFrame:
    """The best configuration and all within `band` of it."""
    return configs.withColumn("best", F.max(value).over(Window.partitionBy())).filter(F.col(value) >= F.col("best") - band).drop("best")


def noise(text: Column, rate: float, seed: int, inventory: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Each character that isn't white space replaced with probability `rate` by one of the inventory, by md5 of place and text."""
    base = F.md5(text)

    def one(c: Column, i: Column) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(seed), i, base))
        u = F.conv(F.substring(h, 1, 6), 16, 10).cast("int")
        pick = F.substring(F.lit(inventory), F.conv(F.substring(h, 7, 6), 16, 10).cast("int") % len(inventory) + 1, F.lit(1))
        return F.when(c.rlike(r"^\s$") | (u >= int(rate * 16**6)), c).otherwise(pick)

    return F.array_join(F.transform(F.split(text, ""), one), "")
