"""Per-label token models in long form: (label, token, n, total, p, w, seen), one row a label and vocabulary token."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.5


MOST_COUNTS = 1 << 20  # counts that a task holds before it passes them on


def token_counts(lines: DataFrame) -> DataFrame:
    """n by y and token (code points). Tasks count whole texts in Arrow batches and pass on sums, so no row a code point is made and the shuffle has the vocabulary's size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[int, int]] = {}

        def out():
            y = [label for label, n in found.items() for _ in n]
            token, n = [chr(t) for c in found.values() for t in c], [x for c in found.values() for x in c.values()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(token, pa.string()), pa.array(n, pa.int64())], names=["y", "token", "n"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32)
                own = found.setdefault(label, {})
                for code, k in zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True):
                    own[code] = own.get(code, 0) + k
            if sum(map(len, found.values())) > MOST_COUNTS:
                yield out()
        yield out()

    return lines.select("y", "text").mapInArrow(partial, "y string, token string, n long").groupBy("y", "token").agg(F.sum("n").alias("n"))


def pair_counts(lines: DataFrame) -> DataFrame:
    """n by y and token, a token being two neighbouring code points; counted in tasks like `token_counts`."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out():
            y = [label for label, n in found.items() for _ in n]
            token, n = [chr(t >> 32) + chr(t & 0xFFFFFFFF) for c in found.values() for t in c], [x for c in found.values() for x in c.values()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(token, pa.string()), pa.array(n, pa.int64())], names=["y", "token", "n"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32).astype(np.int64)
                keys, n = np.unique(codes[:-1] << 32 | codes[1:], return_counts=True)
                own = found.setdefault(label, Counter())
                for key, k in zip(keys.tolist(), n.tolist(), strict=True):
                    own[key] += k
                if sum(map(len, found.values())) > MOST_COUNTS:
                    yield out()
        yield out()

    return lines.select("y", "text").mapInArrow(partial, "y string, token string, n long").groupBy("y", "token").agg(F.sum("n").alias("n"))


def dense(counts: DataFrame) -> DataFrame:
    """counts with a row for every label and token of the vocabulary (n 0 where unseen); the matrix is this size by definition."""
    labels = counts.agg(F.collect_set("y").alias("labels"))
    vocabulary = counts.select("token").distinct().crossJoin(F.broadcast(labels))
    grid = vocabulary.select("token", F.explode("labels").alias("y"))
    return grid.join(counts, ["y", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def smoothed(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The model with add-alpha probabilities: unseen tokens of a label share one floor, rows sum to 1."""
    row = Window.partitionBy("y")
    grid = dense(counts).withColumns({"total": F.sum("n").over(row), "size": F.count(F.lit(1)).over(row)})
    p = (F.col("n") + alpha) / (F.col("total") + alpha * F.col("size"))
    return grid.select("y", "token", "n", "total", p.alias("p"), F.log(p).alias("w"), (F.col("n") > 0).alias("seen"))


def floored(counts: DataFrame, floor: float = 1e-12) -> DataFrame:
    """The model of relative frequencies with a least probability (the M-step of one-code-point tokens)."""
    grid = dense(counts).withColumn("total", F.sum("n").over(Window.partitionBy("y")))
    p = F.greatest(F.col("n") / F.col("total"), F.lit(floor))
    return grid.select("y", "token", "n", "total", p.alias("p"), F.log(p).alias("w"), (F.col("n") > 0).alias("seen"))


def base_model(counts: DataFrame) -> DataFrame:
    """(token, p_base) of all labels together, add-alpha."""
    grid = counts.groupBy("token").agg(F.sum("n").alias("n"))
    all_rows = Window.partitionBy()
    return grid.select("token", ((F.col("n") + ALPHA) / (F.sum("n").over(all_rows) + ALPHA * F.count(F.lit(1)).over(all_rows))).alias("p_base"))


def require(df: DataFrame, bad, what: str) -> DataFrame:
    """df, raising where a row is `bad`: the check runs with the plan, without a pass of its own."""
    return df.filter(F.when(bad, F.raise_error(F.lit(what)).cast("boolean")).otherwise(True))
