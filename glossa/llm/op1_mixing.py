"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import read, small, word_count, written

CELLS = 4096


def source_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size) with the cyclic weight of each source in code point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.create_map(*chain.from_iterable((F.lit(i), F.lit(float(w))) for i, w in enumerate(weights)))
    return sources.withColumn("weight", table[rank % len(weights)])


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """target per source: a share of all sizes by weight, clamped at max_epochs times the source's size.

    Each round clamps the sources above their cap and shares what is left by weight among the others,
    until none is above. Only one row a round comes to the driver.
    """
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * max_epochs
    level = 0.0
    while True:
        free = F.col("weight") * level < cap if level else cap > 0
        fixed, open_weight, n_free = sources.agg(
            F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight"))), F.count_if(free)
        ).first()
        if not n_free:
            break
        raised = (total - (fixed or 0.0)) / open_weight
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.round(F.least(cap, F.col("weight") * level), 6))


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key")))


def _cell(first: int) -> Column:
    return F.conv(F.substring("key", first, 3), 16, 10).cast("int")


def _boundary(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Per key, the cell in which the running size reaches `need`, with the sum before it and its own."""
    w = Window.partitionBy(*keys).orderBy(cell)
    return (
        cells.withColumn("upto", F.sum("words").over(w))
        .withColumn("before", F.col("upto") - F.col("words"))
        .filter((F.col("before") < F.col("need")) & (F.col("upto") >= F.col("need")))
    )


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), max_epochs: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats and the columns `keep` for each row of docs (doc_id, text, source).

    A source takes floor(target / size) whole repetitions of every document and, for the rest, the documents of
    smallest seeded key up to the wanted words: a histogram of 4096 key cells a source finds the cell in which the
    sum is reached, a second one inside that cell the part, and the last part of a part (a 2^-24 share of the
    source, mostly one document) goes whole to the nearer side. A hot source is thus cut by key cell; no task needs
    all its rows. Null sources form one source, null and empty texts have size 0 and are taken 0 times, repeated
    rows share their fate. Rows with no words at all give target 0.
    """
    text_key = F.md5(F.coalesce("text", F.lit(""))).alias("text_key")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_key, F.struct(F.lit(0), *keep).alias("kept"))
    rows = rows.withColumn("key", _key(seed)).drop("text_key")
    sized = written(rows.drop("kept"), "mix-sizes")
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = water_fill(source_weights(sources, weights), share, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = written(plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "s"), "mix-plan")
    needy = plan.filter("need > 0").select("s", "need")

    same = F.col("source").eqNullSafe(F.col("s"))
    cells = sized.withColumn("c1", _cell(1)).groupBy("source", "c1").agg(F.sum("size").alias("words"))
    one = _boundary(cells.join(small(needy), same).select("s", "c1", "words", "need"), ["s"], "c1").select("s", "c1", (F.col("need") - F.col("before")).alias("need"))
    one = written(one, "mix-cell")
    inner = (
        sized.withColumn("d1", _cell(1)).join(small(one), same & (F.col("c1") == F.col("d1")))
        .withColumn("c2", _cell(4)).groupBy("s", "c1", "need", "c2").agg(F.sum("size").alias("words"))
    )
    two = _boundary(inner, ["s"], "c2").select("s", "c1", "c2", (F.col("need") - F.col("before") >= F.col("upto") - F.col("need")).alias("last"))
    bounds = two.withColumn("bound", F.col("c1") * CELLS + F.col("c2") + F.col("last").cast("int")).select(F.col("s").alias("b"), "bound")
    plan = written(plan.join(bounds, F.col("s").eqNullSafe(F.col("b")), "left").select("s", "source_size", "target", "whole", F.coalesce("bound", F.lit(0)).alias("bound")), "mix-bounds")
    out = (rows if keep else sized.withColumn("kept", F.struct(F.lit(0)))).join(small(plan), same, "left")
    repeats = F.col("whole") + (_cell(1) * CELLS + _cell(4) < F.col("bound")).cast("long")
    repeats = F.when(F.col("size") > 0, repeats).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.alias("repeats"), *(F.col(f"kept.{c}").alias(c) for c in keep if c != "doc_id"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed at 150 % of their words by the weights 3, 1, 2."""
    docs = read(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
keyed AS (SELECT *, ('0x' || substr(key, 1, 3))::INT AS c1, ('0x' || substr(key, 4, 3))::INT AS c2 FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
lvl AS (SELECT arg_min(level, full_at) FILTER (WHERE level <= full_at) AS level FROM levels),
targets AS (
  SELECT source, source_size, weight,
         round(least(2.0::DOUBLE * source_size, weight * coalesce(lvl.level, 'infinity'::DOUBLE)), 6) AS target
  FROM sources, lvl),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
needs AS (SELECT *, target - whole * source_size AS need FROM plan),
h1 AS (
  SELECT k.source, k.c1, n.need, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY k.source ORDER BY k.c1) AS upto
  FROM keyed k JOIN needs n ON k.source IS NOT DISTINCT FROM n.source WHERE n.need > 0 GROUP BY k.source, k.c1, n.need),
b1 AS (SELECT source, c1, need - (upto - words) AS need FROM h1 WHERE upto - words < need AND upto >= need),
h2 AS (
  SELECT k.source, k.c1, k.c2, b.need, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY k.source ORDER BY k.c2) AS upto
  FROM keyed k JOIN b1 b ON k.source IS NOT DISTINCT FROM b.source AND k.c1 = b.c1 GROUP BY k.source, k.c1, k.c2, b.need),
b2 AS (
  SELECT source, c1 * 4096 + c2 + (need - (upto - words) >= upto - need)::INT AS bound
  FROM h2 WHERE upto - words < need AND upto >= need)
SELECT k.doc_id, k.size, n.source_size, n.target,
       (k.size * (n.whole + (k.c1 * 4096 + k.c2 < coalesce(b2.bound, 0))::INT))::BIGINT AS taken
FROM keyed k JOIN needs n ON k.source IS NOT DISTINCT FROM n.source LEFT JOIN b2 ON k.source IS NOT DISTINCT FROM b2.source
"""
