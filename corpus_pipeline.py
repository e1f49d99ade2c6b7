"""The corpus pipeline: five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import small, written
from glossa.llm.op1_mixing import mix
from glossa.llm.op2_jaccard import jaccard_join, text_key
from glossa.llm.op5_decontamination import contaminated
from glossa.llm.op6_quality import score
from glossa.llm.op9_sharding import shard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier predicts as 1.

    Null and empty texts are scored like others by their statistics (all 0); rows without an id are scored too; equal
    texts share a verdict; repeated rows stay as often as they are. Columns besides those of documents are left out;
    an empty table gives an empty one, and without labels every row stays.
    """
    verdicts = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=tuple(COLUMNS))
    return verdicts.filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of smallest doc_id (none last), of these that of smallest text hash, once.

    A document is an id with a text, so other texts of a dropped document's id stay. All rows without words stay, as
    they link with nothing. An empty table gives an empty one; columns besides those of documents are left out.
    """
    classes = written(jaccard_join(docs).filter("n_shingles > 0"), "pipeline-classes")
    first = classes.groupBy("class_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.filter("n > 1").drop("n"), "pipeline-first")  # a row alone in its class stays, and needs no look
    rows = classes.join(small(first, 1_000_000), "class_id").groupBy("class_id", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("count"), F.first("first").alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    # rows to drop or to take once; the others needn't be looked at
    marked = written(rows.filter(~kept | (F.col("count") > 1)).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), kept.alias("once")), "pipeline-copies")
    same = (text_key() == F.col("k")) & F.col("doc_id").cast("long").eqNullSafe(F.col("d"))
    found = docs.select(*COLUMNS).join(small(marked, 1_000_000), same, "left")  # three values a row
    once = found.filter("once").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return found.filter("once is null").select(*COLUMNS).unionByName(once)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark passage is found.

    Only a leaking text goes: other texts of its id stay, and so do null and empty texts. Ids may be null; repeated
    rows share their fate. Empty tables of either kind leave all rows; columns besides those of documents are left out.
    """
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = written(found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct(), "pipeline-leaks")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.md5("text") == F.col("k"))
    return docs.join(small(leaks, 1_000_000), same, "left_anti").select(*COLUMNS)


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times).

    Texts without words count for nothing and are left out; null sources are one source; rows without an id are drawn
    by their text; repeated rows share their fate. An empty table gives an empty one; columns besides those of
    documents are left out.
    """
    mixed = mix(docs, keep=tuple(COLUMNS)).filter("repeats > 0")
    return mixed.withColumn("nth", F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select(*COLUMNS)


def shards(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row.

    Equal texts share a shard, null texts too; repeated rows and rows without an id have slots of their own. An empty
    table gives an empty result.
    """
    return shard(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("shards", shards)]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# A fitted classifier, SimHash and differencing aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None
