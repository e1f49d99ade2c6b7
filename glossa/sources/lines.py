"""Readers and writers of labelled lines, benchmarks, predictions and models."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "__label__"
_WEB = {"sep": "\t", "header": True, "quote": "", "escape": "\u0000", "emptyValue": "", "nullValue": "\u0000"}


def _parse(value: Column) -> tuple[Column, Column]:
    at = F.instr(value, " ")
    label = F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value)
    text = F.when(at > 0, F.substring(value, at + 1, F.length(value))).otherwise("")
    return F.replace(label, F.lit(PREFIX), F.lit("")), text


def read_labelled(spark: SparkSession, path: str, train: bool = False) -> DataFrame:
    """label, text of lines "__label__x text", split at the first space; train: lines without the prefix are left out."""
    lines = spark.read.text(path)
    if train:
        lines = lines.filter(F.col("value").startswith(PREFIX))
    label, text = _parse(F.col("value"))
    return lines.select(label.alias("label"), text.alias("text"))


def write_labelled(lines: DataFrame, path: str) -> None:
    """Lines (y, text) in that form; line ends in a text become spaces."""
    lines.select(F.concat(F.lit(PREFIX), "y", F.lit(" "), F.regexp_replace("text", r"[\r\n]", " "))).write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, path: str, first: str = "label", second: str = "text") -> DataFrame:
    """Two columns split at the first tab; quotes and later tabs belong to the second."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].alias(first), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias(second))


def unknown_labels(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Labels of rows that the list lacks."""
    return rows.select("label").distinct().join(known, "label", "left_anti")


_TABLE = {"header": True, "quote": '"', "escape": '"', "multiLine": False}


def write_codes(rows: DataFrame, path: str) -> None:
    """A table (ISO_codes, ISO639P3code, Family, Genus) as CSV with a header."""
    rows.select("ISO_codes", "ISO639P3code", "Family", "Genus").write.mode("overwrite").options(**_TABLE).csv(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """iso, family, genus of such a table, whose first column may list several codes between spaces, commas or semicolons.

    Of a code's lines the first that has a family gives that, and the first that has a genus that. First is by file
    name, place of the part in the file and line, whichever task reads it. A table without any family is an error.
    """
    schema = "ISO_codes string, ISO639P3code string, Family string, Genus string"
    rows = spark.read.options(**_TABLE).schema(schema).csv(path).withColumn("_n", F.monotonically_increasing_id())
    rows = rows.withColumn("at", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("_n").alias("n")))
    codes = F.array_distinct(F.concat(F.split(F.coalesce("ISO_codes", F.lit("")), "[ ;,]+"), F.array(F.coalesce("ISO639P3code", F.lit("")))))
    each = rows.select("at", F.explode(codes).alias("iso"), "Family", "Genus").filter("iso <> ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("at")))
    out = each.groupBy("iso").agg(first("Family").alias("family"), first("Genus").alias("genus")).filter("family IS NOT NULL OR genus IS NOT NULL")
    if out.filter("family IS NOT NULL").isEmpty():
        raise ValueError(f"no family in {path}")
    return out


def import_predictions(lines: DataFrame, predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """lines (line_idx) with the label of predictions (line_idx, pred); an unknown label, a line without prediction, a
    repeated or a surplus one raises when the result is read."""
    known = predictions.join(F.broadcast(labels.select(F.col("label").alias("pred"), F.lit(True).alias("ok"))), "pred", "left")
    one = known.groupBy("line_idx").agg(F.first("pred").alias("pred"), F.first("ok").alias("ok"), F.count(F.lit(1)).alias("n"))
    both = lines.withColumn("here", F.lit(True)).join(one, "line_idx", "full")
    wrong = F.when(F.col("here").isNull(), "a prediction has no line").when(F.col("n").isNull(), "a line has no prediction").when(F.col("n") > 1, "a line has two predictions").when(F.col("ok").isNull(), "a label is unknown")
    return both.filter(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True)).drop("here", "n", "ok")


def save_model(model: DataFrame, path: str, labels: int, tokens: int) -> None:
    """Writes a model (y, token, w); refuses another shape, weights that aren't finite, and a path that exists."""
    found = model.agg(F.count_distinct("y"), F.count_distinct("token"), F.count(F.lit(1)), F.count_if(F.isnan("w") | F.col("w").isNull() | F.col("w").isin(float("inf"), float("-inf")))).first()
    if tuple(found[:2]) != (labels, tokens) or found[2] != labels * tokens:
        raise ValueError(f"the model has {found[0]} labels, {found[1]} tokens and {found[2]} weights")
    if found[3]:
        raise ValueError(f"{found[3]} weights aren't finite")
    model.write.mode("errorifexists").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_web(rows: DataFrame, path: str) -> None:
    """Rows (text, tag) as gzipped lines with a header; tabs and line ends in a text become spaces."""
    clean = rows.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\r\n]", " ").alias("text"), "tag")
    clean.write.mode("overwrite").options(**_WEB, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression="gzip").csv(path)


def read_web(spark: SparkSession, path: str) -> DataFrame:
    """label, text of a table with a header whose columns are text and tag, gzipped or not; quotes belong to the text."""
    rows = spark.read.options(**_WEB).schema("text string, tag string").csv(path)
    return rows.select(F.trim("tag").alias("label"), F.coalesce("text", F.lit("")).alias("text"))


def read_macros(spark: SparkSession, path: str) -> DataFrame:
    """member, macro of a table with a header and the columns macro, member; the last line of a member wins."""
    rows = spark.read.options(**_WEB).schema("macro string, member string").csv(path).withColumn("at", F.monotonically_increasing_id())
    return rows.filter("member is not null").groupBy("member").agg(F.max_by("macro", "at").alias("macro"))


def code_commit() -> str | None:
    """The commit of the code's folder; None where it isn't a checkout."""
    try:
        out = subprocess.run(["git", "rev-parse", "HEAD"], cwd=os.path.dirname(__file__), capture_output=True, text=True, timeout=10)
    except OSError:
        return None
    return out.stdout.strip() or None


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of each file, hashed where it is read, and the commit of the code."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), F.lit(code_commit()).cast("string").alias("commit"))


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path; None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def write_chunks(rows: DataFrame, path: str, chunk: str, config: dict) -> list:
    """Writes rows by chunk below path, only those chunks that aren't there yet, and returns their ids.

    The configuration's digest is a column of the path: another configuration never mixes with what was written.
    """
    import hashlib

    spark = rows.sparkSession
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    target = f"{path}/config={digest}"
    there = written(spark, target)
    done = [] if there is None else [r[0] for r in there.select(chunk).distinct().collect()]
    todo = [r[0] for r in rows.select(chunk).distinct().collect() if r[0] not in done]
    if todo:
        rows.filter(F.col(chunk).isin(todo)).write.mode("append").partitionBy(chunk).parquet(target)
    return sorted(todo)
