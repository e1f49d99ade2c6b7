"""Reports as CSV, Markdown and LaTeX files, written once for each content."""

from __future__ import annotations

import csv
import hashlib
import io
import json

from pyspark.sql import DataFrame, SparkSession

from glossa.functions.render import to_latex, to_markdown

MOST = 1000  # rows of a report, which is meant to be read
FORMATS = ("csv", "markdown", "latex")


def to_csv(df: DataFrame, most: int = MOST) -> str:
    """A header and at most `most` rows; null is an empty field, an empty string a quoted one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_NOTNULL, lineterminator="\n")
    writer.writerows([df.columns, *(list(r) for r in rows)])
    return out.getvalue()


def _read(spark: SparkSession, path: str) -> str | None:
    """The one text of a folder; None where there is none."""
    try:
        found = spark.read.text(path, wholetext=True).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return found[0][0] if found else None


def _write(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, name: str, caption: str, formats: tuple[str, ...] = FORMATS) -> list[str]:
    """Writes df, ordered by the caller, below path/name/<digest> in each format and returns those that it wrote.

    The digest is of the rows and the caption: an equal report is written once, a changed one stands beside the old.
    A format's mark is written after its file, so one that a broken run left half done is written again.
    """
    spark = df.sparkSession
    text = to_csv(df)
    digest = hashlib.sha256(json.dumps([caption, text]).encode()).hexdigest()
    made = []
    for form in formats:
        target = f"{path}/{name}/{digest[:16]}/{form}"
        if (_read(spark, f"{target}-done") or "").strip() == digest:
            continue
        body = {"csv": lambda: text, "markdown": lambda: to_markdown(df, caption), "latex": lambda: to_latex(df, caption, f"tab:{name}")}[form]()
        _write(spark, body, target)
        _write(spark, digest, f"{target}-done")
        made.append(form)
    return made


def read_report(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of all of a report's versions, with the digest of each."""
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(f"{path}/{name}/*/csv")
    return rows.selectExpr("*", "regexp_extract(_metadata.file_path, '/([0-9a-f]{16})/csv/', 1) AS digest")
