"""The evaluation tables that the plans start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.sources.lines import read_codes, write_codes
from glossa.sources.store import dealt, shared

LANGUAGES = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa"}
NEXT = {"eng": "fra", "fra": "deu", "deu": "spa", "spa": "eng"}
#: Sources whose lines count as another script.
OTHER_SCRIPT = ["src1", "src3", "src5", "src7"]
MODELS = ["a", "b", "c"]
#: A table of languages (codes, a single code, family, genus) whose lines list several codes and repeat some.
FAMILIES = [("eng deu", None, "grm", "west"), ("fra;spa, eng", "und", "rom", "italic"), ("deu", "nld", None, "south"), (None, "por", "rom", None)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_idx, y (language and script), script, source, text of every document."""
    docs = documents(spark, sf_dir)
    iso = F.coalesce(F.expr("CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " END"), F.lit("und"))
    script = F.when(F.col("source").isin(OTHER_SCRIPT), "Cyrl").otherwise("Latn")
    return docs.select(F.col("doc_id").alias("line_idx"), F.concat_ws("_", iso, script).alias("y"), script.alias("script"), "source", F.coalesce("text", F.lit("")).alias("text"))


def families(spark: SparkSession) -> DataFrame:
    """iso, family, genus of FAMILIES, written as a file and read again; of a code's lines the first counts."""
    path = shared(spark, "families")
    write_codes(spark.createDataFrame(FAMILIES, "ISO_codes string, ISO639P3code string, Family string, Genus string").coalesce(1), path)
    return read_codes(spark, path)


def _marks(chars: str):
    return F.length(F.regexp_replace("text", f"[^{chars}]", ""))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line: y, script, text_length, n_train (lines of its label) and three systems' predictions (null: empty).

    a counts letters that only one language has, b is the label but for lines picked by hash, c looks for small words.
    """
    lines = labelled(spark, sf_dir)
    fra, spa, deu = _marks("éèêç"), _marks("ñóí"), _marks("üßä")
    iso_a = F.when((fra > spa) & (fra > deu), "fra").when((spa > fra) & (spa > deu), "spa").when((deu > fra) & (deu > spa), "deu").otherwise("eng")
    digit = F.substring(F.md5(F.col("line_idx").cast("string")), 1, 1)
    iso = F.substring_index("y", "_", 1)
    after = F.expr("CASE substring_index(y, '_', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NEXT.items()) + " END")
    iso_b = F.when(digit == "0", after).otherwise(iso)
    script_b = F.when((digit == "2") & (F.col("script") == "Latn"), "Cyrl").otherwise(F.col("script"))
    iso_c = (
        F.when(F.col("text").contains(" the "), "eng").when(F.col("text").contains(" der "), "deu")
        .when(F.col("text").contains(" les "), "fra").when(F.col("text").contains(" el "), "spa")
    )
    lines = lines.select(
        "line_idx", "y", "script", "source", F.length("text").cast("long").alias("text_length"),
        F.concat_ws("_", iso_a, F.col("script")).alias("pred_a"), F.concat_ws("_", iso_b, script_b).alias("pred_b"), F.concat(iso_c, F.lit("_"), F.col("script")).alias("pred_c"),
    )
    counts = lines.groupBy("y").agg(F.count(F.lit(1)).alias("n_train"))  # as many rows as labels
    return lines.join(F.broadcast(counts), "y")


def by_model(rows: DataFrame, *columns: str) -> DataFrame:
    """Unpivot: one row a line and model, with pred."""
    stack = "stack(3, " + ", ".join(f"'{m}', pred_{m}" for m in MODELS) + ") AS (model, pred)"
    return rows.select(*columns, F.expr(stack))


LABELLED_SQL = """lines AS (
  SELECT doc_id AS line_idx, source, coalesce(text, '') AS text,
         CASE WHEN source IN ('src1', 'src3', 'src5', 'src7') THEN 'Cyrl' ELSE 'Latn' END AS script,
         coalesce(CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END, 'und') AS iso,
         iso || '_' || script AS y
  FROM documents)"""
SAMPLE_SQL = (
    "WITH "
    + LABELLED_SQL
    + """, marks AS (
  SELECT *, length(regexp_replace(text, '[^éèêç]', '', 'g')) AS fra, length(regexp_replace(text, '[^ñóí]', '', 'g')) AS spa,
         length(regexp_replace(text, '[^üßä]', '', 'g')) AS deu, substr(md5(line_idx::VARCHAR), 1, 1) AS digit
  FROM lines), preds AS (
  SELECT line_idx, y, script, source, length(text)::BIGINT AS text_length,
         CASE WHEN fra > spa AND fra > deu THEN 'fra' WHEN spa > fra AND spa > deu THEN 'spa' WHEN deu > fra AND deu > spa THEN 'deu' ELSE 'eng' END || '_' || script AS pred_a,
         CASE WHEN digit = '0' THEN CASE iso WHEN 'eng' THEN 'fra' WHEN 'fra' THEN 'deu' WHEN 'deu' THEN 'spa' WHEN 'spa' THEN 'eng' END ELSE iso END
         || '_' || CASE WHEN digit = '2' AND script = 'Latn' THEN 'Cyrl' ELSE script END AS pred_b,
         CASE WHEN contains(text, ' the ') THEN 'eng' WHEN contains(text, ' der ') THEN 'deu' WHEN contains(text, ' les ') THEN 'fra' WHEN contains(text, ' el ') THEN 'spa' END || '_' || script AS pred_c
  FROM marks), s AS (SELECT *, count(*) OVER (PARTITION BY y) AS n_train FROM preds), l AS (
  SELECT * EXCLUDE (pred_a, pred_b, pred_c), 'a' AS model, pred_a AS pred FROM s UNION ALL
  SELECT * EXCLUDE (pred_a, pred_b, pred_c), 'b', pred_b FROM s UNION ALL
  SELECT * EXCLUDE (pred_a, pred_b, pred_c), 'c', pred_c FROM s)"""
)


def classes_sql(keys: str = "model", source: str = "l", name: str = "pc") -> str:
    """CTE with tp, fp, fn, support and the scores of each class, by keys."""
    k = f"{keys}, " if keys else ""
    return f""", {name}_pairs AS (SELECT {k}y, pred, count(*) AS n FROM {source} GROUP BY ALL), {name}_sides AS (
  SELECT {k}y AS label, n AS support, CASE WHEN y = pred THEN n ELSE 0 END AS tp, 0 AS predicted FROM {name}_pairs UNION ALL
  SELECT {k}pred, 0, 0, n FROM {name}_pairs WHERE pred IS NOT NULL), {name}_sums AS (
  SELECT {k}label, sum(support)::BIGINT AS support, sum(tp)::BIGINT AS tp, (sum(predicted) - sum(tp))::BIGINT AS fp, (sum(support) - sum(tp))::BIGINT AS fn FROM {name}_sides GROUP BY ALL), {name} AS (
  SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM {name}_sums)"""


def summary_sql(keys: str = "model", classes: str = "pc") -> str:
    """Select list of accuracy, micro-F1, macro-F1 (true labels) and macro-FPR over a classes CTE, grouped by keys."""
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}sum(support)::BIGINT AS n, round(sum(tp)::DOUBLE / sum(support), 9) AS accuracy,
  round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS micro_f1,
  round(avg(f1) FILTER (WHERE support > 0), 9) AS macro_f1,
  round(avg(fpr) FILTER (WHERE support > 0), 9) AS macro_fpr
FROM (SELECT *, fp::DOUBLE / nullif((sum(support) OVER ({f'PARTITION BY {keys}' if keys else ''})) - support, 0) AS fpr0, coalesce(fpr0, 0) AS fpr FROM {classes})
{f'GROUP BY {keys}' if keys else ''}"""
