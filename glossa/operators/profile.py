"""Corpus profiling: domains, scripts, lengths, entropies and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns and terms of the domains.
VERSE = r"\b\d{1,3}:\d{1,3}\b"
WIKI = r"={2,}[^=]+=+|\[\[|\[\d+\]"
RELIGIOUS = (
    "yehuwa jehova jehovah watchtower jw.org genesis exodus leviticus deuteronomy psalms proverbs isaiah jeremiah ezekiel matthew matayo yohana "
    "revelation bible scripture gospel apostle psalm salmo biblia evangel"
).split()
# Code point ranges of scripts, as character classes.
SCRIPTS = {
    "Latin": r"\x{0041}-\x{024F}\x{1E00}-\x{1EFF}", "Cyrillic": r"\x{0400}-\x{052F}", "Greek": r"\x{0370}-\x{03FF}", "Arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}",
    "Hebrew": r"\x{0590}-\x{05FF}", "Armenian": r"\x{0530}-\x{058F}", "Devanagari": r"\x{0900}-\x{097F}", "Bengali": r"\x{0980}-\x{09FF}", "Gujarati": r"\x{0A80}-\x{0AFF}",
    "Oriya": r"\x{0B00}-\x{0B7F}", "Tamil": r"\x{0B80}-\x{0BFF}", "Telugu": r"\x{0C00}-\x{0C7F}", "Kannada": r"\x{0C80}-\x{0CFF}", "Malayalam": r"\x{0D00}-\x{0D7F}",
    "Sinhala": r"\x{0D80}-\x{0DFF}", "Thai": r"\x{0E00}-\x{0E7F}", "Lao": r"\x{0E80}-\x{0EFF}", "Tibetan": r"\x{0F00}-\x{0FFF}", "Myanmar": r"\x{1000}-\x{109F}",
    "Georgian": r"\x{10A0}-\x{10FF}", "Hangul": r"\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}", "Ethiopic": r"\x{1200}-\x{137F}", "Khmer": r"\x{1780}-\x{17FF}", "Thaana": r"\x{0780}-\x{07BF}",
    "Hiragana": r"\x{3040}-\x{309F}", "Katakana": r"\x{30A0}-\x{30FF}", "Bopomofo": r"\x{3100}-\x{312F}", "Han": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}",
    "Javanese": r"\x{A980}-\x{A9DF}", "Syloti_Nagri": r"\x{A800}-\x{A82F}", "Lisu": r"\x{A4D0}-\x{A4FF}", "Tifinagh": r"\x{2D30}-\x{2D7F}",
}


def classify_domain(text: Column) -> Column:
    """religious, wikipedia or other."""
    terms = "(?i)" + "|".join(t.replace(".", r"\.") for t in RELIGIOUS)
    return F.when(text.rlike(VERSE) | text.rlike(terms), "religious").when(text.rlike(WIKI), "wikipedia").otherwise("other")


def script_count(text: Column, script: str) -> Column:
    """Characters of a script: the length that is left without the others."""
    return F.length(F.regexp_replace(text, f"[^{SCRIPTS[script]}]+", "")).cast("long")


LATIN_ALONE = r"\x{0000}-\x{024F}"  # code points that no script of the table but Latin has


def detect_script(text: Column) -> Column:
    """Map of script to characters, for the scripts that occur; those beside Latin are looked for in what is left without LATIN_ALONE."""
    def of(rest: Column) -> Column:
        pairs = F.array(*(F.struct(F.lit(s).alias("script"), script_count(text if s == "Latin" else rest, s).alias("n")) for s in SCRIPTS))
        return F.map_from_entries(F.filter(pairs, lambda p: p["n"] > 0))

    return F.transform(F.array(F.regexp_replace(text, f"[{LATIN_ALONE}]+", "")), of)[0]


def script_totals(counts: DataFrame, *by: str) -> DataFrame:
    """(by, script, n) of counts (by, token, n) of code points: a token is looked at once, however often it stands in the texts."""
    each = counts.select(*by, "n", F.explode(detect_script(F.col("token"))).alias("script", "k"))
    return each.groupBy(*by, "script").agg(F.sum(F.col("n") * F.col("k")).alias("n"))


def length_stats(lines: DataFrame, *by: str) -> DataFrame:
    """n, mean and population deviation of the lengths (0 under two lines)."""
    size = F.length("text")
    return lines.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean_length"), F.coalesce(F.stddev_pop(size), F.lit(0.0)).alias("std_length"))


def char_entropy(counts: DataFrame, *by: str) -> DataFrame:
    """Entropy in bits of the characters: log2 N - sum n log2 n / N, from the counts alone."""
    n = F.sum("n")
    return counts.groupBy(*by).agg((F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("entropy"))


REGISTERS = 12  # bits of a register's number


def registers(words: DataFrame, *by: str) -> DataFrame:
    """(by, register, rank): a mergeable sketch of the distinct words of (by, word), one row a register that is set.

    The lowest bits of a word's md5 name its register, the 64 bits above them give its rank, one more than their
    leading zeros; a register keeps the greatest. At most 2^12 rows a group, whatever the number of words.
    """
    digest = F.md5(F.encode("word", "UTF-8"))
    low = F.conv(F.substring(digest, 32 - REGISTERS // 4 + 1, REGISTERS // 4), 16, 10).cast("int")
    bits = F.substring(digest, 32 - REGISTERS // 4 - 16 + 1, 16)
    zeros = F.length(F.regexp_extract(bits, "^0*", 0))
    digit = F.conv(F.substring(bits, zeros + 1, F.lit(1)), 16, 10).cast("int")  # the first that isn't 0
    rank = F.when(zeros == 16, 65).otherwise(4 * zeros + 5 - F.length(F.bin(digit.cast("long"))))
    return words.select(*by, low.alias("register"), rank.cast("int").alias("rank")).groupBy(*by, "register").agg(F.max("rank").alias("rank"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketch of the union of what several sketches, stacked, have seen."""
    return sketches.groupBy(*by, "register").agg(F.max("rank").alias("rank"))


def estimate(sketch: DataFrame, *by: str) -> DataFrame:
    """(by, words): the number of distinct words by a sketch, with linear counting while registers are empty."""
    m = float(1 << REGISTERS)
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = sketch.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("inverse"), (m - F.count(F.lit(1))).alias("empty"))
    raw = alpha * m * m / (F.col("inverse") + F.col("empty"))
    linear = m * F.log(m / F.col("empty"))
    return sums.select(*by, F.floor(F.when((raw <= 2.5 * m) & (F.col("empty") > 0), linear).otherwise(raw)).cast("long").alias("words"))


def register(spark: SparkSession) -> None:
    """Makes `classify_domain(text)` and `detect_script(text)` functions of the session's SQL; both are plain expressions that Catalyst inlines."""
    terms = "(?i)" + "|".join(t.replace(".", r"\.") for t in RELIGIOUS)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION classify_domain(t STRING) RETURNS STRING RETURN "
        f"CASE WHEN t RLIKE r'{VERSE}' OR t RLIKE r'{terms}' THEN 'religious' WHEN t RLIKE r'{WIKI}' THEN 'wikipedia' ELSE 'other' END"
    )
    counts = ", ".join(f"named_struct('script', '{s}', 'n', CAST(length(regexp_replace({'t' if s == 'Latin' else 'rest'}, r'[^{chars}]+', '')) AS BIGINT))" for s, chars in SCRIPTS.items())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION detect_script(t STRING) RETURNS MAP<STRING, BIGINT> RETURN "
        f"transform(array(regexp_replace(t, r'[{LATIN_ALONE}]+', '')), rest -> map_from_entries(filter(array({counts}), p -> p.n > 0)))[0]"
    )
