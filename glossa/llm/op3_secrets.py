"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import read, written
from glossa.llm.spans import clear_of, count_kind, found, joined

KINDS = ["assign", "access", "hex", "model"]
# The patterns of the base kinds.
KEYWORD = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = KEYWORD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
# Words of ordinary identifiers.
PARTS = (
    "get set user name file path data list item index count value key map node tree page test main config option client server request "
    "response error handler manager service factory builder parser reader writer stream buffer cache queue table column row group total "
    "version build release image asset style module package import export update delete create select start end time date first last"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(is_random, token): n random strings (base 64, letters alone, hex, upper case) and n identifiers (joined from words and numbers, product names, UUIDs)."""
    ids = spark.range(n)
    code = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(code)), "=", "")
    random = F.element_at(F.array(base64, F.regexp_replace(base64, "[+/]", "x"), F.substring(code, 1, 40), F.upper(F.conv(F.substring(code, 1, 15), 16, 36)), F.concat(F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", ""))), F.regexp_replace(base64, "[^A-Za-z]", "")), (F.col("id") % 6 + 1).cast("int"))
    parts = F.array(*map(F.lit, PARTS))
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit("number")), F.lit(3000)).cast("string")
    words = [part(k) for k in range(4)]
    plain = F.element_at(
        F.array(
            F.concat_ws("_", *words, number), F.concat(words[0], *map(F.initcap, words[1:]), number), F.concat_ws("-", *words, number),
            F.concat_ws("/", *words[:3], number, words[3]), F.upper(F.concat_ws("_", *words, number)), F.concat(*words, number),
            F.concat(F.lit("i"), F.initcap(words[0]), number, F.initcap(words[1]), F.initcap(words[2]), F.element_at(F.array(*map(F.lit, ("8GB", "64GB", "256GB", "4K", "XL", "v2"))), (F.col("id") % 5 + 1).cast("int"))),
            F.concat_ws("-", *(F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        ),
        (F.col("id") % 8 + 1).cast("int"),
    )
    return ids.select(F.lit(True).alias("is_random"), random.alias("token")).union(ids.select(F.lit(False).alias("is_random"), plain.alias("token")))


def candidate(least_chars: int) -> str:
    """The pattern of what the model looks at: a maximal run of at least so many characters with a letter."""
    return rf"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{{least_chars},}}+"


def samples_of(docs: DataFrame) -> DataFrame:
    """(is_random, token) from all texts: what the base patterns mark as secret, and the other runs of 8 characters or
    more, which are ordinary."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ((KEYWORD + "([A-Za-z0-9+/_.=-]{6,})", 1), (ACCESS, 0), (HEX, 0))))
    rest = F.regexp_extract_all(F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|{HEX}", " "), F.lit("[A-Za-z0-9+/_=-]{8,}"), F.lit(0))
    labelled = lambda random: lambda t: F.struct(F.lit(random).alias("is_random"), t.alias("token"))
    return docs.select(F.inline(F.concat(F.transform(marked, labelled(True)), F.transform(rest, labelled(False)))))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the two models' probabilities of each character pair, first character major (add-one-half smoothing).

    samples has (is_random, token); only the counts by pair, at most 2 * 67 * 67 rows, come to the driver.
    """
    chars = F.filter(F.split("token", ""), lambda c: F.lit(ALPHABET).contains(c) & (c != ""))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("chars") - 1, F.lit(1))), lambda i: F.concat(F.get("chars", i - 1), F.get("chars", i)))
    counts = samples.select("is_random", chars.alias("chars")).select("is_random", F.explode(pairs).alias("pair")).filter(F.length("pair") == 2)
    k = len(ALPHABET)
    seen = [[0.5] * (k * k), [0.5] * (k * k)]
    for random, pair, n in counts.groupBy("is_random", "pair").count().collect():
        seen[random][ALPHABET.index(pair[0]) * k + ALPHABET.index(pair[1])] += n
    rows = [[sum(s[i * k : i * k + k]) for i in range(k)] for s in seen]
    return [math.log(seen[1][i] / rows[1][i // k]) - math.log(seen[0][i] / rows[0][i // k]) for i in range(k * k)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token's character pairs: how much likelier it is under the random strings' model. Each pair adds its own, so a long token says more than a short one."""
    k = len(ALPHABET)
    table = F.lit(model)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    first = F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0)))
    second = F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0)))
    ratios = F.zip_with(first, second, lambda a, b: F.get(table, a * k + b))
    return F.aggregate(ratios, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def threshold(made: DataFrame, texts: DataFrame, model: list[float], share: float = 0.99, least: float = 9.0) -> float:
    """The ratio that `share` of the made identifiers stay under, and `share` of the texts' ordinary runs; at least
    `least`, odds of 8,000 to 1, as secrets are rare. A secret among the runs that no base pattern marks moves it little.

    Ratios are counted by hundredths, so the percentile is one of all runs and doesn't depend on their order."""
    ordinary = made.select("is_random", "token", F.lit(True).alias("made")).union(texts.select("is_random", "token", F.lit(False).alias("made"))).filter("NOT is_random")
    counts = ordinary.groupBy("made", F.round(log_ratio(F.col("token"), model), 2).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    highs = counts.groupBy("made").agg(F.percentile("r", share, F.col("n")).alias("r"))
    return max([least, *(r["r"] for r in highs.collect())])


def scan(docs: DataFrame, model: list[float], least: float, least_chars: int = 12) -> DataFrame:
    """doc_id, counts, base_sha256 and spans for each row of docs (doc_id, text), in one pass without a shuffle.

    Base spans come from the patterns; a run of `least_chars` or more with a letter whose log ratio is above `least`
    and that overlaps no base span is a span of kind model. The ratio adds up over a run's pairs, so shorter runs could
    hardly reach it and aren't looked at. Null and empty texts have no spans (base_sha256 is that of the empty string);
    rows are independent, so repeated rows and null ids stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        found(text, ASSIGN, 0, lambda m: F.length(F.regexp_replace(m, "^" + KEYWORD, "")) >= 6),
        found(text, ACCESS, 1),
        found(text, HEX, 2),
    )
    likely = found(text, candidate(least_chars), 3, lambda m: log_ratio(m, model) > least)
    spans = docs.select("doc_id", base.alias("base"), likely.alias("likely"))
    return spans.select(
        "doc_id",
        *(count_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.concat("base", clear_of(F.col("likely"), F.col("base"))), KINDS).alias("spans"),
    )


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by models and a threshold of made samples and of all runs of the texts."""
    docs = read(spark, sf_dir, "documents")
    made, texts = labelled_samples(spark), written(samples_of(docs), "secret-samples")
    model = train(made.union(texts))
    return scan(docs, model, threshold(made, texts, model))
