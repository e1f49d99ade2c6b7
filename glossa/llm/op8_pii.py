"""Personal data: fixed patterns as seeds, and identifiers found by bootstrapped contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import read, small, written
from glossa.llm.spans import clear_of, count_kind, found, joined

KINDS = ["email", "ip", "card", "phone", "context"]
# The patterns, written so that a long run without a match is read once: a match never begins inside such a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
def candidate(least_chars: int, least_digits: int) -> str:
    """What a context may mark: a maximal run of letters, digits and hyphens of at least so many characters and digits."""
    digits = f"(?=[A-Za-z-]*+(?:[0-9][A-Za-z-]*+){{{least_digits}}})" if least_digits else ""
    return rf"(?<![A-Za-z0-9-]){digits}[A-Za-z0-9-]{{{least_chars},}}+"


NEAR = 64  # code points that are looked at first for a word; where they hold no whole one, all the text is
LETTER, OTHER = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.split(F.reverse(_digits(m)), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return F.length(_digits(m)).between(12, 19) & (total % 10 == 0)


def _parts_fit(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    return F.concat(
        found(text, EMAIL, 0),
        found(text, IP, 1, _parts_fit),
        found(text, CARD, 2, _luhn),
        found(text, PHONE, 3, lambda m: F.length(_digits(m)).between(9, 15)),
    )


def _in_context(text: Column, spans: Column) -> Column:
    """Spans with their own text and their patterns: "<" with the word before and ">" with the word after them (lower case), where there is one."""
    before, after = rf"{OTHER}({LETTER}+){OTHER}*$", rf"^{OTHER}*({LETTER}+){OTHER}"

    def word(near: Column, whole: Column, cut: Column, pattern: str) -> Column:
        found_ = F.regexp_extract(near, pattern, 1)
        return F.lower(F.when(cut & (found_ == ""), F.regexp_extract(whole, pattern, 1)).otherwise(found_))

    def one(s: Column) -> Column:
        left = lambda n: F.concat(F.when(s["start"] <= n, " ").otherwise(""), F.substring(text, F.greatest(s["start"] - n, F.lit(0)) + 1, F.least(s["start"], n)))
        right = lambda n: F.concat(F.substring(text, s["end"] + 1, n), F.when(s["end"] + n >= F.length(text), " ").otherwise(""))
        last = word(left(F.lit(NEAR)), left(s["start"]), s["start"] > NEAR, before)
        next_ = word(right(F.lit(NEAR)), right(F.length(text)), s["end"] + NEAR < F.length(text), after)
        patterns = F.filter(F.array(F.concat(F.lit("<"), last), F.concat(F.lit(">"), next_)), lambda p: F.length(p) > 1)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("token"), patterns.alias("patterns"))

    return F.transform(spans, one)


def score_patterns(edges: DataFrame, occurrences: DataFrame, least_score: float, least_support: int, rounds: int = 3, smoothing: float = 3.0) -> DataFrame:
    """(word: a pattern, score, support) of the graph edges (word, token, seed, n) against the words' counts (word, n_all), for words of at least `least_support`.

    A seed's value is 1, another token's 0 at first. In turn a word's score becomes the values of what it precedes
    over its own occurrences plus `smoothing`, and a token's value the chance that one of its words is right. Tokens
    of value `least_score` or more are seeds of the next round: a word's support counts them, so each round may bring
    in further words. Scores only rise; it ends after `rounds` at least, when a round adds no word, no seed and less
    than a thousandth to the scores' sum.
    """
    edges = written(edges.join(occurrences, "word"), "pii-edges")
    tokens = edges.groupBy("token").agg(F.max("seed").cast("double").alias("value"))
    before, r = None, 0
    while True:
        words = (
            edges.join(tokens, "token").groupBy("word")
            .agg((F.sum(F.col("value") * F.col("n")) / (F.first("n_all") + smoothing)).alias("score"), F.sum((F.col("value") >= least_score).cast("long")).alias("support"))
        )
        words = written(words.filter(F.col("support") >= least_support).withColumn("score", F.least("score", F.lit(0.999))), "pii-words")
        now = words.agg(F.count(F.lit(1)), F.count_if(F.col("score") >= least_score), F.sum("support"), F.round(F.sum("score"), 3)).first()
        r += 1
        if not now[0] or (r >= rounds and now == before):
            return words
        before = now
        miss = F.sum(F.log(1 - F.coalesce("score", F.lit(0.0))))
        tokens = edges.join(words, "word", "left").groupBy("token").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(miss)).alias("value"))
        tokens = written(tokens, "pii-tokens")


def find(docs: DataFrame, least_score: float = 0.5, least_support: int = 5, least_chars: int = 6, least_digits: int = 4) -> DataFrame:
    """doc_id, counts, base_sha256 and spans for each row of docs (doc_id, text).

    Seeds are the base matches. The word before a seed is a lexical pattern, and so is the word after it; those of at
    least `least_support` distinct seeds are scored on the graph of patterns and tokens, with the words' occurrences in
    all texts below the line; what they find counts as seeds in turn, until no score rises. Candidates in a pattern of
    at least `least_score` that overlap no base span are spans of kind context. A candidate is a run of letters, digits
    and hyphens with `least_chars` of them and `least_digits` digits: with 4 digits numbers and codes are looked at,
    with none user names and other words too, at the cost of a row for every such word of the texts.
    Null and empty texts have no spans; repeated rows stay; null ids are a key like another.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select("doc_id", text.alias("text"), base_spans(text).alias("base"), found(text, candidate(least_chars, least_digits), 4).alias("more"))
    spans = spans.withColumn("more", clear_of(F.col("more"), F.col("base")))
    spans = written(spans.select("doc_id", F.md5("text").alias("text_key"), "base", _in_context(F.col("text"), F.col("base")).alias("seeds"), _in_context(F.col("text"), F.col("more")).alias("more")), "pii-spans")

    seeds = spans.select(F.explode("seeds").alias("s"), F.lit(True).alias("seed"))
    others = spans.select(F.explode("more").alias("s"), F.lit(False).alias("seed"))
    edges = seeds.union(others).select(F.explode("s.patterns").alias("word"), "s.token", "seed").groupBy("word", "token").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    edges = written(edges, "pii-pairs")
    # no round gives a word more support than it has tokens
    frequent = edges.groupBy("word").agg(F.count(F.lit(1)).alias("most")).filter(F.col("most") >= least_support).select("word")
    frequent = written(frequent, "pii-frequent")
    words = docs.select(F.explode(F.split(F.lower(F.col("text")), OTHER + "+")).alias("w"))
    plain = frequent.select(F.substr("word", F.lit(2)).alias("w")).distinct()
    occurrences = words.join(small(plain), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("n_all"))
    occurrences = occurrences.select(F.explode(F.array(F.concat(F.lit("<"), "w"), F.concat(F.lit(">"), "w"))).alias("word"), "n_all")
    occurrences = written(occurrences, "pii-occurrences")
    good = score_patterns(edges, occurrences, least_score, least_support).filter(F.col("score") >= least_score).select("word")

    hits = (
        spans.select("doc_id", "text_key", F.explode("more").alias("s")).select("doc_id", "text_key", "s", F.explode("s.patterns").alias("word")).join(small(good), "word", "left_semi")
        .groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t"))
        .agg(F.collect_set(F.struct(F.col("s.start").alias("start"), F.lit(4).alias("kind"), F.col("s.end").alias("end"))).alias("extra"))
    )
    out = spans.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    return out.select(
        "doc_id",
        *(count_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra")), KINDS).alias("spans"),
    )


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find(read(spark, sf_dir, "documents"))
