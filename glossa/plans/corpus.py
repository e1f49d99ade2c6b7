"""Profiling and sampling plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.operators import metrics as m
from glossa.operators import profile as pf
from glossa.operators import sampling as sp
from glossa.plans.evaluation import RARE, RESOURCE_SQL, WIDE_SQL, long, scores, wide_f1
from glossa.plans.modelling import MODEL_SQL, counts
from glossa.plans.registry import query
from glossa.plans.tables import LABELLED_SQL, MODELS, SAMPLE_SQL, classes_sql, families, labelled, sample
from glossa.sources.reports import FORMATS, read_report, write_report
from glossa.sources.store import shared

LINES = "WITH " + LABELLED_SQL
TOLERANCE = 0.005  # between a published macro-F1 and the one found
TERMS = "|".join(t.replace(".", r"\.") for t in pf.RELIGIOUS)
DOMAIN_SQL = rf"CASE WHEN regexp_matches(text, '\b\d{{1,3}}:\d{{1,3}}\b') OR regexp_matches(text, '(?i){TERMS}') THEN 'religious' WHEN regexp_matches(text, '={{2,}}[^=]+=+|\[\[|\[\d+\]') THEN 'wikipedia' ELSE 'other' END"


def r6(c):
    return F.round(c, 6)


@query(LINES + f" SELECT {DOMAIN_SQL} AS domain, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM lines GROUP BY domain")
def domain_overall(spark, sf_dir):
    """Lines by domain."""
    rows = labelled(spark, sf_dir).groupBy(pf.classify_domain(F.col("text")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("WITH t AS (SELECT url, coalesce(html, '') AS text FROM pages) SELECT " + DOMAIN_SQL + " AS domain, count(*) AS n FROM t GROUP BY domain")
def domain_pages(spark, sf_dir):
    """Pages by domain of their source text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.coalesce("html", F.lit("")).alias("text"))
    return pages.groupBy(pf.classify_domain(F.col("text")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query(LINES + f", t AS (SELECT y, {DOMAIN_SQL} AS domain, count(*) OVER (PARTITION BY y) AS n_train FROM lines) SELECT {RESOURCE_SQL} AS bin, count(*) FILTER (WHERE domain = 'religious') AS religious, count(*) FILTER (WHERE domain = 'wikipedia') AS wikipedia, count(*) FILTER (WHERE domain = 'other') AS other FROM t GROUP BY bin")
def domain_by_resource(spark, sf_dir):
    """Domains as columns by bin of lines."""
    by_label = labelled(spark, sf_dir).groupBy("y", pf.classify_domain(F.col("text")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("y"))
    rows = by_label.withColumn("bin", m.resource_bin(total)).groupBy("bin").pivot("domain", ["religious", "wikipedia", "other"]).agg(F.sum("n"))
    return rows.na.fill(0)


LATIN_SQL, CYRILLIC_SQL = r"length(regexp_replace(text, '[^\x{0041}-\x{024F}\x{1E00}-\x{1EFF}]', '', 'g'))", r"length(regexp_replace(text, '[^\x{0400}-\x{052F}]', '', 'g'))"


@query(
    LINES + ", c AS (SELECT y, unnest([" + ", ".join(f"{{'script': '{name}', 'n': length(regexp_replace(text, '[^{chars}]', '', 'g'))}}" for name, chars in pf.SCRIPTS.items()) + "]) AS c FROM lines) SELECT y, c.script AS script, sum(c.n)::BIGINT AS n FROM c WHERE c.n > 0 GROUP BY ALL"
)
def script_table(spark, sf_dir):
    """Characters of every script of the table, by label; scripts that don't occur have no row."""
    return pf.script_totals(counts(spark, sf_dir), "y")


@query(
    LINES + ", d AS (SELECT CASE WHEN regexp_matches(text, '" + pf.VERSE + "') OR regexp_matches(text, '(?i)" + "|".join(t.replace(".", r"\.") for t in pf.RELIGIOUS) + "') THEN 'religious' WHEN regexp_matches(text, '" + pf.WIKI + "') THEN 'wikipedia' ELSE 'other' END AS domain,"
    f" {LATIN_SQL} AS latin FROM lines) SELECT domain, count(*) AS n, sum(latin)::BIGINT AS latin FROM d GROUP BY domain"
)
def registered_functions(spark, sf_dir):
    """2.11: `classify_domain` and `detect_script` as functions of Spark SQL."""
    pf.register(spark)
    return spark.sql(
        "SELECT classify_domain(text) AS domain, count(*) AS n, sum(coalesce(detect_script(text)['Latin'], 0)) AS latin FROM {lines} GROUP BY 1",
        lines=labelled(spark, sf_dir),
    )


@query(LINES + f" SELECT y, sum({LATIN_SQL})::BIGINT AS latin, sum({CYRILLIC_SQL})::BIGINT AS cyrillic, sum(length(text))::BIGINT AS chars FROM lines GROUP BY y")
def script_characters(spark, sf_dir):
    """Characters by code point ranges of scripts (punctuation between Z and a counts as Latin)."""
    t = F.col("text")
    return labelled(spark, sf_dir).groupBy("y").agg(F.sum(pf.script_count(t, "Latin")).alias("latin"), F.sum(pf.script_count(t, "Cyrillic")).alias("cyrillic"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(LINES + " SELECT y, count(*) AS n, round(avg(length(text)), 6) AS mean_length, round(stddev_pop(length(text)), 6) AS std_length FROM lines GROUP BY y")
def length_statistics(spark, sf_dir):
    """Number, mean and deviation of lengths."""
    return pf.length_stats(labelled(spark, sf_dir), "y").select("y", "n", r6("mean_length").alias("mean_length"), r6("std_length").alias("std_length"))


@query(MODEL_SQL + " SELECT y, round(-sum(n::DOUBLE / total * log2(n::DOUBLE / total)), 6) AS entropy FROM m WHERE n > 0 GROUP BY y")
def character_entropy(spark, sf_dir):
    """Entropy of characters in bits."""
    return pf.char_entropy(counts(spark, sf_dir), "y").select("y", r6("entropy").alias("entropy"))


WORDS_SQL = LINES + r", words AS (SELECT y, unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM lines)"


@query(WORDS_SQL + " SELECT y, count(DISTINCT word) AS words FROM words WHERE word <> '' GROUP BY y")
def vocabulary_exact(spark, sf_dir):
    """P5: distinct words of each label; distinct by (label, word) first, so that no label is gathered."""
    words = labelled(spark, sf_dir).select("y", F.explode(F.split("text", r"[ \t\n\r\f]+")).alias("word")).filter("word <> ''")
    return words.distinct().groupBy("y").agg(F.count(F.lit(1)).alias("words"))


SKETCH_SQL = (
    WORDS_SQL + f""", hashed AS (SELECT y, md5(word) AS h FROM words WHERE word <> ''), bits AS (SELECT y, ('0x' || substr(h, 30, 3))::INT AS register, substr(h, 14, 16) AS b FROM hashed),
  zeros AS (SELECT y, register, b, length(regexp_extract(b, '^0*')) AS z FROM bits),
  regs AS (SELECT y, register, max(CASE WHEN z = 16 THEN 65 ELSE 4 * z + CASE WHEN substr(b, z + 1, 1) = '1' THEN 4 WHEN substr(b, z + 1, 1) IN ('2', '3') THEN 3 WHEN substr(b, z + 1, 1) IN ('4', '5', '6', '7') THEN 2 ELSE 1 END END) AS rank FROM zeros GROUP BY y, register),
  est AS (SELECT y, 4096 - count(*) AS empty, (0.7213::DOUBLE / (1 + 1.079::DOUBLE / 4096)) * 4096.0::DOUBLE * 4096.0::DOUBLE / (sum(pow(2.0::DOUBLE, -rank)) + 4096 - count(*)) AS raw FROM regs GROUP BY y)"""
)


@query(SKETCH_SQL + " SELECT y, floor(CASE WHEN raw <= 2.5 * 4096 AND empty > 0 THEN 4096 * ln(4096.0::DOUBLE / empty) ELSE raw END)::BIGINT AS words FROM est")
def vocabulary_sketch(spark, sf_dir):
    """P5: distinct words of each label by a mergeable sketch of 2^12 md5 registers; sketches of two halves of the lines are merged."""
    words = labelled(spark, sf_dir).select("y", "line_idx", F.explode(F.split("text", r"[ \t\n\r\f]+")).alias("word")).filter("word <> ''")
    halves = pf.registers(words.withColumn("half", F.col("line_idx") % 2), "half", "y")
    return pf.estimate(pf.merged(halves, "y"), "y")


@query(
    MODEL_SQL + ", q AS (SELECT y, any_value(n_lines) AS n_train, -sum(n::DOUBLE / total * log2(n::DOUBLE / total)) AS entropy, any_value(total)::DOUBLE / any_value(n_lines) AS len FROM m WHERE n > 0 GROUP BY y)"
    f" SELECT {RESOURCE_SQL} AS bin, count(*) AS labels, round(avg(entropy), 6) AS entropy, round(avg(len), 6) AS mean_length FROM q GROUP BY bin"
)
def quality_by_resource(spark, sf_dir):
    """Unweighted means over the labels of each bin."""
    rows = pf.char_entropy(counts(spark, sf_dir), "y").join(pf.length_stats(labelled(spark, sf_dir), "y"), "y")
    return rows.groupBy(m.resource_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("labels"), r6(F.avg("entropy")).alias("entropy"), r6(F.avg("mean_length")).alias("mean_length"))


@query(
    LINES + f", c AS (SELECT y, script, sum({LATIN_SQL})::DOUBLE AS latin, sum({CYRILLIC_SQL})::DOUBLE AS cyrillic FROM lines GROUP BY y, script), f AS (SELECT y, round(CASE script WHEN 'Latn' THEN latin ELSE cyrillic END / (latin + cyrillic), 6) AS fraction, CASE WHEN latin >= cyrillic THEN 'Latin' ELSE 'Cyrillic' END AS dominant FROM c)"
    " SELECT * FROM f WHERE fraction < 0.95 ORDER BY fraction, y LIMIT 50"
)
def script_verification(spark, sf_dir):
    """Labels with under 95 % of characters in their script; the worst 50."""
    rows = script_characters(spark, sf_dir)
    own = F.when(F.substring_index("y", "_", -1) == "Latn", F.col("latin")).otherwise(F.col("cyrillic"))
    rows = rows.select("y", r6(F.try_divide(own, F.col("latin") + F.col("cyrillic"))).alias("fraction"), F.when(F.col("latin") >= F.col("cyrillic"), "Latin").otherwise("Cyrillic").alias("dominant"))
    return rows.filter("fraction < 0.95").orderBy("fraction", "y").limit(50)


@query(LINES + ", d AS (SELECT y, count(*) AS declared FROM lines GROUP BY y), o AS (SELECT y, count(*) FILTER (WHERE length(text) > 0) AS streamed FROM lines GROUP BY y) SELECT y, declared, streamed FROM d FULL JOIN o USING (y) WHERE declared IS DISTINCT FROM streamed")
def count_reconciliation(spark, sf_dir):
    """Labels whose streamed lines aren't as many as declared."""
    rows = labelled(spark, sf_dir)
    declared, streamed = rows.groupBy("y").agg(F.count(F.lit(1)).alias("declared")), rows.groupBy("y").agg(F.count_if(F.length("text") > 0).alias("streamed"))
    return declared.join(streamed, "y", "full").filter(~F.col("declared").eqNullSafe(F.col("streamed")))


@query("SELECT unnest([0, 25, 50, 75, 90, 99, 100]) AS p, round(unnest(quantile_cont(coalesce(length(text), 0)::DOUBLE, [0.0::DOUBLE, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])), 6) AS length FROM documents")
def length_percentiles(spark, sf_dir):
    """P10: percentiles of lengths."""
    ends = [0, 25, 50, 75, 90, 99, 100]
    row = labelled(spark, sf_dir).agg(F.percentile(F.length("text"), [p / 100 for p in ends]).alias("v"))
    return row.select(F.explode(F.arrays_zip(F.array(*map(F.lit, ends)).alias("p"), F.col("v").alias("length"))).alias("z")).select("z.p", r6("z.length").alias("length"))


@query(LINES + " SELECT line_idx, y FROM lines ORDER BY md5('42:' || line_idx), line_idx LIMIT 200")
def sample_uniform(spark, sf_dir):
    """A seeded sample without replacement, by hash order."""
    return sp.uniform_sample(labelled(spark, sf_dir).select("line_idx", "y"), 200, 42)


DRAW_SQL = LINES + ", d101 AS (SELECT line_idx, y FROM (SELECT line_idx, y, count(*) OVER (PARTITION BY y) AS pool, row_number() OVER (PARTITION BY y ORDER BY md5('101:' || line_idx), line_idx) AS k FROM lines) WHERE k <= least(100, floor(0.5 * pool)))"


@query(DRAW_SQL + " SELECT y, count(*) AS n, min(line_idx) AS first, max(line_idx) AS last FROM d101 GROUP BY y")
def draw_balanced(spark, sf_dir):
    """At most 100 lines a label, at most half of it."""
    return sp.balanced_draw(labelled(spark, sf_dir), 101).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("line_idx").alias("first"), F.max("line_idx").alias("last"))


@query(
    DRAW_SQL + ", pool AS (SELECT line_idx, y, count(*) OVER (PARTITION BY y) AS pool, row_number() OVER (PARTITION BY y ORDER BY md5('201:' || line_idx), line_idx) AS k FROM lines ANTI JOIN d101 USING (line_idx)) SELECT line_idx, y FROM pool WHERE k <= least(100, floor(0.5 * pool))"
)
def draw_excluding(spark, sf_dir):
    """The test draw from what the first left."""
    rows = labelled(spark, sf_dir).select("line_idx", "y")
    return sp.balanced_draw(rows, 201, exclude=sp.balanced_draw(rows, 101))


@query(LINES + " SELECT y, count(*) FILTER (WHERE ('0x' || substr(md5('301:' || line_idx), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.4) AS derive, count(*) FILTER (WHERE ('0x' || substr(md5('301:' || line_idx), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.4) AS judge FROM lines GROUP BY y")
def rule_split(spark, sf_dir):
    """40 % of the lines to derive a rule, 60 % to judge it."""
    derive = sp.hash_fraction(301) < 0.4
    return labelled(spark, sf_dir).groupBy("y").agg(F.count_if(derive).alias("derive"), F.count_if(~derive).alias("judge"))


@query(LINES + ", k AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY line_idx) % 2 AS side FROM lines) SELECT y, count(*) FILTER (WHERE side = 1) AS val, count(*) FILTER (WHERE side = 0) AS test FROM k GROUP BY y")
def parity_split(spark, sf_dir):
    """R2: validation and test by parity of the place in a label's order."""
    rows = sp.rank_in(labelled(spark, sf_dir).select("y", "line_idx"), ["y"], "line_idx").withColumn("side", F.col("rank") % 2)
    return rows.groupBy("y").agg(F.count_if(F.col("side") == 1).alias("val"), F.count_if(F.col("side") == 0).alias("test"))


@query(
    DRAW_SQL + ", d201 AS (SELECT line_idx FROM (SELECT line_idx, count(*) OVER (PARTITION BY y) AS pool, row_number() OVER (PARTITION BY y ORDER BY md5('201:' || line_idx), line_idx) AS k FROM lines ANTI JOIN d101 USING (line_idx)) WHERE k <= least(100, floor(0.5 * pool))),"
    " st AS (SELECT seed, line_idx, y, count(*) OVER (PARTITION BY seed, y) AS pool, row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed || ':' || line_idx), line_idx) AS k FROM lines ANTI JOIN d201 USING (line_idx), (VALUES (102), (103), (104), (105)) v(seed))"
    " SELECT seed, y, count(*) AS n, min(line_idx) AS first, max(line_idx) AS last FROM st WHERE k <= least(100, floor(0.5 * pool)) GROUP BY seed, y"
)
def draw_stability(spark, sf_dir):
    """Four more draws, none of which meets the test draw."""
    rows = labelled(spark, sf_dir).select("line_idx", "y")
    test = sp.balanced_draw(rows, 201, exclude=sp.balanced_draw(rows, 101))
    draws = [sp.balanced_draw(rows, seed, exclude=test).withColumn("seed", F.lit(seed)) for seed in (102, 103, 104, 105)]
    every = draws[0].unionByName(draws[1]).unionByName(draws[2]).unionByName(draws[3])
    return every.groupBy("seed", "y").agg(F.count(F.lit(1)).alias("n"), F.min("line_idx").alias("first"), F.max("line_idx").alias("last"))


def _poisson_sql(u: str) -> str:
    return f"(CASE WHEN {u} < 0.36787944117144233 THEN 0 WHEN {u} < 0.7357588823428847 THEN 1 WHEN {u} < 0.9196986029286058 THEN 2 WHEN {u} < 0.9810118431238462 THEN 3 WHEN {u} < 0.9963401531726563 THEN 4 WHEN {u} < 0.9994058151824183 THEN 5 WHEN {u} < 0.9999167588507119 THEN 6 ELSE 7 END)"


def _uniform_sql(parts: str) -> str:
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _pieces_sql(cells: str, columns: str, key: str, seed: int, draws: int = 1000) -> str:
    """CTE `draws`: the columns of `cells` (n, and those given), draw and k of each piece of each row."""
    parts, left = [], "n"
    for mean in reversed(sp.MEANS):
        parts.append(f"SELECT {columns}, {key} AS key, {mean} AS mean, unnest(range(({left}) // {mean})) AS i FROM {cells}")
        left = f"({left}) % {mean}"
    u = "(('0x' || substr(md5(concat_ws(':', '" + str(seed) + "', 'draw', key, mean, i)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)".replace("'draw'", "draw")
    tables = " ".join(f"WHEN {mean} THEN [{', '.join(repr(x) + ('' if 'e' in repr(x) else 'e0') for x in sp.poisson_table(mean))}]" for mean in sp.MEANS)
    return f", pieces AS ({' UNION ALL '.join(parts)}), hashes AS (SELECT {columns}, draw, mean, {u} AS u FROM pieces, range({draws}) d(draw)), draws AS (SELECT {columns}, draw, len(list_filter(CASE mean {tables} END, lambda c: u >= c)) AS k FROM hashes)"


@query(
    SAMPLE_SQL + ", c AS (SELECT v, count(*) AS n FROM (SELECT (y IS NOT DISTINCT FROM pred_b)::INT - (y IS NOT DISTINCT FROM pred_a)::INT AS v FROM s) GROUP BY v)" + _pieces_sql("c", "v", "v::VARCHAR", 7)
    + ", e AS (SELECT draw, sum(k * v)::DOUBLE / nullif(sum(k), 0) AS mean FROM draws GROUP BY draw) SELECT (SELECT round(sum(n * v)::DOUBLE / sum(n), 8) FROM c) AS mean, round(quantile_cont(mean, 0.025::DOUBLE), 8) AS low, round(quantile_cont(mean, 0.975::DOUBLE), 8) AS high FROM e"
)
def bootstrap_items(spark, sf_dir):
    """Interval of the change in accuracy from system a to b over 1,000 resamples of the lines."""
    v = F.col("y").eqNullSafe(F.col("pred_b")).cast("int") - F.col("y").eqNullSafe(F.col("pred_a")).cast("int")
    return sp.bootstrap_counts(sample(spark, sf_dir).select(v.alias("v")), "v", 1000, 7).select(*(F.round(c, 8).alias(c) for c in ("mean", "low", "high")))


@query(
    SAMPLE_SQL + ", c AS (SELECT y, pred_a AS a, pred_b AS b, count(*) AS n FROM s GROUP BY ALL)" + _pieces_sql("c", "y, a, b", "y || '|' || coalesce(a, '') || '|' || coalesce(b, '')", 11)
    + """, sides AS (SELECT draw, y AS label, k AS support, 0 AS pa, 0 AS pb, CASE WHEN a = y THEN k ELSE 0 END AS ta, CASE WHEN b = y THEN k ELSE 0 END AS tb FROM draws UNION ALL
  SELECT draw, a, 0, k, 0, 0, 0 FROM draws WHERE a IS NOT NULL UNION ALL SELECT draw, b, 0, 0, k, 0, 0 FROM draws WHERE b IS NOT NULL),
  bl AS (SELECT draw, label, sum(support) AS support, sum(pa) AS pa, sum(pb) AS pb, sum(ta) AS ta, sum(tb) AS tb FROM sides GROUP BY ALL HAVING sum(support) > 0),
  e AS (SELECT draw, avg(2.0::DOUBLE * tb / (support + pb) - 2.0::DOUBLE * ta / (support + pa)) AS delta FROM bl GROUP BY draw)
SELECT round(avg(delta), 8) AS mean, round(quantile_cont(delta, 0.025::DOUBLE), 8) AS low, round(quantile_cont(delta, 0.975::DOUBLE), 8) AS high FROM e"""
)
def bootstrap_macro_f1(spark, sf_dir):
    """Interval of the change in macro-F1 from system a to b over 1,000 resamples of the lines, by counts of (label, a, b)."""
    return sp.bootstrap_macro_f1(sample(spark, sf_dir), "pred_a", "pred_b", 1000, 11).select(*(F.round(c, 8).alias(c) for c in ("mean", "low", "high")))


@query(
    WIDE_SQL + f", b AS (SELECT f1_b - f1_a AS v, d.draw, {_uniform_sql("'9:' || d.draw || ':' || label")} AS u FROM wide, range(10000) d(draw)),"
    f" e AS (SELECT draw, sum({_poisson_sql('u')} * v)::DOUBLE / nullif(sum({_poisson_sql('u')}), 0) AS mean FROM b GROUP BY draw) SELECT (SELECT round(avg(v), 7) FROM b WHERE draw = 0) AS mean, round(quantile_cont(mean, 0.025::DOUBLE), 7) AS low, round(quantile_cont(mean, 0.975::DOUBLE), 7) AS high FROM e"
)
def bootstrap_labels(spark, sf_dir):
    """Interval of the change in macro-F1 over 10,000 resamples of the labels, both systems by the same resample."""
    rows = wide_f1(spark, sf_dir).select("label", (F.col("f1_b") - F.col("f1_a")).alias("v"))
    return sp.bootstrap_interval(rows, "v", "label", 10000, 9).select(*(F.round(c, 7).alias(c) for c in ("mean", "low", "high")))


STRATA_SQL = WIDE_SQL + f", st AS (SELECT CASE WHEN support < {RARE} THEN 'tail' ELSE 'head' END AS stratum, avg(f1_a) AS base, avg(f1_b) AS cand FROM wide GROUP BY stratum UNION ALL SELECT 'overall', avg(f1_a), avg(f1_b) FROM wide)"


def strata(spark, sf_dir):
    rows = wide_f1(spark, sf_dir).withColumn("stratum", F.explode(F.array(F.when(F.col("support") < RARE, "tail").otherwise("head"), F.lit("overall"))))
    return rows.groupBy("stratum").agg(F.avg("f1_a").alias("base"), F.avg("f1_b").alias("cand"))


@query(STRATA_SQL + " SELECT coalesce(bool_or(stratum = 'overall' AND cand > base), false) AND bool_and(cand >= base - 0.01) AS passes FROM st")
def adoption_guard(spark, sf_dir):
    """The change must help overall and hurt no stratum by over 0.01."""
    return sp.passes_guard(strata(spark, sf_dir))


@query(
    STRATA_SQL + ", g AS (SELECT *, CASE WHEN stratum = 'tail' THEN cand - base END AS gain, base - cand AS loss FROM st), a AS (SELECT count(*) FILTER (WHERE loss > CASE WHEN gain > 5 * greatest(loss, 0) THEN 0.05 WHEN gain > greatest(loss, 0) THEN 0.03 ELSE 0.01 END) AS within, count(*) FILTER (WHERE gain < 0) AS global FROM g),"
    " b AS (SELECT avg(f1_b) < avg(f1_a) - 0.01 AS macro, count(*) FILTER (WHERE support >= 10 AND f1_a - f1_b > 0.10) AS collapsed FROM wide) SELECT within, global, macro, collapsed, within = 0 AND global = 0 AND NOT macro AND collapsed <= 2 AS adopted FROM a, b"
)
def adoption_two_sided(spark, sf_dir):
    """The full rule with its clauses."""
    rows = strata(spark, sf_dir).withColumn("gain", F.when(F.col("stratum") == "tail", F.col("cand") - F.col("base")))
    labels = wide_f1(spark, sf_dir).select("label", "support", F.col("f1_a").alias("base_f1"), F.col("f1_b").alias("cand_f1"))
    return sp.two_sided(rows, labels)


@query(WIDE_SQL + ", o AS (SELECT 'a' AS model, round(avg(f1_a), 9) AS overall FROM wide UNION ALL SELECT 'b', round(avg(f1_b), 9) FROM wide UNION ALL SELECT 'c', round(avg(f1_c), 9) FROM wide) SELECT model, overall FROM o WHERE overall >= (SELECT max(overall) FROM o) - 0.05")
def selection_near_ties(spark, sf_dir):
    """The best system and those near it."""
    rows = wide_f1(spark, sf_dir).agg(*(F.round(F.avg(f"f1_{c}"), 9).alias(c) for c in MODELS)).select(F.expr("stack(3, 'a', a, 'b', b, 'c', c) AS (model, overall)"))
    return sp.near_ties(rows, band=0.05)


@query(SAMPLE_SQL + " SELECT line_idx, y, pred FROM l WHERE model = 'b' AND pred IS DISTINCT FROM y ORDER BY md5('0:' || line_idx), line_idx LIMIT 50")
def audit_sample(spark, sf_dir):
    """50 of the errors left, by hash order."""
    return sp.uniform_sample(long(spark, sf_dir).filter("model = 'b' AND NOT (pred <=> y)").select("line_idx", "y", "pred"), 50, 0)


@query(
    "SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c, i: CASE WHEN regexp_full_match(c, '\\s') OR ('0x' || substr(md5('5:' || (i - 1) || ':' || md5(text)), 1, 6))::INT >= 1677721 THEN c ELSE 'abcdefghijklmnopqrstuvwxyz'[('0x' || substr(md5('5:' || (i - 1) || ':' || md5(text)), 7, 6))::INT % 26 + 1] END), '') AS noisy FROM benchmark"
)
def character_noise(spark, sf_dir):
    """A tenth of the characters replaced, by hash."""
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", sp.noise(F.col("text"), 0.1, 5).alias("noisy"))


GATE_SQL = (
    SAMPLE_SQL + ", g AS (SELECT CASE WHEN substr(md5('r:' || line_idx), 1, 1) < '8' THEN 'report' ELSE 'run' END AS model, y, pred_a AS pred FROM s)" + classes_sql("model", "g", "gc")
    + ", f AS (SELECT model, avg(f1) FILTER (WHERE support > 0) AS f FROM gc GROUP BY model), p AS (SELECT max(round(f, 4)) FILTER (WHERE model = 'report') AS published, max(f) FILTER (WHERE model = 'run') AS f FROM f)"
)


@query(GATE_SQL + f" SELECT round(f, 9) AS macro_f1, published, abs(f - published) <= {TOLERANCE} AS accepted FROM p")
def acceptance_gate(spark, sf_dir):
    """The base's macro-F1 on one half of the lines against the one in a report, read from its file, that another run wrote of the other half.

    A value further than the tolerance from it isn't accepted; `sampling.accept` stops a job there, before candidates
    are looked at. The halves have no line in common, so either answer may come out.
    """
    path = shared(spark, "reports")
    half = F.when(F.substring(F.md5(F.concat(F.lit("r:"), F.col("line_idx").cast("string"))), 1, 1) < "8", "report").otherwise("run")
    rows = m.class_scores(sample(spark, sf_dir).select(half.alias("model"), "y", F.col("pred_a").alias("pred")), ["model"]).filter("support > 0")
    value = F.avg("f1").alias("macro_f1")
    write_report(rows.filter("model = 'report'").agg(F.round(value, 4).alias("macro_f1")), path, "base", "macro-F1 of the base", ("csv",))
    published = read_report(spark, path, "base", "macro_f1 double").first()["macro_f1"]
    far = F.abs(F.col("macro_f1") - F.lit(published)) <= TOLERANCE
    return rows.filter("model = 'run'").agg(value).select(F.round("macro_f1", 9).alias("macro_f1"), F.lit(published).alias("published"), far.alias("accepted"))


@query(SAMPLE_SQL + classes_sql() + " SELECT model, label, support, tp, fp, fn, round(f1, 6) AS f1 FROM pc")
def report_files(spark, sf_dir):
    """Scores by system and label as CSV, Markdown and LaTeX files; the second call writes nothing, a broken file is written again."""
    path, rows = shared(spark, "reports"), scores(spark, sf_dir).select("model", "label", "support", "tp", "fp", "fn", F.round("f1", 6).alias("f1")).orderBy("model", "label")
    first = write_report(rows, path, "classes", "Scores by label")
    if list(first) != list(FORMATS) or write_report(rows, path, "classes", "Scores by label"):
        raise RuntimeError("a report was not written once")
    return read_report(spark, path, "classes", "model string, label string, support long, tp long, fp long, fn long, f1 double").drop("digest")


FAMILIES_SQL = (
    SAMPLE_SQL.split(", marks AS")[0] + """, fam AS (SELECT * FROM (VALUES (0, 'eng deu', NULL, 'grm', 'west'), (1, 'fra;spa, eng', 'und', 'rom', 'italic'), (2, 'deu', 'nld', NULL, 'south'), (3, NULL, 'por', 'rom', NULL)) t(place, codes, one, family, genus)),
  iso AS (SELECT place, unnest(list_distinct(list_append(string_split_regex(coalesce(codes, ''), '[ ;,]+'), coalesce(one, '')))) AS iso, family, genus FROM fam),
  found AS (SELECT iso, arg_min(family, place) FILTER (WHERE family IS NOT NULL) AS family, arg_min(genus, place) FILTER (WHERE genus IS NOT NULL) AS genus FROM iso WHERE iso <> '' GROUP BY iso)"""
)


@query(FAMILIES_SQL + " SELECT f.iso, family, genus, count(l.y) AS n, count(DISTINCT l.y) AS labels FROM found f LEFT JOIN lines l ON l.iso = f.iso GROUP BY ALL")
def label_families(spark, sf_dir):
    """Lines and labels of each language of a family table whose lines list several codes, first wins."""
    lines = labelled(spark, sf_dir).groupBy(F.substring_index("y", "_", 1).alias("iso"), "y").agg(F.count(F.lit(1)).alias("n"))
    rows = families(spark).join(lines, "iso", "left").groupBy("iso", "family", "genus")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("y").alias("labels"))


@query(
    SAMPLE_SQL + ", v AS (SELECT line_idx, y FROM lines), p AS (SELECT line_idx, pred_c AS pred FROM s WHERE pred_c IS NOT NULL) SELECT count(*) AS lines, count(pred) AS matched, count(*) - count(pred) AS missing, count(*) FILTER (WHERE pred = y) AS correct FROM v LEFT JOIN p USING (line_idx)"
)
def positional_join(spark, sf_dir):
    """A system's predictions joined by stored line number; missing ones are counted."""
    predictions = sample(spark, sf_dir).filter("pred_c is not null").select("line_idx", F.col("pred_c").alias("pred"))
    rows = labelled(spark, sf_dir).select("line_idx", "y").join(predictions, "line_idx", "left")
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.count("pred").alias("matched"), F.count_if(F.col("pred").isNull()).alias("missing"), F.count_if(F.col("pred") == F.col("y")).alias("correct"))


@query(DRAW_SQL + " SELECT line_idx, l.y, length(text)::BIGINT AS chars FROM lines l SEMI JOIN d101 USING (line_idx)")
def point_lookup(spark, sf_dir):
    """The lines of a drawn set, by semi-join."""
    rows = labelled(spark, sf_dir)
    drawn = sp.balanced_draw(rows.select("line_idx", "y"), 101)
    return rows.join(drawn, "line_idx", "left_semi").select("line_idx", "y", F.length("text").cast("long").alias("chars"))


@query(LINES + " SELECT y AS label, y NOT IN ('eng_Latn', 'fra_Latn', 'deu_Latn', 'spa_Latn') AS unknown, count(*) AS n FROM lines GROUP BY y")
def label_inventory(spark, sf_dir):
    """Labels of a benchmark against a label list, by anti-join."""
    known = spark.createDataFrame([(x,) for x in ("eng_Latn", "fra_Latn", "deu_Latn", "spa_Latn")], "label string")
    rows = labelled(spark, sf_dir).groupBy(F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    marked = rows.join(F.broadcast(known.withColumn("known", F.lit(True))), "label", "left")
    return marked.select("label", F.col("known").isNull().alias("unknown"), "n")
