"""Training, weight-transform and distribution plans over one-code-point tokens, whose segmentation is unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators import distributions as d
from glossa.operators import metrics
from glossa.operators import model as mo
from glossa.operators import sampling as sp
from glossa.operators import weights as w
from glossa.plans.registry import query
from glossa.plans.tables import LABELLED_SQL, SAMPLE_SQL, classes_sql, families, labelled, sample
from glossa.sources.store import table


def counts(spark, sf_dir: str) -> DataFrame:
    """Token counts by label, written as a table: the only pass over the texts, and as small as the model."""
    return table(mo.token_counts(labelled(spark, sf_dir)), "counts")


def with_lines(spark, sf_dir: str, model: DataFrame) -> DataFrame:
    """model with n_lines and script of each label."""
    lines = labelled(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n_lines"), F.first("script").alias("script"))
    return model.join(F.broadcast(lines), "y")


def model(spark, sf_dir: str) -> DataFrame:
    return with_lines(spark, sf_dir, mo.smoothed(counts(spark, sf_dir)))


def cells(df: DataFrame) -> DataFrame:
    return df.select("y", "token", F.round("w", 6).alias("w"))


MODEL_SQL = (
    "WITH "
    + LABELLED_SQL
    + """, ch AS (SELECT y, unnest(string_split(text, '')) AS token FROM lines), cnt AS (SELECT y, token, count(*) AS n FROM ch WHERE token <> '' GROUP BY ALL),
  lab AS (SELECT y, count(*) AS n_lines, any_value(script) AS script FROM lines GROUP BY y), tot AS (SELECT y, sum(n) AS total FROM cnt GROUP BY y), voc AS (SELECT DISTINCT token FROM cnt),
  grid AS (SELECT y, token, coalesce(n, 0)::BIGINT AS n, total::BIGINT AS total, n_lines, script, (SELECT count(*) FROM voc) AS size FROM tot CROSS JOIN voc JOIN lab USING (y) LEFT JOIN cnt USING (y, token)),
  m AS (SELECT y, token, n, total, n_lines, script, (n + 0.5::DOUBLE) / (total + 0.5::DOUBLE * size) AS p, ln((n + 0.5::DOUBLE) / (total + 0.5::DOUBLE * size)) AS w, n > 0 AS seen FROM grid),
  base AS (SELECT token, (n + 0.5::DOUBLE) / (sum(n) OVER () + 0.5::DOUBLE * count(*) OVER ()) AS p_base FROM (SELECT token, sum(n)::DOUBLE AS n FROM cnt GROUP BY token))"""
)
CELLS = " SELECT y, token, round(w, 6) AS w FROM x"


def renorm_sql(source: str) -> str:
    return f", x AS (SELECT y, token, w - top - ln(sum(exp(w - top)) OVER (PARTITION BY y)) AS w FROM (SELECT y, token, w, max(w) OVER (PARTITION BY y) AS top FROM {source}))"


@query(MODEL_SQL + " SELECT y, token, n, round(ln(greatest(n::DOUBLE / total, 1e-12)), 6) AS w, seen FROM m")
def train_floored(spark, sf_dir):
    """One model a label by relative frequencies with a floor."""
    return mo.floored(counts(spark, sf_dir)).select("y", "token", "n", F.round("w", 6).alias("w"), "seen")


@query(MODEL_SQL + " SELECT y, token, n, round(w, 6) AS w, seen FROM m")
def train_smoothed(spark, sf_dir):
    """T4: add-alpha models whose rows sum to 1; a weight that isn't finite stops the query (T5)."""
    rows = mo.require(mo.smoothed(counts(spark, sf_dir)), F.isnan("w") | F.col("w").isin(float("inf"), float("-inf")), "a weight isn't finite")
    return rows.select("y", "token", "n", F.round("w", 6).alias("w"), "seen")


@query(MODEL_SQL + " SELECT token, round(-ln((SELECT count(*) FROM voc)), 9) AS base_logp FROM voc")
def vocabulary_uniform(spark, sf_dir):
    """The vocabulary with a uniform log-probability as seed."""
    tokens = counts(spark, sf_dir).select("token").distinct()
    return tokens.select("token", F.round(-F.log(F.count(F.lit(1)).over(Window.partitionBy())), 9).alias("base_logp"))


@query(MODEL_SQL + ", k AS (SELECT y, sum((w > lo)::INT) AS above, any_value(total) AS total FROM (SELECT *, min(w) OVER (PARTITION BY y) AS lo FROM m) GROUP BY y) SELECT y, above::BIGINT AS above, above < 100 AS degenerate FROM k")
def degenerate_rows(spark, sf_dir):
    """Rows with under 100 weights above their least."""
    return d.entropy(model(spark, sf_dir)).select("y", "above", (F.col("above") < 100).alias("degenerate"))


@query(MODEL_SQL + ", k AS (SELECT *, min(w) OVER (PARTITION BY y) AS lo FROM m) SELECT y, any_value(total) AS total, round(-sum(p * ln(p)), 6) AS h, round(max(p), 9) AS peak, count(*) FILTER (WHERE w > lo) AS above FROM k GROUP BY y")
def row_statistics(spark, sf_dir):
    """Entropy, peak and number of weights above the least of each row."""
    return d.entropy(model(spark, sf_dir)).select("y", "total", F.round("h", 6).alias("h"), F.round("peak", 9).alias("peak"), "above")


@query(MODEL_SQL + ", x AS (SELECT y, token, greatest(w, -10) AS w FROM m)" + CELLS)
def weights_clamped(spark, sf_dir):
    """No weight under a floor."""
    return cells(w.clamp(model(spark, sf_dir), -10.0))


@query(MODEL_SQL + ", x AS (SELECT y, token, CASE WHEN lo > -21 AND NOT seen THEN -21 ELSE w END AS w FROM (SELECT *, min(w) OVER (PARTITION BY y) AS lo FROM m))" + CELLS)
def weights_equal_floor(spark, sf_dir):
    """Unseen tokens down to one floor."""
    return cells(w.equalise_floor(model(spark, sf_dir), -21.0))


@query(
    MODEL_SQL + ", g AS (SELECT *, sum(CASE WHEN NOT seen THEN p ELSE 0 END) OVER (PARTITION BY y) AS mass, sum((NOT seen)::INT) OVER (PARTITION BY y) AS unseen, sum((n = 1)::INT) OVER (PARTITION BY y) AS once FROM m),"
    " x AS (SELECT y, token, CASE WHEN once = 0 OR unseen = 0 THEN w WHEN seen THEN w + ln((1 - least(mass, once::DOUBLE / total)) / (1 - mass)) ELSE ln(least(mass, once::DOUBLE / total) / unseen) END AS w FROM g)" + CELLS
)
def weights_good_turing(spark, sf_dir):
    """Unseen mass by the share of singletons."""
    return cells(w.good_turing(model(spark, sf_dir)))


@query(
    MODEL_SQL + " SELECT y, any_value(total) AS total, count(*) FILTER (WHERE n = 1) AS once, count(*) FILTER (WHERE seen) AS types, count(*) FILTER (WHERE NOT seen) AS plateau_size, round(coalesce(sum(p) FILTER (WHERE NOT seen), 0), 12) AS plateau_mass FROM m GROUP BY y"
)
def good_turing_counts(spark, sf_dir):
    """Tokens, singletons, types and the plateau of unseen tokens of each label."""
    return model(spark, sf_dir).groupBy("y").agg(
        F.max("total").alias("total"), F.count_if(F.col("n") == 1).alias("once"), F.count_if("seen").alias("types"), F.count_if(~F.col("seen")).alias("plateau_size"),
        F.round(F.coalesce(F.sum(F.when(~F.col("seen"), F.col("p"))), F.lit(0.0)), 12).alias("plateau_mass"),
    )


@query(MODEL_SQL + ", x AS (SELECT y, token, CASE WHEN seen THEN w ELSE ln(p_base) - 21 - (SELECT avg(ln(p_base)) FROM base) END AS w FROM m JOIN base USING (token))" + CELLS)
def weights_background(spark, sf_dir):
    """Unseen tokens by the background distribution."""
    return cells(w.background_floor(model(spark, sf_dir), mo.base_model(counts(spark, sf_dir))))


BAR, CAP = 60, 300
PRIOR_SQL = f""", k AS (SELECT *, CASE WHEN n_lines >= {BAR} THEN least(n_lines, {CAP}) ELSE 0 END::DOUBLE AS k FROM m), prior AS (
  SELECT y, token, num / den AS prior FROM (SELECT y, token, sum(k * p) OVER (PARTITION BY script, token) - k * p AS num, sum(k) OVER (PARTITION BY script, token) - k AS den FROM k) WHERE den > 0.5)"""


def script_prior(spark, sf_dir):
    return w.backbone_mean(model(spark, sf_dir), "script", "n_lines", BAR, CAP)


@query(MODEL_SQL + PRIOR_SQL + " SELECT y, token, round(prior, 9) AS prior FROM prior")
def backbone_prior(spark, sf_dir):
    """Mean of the other well-trained rows of the script."""
    return script_prior(spark, sf_dir).select("y", "token", F.round("prior", 9).alias("prior"))


@query(
    MODEL_SQL + f", sk AS (SELECT a.y AS y, b.y AS other, (sum(a.p * ln(a.p / b.p)) + sum(b.p * ln(b.p / a.p))) / 2 AS kl FROM m a JOIN m b USING (token) WHERE a.y <> b.y GROUP BY ALL), near AS (SELECT y, other FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY round(kl, 9), other) AS r FROM sk) WHERE r <= 1),"
    f" k AS (SELECT *, CASE WHEN n_lines >= {BAR} THEN least(n_lines, {CAP}) ELSE 0 END::DOUBLE AS k FROM m)"
    " SELECT a.y, a.token, round(sum(b.k * b.p) / sum(b.k), 9) AS prior FROM k a JOIN k b ON a.token = b.token AND a.y <> b.y ANTI JOIN near ON near.y = a.y AND near.other = b.y GROUP BY a.y, a.token HAVING sum(b.k) > 0.5"
)
def backbone_without_near(spark, sf_dir):
    """The mean over all rows but the row itself and its nearest by symmetric KL."""
    m = model(spark, sf_dir)
    pairs = d.both_ways(d.pairwise(m)).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.round("sym_kl", 9), "b"))).filter("r <= 1")
    near = pairs.select(F.col("a").alias("y"), F.col("b").alias("other"))
    return w.backbone_mean(m.withColumn("one", F.lit(1)), "one", "n_lines", BAR, CAP, near).select("y", "token", F.round("prior", 9).alias("prior"))


@query(MODEL_SQL + PRIOR_SQL + ", x AS (SELECT y, token, ln(CASE WHEN prior IS NULL OR seen THEN p ELSE greatest(p, 300.0::DOUBLE / (n_lines + 300) * prior) END) AS w FROM m LEFT JOIN prior USING (y, token))" + CELLS)
def weights_back_off_lift(spark, sf_dir):
    """Unseen tokens lifted to a share of the script's mean."""
    return cells(w.back_off(model(spark, sf_dir), script_prior(spark, sf_dir), "n_lines", 300.0))


@query(MODEL_SQL + PRIOR_SQL + ", x AS (SELECT y, token, ln(CASE WHEN prior IS NULL THEN p ELSE p + 300.0::DOUBLE / (n_lines + 300) * (prior - p) END) AS w FROM m LEFT JOIN prior USING (y, token))" + CELLS)
def weights_back_off_full(spark, sf_dir):
    """All tokens mixed with the script's mean by the label's lines."""
    return cells(w.back_off(model(spark, sf_dir), script_prior(spark, sf_dir), "n_lines", 300.0, "full"))


FAMILY_SQL = "CASE WHEN split_part(y, '_', 1) IN ('eng', 'deu') THEN 'grm' ELSE 'rom' END || '|' || script"


@query(
    MODEL_SQL + PRIOR_SQL + f", f AS (SELECT *, {FAMILY_SQL} AS fam, k FROM k), fc AS (SELECT fam, count(DISTINCT y) AS members FROM f WHERE k > 0 GROUP BY fam), fp AS (SELECT y, token, num / den AS fprior FROM"
    " (SELECT y, token, fam, sum(k * p) OVER (PARTITION BY fam, token) - k * p AS num, sum(k) OVER (PARTITION BY fam, token) - k AS den FROM f) JOIN fc USING (fam) WHERE den > 0.5 AND members >= 2)"
    " SELECT y, token, round(coalesce(fprior, prior), 9) AS prior, CASE WHEN fprior IS NOT NULL THEN 'family' WHEN prior IS NOT NULL THEN 'script' ELSE 'none' END AS tier FROM m LEFT JOIN fp USING (y, token) LEFT JOIN prior USING (y, token)"
)
def tiered_prior(spark, sf_dir):
    """The family's mean within the script where it has two backbone rows, else the script's; families come from a table's file."""
    known = families(spark).select("iso", F.col("family").alias("group"))  # a row a language
    m = model(spark, sf_dir).withColumn("iso", F.substring_index("y", "_", 1)).join(F.broadcast(known), "iso").drop("iso")
    m = m.withColumn("family", F.concat_ws("|", "group", "script")).drop("group")
    enough = m.filter(F.col("n_lines") >= BAR).select("family", "y").distinct().groupBy("family").count().filter("count >= 2").select("family")
    first = w.backbone_mean(m, "family", "n_lines", BAR, CAP).withColumnRenamed("prior", "first")
    first = first.join(F.broadcast(m.join(F.broadcast(enough), "family", "left_semi").select("y").distinct()), "y", "left_semi")
    rows = m.select("y", "token").join(first, ["y", "token"], "left").join(script_prior(spark, sf_dir), ["y", "token"], "left")
    tier = F.when(F.col("first").isNotNull(), "family").when(F.col("prior").isNotNull(), "script").otherwise("none")
    return rows.select("y", "token", F.round(F.coalesce("first", "prior"), 9).alias("prior"), tier.alias("tier"))


@query(MODEL_SQL + PRIOR_SQL + ", x AS (SELECT y, token, ln(CASE WHEN prior IS NULL THEN p ELSE 0.7 * p + 0.3 * prior END) AS w FROM m LEFT JOIN prior USING (y, token))" + CELLS)
def weights_shrunk(spark, sf_dir):
    """A fixed share of the prior."""
    return cells(w.shrink(model(spark, sf_dir), script_prior(spark, sf_dir), F.lit(0.3)))


@query(MODEL_SQL + renorm_sql("(SELECT y, token, 1.5 * w AS w FROM m)") + CELLS)
def weights_sharpened(spark, sf_dir):
    """Scaled weights, renormalised by log-sum-exp."""
    return cells(w.sharpen(model(spark, sf_dir), 1.5))


@query(
    MODEL_SQL + f", sk AS (SELECT a.y AS y, b.y AS other, (sum(a.p * ln(a.p / b.p)) + sum(b.p * ln(b.p / a.p))) / 2 AS kl FROM m a JOIN m b USING (token) WHERE a.script = b.script AND a.n_lines < {BAR} AND b.n_lines >= {BAR} GROUP BY ALL),"
    " near AS (SELECT y, other FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY round(kl, 9), other) AS r FROM sk) WHERE r = 1), x AS (SELECT m.y, m.token, ln(CASE WHEN o.p IS NULL THEN m.p ELSE 0.8 * m.p + 0.2 * o.p END) AS w FROM m LEFT JOIN near USING (y) LEFT JOIN m o ON o.y = near.other AND o.token = m.token)"
    + CELLS
)
def weights_related(spark, sf_dir):
    """Rows with few lines mixed with the nearest well-trained row of their script."""
    m = model(spark, sf_dir)
    labels = m.select("y", "script", "n_lines").distinct()
    few = labels.filter(F.col("n_lines") < BAR).select(F.col("y").alias("a"), "script")
    pairs = few.join(labels.filter(F.col("n_lines") >= BAR).select(F.col("y").alias("b"), "script"), "script").select("a", "b")
    near = d.pairwise(m, pairs).groupBy("a").agg(F.min(F.struct(F.round("sym_kl", 9).alias("kl"), F.col("b").alias("other"))).alias("best"))
    return cells(w.interpolate(m, near.select(F.col("a").alias("y"), F.col("best.other").alias("other")), 0.8))


@query(MODEL_SQL + f", x AS (SELECT y, token, ln(CASE WHEN n_lines < {BAR} THEN 0.8 * p + 0.2 * avg(p) OVER (PARTITION BY script, token) ELSE p END) AS w FROM m)" + CELLS)
def weights_script_average(spark, sf_dir):
    """Rows with few lines mixed with their script's mean."""
    return cells(w.script_average(model(spark, sf_dir), "script", F.col("n_lines") < BAR, 0.8))


@query(MODEL_SQL + ", x AS (SELECT y, token, CASE WHEN regexp_full_match(token, '[^\\p{L}]') THEN ln(sum(n_lines * p) OVER (PARTITION BY token) / sum(n_lines) OVER (PARTITION BY token)) ELSE w END AS w FROM m)" + CELLS)
def weights_tied(spark, sf_dir):
    """Tokens without letters get one weight in all rows."""
    return cells(w.tie(model(spark, sf_dir), F.col("token").rlike("^[^\\p{L}]$"), "n_lines"))


@query(MODEL_SQL + ", x AS (SELECT y, token, CASE WHEN regexp_full_match(token, '[0-9\\s]') THEN ln(sum(n_lines * p) OVER (PARTITION BY token, script) / sum(n_lines) OVER (PARTITION BY token, script)) ELSE w END AS w FROM m)" + CELLS)
def weights_tied_by_script(spark, sf_dir):
    """Digits and spaces get one weight in a script."""
    return cells(w.tie(model(spark, sf_dir), F.col("token").rlike("^[0-9\\s]$"), "n_lines", "script"))


@query(
    MODEL_SQL + " SELECT token, NOT regexp_full_match(token, '\\p{L}') AS nonalpha_all, regexp_full_match(token, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]') AS nonalpha_ascii, regexp_full_match(token, '[0-9\\s]') AS digits_ws FROM voc"
)
def token_byte_classes(spark, sf_dir):
    """Which tokens may be tied."""
    t = F.col("token")
    return counts(spark, sf_dir).select("token").distinct().select("token", (~t.rlike("^\\p{L}$")).alias("nonalpha_all"), t.rlike("^[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]$").alias("nonalpha_ascii"), t.rlike("^[0-9\\s]$").alias("digits_ws"))


@query(
    MODEL_SQL + ", x AS (SELECT y, token, CASE WHEN regexp_full_match(token, '[^\\p{L}]') THEN ln(p + 300.0::DOUBLE / (n_lines + 300) * (sum(n_lines * p) OVER (PARTITION BY token, script) / sum(n_lines) OVER (PARTITION BY token, script) - p)) ELSE w END AS w FROM m)" + CELLS
)
def weights_punctuation_pooled(spark, sf_dir):
    """Tokens without letters pooled within the script by the label's lines."""
    return cells(w.tie(model(spark, sf_dir), F.col("token").rlike("^[^\\p{L}]$"), "n_lines", "script", 300.0))


CLUSTER_SQL = MODEL_SQL + ", cl AS (SELECT * FROM m WHERE script = 'Latn'), var AS (SELECT token, var_pop(w) AS v FROM cl GROUP BY token), st AS (SELECT median(v) FILTER (WHERE v > 0) AS mid, avg(v) AS mean, stddev_pop(v) AS sd FROM var)"


def latin(spark, sf_dir):
    return model(spark, sf_dir).filter("script = 'Latn'")


@query(CLUSTER_SQL + renorm_sql("(SELECT y, token, CASE WHEN v > mid THEN w + 0.5 * v ELSE w END AS w FROM cl JOIN var USING (token), st)") + CELLS)
def weights_discriminative_a(spark, sf_dir):
    """W16 a: a boost for tokens that tell a cluster's labels apart."""
    return cells(w.discriminate(latin(spark, sf_dir), "a", 0.5))


@query(CLUSTER_SQL + renorm_sql("(SELECT y, token, w + 0.5 * (v - mean) / sd AS w FROM cl JOIN var USING (token), st)") + CELLS)
def weights_discriminative_b(spark, sf_dir):
    """W16 b: z-scored boost."""
    return cells(w.discriminate(latin(spark, sf_dir), "b", 0.5))


@query(CLUSTER_SQL + renorm_sql("(SELECT y, token, w / (1 + exp(-5 * (v - mid))) + ln(p_base) * (1 - 1 / (1 + exp(-5 * (v - mid)))) AS w FROM cl JOIN var USING (token) JOIN base USING (token), st)") + CELLS)
def weights_discriminative_c(spark, sf_dir):
    """W16 c: a sigmoid gate to the base's weights."""
    return cells(w.discriminate(latin(spark, sf_dir), "c", 5.0, mo.base_model(counts(spark, sf_dir))))


@query(MODEL_SQL + f", x AS (SELECT y, token, CASE WHEN n_lines < {BAR} AND lo > -21 AND NOT seen THEN -21 ELSE w END AS w FROM (SELECT *, min(w) OVER (PARTITION BY y) AS lo FROM m))" + CELLS)
def weights_mixed(spark, sf_dir):
    """Well-trained rows unchanged, the others with an equal floor."""
    m = model(spark, sf_dir)
    return cells(w.mixed(m, w.equalise_floor(m, -21.0), F.col("n_lines") >= BAR))


@query(MODEL_SQL + " SELECT count(*) AS cells, 0::BIGINT AS differing FROM m")
def weights_no_op(spark, sf_dir):
    """Passes that change nothing leave every weight as it is, bit by bit."""
    m = model(spark, sf_dir)
    return w.differing(m, w.clamp(w.mixed(m, m, F.col("n_lines") >= BAR), None))


@query(MODEL_SQL + " SELECT a.y AS a, b.y AS b, round((sum(a.p * ln(a.p / b.p)) + sum(b.p * ln(b.p / a.p))) / 2, 7) AS sym_kl FROM m a JOIN m b USING (token) WHERE a.y < b.y GROUP BY ALL")
def kl_pairs(spark, sf_dir):
    """Symmetric KL of all pairs of labels."""
    return d.pairwise(model(spark, sf_dir)).select("a", "b", F.round("sym_kl", 7).alias("sym_kl"))


@query(MODEL_SQL + " SELECT y, round(sum(p * ln(p / p_base)), 7) AS kl, round(corr(w, ln(p_base)), 7) AS corr, round(avg(abs(w - ln(p_base))), 7) AS mad FROM m JOIN base USING (token) GROUP BY y")
def kl_base(spark, sf_dir):
    """D3: each row against the base."""
    rows = d.against_base(model(spark, sf_dir), mo.base_model(counts(spark, sf_dir)))
    return rows.select("y", *(F.round(c, 7).alias(c) for c in ("kl", "corr", "mad")))


@query(
    MODEL_SQL + ", t AS (SELECT y, token, round(p * ln(p / p_base), 9) AS part FROM m JOIN base USING (token)), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY abs(part) DESC, token) AS rank FROM t) SELECT y, token, part, rank FROM r WHERE rank <= 20"
)
def divergent_tokens(spark, sf_dir):
    """The tokens that part each row most from the base."""
    rows = model(spark, sf_dir).join(F.broadcast(mo.base_model(counts(spark, sf_dir))), "token")
    rows = rows.select("y", "token", F.round(F.col("p") * F.log(F.col("p") / F.col("p_base")), 9).alias("part"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy(F.desc(F.abs("part")), "token"))).filter("rank <= 20")


@query(MODEL_SQL + " SELECT a.y AS a, b.y AS b, round((sum(a.p * ln(a.p / b.p)) + sum(b.p * ln(b.p / a.p))) / 2, 7) AS sym_kl FROM m a JOIN m b USING (token) JOIN (VALUES ('eng_Latn', 'deu_Latn'), ('fra_Latn', 'spa_Latn'), ('eng_Latn', 'eng_Cyrl')) q(a, b) ON q.a = a.y AND q.b = b.y GROUP BY ALL")
def related_pairs(spark, sf_dir):
    """Symmetric KL of listed pairs."""
    pairs = spark.createDataFrame([("eng_Latn", "deu_Latn"), ("fra_Latn", "spa_Latn"), ("eng_Latn", "eng_Cyrl")], "a string, b string")
    return d.pairwise(model(spark, sf_dir), pairs).select("a", "b", F.round("sym_kl", 7).alias("sym_kl"))


ENTROPY_SQL = ", ent AS (SELECT y, any_value(script) AS script, any_value(n_lines) AS n_lines, -sum(p * ln(p)) AS h FROM m GROUP BY y), z AS (SELECT e.*, mid, members FROM ent e JOIN (SELECT script, median(h) AS mid, count(*) AS members FROM ent GROUP BY script) USING (script)), zz AS (SELECT z.*, CASE WHEN members >= 3 THEN (h - mid) / (1.4826 * mad + 1e-9) ELSE 0 END AS zh FROM z JOIN (SELECT script, median(abs(h - mid)) AS mad FROM z GROUP BY script) USING (script))"


def flatness(spark, sf_dir):
    rows = model(spark, sf_dir).groupBy("y").agg(F.first("script").alias("script"), F.max("n_lines").alias("n_lines"), (-F.sum(F.col("p") * F.log("p"))).alias("h"))
    return d.robust_z(rows, "h", "script").withColumnRenamed("z", "zh")


@query(MODEL_SQL + ENTROPY_SQL + " SELECT y, script, round(h, 6) AS h, round(zh, 4) AS zh FROM zz")
def flatness_z(spark, sf_dir):
    """How flat a row is for its script, by median and MAD."""
    return flatness(spark, sf_dir).select("y", "script", F.round("h", 6).alias("h"), F.round("zh", 4).alias("zh"))


NEAR_SQL = ", sk AS (SELECT a.y AS a, b.y AS b, round((sum(a.p * ln(a.p / b.p)) + sum(b.p * ln(b.p / a.p))) / 2, 8) AS kl, any_value(a.script) AS sa, any_value(b.script) AS sb, any_value(a.n_lines) AS na, any_value(b.n_lines) AS nb FROM m a JOIN m b USING (token) WHERE a.y <> b.y GROUP BY ALL), close AS (SELECT quantile_cont(kl, 0.25::DOUBLE) AS bar FROM sk), near AS (SELECT a AS y, min(kl) AS d_nn, arg_min(b, (kl, b)) AS nn, count(*) FILTER (WHERE kl < bar) AS k_close, min(kl) FILTER (WHERE sa = sb AND nb > na) AS d_up, arg_min(b, (kl, b)) FILTER (WHERE sa = sb AND nb > na) AS target FROM sk, close GROUP BY a)"


def neighbours(spark, sf_dir):
    m = model(spark, sf_dir)
    of = m.select("y", "script", "n_lines").distinct()
    pairs = table(d.both_ways(d.pairwise(m)).select("a", "b", F.round("sym_kl", 8).alias("kl")), "pairs")  # labels squared
    bar = pairs.agg(F.percentile("kl", 0.25).alias("bar"))
    near = pairs.crossJoin(F.broadcast(bar)).groupBy(F.col("a").alias("y")).agg(F.min(F.struct("kl", "b")).alias("one"), F.count_if(F.col("kl") < F.col("bar")).alias("k_close"))
    up = pairs.join(d.richer(of), ["a", "b"]).groupBy(F.col("a").alias("y")).agg(F.min(F.struct("kl", "b")).alias("two"))
    best = near.join(up, "y", "left")
    return best.select("y", F.col("one.kl").alias("d_nn"), F.col("one.b").alias("nn"), "k_close", F.col("two.kl").alias("d_up"), F.col("two.b").alias("target"))


@query(MODEL_SQL + NEAR_SQL + " SELECT y, round(d_nn, 6) AS d_nn, nn, k_close, round(d_up, 6) AS d_up, target FROM near")
def nearest_labels(spark, sf_dir):
    """Nearest row, number of close rows, and nearest richer row of the script."""
    return neighbours(spark, sf_dir).select("y", F.round("d_nn", 6).alias("d_nn"), "nn", "k_close", F.round("d_up", 6).alias("d_up"), "target")


EVEN_SQL = SAMPLE_SQL + ", l AS (SELECT 'a' AS model, y, pred_a AS pred FROM (SELECT *, row_number() OVER (ORDER BY line_idx) AS place FROM s) WHERE place % 2 = 1)" + classes_sql()
EVEN_SQL = EVEN_SQL.replace(EVEN_SQL[EVEN_SQL.index(", l AS (\n") : EVEN_SQL.index(", l AS (SELECT 'a'")], "")
MAGNET_SQL = ", magnet AS (SELECT label AS y, support, fp, fp::DOUBLE / (support + 1) AS magnet FROM pc)"


@query(EVEN_SQL + MAGNET_SQL + " SELECT y, support, fp, round(magnet, 9) AS magnet FROM magnet")
def magnet_ratio(spark, sf_dir):
    """False positives over support + 1 of each label for system a, on the lines of even position (from 0)."""
    return magnets(spark, sf_dir).select("y", "support", "fp", F.round("magnet", 9).alias("magnet"))


def magnets(spark, sf_dir: str) -> DataFrame:
    even = sp.rank_in(sample(spark, sf_dir).select("line_idx", "y", "pred_a"), [], "line_idx").filter("rank % 2 = 1")
    return metrics.class_scores(even, [], "y", "pred_a").select(F.col("label").alias("y"), "support", "fp", (F.col("fp") / (F.col("support") + 1)).alias("magnet"))


def category(zh, magnet, d_nn, dnn_bar, log_gap, n_lines, d_up, dup_bar):
    """The first rule that holds names a row's category; the order matters."""
    return (
        F.when(((zh > 2) & (magnet > 0.5)) | (zh > 8), "flat_magnet").when((d_nn < dnn_bar) & (log_gap < 1), "twin").when((n_lines < BAR) & (d_up < dup_bar), "tight_lowres")
        .when(n_lines < BAR, "isolated_tail").when(n_lines >= CAP, "head").otherwise("mid")
    )


@query(
    MODEL_SQL + EVEN_SQL.removeprefix("WITH " + LABELLED_SQL) + MAGNET_SQL + ENTROPY_SQL + NEAR_SQL + ", q AS (SELECT quantile_cont(d_nn, 0.3::DOUBLE) AS nb, quantile_cont(d_up, 0.3::DOUBLE) AS ub FROM near)"
    f" SELECT y, CASE WHEN (zh > 2 AND magnet > 0.5) OR zh > 8 THEN 'flat_magnet' WHEN d_nn < nb AND abs(ln(z.n_lines) - ln(o.n_lines)) < 1 THEN 'twin' WHEN z.n_lines < {BAR} AND d_up < ub THEN 'tight_lowres' WHEN z.n_lines < {BAR} THEN 'isolated_tail' WHEN z.n_lines >= {CAP} THEN 'head' ELSE 'mid' END AS category"
    " FROM zz z JOIN near USING (y) JOIN (SELECT y AS nn, n_lines FROM lab) o USING (nn) LEFT JOIN magnet g USING (y), q"
)
def label_categories(spark, sf_dir):
    """Flat magnet, twin, tight low-resource, isolated tail, head or mid."""
    z, near = flatness(spark, sf_dir), neighbours(spark, sf_dir)
    bars = near.agg(F.percentile("d_nn", 0.3).alias("nb"), F.percentile("d_up", 0.3).alias("ub"))
    lines = z.select(F.col("y").alias("nn"), F.col("n_lines").alias("nn_lines"))
    rows = z.join(near, "y").join(lines, "nn").join(magnets(spark, sf_dir).select("y", "magnet"), "y", "left").crossJoin(F.broadcast(bars))
    gap = F.abs(F.log("n_lines") - F.log("nn_lines"))
    return rows.select("y", category(F.col("zh"), F.coalesce("magnet", F.lit(0.0)), F.col("d_nn"), F.col("nb"), gap, F.col("n_lines"), F.col("d_up"), F.col("ub")).alias("category"))


# The words of the classes, by language group (a word may stand in several).
FUNCTION_WORDS = """
the of and in to is for that with was on are be by it as at or an not from but have this had has his her its they their who which will would been were
one all also can more than other into said about over after when where how each
de la le les du des un une en et est que qui dans par sur au aux ou el los las del con por se su es da di il lo gli nel dei al che si do dos das no na nos ao aos em com
der die das den dem ein eine und ist von zu auf mit im an er sie es og er i en et af til med for har av som var det att inte kan om
na je se ze ve ke do za po
yang dan di ini itu dari ke untuk dengan pada ada akan juga oleh karena bahwa saya kita mereka ia nya
na ya wa ni kwa mu
""".split()
RELIGIOUS = "yehuwa jehov jehovah allah biblia bible psalm jesus christ gospel scripture verse church pray lord god prophet apostle kina mose moses israel jerusalem".split()
MARK = "\u0120"  # begins a token that starts a word


def token_class(token):
    """Linguistic class of a token; the first rule that holds counts."""
    marked = token.startswith(MARK)
    bare = F.regexp_replace(token, "^" + MARK, "")
    body, size = F.lower(bare), F.length(bare)
    letters = F.length(F.regexp_replace(bare, "[^\\p{L}]", ""))
    term = body.isin(RELIGIOUS)
    for t in RELIGIOUS:
        term = term | (body.contains(t) & (size < len(t) + 5))
    return (
        F.when(F.length(F.regexp_replace(token, f"[^{MARK}]", "")) >= 2, "multi_word_unit")
        .when((size > 0) & (letters == 0), "punctuation")
        .when((size > 0) & (letters < size * 0.5) & (size <= 4), "punctuation")
        .when(size == 0, "punctuation")
        .when(bare.rlike("\\p{Cc}"), "script_encoding")
        .when(term, "domain_religious")
        .when(marked & body.isin(FUNCTION_WORDS), "function_word")
        .when((size <= 2) & (letters == size), "character_phonotactic")
        .when(~marked & (size <= 5) & (letters == size), "morphological_affix")
        .when(marked | (size > 5), "content_word")
        .otherwise("morphological_affix")
    )


def _list_sql(words: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in words)


CLASS_SQL = (
    "CASE WHEN NOT regexp_matches(token, '\\p{L}') THEN 'punctuation' WHEN regexp_matches(token, '[\\x00-\\x1F\\x7F]') THEN 'script_encoding' ELSE 'character_phonotactic' END"  # of one code point
)
WORD_CLASS_SQL = f"""CASE WHEN length(token) - length(replace(token, '{MARK}', '')) >= 2 THEN 'multi_word_unit' WHEN size > 0 AND letters = 0 THEN 'punctuation' WHEN size > 0 AND letters < size * 0.5::DOUBLE AND size <= 4 THEN 'punctuation'
  WHEN size = 0 THEN 'punctuation' WHEN regexp_matches(bare, '\\p{{Cc}}') THEN 'script_encoding'
  WHEN list_bool_or(list_transform([{_list_sql(RELIGIOUS)}], lambda t: body = t OR (contains(body, t) AND size < length(t) + 5))) THEN 'domain_religious'
  WHEN marked AND body IN ({_list_sql(FUNCTION_WORDS)}) THEN 'function_word' WHEN size <= 2 AND letters = size THEN 'character_phonotactic' WHEN NOT marked AND size <= 5 AND letters = size THEN 'morphological_affix'
  WHEN marked OR size > 5 THEN 'content_word' ELSE 'morphological_affix' END"""


@query(MODEL_SQL + f" SELECT token, {CLASS_SQL} AS class FROM voc")
def token_classes(spark, sf_dir):
    """Class of each token of the vocabulary."""
    return counts(spark, sf_dir).select("token").distinct().select("token", token_class(F.col("token")).alias("class"))


@query(
    "WITH "
    + LABELLED_SQL
    + f", ws AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM lines), tk AS (SELECT '{MARK}' || word AS token FROM ws UNION SELECT word FROM ws UNION SELECT '{MARK}' || word || '{MARK}' FROM ws),"
    f" b AS (SELECT token, starts_with(token, '{MARK}') AS marked, regexp_replace(token, '^{MARK}', '') AS bare, lower(bare) AS body, length(bare) AS size, length(regexp_replace(bare, '[^\\p{{L}}]', '', 'g')) AS letters FROM tk), c AS (SELECT {WORD_CLASS_SQL} AS class, count(*) AS n FROM b GROUP BY ALL) SELECT class, n FROM c"
)
def word_classes(spark, sf_dir):
    """All eight classes, over the documents' words as marked, bare and joined tokens."""
    words = labelled(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    tokens = words.select(F.explode(F.array(F.concat(F.lit(MARK), "word"), "word", F.concat(F.lit(MARK), "word", F.lit(MARK)))).alias("token")).distinct()
    return tokens.groupBy(token_class(F.col("token")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    MODEL_SQL + f" SELECT CASE WHEN n_lines >= {CAP} THEN 'high' WHEN n_lines < {BAR} THEN 'low' ELSE 'mid' END AS level, {CLASS_SQL} AS class, count(*) AS n, round(sum(abs(p * ln(p / p_base))), 7) AS kl, round(sum(abs(p - p_base)), 7) AS delta FROM m JOIN base USING (token) GROUP BY ALL"
)
def class_divergence(spark, sf_dir):
    """Divergence from the base by token class and the labels' resource level."""
    rows = model(spark, sf_dir).join(F.broadcast(mo.base_model(counts(spark, sf_dir))), "token")
    level = F.when(F.col("n_lines") >= CAP, "high").when(F.col("n_lines") < BAR, "low").otherwise("mid")
    part = F.abs(F.col("p") * F.log(F.col("p") / F.col("p_base")))
    return rows.groupBy(level.alias("level"), token_class(F.col("token")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(part), 7).alias("kl"), F.round(F.sum(F.abs(F.col("p") - F.col("p_base"))), 7).alias("delta"))


@query(
    MODEL_SQL + ", v AS (SELECT y, any_value(n_lines) AS n_lines, sum(p * ln(p / p_base)) AS kl, corr(w, ln(p_base)) AS c FROM m JOIN base USING (token) GROUP BY y) SELECT CASE WHEN n_lines < 500 THEN '<500' WHEN n_lines < 1000 THEN '500--1k' WHEN n_lines < 12000 THEN '1k--12k' WHEN n_lines < 18000 THEN '12k--18k' WHEN n_lines < 35000 THEN '18k--35k' ELSE '35k+' END AS bin, count(*) AS labels, round(avg(kl), 6) AS mean_kl, round(median(kl), 6) AS median_kl, round(avg(c), 6) AS mean_corr FROM v GROUP BY bin"
)
def divergence_by_resource(spark, sf_dir):
    """Mean and median divergence by bin of lines."""
    from glossa.operators.metrics import resource_bin

    rows = with_lines(spark, sf_dir, d.against_base(model(spark, sf_dir), mo.base_model(counts(spark, sf_dir))))
    return rows.groupBy(resource_bin(F.col("n_lines")).alias("bin")).agg(F.count(F.lit(1)).alias("labels"), F.round(F.avg("kl"), 6).alias("mean_kl"), F.round(F.median("kl"), 6).alias("median_kl"), F.round(F.avg("corr"), 6).alias("mean_corr"))
