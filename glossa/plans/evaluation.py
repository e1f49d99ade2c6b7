"""Metric and comparison plans over the three systems' predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators import metrics as m
from glossa.plans.registry import query
from glossa.plans.tables import MODELS, SAMPLE_SQL, by_model, classes_sql, sample, summary_sql

LENGTH_SQL = "CASE WHEN text_length < 30 THEN '<30' WHEN text_length < 75 THEN '30--75' WHEN text_length < 150 THEN '75--150' WHEN text_length < 300 THEN '150--300' ELSE '300+' END"
RESOURCE_SQL = "CASE WHEN n_train < 500 THEN '<500' WHEN n_train < 1000 THEN '500--1k' WHEN n_train < 12000 THEN '1k--12k' WHEN n_train < 18000 THEN '12k--18k' WHEN n_train < 35000 THEN '18k--35k' ELSE '35k+' END"
RARE = 100  # labels with fewer lines are the tail


def long(spark, sf_dir: str) -> DataFrame:
    return by_model(sample(spark, sf_dir), "line_idx", "y", "script", "source", "text_length", "n_train")


def scores(spark, sf_dir: str) -> DataFrame:
    return m.class_scores(long(spark, sf_dir), ["model"])


def _r(c, places: int = 9):
    return F.round(c, places)


@query(SAMPLE_SQL + classes_sql() + summary_sql())
def metrics_overall(spark, sf_dir):
    """M1, M8: accuracy, micro-F1, macro-F1 and macro-FPR of each system."""
    return m.summary(scores(spark, sf_dir), ["model"])


@query(SAMPLE_SQL + classes_sql() + " SELECT model, label, support, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM pc")
def metrics_per_class(spark, sf_dir):
    """M2: precision, recall, F1 and support over the union of labels."""
    return scores(spark, sf_dir).select("model", "label", "support", "tp", "fp", "fn", _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"))


@query(SAMPLE_SQL + classes_sql() + " SELECT model, round(avg(f1), 9) AS union_macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM pc GROUP BY model")
def metrics_union(spark, sf_dir):
    """M3: macro-F1 over true and predicted labels, and F1 weighted by support."""
    return scores(spark, sf_dir).groupBy("model").agg(_r(F.avg("f1")).alias("union_macro_f1"), _r(F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


@query(SAMPLE_SQL + classes_sql() + ", e AS (SELECT y AS label, count(*) AS empty FROM l WHERE model = 'c' AND pred IS NULL GROUP BY y) SELECT label, support, tp, fp, fn, coalesce(empty, 0)::BIGINT AS empty FROM pc LEFT JOIN e USING (label) WHERE model = 'c'")
def metrics_empty_aware(spark, sf_dir):
    """M4: counts of a system with empty predictions: misses, but nobody's false positives."""
    rows = long(spark, sf_dir).filter("model = 'c'")
    pairs = m.confusion_pairs(rows, [])
    empty = pairs.filter("pred is null").select(F.col("y").alias("label"), F.col("n").alias("empty"))
    return m.class_counts(pairs, []).join(empty, "label", "left").select("label", "support", "tp", "fp", "fn", F.coalesce("empty", F.lit(0)).cast("long").alias("empty"))


KEPT = ["eng_Latn", "fra_Latn", "spa_Latn", "deu_Cyrl"]


@query(
    SAMPLE_SQL + ", k AS (SELECT * FROM l WHERE y IN ('eng_Latn', 'fra_Latn', 'spa_Latn', 'deu_Cyrl'))" + classes_sql(source="k")
    + ", o AS (SELECT model, count(*) FILTER (WHERE pred NOT IN ('eng_Latn', 'fra_Latn', 'spa_Latn', 'deu_Cyrl')) AS outside FROM k GROUP BY model)"
    + " SELECT model, label, support, tp, fp, fn, round(f1, 9) AS f1, outside FROM pc JOIN o USING (model) WHERE label IN ('eng_Latn', 'fra_Latn', 'spa_Latn', 'deu_Cyrl')"
)
def metrics_label_set(spark, sf_dir):
    """M5: metrics within a label set; predictions outside it are misses and are counted."""
    labels = spark.createDataFrame([(x,) for x in KEPT], "label string")
    rows = long(spark, sf_dir).join(F.broadcast(labels.withColumnRenamed("label", "y")), "y", "left_semi")
    outside = rows.groupBy("model").agg(F.count_if(~F.col("pred").isin(KEPT)).alias("outside"))
    inside = m.class_scores(rows, ["model"]).join(F.broadcast(labels), "label", "left_semi")
    return inside.join(F.broadcast(outside), "model").select("model", "label", "support", "tp", "fp", "fn", _r("f1").alias("f1"), "outside")


@query(
    SAMPLE_SQL + classes_sql()
    + ", n AS (SELECT model, sum(support) AS n FROM pc GROUP BY model) SELECT model, round(avg(fp::DOUBLE / (n - support)), 9) AS macro_fpr, round(100000 * avg(fp::DOUBLE / (n - support)), 6) AS fpr_e5 FROM pc JOIN n USING (model) WHERE support > 0 GROUP BY model"
)
def metrics_macro_fpr(spark, sf_dir):
    """M6: macro-FPR with the instrument's n: TN = n - support - FP."""
    total = F.sum("support").over(Window.partitionBy("model"))
    rows = scores(spark, sf_dir).withColumn("fpr", m.ratio(F.col("fp"), total - F.col("support"))).filter("support > 0")
    return rows.groupBy("model").agg(_r(F.avg("fpr")).alias("macro_fpr"), _r(1e5 * F.avg("fpr"), 6).alias("fpr_e5"))


STRATUM_SQL = f", t AS (SELECT *, CASE WHEN n_train < {RARE} THEN 'tail' ELSE 'head' END AS stratum FROM l)"


@query(
    SAMPLE_SQL + STRATUM_SQL + classes_sql("model, stratum", "t", "w") + classes_sql() + ", st AS (SELECT DISTINCT y AS label, stratum FROM t)"
    + ", g AS (SELECT model, stratum, avg(f1) AS global_f1 FROM pc JOIN st USING (label) WHERE support > 0 GROUP BY ALL)"
    + " SELECT model, stratum, round(avg(w.f1), 9) AS within_f1, round(any_value(global_f1), 9) AS global_f1 FROM w JOIN g USING (model, stratum) WHERE w.support > 0 GROUP BY model, stratum"
)
def metrics_within_stratum(spark, sf_dir):
    """M7: macro-F1 of a stratum's lines alone against the mean of its labels' F1 on all lines."""
    stratum = F.when(F.col("n_train") < RARE, "tail").otherwise("head").alias("stratum")
    rows = long(spark, sf_dir).withColumn("stratum", stratum)
    within = m.class_scores(rows, ["model", "stratum"]).filter("support > 0").groupBy("model", "stratum").agg(_r(F.avg("f1")).alias("within_f1"))
    of = rows.select(F.col("y").alias("label"), "stratum").distinct()
    whole = m.class_scores(rows, ["model"]).filter("support > 0").join(F.broadcast(of), "label").groupBy("model", "stratum").agg(_r(F.avg("f1")).alias("global_f1"))
    return within.join(whole, ["model", "stratum"])


def _binned_sql(expression: str) -> str:
    return (
        SAMPLE_SQL + f", t AS (SELECT *, {expression} AS bin FROM l)" + classes_sql("model, bin", "t", "w")
        + f", d AS (SELECT bin, count(DISTINCT y) AS labels FROM t GROUP BY bin), r AS ({summary_sql('model, bin', 'w')}) SELECT r.*, labels FROM r JOIN d USING (bin)"
    )


def _binned(spark, sf_dir, bin_column) -> DataFrame:
    rows = long(spark, sf_dir).withColumn("bin", bin_column)
    classes = m.class_scores(rows, ["model", "bin"])
    labels = classes.filter("support > 0").groupBy("model", "bin").agg(F.count(F.lit(1)).alias("labels"))
    return m.summary(classes, ["model", "bin"]).join(labels, ["model", "bin"])


@query(_binned_sql(LENGTH_SQL))
def metrics_by_length(spark, sf_dir):
    """M9: metrics by bin of text length, with the number of true labels; empty bins have no row."""
    return _binned(spark, sf_dir, m.length_bin(F.col("text_length")))


@query(_binned_sql(RESOURCE_SQL))
def metrics_by_resource(spark, sf_dir):
    """M9: metrics by bin of training lines."""
    return _binned(spark, sf_dir, m.resource_bin(F.col("n_train")))


@query(_binned_sql("CASE WHEN script IN (" + ", ".join(f"'{x}'" for x in m.TOP_SCRIPTS) + ") THEN script ELSE 'Other' END"))
def metrics_by_script(spark, sf_dir):
    """Metrics by script, those outside a fixed list of ten as one group."""
    return _binned(spark, sf_dir, F.when(F.col("script").isin(m.TOP_SCRIPTS), F.col("script")).otherwise("Other"))


@query(
    SAMPLE_SQL + ", e AS (SELECT *, y IS DISTINCT FROM pred_a AS wa, y IS DISTINCT FROM pred_b AS wb, y IS DISTINCT FROM pred_c AS wc FROM s)"
    " SELECT count(*) AS n, count(*) FILTER (WHERE wa OR wb OR wc) AS any_wrong, count(*) FILTER (WHERE wa AND wb AND wc) AS all_wrong,"
    " count(*) FILTER (WHERE wa AND wb AND wc AND pred_a IS NOT DISTINCT FROM pred_b AND pred_a IS NOT DISTINCT FROM pred_c) AS all_same_wrong,"
    " count(*) FILTER (WHERE wa) AS wrong_a, count(*) FILTER (WHERE wb) AS wrong_b, count(*) FILTER (WHERE wc) AS wrong_c,"
    " count(*) FILTER (WHERE wa AND NOT wb AND NOT wc) AS only_a, count(*) FILTER (WHERE wb AND NOT wa AND NOT wc) AS only_b, count(*) FILTER (WHERE wc AND NOT wa AND NOT wb) AS only_c FROM e"
)
def compare_error_overlap(spark, sf_dir):
    """How the systems' errors overlap."""
    return m.error_overlap(sample(spark, sf_dir), MODELS)


@query(
    SAMPLE_SQL + classes_sql("model, script") + f", r AS ({summary_sql('model, script')}), k AS (SELECT *, row_number() OVER (PARTITION BY script ORDER BY accuracy DESC, model) AS ka, row_number() OVER (PARTITION BY script ORDER BY macro_f1 DESC, model) AS kf FROM r)"
    " SELECT script, max(model) FILTER (WHERE ka = 1) AS best_acc, max(accuracy) FILTER (WHERE ka = 1) AS acc, round(max(accuracy) FILTER (WHERE ka = 1) - max(accuracy) FILTER (WHERE ka = 2), 8) AS acc_delta,"
    " max(model) FILTER (WHERE kf = 1) AS best_f1, max(macro_f1) FILTER (WHERE kf = 1) AS f1, round(max(macro_f1) FILTER (WHERE kf = 1) - max(macro_f1) FILTER (WHERE kf = 2), 8) AS f1_delta FROM k GROUP BY script"
)
def compare_script_winner(spark, sf_dir):
    """Best and second system of each script by accuracy and by macro-F1, the earlier name on ties."""
    rows = m.summary(m.class_scores(long(spark, sf_dir), ["model", "script"]), ["model", "script"])
    for kind, column in (("acc", "accuracy"), ("f1", "macro_f1")):
        rows = rows.withColumn(f"rank_{kind}", F.row_number().over(Window.partitionBy("script").orderBy(F.desc(column), "model")))
    out = []
    for kind, column in (("acc", "accuracy"), ("f1", "macro_f1")):
        first, second = (F.max(F.when(F.col(f"rank_{kind}") == k, F.col(column))) for k in (1, 2))
        out += [F.max(F.when(F.col(f"rank_{kind}") == 1, F.col("model"))).alias(f"best_{kind}"), first.alias(kind), _r(first - second, 8).alias(f"{kind}_delta")]
    return rows.groupBy("script").agg(*out)


@query(
    SAMPLE_SQL + ", e AS (SELECT y, count(*) AS n, avg((y IS DISTINCT FROM pred_a)::INT) AS ea, avg((y IS DISTINCT FROM pred_b)::INT) AS eb, avg((y IS DISTINCT FROM pred_c)::INT) AS ec FROM s GROUP BY y HAVING count(*) >= 20),"
    " g AS (SELECT y, n, round(ea, 9) AS err_a, round(eb, 9) AS err_b, round(ec, 9) AS err_c, round(ea - least(eb, ec), 9) AS gap FROM e),"
    " r AS (SELECT *, row_number() OVER (ORDER BY gap DESC, y) AS worse, row_number() OVER (ORDER BY gap, y) AS better FROM g)"
    " SELECT 'worse' AS side, y, n, err_a, err_b, err_c, gap FROM r WHERE worse <= 15 UNION ALL SELECT 'better', y, n, err_a, err_b, err_c, gap FROM r WHERE better <= 15"
)
def compare_divergences(spark, sf_dir):
    """Labels where system a errs most above and most below the best of the others (20 lines at least, 15 a side)."""
    error = lambda c: F.avg((~F.col("y").eqNullSafe(F.col(f"pred_{c}"))).cast("int"))
    rows = sample(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"), *(error(c).alias(c) for c in MODELS)).filter("n >= 20")
    rows = rows.select("y", "n", *(_r(c).alias(f"err_{c}") for c in MODELS), _r(F.col("a") - F.least("b", "c")).alias("gap"))
    sides = [m.top(rows, [], [order, F.col("y")], 15).select(F.lit(side).alias("side"), "*") for side, order in (("worse", F.desc("gap")), ("better", F.asc("gap")))]
    return sides[0].union(sides[1])


CLUSTER = ["eng_Latn", "fra_Latn", "deu_Latn", "spa_Latn"]


@query(
    SAMPLE_SQL + " SELECT y AS true_label, " + ", ".join(f"count(*) FILTER (WHERE pred = '{c}') AS {c}" for c in CLUSTER)
    + f" FROM l WHERE model = 'a' AND y IN {tuple(CLUSTER)} AND pred IN {tuple(CLUSTER)} GROUP BY y"
)
def confusion_cluster(spark, sf_dir):
    """Confusion matrix of a cluster of labels, cells with both labels in it."""
    pairs = m.confusion_pairs(long(spark, sf_dir).filter("model = 'a'"), []).filter(F.col("y").isin(CLUSTER) & F.col("pred").isin(CLUSTER))
    return pairs.groupBy(F.col("y").alias("true_label")).pivot("pred", CLUSTER).agg(F.sum("n")).na.fill(0)


@query(
    SAMPLE_SQL + " SELECT script, CASE WHEN y = pred_a AND y = pred_b THEN 'correct' WHEN y = pred_b THEN 'fixed' WHEN y = pred_a THEN 'introduced' WHEN pred_a = pred_b THEN 'same_wrong' ELSE 'other_wrong' END AS kind, count(*) AS n FROM s GROUP BY ALL"
)
def compare_transition(spark, sf_dir):
    """Shared, fixed and introduced errors from system a to b, by script."""
    kind = m.transition(F.col("pred_a"), F.col("pred_b"), F.col("y")).alias("kind")
    return sample(spark, sf_dir).groupBy("script", kind).agg(F.count(F.lit(1)).alias("n"))


@query(
    SAMPLE_SQL + ", f AS (SELECT model, pred AS absorber, y AS origin, count(*) AS n FROM l WHERE pred <> y GROUP BY ALL),"
    " r AS (SELECT *, sum(n) OVER (PARTITION BY model, absorber) AS absorbed, row_number() OVER (PARTITION BY model, absorber ORDER BY n DESC, origin) AS rank FROM f)"
    " SELECT model, absorber, origin, n, absorbed::BIGINT AS absorbed, rank FROM r WHERE rank <= 3"
)
def flow_false_positives(spark, sf_dir):
    """Where each label's false positives come from: its total and three largest origins."""
    flows = m.confusion_pairs(long(spark, sf_dir), ["model"]).filter("pred <> y").select("model", F.col("pred").alias("absorber"), F.col("y").alias("origin"), "n")
    flows = flows.withColumn("absorbed", F.sum("n").over(Window.partitionBy("model", "absorber")))
    return m.top(flows, ["model", "absorber"], [F.desc("n"), F.col("origin")], 3)


@query(
    SAMPLE_SQL + " SELECT label, count(*) FILTER (WHERE y <> label AND pred_b = label AND pred_a IS DISTINCT FROM label) AS new_fp, count(*) FILTER (WHERE y <> label AND pred_a = label AND pred_b IS DISTINCT FROM label) AS removed_fp,"
    " count(*) FILTER (WHERE y = label AND pred_a = label AND pred_b IS DISTINCT FROM label) AS lost_recall FROM s, (SELECT DISTINCT y AS label FROM s) GROUP BY label"
)
def flow_difference(spark, sf_dir):
    """New and removed false positives and lost recall of each label from system a to b.

    Each line counts for the labels it names (at most three), so lines aren't paired with all labels.
    """
    rows = sample(spark, sf_dir).groupBy("y", "pred_a", "pred_b").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("label", F.explode(F.array_distinct(F.array("y", "pred_a", "pred_b"))))
    is_a, is_b, own = (F.col(c).eqNullSafe(F.col("label")) for c in ("pred_a", "pred_b", "y"))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    flows = rows.groupBy("label").agg(count(~own & is_b & ~is_a).alias("new_fp"), count(~own & is_a & ~is_b).alias("removed_fp"), count(own & is_a & ~is_b).alias("lost_recall"), F.max(own.cast("int")).alias("is_true"))
    return flows.filter("is_true = 1").drop("is_true")


@query(
    SAMPLE_SQL + f" SELECT model, count(*) AS residual, round(avg((n_train >= {RARE})::INT), 9) AS head_share, count(*) FILTER (WHERE split_part(y, '_', 1) = split_part(pred, '_', 1)) AS script_only FROM l WHERE pred IS NOT NULL AND pred <> y GROUP BY model"
)
def residual_shares(spark, sf_dir):
    """Of the errors left, the share with a frequent true label, and those in script only."""
    wrong = long(spark, sf_dir).filter("pred is not null and pred <> y")
    same = F.substring_index("y", "_", 1) == F.substring_index("pred", "_", 1)
    return wrong.groupBy("model").agg(F.count(F.lit(1)).alias("residual"), _r(F.avg((F.col("n_train") >= RARE).cast("int"))).alias("head_share"), F.count_if(same).alias("script_only"))


@query(SAMPLE_SQL + classes_sql() + " SELECT model, regexp_replace(label, '^.*_', '') AS script, count(*) AS labels, round(avg(f1), 9) AS mean_f1 FROM pc WHERE support > 0 GROUP BY ALL")
def breakdown_by_script(spark, sf_dir):
    """Mean F1 of the labels of each script."""
    rows = scores(spark, sf_dir).filter("support > 0")
    return rows.groupBy("model", F.substring_index("label", "_", -1).alias("script")).agg(F.count(F.lit(1)).alias("labels"), _r(F.avg("f1")).alias("mean_f1"))


MACROS = {"eng": "grm", "deu": "grm", "fra": "rom", "spa": "rom"}
MACRO_SQL = "(VALUES ('eng', 'grm'), ('deu', 'grm'), ('fra', 'rom'), ('spa', 'rom')) m(member, macro)"


def macros(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(MACROS.items()), "member string, macro string"))


EQUIVALENT = ("tgl", "fil")  # fixed value: a tag and the one label that is right for it besides


@query(
    SAMPLE_SQL + f", g AS (SELECT model, CASE WHEN source = 'src2' THEN macro ELSE split_part(y, '_', 1) END AS gold, split_part(pred, '_', 1) AS own FROM l LEFT JOIN {MACRO_SQL} ON split_part(y, '_', 1) = member)"
    f" SELECT model, round(avg(coalesce((gold = own OR macro = gold OR (gold = 'tgl' AND own = 'fil'))::INT, 0)), 9) AS macro_aware, round(avg(coalesce((gold = own)::INT, 0)), 9) AS strict FROM g LEFT JOIN {MACRO_SQL} ON own = member GROUP BY model"
)
def macro_aware_accuracy(spark, sf_dir):
    """Right is the tag itself, a member of the tag's macrolanguage, or its equivalent; one source's tags are macrolanguages."""
    gold_macro = macros(spark).select(F.col("member").alias("iso"), F.col("macro").alias("gold_macro"))
    rows = long(spark, sf_dir).select("model", "source", F.substring_index("y", "_", 1).alias("iso"), F.substring_index("pred", "_", 1).alias("member")).join(gold_macro, "iso", "left").join(macros(spark), "member", "left")
    gold = F.when(F.col("source") == "src2", F.col("gold_macro")).otherwise(F.col("iso"))
    aware, strict = m.macro_correct(F.col("member"), F.col("macro"), gold, EQUIVALENT), F.coalesce(gold == F.col("member"), F.lit(False))
    return rows.groupBy("model").agg(_r(F.avg(aware.cast("int"))).alias("macro_aware"), _r(F.avg(strict.cast("int"))).alias("strict"))


@query(
    SAMPLE_SQL + f", t AS (SELECT model, split_part(l.y, '_', 1) AS y, CASE WHEN split_part(l.y, '_', 1) = split_part(pred, '_', 1) THEN split_part(pred, '_', 1) ELSE coalesce(macro, split_part(pred, '_', 1)) END AS pred"
    f" FROM l LEFT JOIN {MACRO_SQL} ON split_part(pred, '_', 1) = member)" + classes_sql(source="t") + " SELECT model, round(avg(f1), 9) AS tag_macro_f1 FROM pc WHERE support > 0 GROUP BY model"
)
def tag_macro_f1(spark, sf_dir):
    """Macro-F1 of tags, wrong predictions taken to their macrolanguage."""
    rows = long(spark, sf_dir).select("model", F.substring_index("y", "_", 1).alias("y"), F.substring_index("pred", "_", 1).alias("member")).join(macros(spark), "member", "left")
    rows = rows.withColumn("pred", F.when(F.col("y") == F.col("member"), F.col("member")).otherwise(F.coalesce("macro", "member")))
    return m.class_scores(rows, ["model"]).filter("support > 0").groupBy("model").agg(_r(F.avg("f1")).alias("tag_macro_f1"))


@query(
    SAMPLE_SQL + ", c AS (SELECT y AS pred, count(*) AS n_pred FROM s GROUP BY y), w AS (SELECT model, l.y, pred, n_train, coalesce(n_pred, 0) AS n_pred FROM l LEFT JOIN c USING (pred) WHERE pred IS NOT NULL AND l.y <> pred)"
    " SELECT model, round(avg((n_pred < n_train)::INT), 9) AS rarer_share, round(max(k)::DOUBLE / any_value(t), 9) AS magnet_share FROM (SELECT *, count(*) OVER (PARTITION BY model, pred) AS k, count(*) OVER (PARTITION BY model) AS t FROM w) GROUP BY model"
)
def resource_asymmetry(spark, sf_dir):
    """Share of errors that go to a rarer label than the true one, and the part that the largest magnet draws."""
    rows = long(spark, sf_dir)
    counts = rows.filter("model = 'a'").groupBy(F.col("y").alias("pred")).agg(F.count(F.lit(1)).alias("n_pred"))
    wrong = rows.filter("pred is not null and y <> pred").groupBy("model", "pred", "n_train").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(counts), "pred", "left")
    rarer = F.when(F.coalesce("n_pred", F.lit(0)) < F.col("n_train"), F.col("n")).otherwise(0)
    by_pred = wrong.groupBy("model", "pred").agg(F.sum(rarer).alias("rarer"), F.sum("n").alias("k"))
    return by_pred.groupBy("model").agg(_r(F.sum("rarer") / F.sum("k")).alias("rarer_share"), _r(F.max("k") / F.sum("k")).alias("magnet_share"))


@query(
    "WITH r AS (SELECT n_chars AS v, quality = 1 AS p, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS rk FROM documents JOIN labels USING (doc_id))"
    " SELECT count(*) FILTER (WHERE p) AS n_pos, count(*) FILTER (WHERE NOT p) AS n_neg, round((sum(rk) FILTER (WHERE p) - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 9) AS auc FROM r"
)
def rank_auc(spark, sf_dir):
    """Area under the curve of text length as a sign of quality."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return m.rank_auc(rows.withColumn("good", F.col("quality") == 1), "n_chars", "good")


WIDE_SQL = SAMPLE_SQL + classes_sql() + ", wide AS (SELECT label, max(support) AS support, max(f1) FILTER (WHERE model = 'a') AS f1_a, max(f1) FILTER (WHERE model = 'b') AS f1_b, max(f1) FILTER (WHERE model = 'c') AS f1_c FROM pc GROUP BY label HAVING max(support) > 0)"


def wide_f1(spark, sf_dir) -> DataFrame:
    """label, support, n_train-like group and F1 of each system, for true labels."""
    f1 = lambda c: F.coalesce(F.max(F.when(F.col("model") == c, F.col("f1"))), F.lit(0.0)).alias(f"f1_{c}")
    return scores(spark, sf_dir).groupBy("label").agg(F.max("support").alias("support"), *map(f1, MODELS)).filter("support > 0")


@query(
    WIDE_SQL + f" SELECT CASE WHEN support < {RARE} THEN 'tail' ELSE 'head' END AS grp, count(*) AS labels, round(avg(greatest(f1_a, f1_b, f1_c)), 9) AS oracle, round(avg(greatest(f1_a, f1_b, f1_c)) - greatest(avg(f1_a), avg(f1_b), avg(f1_c)), 9) AS gain FROM wide GROUP BY grp"
)
def oracle_bound(spark, sf_dir):
    """Mean of each label's best F1 over systems, and its gain over the best single system, by group."""
    best = F.avg(F.greatest("f1_a", "f1_b", "f1_c"))
    group = F.when(F.col("support") < RARE, "tail").otherwise("head").alias("grp")
    return wide_f1(spark, sf_dir).groupBy(group).agg(F.count(F.lit(1)).alias("labels"), _r(best).alias("oracle"), _r(best - F.greatest(*(F.avg(f"f1_{c}") for c in MODELS))).alias("gain"))


@query(
    WIDE_SQL + f", g AS (SELECT CASE WHEN support < {RARE} THEN 'tail' ELSE 'head' END AS grp, model, avg(f1) AS f1 FROM (SELECT support, 'a' AS model, f1_a AS f1 FROM wide UNION ALL SELECT support, 'b', f1_b FROM wide UNION ALL SELECT support, 'c', f1_c FROM wide) GROUP BY ALL),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, model) AS k FROM g) SELECT grp, max(model) FILTER (WHERE k = 1) AS leader, max(model) FILTER (WHERE k = 2) AS runner_up, round(max(f1) FILTER (WHERE k = 1) - max(f1) FILTER (WHERE k = 2), 9) AS lead FROM r GROUP BY grp"
)
def combined_evidence(spark, sf_dir):
    """The leading system of each group of labels, the runner-up and the lead."""
    group = F.when(F.col("support") < RARE, "tail").otherwise("head").alias("grp")
    rows = wide_f1(spark, sf_dir).select(group, F.expr("stack(3, 'a', f1_a, 'b', f1_b, 'c', f1_c) AS (model, f1)")).groupBy("grp", "model").agg(F.avg("f1").alias("f1"))
    w = Window.partitionBy("grp").orderBy(F.desc("f1"), "model")
    rows = rows.withColumns({"k": F.row_number().over(w), "runner_up": F.lead("model").over(w), "second": F.lead("f1").over(w)})
    return rows.filter("k = 1").select("grp", F.col("model").alias("leader"), "runner_up", _r(F.col("f1") - F.col("second")).alias("lead"))


@query(
    SAMPLE_SQL + ", e AS (SELECT y, avg((y IS DISTINCT FROM pred_a)::INT) AS ea, avg((y IS DISTINCT FROM pred_b)::INT) AS eb, avg((y IS DISTINCT FROM pred_c)::INT) AS ec FROM s GROUP BY y HAVING count(*) >= 10)"
    " SELECT round(corr(ea, eb), 8) AS a_b, round(corr(ea, ec), 8) AS a_c, round(corr(eb, ec), 8) AS b_c FROM e"
)
def error_correlation(spark, sf_dir):
    """Pearson correlation of the systems' error rates by label (10 lines at least)."""
    error = lambda c: F.avg((~F.col("y").eqNullSafe(F.col(f"pred_{c}"))).cast("int")).alias(f"e{c}")
    rows = sample(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"), *map(error, MODELS)).filter("n >= 10")
    return rows.agg(*(_r(F.corr(f"e{x}", f"e{y}"), 8).alias(f"{x}_{y}") for x, y in (("a", "b"), ("a", "c"), ("b", "c"))))


@query(SAMPLE_SQL + ", p AS (SELECT model, y, pred, count(*) AS n FROM l WHERE pred <> y GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, y, pred) AS rank FROM p) SELECT * FROM r WHERE rank <= 30")
def top_confusions(spark, sf_dir):
    """The 30 commonest confusions of each system."""
    return m.top(m.confusion_pairs(long(spark, sf_dir), ["model"]).filter("pred <> y"), ["model"], [F.desc("n"), F.col("y"), F.col("pred")], 30)


@query(
    WIDE_SQL + " SELECT regexp_replace(label, '^.*_', '') AS category, count(*) AS labels, round(sum(f1_b - f1_a) / (SELECT count(*) FROM wide), 9) AS part FROM wide GROUP BY category"
)
def delta_decomposition(spark, sf_dir):
    """Parts of the change in macro-F1 from system a to b by category; they sum to the whole."""
    rows = wide_f1(spark, sf_dir)
    parts = rows.groupBy(F.substring_index("label", "_", -1).alias("category")).agg(F.count(F.lit(1)).alias("labels"), F.sum(F.col("f1_b") - F.col("f1_a")).alias("total"))
    return parts.select("category", "labels", _r(F.col("total") / F.sum("labels").over(Window.partitionBy())).alias("part"))


@query(
    SAMPLE_SQL + classes_sql() + ", r AS (SELECT model, label, fp, row_number() OVER (PARTITION BY model ORDER BY fp DESC, label) AS rank, sum(fp) OVER (PARTITION BY model) AS total FROM pc)"
    " SELECT model, rank, label, fp, round(sum(fp) OVER (PARTITION BY model ORDER BY rank)::DOUBLE / nullif(total, 0), 9) AS share FROM r"
)
def fp_concentration(spark, sf_dir):
    """Running share of all false positives that the top labels receive."""
    w = Window.partitionBy("model").orderBy(F.desc("fp"), "label")
    rows = scores(spark, sf_dir).select("model", "label", "fp", F.row_number().over(w).alias("rank"), F.sum("fp").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("fp").over(Window.partitionBy("model")).alias("total"))
    return rows.select("model", "rank", "label", "fp", _r(F.try_divide(F.col("upto"), F.col("total"))).alias("share"))


@query(SAMPLE_SQL + classes_sql() + " SELECT model, round(avg(f1), 9) AS macro_f1, round(avg(2 * recall / (1 + recall)), 9) AS precision_fixed FROM pc WHERE support > 0 GROUP BY model")
def precision_fixed(spark, sf_dir):
    """Macro-F1 if every precision were 1."""
    return scores(spark, sf_dir).filter("support > 0").groupBy("model").agg(_r(F.avg("f1")).alias("macro_f1"), _r(F.avg(2 * F.col("recall") / (1 + F.col("recall")))).alias("precision_fixed"))


@query(
    SAMPLE_SQL + classes_sql() + ", d AS (SELECT label, a.support, round(a.recall - b.recall, 9) AS recall_drop, round(a.precision - b.precision, 9) AS precision_drop FROM pc a JOIN pc b USING (label) WHERE a.model = 'a' AND b.model = 'b' AND a.support > 0),"
    " u AS (SELECT label, support, 'recall' AS kind, recall_drop AS drop FROM d UNION ALL SELECT label, support, 'precision', precision_drop FROM d),"
    " r AS (SELECT *, support >= 10 AS supported, row_number() OVER (PARTITION BY kind, support >= 10 ORDER BY drop DESC, label) AS rank FROM u WHERE drop > 0.05) SELECT kind, supported, rank, label, support, drop FROM r WHERE rank <= 5"
)
def top_losers(spark, sf_dir):
    """The five labels that lose most recall or precision (over 0.05) from system a to b; those with few lines apart."""
    rows = scores(spark, sf_dir)
    a, b = (rows.filter(F.col("model") == c).select("label", *(F.col(x).alias(f"{x}_{c}") for x in ("support", "recall", "precision"))) for c in ("a", "b"))
    both = a.join(b, "label").filter("support_a > 0")
    drops = both.select("label", F.col("support_a").alias("support"), F.expr("stack(2, 'recall', round(recall_a - recall_b, 9), 'precision', round(precision_a - precision_b, 9)) AS (kind, drop)"))
    drops = drops.filter("drop > 0.05").withColumn("supported", F.col("support") >= 10)
    return m.top(drops, ["kind", "supported"], [F.desc("drop"), F.col("label")], 5)


@query(
    SAMPLE_SQL + " SELECT count(*) FILTER (WHERE pred_a IS DISTINCT FROM pred_b) AS changed, count(*) FILTER (WHERE pred_a IS DISTINCT FROM pred_b AND y = pred_b) AS corrected, count(*) FILTER (WHERE pred_a IS DISTINCT FROM pred_b AND y = pred_a) AS broken,"
    " corrected - broken AS net FROM s"
)
def changed_predictions(spark, sf_dir):
    """Predictions changed from system a to b, corrected, broken and net."""
    changed = ~F.col("pred_a").eqNullSafe(F.col("pred_b"))
    out = sample(spark, sf_dir).agg(F.count_if(changed).alias("changed"), F.count_if(changed & (F.col("y") == F.col("pred_b"))).alias("corrected"), F.count_if(changed & (F.col("y") == F.col("pred_a"))).alias("broken"))
    return out.withColumn("net", F.col("corrected") - F.col("broken"))


@query(
    WIDE_SQL + ", g AS (SELECT *, greatest(f1_a, f1_b, f1_c) AS top, (f1_a = top)::INT + (f1_b = top)::INT + (f1_c = top)::INT AS ties FROM (SELECT label, round(f1_a, 9) AS f1_a, round(f1_b, 9) AS f1_b, round(f1_c, 9) AS f1_c FROM wide))"
    " SELECT count(*) FILTER (WHERE ties > 1) AS tied, count(*) FILTER (WHERE ties = 1 AND f1_a = top) AS best_a, count(*) FILTER (WHERE ties = 1 AND f1_b = top) AS best_b, count(*) FILTER (WHERE ties = 1 AND f1_c = top) AS best_c FROM g"
)
def unique_best(spark, sf_dir):
    """On how many labels each system alone is best; ties are counted apart."""
    rows = wide_f1(spark, sf_dir).select(*(_r(f"f1_{c}").alias(c) for c in MODELS)).withColumn("top", F.greatest(*MODELS))
    ties = sum(((F.col(c) == F.col("top")).cast("int") for c in MODELS), F.lit(0))
    return rows.agg(F.count_if(ties > 1).alias("tied"), *(F.count_if((ties == 1) & (F.col(c) == F.col("top"))).alias(f"best_{c}") for c in MODELS))


@query(
    SAMPLE_SQL + " SELECT model, cluster, count(*) AS n, round(avg(coalesce((y = pred)::INT, 0)), 9) AS accuracy FROM l JOIN (VALUES ('germanic', 'eng_Latn'), ('germanic', 'deu_Latn'), ('romance', 'fra_Latn'), ('romance', 'spa_Latn')) c(cluster, y) USING (y) GROUP BY ALL"
)
def cluster_accuracy(spark, sf_dir):
    """Accuracy of each system within clusters of labels."""
    clusters = spark.createDataFrame([("germanic", "eng_Latn"), ("germanic", "deu_Latn"), ("romance", "fra_Latn"), ("romance", "spa_Latn")], "cluster string, y string")
    rows = long(spark, sf_dir).join(F.broadcast(clusters), "y")
    return rows.groupBy("model", "cluster").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(F.coalesce((F.col("y") == F.col("pred")).cast("int"), F.lit(0)))).alias("accuracy"))


@query(
    SAMPLE_SQL + f", t AS (SELECT model, {LENGTH_SQL} AS bin, coalesce((y = pred)::INT, 0) AS ok FROM l) SELECT model, round(avg(ok) FILTER (WHERE bin = '<30'), 9) AS below_30, round(avg(ok) FILTER (WHERE bin = '30--75'), 9) AS below_75, round(avg(ok) FILTER (WHERE bin = '75--150'), 9) AS below_150, round(avg(ok) FILTER (WHERE bin = '150--300'), 9) AS below_300, round(avg(ok) FILTER (WHERE bin = '300+'), 9) AS from_300 FROM t GROUP BY model"
)
def accuracy_grid(spark, sf_dir):
    """Accuracy by system and bin of length as a grid; an empty bin is null."""
    rows = long(spark, sf_dir).select("model", m.length_bin(F.col("text_length")).alias("bin"), F.coalesce((F.col("y") == F.col("pred")).cast("int"), F.lit(0)).alias("ok"))
    grid = rows.groupBy("model").pivot("bin", m.LENGTH_LABELS).agg(_r(F.avg("ok")))
    return grid.toDF("model", "below_30", "below_75", "below_150", "below_300", "from_300")


@query(
    SAMPLE_SQL + " SELECT script, count(*) FILTER (WHERE y IS DISTINCT FROM pred_a) AS base_errors, count(*) FILTER (WHERE y = pred_a) AS base_correct,"
    " round(count(*) FILTER (WHERE y IS DISTINCT FROM pred_a AND y = pred_b)::DOUBLE / nullif(base_errors, 0), 9) AS fix_rate, round(count(*) FILTER (WHERE y = pred_a AND y IS DISTINCT FROM pred_b)::DOUBLE / nullif(base_correct, 0), 9) AS introduce_rate FROM s GROUP BY script"
)
def conditional_rates(spark, sf_dir):
    """How often system b repairs an error of a, and spoils what a has right, by script."""
    good_a, good_b = (F.col("y").eqNullSafe(F.col(c)) for c in ("pred_a", "pred_b"))
    return sample(spark, sf_dir).groupBy("script").agg(
        F.count_if(~good_a).alias("base_errors"), F.count_if(good_a).alias("base_correct"),
        _r(F.try_divide(F.count_if(~good_a & good_b), F.count_if(~good_a))).alias("fix_rate"), _r(F.try_divide(F.count_if(good_a & ~good_b), F.count_if(good_a))).alias("introduce_rate"),
    )


@query(SAMPLE_SQL + ", p AS (SELECT y, pred, count(*) AS n FROM l WHERE model = 'b' AND pred IS NOT NULL GROUP BY ALL) SELECT y, pred, round(n::DOUBLE / sum(n) OVER (PARTITION BY y), 9) AS share FROM p")
def confusion_normalised(spark, sf_dir):
    """Confusion matrix with rows that sum to 1."""
    pairs = m.confusion_pairs(long(spark, sf_dir).filter("model = 'b' and pred is not null"), [])
    return pairs.select("y", "pred", _r(F.col("n") / F.sum("n").over(Window.partitionBy("y"))).alias("share"))


@query(
    SAMPLE_SQL + f", t AS (SELECT *, {LENGTH_SQL} AS bin FROM l) SELECT model, coalesce(bin, 'All') AS bin, count(*) AS n, round(avg(coalesce((y = pred)::INT, 0)), 9) AS accuracy FROM t GROUP BY GROUPING SETS ((model), (model, bin))"
)
def accuracy_with_total(spark, sf_dir):
    """2.9: grouping sets, each bin and all together."""
    rows = long(spark, sf_dir).withColumn("bin", m.length_bin(F.col("text_length"))).withColumn("ok", F.coalesce((F.col("y") == F.col("pred")).cast("int"), F.lit(0)))
    sets = rows.groupingSets([["model"], ["model", "bin"]], "model", "bin").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("ok")).alias("accuracy"))
    return sets.select("model", F.coalesce("bin", F.lit("All")).alias("bin"), "n", "accuracy")
