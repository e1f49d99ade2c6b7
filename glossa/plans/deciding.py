"""Scoring and decision plans: candidates of every line under the smoothed models, then rules over them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators import decisions as dc
from glossa.operators import model as mo
from glossa.operators import sampling as sp
from glossa.operators import segment as sg
from glossa.operators import weights as w
from glossa.plans.modelling import BAR, CAP, MODEL_SQL, counts, model, with_lines
from glossa.plans.registry import query
from glossa.plans.tables import labelled
from glossa.sources.store import shared, table

SCORE_SQL = (
    MODEL_SQL.replace("ch AS (SELECT y, unnest", "ch AS (SELECT line_idx, y, unnest")
    + ", lc AS (SELECT line_idx, y, token, count(*) AS n FROM ch WHERE token <> '' GROUP BY ALL), sc AS (SELECT c.line_idx, c.y, m.y AS label, any_value(m.n_lines) AS n_lines, round(sum(c.n * m.w), 4) AS score, sum(c.n)::BIGINT AS n_tokens FROM lc c JOIN m USING (token) GROUP BY ALL),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY line_idx ORDER BY score DESC, label) AS r FROM sc),"
    " cd AS (SELECT line_idx, any_value(y) AS y, max(label) FILTER (WHERE r = 1) AS first, max(label) FILTER (WHERE r = 2) AS second, round(max(score) FILTER (WHERE r = 1) - max(score) FILTER (WHERE r = 2), 4) AS gap, max(score) FILTER (WHERE r = 1) AS s1 FROM rk GROUP BY line_idx)"
)


def candidates(spark, sf_dir: str, k: int | None = 5, rows: DataFrame | None = None, **options) -> DataFrame:
    """line_idx, y, cands and own_lines of every line that has a token: one pass of the kernel under all labels."""
    lines = labelled(spark, sf_dir)
    own = lines.groupBy("y").agg(F.count(F.lit(1)).alias("own_lines"))
    scored = sg.score_lines(lines.select("line_idx", "y", "text"), model(spark, sf_dir) if rows is None else rows, k, **options)
    return scored.filter("status = 'SCORED'").drop("status").join(F.broadcast(own), "y")


def stored(spark, sf_dir: str, **options) -> DataFrame:
    """The candidates, scored once and written, for rules that read them several times."""
    path = shared(spark, "candidates")
    candidates(spark, sf_dir, **options).write.parquet(path)
    return spark.read.parquet(path)


def label_lines(spark, sf_dir: str) -> dict[str, int]:
    """Lines by label: as many rows as labels."""
    return {r["y"]: r["n"] for r in labelled(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}


@query(SCORE_SQL + " SELECT line_idx, y, first AS pred FROM cd")
def predict_unigram(spark, sf_dir):
    """The label of best score of each line, the lesser one on ties."""
    return candidates(spark, sf_dir).select("line_idx", "y", dc.top().alias("pred"))


@query(SCORE_SQL + " SELECT line_idx, label, score, r AS rank FROM rk WHERE r <= 3")
def predict_top_k(spark, sf_dir):
    """The three best labels of each line."""
    return candidates(spark, sf_dir).select("line_idx", F.posexplode(F.slice("cands", 1, 3)).alias("i", "c")).select("line_idx", "c.label", "c.score", (F.col("i") + 1).alias("rank"))


@query(SCORE_SQL + ", b AS (SELECT line_idx, y, label, row_number() OVER (PARTITION BY line_idx ORDER BY round(score + CASE WHEN label LIKE 'eng%' THEN -25 ELSE 0 END, 4) DESC, label) AS r FROM sc) SELECT line_idx, y, label AS pred FROM b WHERE r = 1")
def predict_biased(spark, sf_dir):
    """Argmax after a bias by label; labels without one have 0."""
    return candidates(spark, sf_dir, 1, bias={"eng_Latn": -25.0, "eng_Cyrl": -25.0}).select("line_idx", "y", dc.top().alias("pred"))


@query(SCORE_SQL + ", b AS (SELECT line_idx, y, label, round(score / pow(n_tokens, 0.9::DOUBLE), 4) AS s, row_number() OVER (PARTITION BY line_idx ORDER BY round(score / pow(n_tokens, 0.9::DOUBLE), 4) DESC, label) AS r FROM sc) SELECT line_idx, y, label AS pred, s FROM b WHERE r = 1")
def predict_normalised(spark, sf_dir):
    """Argmax of score over tokens to the power alpha."""
    return candidates(spark, sf_dir, 1, alpha=0.9).select("line_idx", "y", dc.top().alias("pred"), dc.top(1, "score").alias("s"))


@query(SCORE_SQL + ", b AS (SELECT line_idx, y, label, row_number() OVER (PARTITION BY line_idx ORDER BY round(score + 1.5 * ln(n_lines + 1), 4) DESC, label) AS r FROM sc) SELECT line_idx, y, label AS pred FROM b WHERE r = 1")
def predict_with_prior(spark, sf_dir):
    """Bias by gamma times the log of the label's lines."""
    prior = {y: 1.5 * math.log(n + 1) for y, n in label_lines(spark, sf_dir).items()}
    return candidates(spark, sf_dir, 1, bias=prior).select("line_idx", "y", dc.top().alias("pred"))


@query(SCORE_SQL + ", g AS (SELECT g, round(avg((pred = y)::INT), 9) AS accuracy FROM (SELECT g, y, label AS pred, row_number() OVER (PARTITION BY line_idx, g ORDER BY round(score + g * ln(n_lines + 1), 4) DESC, label) AS r FROM sc, (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0), (1.5), (2.0), (3.0), (5.0)) v(g)) WHERE r = 1 GROUP BY g) SELECT g AS gamma, accuracy FROM g")
def prior_sweep(spark, sf_dir):
    """Accuracy of a grid of priors; the scores are made once."""
    gammas = F.array(*map(F.lit, [0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0]))
    best = lambda g: F.array_min(F.transform("cands", lambda c: F.struct((-F.round(c["score"] + g * F.log(c["n_lines"] + 1), 4)).alias("minus"), c["label"].alias("label"))))
    hits = F.transform(gammas, lambda g: F.struct(g.alias("gamma"), (best(g)["label"] == F.col("y")).cast("int").alias("hit")))
    rows = candidates(spark, sf_dir, None).select(F.explode(hits).alias("h"))
    return rows.groupBy("h.gamma").agg(F.round(F.avg("h.hit"), 9).alias("accuracy"))


GROUP_SQL = "CASE WHEN label[1:3] IN ('eng', 'deu') THEN 'grm' ELSE 'rom' END"


@query(
    SCORE_SQL + f", g AS (SELECT line_idx, y, {GROUP_SQL} AS macro, max(score) AS top, arg_min(label, (-score, label)) AS pred, list(score ORDER BY score) AS sl FROM rk WHERE r <= 5 GROUP BY ALL),"
    " l AS (SELECT *, round(top + ln(list_sum(list_transform(sl, lambda x: exp(x - top)))), 4) AS lse FROM g) SELECT line_idx, y, macro, pred FROM (SELECT *, row_number() OVER (PARTITION BY line_idx ORDER BY lse DESC, macro) AS k FROM l) WHERE k = 1"
)
def predict_macro_group(spark, sf_dir):
    """C14: the best group by log-sum-exp over the five candidates, then its best member."""
    labels = model(spark, sf_dir).select(F.col("y").alias("label")).distinct()
    macro = labels.select("label", F.when(F.substring("label", 1, 3).isin("eng", "deu"), "grm").otherwise("rom").alias("macro"))
    return dc.macro_decision(candidates(spark, sf_dir), macro)


@query(SCORE_SQL + " SELECT line_idx, y, first, gap FROM cd")
def margins(spark, sf_dir):
    """How far the first candidate is above the second."""
    return candidates(spark, sf_dir).select("line_idx", "y", dc.top().alias("first"), dc.gap().alias("gap"))


def tau_sql(share: str, name: str = "tau", least: int = 20) -> str:
    return f""", {name}_own AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(line_idx::VARCHAR)) AS k, count(*) OVER (PARTITION BY y) AS own_lines FROM cd), {name}_st AS (
  SELECT y AS label, count(*) AS n_own, count(*) FILTER (WHERE first = y AND gap IS NOT NULL) AS n_won, list(gap ORDER BY gap) FILTER (WHERE first = y AND gap IS NOT NULL) AS gaps, ({share}) AS share, max(own_lines) AS own_lines FROM {name}_own WHERE k <= 2000 GROUP BY y), {name} AS (
  SELECT label, n_own, n_won, CASE WHEN NOT (n_won < {least} OR share <= 0) THEN gaps[floor(share * (n_won - 1))::INT + 1] + (share * (n_won - 1) - floor(share * (n_won - 1))) * (coalesce(gaps[floor(share * (n_won - 1))::INT + 2], gaps[floor(share * (n_won - 1))::INT + 1]) - gaps[floor(share * (n_won - 1))::INT + 1]) END AS tau,
         n_won < {least} OR share <= 0 AS excluded FROM {name}_st)"""


TAU_SQL = SCORE_SQL + tau_sql("0.05::DOUBLE")
ADAPTIVE = f"0.05::DOUBLE * (1 - least(max(own_lines), {CAP}) / {CAP}.0::DOUBLE)"


def fixed_taus(rows: DataFrame) -> DataFrame:
    return dc.thresholds(rows, 0.05, 20)


def adaptive_taus(rows: DataFrame) -> DataFrame:
    share = 0.05 * (1 - F.least("own_lines", F.lit(CAP)) / F.lit(float(CAP)))
    return dc.thresholds(rows, share, 20)


@query(TAU_SQL + " SELECT label, n_own, n_won, round(tau, 6) AS tau, excluded FROM tau")
def gate_thresholds(spark, sf_dir):
    """The 5th percentile of the gaps of each label's own, won lines."""
    return fixed_taus(candidates(spark, sf_dir)).withColumn("tau", F.round("tau", 6))


@query(SCORE_SQL + tau_sql(ADAPTIVE) + " SELECT label, n_own, n_won, round(tau, 6) AS tau, excluded FROM tau")
def gate_thresholds_adaptive(spark, sf_dir):
    """C17: a percentile that falls with the label's lines; 0 excludes the label."""
    return adaptive_taus(candidates(spark, sf_dir)).withColumn("tau", F.round("tau", 6))


@query(TAU_SQL + " SELECT line_idx, y, CASE WHEN gap < tau THEN second ELSE first END AS pred, CASE WHEN gap < tau THEN 'moved' ELSE 'kept' END AS outcome FROM cd LEFT JOIN tau ON first = label")
def gate_runner_up(spark, sf_dir):
    """Lines under the threshold go to the second candidate."""
    rows = stored(spark, sf_dir)
    return dc.gate(rows, fixed_taus(rows), "second").select("line_idx", "y", "pred", "outcome")


def head_sql(taus: str, reach: str = "", tau: str = "tau") -> str:
    near = f" AND s1 - score <= {reach}" if reach else ""
    return f""", fit AS (SELECT line_idx, arg_min(label, r) AS any_fit FROM rk WHERE r BETWEEN 2 AND 5 AND n_lines >= {BAR} GROUP BY line_idx), hd AS (SELECT rk.line_idx, arg_min(label, r) AS goal FROM rk JOIN cd USING (line_idx) WHERE r BETWEEN 2 AND 5 AND n_lines >= {BAR}{near} GROUP BY rk.line_idx)
  SELECT line_idx, y, CASE WHEN gap < {tau} AND goal IS NOT NULL THEN goal ELSE first END AS pred, CASE WHEN gap < {tau} THEN CASE WHEN goal IS NOT NULL THEN 'moved' WHEN any_fit IS NOT NULL THEN 'blocked_by_proximity' ELSE 'no_candidate' END ELSE 'kept' END AS outcome
  FROM cd LEFT JOIN {taus} t ON first = t.label LEFT JOIN hd USING (line_idx) LEFT JOIN fit USING (line_idx)"""


@query(SCORE_SQL + tau_sql(ADAPTIVE) + head_sql("tau"))
def gate_head_target(spark, sf_dir):
    """Lines under the threshold go to the first well-trained candidate of ranks 2 to 5."""
    rows = stored(spark, sf_dir)
    return dc.gate(rows, adaptive_taus(rows), "head", BAR).select("line_idx", "y", "pred", "outcome")


@query(SCORE_SQL + tau_sql(ADAPTIVE) + head_sql("tau", "21"))
def gate_proximity(spark, sf_dir):
    """C20: as before, if the target's score is at most 21 below the first's."""
    rows = stored(spark, sf_dir)
    return dc.gate(rows, adaptive_taus(rows), "head", BAR, 21.0).select("line_idx", "y", "pred", "outcome")


MERGED_SQL = SCORE_SQL + tau_sql(ADAPTIVE, "ta") + tau_sql("0.05::DOUBLE", "tb") + f", tau AS (SELECT label, tau FROM ta WHERE label NOT LIKE 'eng%' UNION ALL SELECT label, tau FROM tb WHERE label LIKE 'eng%')"


def merged_taus(rows: DataFrame) -> DataFrame:
    """Adaptive thresholds of group A and fixed ones of group B (here English); a label in both stops the query."""
    group_b = F.col("label").startswith("eng")
    both = adaptive_taus(rows).filter(~group_b).unionByName(fixed_taus(rows).filter(group_b))
    times = both.groupBy("label").agg(F.first("tau").alias("tau"), F.count(F.lit(1)).alias("n"))
    return mo.require(times, F.col("n") > 1, "a label is in both groups")


@query(MERGED_SQL + head_sql("tau", "21"))
def gate_two_groups(spark, sf_dir):
    """Both groups' gates at once, with the bar and the proximity rule."""
    rows = stored(spark, sf_dir)
    return dc.gate(rows, merged_taus(rows), "head", BAR, 21.0).select("line_idx", "y", "pred", "outcome")


@query(SCORE_SQL + ", t9 AS (SELECT y AS label, 9.0::DOUBLE AS tau FROM lab)" + head_sql("t9"))
def gate_shared_threshold(spark, sf_dir):
    """One threshold of 9 for all labels."""
    labels = model(spark, sf_dir).select(F.col("y").alias("label")).distinct().withColumn("tau", F.lit(9.0))
    return dc.gate(candidates(spark, sf_dir), labels, "head", BAR).select("line_idx", "y", "pred", "outcome")


#: SCORE_SQL under the matrix whose unseen tokens have one floor of -21.
FLOOR_SQL = SCORE_SQL.replace(", lc AS", ", m21 AS (SELECT * REPLACE (CASE WHEN seen THEN w ELSE least(w, -21.0::DOUBLE) END AS w) FROM m), lc AS").replace("JOIN m USING", "JOIN m21 m USING")
LISTED = ["eng_Latn", "spa_Latn"]


def floored(spark, sf_dir: str) -> DataFrame:
    return w.equalise_floor(model(spark, sf_dir), -21.0)


@query(FLOOR_SQL + tau_sql(ADAPTIVE) + head_sql("tau"))
def gate_solo_floored(spark, sf_dir):
    """The adaptive gate with the bar over the matrix of floor -21; over the plain matrix it is `gate_head_target`."""
    rows = stored(spark, sf_dir, rows=floored(spark, sf_dir))
    return dc.gate(rows, adaptive_taus(rows), "head", BAR).select("line_idx", "y", "pred", "outcome")


@query(FLOOR_SQL + MERGED_SQL.removeprefix(SCORE_SQL) + head_sql("tau", "21"))
def gate_promoted(spark, sf_dir):
    """The whole configuration: floor -21 for all rows, both groups' thresholds, the bar and the proximity rule."""
    rows = stored(spark, sf_dir, rows=floored(spark, sf_dir))
    return dc.gate(rows, merged_taus(rows), "head", BAR, 21.0).select("line_idx", "y", "pred", "outcome")


@query(FLOOR_SQL + tau_sql("0.05::DOUBLE", "tf", 5) + ", few AS (SELECT label, tau FROM tf WHERE label IN ('eng_Latn', 'spa_Latn'))" + head_sql("few"))
def gate_listed_labels(spark, sf_dir):
    """Fixed thresholds for a few listed labels over the matrix of floor -21; too few gaps of one stop the query.

    The bar of gaps is 200 by default in use on large corpora (`least`), and 5 here, for the test tables' labels.
    """
    rows = stored(spark, sf_dir, rows=floored(spark, sf_dir))
    taus = dc.thresholds(rows.filter(F.col("y").isin(LISTED)), 0.05, 5, stop=True)
    return dc.gate(rows, taus, "head", BAR).select("line_idx", "y", "pred", "outcome")


OLD_ALPHA = 0.4  # the smoothing of an older run's model
OLD_SQL = (
    f", om AS (SELECT y, token, ln((n + {OLD_ALPHA}::DOUBLE) / (total + {OLD_ALPHA}::DOUBLE * size)) AS w FROM grid), os AS (SELECT c.line_idx, m.y AS label, round(sum(c.n * m.w), 4) AS score FROM lc c JOIN om m USING (token) GROUP BY ALL),"
    " old AS (SELECT line_idx, arg_min(label, (-score, label)) AS saved FROM os GROUP BY line_idx)"
)
CARVE_SQL = TAU_SQL + OLD_SQL


def saved_predictions(spark, sf_dir: str) -> DataFrame:
    """The labels that an older run saved to a file: those of another model, smoothed less, scored by itself."""
    old = with_lines(spark, sf_dir, mo.smoothed(counts(spark, sf_dir), OLD_ALPHA))
    path = shared(spark, "saved")
    candidates(spark, sf_dir, 1, old).select("line_idx", dc.top().alias("saved")).write.parquet(path)
    return spark.read.parquet(path)


@query(CARVE_SQL + " SELECT line_idx, y, CASE WHEN gap < tau THEN second ELSE first END AS pred, CASE WHEN gap < tau THEN 'moved' ELSE 'kept' END AS outcome FROM cd JOIN old USING (line_idx) LEFT JOIN tau ON first = label WHERE first = saved")
def agreement_carve_out(spark, sf_dir):
    """Only lines whose label equals the one that an older model's run saved go through the gate; an agreement under 0.99 stops the query."""
    rows = stored(spark, sf_dir)
    same = dc.agreeing(rows, saved_predictions(spark, sf_dir))
    return dc.gate(same, fixed_taus(rows), "second").select("line_idx", "y", "pred", "outcome")


def plain_labels(lines: DataFrame, model: DataFrame) -> DataFrame:
    """line_idx, pred by joins alone: the code points of lines (line_idx, text) with their weights, summed; another implementation than the kernel's."""
    each = lines.select("line_idx", F.explode(F.split("text", "")).alias("token")).filter("token <> ''").groupBy("line_idx", "token").agg(F.count(F.lit(1)).alias("n"))
    scores = each.join(model.select("y", "token", "w"), "token").groupBy("line_idx", "y").agg(F.round(F.sum(F.col("n") * F.col("w")), 4).alias("score"))
    return scores.groupBy("line_idx").agg(F.min(F.struct((-F.col("score")).alias("minus"), "y")).alias("best")).select("line_idx", F.col("best.y").alias("pred"))


@query(SCORE_SQL + ", p AS (SELECT line_idx, first FROM cd ORDER BY md5('42:' || line_idx), line_idx LIMIT 200) SELECT count(*) AS lines, count(first) AS equal FROM p")
def import_agreement(spark, sf_dir):
    """Labels that another implementation made and a file of its own brings must equal the kernel's on all lines of the seed-42 sample, else the query stops."""
    rows = stored(spark, sf_dir)
    drawn = table(sp.uniform_sample(rows, 200, 42), "drawn")
    path = shared(spark, "imported")
    lines = labelled(spark, sf_dir).select("line_idx", "text").join(F.broadcast(drawn.select("line_idx")), "line_idx", "left_semi")
    plain_labels(lines, model(spark, sf_dir)).select(F.col("line_idx").cast("string"), "pred").write.option("sep", "\t").csv(path)
    imported = spark.read.option("sep", "\t").schema("line_idx long, saved string").csv(path)
    same = dc.agreeing(drawn, imported, 1.0).agg(F.count(F.lit(1)).alias("equal"))
    return drawn.agg(F.count(F.lit(1)).alias("lines")).crossJoin(same)


@query(SCORE_SQL + ", h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY line_idx) % 2 AS half FROM cd) SELECT half, y, count(*) AS n, round(avg((first = y)::INT), 9) AS accuracy FROM h GROUP BY ALL")
def balanced_halves(spark, sf_dir):
    """R2: halves of each label by parity of rank, for fitting and choosing."""
    rows = halves(stored(spark, sf_dir))
    return rows.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((dc.top() == F.col("y")).cast("int")), 9).alias("accuracy"))


def halves(rows: DataFrame) -> DataFrame:
    return sp.rank_in(rows, ["y"], "line_idx").withColumn("half", (F.col("rank") % 2).cast("int")).drop("rank")


def best_with(bias):
    """The label of best score after a bias, a map by label; the lesser on ties."""
    return F.array_min(F.transform("cands", lambda c: F.struct((-F.round(c["score"] + bias[c["label"]], 4)).alias("minus"), c["label"].alias("label"))))["label"]


@query()
def bias_by_halves(spark, sf_dir):
    """Biases fitted on one half of each label's lines and tried on the other, both ways; iterative, so without SQL."""
    rows = halves(stored(spark, sf_dir))
    path = shared(spark, "halves")
    rows.write.partitionBy("half").parquet(path)
    rows = spark.read.parquet(path)
    lines = label_lines(spark, sf_dir)
    out = []
    for fit in (0, 1):
        bias, _ = dc.learn_bias(rows.filter(F.col("half") == fit), sorted(lines), {x: 0.1 * math.log(n + 1) for x, n in lines.items()}, steps=6)
        added = F.create_map(*(F.lit(v) for x, b in bias.items() for v in (x, float(b))))
        new = best_with(added)
        chosen = rows.filter(F.col("half") != fit).agg(F.avg((dc.top() == F.col("y")).cast("int")), F.avg((new == F.col("y")).cast("int")), F.count(F.lit(1))).first()
        out.append((fit, chosen[2], chosen[0], chosen[1]))
    return spark.createDataFrame(out, "fitted_half int, n long, accuracy_plain double, accuracy_biased double")


@query()
def learned_bias(spark, sf_dir):
    """C11: biases by label that minimise the regularised softmax loss over the 20 best candidates; iterative, so without SQL."""
    rows = stored(spark, sf_dir, k=20)
    labels = sorted(r[0] for r in model(spark, sf_dir).select("y").distinct().collect())
    lines = {r["y"]: r["own_lines"] for r in rows.select("y", "own_lines").distinct().collect()}
    bias, losses = dc.learn_bias(rows, labels, {x: 0.1 * math.log(lines.get(x, 0) + 1) for x in labels}, steps=12)
    return spark.createDataFrame([(x, round(float(b), 6), round(float(losses[0]), 6), round(float(losses[-1]), 6)) for x, b in bias.items()], "label string, bias double, first_loss double, last_loss double")
