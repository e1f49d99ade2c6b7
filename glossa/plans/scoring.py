"""Plans of the segmentation kernel, of files and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators import decisions as dc
from glossa.operators import metrics as m
from glossa.operators import model as mo
from glossa.operators import segment as sg
from glossa.operators import subword as sw
from glossa.plans.corpus import LINES
from glossa.plans.deciding import SCORE_SQL
from glossa.plans.evaluation import LENGTH_SQL
from glossa.plans.modelling import MODEL_SQL, counts, model
from glossa.plans.registry import query
from glossa.plans.tables import LABELLED_SQL, LANGUAGES, SAMPLE_SQL, labelled, sample
from glossa.sources import lines as src
from glossa.sources.store import shared, table
from glossa.streaming import scoring as st


@query(
    SCORE_SQL + " SELECT l.line_idx, CASE WHEN l.text = '' THEN 'EMPTY' ELSE 'SCORED' END AS status, first AS pred, round(s1, 2) AS score, coalesce(first = l.y, false) AS correct FROM lines l LEFT JOIN cd ON cd.line_idx = l.line_idx"
)
def predict_kernel(spark, sf_dir):
    """The broadcast kernel over whole texts; empty lines keep their row and count as wrong."""
    rows = sg.score_lines(labelled(spark, sf_dir).select("line_idx", "y", "text"), model(spark, sf_dir), 1)
    return rows.select("line_idx", "status", dc.top().alias("pred"), F.round(dc.top(1, "score"), 2).alias("score"), F.coalesce(dc.top() == F.col("y"), F.lit(False)).alias("correct"))


PAIR_BAR = 200  # occurrences that make two neighbouring code points a token

PAIR_SQL = (
    MODEL_SQL + f""", pr AS (SELECT y, text[i:i + 1] AS token FROM lines, unnest(range(1, length(text))) r(i)), pc AS (SELECT y, token, count(*) AS n FROM pr GROUP BY ALL), pv AS (SELECT token FROM pc GROUP BY token HAVING sum(n) >= {PAIR_BAR}),
  tv AS (SELECT token FROM voc UNION SELECT token FROM pv), tc AS (SELECT y, token, n FROM cnt UNION ALL SELECT y, token, n FROM pc SEMI JOIN pv USING (token)),
  tg AS (SELECT y, token, coalesce(n, 0) + 0.5::DOUBLE AS n FROM (SELECT DISTINCT y FROM cnt) CROSS JOIN tv LEFT JOIN tc USING (y, token)), tm AS (SELECT y, token, ln(n / sum(n) OVER (PARTITION BY y)) AS w, min(ln(n / sum(n) OVER (PARTITION BY y))) OVER (PARTITION BY y) - 10 AS unk FROM (SELECT y, token, n FROM tg))"""
)


def pair_model(spark, sf_dir: str) -> DataFrame:
    """A model over code points and frequent pairs of neighbours, weighted by their substring counts."""
    found = mo.pair_counts(labelled(spark, sf_dir))
    total = F.sum("n").over(Window.partitionBy("token"))
    both = counts(spark, sf_dir).unionByName(found.withColumn("all", total).filter(F.col("all") >= PAIR_BAR).drop("all"))
    grid = mo.dense(both).withColumn("n", F.col("n") + 0.5)
    return table(grid.select("y", "token", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("y"))).alias("w")), "pairs")


def _paths_sql(join: str) -> str:
    return (
        PAIR_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace("min(ln(n / sum(n) OVER (PARTITION BY y))) OVER (PARTITION BY y) - 10 AS unk FROM (SELECT y, token, n FROM tg)", "0 AS u FROM tg")
        + f""", un AS (SELECT y, min(w) - 10 AS unk FROM tm GROUP BY y), v AS (
  SELECT item_id, text, y, 0 AS pos, '-infinity'::DOUBLE AS b2, 0.0::DOUBLE AS b1 FROM benchmark, un UNION ALL
  SELECT v.item_id, v.text, v.y, pos + 1, b1, {join} FROM v JOIN un USING (y) LEFT JOIN tm a ON a.y = v.y AND a.token = v.text[pos + 1:pos + 1] LEFT JOIN tm b ON b.y = v.y AND b.token = v.text[pos:pos + 1] AND pos > 0 WHERE pos < length(v.text)),
  fin AS (SELECT item_id, y AS label, round(b1, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(b1, 4) DESC, y) AS r FROM v WHERE pos = length(text)) SELECT item_id, label AS pred, round(score, 2) AS score FROM fin WHERE r = 1"""
    )


ONE, TWO = "b1 + coalesce(a.w, unk)", "b2 + coalesce(b.w, '-infinity'::DOUBLE)"


def _benchmark(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("line_idx"), "text")


@query(_paths_sql(f"greatest({ONE}, {TWO})"))
def viterbi_pairs(spark, sf_dir):
    """Best segmentation into code points and pairs, under each label; the best label of each item."""
    rows = sg.score_texts(_benchmark(spark, sf_dir), pair_model(spark, sf_dir)).filter("status = 'SCORED'")
    return rows.select(F.col("line_idx").alias("item_id"), "pred", F.round(F.col("candidates")[0]["score"], 2).alias("score"))


@query(_paths_sql(f"greatest({ONE}, {TWO}) + ln(1 + exp(least({ONE}, {TWO}) - greatest({ONE}, {TWO})))"))
def marginal_pairs(spark, sf_dir):
    """As before, all segmentations summed."""
    rows = sg.score_texts(_benchmark(spark, sf_dir), pair_model(spark, sf_dir), marginal=True).filter("status = 'SCORED'")
    return rows.select(F.col("line_idx").alias("item_id"), "pred", F.round(F.col("candidates")[0]["score"], 2).alias("score"))


PIECES = (40, 8, 3000)  # least occurrences of a token, most code points of one, and tokens of the vocabulary


def words_of(spark, sf_dir: str) -> DataFrame:
    """Marked words by label with their counts: the only pass over the texts that training takes."""
    return sw.word_counts(labelled(spark, sf_dir))


def pieces(words: DataFrame) -> DataFrame:
    """The vocabulary of frequent substrings of the words."""
    least, longest, size = PIECES
    return sw.vocabulary(sw.substring_counts(words.select("word", "n"), least, longest), size)


def word_model(spark, sf_dir: str) -> DataFrame:
    """Weights of the vocabulary under each label by substring counts, with the label's lines."""
    words = words_of(spark, sf_dir)
    lines = labelled(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n_lines"))  # a row a label
    return sw.substring_model(words, pieces(words)).join(F.broadcast(lines), "y")


WORDS_SQL = (
    "WITH "
    + LABELLED_SQL
    + f""", cut AS (SELECT line_idx, y, unnest(string_split_regex(nfc_normalize(text), '[\x20\x09-\x0D]+')) AS word FROM lines), wd AS (SELECT line_idx, y, '{sw.MARK}' || word AS word FROM cut WHERE word <> ''),
  units AS (SELECT y, word, count(*) AS n FROM wd GROUP BY ALL), sub AS (SELECT y, word[i:i + k - 1] AS token, sum(n)::BIGINT AS n FROM units, range(1, {PIECES[1] + 1}) k(k), unnest(range(1, length(word) - k + 2)) i(i) GROUP BY ALL),
  frequent AS (SELECT token, sum(n)::BIGINT AS n FROM sub GROUP BY token HAVING sum(n) >= {PIECES[0]}),
  voc AS (SELECT token, n FROM frequent WHERE length(token) = 1 UNION ALL (SELECT token, n FROM frequent WHERE length(token) > 1 ORDER BY n * length(token) DESC, token LIMIT greatest({PIECES[2]} - (SELECT count(*) FROM frequent WHERE length(token) = 1), 0)))"""
)


@query(WORDS_SQL + " SELECT token, n FROM frequent")
def substrings_frequent(spark, sf_dir):
    """Substrings of up to 8 code points of marked words that occur 40 times or more, level by level."""
    return sw.substring_counts(words_of(spark, sf_dir).select("word", "n"), *PIECES[:2])


WORD_MODEL_SQL = (
    WORDS_SQL
    + """, wm AS (SELECT y, token, ln((coalesce(sub.n, 0) + 0.5::DOUBLE) / (sum(coalesce(sub.n, 0)) OVER (PARTITION BY y) + 0.5::DOUBLE * count(*) OVER (PARTITION BY y)))::FLOAT AS w FROM (SELECT DISTINCT y FROM units) CROSS JOIN voc LEFT JOIN sub USING (y, token))"""
)


@query(WORD_MODEL_SQL + " SELECT y, token, round(w::DOUBLE, 4) AS w FROM wm")
def vocabulary_substrings(spark, sf_dir):
    """The vocabulary by n x length, weighted under each label by its substring counts."""
    return word_model(spark, sf_dir).select("y", "token", F.round(F.col("w").cast("double"), 4).alias("w"))


# the best score up to each place of a word and its tokens' number, negative, one pair after another: of the tokens that end there, given as starts and weights
WORD_PATHS_SQL = (
    WORD_MODEL_SQL
    + f""", un AS (SELECT y, (min(w) - 10)::FLOAT AS w FROM wm GROUP BY y), word AS (SELECT DISTINCT word FROM units),
  edge AS (SELECT word, i - 1 AS s, i + k - 1 AS e, word[i:i + k - 1] AS token FROM word, range(1, {PIECES[1] + 1}) k(k), unnest(range(1, length(word) - k + 2)) i(i) WHERE k = 1 OR word[i:i + k - 1] IN (SELECT token FROM voc)),
  weighted AS (SELECT word, s, e, un.y, coalesce(wm.w, un.w)::DOUBLE AS w FROM edge CROSS JOIN un LEFT JOIN wm ON wm.token = edge.token AND wm.y = un.y),
  ends AS (SELECT word, y, e, flatten(list([s::DOUBLE, w])) AS g FROM weighted GROUP BY word, y, e),
  ws AS (SELECT word, y, b[-2] AS score, -b[-1] AS n FROM (SELECT word, y, list_reduce(list_prepend([0.0::DOUBLE, 0.0::DOUBLE], list(g ORDER BY e)), lambda b, g: list_concat(b, list_max(list_transform(range(len(g) // 2), lambda j: [b[2 * g[2 * j + 1]::BIGINT + 1] + g[2 * j + 2], b[2 * g[2 * j + 1]::BIGINT + 2] - 1])))) AS b FROM ends GROUP BY word, y)),
  ts AS (SELECT wd.line_idx, ws.y AS label, round(sum(ws.score), 4) AS score, sum(ws.n)::BIGINT AS n_tokens FROM wd JOIN ws USING (word) GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY line_idx ORDER BY score DESC, label) AS r FROM ts)"""
)


@query(
    WORD_PATHS_SQL
    + """ SELECT l.line_idx, CASE WHEN rk.label IS NULL THEN 'EMPTY' ELSE 'SCORED' END AS status, rk.label AS pred, rk.score, coalesce(rk.label = l.y, false) AS correct FROM lines l LEFT JOIN rk ON rk.line_idx = l.line_idx AND r = 1"""
)
def predict_words(spark, sf_dir):
    """Every whole document pre-tokenised and segmented word by word into tokens of up to 8 code points, under each label; its best label."""
    rows = sw.score_words(labelled(spark, sf_dir).select("line_idx", "y", "text"), word_model(spark, sf_dir), 1)
    return rows.select("line_idx", "status", dc.top().alias("pred"), dc.top(1, "score").alias("score"), F.coalesce(dc.top() == F.col("y"), F.lit(False)).alias("correct"))


@query(WORD_PATHS_SQL + " SELECT l.line_idx, CASE WHEN rk.label IS NULL THEN 'EMPTY' ELSE 'SCORED' END AS status, rk.label AS pred, rk.score, rk.n_tokens FROM lines l LEFT JOIN rk ON rk.line_idx = l.line_idx AND r = 1")
def viterbi_documents(spark, sf_dir):
    """The best label's score of every whole document with the number of tokens of its best path."""
    rows = sw.score_words(labelled(spark, sf_dir).select("line_idx", "text"), word_model(spark, sf_dir), 1)
    return rows.select("line_idx", "status", dc.top().alias("pred"), dc.top(1, "score").alias("score"), dc.top(1, "n_tokens").alias("n_tokens"))


# as the best paths, with the logarithm of the sum of all
MARGINAL_SQL = (
    WORD_PATHS_SQL[: WORD_PATHS_SQL.index("  ws AS (")]
    + """  ws AS (SELECT word, y, list_reduce(list_prepend([0.0::DOUBLE], list(g ORDER BY e)), lambda b, g: list_append(b, list_transform([list_transform(range(len(g) // 2), lambda j: b[g[2 * j + 1]::BIGINT + 1] + g[2 * j + 2])], lambda c: list_max(c) + ln(list_sum(list_transform(c, lambda x: exp(x - list_max(c))))))[1]))[-1] AS score FROM ends GROUP BY word, y),
  ts AS (SELECT wd.line_idx, ws.y AS label, round(sum(ws.score), 4) AS score FROM wd JOIN ws USING (word) GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY line_idx ORDER BY score DESC, label) AS r FROM ts)"""
)


@query(MARGINAL_SQL + " SELECT l.line_idx, CASE WHEN rk.label IS NULL THEN 'EMPTY' ELSE 'SCORED' END AS status, rk.label AS pred, rk.score FROM lines l LEFT JOIN rk ON rk.line_idx = l.line_idx AND r = 1")
def marginal_documents(spark, sf_dir):
    """All segmentations of each word summed, over every whole document."""
    rows = sw.score_words(labelled(spark, sf_dir).select("line_idx", "text"), word_model(spark, sf_dir), 1, marginal=True)
    return rows.select("line_idx", "status", dc.top().alias("pred"), dc.top(1, "score").alias("score"))


@query(
    WORD_PATHS_SQL + ", na AS (SELECT line_idx, label, round(score / pow(n_tokens, 0.1::DOUBLE), 4) AS score FROM ts), nr AS (SELECT *, row_number() OVER (PARTITION BY line_idx ORDER BY score DESC, label) AS r FROM na)"
    " SELECT l.line_idx, CASE WHEN nr.label IS NULL THEN 'EMPTY' ELSE 'SCORED' END AS status, nr.label AS pred, nr.score FROM lines l LEFT JOIN nr ON nr.line_idx = l.line_idx AND r = 1"
)
def predict_normalised_documents(spark, sf_dir):
    """Score over the best path's number of tokens to the power 0.1, over every whole document."""
    rows = sw.score_words(labelled(spark, sf_dir).select("line_idx", "text"), word_model(spark, sf_dir), 1, alpha=0.1)
    return rows.select("line_idx", "status", dc.top().alias("pred"), dc.top(1, "score").alias("score"))


@query()
def segment_documents(spark, sf_dir):
    """Tokens of the best path of every document's words under its own label; they join to the marked words."""
    return sw.segment_words(labelled(spark, sf_dir).select("line_idx", "y", "text"), word_model(spark, sf_dir)).select("line_idx", "tokens")


@query()
def train_em_documents(spark, sf_dir):
    """EM over the words of all documents from uniform weights, two rounds; iterative, so without SQL."""
    words = words_of(spark, sf_dir)
    return sw.unpacked(sw.train_em(words, pieces(words), rounds=2)[0])


@query(
    WORDS_SQL + " SELECT y, CASE WHEN y = 'nil_Latn' THEN 'failed' WHEN call = 1 THEN 'trained' ELSE 'present' END AS status, CASE WHEN y = 'nil_Latn' THEN 'no words' END AS error, call FROM (SELECT DISTINCT y FROM units UNION ALL SELECT 'nil_Latn') CROSS JOIN range(1, 3) c(call)"
)
def train_isolated_labels(spark, sf_dir):
    """Labels trained one apart from another, twice with one path: a label without text fails alone, the second call trains nothing again."""
    words, path = words_of(spark, sf_dir), shared(spark, "labels")
    tokens = pieces(words)
    labels = sorted(r[0] for r in words.select("y").distinct().collect()) + ["nil_Latn"]
    first = sw.train_isolated(spark, labels, words, tokens, path, rounds=1)
    second = sw.train_isolated(spark, labels, words, tokens, path, rounds=1)
    return first.withColumn("call", F.lit(1)).unionByName(second.withColumn("call", F.lit(2)))


@query(
    WORDS_SQL + f""" SELECT 'special tokens' AS "check", bool_or(token = '{sw.MARK}') AS passed, CASE WHEN bool_or(token = '{sw.MARK}') THEN '' ELSE '{sw.MARK}' END AS found FROM voc UNION ALL
  SELECT 'vocabulary size', count(*) = {PIECES[2]}, count(*)::VARCHAR FROM voc UNION ALL SELECT 'tokens unique and not empty', count(*) = count(DISTINCT token) AND bool_and(token <> ''), count(DISTINCT token)::VARCHAR FROM voc UNION ALL
  SELECT 'lines a label', count(*) > 0, '0' FROM (SELECT DISTINCT y FROM lines)"""
)
def preflight_checks(spark, sf_dir):
    """Special tokens, the size that the vocabulary was asked to have, and lines a label before a training."""
    tokens = [r[0] for r in pieces(words_of(spark, sf_dir)).select("token").collect()]  # as many as asked for
    return sg.preflight(tokens, labelled(spark, sf_dir), [sw.MARK], PIECES[2])


def token_deltas(spark, sf_dir: str) -> DataFrame:
    """Each scored line's number of tokens under its first label less that under its own, and whether the score a token would turn an error right."""
    lines = labelled(spark, sf_dir).select("line_idx", "y", "text", F.length("text").alias("text_length"))
    rows = sw.score_words(lines, word_model(spark, sf_dir), 1, own="y").filter("status = 'SCORED'")
    own = F.filter("cands", lambda c: c["label"] == F.col("y"))[0]
    rows = rows.withColumns({"pred": dc.top(), "delta": dc.top(1, "n_tokens") - own["n_tokens"]})
    return rows.withColumn("flips", (F.col("pred") != F.col("y")) & (own["score"] / own["n_tokens"] > dc.top(1, "score") / dc.top(1, "n_tokens"))).drop("cands", "status")


DELTA_SQL = (
    WORD_PATHS_SQL
    + f""", dl AS (SELECT f.line_idx, l.y, f.label AS pred, {LENGTH_SQL.replace("text_length", "length(l.text)")} AS bin, f.n_tokens - o.n_tokens AS delta, f.label <> l.y AND o.score / o.n_tokens > f.score / f.n_tokens AS flips
  FROM rk f JOIN lines l ON l.line_idx = f.line_idx JOIN ts o ON o.line_idx = f.line_idx AND o.label = l.y WHERE f.r = 1)"""
)


@query(
    DELTA_SQL + " SELECT bin, count(*) AS n, round(avg(delta), 9) AS mean, median(delta)::DOUBLE AS median, round(avg((delta < 0)::INT), 9) AS fewer, round(avg((delta = 0)::INT), 9) AS same, round(avg((delta > 0)::INT), 9) AS more FROM dl GROUP BY bin"
)
def token_delta_summary(spark, sf_dir):
    """How many more tokens the predicted label's segmentation has than the true one's, by bin of length."""
    rows = m.delta_summary(token_deltas(spark, sf_dir), m.length_bin(F.col("text_length")).alias("bin"))
    return rows.select("bin", "n", "median", *(F.round(c, 9).alias(c) for c in ("mean", "fewer", "same", "more")))


@query(DELTA_SQL + " SELECT bin, y, sign(delta)::INT AS sign, count(*) AS wrong, count(*) FILTER (WHERE flips) AS flipped FROM dl WHERE pred <> y GROUP BY ALL")
def normalisation_counterfactual(spark, sf_dir):
    """Errors that the score a token would turn right, by bin of length, label and sign of the delta."""
    rows = token_deltas(spark, sf_dir).filter(F.col("pred") != F.col("y"))
    return rows.groupBy(m.length_bin(F.col("text_length")).alias("bin"), "y", F.signum("delta").cast("int").alias("sign")).agg(F.count(F.lit(1)).alias("wrong"), F.count_if("flips").alias("flipped"))


@query(DELTA_SQL + " SELECT count(*) AS n, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 9) AS t, round(avg(delta) / stddev_samp(delta), 9) AS cohen_d FROM dl")
def one_sample_t(spark, sf_dir):
    """One-sample t and Cohen's d of the token deltas against 0."""
    return m.one_sample_t(token_deltas(spark, sf_dir)).select("n", F.round("t", 9).alias("t"), F.round("cohen_d", 9).alias("cohen_d"))


@query(
    DELTA_SQL + ", rk2 AS (SELECT delta, abs(delta) AS size, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2.0::DOUBLE AS place FROM dl WHERE delta <> 0),"
    " w AS (SELECT count(*) AS n, coalesce(sum(place) FILTER (WHERE delta > 0), 0)::DOUBLE AS w_plus, coalesce(sum(place) FILTER (WHERE delta < 0), 0)::DOUBLE AS w_minus FROM rk2), ti AS (SELECT coalesce(sum(k * k * k - k), 0)::DOUBLE AS ties FROM (SELECT count(*) AS k FROM rk2 GROUP BY size))"
    " SELECT n, w_plus, w_minus, round((least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48), 9) AS z FROM w, ti"
)
def signed_rank(spark, sf_dir):
    """Signed-rank sums of the token deltas and their normal approximation."""
    return m.signed_rank(token_deltas(spark, sf_dir)).withColumn("z", F.round("z", 9))


@query(SAMPLE_SQL + " SELECT pred_a AS label, count(*) AS n FROM s GROUP BY pred_a")
def web_tags_file(spark, sf_dir):
    """Texts and tags as a gzipped table with a header, text first, written and read back."""
    path = shared(spark, "web")
    lines = labelled(spark, sf_dir).select("line_idx", "text").join(sample(spark, sf_dir).select("line_idx", "pred_a"), "line_idx")
    src.write_web(lines.select("text", F.col("pred_a").alias("tag")), path)
    return src.read_web(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(LINES + " SELECT (sum(length(y) + 1))::BIGINT AS length, sha256(string_agg(y, chr(10) ORDER BY y) || chr(10)) AS sha256 FROM (SELECT DISTINCT y FROM lines)")
def provenance_file(spark, sf_dir):
    """Length and digest of a written label list; `fingerprint` also gives the path and the code's commit."""
    path = shared(spark, "list")
    labelled(spark, sf_dir).select("y").distinct().coalesce(1).sortWithinPartitions("y").write.text(path)  # a row a label
    return src.fingerprint(spark, path).filter("path LIKE '%.txt'").select("length", "sha256")


@query(LINES + " SELECT y AS label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM lines GROUP BY y")
def labelled_lines_file(spark, sf_dir):
    """Documents written as labelled lines and read back, split at the first space."""
    path = shared(spark, "labelled")
    src.write_labelled(labelled(spark, sf_dir), path)
    rows = src.read_labelled(spark, path, train=True)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(MODEL_SQL + " SELECT y, token, round(w, 6) AS w FROM m")
def model_file(spark, sf_dir):
    """A model written after its checks and read again."""
    rows = model(spark, sf_dir).select("y", "token", "w")
    path = shared(spark, "model")
    labels, tokens = rows.agg(F.count_distinct("y"), F.count_distinct("token")).first()
    src.save_model(rows, path, labels, tokens)
    return src.load_model(spark, path).select("y", "token", F.round("w", 6).alias("w"))


@query(SAMPLE_SQL + " SELECT line_idx, pred_b AS pred FROM s")
def imported_predictions(spark, sf_dir):
    """Predictions taken over after the checks on labels and lines."""
    labels = spark.createDataFrame([(f"{y}_{s}",) for y in (*LANGUAGES.values(), "und") for s in ("Latn", "Cyrl")], "label string")
    predictions = sample(spark, sf_dir).select("line_idx", F.col("pred_b").alias("pred"))
    return src.import_predictions(labelled(spark, sf_dir).select("line_idx"), predictions, labels)


@query(LINES + " SELECT source, count(*) AS n FROM lines GROUP BY source")
def chunked_sink(spark, sf_dir):
    """A sink by chunk that skips what is there; the second call writes nothing."""
    rows, path = labelled(spark, sf_dir).select("line_idx", "y", "source"), shared(spark, "chunks")
    src.write_chunks(rows, path, "source", {"alpha": 0.5})
    if src.write_chunks(rows, path, "source", {"alpha": 0.5}):
        raise RuntimeError("a chunk was written twice")
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(LINES + " SELECT y, count(*) AS n, round(avg(length(text)), 6) AS mean_length, round(stddev_pop(length(text)), 6) AS std_length FROM lines GROUP BY y")
def stream_statistics(spark, sf_dir):
    """2.12: statistics by label kept over a stream until its input ends."""
    rows = labelled(spark, sf_dir).select("y", "text")
    path = shared(spark, "stream")
    rows.write.parquet(path)
    out = shared(spark, "stream-out")
    st.write_stats(st.running_stats(st.read_documents(spark, path)), out, shared(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out)


@query(LINES + " SELECT y, count(*) AS n, round(avg(length(text)), 6) AS mean_length, round(stddev_pop(length(text)), 6) AS std_length FROM lines GROUP BY y")
def stream_sums(spark, sf_dir):
    """2.12, P3: sums by label kept by batch id; every batch comes twice, as after a failure, and counts once."""
    path, out = shared(spark, "stream"), shared(spark, "stream-sums")
    labelled(spark, sf_dir).select("y", "text").write.parquet(path)  # a file a part of the table, so a larger table has more
    merge = st.merge_sums(out)

    def twice(rows, batch):
        merge(rows, batch)
        merge(rows, batch)

    st.write_sums(st.read_documents(spark, path, spark.sparkContext.defaultParallelism), out, shared(spark, "stream-state"), twice).awaitTermination()
    return st.read_sums(spark, out)


@query(SCORE_SQL + " SELECT line_idx, first AS pred FROM cd")
def stream_predictions(spark, sf_dir):
    """2.12: predictions of a stream of lines, appended to files."""
    path, out = shared(spark, "stream"), shared(spark, "stream-out")
    labelled(spark, sf_dir).select("line_idx", "text").write.parquet(path)
    st.score_stream(st.read_documents(spark, path), model(spark, sf_dir), out, shared(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).filter("status = 'SCORED'").select("line_idx", "pred")
