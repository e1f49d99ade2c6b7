"""Pre-tokenised scoring, substring vocabularies and EM in tables, against all paths and plain counts."""

import collections
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.operators import segment as sg
from glossa.operators import subword as sw
from glossa.sources.store import shared

random.seed(2)
TOKENS = ["▁", "a", "b", "c", "▁a", "ab", "abc", "bc", "abcab", "abcabcab", "▁abcabca", "é", "▁é"]


def paths(word, tokens):
    """All segmentations; a code point that is no token is None."""
    if not word:
        return [[]]
    out = [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in tokens for rest in paths(word[k:], tokens)]
    return out if word[0] in tokens else out + [[None, *rest] for rest in paths(word[1:], tokens)]


def weights(labels, seed=4):
    return np.random.default_rng(seed).normal(-3, 1, (labels, len(TOKENS))).astype(np.float32)


def value(path, row):
    unknown = np.float32(row.min() - sw.UNKNOWN_PENALTY)
    return sum(float(unknown if t is None else row[TOKENS.index(t)]) for t in path)


WORDS = ["▁", "▁a", "▁abcabcab", "▁abcabca", "▁é", "▁xaby", "▁ééé", "▁😀abc", "▁cbacba", "abcabcab", "x", ""]


@pytest.mark.parametrize("cells", [1 << 22, 30])
def test_words_against_all_paths(cells, monkeypatch):
    monkeypatch.setattr(sw, "CELLS", cells)
    w = weights(3)
    lattice = sw.WordLattice(TOKENS, w)
    assert lattice.rows.dtype == np.float32 and lattice.longest == 8
    best, count = lattice.score(WORDS)
    summed, _ = lattice.score(WORDS, marginal=True)
    for i, word in enumerate(WORDS):
        found = paths(word, TOKENS)
        for y in range(3):
            values = [value(p, w[y]) for p in found]
            assert best[i, y] == pytest.approx(max(values), abs=1e-9)
            assert summed[i, y] == pytest.approx(np.logaddexp.reduce(values), abs=1e-9)
            assert count[i, y] in {len(p) for p, v in zip(found, values, strict=True) if v > max(values) - 1e-9}


def test_tokens_of_the_best_path(spark, monkeypatch):
    w = weights(3)
    lattice = sw.WordLattice(TOKENS, w)
    label = np.arange(len(WORDS)) % 3
    best = lattice.score(WORDS)[0]
    for word, y, found, score in zip(WORDS, label, lattice.paths(WORDS, label), best, strict=True):
        assert "".join(found) == word
        assert value([t if t in TOKENS else None for t in found], w[y]) == pytest.approx(score[y], abs=1e-9)
    lines = spark.createDataFrame(TEXTS, "line_idx long, y string, text string")
    whole = {(r["line_idx"], r["y"], None if r["tokens"] is None else tuple(r["tokens"])) for r in sw.segment_words(lines, long_model(spark, w)).collect()}
    for line, y, text in TEXTS:
        words = ["▁" + x for x in unicodedata.normalize("NFC", text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        joined = {"".join(t) for i, g, t in whole if (i, g) == (line, y) and t is not None}
        assert ("".join(words) in joined) if y != "lx" else (line, y, None) in whole
    monkeypatch.setattr(sw, "MOST_MODEL", 60)
    assert {(r["line_idx"], r["y"], None if r["tokens"] is None else tuple(r["tokens"])) for r in sw.segment_words(lines, long_model(spark, w)).collect()} == whole


def test_expected_counts_against_all_paths(monkeypatch):
    monkeypatch.setattr(sw, "CELLS", 60)
    w = weights(1)
    n = np.arange(1.0, len(WORDS) + 1)
    found, like = sw.WordLattice(TOKENS, w).expectations(WORDS, n)
    wanted, whole = np.zeros(len(TOKENS)), 0.0
    for word, k in zip(WORDS, n, strict=True):
        every = paths(word, TOKENS)
        values = np.array([value(p, w[0]) for p in every])
        z = np.logaddexp.reduce(values)
        whole += k * z
        for p, v in zip(every, values, strict=True):
            for t in p:
                if t is not None:
                    wanted[TOKENS.index(t)] += k * np.exp(v - z)
    assert found == pytest.approx(wanted) and like == pytest.approx(whole)


def test_trie_and_empty_models():
    keys, nodes, token = sw.trie(["b", "a", "ab", "abc"])
    assert (np.diff(keys) > 0).all() and sorted(token[token >= 0]) == [0, 1, 2, 3] and len(nodes) == len(keys)
    nothing = sw.WordLattice([], np.zeros((2, 0), np.float32))
    assert nothing.score(["ab"])[0].tolist() == [[-20.0, -20.0]]


def long_model(spark, w, tokens=TOKENS):
    return spark.createDataFrame([(f"l{y}", t, float(w[y, i]), y) for y in range(len(w)) for i, t in enumerate(tokens)], "y string, token string, w double, n_lines long")


TEXTS = [(0, "l1", "abcabcab xaby"), (1, "l0", None), (2, "l2", " \t\n"), (3, "lx", "abc " * 400), (4, "l2", "é é a b"), (5, "l1", ""), (6, "l0", "a" * 300 + " b"), (6, "l0", "c b a")]


@pytest.mark.parametrize("most", [1 << 30, 60])
def test_texts_are_sums_of_their_words(spark, monkeypatch, most):
    """Label blocks give what one block does; a worker that keeps few words gives what one that keeps all does."""
    monkeypatch.setattr(sw, "MOST_MODEL", most)
    w = weights(4)
    lattice = sw.WordLattice(TOKENS, w)
    lines = spark.createDataFrame(TEXTS, "line_idx long, y string, text string")
    rows = sw.score_words(lines, long_model(spark, w), k=2, own="y").collect()
    assert len(rows) == len(TEXTS)
    got = collections.defaultdict(list)
    for r in rows:
        got[r["line_idx"]].append(r)
    for line, y, text in TEXTS:
        words = ["▁" + x for x in unicodedata.normalize("NFC", text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        scores = np.round(lattice.score(words)[0].sum(axis=0), 4) if words else None
        match = [r for r in got[line] if r["y"] == y and (r["status"] == "EMPTY") == (not words) and (not words or abs(r["cands"][0]["score"] - scores.max()) < 2e-4)]
        assert match, (line, text)
        if not words:
            assert match[0]["cands"] == []
            continue
        order = sorted(range(4), key=lambda i: (-scores[i], i))
        wanted = [f"l{i}" for i in order[:2]] + ([y] if y in {f"l{i}" for i in order[2:]} else [])
        assert [c["label"] for c in match[0]["cands"]] == wanted and match[0]["cands"][0]["n_lines"] == order[0]


def test_scorer_keeps_a_bounded_number(monkeypatch):
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abcx", k=r.randint(1, 5))) for _ in range(r.randint(0, 40))) for _ in range(60)]
    lattice = sw.WordLattice(TOKENS, weights(2))
    whole = sw.Scorer(lattice, sw.Words(), False).scores(texts)
    monkeypatch.setattr(sw, "MOST_KNOWN", 40)
    monkeypatch.setattr(sw, "CELLS", 16)
    few = sw.Scorer(lattice, sw.Words(), False)
    parts = [few.scores(texts[i : i + 7]) for i in range(0, 60, 7)]
    assert np.concatenate([p[0] for p in parts]) == pytest.approx(whole[0]) and (np.concatenate([p[1] for p in parts]) == whole[1]).all()
    assert len(few.known) <= 40


def test_scores_per_token_and_bias(spark):
    w = weights(2)
    lines = spark.createDataFrame([(1, "abcab a")], "line_idx long, text string")
    plain = {c["label"]: c for c in sw.score_words(lines, long_model(spark, w), k=None).first()["cands"]}
    shared_out = {c["label"]: c for c in sw.score_words(lines, long_model(spark, w), k=None, alpha=1.0).first()["cands"]}
    for y, c in plain.items():
        assert shared_out[y]["score"] == pytest.approx(c["score"] / c["n_tokens"], abs=1e-4)
    biased = sw.score_words(lines, long_model(spark, w), k=1, bias={"l0": 1000.0}).first()["cands"][0]
    assert biased["label"] == "l0"
    assert sw.score_words(lines.limit(0), long_model(spark, w)).count() == 0


def substrings(words, least, longest):
    n = collections.Counter()
    for w, k in words.items():
        for size in range(1, longest + 1):
            for i in range(len(w) - size + 1):
                n[w[i : i + size]] += k
    return {t: c for t, c in n.items() if c >= least}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_substring_counts(spark, monkeypatch, most):
    monkeypatch.setattr(sw, "MOST_TOKENS", most)
    r = random.Random(3)
    words = collections.Counter("".join(r.choices("ab", k=r.randint(1, 14))) for _ in range(300))
    words["😀é" * 6] = 9
    words[""] = 5
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r["token"]: r["n"] for r in sw.substring_counts(table, 8, 9).collect()}
    assert found == substrings(words, 8, 9) and max(map(len, found)) == 9
    assert sw.substring_counts(table.limit(0), 8).count() == 0
    chosen = sw.vocabulary(sw.substring_counts(table, 8, 9), 20).collect()
    points = [t for t in found if len(t) == 1]
    longer = sorted((t for t in found if len(t) > 1), key=lambda t: (-found[t] * len(t), t.encode()))
    assert {r["token"] for r in chosen} == {*points, *longer[: 20 - len(points)]}


def test_word_counts(spark, monkeypatch):
    lines = spark.createDataFrame([("p", "a b\ta"), ("p", "é é"), ("q", None), ("q", " "), ("q", "a b")], "y string, text string")
    wanted = {("p", "▁a"): 2, ("p", "▁b"): 1, ("p", "▁é"): 2, ("q", "▁a b"): 1}
    assert {(r["y"], r["word"]): r["n"] for r in sw.word_counts(lines).collect()} == wanted
    monkeypatch.setattr(sw, "MOST_COUNTS", 0)
    assert {(r["y"], r["word"]): r["n"] for r in sw.word_counts(lines).collect()} == wanted


UNITS = [("p", "ababab", 3), ("p", "aab", 1), ("p", "axb", 2), ("q", "cccab", 4), ("q", "c", 1)]


def em(words, tokens, rounds, floor=1e-12):
    """EM over all paths of each label's words; weights by token, and the likelihood of each round."""
    w, likes = {t: -np.log(len(tokens)) for t in tokens}, []
    for _ in range(rounds):
        n, like = collections.Counter(), 0.0
        unknown = min(w.values()) - sw.UNKNOWN_PENALTY
        for word, k in words:
            every = paths(word, tokens)
            values = np.array([sum(unknown if t is None else w[t] for t in p) for p in every])
            z = np.logaddexp.reduce(values)
            like += k * z
            for p, v in zip(every, values, strict=True):
                for t in p:
                    if t is not None:
                        n[t] += k * np.exp(v - z)
        total = sum(n.values())
        w = {t: np.log(max(n[t] / total, floor)) for t in tokens}
        likes.append(like)
    return w, likes


@pytest.mark.parametrize("block", [20_000, 1])
def test_em_against_all_paths(spark, monkeypatch, block):
    monkeypatch.setattr(sw, "BLOCK_WORDS", block)
    tokens = ["a", "b", "c", "ab", "abab"]
    units = spark.createDataFrame(UNITS, "y string, word string, n long")
    rows, likes, failures = sw.train_em(units, spark.createDataFrame([(t,) for t in tokens], "token string"), rounds=4)
    found = collections.defaultdict(dict)
    for r in sw.unpacked(rows).collect():
        found[r["y"]][r["token"]] = r["w"]
    by_round = {(r["y"], r["round"]): r["like"] for r in likes.collect()}
    for y in ("p", "q"):
        wanted, whole = em([(w, n) for g, w, n in UNITS if g == y], tokens, 4)
        assert found[y] == pytest.approx(wanted, rel=1e-4) and [by_round[y, i] for i in range(4)] == pytest.approx(whole, rel=1e-5)
        assert y == "p" or all(b >= a - 1e-9 for a, b in zip(whole, whole[1:]))  # p has an unknown code point, whose weight moves with the least
    assert failures.count() == 0


def breaking():
    """An E-step that raises on some words; a function in a function travels to the workers by value."""

    def step(tokens, w, words, n):
        if any("!" in x for x in words):
            raise ValueError("a word that can't be read")
        if "inf" in words:
            return np.full(len(tokens), np.inf), 0.0
        return sw.expected_counts(tokens, w, words, n)

    return step


def test_a_label_that_raises_fails_alone(spark):
    units = spark.createDataFrame([*UNITS, ("bad", "a!", 1), ("bad", "ab", 1), ("inf", "inf", 1), ("strange", "xyz", 1)], "y string, word string, n long")
    tokens = spark.createDataFrame([("a",), ("b",), ("c",), ("ab",)], "token string")
    path = shared(spark, "isolated")
    labels = ["p", "q", "bad", "inf", "strange", "wordless"]
    first = {r["y"]: (r["status"], r["error"]) for r in sw.train_isolated(spark, labels, units, tokens, path, rounds=2, wave=4, step=breaking()).collect()}
    assert {y for y, s in first.items() if s[0] == "trained"} == {"p", "q"} and all(first[y][0] == "failed" for y in ("bad", "inf", "strange", "wordless"))
    assert "can't be read" in first["bad"][1] and "finite" in first["inf"][1] and "no token" in first["strange"][1]
    second = {r["y"]: r["status"] for r in sw.train_isolated(spark, ["p", "q", "bad"], units, tokens, path, rounds=2).collect()}
    assert second == {"p": "present", "q": "present", "bad": "trained"}
    whole, _, _ = sw.train_em(units.filter("y in ('p', 'q')"), tokens, rounds=2)
    alone = {(r["y"], r["token"]): r["w"] for r in spark.read.parquet(path).filter("y <> 'bad'").collect()}
    assert alone == pytest.approx({(r["y"], r["token"]): r["w"] for r in sw.unpacked(whole).collect()})
    with pytest.raises(Exception, match="training failed"):
        sw.train_em(units, tokens, rounds=1, step=breaking())[0].collect()


class Killed(BaseException):
    """Ends a run as a signal would; no handler of Exception stops it."""


def test_a_killed_run_goes_on(spark, monkeypatch):
    """A run that ends between waves keeps what it committed; a half-written label is trained again; a job that fails is halved."""
    units = spark.createDataFrame([*UNITS, ("r", "ab", 2), ("01", "ba", 1)], "y string, word string, n long")
    tokens, path = spark.createDataFrame([("a",), ("b",), ("c",)], "token string"), shared(spark, "killed")
    real, calls = sw.train_em, []

    def dies(words, *args, **options):
        calls.append(1)
        if len(calls) == 3:
            raise Killed
        return real(words, *args, **options)

    monkeypatch.setattr(sw, "train_em", dies)
    with pytest.raises(Killed):
        sw.train_isolated(spark, ["p", "q", "r", "01"], units, tokens, path, rounds=1, wave=1)
    kept = {r[0] for r in spark.read.schema("token string, w double, y string").parquet(path).select("y").distinct().collect()}
    assert kept == {"01", "p"}

    def fails(words, *args, **options):
        if words.filter("y = 'r'").count():
            raise RuntimeError("the job failed")
        return real(words, *args, **options)

    monkeypatch.setattr(sw, "train_em", fails)
    status = {r["y"]: r["status"] for r in sw.train_isolated(spark, ["p", "q", "r", "01"], units, tokens, path, rounds=1, wave=4).collect()}
    assert status == {"p": "present", "01": "present", "q": "trained", "r": "failed"}
    spark.createDataFrame([("a", -1.0, "r")], "token string, w double, y string").write.mode("append").partitionBy("y").parquet(path)
    monkeypatch.setattr(sw, "train_em", real)
    status = {r["y"]: r["status"] for r in sw.train_isolated(spark, ["p", "q", "r", "01"], units, tokens, path, rounds=1).collect()}
    assert status["r"] == "trained"
    assert spark.read.schema("token string, w double, y string").parquet(path).groupBy("y").agg(F.count("token").alias("n")).filter("n <> 3").count() == 0


def test_a_workers_memory_does_not_follow_the_rows_of_a_batch(spark):
    """Batches go through in slices of about BATCH_BYTES of text, all rows in order, a long text alone; nulls count as empty."""
    texts = ["ab " * 1000] * 2000 + [None, ""] * 50 + ["ö" * sg.BATCH_BYTES, "x"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts})
    parts = list(sg.by_size(iter([batch, batch.slice(0, 0)])))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    sizes = [sum(len((t or "").encode()) for t in p.column("text").to_pylist()) for p in parts]
    assert len(parts) > 5 and all(x < sg.BATCH_BYTES + 3000 for x in sizes[:-2]) and sum(sizes) < 9 * sg.BATCH_BYTES
    assert sg.ends_by_size(np.array([], np.int64)) == [] and sg.ends_by_size(np.array([5, 0, 5, 11, 1]), 10) == [3, 4, 5]
