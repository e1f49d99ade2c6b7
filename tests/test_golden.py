"""Hand-computed cases of ties, edges and invariants."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions.render import confusion_to_latex, to_latex, to_markdown
from glossa.operators import decisions as dc
from glossa.operators import distributions as d
from glossa.operators import metrics as m
from glossa.operators import model as mo
from glossa.operators import profile as pf
from glossa.operators import sampling as sp
from glossa.operators import segment as sg
from glossa.operators import weights as w
from glossa.sources import lines as src
from glossa.sources import reports
from glossa.sources.store import shared
from glossa.streaming import scoring as st


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_metrics_by_hand(spark):
    rows = frame(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("b", "x"), ("c", None)], "y string, pred string")
    by = {r["label"]: r for r in m.class_scores(rows, []).collect()}
    assert (by["a"]["tp"], by["a"]["fp"], by["a"]["fn"]) == (1, 0, 1)
    assert (by["x"]["support"], by["x"]["fp"], by["x"]["f1"]) == (0, 1, 0.0)
    assert (by["c"]["support"], by["c"]["fn"], by["c"]["fp"], by["c"]["recall"]) == (1, 1, 0, 0.0)
    one = m.summary(m.class_scores(rows, []), []).first()
    assert one["accuracy"] == pytest.approx(0.4)
    assert one["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)  # x is predicted but never true
    assert one["micro_f1"] == pytest.approx(2 * 2 / (2 * 2 + 2 + 3))


def test_bins_are_left_closed(spark):
    rows = frame(spark, [(v,) for v in (0, 29, 30, 74, 75, 150, 299, 300)], "v long").select(m.length_bin(F.col("v")))
    assert [r[0] for r in rows.collect()] == ["<30", "<30", "30--75", "30--75", "75--150", "150--300", "150--300", "300+"]
    rows = frame(spark, [(v,) for v in (499, 500, 999, 1000, 12000, 18000, 35000)], "v long").select(m.resource_bin(F.col("v")))
    assert [r[0] for r in rows.collect()] == ["<500", "500--1k", "500--1k", "1k--12k", "12k--18k", "18k--35k", "35k+"]


def test_auc_with_ties(spark):
    rows = frame(spark, [(1, False), (2, False), (2, True), (3, True)], "v long, p boolean")
    assert m.rank_auc(rows, "v", "p").first()["auc"] == pytest.approx(3.5 / 4)


def test_transition(spark):
    rows = frame(spark, [("a", "a", "a"), ("a", "b", "a"), ("a", "a", "b"), ("a", "b", "b"), ("a", "b", "c"), ("a", None, "a")], "y string, o string, n string")
    assert [r[0] for r in rows.select(m.transition(F.col("o"), F.col("n"), F.col("y"))).collect()] == ["correct", "fixed", "introduced", "same_wrong", "other_wrong", "fixed"]


CANDS = "line_idx long, y string, cands array<struct<score:double,label:string,n_lines:long>>"


def test_gate_outcomes(spark):
    rows = frame(
        spark,
        [(1, "a", [(5.0, "a", 10), (4.5, "b", 10), (4.0, "c", 99)]), (2, "a", [(5.0, "a", 10), (1.0, "c", 99)]), (3, "a", [(5.0, "a", 10)]), (4, "a", [(9.0, "a", 10), (8.9, "b", 10), (-20.0, "c", 99)]), (5, "a", [(2.0, "a", 10), (1.9, "b", 10)])],
        CANDS,
    )
    taus = frame(spark, [("a", 1.0)], "label string, tau double")
    out = {r["line_idx"]: (r["pred"], r["outcome"]) for r in dc.gate(rows, taus, "head", 50, 21.0).collect()}
    assert out == {1: ("c", "moved"), 2: ("a", "kept"), 3: ("a", "kept"), 4: ("a", "blocked_by_proximity"), 5: ("a", "no_candidate")}
    none = dc.gate(rows, taus.limit(0), "second").filter("outcome <> 'kept'")
    assert none.count() == 0
    assert {r["line_idx"]: r["g"] for r in rows.select("line_idx", dc.gap().alias("g")).collect()}[3] == math.inf


def test_ties_take_the_lesser_label(spark):
    rows = frame(spark, [(1, "x", "b", 1, 2.0, 3), (1, "x", "a", 1, 2.0, 3), (1, "x", "c", 1, 1.0, 3)], "line_idx long, y string, label string, n_lines long, score double, n_tokens long")
    assert [c["label"] for c in dc.candidates(rows, 2).first()["cands"]] == ["a", "b"]


def test_few_gaps_exclude_a_label(spark):
    rows = frame(spark, [(i, "a", [(5.0 + i, "a", 10), (4.0, "b", 10)]) for i in range(5)], CANDS).withColumn("own_lines", F.lit(5))
    assert dc.thresholds(rows, 0.5, 6).first()["excluded"] and dc.thresholds(rows, 0.5, 5).first()["tau"] == pytest.approx(3.0)


def test_macro_decision_sums_a_group(spark):
    rows = frame(spark, [(1, "x", [(1.0, "a", 1), (0.9, "b", 1), (0.9, "c", 1)])], CANDS)
    macro = frame(spark, [("a", "one"), ("b", "two"), ("c", "two")], "label string, macro string")
    got = dc.macro_decision(rows, macro).first()
    assert (got["macro"], got["pred"]) == ("two", "b")


def test_bias_learning_lowers_the_loss(spark):
    rows = frame(spark, [(i, "a" if i % 3 else "b", [(1.0, "b", 1), (0.5 + 0.01 * i, "a", 1)]) for i in range(30)], CANDS)
    bias, losses = dc.learn_bias(rows, ["a", "b"], {}, steps=10)
    assert losses[-1] < losses[0] and all(b <= a + 1e-12 for a, b in zip(losses, losses[1:])) and bias["a"] > bias["b"]


@pytest.fixture(scope="module")
def small_model(spark):
    lines = frame(spark, [(1, "p", "L", "aab"), (2, "p", "L", "abc"), (3, "q", "L", "ccc"), (4, "r", "M", "d"), (5, "r", "M", "")], "line_idx long, y string, script string, text string")
    counts = mo.token_counts(lines)
    return mo.smoothed(counts).withColumn("n_lines", F.when(F.col("y") == "p", 90).otherwise(70)).withColumn("script", F.when(F.col("y") == "r", "M").otherwise("L")), mo.base_model(counts)


def row_sums(model):
    return [r[0] for r in model.groupBy("y").agg(F.sum(F.exp("w"))).select("sum(EXP(w))").collect()]


def test_rows_sum_to_one(small_model):
    model, base = small_model
    for changed in (model, w.good_turing(model), w.sharpen(model, 2.0), w.discriminate(model, "a", 1.0), w.discriminate(model, "b", 1.0), w.discriminate(model, "c", 5.0, base)):
        assert row_sums(changed) == pytest.approx([1.0] * 3)


def test_passes_that_change_nothing(small_model):
    model, _ = small_model
    prior = w.backbone_mean(model, "script", "n_lines", 60, 300)
    for same in (w.clamp(model, None), w.equalise_floor(model, 100.0), w.mixed(model, model, F.col("y") == "p")):
        assert w.differing(model, same).first()["differing"] == 0
    shrunk = w.shrink(model, prior, F.lit(0.0))
    assert max(abs(r[0]) for r in shrunk.select(F.col("w") - F.log("p")).collect()) < 1e-12
    lifted = w.back_off(model, prior, "n_lines", 300.0)
    assert lifted.filter(F.col("w") < F.log("p") - 1e-12).count() == 0  # a floor is never lowered


def test_floor_goes_down_only(small_model):
    model, _ = small_model
    down = w.equalise_floor(model, -21.0)
    assert down.filter("NOT seen").select(F.max("w")).first()[0] == -21.0
    assert down.filter("seen").select(F.sum(F.abs(F.col("w") - F.log("p")))).first()[0] < 1e-12


def test_small_groups_are_not_flat(spark):
    rows = frame(spark, [("L", 1.0), ("L", 2.0), ("L", 9.0), ("M", 1.0), ("M", 50.0)], "g string, v double")
    z = sorted((r["g"], round(r["z"], 3)) for r in d.robust_z(rows, "v", "g").collect())
    assert z == [("L", -0.674), ("L", 0.0), ("L", 4.721), ("M", 0.0), ("M", 0.0)]


def test_non_finite_weight_stops(spark):
    with pytest.raises(Exception, match="finite"):
        mo.require(frame(spark, [(float("nan"),)], "w double"), F.isnan("w"), "a weight isn't finite").collect()


def paths(text, ids):
    if not text:
        return [[]]
    return [[text[:k], *rest] for k in range(1, len(text) + 1) if text[:k] in ids for rest in paths(text[k:], ids)]


def test_segmentation_against_all_paths():
    tokens = ["a", "ab", "abc", "b", "bc", "c"]
    rng = np.random.default_rng(4)
    lattice = sg.Lattice(tokens, rng.normal(-2, 1, (3, len(tokens))))
    for text in ("abc", "aabbcc", "abcabcab", "c"):
        found = paths(text, lattice.ids)
        for row in range(3):
            value = [sum(lattice.weights[row, lattice.ids[t]] for t in p) for p in found]
            assert lattice.score(text)[row] == pytest.approx(max(value))
            assert lattice.score(text, marginal=True)[row] == pytest.approx(np.logaddexp.reduce(value))
    assert lattice.score("axb")[0] == pytest.approx(lattice.weights[0, 0] + lattice.unknown[0] + lattice.weights[0, 3])


def test_empty_texts_keep_a_row(spark, small_model):
    out = {r["line_idx"]: r for r in sg.score_texts(frame(spark, [(1, "aab"), (2, ""), (3, None)], "line_idx long, text string"), small_model[0], k=2).collect()}
    assert out[1]["pred"] == "p" and len(out[1]["candidates"]) == 2
    assert out[2]["pred"] is None and out[2]["status"] == out[3]["status"] == "EMPTY"


def test_labelled_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("__label__x one two\n__label__y\nno label here\n__label__z a\tb\n")
    rows = sorted(tuple(r) for r in src.read_labelled(spark, str(tmp_path), train=True).collect())
    assert rows == [("x", "one two"), ("y", ""), ("z", "a\tb")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.tsv").write_text('eng\tsay "a"\tb\nfra\t\n')
    rows = sorted(tuple(r) for r in src.read_tsv(spark, str(tmp_path / "t")).collect())
    assert rows == [("eng", 'say "a"\tb'), ("fra", "")]
    assert src.unknown_labels(src.read_tsv(spark, str(tmp_path / "t")), frame(spark, [("eng",)], "label string")).first()[0] == "fra"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "w.tsv").write_text("eng sco\tIE\tGermanic\neng\tother\tother\n")
    assert src.fingerprint(spark, str(tmp_path / "c")).first()["length"] == 36


def test_code_tables(spark, tmp_path):
    head = "ISO_codes,ISO639P3code,Family,Genus\n"
    (tmp_path / "b.csv").write_text(head + 'eng,,late,late\nfra,,"Indo, European",\n')
    (tmp_path / "a.csv").write_text(head + "eng sco;nld,eng,,Germanic\n,deu,IE,Germanic\n" + "eng,,IE,\n" * 5000 + "sco,,last,last\n")
    wanted = [("deu", "IE", "Germanic"), ("eng", "IE", "Germanic"), ("fra", "Indo, European", None), ("nld", None, "Germanic"), ("sco", "last", "Germanic")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many tasks a file
    try:
        assert sorted(tuple(r) for r in src.read_codes(spark, str(tmp_path)).collect()) == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    src.write_codes(frame(spark, [("x", None, None, "g")], "ISO_codes string, ISO639P3code string, Family string, Genus string"), str(tmp_path / "n"))
    with pytest.raises(ValueError, match="no family"):
        src.read_codes(spark, str(tmp_path / "n"))


def test_reports(spark):
    path = shared(spark, "reports")
    rows = frame(spark, [("a|b", 1, 0.5, True), (None, None, None, None), ("", 3, 1.25, False), ('say "x", y\nz', 4, 2.0, True)], "name string, n long, v double, ok boolean").orderBy("n")
    assert reports.write_report(rows, path, "r", "A caption") == ["csv", "markdown", "latex"]
    assert reports.write_report(rows, path, "r", "A caption") == []
    assert reports.write_report(rows, path, "r", "Another", ("csv",)) == ["csv"]
    digest = os.listdir(path.removeprefix("file://") + "/r")
    assert len(digest) == 2
    broken = [f"{path.removeprefix('file://')}/r/{d}/latex-done" for d in digest if os.path.isdir(f"{path.removeprefix('file://')}/r/{d}/latex-done")]
    for name in os.listdir(broken[0]):
        os.remove(f"{broken[0]}/{name}")
    assert reports.write_report(rows, path, "r", "A caption") == ["latex"]
    with pytest.raises(ValueError, match="over 1000"):
        reports.write_report(spark.range(1001), path, "many", "x")
    plain = frame(spark, [("x", 1, 0.5), ("y", None, None)], "label string, n long, v double").orderBy("label")
    reports.write_report(plain, path, "p", "x")
    back = reports.read_report(spark, path, "p", "label string, n long, v double")
    assert sorted(tuple(r)[:3] for r in back.collect()) == [("x", 1, 0.5), ("y", None, None)] and len(back.first()["digest"]) == 16


def sketch_of(words):
    """Registers by plain arithmetic on the md5 as a number."""
    out = {}
    for x in words:
        h = int(hashlib.md5(x.encode()).hexdigest(), 16)
        bits = (h >> 12) & (2**64 - 1)
        out[h & 4095] = max(out.get(h & 4095, 0), 65 - bits.bit_length())
    return out


def test_sketches_merge(spark):
    a, b = [f"w{i}" for i in range(3000)], [f"w{i}" for i in range(2000, 40_000)]
    one, two = (pf.registers(frame(spark, [("p", x) for x in xs], "y string, word string"), "y") for xs in (a, b))
    assert {r["register"]: r["rank"] for r in one.collect()} == sketch_of(a)
    both = pf.merged(one.unionByName(two), "y")
    assert {r["register"]: r["rank"] for r in both.collect()} == sketch_of(a + b)
    for sketch, words in ((one, 3000), (both, 40_000)):
        assert pf.estimate(sketch, "y").first()["words"] == pytest.approx(words, rel=0.05)
    assert pf.estimate(one.limit(0), "y").count() == 0


def test_divergences_in_chunks(spark, monkeypatch):
    """Every pair against the definition, with tokens in several chunks and tasks; a missing cell stops it."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet(np.ones(700), 5)
    cells = [(f"l{y}", f"t{t}", float(p[y, t])) for y in range(5) for t in range(700)]
    rng.shuffle(cells)
    rows = frame(spark, [(str(y), str(t), float(v)) for y, t, v in cells], "y string, token string, p double")
    monkeypatch.setattr(d, "CHUNK", 7)
    for parts in (1, 3):
        found = {(r["a"], r["b"]): r["sym_kl"] for r in d.pairwise(rows, parts=parts).collect()}
        wanted = {(f"l{a}", f"l{b}"): float(((p[a] - p[b]) * np.log(p[a] / p[b])).sum() / 2) for a in range(5) for b in range(a + 1, 5)}
        assert found == pytest.approx(wanted)
    with pytest.raises(Exception, match="lacks weights"):
        d.pairwise(rows.filter("NOT (y = 'l2' AND token = 't5')")).collect()
    assert d.pairwise(rows.limit(0)).count() == 0


def test_richer_labels_by_buckets(spark):
    rng = np.random.default_rng(3)
    labels = [(f"l{i}", [None, "A", "B"][i % 3], int(n)) for i, n in enumerate([0, 1, 2, 3, 4, 7, 8, 8, 9, 1000, 1023, 1024, *rng.integers(0, 5000, 60)])]
    found = {tuple(r) for r in d.richer(frame(spark, labels, "y string, script string, n_lines long")).collect()}
    assert found == {(a, b) for a, s, n in labels for b, t, k in labels if s is not None and s == t and k > n}


def test_replayed_batches_count_once(spark):
    folder = shared(spark, "sums")
    merge = st.merge_sums(folder)
    first, second = frame(spark, [("p", "ab"), ("p", "abcd"), ("q", "")], "y string, text string"), frame(spark, [("p", "x")], "y string, text string")
    for rows, batch in ((first, 0), (second, 1), (first, 0), (second, 1), (second, 1)):
        merge(rows, batch)
    found = {r["y"]: tuple(r)[1:] for r in st.read_sums(spark, folder).collect()}
    assert found == {"p": (3, round(7 / 3, 6), pytest.approx(np.std([2, 4, 1]), abs=1e-6)), "q": (1, 0.0, 0.0)}


def test_imports_are_checked(spark):
    lines, labels = frame(spark, [(1,), (2,)], "line_idx long"), frame(spark, [("a",)], "label string")
    for predictions, fault in (([(1, "a")], "no prediction"), ([(1, "a"), (2, "x")], "unknown"), ([(1, "a"), (2, "a"), (3, "a")], "no line"), ([(1, "a"), (2, "a"), (2, "a")], "two")):
        with pytest.raises(Exception, match=fault):
            src.import_predictions(lines, frame(spark, predictions, "line_idx long, pred string"), labels).collect()


def test_models_are_checked(spark, small_model):
    model = small_model[0].select("y", "token", "w")
    path = shared(spark, "model")
    with pytest.raises(ValueError):
        src.save_model(model.limit(5), path, 3, 4)
    src.save_model(model, path, 3, 4)
    with pytest.raises(Exception, match="(?i)exist"):
        src.save_model(model, path, 3, 4)
    assert src.load_model(spark, path).count() == 12


def test_draws_do_not_meet(spark):
    rows = spark.range(500).selectExpr("id AS line_idx", "CASE WHEN id < 400 THEN 'a' ELSE 'b' END AS y")
    one = sp.balanced_draw(rows, 1)
    two = sp.balanced_draw(rows, 2, exclude=one)
    assert one.join(two, "line_idx").count() == 0
    assert {r["y"]: r["count"] for r in one.groupBy("y").count().collect()} == {"a": 100, "b": 50}
    assert {r["y"]: r["count"] for r in two.groupBy("y").count().collect()} == {"a": 100, "b": 25}


def test_adoption(spark):
    strata = frame(spark, [("overall", 0.8, 0.81, None), ("tail", 0.5, 0.48, 0.03), ("head", 0.9, 0.9, None)], "stratum string, base double, cand double, gain double")
    labels = frame(spark, [(f"l{i}", 0.5, 0.5 if i > 1 else 0.3, 20) for i in range(9)] + [("rare", 1.0, 0.0, 3)], "label string, base_f1 double, cand_f1 double, support long")
    got = sp.two_sided(strata, labels.filter("label <> 'rare'").withColumn("cand_f1", F.col("cand_f1") + 0.05), support=10).first()
    assert got["adopted"] and got["collapsed"] == 2
    assert not sp.two_sided(strata.withColumn("gain", F.lit(0.0)), labels).first()["adopted"]
    assert not sp.passes_guard(strata).first()[0] and sp.passes_guard(strata.filter("stratum <> 'tail'")).first()[0]


def test_noise_rates(spark):
    rows = frame(spark, [("abcdef ghi " * 50,)], "t string")
    same = rows.select(sp.noise(F.col("t"), 0.0, 1), F.col("t"), sp.noise(F.col("t"), 0.5, 1)).first()
    assert same[0] == same[1] and len(same[2]) == len(same[1])
    changed = np.mean([a != b for a, b in zip(same[1], same[2], strict=True) if a != " "])
    assert 0.4 < changed < 0.56 and all(b == " " for a, b in zip(same[1], same[2], strict=True) if a == " ")


def test_domains_and_scripts(spark):
    rows = frame(spark, [("see 3:16",), ("The GOSPEL",), ("== Head ==",), ("a [[b]]",), ("x [12]",), ("plain",)], "t string")
    assert [r[0] for r in rows.select(pf.classify_domain(F.col("t"))).collect()] == ["religious", "religious", "wikipedia", "wikipedia", "wikipedia", "other"]
    one = frame(spark, [("abé Яш 漢 1!",)], "t string").select(pf.detect_script(F.col("t"))).first()[0]
    assert one == {"Latin": 3, "Cyrillic": 2, "Han": 1}


def test_tables_are_rendered(spark):
    df = frame(spark, [("a_b", 1234, 0.5), ("c|d", None, 1.0)], "name string, n long, v double")
    assert to_markdown(df, "T") == "**T**\n\n| name | n     | v     |\n|------|-------|-------|\n| a_b  | 1,234 | 0.500 |\n| c\\|d | --    | 1.000 |\n"
    assert r"a\_b & 1,234 & 0.500 \\" in to_latex(df, "T", "tab:t")
    with pytest.raises(ValueError):
        to_markdown(spark.range(20), most=10)


def test_blocks_equal_single_texts():
    rng = np.random.default_rng(8)
    tokens = ["a", "b", "ab", "ba", "aba", "c\U0001f600"]
    lattice = sg.Lattice(tokens, rng.normal(-2, 1, (3, len(tokens))))
    texts = ["".join(rng.choice(list("abc\U0001f600"), n)) for n in (0, 1, 2, 3, 9, 9, 17, 40)]
    for marginal in (False, True):
        scores, size = lattice.scores(texts, marginal)
        for i, t in enumerate(texts):
            assert scores[i] == pytest.approx(lattice.score(t, marginal))
            assert size[i].tolist() == lattice.scores([t], marginal)[1][0].tolist()


def test_token_deltas_by_hand(spark):
    model = frame(spark, [(y, t, w) for y, row in {"p": (-1.0, -1.0, -3.0), "q": (-3.0, -3.0, -1.5)}.items() for t, w in zip(("a", "b", "ab"), row, strict=True)], "y string, token string, w double")
    rows = sg.score_lines(frame(spark, [(1, "p", "abab"), (2, "q", ""), (3, "p", "ab")], "line_idx long, y string, text string"), model, 1, own="y").collect()
    one = {r["line_idx"]: [(c["label"], c["score"], c["n_tokens"]) for c in r["cands"]] for r in rows}
    assert one[1] == [("q", -3.0, 2), ("p", -4.0, 4)] and one[2] == [] and one[3] == [("q", -1.5, 1), ("p", -2.0, 2)]
    short = sg.score_lines(frame(spark, [(1, "p", "abab")], "line_idx long, y string, text string"), model, 1, alpha=1.0).first()["cands"][0]
    assert (short["label"], short["score"]) == ("p", -1.0)  # a token scores -1 under p and -1.5 under q


def test_labels_in_blocks_score_alike(spark, small_model, monkeypatch):
    lines = frame(spark, [(1, "aab"), (2, "ccd"), (3, "")], "line_idx long, text string")
    whole = {r["line_idx"]: r["cands"] for r in sg.score_lines(lines, small_model[0], 2).collect()}
    monkeypatch.setattr(sg, "MOST_BYTES", 40)  # one label of four tokens
    assert {r["line_idx"]: r["cands"] for r in sg.score_lines(lines, small_model[0], 2).collect()} == whole


def test_delta_statistics(spark):
    deltas = [0, 1, -1, 2, 2, -3, 5, 0]
    rows = frame(spark, [(d,) for d in deltas], "delta long")
    v = np.array(deltas, float)
    t = m.one_sample_t(rows).first()
    assert t["cohen_d"] == pytest.approx(v.mean() / v.std(ddof=1)) and t["t"] == pytest.approx(t["cohen_d"] * math.sqrt(8))
    r = m.signed_rank(rows).first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (6, 1.5 + 3.5 + 3.5 + 6, 1.5 + 5)
    assert m.one_sample_t(rows.limit(0)).first()["t"] is None and m.signed_rank(rows.limit(0)).first()["n"] == 0


def test_preflight(spark):
    lines = frame(spark, [("p", "abab"), ("q", ""), ("r", "ba")], "y string, text string")
    checks = {r["check"]: r["passed"] for r in sg.preflight(["a", "a"], lines, ["<s>"], 3).collect()}
    assert not checks["special tokens"] and not checks["vocabulary size"] and not checks["tokens unique and not empty"] and checks["lines a label"]


def test_ranks_and_first_rows_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("id * id % 7919 * 3 AS v", "CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS y").dropDuplicates()
    by = {}
    for r in sp.rank_in(rows, ["y"], "v").collect():
        by.setdefault(r["y"], []).append((r["v"], r["rank"]))
    assert all([k for _, k in sorted(x)] == list(range(1, len(x) + 1)) for x in by.values())
    first = sp.first_by(rows, ["y"], [F.col("v")], 7).collect()
    assert all(sorted(r["v"] for r in first if r["y"] == y) == sorted(v for v, _ in x)[:7] for y, x in by.items())


def test_script_totals_look_at_a_code_point_once(spark):
    """Counts of code points give what whole texts give, in every script; a billion repeats are one row."""
    text = "aZ[é̄ḁ7 Жԯ Ωα שא কখ ㄅ漢𠀀 ꓐⴰ"
    tokens = frame(spark, [("x", c, text.count(c)) for c in sorted(set(text))], "y string, token string, n long")
    whole = frame(spark, [(text,)], "t string").select(pf.detect_script(F.col("t")).alias("m")).first()["m"]
    each = {s: int(frame(spark, [(text,)], "t string").select(pf.script_count(F.col("t"), s)).first()[0]) for s in pf.SCRIPTS}
    assert {r["script"]: r["n"] for r in pf.script_totals(tokens, "y").collect()} == whole == {s: n for s, n in each.items() if n}
    assert pf.script_totals(frame(spark, [("x", "a", 10**9)], "y string, token string, n long"), "y").first()["n"] == 10**9


def test_pairs_are_counted_in_tasks(spark):
    """Neighbouring code points by label, overlaps included, none across texts; the plan makes no row a pair."""
    texts = [("x", "aab"), ("x", "baa"), ("x", "a"), ("x", ""), ("x", None), ("z", "𠀀é𠀀"), ("z", "aaaa")]
    got = mo.pair_counts(frame(spark, texts, "y string, text string"))
    want = {("x", "aa"): 2, ("x", "ab"): 1, ("x", "ba"): 1, ("z", "𠀀é"): 1, ("z", "é𠀀"): 1, ("z", "aa"): 3}
    assert {(r["y"], r["token"]): r["n"] for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_bootstrap_by_counts(spark):
    rows = spark.range(4000).selectExpr("CAST(id % 4 = 0 AS INT) AS v")
    got = sp.bootstrap_counts(rows, "v", 400, 3).first()
    spread = math.sqrt(0.25 * 0.75 / 4000)
    assert got["mean"] == 0.25 and got["low"] == pytest.approx(0.25 - 1.96 * spread, abs=0.004) and got["high"] == pytest.approx(0.25 + 1.96 * spread, abs=0.004)


def test_poisson_draws(spark):
    """Pieces add up to n, tables are the law's, and draws have its mean and variance at small and large n."""
    for mean in sp.MEANS:
        law = [math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(400)]
        assert sp.poisson_table(mean) == pytest.approx(np.cumsum(law)[: len(sp.poisson_table(mean))])
    counts = frame(spark, [("a", 0), ("b", 1), ("c", 63), ("d", 64), ("e", 1000)], "v string, n long")
    whole = counts.select("v", "n", F.aggregate(sp.poisson_pieces(F.col("n")), F.lit(0).cast("long"), lambda s, p: s + p["mean"]).alias("m")).collect()
    assert all(r["n"] == r["m"] for r in whole)
    drawn = sp.poisson_draws(counts, F.col("v"), 2000, 1).groupBy("v", "draw").agg(F.sum("k").alias("k")).groupBy("v").agg(F.avg("k").alias("mean"), F.var_pop("k").alias("var"))
    for r in drawn.collect():
        n = {"b": 1, "c": 63, "d": 64, "e": 1000}[r["v"]]
        assert r["mean"] == pytest.approx(n, abs=4 * math.sqrt(n / 2000)) and r["var"] == pytest.approx(n, rel=0.15)


def test_poisson_draws_of_a_large_count_are_dealt_out(spark):
    """One count in one part: the pieces, which grow with it, are drawn in several tasks, as md5 of seed, draw, key, mean and piece says."""
    n, draws = 64 * 1000 + 17, 3
    rows = sp.poisson_draws(frame(spark, [("x", n)], "v string, n long").coalesce(1), F.col("v"), draws, 4).withColumn("part", F.spark_partition_id()).collect()
    assert len({r["part"] for r in rows}) > 1 and len(rows) < 100 * draws
    for draw in range(draws):
        u = lambda mean, i: int(hashlib.md5(f"4:{draw}:x:{mean}:{i}".encode()).hexdigest()[:13], 16) / 16**13  # noqa: B023, E731
        k = sum(sum(u(mean, i) >= c for c in sp.poisson_table(mean)) for mean, pieces in ((64, 1000), (16, 1), (1, 1)) for i in range(pieces))
        assert sum(r["k"] for r in rows if r["draw"] == draw) == k


def test_bootstrap_of_macro_f1(spark):
    """Intervals against resampled lines in numpy; equal systems never differ."""
    rng = np.random.default_rng(5)
    y = rng.choice(["p", "q", "r"], 1500, p=[0.7, 0.25, 0.05])
    a, b = (np.where(rng.random(1500) < rate, y, rng.choice(["p", "q", "s"], 1500)) for rate in (0.7, 0.8))
    rows = frame(spark, [(str(t), str(i) if i != "s" else None, str(j)) for t, i, j in zip(y, a, b, strict=True)], "y string, a string, b string")

    def macro(t, p):
        return np.mean([2 * np.sum((t == x) & (p == x)) / (np.sum(t == x) + np.sum(p == x)) for x in np.unique(t)])

    deltas = []
    for _ in range(1000):
        at = rng.integers(0, 1500, 1500)
        deltas.append(macro(y[at], b[at]) - macro(y[at], np.where(a == "s", "none", a)[at]))
    got = sp.bootstrap_macro_f1(rows, "a", "b", 500, 2).first()
    assert [got["mean"], got["low"], got["high"]] == pytest.approx([np.mean(deltas), *np.percentile(deltas, [2.5, 97.5])], abs=0.012)
    assert tuple(sp.bootstrap_macro_f1(rows, "b", "b", 50, 2).first()) == (0.0, 0.0, 0.0)


def test_ranks_of_hashed_and_far_values(spark):
    ids = [(i * 2654435761 * 40503 % 2**63) * (-1) ** i for i in range(3000)] + [10**12, None, None, 5, 5, 5]
    rows = frame(spark, [("hot" if i % 10 else None, v) for i, v in enumerate(ids)], "y string, v long")
    by = {}
    for r in sp.rank_in(rows, ["y"], "v").collect():
        by.setdefault(r["y"], []).append((r["v"] is not None, r["v"] or 0, r["rank"]))
    assert set(by) == {"hot", None}
    for found in by.values():
        assert [k for *_, k in sorted(found)] == list(range(1, len(found) + 1))
    everything = sp.rank_in(rows.select("v"), [], "v").collect()
    assert sorted(r["rank"] for r in everything) == list(range(1, len(ids) + 1))
    assert sp.rank_in(rows.limit(0), ["y"], "v").count() == 0


def test_stops(spark):
    rows = frame(spark, [(i, "a", [(5.0 + i, "a", 10), (4.0, "b", 10)]) for i in range(5)], CANDS).withColumn("own_lines", F.lit(5))
    with pytest.raises(Exception, match="gaps"):
        dc.thresholds(rows, 0.5, 6, stop=True).collect()
    saved = rows.select("line_idx", F.when(F.col("line_idx") == 0, "b").otherwise("a").alias("saved"))
    assert sorted(r["line_idx"] for r in dc.agreeing(rows, saved, 0.8).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="under 0.99"):
        dc.agreeing(rows, saved)
    value = frame(spark, [(0.94,)], "v double")
    assert sp.accept(value, "v", 0.944).first()["accepted"]
    with pytest.raises(Exception, match="0.005"):
        sp.accept(value, "v", 0.95).collect()


def test_macro_tags(spark):
    rows = frame(spark, [("uzn", "uzb", "uzb"), ("uzn", "uzb", "uzn"), ("fil", None, "tgl"), ("tgl", None, "fil"), ("eng", None, None), ("uzn", "uzb", "uzs")], "pred string, macro string, gold string")
    assert [r[0] for r in rows.select(m.macro_correct(F.col("pred"), F.col("macro"), F.col("gold"), ("tgl", "fil"))).collect()] == [True, True, True, False, False, False]


def test_web_tables_and_macros(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "w.tsv.gz", "wt") as f:
        f.write('text\ttag\nsay "a\\b", x\teng \n\tfra\n')
    assert sorted((r["label"], r["text"]) for r in src.read_web(spark, str(tmp_path / "w.tsv.gz")).collect()) == [("eng", 'say "a\\b", x'), ("fra", "")]
    (tmp_path / "m.tab").write_text("M_Id\tI_Id\tstatus\nuzb\tuzn\tA\nuzb\tuzs\tA\n")
    assert sorted(tuple(r) for r in src.read_macros(spark, str(tmp_path / "m.tab")).select("member", "macro").collect()) == [("uzn", "uzb"), ("uzs", "uzb")]
    assert "commit" in src.fingerprint(spark, str(tmp_path / "m.tab")).columns


def test_confusion_table(spark):
    tex = confusion_to_latex(frame(spark, [("a_b", "a_b", 0.9), ("a_b", "c", 0.1)], "true string, pred string, share double"), "T", "tab:t")
    assert r"a\_b & \cellcolor{blue!54}90.0 & \cellcolor{blue!6}10.0 \\" in tex and r"c & -- & -- \\" in tex


def test_texts_are_normalised():
    assert sg.preprocess("e\u0301  x\ty", "NFC", "\u2581") == "\u00e9\u2581x\u2581y" and sg.preprocess(None, "NFC") == ""


def test_stream_sums_files_grow_with_the_table(spark, sf, monkeypatch):
    """The stream has a file a part of the table, so no task reads a fixed share of it."""
    from glossa.plans import scoring

    paths, shared_, labelled_ = [], scoring.shared, scoring.labelled
    monkeypatch.setattr(scoring, "shared", lambda s, name: paths.append(shared_(s, name)) or paths[-1])
    monkeypatch.setattr(scoring, "labelled", lambda s, d: labelled_(s, d).repartition(9))
    scoring.stream_sums(spark, sf)
    assert len(spark.read.parquet(paths[0]).inputFiles()) == 9
