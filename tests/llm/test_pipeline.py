"""Each pipeline stage on its own input, against plain Python."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_operators import classes, near_copies, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, docs, source=lambda i: f"s{i % 4}"):
    return spark.createDataFrame([(d, t, "en", source(i), len(t or "")) for i, (d, t) in enumerate(docs)], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    items = [(i, prose(20 + i, 7000 + i)) for i in range(6)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    good = [(i, prose(80, i).capitalize() + ". " + prose(60, i + 9000) + ".") for i in range(160)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(90, i + 500).split())) for i in range(60)]
    marks = [(d, 1, 0) for d, _ in good[:120]] + [(d, 0, 0) for d, _ in bad[:45]]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    leaks = [(2000 + i, prose(50, i).capitalize() + ". " + prose(30, i + 8000) + " " + t + " " + prose(30, i + 40) + ".") for i, t in items]
    table(spark, good + bad + leaks + [(3000 + d, t + " more") for d, t in good[:20]]).write.parquet(f"{path}/documents.parquet")
    return str(path), good, bad, leaks


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect() if r[0] is not None)


def test_quality_keeps_clean_documents(spark, folder):
    path, good, bad, leaks = folder
    kept = cp.quality(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert kept.columns == cp.COLUMNS
    wanted = {d for d, _ in good} | {d for d, _ in leaks} | {3000 + d for d, _ in good[:20]}
    assert set(ids(kept)) == wanted


def test_near_duplicates_keeps_one_of_each(spark):
    docs = near_copies()[:230] + [(900, None), (901, ""), (902, " ")]
    rows = docs + [docs[3], docs[3]]
    kept = cp.near_duplicates(spark, table(spark, rows), "")
    assert ids(kept) == sorted({d if not n else c for d, n, c in classes(docs)})
    assert {tuple(r)[:2] for r in kept.collect()} <= {(d, t) for d, t in docs}


def test_decontaminate_drops_the_leaks_alone(spark, folder):
    path, _, _, leaks = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert set(ids(docs)) - set(ids(cp.decontaminate(spark, docs, path))) == {d for d, _ in leaks}


def test_mixture_repeats_rows(spark):
    docs = [(i, prose(50, i)) for i in range(400)]
    mixed = cp.mixture(spark, table(spark, docs), "").collect()
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 2 and abs(len(mixed) - 600) <= 8
    assert all(r["text"] == dict(docs)[r["doc_id"]] for r in mixed)


def test_shards_number_every_row(spark):
    docs = [(i, prose(5 + i % 9, i // 3)) for i in range(300)]
    rows = cp.shards(spark, table(spark, docs), "").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(300))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_run(spark, folder):
    path, good, bad, leaks = folder
    out = cp.run(spark, path).collect()
    assert {r["doc_id"] for r in out} <= {d for d, _ in good}
    words = sum(len(re.findall(r"\S+", t)) for _, t in good)
    assert abs(sum(r["size"] for r in out) / sum(len(t.encode()) + 1 for _, t in good) - 1.5) < 0.1 and words


def test_empty_tables(spark, folder):
    path = folder[0]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, path).count() == 0


def test_near_duplicates_tells_texts_of_an_id_apart(spark):
    a, b, c = (prose(40, 70 + i) for i in range(3))
    rows = [(2, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, b + " x"), (None, prose(30, 99)), (None, prose(30, 99)), (8, None), (8, None), (None, "")]
    kept = cp.near_duplicates(spark, table(spark, rows).withColumn("k", F.lit(1)).withColumn("once", F.lit("x")), "")
    assert kept.columns == cp.COLUMNS
    wanted = [(2, a), (5, b), (7, c), (None, prose(30, 99)), (8, None), (8, None), (None, "")]
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted(wanted, key=str)


def odd_rows(spark):
    """Nulls everywhere, an id with two texts, repeated rows, empty and long texts, clashing names."""
    rows = [(i, prose(60, i), "en", f"s{i % 2}", 1) for i in range(20)]
    rows += [(None, prose(60, 50), None, None, None), (3, prose(60, 3), "en", "s1", 1), (3, prose(60, 51), "en", "s1", 1), (30, None, None, "s0", None), (31, "", "en", None, 0), (None, None, None, None, None), (32, prose(9000, 52), "en", "s0", 1)]
    return spark.createDataFrame([(*r, "x", 2.0, "k") for r in rows], SCHEMA + ", size string, score double, text_key string")


def test_odd_rows_in_every_stage(spark, folder):
    path, docs = folder[0], odd_rows(spark)
    pairs = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    of = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, path).columns == cp.COLUMNS, name
    scored = of(cp.quality(spark, docs, path))
    assert collections.Counter(scored) <= collections.Counter(pairs) and len(scored) >= 20
    assert len(of(cp.near_duplicates(spark, docs, path))) == len(pairs) - 1
    bench = {f"{i}" for i in range(6)}
    assert len(of(cp.decontaminate(spark, docs, path))) == len(pairs) and bench
    mixed = collections.Counter(of(cp.mixture(spark, docs, path)))
    assert all(t for _, t in mixed) and max(mixed.values()) <= 4 and set(mixed) <= set(pairs)
    assert cp.shards(spark, docs, path).count() == len(pairs)
