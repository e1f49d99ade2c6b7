"""Exact deduplication, the Merkle manifest and lexical search against plain Python, with odd rows and small parameters."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import op11_exact, op12_merkle, op13_lexical

DOCS = "doc_id long, text string, source string, lang string, n_chars long, n long, key string, digest string, path string, rank string"
random.seed(8)
VOCABULARY = ["".join(random.choices("abcdefghij", k=random.randint(1, 6))) for _ in range(150)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, hot texts, and columns named as the operators' own."""
    rows = [(i, prose(10 + i % 7, i % 23), f"s{i % 3}", "en" if i % 3 else "de", i) for i in range(90)]
    rows += [(200 + i, " the  same\ttext ", "s0", "en", 3) for i in range(60)] + [(None, "the same text", None, "en", None)]
    rows += [(300, None, None, None, None), (301, "", "s", "fr", 0), (302, " \t\n", "s", "fr", 0), (303, " ", "s", "fr", 0), (None, None, None, None, None), (None, "only here", "s", None, 9), (None, "only here", "s", None, 9)]
    rows += [(304, "x" * 70_000, "s", "é", 1), (305, prose(20_000, 5), "s", "en", 2), (306, "É€😀 A-b_c'D 1 2", "s", "e", 7), (7, rows[7][1], *rows[7][2:]), (7, rows[7][1], *rows[7][2:])]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(d, t, s, g, n, 1, "k", "d", "p", "r") for d, t, s, g, n in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_filter_holds_all_keys_and_few_others():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 10, 500, 4096, 30_000):
        keys = r.integers(0, 2**63, n, dtype=np.uint64)
        fuse = op11_exact.build_filter(np.concatenate([keys, keys[: n // 2]]))
        assert op11_exact.in_filter(keys, *fuse).all()
        others = op11_exact.in_filter(r.integers(0, 2**63, 100_000, dtype=np.uint64), *fuse).mean()
        assert others < 0.006
        if n > 1000:
            assert len(fuse[3]) < 1.4 * n


def equal_texts(docs):
    """Counter of (doc_id, keep_id, group_size, kept)."""
    by = collections.defaultdict(list)
    for d, t in docs:
        by[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(d)
    out = collections.Counter()
    for ids in by.values():
        ids.sort(key=lambda d: (d is None, d or 0))
        for i, d in enumerate(ids):
            out[d, ids[0], len(ids), i == 0] += 1
    return out


def weak(text):
    """Five digests for all texts, so that different texts share one."""
    return F.concat(F.lit("d"), F.pmod(F.xxhash64(text), F.lit(5)).cast("string"))


@pytest.mark.parametrize("options", [{}, {"parts": 1}, {"parts": 4, "keys": 8}, {"parts": 3, "few": 0}, {"parts": 3, "digest": weak}, {"parts": 2, "digest": weak, "few": 0}])
def test_exact_dedup(odd, none, options):
    rows = op11_exact.exact_dedup(odd, **options).collect()
    found = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows)
    assert found == equal_texts([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert op11_exact.exact_dedup(none, **options).count() == 0


def test_screen_lets_all_known_through(spark):
    known = op11_exact.snapshot(spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text"), keys=100)
    assert known.buckets == 30 and known.filters.count() == 30
    asked = op11_exact.snapshot(spark.range(2000, 8000).selectExpr("id AS doc_id", "concat('t', id) AS text"), 1)
    positive = {r["digest"] for r in op11_exact.screen(asked.digests, known).collect()}
    true = {hashlib.sha256(f"t{i}".encode()).hexdigest() for i in range(2000, 3000)}
    assert true <= positive and len(positive - true) < 60  # about 5,000 / 256


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grown(nodes):
    """All levels over nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, at):
    return [(level[at >> h ^ 1] if at >> h ^ 1 < len(level) else "", (at >> h) & 1) for h, level in enumerate(levels[:-1])]


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def merkle(rows):
    """Counter of the expected rows, by whole trees in memory."""
    leaf = lambda r, more=0: H(*(field(r[c] + more if c == "n_chars" and r[c] is not None else r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda x: x[:3])
        trees[g] = grown([x[2] for x in by[g]])
    top = grown([trees[g][-1][0] for g in langs])
    out = collections.Counter()
    for i, g in enumerate(langs):
        for at, (_, _, own, r) in enumerate(by[g]):
            path = siblings(trees[g], at) + siblings(top, i)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, 1) if hit else own
            for other, before in path:
                node = H(other, node) if before else H(node, other)
            out[r["doc_id"], own, trees[g][-1][0], top[-1][0], H(*(s for s, _ in path)), node, node == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("block", [2, 4, 16, 1024])
def test_merkle(odd, none, block):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    made = op12_merkle.manifest(odd, op12_merkle.tampering(), block=block).select(*columns)
    wanted = merkle(odd.collect())
    assert collections.Counter(tuple(r) for r in made.collect()) == wanted
    assert any(not w[-1] for w in wanted)
    assert op12_merkle.manifest(none, op12_merkle.tampering(), block=block).count() == 0


def test_merkle_small_trees(spark):
    for n in (1, 2, 3, 5, 17):
        docs = spark.createDataFrame([(i, f"t{i}", "s", "en", i) for i in range(n)], "doc_id long, text string, source string, lang string, n_chars long")
        rows = op12_merkle.manifest(docs, block=4).collect()
        assert {r["root"] for r in rows} == {r["subroot"] for r in rows} and all(r["verified"] for r in rows)
        assert {tuple(r[c] for c in ("doc_id", "leaf", "root")) for r in rows} == {(k[0], k[1], k[3]) for k in merkle(docs.collect())}
        if n == 1:
            assert rows[0]["root"] == rows[0]["leaf"] and rows[0]["proof_sha256"] == H()


def ranked(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, collections.Counter(words(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        asked, scores = collections.Counter(words(text)), []
        for d, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // max(total, 1)
            s = sum(q * w[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if x[1] else x[2], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


ITEMS = [(i, prose(n, 500 + i)) for i, n in enumerate((1, 2, 3, 8, 15, 40, 90))] + [(50, None), (51, ""), (52, "nowhere zz9 only"), (53, prose(12, 3)), (53, prose(12, 3)), (None, "É€😀 THE Same 1"), (54, VOCABULARY[0] * 1 + " " + (VOCABULARY[1] + " ") * 9)]


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"k": 5, "most_terms": 10}, {"block_rows": 20}])
def test_lexical(spark, odd, none, options):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, rank string").repartition(3)
    rows = [tuple(r) for r in op13_lexical.search(odd, items, **options).collect()]
    assert sorted(rows, key=str) == ranked([(r["doc_id"], r["text"]) for r in odd.collect()], ITEMS, options.get("k", 20))
    assert op13_lexical.search(none, items, **options).count() == 0
    assert op13_lexical.search(odd, items.limit(0), **options).count() == 0


def test_lexical_prunes_terms(spark):
    """One rare term whose kth impact outweighs the common ones: these are not needed, and the result is whole."""
    docs = [(i, f"{'common' if i % 2 else 'usual'} {'plain' if i % 3 else 'x'} {'rare rare rare' if i % 40 == 0 else 'other'} w{i % 9}") for i in range(1000)]
    items = [(1, "rare common plain"), (2, "common plain"), (3, "w1 w1 common")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index, queries = op13_lexical.indexed(df.withColumnRenamed("doc_id", "id")), op13_lexical.indexed(asked.withColumnRenamed("item_id", "id"))
    n, total = index.selectExpr("count(n)", "sum(n)").first()
    terms = op13_lexical.query_terms(queries, op13_lexical.term_statistics(index, n, total, 20)).collect()
    assert any(not r["needed"] for r in terms) and all(r["needed"] for r in terms if bytes(r["term"]) == b"rare")
    assert sorted((tuple(r) for r in op13_lexical.search(df, asked).collect()), key=str) == ranked(docs, items)


def test_lexical_pieces(monkeypatch):
    text = prose(5000, 12).encode()
    whole = op13_lexical.term_counts(text)
    monkeypatch.setattr(op13_lexical, "PIECE", 100)
    assert op13_lexical.term_counts(text) == whole == collections.Counter(text.split())
