"""Ranked lexical search: stored kth impacts bound each item's kth score from below, suffix bounds prune its terms, and what is left is rescored exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import read, small, written

INDEX = "id long, nth long, n long, terms array<binary>, counts array<int>"
FOUND = "item long, score long, id long, nth long"
# bytes of terms: ASCII letters (A-Z lower-cased), digits, and all of other characters; the rest becomes a space
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 22


def term_counts(text: bytes) -> Counter:
    """How often each term occurs; a very long text goes piece by piece, cut between terms."""
    text = text.translate(TABLE)
    if len(text) <= PIECE:
        return Counter(text.split())
    found, at = Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def indexed(texts: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """The forward index of texts (id, text), written: id, nth (the row), n (terms with repeats), different terms and their counts.

    With a vocabulary only its terms are listed; n counts all. Null texts have no terms.
    """
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            for at in range(0, len(batch), 1000):
                ns, ends, terms, counts = [], [0], [], []
                part = batch.slice(at, 1000)
                for text in column.slice(at, 1000):
                    found = term_counts(text.as_py() or b"")
                    ns.append(sum(found.values()))
                    for t in found if wanted is None else found.keys() & wanted:
                        terms.append(t)
                        counts.append(found[t])
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("nth"), pa.array(ns, pa.int64()), *lists], names=["id", "nth", "n", "terms", "counts"])

    rows = texts.select(F.col("id").cast("long").alias("id"), F.monotonically_increasing_id().alias("nth"), "text")
    return written(rows.mapInArrow(count, INDEX), "lexical-index")


def impact(count: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's share of a score before its weight, by its count and the document's length, in whole numbers."""
    return 10**9 * count // (1000 * count + 12 * (100 - 25 + 25 * n * documents // total))


def term_statistics(index: DataFrame, documents: int, total: int, k: int) -> DataFrame:
    """(term, w, most, kth), written: each term's weight, its largest impact and its kth largest (0 below k documents).

    An impact depends on a count and a length alone, so documents are first counted by (term, impact) in each
    partition: what is shuffled of a frequent term is the number of its different impacts, not of its documents.
    """
    each = index.select("n", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("n", "e.terms", F.col("e.counts").cast("long").alias("tf"))
    m = F.expr(f"75 + (25L * n * {documents}L) div {max(total, 1)}L")
    by = each.withColumn("m", m).select(F.col("terms").alias("term"), F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)").alias("impact")).groupBy("term", "impact").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("term").orderBy(F.desc("impact")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stats = by.withColumn("upto", upto).groupBy("term").agg(F.sum("c").alias("df"), F.max("impact").alias("most"), F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("impact"))), F.lit(0)).alias("kth"))
    w = F.floor(1000 * F.log((F.lit(2.0 * documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    return written(stats.select("term", w.alias("w"), "most", "kth"), "lexical-terms")


def query_terms(items: DataFrame, stats: DataFrame) -> DataFrame:
    """(item, term, weight, needed, floor, slack), written: the items' terms that documents hold.

    floor: k documents have at least the largest of weight x kth impact, so the item's kth score is no less. The terms
    of least bound (weight x largest impact) whose bounds add up to less than that are not needed: a document with
    none of the others can't be among the k. slack: the sum of those bounds.
    """
    each = items.select(F.col("nth").alias("item"), F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("item", F.col("e.terms").alias("term"), F.col("e.counts").cast("long").alias("tf"))
    each = each.join(stats, "term").withColumn("weight", F.col("tf") * F.col("w")).filter("weight > 0")
    own = Window.partitionBy("item")
    bound = F.col("weight") * F.col("most")
    upto = F.sum(bound).over(own.orderBy(bound, "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("floor", F.max(F.col("weight") * F.col("kth")).over(own)).withColumn("upto", upto).withColumn("needed", F.col("upto") >= F.col("floor"))
    slack = F.coalesce(F.max(F.when(~F.col("needed"), F.col("upto"))).over(own), F.lit(0)).alias("slack")
    return written(each.select("item", "term", "weight", "needed", "floor", slack), "lexical-queries")


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Block:
    """Some items' terms as arrays: for each term the items that hold it, the needed ones apart."""

    def __init__(self, rows: pa.Table):
        items, item = np.unique(rows["item"].to_numpy(), return_inverse=True)
        terms = rows["term"].combine_chunks().dictionary_encode()
        self.items, self.terms = items, terms.dictionary
        term, needed = terms.indices.to_numpy(), rows["needed"].to_numpy()
        self.floor, self.slack = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        self.floor[item], self.slack[item] = rows["floor"].to_numpy(), rows["slack"].to_numpy()
        self.lists = []
        for chosen in (needed, ~needed):
            order = np.flatnonzero(chosen)[np.argsort(term[chosen], kind="stable")]
            sizes = np.bincount(term[order], minlength=len(self.terms))
            self.lists.append((np.cumsum(sizes) - sizes, sizes, item[order], rows["weight"].to_numpy()[order]))

    def sums(self, which: int, doc: np.ndarray, term: np.ndarray, impacts: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weight x impact by doc * items + item, over the needed terms (which 0) or the others, of `keys` alone if given."""
        first, sizes, items, weights = self.lists[which]
        repeats = sizes[term]
        at = np.repeat(first[term], repeats) + _spread(repeats)
        key = np.repeat(doc, repeats) * len(self.items) + items[at]
        value = np.repeat(impacts, repeats) * weights[at]
        if keys is not None:
            place = np.searchsorted(keys, key)
            place[place == len(keys)] = 0
            there = keys[place] == key
            key, value = key[there], value[there]
        if not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return key[starts], np.add.reduceat(value, starts)


def best_of(found: np.ndarray, k: int) -> np.ndarray:
    """The k best rows of each item from rows (item, score, none, id, nth): by score, then id (none last)."""
    found = found[np.lexsort((found[:, 4], found[:, 3], found[:, 2], -found[:, 1], found[:, 0]))]
    starts = np.flatnonzero(np.concatenate(([True], found[1:, 0] != found[:-1, 0])))
    place = _spread(np.diff(np.append(starts, len(found))))
    return found[place < k]


def block_search(index: DataFrame, rows: pa.Table, documents: int, total: int, k: int, most_pairs: int = 1 << 20) -> DataFrame:
    """The k best documents of each partition for each item of a block: (item, score, id, nth).

    A document is a candidate where its needed terms and the slack together reach the item's bound, which rises to
    the kth score that the task has seen; only candidates get the other terms' shares. Documents go through in runs
    of about `most_pairs` pairs of a term and an item.
    """
    held = index.sparkSession.sparkContext.broadcast(rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(held.value)
        items = len(block.items)
        floor, best = block.floor.copy(), np.zeros((0, 5), np.int64)
        pairs = block.lists[0][1] + block.lists[1][1]
        for batch in batches:
            terms = batch.column("terms")
            term = pc.index_in(terms.flatten(), value_set=block.terms).fill_null(-1).to_numpy()
            count, n = batch.column("counts").flatten().to_numpy().astype(np.int64), batch.column("n").to_numpy()
            doc = np.repeat(np.arange(len(batch)), pc.list_value_length(terms).fill_null(0).to_numpy())
            some = term >= 0
            doc, term, count = doc[some], term[some], count[some]
            impacts = impact(count, n[doc], documents, total)
            upto = np.cumsum(pairs[term])
            ids, none = batch.column("id").fill_null(0).to_numpy(), batch.column("id").is_null().to_numpy(zero_copy_only=False)
            nth, at = batch.column("nth").to_numpy(), 0
            while at < len(doc):
                before = upto[at - 1] if at else 0
                end = int(np.searchsorted(upto, before + most_pairs, "right"))
                last = doc[min(max(end, at + 1), len(doc)) - 1]
                end = int(np.searchsorted(doc, last, "right")) if last == doc[at] or end >= len(doc) else int(np.searchsorted(doc, last, "left"))
                d, t, v = doc[at:end], term[at:end], impacts[at:end]
                at = end
                key, score = block.sums(0, d, t, v)
                may = score + block.slack[key % items] >= floor[key % items]
                key, score = key[may], score[may]
                if not len(key):
                    continue
                other, more = block.sums(1, d, t, v, key)
                score[np.searchsorted(key, other)] += more
                item, of = key % items, key // items
                good = (score >= floor[item]) & (score > 0)
                item, of, score = item[good], of[good], score[good]
                best = best_of(np.concatenate([best, np.stack([item, score, none[of], ids[of], nth[of]], 1)]), k)
                full = np.flatnonzero(np.bincount(best[:, 0], minlength=items) >= k)
                least = np.full(items, np.iinfo(np.int64).max)
                np.minimum.at(least, best[:, 0], best[:, 1])
                floor[full] = np.maximum(floor[full], least[full])
        yield pa.RecordBatch.from_arrays([pa.array(block.items[best[:, 0]], pa.int64()), pa.array(best[:, 1]), pa.array(best[:, 3], mask=best[:, 2] == 1), pa.array(best[:, 4])], names=["item", "score", "id", "nth"])

    return index.mapInArrow(search, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 20, most_terms: int = 300_000, block_rows: int = 500_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of docs (doc_id, text) of highest score above 0 for each row of items (item_id, text).

    The index lists the terms that occur in an item, if these are at most `most_terms`, else all terms; either gives
    the same rows. The items' terms go out in blocks of about `block_rows` rows, each a pass over the index.

    Null and empty texts have no terms: such documents are never found and such items have no rows. Equal scores rank
    by doc_id, none last; repeated rows rank one after another; rows of items with equal or no ids have ranks of their
    own. Columns besides those named are left out; empty tables give an empty result.
    """
    spark = docs.sparkSession
    asked = indexed(items.select(F.col("item_id").alias("id"), "text"))
    used = asked.select(F.explode("terms").alias("term")).distinct()
    few = used.limit(most_terms + 1).count() <= most_terms
    vocabulary = frozenset(used.toArrow()["term"].to_pylist()) if few else None
    index = indexed(docs.select(F.col("doc_id").alias("id"), "text"), vocabulary)
    documents, total = index.filter("n > 0").agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    stats = term_statistics(index, documents, total, k)
    queries = query_terms(asked, small(stats))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        rows = queries.filter(F.col("block") == b).toArrow()
        if len(rows):
            found = found.union(block_search(index, rows, documents, max(total, 1), k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "nth")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select(F.col("nth").alias("item"), F.col("id").alias("item_id"))
    return ranked.join(small(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each benchmark item."""
    return search(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "SELECT {id}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}"

SQL = f"""
WITH words AS ({_TERMS.format(id="doc_id", table="documents")}),
asked AS ({_TERMS.format(id="item_id", table="benchmark")}),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM lengths),
held AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, whole GROUP BY term, documents),
shares AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // total))) AS share
  FROM held JOIN lengths USING (doc_id) JOIN weights USING (term), whole
), scores AS (SELECT item_id, doc_id, sum(share)::BIGINT AS score FROM asked JOIN shares USING (term) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 20
"""
