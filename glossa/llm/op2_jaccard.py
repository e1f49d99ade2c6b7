"""N-gram Jaccard join by a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import numbers, read, shingles, slices, small, words, written
from glossa.llm.components import components

STEP = 1.1  # sizes within a class of sizes differ by less than this factor


def common_prefix(n):
    """How many tokens two linked sets, the smaller one of n, share at least in their prefixes (all they share, if fewer)."""
    return 4 + n // 20


def distinct_shingles(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and the rows' bounds."""
    codes, rows = shingles(*words(raw, ends))
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
    codes, rows = codes[new], rows[new]
    return codes, np.searchsorted(rows, np.arange(len(ends) + 1))


def set_ids(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set (0 for an empty one)."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * np.uint64(0x9E3779B97F4A7C15) ^ (codes >> np.uint64(29)), dtype=np.uint64)))
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def prefix_length(n: np.ndarray | int):
    """n - ceil(0.8 n) + common_prefix(n): the first that many tokens hold the first common_prefix of those shared with any linked set."""
    return n - (4 * n + 4) // 5 + common_prefix(n)


def common_tokens(docs: DataFrame, part: int = 16, line: int = 6, most: int = 1_000_000) -> np.ndarray:
    """Shingles of over about part * line documents, by one in `part` of the texts; they go last in the order of tokens.

    The order only steers how many candidates there are, never which links are found. Where more than `most` shingles
    are over the line, it is doubled until they fit: what each task gets has that bound.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, ends in slices(batch.column(0)):
                codes, _ = distinct_shingles(raw, ends)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64))], names=["token"])

    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text")
    counts = some.mapInArrow(emit, "token long").groupBy("token").count().filter(F.col("count") >= line)
    counts = written(counts, "jaccard-common")
    while counts.filter(F.col("count") >= line).count() > most:
        line *= 2
    found = numbers(counts.filter(F.col("count") >= line).select("token"))[0]
    return np.sort(found.view(np.uint64))


def text_key() -> Column:
    """With doc_id, what tells rows apart: the same id may stand at several texts."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def token_sets(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, text_key, n (set size), sid (set id) and prefix (first tokens, common ones last, 48 bits of each) for each row of docs."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, ends in slices(batch.column(2)):
                codes, bounds = distinct_shingles(raw, ends)
                sids, n = set_ids(codes, bounds), np.diff(bounds)
                rows = np.repeat(np.arange(len(n)), n)
                last = common[np.minimum(np.searchsorted(common, codes), len(common) - 1)] == codes if len(common) else np.zeros(len(codes), bool)
                order = np.lexsort((codes, last, rows)) if last.any() else np.arange(len(codes))
                rank = np.arange(len(codes)) - bounds[rows]
                kept = order[rank < prefix_length(n)[rows]]
                lengths = np.minimum(n, prefix_length(n))
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), pa.array((codes[kept] >> np.uint64(16)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(n.astype(np.int64)), pa.array(sids), lists], names=["doc_id", "text_key", "n", "sid", "prefix"])

    return docs.select("doc_id", text_key(), "text").mapInArrow(measure, "doc_id long, text_key long, n long, sid long, prefix array<long>")


def alike_in_size(n: str, m: str) -> Column:
    return (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n))


def needed(smaller: Column, larger: Column) -> Column:
    """Shared prefix tokens without which two sets of these sizes can't link."""
    return F.least(4 + F.floor(smaller / 20), F.floor((4 * larger + 4) / 5))


def pruned(matrix: DataFrame) -> DataFrame:
    """The matrix without the sets that share too few tokens with all others together, and then without tokens of one group only."""
    n = F.first("n")
    enough = matrix.groupBy("sid").agg(F.count(F.lit(1)).alias("shared"), n.alias("n"))
    enough = enough.filter(F.col("shared") >= needed(F.ceil(0.8 * F.col("n")), F.col("n"))).select("sid", (F.col("shared") / F.col("n")).alias("central"))
    rows = written(matrix.drop("central").join(enough, "sid"), "jaccard-enough")
    split = rows.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo < hi").select("token")
    return written(rows.join(split, "token"), "jaccard-matrix")


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def whole_sets(wanted: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, tokens) of the wanted sids, made again from the texts: 48 bits of each token, sorted."""
    at = wanted.select("sid").distinct().join(sets.select("sid", "at"), "sid").select(F.col("at.doc_id").alias("d"), F.col("at.text_key").alias("k"), F.col("sid").alias("s"))
    same = (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    texts = docs.select("doc_id", text_key(), "text").join(small(written(at, "jaccard-wanted"), 1_000_000), same)  # three numbers a row

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, ends in slices(batch.column(0)):
                codes, bounds = distinct_shingles(raw, ends)
                own = set_ids(codes, bounds)
                good = np.flatnonzero(own == batch.column(1).slice(i, j - i).to_numpy())
                octets = codes.view(np.uint8).reshape(-1, 8)[:, 2:]
                packed = [octets[bounds[r] : bounds[r + 1]].tobytes() for r in good]
                yield pa.RecordBatch.from_arrays([pa.array(own[good]), pa.array(packed, pa.binary())], names=["sid", "tokens"])

    found = texts.select("text", "s").mapInArrow(tokens, "sid long, tokens binary").groupBy("sid").agg(F.first("tokens").alias("tokens"))
    return written(found, "jaccard-sets")


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids with 100 * intersection >= 80 * union, by their whole sets."""
    left = whole.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    right = whole.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, held, kept = [], None, None
            for r in range(batch.num_rows):
                x, y = batch.column(2)[r].as_py(), batch.column(3)[r].as_py()
                if held != y:
                    held, kept = y, _unpack(y)
                u = _unpack(x)
                at = np.minimum(np.searchsorted(kept, u), len(kept) - 1)
                both = int((kept[at] == u).sum())
                if 100 * both >= 80 * (len(u) + len(kept) - both):
                    good.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good, pa.int64())) for k in (0, 1)], names=["a", "b"])

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return written(joined.mapInArrow(compare, "a long, b long"), "jaccard-links")


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(STEP)) + 1e-9).cast("int")


def leaders(matrix: DataFrame, turn: int, above: int) -> DataFrame:
    """(a, b): for each set the one of another group that heads most of its tokens in the size class `above` its own.

    A token's head in a size class is the set with the largest share of tokens that others have too, as the original
    of many near copies has; `turn` breaks ties. Which sets are compared here only decides how much is left for
    open_groups.
    """
    rows = matrix.withColumn("class", size_class(F.col("n")))
    head = rows.groupBy("token", "class").agg(F.min(F.struct((-F.col("central")).alias("order"), F.xxhash64("sid", F.lit(turn)).alias("then"), F.col("sid").alias("head"), F.col("grp").alias("head_grp"), F.col("n").alias("m"))).alias("h"))
    head = head.select("token", (F.col("class") - above).alias("class"), "h.head", "h.head_grp", "h.m")
    near = rows.join(head, ["token", "class"]).filter((F.col("grp") != F.col("head_grp")) & alike_in_size("n", "m"))
    shares = near.groupBy("sid", "head").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")).filter(F.col("shared") >= F.least(F.lit(4), F.ceil(0.8 * F.col("n"))))
    return shares.groupBy("sid").agg(F.max(F.struct("shared", "head")).alias("best")).select(F.col("sid").alias("a"), F.col("best.head").alias("b"))


def regroup(matrix: DataFrame, links: DataFrame) -> DataFrame:
    """The matrix rows with their groups, the components of the links so far, of the sets and tokens that still matter."""
    groups = components(links)
    named = matrix.drop("grp").join(groups, F.col("sid") == F.col("node"), "left").select("token", "sid", "n", F.coalesce("root", "sid").alias("grp"))
    named = written(named, "jaccard-grouped")
    split = named.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo < hi").select("token")
    return pruned(named.join(split, "token"))


def held_by_others(rows: DataFrame) -> DataFrame:
    """(sid, cover): how many of a set's tokens (rows: token, sid, grp, class) another group has, as seven sums by the holders' size class.

    The token-group matrix has, for each token, its size classes with the least and the largest group that holds it; a
    set's own group doesn't count. Sizes that a link allows differ by at most 1.25, so classes by at most three. A
    token is one row of the join, however many groups hold it.
    """
    column = rows.groupBy("token", "class").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    column = column.groupBy("token").agg(F.collect_list(F.struct("class", "lo", "hi")).alias("column"))
    there = lambda d: F.exists("column", lambda c: (c["class"] == F.col("class") + d) & ((c["lo"] != F.col("grp")) | (c["hi"] != F.col("grp"))))
    held = rows.join(column, "token").groupBy("sid").agg(*(F.count_if(there(d)).alias(f"cover_{d + 3}") for d in range(-3, 4)))
    return held.select("sid", F.array(*(f"cover_{d}" for d in range(7))).alias("cover"))


def whole_tokens(asked: DataFrame, whole: DataFrame) -> DataFrame:
    """(sid, grp, n, token): a row for each token of the whole sets asked (sid, grp, n)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                codes = _unpack(batch.column(3)[r].as_py()).view(np.int64)
                same = [pa.array(np.full(len(codes), batch.column(k)[r].as_py(), np.int64)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(codes)], names=["sid", "grp", "n", "token"])

    return asked.join(whole, "sid").select("sid", "grp", "n", "tokens").mapInArrow(explode, "sid long, grp long, n long, token long")


def rare_tokens(tokens: DataFrame) -> DataFrame:
    """(token, k1, k2, sid, grp, n, left, lower, upper): the tokens by which two sets of different groups can find each other.

    Tokens in one group only can't be shared with another; the others of a set are ordered by how many sets have them,
    `left` of them from this one on. Where two sets of n and m link they share at least 4 / 9 (n + m) tokens, and the
    first shared one in this common order has as many left in both. So a set needs its few rarest shared tokens only,
    fewer the more of its tokens are its own, and one with too many of its own needs none. k1 and k2 are the size
    classes of the two sides, the smaller first; lower and upper say which of them the set is.
    """
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    live = tokens.join(counts.filter("lo < hi").select("token", "holders"), "token")
    own = Window.partitionBy("sid")
    left = F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("holders", "token")) + 1
    rows = live.withColumn("left", left).withColumn("class", size_class(F.col("n"))).filter(5 * F.col("left") >= 4 * F.col("n"))
    other = F.explode(F.sequence(size_class(0.8 * F.col("n")), size_class(F.col("n") / 0.8))).alias("other")
    rows = rows.select("token", "sid", "grp", "n", "left", "class", other)
    least = F.greatest(F.ceil(F.pow(F.lit(STEP), "other") - 1e-6), F.ceil(0.8 * F.col("n")))
    rows = rows.filter(9 * F.col("left") >= 4 * (F.col("n") + least))
    k1, k2 = F.least("class", "other").alias("k1"), F.greatest("class", "other").alias("k2")
    rows = rows.select("token", k1, k2, "sid", "grp", "n", "left", (F.col("class") <= F.col("other")).alias("lower"), (F.col("class") >= F.col("other")).alias("upper"))
    return between_groups(rows)


KEY = ["token", "k1", "k2"]


def between_groups(rows: DataFrame) -> DataFrame:
    """The rows of keys that are in more than one group, on both sides."""
    several = rows.groupBy(*KEY).agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("lower").alias("l"), F.max("upper").alias("u"))
    return written(rows.join(several.filter("lo < hi AND l AND u").select(*KEY), KEY), "jaccard-rare")


def pairs_left(rows: DataFrame) -> tuple[int, int]:
    """Rows, and pairs of rows of a key and different groups."""
    groups = rows.groupBy(*KEY, "grp").agg(F.count_if("lower").alias("l"), F.count_if("upper").alias("u"))
    keys = groups.groupBy(*KEY).agg((F.sum("l").cast("double") * F.sum("u") - F.sum(F.col("l").cast("double") * F.col("u"))).alias("pairs"))
    return rows.count(), keys.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]


def heads(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each set one of another group, that which stands for most of its keys; `turn` changes who stands for a key."""
    head = rows.filter("upper").groupBy(*KEY).agg(F.min_by(F.struct(F.col("sid").alias("head"), F.col("grp").alias("head_grp")), F.xxhash64("sid", F.lit(turn))).alias("h"))
    votes = rows.filter("lower").join(head, KEY).filter("grp <> h.head_grp").groupBy("sid", "h.head").count()
    return votes.groupBy("sid").agg(F.max(F.struct("count", "head")).alias("best")).select(F.col("sid").alias("a"), F.col("best.head").alias("b"))


def all_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of sets of different groups with a common key that leaves both enough tokens; sets of one group never meet."""
    upper = rows.filter("upper").select(*KEY, F.col("sid").alias("b"), F.col("grp").alias("grp_b"), F.col("n").alias("m"), F.col("left").alias("left_b"))
    enough = (9 * F.least("left", "left_b") >= 4 * (F.col("n") + F.col("m"))) & alike_in_size("n", "m")
    groups = upper.groupBy(*KEY, "grp_b").agg(F.max("left_b").alias("most"), F.min("m").alias("least"))
    met = rows.filter("lower").join(groups, KEY).filter((F.col("grp") != F.col("grp_b")) & (9 * F.least("left", "most") >= 4 * (F.col("n") + F.col("least"))))
    twice = (F.col("k1") < F.col("k2")) | (F.col("grp") < F.col("grp_b"))
    return met.join(upper, [*KEY, "grp_b"]).filter(enough & twice).select(F.col("sid").alias("a"), "b").distinct()


def open_groups(matrix: DataFrame, docs: DataFrame, sets: DataFrame, links: DataFrame, pairs_a_row: float = 4.0) -> DataFrame:
    """All links: `links` and those between sets of different groups of the matrix.

    A set is bounded against the union of the other groups' tokens in each size class by its prefix tokens, of which a
    link needs common_prefix. Only what passes is opened, with whole sets; see rare_tokens. While there are over
    pairs_a_row pairs to a row, sets are compared with one head each and what links becomes one group, so that those
    of a large group don't meet in pairs; when a turn leaves over nine tenths, or few pairs are left, all are compared.
    """
    rows = matrix.withColumn("class", size_class(F.col("n")))
    by_set = rows.select("sid", "n", "grp", "class").distinct()
    least = lambda d: F.greatest(F.ceil(F.pow(F.lit(STEP), F.col("class") + d) - 1e-6), F.ceil(0.8 * F.col("n")))
    passes = [F.col("cover")[d + 3] >= needed(F.least("n", least(d)), F.greatest("n", least(d))) for d in range(-3, 4)]
    asked = written(held_by_others(rows).join(by_set, "sid").filter(reduce(or_, passes)).select("sid", "grp", "n"), "jaccard-asked")
    whole = whole_sets(asked, docs, sets)
    rows = rare_tokens(written(whole_tokens(asked, whole), "jaccard-whole"))
    turn, before = 0, float("inf")
    while (left := pairs_left(rows))[1] > pairs_a_row * left[0] and left[1] <= 0.9 * before:
        turn, before = turn + 1, left[1]
        found = verified(heads(rows, turn), whole)
        links = links.union(found)
        groups = components(links)
        rows = between_groups(rows.drop("grp").join(groups, F.col("sid") == F.col("node"), "left").withColumn("grp", F.coalesce("root", "sid")).drop("node", "root"))
    return links.union(verified(all_pairs(rows), whole))


def jaccard_join(docs: DataFrame, turns: tuple[int, ...] = (0, 1)) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, class_id for each row of docs (doc_id, text); links are at 0.8 or more by five-word shingles.

    1. Equal sets (by 64-bit ids) are one from here on, however many copies there are.
    2. Tokens are ordered, common ones last; two sets that link share common_prefix tokens of their prefixes. So tokens of one set only are dropped, and the rest, by set, is the matrix.
    3. Groups: each set is compared with one leader of its size class, then of the next one (`turns`), and linked sets
       become one group, so a large group of near copies isn't paired with itself.
    4. The token-group matrix then bounds what is left between different groups, and only what passes is opened; see
       open_groups.
    Pairs are verified on whole texts. class_id tells components apart (a set id; 0 for texts without words), also where
    an id stands at several texts; component_id is the smallest doc_id of a class. Null and empty texts have n_shingles
    0 and stand alone; repeated rows are equal sets; null ids take part, and a component of them only has a null id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_sets = written(token_sets(docs, common_tokens(docs)), "jaccard-tokens")
    reps = all_sets.filter("n > 0").groupBy("sid").agg(F.first("prefix").alias("prefix"))
    tokens = reps.select("sid", F.explode("prefix").alias("token")).repartition("token")
    shared = tokens.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("token")
    matrix = written(tokens.join(shared.hint("shuffle_hash"), "token").select("token", "sid"), "jaccard-shared")
    at = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")).alias("at")
    sets = written(all_sets.groupBy("sid").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), at), "jaccard-reps")
    matrix = pruned(matrix.join(sets.select("sid", "n"), "sid").withColumn("grp", F.col("sid")))

    links = None
    for turn, above in enumerate(turns):
        pairs = written(leaders(matrix, turn, above), "jaccard-leaders")
        found = verified(pairs, whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")), docs, sets))
        links = found if links is None else links.union(found)
        matrix = regroup(matrix, links)
    links = open_groups(matrix, docs, sets, links)

    groups = components(links).join(sets.select("sid", "rep"), F.col("node") == F.col("sid"))
    names = written(groups.groupBy("root").agg(F.min("rep").alias("component")), "jaccard-names")
    member = groups.join(names, "root").select(F.col("node").alias("s"), "root", "component")
    labels = sets.join(member, F.col("sid") == F.col("s"), "left").select(F.col("sid").alias("s"), F.coalesce("component", "rep").alias("component"), F.coalesce("root", "sid").alias("class_id"))
    out = all_sets.select("doc_id", "text_key", "n", "sid").join(written(labels, "jaccard-labels"), F.col("sid") == F.col("s"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component, "class_id")


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return jaccard_join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
