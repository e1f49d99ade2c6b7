"""Exact duplicates: static binary-fuse filters of immutable snapshots screen a batch's digests, and texts are compared byte by byte."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import mix64, read, written

SPACE = r"[\x20\x09-\x0D]+"
FILTER = "bucket long, seed long, segment long, segments long, prints binary"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


# Binary fuse filters: each key has one slot in each of three neighbouring segments, and the three prints there combine
# to the key's own. Segment and table sizes are the ones published with the structure.


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key (3, n) and its print."""
    h = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    inner = np.uint64(segment - 1)
    base = first.astype(np.int64)
    second = (base + segment) ^ ((h >> np.uint64(18)) & inner).astype(np.int64)
    third = (base + 2 * segment) ^ (h & inner).astype(np.int64)
    return np.stack([base, second, third]), (mix64(h) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, prints of 8 bits) of a static filter that holds all of keys (uint64).

    Slots that one key alone holds are peeled, all of a round at once; the prints are then set in the opposite order.
    A seed under which keys are left over is followed by the next.
    """
    keys = np.unique(keys)
    n = len(keys)
    segment = min(1 << max(int(math.log(max(n, 2)) / math.log(3.33) + 2.25), 2), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(math.ceil(n * factor / segment) - 2, 1)
    size = (segments + 2) * segment
    for seed in range(1, 1000):
        slots, own = _slots(keys, seed, segment, segments)
        left = np.bincount(slots.ravel(), minlength=size)
        held = np.bincount(slots.ravel(), np.tile(np.arange(n, dtype=np.float64), 3), size).astype(np.int64)  # sums of key numbers, below 2^53
        order, there = [], 0
        single = np.flatnonzero(left == 1)
        while len(single):
            who, at = np.unique(held[single], return_index=True)
            order.append((who, single[at]))
            there += len(who)
            touched = slots[:, who]
            np.subtract.at(left, touched, 1)
            np.subtract.at(held, touched, np.broadcast_to(who, touched.shape))
            near = np.unique(touched)
            single = near[left[near] == 1]
        if there == n:
            prints = np.zeros(size, np.uint8)
            for who, slot in reversed(order):
                prints[slot] = 0
                a, b, c = slots[:, who]
                prints[slot] = own[who] ^ prints[a] ^ prints[b] ^ prints[c]
            return seed, segment, segments, prints
    raise RuntimeError(f"no seed peels {n} keys")


def in_filter(keys: np.ndarray, seed: int, segment: int, segments: int, prints: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: true for all keys that it holds, for others with probability 1/256."""
    (a, b, c), own = _slots(keys, seed, segment, segments)
    return (prints[a] ^ prints[b] ^ prints[c]) == own


def _key() -> Column:
    return F.xxhash64("digest")


@dataclass(frozen=True)
class Snapshot:
    """One immutable batch.

    rows: nth, doc_id, digest, text (normalised); digests: digest, n; filters: one row a bucket of digests.
    """

    part: int
    rows: DataFrame
    digests: DataFrame
    filters: DataFrame
    buckets: int
    total: int


def snapshot(batch: DataFrame, part: int = 0, digest: Callable[[Column], Column] = sha256, keys: int = 4096) -> Snapshot:
    """Writes a batch (doc_id, text), its digests with counts, and filters of about `keys` digests each.

    Digests are distinct and hashed to their buckets, so a bucket's size doesn't depend on how often a text repeats.
    An empty batch has no filters.
    """
    rows = batch.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text")))
    rows = written(rows.select(F.monotonically_increasing_id().alias("nth"), "doc_id", "digest", "text"), "exact-rows")
    digests = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "exact-digests")
    different, total = digests.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, math.ceil(different / keys))

    def build(group: pa.Table) -> pa.Table:
        seed, segment, segments, prints = build_filter(group["key"].to_numpy().astype(np.int64).view(np.uint64))
        return pa.table({"bucket": group["bucket"][:1], "seed": [seed], "segment": [segment], "segments": [segments], "prints": pa.array([prints.tobytes()], pa.binary())})

    keyed = digests.select(_key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("long"))
    return Snapshot(part, rows, digests, written(keyed.groupBy("bucket").applyInArrow(build, FILTER), "exact-filters"), buckets, total)


def screen(digests: DataFrame, against: Snapshot) -> DataFrame:
    """The digests (digest, distinct) that the snapshot's filters let through: all that are in it, and about 1 in 256 others.

    Each bucket's filter comes before its digests in a sorted partition, so a task holds one filter and one batch.
    """
    asked = digests.select(F.lit(1).alias("turn"), "digest", _key().alias("key")).withColumn("bucket", F.pmod("key", F.lit(against.buckets)).cast("long"))
    held = against.filters.withColumn("turn", F.lit(0))
    both = held.unionByName(asked, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "turn")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fuse = None, None
        for batch in batches:
            buckets, turns = batch.column("bucket").to_numpy(), batch.column("turn").to_numpy()
            keys = batch.column("key").fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], (buckets[1:] != buckets[:-1]) | (turns[1:] != turns[:-1]))))
            good = np.zeros(len(keys), bool)
            for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
                if turns[i] == 0:
                    seed, segment, segments, prints = (batch.column(c)[int(i)].as_py() for c in ("seed", "segment", "segments", "prints"))
                    bucket, fuse = buckets[i], (seed, segment, segments, np.frombuffer(prints, np.uint8))
                elif fuse is not None and bucket == buckets[i]:
                    good[i:j] = in_filter(keys[i:j], *fuse)
            yield pa.RecordBatch.from_arrays([batch.column("digest").filter(pa.array(good))], names=["digest"])

    return both.mapInArrow(probe, "digest string")


def matched(rows: DataFrame, right: DataFrame, on: list[str], total: int, how: str, few: int = 100_000) -> DataFrame:
    """rows joined (inner or left) with right, which has one row a key and n, the key's number of rows.

    Up to `few` rows of right are broadcast (they hold no texts). Beyond that only keys with a thousandth of all rows
    are, at most 1,000, and the others are shuffled: no key of the shuffle is hot.
    """
    if right.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(right), on, how)
    heavy, light = right.filter(F.col("n") * 1000 >= total), right.filter(F.col("n") * 1000 < total)
    others = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    return rows.join(F.broadcast(heavy), on).unionByName(others)


def same_texts(found: Snapshot, digests: DataFrame, few: int) -> DataFrame:
    """(digest, text, n, first) of the snapshot's different texts under the given digests (digest, n).

    Texts are grouped by all their bytes, in each partition before the shuffle, so copies don't travel. `first` is the
    row of smallest doc_id (none last), of several such rows the first written.
    """
    first = F.struct(F.lit(found.part).alias("part"), F.isnull("doc_id").alias("none"), "doc_id", "nth")
    rows = matched(found.rows, digests, ["digest"], found.total, "inner", few)
    return rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))


def fold(batch: DataFrame, earlier: list[Snapshot], digest: Callable[[Column], Column] = sha256, keys: int = 4096, few: int = 100_000) -> tuple[DataFrame, Snapshot]:
    """Verdicts on a batch (doc_id, digest, part, nth, keep) against the snapshots before it, and the batch's own snapshot.

    keep is the row that stays: of the earliest snapshot with an equal text, else the batch's first with that text.
    Digests that pass a filter are looked up in that snapshot's digests, and only then are texts read and compared.
    Digests that the batch itself repeats are grouped by text separately. A digest alone decides nothing: different
    texts with one digest stay apart.
    """
    own = snapshot(batch, len(earlier), digest, keys)
    found, asked = [], None
    for before in earlier:
        positive = screen(own.digests, before)
        hits = written(before.digests.join(positive, "digest", "left_semi"), "exact-hits")
        found.append(written(same_texts(before, hits, few).select("digest", "text", F.col("first").alias(f"first{before.part}")), "exact-buckets"))
        asked = hits.select("digest") if asked is None else asked.union(hits.select("digest"))
    wanted = own.digests.filter("n > 1")
    if asked is not None:
        wanted = wanted.union(own.digests.filter("n = 1").join(asked.distinct(), "digest", "left_semi"))
    groups = same_texts(own, written(wanted, "exact-wanted"), few)
    for before, texts in zip(earlier, found, strict=True):
        groups = groups.join(texts, ["digest", "text"], "left")
    keep = F.coalesce(*(F.col(f"first{before.part}") for before in earlier), F.col("first"))
    groups = written(groups.select("digest", "text", "n", keep.alias("keep")), "exact-groups")

    rows = own.rows.select("doc_id", "digest", F.lit(own.part).alias("part"), "nth")
    itself = F.struct("part", F.isnull("doc_id").alias("none"), "doc_id", "nth")
    shared = written(groups.groupBy("digest").count().filter("count > 1").select("digest"), "exact-collisions")  # of different texts: none, for a strong digest
    single = groups.join(shared, "digest", "left_anti").select("digest", "n", "keep")
    out = matched(rows, single, ["digest"], own.total, "left", few).withColumn("keep", F.coalesce("keep", itself))
    if not shared.isEmpty():
        texts = own.rows.join(shared, "digest", "left_semi").join(groups.select("digest", "text", "keep"), ["digest", "text"])
        apart = texts.select("doc_id", "digest", F.lit(own.part).alias("part"), "nth", "keep")
        out = out.join(shared, "digest", "left_anti").select(*apart.columns).unionByName(apart)
    return out.select("doc_id", "digest", "part", "nth", "keep"), own


def exact_dedup(docs: DataFrame, parts: int = 2, digest: Callable[[Column], Column] = sha256, keys: int = 4096, few: int = 100_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (the digest) for each row of docs (doc_id, text), dropped ones too.

    The documents come as `parts` batches of ascending doc_id, each screened against the snapshots of those before it,
    so the row that stays has the smallest doc_id of its group. Null texts are empty ones. Rows without an id come last
    and stay only where no row with an id has their text (keep_id is null then); of repeated rows one stays. Columns
    besides doc_id and text are left out; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    cuts = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.02) if parts > 1 else []
    edges = sorted({int(c) for c in cuts})
    upto = F.lit(0)
    for c in edges:
        upto = upto + F.when(F.col("doc_id") < c, 0).otherwise(1)
    snapshots, verdicts = [], None
    for i in range(len(edges) + 1):
        batch = docs.filter(upto == i) if edges else docs
        verdict, own = fold(batch, snapshots, digest, keys, few)
        snapshots.append(own)
        verdict = written(verdict, "exact-verdicts")
        verdicts = verdict if verdicts is None else verdicts.unionByName(verdict)
    kept = [F.col("keep.part").alias("keep_part"), F.col("keep.nth").alias("keep_nth")]
    verdicts = verdicts.select("doc_id", "digest", "part", "nth", F.col("keep.doc_id").alias("keep_id"), *kept)
    sizes = verdicts.groupBy("keep_part", "keep_nth").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = matched(verdicts, written(sizes, "exact-sizes"), ["keep_part", "keep_nth"], sum(s.total for s in snapshots), "left", few)
    stays = (F.col("part") == F.col("keep_part")) & (F.col("nth") == F.col("keep_nth"))
    return out.select("doc_id", "keep_id", F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), F.col("digest").alias("text_sha256"))


def op11_exact(spark, sf_dir: str) -> DataFrame:
    """All documents in two batches, the later screened against the earlier one's snapshot."""
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = """
WITH normal AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM normal WINDOW w AS (PARTITION BY text_sha256)
"""
