"""Benchmark decontamination: SimHash of windows, Hamming search by blocks, and exact weighted-shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import read, shingles, slices, small, words, written

RADIUS = 3
SIZES = [1, 2, 3, 4, 6, 9, 13, 20, 30, 45, 68, 102, 153, 230]
_SPREAD = np.zeros(256, np.uint64)  # a byte's bits as eight bytes 0 or 1
for _i in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_i)) & np.uint64(1)) << np.uint64(8 * _i)
_ONES, _TOPS, _GATHER = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(0x0102040810204080)


def running_bits(codes: np.ndarray) -> list[np.ndarray]:
    """Eight running sums of 8 one-byte counters each, from 0; differences of them count exactly up to 255."""
    octets = codes.view(np.uint8).reshape(-1, 8)
    out = []
    for k in range(8):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_SPREAD[octets[:, k]], out=sums[1:])
        out.append(sums)
    return out


def simhash(sums: list[np.ndarray], size: int) -> np.ndarray:
    """Fingerprint of each window of `size` shingles, as four 16-bit blocks: a bit is set if over half of the hashes have it."""
    up = _ONES * np.uint64(128 - (size // 2 + 1))
    out = np.empty((4, max(len(sums[0]) - size, 0)), np.uint16)
    for k in range(8):
        lanes = sums[k][size:] - sums[k][:-size]
        lanes += up
        lanes &= _TOPS
        lanes >>= np.uint64(7)
        lanes *= _GATHER
        lanes >>= np.uint64(56)
        if k % 2 == 0:
            out[k // 2] = lanes
        else:
            out[k // 2] |= lanes.astype(np.uint16) << np.uint16(8)
    return out


def item_shingles(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return shingles(*words(raw, np.array([len(raw)]), True))[0]


def weighed(benchmark: DataFrame) -> DataFrame:
    """item_id, text, shared: for each benchmark item its shingles that other items have too, with the number of different items that have them."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            codes = [item_shingles(t.as_py()) for t in batch.column(1)]
            keys = [hashlib.md5(c.tobytes()).hexdigest() for c in codes]
            lists = pa.array([np.unique(c).view(np.int64) for c in codes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string()), lists], names=["item_id", "text", "key", "codes"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = written(items.mapInArrow(parse, "item_id long, text string, key string, codes array<long>"), "decontamination-items")
    pairs = items.select("key", F.explode("codes").alias("code")).distinct()  # equal items count once
    several = written(pairs.groupBy("code").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1"), "decontamination-shared")
    shared = pairs.join(small(several), "code").groupBy("key").agg(F.collect_list(F.struct("code", "seen")).alias("shared"))
    return written(items.drop("codes").join(shared, "key", "left").select("item_id", "text", "shared"), "decontamination-weighed")


class Index:
    """Fingerprints of items' windows by size, each with a table of the values of its four blocks.

    Two fingerprints within RADIUS = 3 bits agree in one of the four blocks, so the tables miss none. An item of m
    shingles that is alike to 0.8 with m shingles of a text has at most d = m / 9 shingles that the text lacks; as
    one changed word takes up to five, the others form a run of at least L = (m - d) / (d // 5 + 1). The window size
    is the largest of SIZES up to L (two thirds of L where d is 5 or more), at so many places of the item that one
    lies in any such run: its fingerprint then equals the text's.
    """

    def __init__(self, items: list[tuple[int, str | None, list[tuple[int, int]] | None]]):
        self.items: list[tuple] = []
        entries: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for item_id, text, shared in items:
            codes = item_shingles(text)
            if not len(codes):
                continue
            unique, counts = np.unique(codes, return_counts=True)
            # shingles that many items share say less; those of no item weigh what the item's weigh on average
            seen = dict(shared or ())
            weight = np.array([1 / np.sqrt(seen.get(c, 1)) for c in unique.view(np.int64).tolist()])
            total = float((weight * counts).sum())
            self.items.append((item_id, len(codes), unique, counts, weight, total, total / len(codes)))
            m = len(codes)
            lost = m // 9
            run = (m - lost) // (lost // 5 + 1)
            size = max(s for s in SIZES if s <= max(1, run if lost < 5 else 2 * run // 3))
            places = sorted({*range(0, m - size + 1, run - size + 1), m - size})
            prints = simhash(running_bits(codes), size)
            for p in places:
                entries.setdefault(size, []).append((len(self.items) - 1, p, prints[:, p]))
        self.sizes = {}
        for size, found in entries.items():
            prints = np.array([e[2] for e in found])
            tables = []
            for b in range(4):
                order = np.argsort(prints[:, b], kind="stable")
                first = np.searchsorted(prints[order, b], np.arange(65537))
                tables.append((order, first, first[1:] > first[:-1]))
            self.sizes[size] = (np.array([e[0] for e in found]), np.array([e[1] for e in found]), prints, tables)

    def near(self, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, entry) pairs of fingerprints within RADIUS."""
        _, _, prints, tables = self.sizes[size]
        windows, entries = [], []
        for b in range(4):
            order, first, known = tables[b]
            hit = np.flatnonzero(known[blocks[b]])
            if not len(hit):
                continue
            value = blocks[b][hit].astype(np.int64)
            n = first[value + 1] - first[value]
            w = np.repeat(hit, n)
            e = order[np.repeat(first[value], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            close = np.bitwise_count(blocks[:, w] ^ prints[e].T).sum(axis=0) <= RADIUS
            windows.append(w[close])
            entries.append(e[close])
        if not windows:
            return np.zeros(0, int), np.zeros(0, int)
        pairs = np.unique(np.concatenate(windows) * len(prints) + np.concatenate(entries))
        return pairs // len(prints), pairs % len(prints)

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard of the item's shingles and a window's, repeats counted; what the item lacks weighs its mean weight."""
        _, _, unique, counts, weight, total, mean = self.items[item]
        codes, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(unique, codes), len(unique) - 1)
        same = unique[at] == codes
        both = (np.minimum(counts[at[same]], n[same]) * weight[at[same]]).sum()
        own = (n[same] * weight[at[same]]).sum() + mean * n[~same].sum()
        return float(both / (total + own - both))


def matches(index: Index, codes: np.ndarray, rows: np.ndarray, least: float, shift: int = 2) -> list[tuple[int, int, float, int]]:
    """(row, item id, similarity, first shingle) of the best window of each row and item that are alike to `least`."""
    if not len(codes):
        return []
    begin = np.searchsorted(rows, np.arange(rows.max() + 2)) if (np.diff(rows) >= 0).all() else None
    if begin is None:  # the short rows stand at the end
        order = np.argsort(rows, kind="stable")
        codes, rows = codes[order], rows[order]
        begin = np.searchsorted(rows, np.arange(rows.max() + 2))
    sums = running_bits(codes)
    todo: set[tuple[int, int, int]] = set()
    for size, (of, place, _, _) in index.sizes.items():
        if len(codes) < size:
            continue
        windows, entries = index.near(simhash(sums, size), size)
        inside = rows[windows] == rows[windows + size - 1]
        windows, entries = windows[inside], entries[inside]
        for row, item, start in set(zip(rows[windows].tolist(), of[entries].tolist(), (windows - place[entries]).tolist(), strict=True)):
            todo.update((row, item, start + d) for d in range(-shift, shift + 1))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for row, item, start in sorted(todo):
        low, high = begin[row], begin[row + 1]
        a, b = max(low, start), min(high, start + index.items[item][1])
        if a < b and (s := index.similarity(item, codes[a:b])) >= least and s > best.get((row, item), (0, 0))[0]:
            best[row, item] = (s, int(a - low))
    return [(row, index.items[item][0], s, at) for (row, item), (s, at) in best.items()]


FOUND = "doc_id long, text_key string, item_id long, similarity double, first_shingle long"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block: int = 2000) -> DataFrame:
    """doc_id, text_key (md5), item_id, similarity, first_shingle: the best window of each document (doc_id, text) and
    benchmark item (item_id, text) that are alike to `least`. A shingle weighs 1 / sqrt(different items that have it),
    counted over the whole benchmark, so that neither equal items nor the blocks change what is found.

    Words are compared without case and ASCII punctuation. Items are taken in blocks, so that what each task gets is
    bounded; documents are read once a block, without a shuffle. Null or empty texts and items match nothing, items
    under five words are one shingle, equal items and repeated rows each give their own rows, null ids stay null.
    """
    numbered = weighed(benchmark)
    n = numbered.count()
    blocks = max(1, -(-n // block))
    parts = []
    for k in range(blocks):
        own = numbered if blocks == 1 else numbered.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = Index([tuple(r) for r in own.collect()])

        def look(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            import hashlib

            for batch in batches:
                for i, _, raw, ends in slices(batch.column(1)):
                    codes, rows = shingles(*words(raw, ends, True))
                    out = []
                    for row, item_id, s, at in matches(index, codes, rows, least):
                        text = batch.column(1)[i + row].as_py()
                        out.append((batch.column(0)[i + row].as_py(), hashlib.md5(text.encode()).hexdigest(), item_id, round(s, 9), at))
                    if out:
                        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, FOUND))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return contaminated(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
