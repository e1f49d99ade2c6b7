"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import numbers, read, slices, small, words, written

STATS = [
    "log_words", "log_bytes", "word_bytes", "upper", "digits", "marks", "symbols", "bars", "stops", "beyond_ascii", "lines", "line_repeats",
    "distinct_words", "top_word", "distinct_pairs", "marked_words",
]


def _classes() -> np.ndarray:
    """Byte classes as columns: upper case, digits, other marks, symbols, bars, stops, beyond ASCII, line ends."""
    out = np.zeros((256, 8))
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\"'():;-/\\?_=<>[]{}", b"#$%&*!@^~+", b"|", b".,")):
        out[list(chars), i] = 1
    out[128:, 6] = 1
    out[10, 7] = 1
    return out


CLASSES = _classes()


def _distinct(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, how many different codes there are and how often the commonest occurs."""
    order = np.lexsort((code, row))
    r, c = row[order], code[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    most = np.zeros(n)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r[at], minlength=n).astype(float), most


def statistics(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of STATS for each text in raw; zeros for an empty one."""
    n = len(ends)
    sizes = np.diff(np.concatenate(([0], ends))).astype(float)
    hashes, counts = words(raw, ends)
    row_of_byte = np.repeat(np.arange(n), sizes.astype(int))
    histogram = np.bincount(row_of_byte * 256 + raw, minlength=n * 256).reshape(n, 256)
    shares = histogram @ CLASSES / np.maximum(sizes, 1)[:, None]
    row = np.repeat(np.arange(n), counts)
    total = np.maximum(counts, 1)
    distinct, top = _distinct(row, hashes, n)
    same_row = row[1:] == row[:-1]
    pairs = (hashes[1:] * np.uint64(3) + hashes[:-1])[same_row]
    distinct_pairs, _ = _distinct(row[1:][same_row], pairs, n)
    # lines: sums of their words' hashes, cut where a line end stands before a word
    lines = np.zeros(n)
    repeats = np.zeros(n)
    if len(hashes):
        is_word = ~np.isin(raw, np.array([32, 9, 10, 11, 12, 13], np.uint8))
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1] | (row_of_byte[1:] != row_of_byte[:-1])
        start = np.flatnonzero(begins)
        line = np.cumsum(raw == 10)[start]
        cut = np.ones(len(start), bool)
        cut[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(cut)
        sums = np.add.reduceat(hashes, at)
        lines = np.bincount(row[at], minlength=n).astype(float)
        own, _ = _distinct(row[at], sums, n)
        repeats = 1 - own / np.maximum(lines, 1)
        last = np.append(start[1:], len(raw)) - 1  # the word's end is the last word byte before the next word
        place = np.where(is_word, np.arange(len(raw)), 0)
        np.maximum.accumulate(place, out=place)
        marked = CLASSES[raw[place[last]], 3] > 0
        marked_words = np.bincount(row, weights=marked, minlength=n) / total
    else:
        marked_words = np.zeros(n)
    out = np.column_stack([
        np.log1p(counts), np.log1p(sizes), sizes / total, *shares[:, :7].T, shares[:, 7], repeats,
        distinct / total ** 0.8, top / total, distinct_pairs / total, marked_words,
    ])
    out[sizes == 0] = 0
    out[:, 2] = np.minimum(out[:, 2], 60)
    return out


def rest(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


class Model:
    """Standardised statistics through cos(Wx + b), a ridge fit on them, and steps from its scores to chances."""

    def __init__(self, mean, scale, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def expand(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.column_stack([z, np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, bins: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over at most `bins` equal parts of the sorted scores: both ends of each block and its level."""
    order = np.argsort(x, kind="stable")
    blocks: list[tuple[float, float, float, float]] = []  # sum of y, rows, least x, largest x
    for p in np.array_split(order, min(bins, len(x))):
        blocks.append((float(y[p].sum()), float(len(p)), float(x[p].min()), float(x[p].max())))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            (s, n, _, high), (s0, n0, low, _) = blocks.pop(), blocks.pop()
            blocks.append((s + s0, n + n0, low, high))
    knots = np.array([e for b in blocks for e in b[2:]])
    return knots, np.repeat([(b[0] + 0.5) / (b[1] + 1) for b in blocks], 2)


def solve(gram: np.ndarray, right: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights; the penalty grows with the rows and leaves the constant (the last feature) free."""
    penalty = ridge * max(gram[-1, -1], 1.0) * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, right)


def best_ridge(sums: np.ndarray, ridges: tuple[float, ...]) -> float:
    """The ridge of least squared error over the folds, each predicted by the others' rows; the larger one of equals.

    sums has for each fold the matrix [z y]'[z y], which is all that both the fit and its error need.
    """
    errors = []
    for ridge in ridges:
        total = 0.0
        for own in sums:
            rest_ = sums.sum(axis=0) - own
            beta = np.append(-solve(rest_[:-1, :-1], rest_[:-1, -1], ridge), 1.0)
            total += beta @ own @ beta
        errors.append((round(total, 9), -ridge))
    return -min(errors)[1]


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, features: int = 256, width: float = 4.0, ridges: tuple[float, ...] = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1), folds: int = 3, seed: int = 5) -> Model | None:
    """A Model from the labelled documents (doc_id, text) whose rest is not 2; about `most_rows` of them, those of smallest hashed doc_id.

    A share of 1 / (folds + 1) of them calibrates, the others give the normal equations, summed on each partition and
    then by fold and cell. Of several rows with a labelled id the one of least statistics counts, so no more than the
    labels' number come out. The folds choose the ridge; held-out rows have no part in it. None without labelled rows.
    """
    marks = labels.filter((rest(F.col("doc_id")) != 2) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    order = F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary"))
    marks = written(marks.select(F.col("doc_id").cast("long").alias("marked"), "y", order.alias("o")), "quality-marks")
    n = marks.count()
    marks = marks.filter(F.col("o") < 2**32 * min(1.0, most_rows / max(n, 1)))
    chosen = docs.select("doc_id", "text").join(small(marks), F.col("doc_id") == F.col("marked"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, ends in slices(batch.column(0)):
                stats = statistics(raw, ends)
                lists = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, len(STATS), dtype=np.int32), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([lists, *(batch.column(k).slice(i, j - i) for k in (1, 2, 3))], names=["stats", "y", "fold", "marked"])

    rows = chosen.select("text", "y", (F.col("o") % (folds + 1)).cast("int").alias("fold"), "marked").mapInArrow(measure, "stats array<double>, y double, fold int, marked long")
    often = docs.select("doc_id").join(small(marks.select("marked")), F.col("doc_id") == F.col("marked")).groupBy("marked").count().filter("count > 1").select("marked")
    often = written(often, "quality-often")
    if not often.isEmpty():  # an id that stands on many rows counts once; there are no more of them than marks
        once = rows.join(small(often), "marked", "left_semi").groupBy("marked").agg(F.min(F.struct("stats", "y", "fold")).alias("row")).select("row.*")
        rows = rows.join(small(often), "marked", "left_anti").select("stats", "y", "fold").unionByName(once)
    rows = written(rows.select("stats", "y", "fold"), "quality-fit")
    one = rows.select(*(x for i in range(len(STATS)) for x in (F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i]))), F.count(F.lit(1))).first()
    if not one[-1]:
        return None
    model = Model(np.array(one[0:-1:2]), np.maximum(np.array(one[1:-1:2]), 1e-6), features, width, seed)
    size = features + 2
    upper = np.triu_indices(size)  # the matrices are symmetric

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(STATS))
            zy = np.column_stack([model.expand(x), np.array(batch.column(1).to_pylist(), float)])
            fold = batch.column(2).to_numpy() - 1
            for f in range(folds):
                total[f] += zy[fold == f].T @ zy[fold == f]
        part = total[:, *upper].ravel()
        yield pa.RecordBatch.from_pydict({"cell": np.arange(part.size, dtype=np.int32), "part": part})

    early = rows.filter("fold > 0").select("stats", "y", "fold").coalesce(16)
    cell, part = numbers(early.mapInArrow(equations, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")))
    half = np.zeros(folds * len(upper[0]))
    half[cell] = part
    sums = np.zeros((folds, size, size))
    sums[:, *upper] = half.reshape(folds, -1)
    sums += np.triu(sums, 1).transpose(0, 2, 1)
    model.ridge = best_ridge(sums, ridges)
    every = sums.sum(axis=0)
    model.beta = solve(every[:-1, :-1], every[:-1, -1], model.ridge)
    later = rows.filter("fold = 0").select("stats", "y").collect()  # a share of most_rows
    later = later or rows.select("stats", "y").limit(most_rows).collect()
    model.knots, model.levels = isotonic(model.raw(np.array([r[0] for r in later])), np.array([float(r[1]) for r in later]))
    return model


def score(docs: DataFrame, labels: DataFrame, least: float = 0.7, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns `keep` for each row of docs (doc_id, text), in one pass after the fit.

    Only statistics of the whole text enter a score. Null and empty texts have zeros as statistics and are scored
    like others; null ids are never held out; repeated rows stay. Without labels the score is 1 for all.
    """
    model = fit(docs, labels, **options)
    others = [c for c in keep if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(F.lit(0), *others).alias("kept"))
    schema = f"doc_id long, score double, kept {rows.schema['kept'].dataType.simpleString()}, text string"
    with_text = "text" in keep

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, ends in slices(batch.column(1)):
                values = model.score(statistics(raw, ends)) if model else np.ones(j - i)
                ids, text, kept = (batch.column(k).slice(i, j - i) for k in range(3))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.round(values, 9)), kept, text if with_text else pa.nulls(j - i, pa.string())], names=["doc_id", "score", "kept", "text"])

    scored = rows.mapInArrow(apply, schema)
    held_out = F.coalesce(rest(F.col("doc_id")) == 2, F.lit(False))
    out = scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "text", *(F.col(f"kept.{c}").alias(c) for c in others))
    return out if with_text else out.drop("text")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return score(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
