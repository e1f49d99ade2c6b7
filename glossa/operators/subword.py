"""Subword models over words: pre-tokenisation, vocabularies by substring counts, scores by distinct words, and EM in tables.

Tokens never cross a word's bounds, so a text's score is the sum of its words' scores, and a word has one score under
each label wherever it stands. Everything here works on words with counts: of the texts only words are taken, once.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.operators.model import MOST_COUNTS, require
from glossa.operators.segment import CANDIDATE, POINTS, UNKNOWN_PENALTY, by_size, weight_rows
from glossa.sources.store import table

MARK = "▁"
MOST_TOKENS = 1_000_000  # tokens whose lookups are broadcast; more are joined by a shuffle
CELLS = 1 << 20  # numbers of a block of words (places kept x words x labels)
MOST_KNOWN = 1 << 21  # numbers that a worker keeps of words that it has scored
MOST_PATHS = 1 << 17  # words by label whose paths a worker keeps
MOST_WORDS = 1 << 18  # words by label that a task counts before it passes them on
MOST_WORD_BYTES = 1 << 25  # and their bytes
SLICE_BYTES = 1 << 18  # of words that are walked at once: every code point takes some numbers


@dataclass(frozen=True)
class Words:
    """How a text becomes words: a Unicode normal form, cuts at ASCII white space, and a mark in front of each word.

    Null texts and texts of white space alone have no words.
    """

    form: str | None = "NFC"
    mark: str = MARK

    def normal(self, text: str | None) -> str:
        text = text or ""
        return unicodedata.normalize(self.form, text) if self.form and not text.isascii() else text

    def cut(self, text: str) -> list[bytes]:
        """The words of a normalised text, without the mark; bytes.split cuts at \\x20 and \\x09-\\x0D."""
        return text.encode("utf-8", "surrogatepass").split()

    def marked(self, words: list[bytes]) -> list[str]:
        return [self.mark + w.decode("utf-8", "surrogatepass") for w in words]


def word_counts(lines: DataFrame, words: Words = Words()) -> DataFrame:
    """(y, word, n) of lines (y, text), written: how often each marked word stands in each label's texts.

    Tasks count in Arrow batches and pass on sums of a bounded number of words, so the shuffle is of different words.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        held = 0  # bytes of the words, at most

        def out():
            y = [label for label, c in found.items() for _ in c]
            word = words.marked([w for c in found.values() for w in c])
            n = [k for c in found.values() for k in c.values()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(y, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["y", "word", "n"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(label, Counter()).update(words.cut(words.normal(text.as_py())))
                held += len(text.as_buffer() or b"")
                full = held > MOST_WORD_BYTES
                if full:  # repeats take no room
                    held = sum(len(w) for c in found.values() for w in c)
                if sum(map(len, found.values())) > MOST_WORDS or full and held > MOST_WORD_BYTES // 2:
                    yield out()
                    held = 0
        yield out()

    rows = lines.select("y", "text").mapInArrow(partial, "y string, word string, n long")
    return table(rows.groupBy("y", "word").agg(F.sum("n").alias("n")), "words")


STARTS = 64  # of substrings in a piece of a word


def _cut(words: DataFrame, longest: int) -> DataFrame:
    """words with `piece` for `word`: runs of STARTS places and what a substring that starts there needs beyond, so that a very long word is many rows."""
    firsts = F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)), F.lit(STARTS))
    rows = words.filter("word <> ''").select(*(c for c in words.columns if c != "word"), "word", F.explode(firsts).alias("first"))
    return rows.withColumn("piece", F.substring("word", F.col("first"), F.lit(STARTS + longest - 1))).drop("word", "first")


def _substrings(size: int) -> Column:
    """The substrings of `size` code points of a piece, with repeats."""
    starts = F.sequence(F.lit(1), F.least(F.lit(STARTS), F.length("piece") - (size - 1)))
    return F.explode(F.transform(starts, lambda i: F.substring("piece", i, F.lit(size))))


def _longer(units: DataFrame, shorter: list[str] | None, size: int) -> DataFrame:
    """(token, n) of the substrings of `size` code points whose two shorter parts are in `shorter` (None: all code points).

    A place's shorter token has a number, so a substring there is that number and one more code point: an exact key,
    counted in whole batches.
    """
    held = None
    if shorter is not None:
        lattice = WordLattice(shorter, np.zeros((1, len(shorter)), np.float32))
        lattice.tokens = pa.array(shorter, pa.string())  # packed, as each worker has a copy
        held = units.sparkSession.sparkContext.broadcast(lattice)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "word", SLICE_BYTES):
            words = batch.column("word").to_pylist()
            length = np.array([len(w) for w in words], np.int64)
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            n = np.repeat(batch.column("n").to_numpy(), length)
            if held is None:
                keys, which = np.unique(codes, return_inverse=True)
                tokens = pa.array([chr(k) for k in keys.tolist()], pa.string())
            else:
                lattice = held.value
                first = np.cumsum(length) - length
                start, long, word, token = lattice.edges(words)
                known = (long == size - 1) & (token < len(lattice.tokens))
                have = np.full(len(codes) + 1, -1, np.int64)
                have[first[word[known]] + start[known]] = token[known]
                left = np.repeat(first + length, length) - np.arange(len(codes))
                at = np.flatnonzero((left >= size) & (have[:-1] >= 0) & (have[1:] >= 0))
                keys, which = np.unique(have[at] * POINTS + codes[at + size - 1], return_inverse=True)
                n = n[at]
                tokens = pc.binary_join_element_wise(lattice.tokens.take(pa.array(keys // POINTS)), pa.array([chr(k % POINTS) for k in keys.tolist()], pa.string()), "")
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, which, n)
            yield pa.RecordBatch.from_arrays([tokens, pa.array(sums)], names=["token", "n"])

    return units.mapInArrow(count, "token string, n long")


def substring_counts(words: DataFrame, least: int, longest: int = 8) -> DataFrame:
    """(token, n): the substrings of at most `longest` code points that stand at least `least` times in words (word, n).

    Level by level: a substring can only be that frequent if both of its parts that are one code point shorter are, so
    the others are dropped before they are counted. A level without any ends the search. Words are counted once, with
    their numbers, and each level is as large as what it found. Tasks get the last level whole while it has MOST_TOKENS
    or fewer, and count by its numbers; a larger one is joined.
    """
    units = table(words.groupBy("word").agg(F.sum("n").alias("n")).filter("word <> ''"), "units")
    found, shorter, pieces = None, None, None
    for size in range(1, longest + 1):
        known = None if shorter is None else [r["token"] for r in shorter.limit(MOST_TOKENS + 1).collect()]
        if known is None or len(known) <= MOST_TOKENS:
            each = _longer(units, known, size)
        else:
            pieces = table(_cut(units, longest), "pieces") if pieces is None else pieces
            each = pieces.filter(F.length("piece") >= size).select("n", _substrings(size).alias("token"))
            for part, name in ((F.substring("token", 1, size - 1), "head"), (F.substring("token", 2, size - 1), "tail")):
                each = each.join(shorter.select(F.col("token").alias(name)), part == F.col(name), "left_semi")
        level = table(each.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "substrings")
        found = level if found is None else found.unionByName(level)
        shorter = level.select("token")
        if level.isEmpty():
            break
    return found


def vocabulary(substrings: DataFrame, size: int) -> DataFrame:
    """(token, n), written: all frequent code points, and as many longer substrings as `size` leaves room for, by n x length."""
    points = substrings.filter(F.length("token") == 1)
    room = max(size - points.count(), 0)
    longer = substrings.filter(F.length("token") > 1).orderBy(F.desc(F.col("n") * F.length("token")), "token").limit(room)
    return table(points.unionByName(longer), "vocabulary")


def token_counts(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(y, token, n), n at least 1: how often each token stands in the words (y, word, n) of each label, overlaps included.

    The vocabulary, which was asked to have a size and may have MOST_TOKENS at most, goes to the tasks; they walk their
    words' places through it at once and pass on sums.
    """
    names = [r["token"] for r in tokens.select("token").distinct().limit(MOST_TOKENS + 1).collect()]
    if len(names) > MOST_TOKENS:
        raise ValueError(f"a vocabulary has at most {MOST_TOKENS} tokens")
    held = words.sparkSession.sparkContext.broadcast(WordLattice(names, np.zeros((1, len(names)), np.float32)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = held.value
        sums: dict[str, np.ndarray] = {}
        for batch in by_size(batches, "word", SLICE_BYTES):
            _, _, word, token = lattice.edges(batch.column("word").to_pylist())
            labels = batch.column("y").dictionary_encode()
            of, n = labels.indices.to_numpy(), batch.column("n").to_numpy()
            for i, y in enumerate(labels.dictionary.to_pylist()):
                own = of[word] == i
                new = np.bincount(token[own], n[word[own]], len(names) + 1)[:-1].astype(np.int64)
                sums[y] = sums[y] + new if y in sums else new
            if len(sums) * len(names) > MOST_COUNTS:
                yield from out(sums)
        yield from out(sums)

    def out(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for y, n in sums.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(there), pa.string()), pa.array([names[i] for i in there], pa.string()), pa.array(n[there], pa.int64())], names=["y", "token", "n"])
        sums.clear()

    return words.select("y", "word", "n").mapInArrow(count, "y string, token string, n long").groupBy("y", "token").agg(F.sum("n").alias("n"))


def substring_model(words: DataFrame, tokens: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(y, token, w), written: add-alpha weights of every token under every label, in single precision."""
    labels = words.select("y").distinct()
    grid = tokens.select("token").join(F.broadcast(labels), how="cross").join(token_counts(words, tokens), ["y", "token"], "left")
    own = Window.partitionBy("y")
    p = (F.coalesce("n", F.lit(0)) + alpha) / (F.sum(F.coalesce("n", F.lit(0))).over(own) + alpha * F.count(F.lit(1)).over(own))
    return table(grid.select("y", "token", F.log(p).cast("float").alias("w")), "subwords")


def trie(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge keys in order, their nodes, token of each node or -1); the root is 0, an edge's key is node * POINTS + code point."""
    size = np.array([len(t) for t in tokens], np.int64)
    first = np.cumsum(size) - size
    codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    node, keys, nodes, base = np.zeros(len(tokens), np.int64), [], [], 1
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        new, which = np.unique(node[live] * POINTS + codes[first[live] + k], return_inverse=True)
        node[live] = base + which
        keys.append(new)
        nodes.append(base + np.arange(len(new)))
        base += len(new)
    token = np.full(base, -1, np.int32)
    token[node[size > 0]] = np.flatnonzero(size > 0)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *keys]), np.concatenate([empty, *nodes]), token


class WordLattice:
    """The tokens' weights under each label, held once in single precision (rows: tokens, then the unknown code point); sums are double."""

    def __init__(self, tokens: list[str], weights: np.ndarray):
        self.tokens, self.longest = tokens, max(map(len, tokens), default=1)
        low = weights.min(axis=1) if weights.size else np.zeros(len(weights))
        self.rows = np.empty((len(tokens) + 1, len(weights)), np.float32)
        self.rows[:-1], self.rows[-1] = weights.T, low - UNKNOWN_PENALTY
        self.edge_keys, self.edge_nodes, self.node_token = trie(tokens)

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(start, size, word, token) of every token at every place of the words, by start and size: a ragged list.

        A code point that is no token by itself is an edge of the unknown token.
        """
        length = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), length)
        start = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
        left = np.repeat(length, length) - start
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        alone = np.ones(len(codes), bool)
        found = []
        for k in range(self.longest if len(self.edge_keys) else 0):
            live = left[at] > k
            at, node = at[live], node[live]
            keys = node * POINTS + codes[at + k]
            place = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            ok = self.edge_keys[place] == keys
            at, node = at[ok], self.edge_nodes[place[ok]]
            if not len(at):
                break
            there = self.node_token[node] >= 0
            found.append((at[there], np.full(there.sum(), k + 1), self.node_token[node[there]].astype(np.int64)))
            if k == 0:
                alone[at[there]] = False
        lone = np.flatnonzero(alone)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), len(self.tokens))))
        at, size, token = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((word[at], size, start[at]))
        return start[at][order], size[order], word[at][order], token[order]

    def _blocks(self, words: list[str], width: int) -> Iterator[np.ndarray]:
        """Places of words of similar length, longest first, CELLS // width of them at most."""
        order = np.argsort([len(w) for w in words], kind="stable")[::-1]
        most = max(1, CELLS // max(width, 1))
        for i in range(0, len(order), most):
            yield order[i : i + most]

    def score(self, words: list[str], marginal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(scores, numbers of tokens), words by labels: of the best path, or of all paths together (then the best's number).

        The first found of equal paths stays. A word without code points has score 0.
        """
        labels, ring = self.rows.shape[1], self.longest + 1
        total, count = np.zeros((len(words), labels)), np.zeros((len(words), labels), np.int32)
        for part in self._blocks(words, labels * ring):
            own = [words[i] for i in part]
            length = np.array([len(w) for w in own])
            best, steps = np.full((ring, len(own), labels), -np.inf), np.zeros((ring, len(own), labels), np.int32)
            summed = np.full(best.shape, -np.inf) if marginal else None
            best[0] = 0
            if marginal:
                summed[0] = 0
            start, size, word, token = self.edges(own)
            cuts = np.flatnonzero(np.diff(start * ring + size)) + 1
            groups = list(zip([0, *cuts], [*cuts, len(start)], strict=True)) if len(start) else []
            g = 0
            for s in range(int(length.max()) + 1):
                here = s % ring
                done = np.flatnonzero(length == s)
                total[part[done]], count[part[done]] = (summed if marginal else best)[here, done], steps[here, done]
                while g < len(groups) and start[groups[g][0]] == s:
                    i, j = groups[g]
                    g += 1
                    w, there = word[i:j], (s + int(size[i])) % ring
                    weight = self.rows[token[i:j]]
                    new, old = best[here, w] + weight, best[there, w]
                    better = new > old
                    best[there, w] = np.where(better, new, old)
                    steps[there, w] = np.where(better, steps[here, w] + 1, steps[there, w])
                    if marginal:
                        summed[there, w] = np.logaddexp(summed[there, w], summed[here, w] + weight)
                best[here] = -np.inf
                if marginal:
                    summed[here] = -np.inf
        return total, count

    def paths(self, words: list[str], label: np.ndarray) -> list[list[str]]:
        """The best path's tokens of each word under its own label (an index); the first found of equal paths stays."""
        out: list[list[str]] = [[] for _ in words]
        longest = max(map(len, words), default=0)
        for part in self._blocks(words, 2 * (longest + 1)):
            own = [words[i] for i in part]
            length = np.array([len(w) for w in own])
            best, back = np.full((int(length.max()) + 1, len(own)), -np.inf), np.zeros((int(length.max()) + 1, len(own)), np.int64)
            best[0] = 0
            start, size, word, token = self.edges(own)
            weight = self.rows[token, label[part][word]]
            cuts = np.flatnonzero(np.diff(start * (self.longest + 1) + size)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(start)], strict=True) if len(start) else ():
                s, e, w = start[i], start[i] + size[i], word[i:j]
                new = best[s, w] + weight[i:j]
                better = new > best[e, w]
                best[e, w], back[e, w] = np.where(better, new, best[e, w]), np.where(better, s, back[e, w])
            for b, i in enumerate(part):
                e = int(length[b])
                while e:
                    out[i].append(own[b][back[e, b] : e])
                    e = int(back[e, b])
                out[i].reverse()
        return out

    def expectations(self, words: list[str], n: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected counts of the tokens in words that stand n times each, under the first label, and the log-likelihood."""
        weight = self.rows[:, 0].astype(np.float64)
        counts, like = np.zeros(len(weight)), 0.0
        longest = max(map(len, words), default=0)
        for part in self._blocks(words, 2 * (longest + 1)):
            own, times = [words[i] for i in part], n[part]
            length = np.array([len(w) for w in own])
            start, size, word, token = self.edges(own)
            w = weight[token]
            a, b = np.full((int(length.max()) + 1, len(own)), -np.inf), np.full((int(length.max()) + 1, len(own)), -np.inf)
            a[0], b[length, np.arange(len(own))] = 0, 0
            cuts = np.flatnonzero(np.diff(start * (self.longest + 1) + size)) + 1
            groups = list(zip([0, *cuts], [*cuts, len(start)], strict=True)) if len(start) else []
            for i, j in groups:
                s, e, x = start[i], start[i] + size[i], word[i:j]
                a[e, x] = np.logaddexp(a[e, x], a[s, x] + w[i:j])
            for i, j in reversed(groups):
                s, e, x = start[i], start[i] + size[i], word[i:j]
                b[s, x] = np.logaddexp(b[s, x], b[e, x] + w[i:j])
            whole = a[length, np.arange(len(own))]
            chance = np.exp(a[start, word] + w + b[start + size, word] - whole[word]) * times[word]
            counts += np.bincount(token, chance, len(weight))
            like += float(whole @ times)
        return counts[:-1], like


class Scorer:
    """Scores of whole texts by their words; a worker keeps what it has scored, up to MOST_KNOWN numbers, then starts anew."""

    def __init__(self, lattice: WordLattice, words: Words, marginal: bool):
        self.lattice, self.words, self.marginal = lattice, words, marginal
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.values = np.zeros((0, self.lattice.rows.shape[1]))
        self.sizes = np.zeros((0, self.lattice.rows.shape[1]), np.int32)

    def _rows(self, flat: list[bytes]) -> np.ndarray:
        labels = max(self.lattice.rows.shape[1], 1)
        fresh = [w for w in dict.fromkeys(flat) if w not in self.known]
        if (len(self.known) + len(fresh)) * labels > MOST_KNOWN:
            self._forget()
            fresh = list(dict.fromkeys(flat))
        if fresh:
            values, sizes = self.lattice.score(self.words.marked(fresh), self.marginal)
            self.known |= zip(fresh, range(len(self.known), len(self.known) + len(fresh)))
            self.values, self.sizes = np.concatenate([self.values, values]), np.concatenate([self.sizes, sizes])
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, numbers of tokens), texts by labels. Words go through some at a time, so a long text needs no more room than others."""
        labels = self.lattice.rows.shape[1]
        total, size = np.zeros((len(texts), labels)), np.zeros((len(texts), labels), np.int64)
        most = max(1, CELLS // max(labels, 1))
        flat: list[bytes] = []
        of: list[tuple[int, int]] = []

        def add() -> None:
            rows = self._rows(flat)
            starts, ends = np.cumsum([0, *(k for _, k in of)])[:-1], [i for i, _ in of]
            total[ends] += np.add.reduceat(self.values[rows], starts)
            size[ends] += np.add.reduceat(self.sizes[rows], starts, dtype=np.int64)
            flat.clear()
            of.clear()

        for i, text in enumerate(texts):
            words = self.words.cut(text)
            for at in range(0, len(words), most):
                piece = words[at : at + most]
                if flat and len(flat) + len(piece) > most:
                    add()
                flat += piece
                of.append((i, len(piece)))
        if flat:
            add()
        return total, size


MOST_MODEL = 1 << 30  # bytes of a block of labels' weights, in single precision


def _lattice(rows: DataFrame, names: list[str]) -> tuple[WordLattice, pa.Array]:
    """The lattice of some labels of packed rows, in their order, and their lines; MOST_MODEL bounds what comes here."""
    found = rows.filter(F.col("y").isin(names)).select("y", "n_lines", "tokens", F.col("w").cast("array<float>").alias("w")).toArrow()
    order = np.argsort(found["y"].to_pylist(), kind="stable")
    tokens = found["tokens"][0].as_py() if len(found) else []
    weights = found["w"].combine_chunks().flatten().to_numpy().reshape(len(found), len(tokens))[order] if len(found) else np.zeros((0, 0), np.float32)
    return WordLattice(tokens, weights), pa.array([found["n_lines"][int(i)].as_py() for i in order], pa.int64())


def _label_blocks(rows: DataFrame) -> list[list[str]]:
    """The labels of packed rows, a row a label, in blocks of MOST_MODEL bytes; a missing or doubled weight is an error."""
    found = rows.select("y", F.size("tokens").alias("n"), "of", F.exists("w", lambda w: w.isNull()).alias("bad")).orderBy("y").collect()
    if any(r["bad"] for r in found) or len({(r["n"], r["of"]) for r in found}) > 1:
        raise ValueError("the model lacks weights of some labels and tokens")
    labels, step = [r["y"] for r in found], max(1, MOST_MODEL // max(4 * found[0]["n"], 1)) if found else 1
    return [labels[i : i + step] for i in range(0, len(labels), step)]


def _pass(lines: DataFrame, rows: DataFrame, names: list[str], at: int, k: int | None, alpha: float | None, marginal: bool, bias: dict[str, float], words: Words, own: str | None) -> DataFrame:
    """lines with cands{at}, the k best labels of one block, and own{at}, the label of column `own` if the block has it."""
    lattice, n_lines = _lattice(rows, names)
    held = lines.sparkSession.sparkContext.broadcast(Scorer(lattice, words, marginal))
    label, add, place = pa.array(names, pa.string()), np.array([bias.get(y, 0.0) for y in names]), {y: i for i, y in enumerate(names)}
    most = len(names) if k is None else min(k, len(names))

    def entries(scores: np.ndarray, size: np.ndarray, text: np.ndarray, which: np.ndarray) -> pa.StructArray:
        columns = [pa.array(scores[text, which]), label.take(pa.array(which)), n_lines.take(pa.array(which)), pa.array(size[text, which])]
        return pa.StructArray.from_arrays(columns, names=["score", "label", "n_lines", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            texts = [words.normal(t) for t in batch.column("text").to_pylist()]
            scores, size = held.value.scores(texts)
            scores = np.round(scores, 4) + add
            if alpha is not None:
                scores = scores / np.maximum(size, 1) ** alpha
            scores = np.round(scores, 4)
            some = (size > 0).any(axis=1)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :most]  # names ascend, so the lesser of equals comes first
            ends = np.concatenate(([0], np.cumsum(np.where(some, most, 0))))
            text = np.flatnonzero(some)
            cands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries(scores, size, np.repeat(text, most), best[text].ravel()))
            out = [*batch.columns, cands]
            if own is not None:
                mine = np.array([place.get(y, -1) for y in batch.column(own).to_pylist()], np.int64)
                there = (mine >= 0) & some
                out.append(pa.StructArray.from_arrays(entries(scores, size, np.arange(len(mine)), np.maximum(mine, 0)).flatten(), names=["score", "label", "n_lines", "n_tokens"], mask=pa.array(~there)))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, f"cands{at}", *([f"own{at}"] if own else [])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + f", cands{at} array<{CANDIDATE}>" + (f", own{at} {CANDIDATE}" if own else "")
    return lines.mapInArrow(run, schema)


def score_words(lines: DataFrame, model: DataFrame, k: int | None = 5, alpha: float | None = None, marginal: bool = False, bias: dict[str, float] | None = None, words: Words = Words(), own: str | None = None) -> DataFrame:
    """The columns of lines but text, with status and cands: the k best labels (score, label, n_lines, n_tokens), best first, the lesser on ties.

    model: (y, token, w and perhaps n_lines) over marked words. Texts without words keep their row with status EMPTY
    and no candidates. `own` names a column whose label is appended where it isn't among the k best. Labels beyond
    MOST_MODEL bytes are scored block by block, each block in the same rows as the one before: nothing is shuffled.
    """
    rows = weight_rows(model)
    blocks = _label_blocks(rows)
    keep = [c for c in lines.columns if c != "text"]
    for i, names in enumerate(blocks):
        lines = _pass(lines, rows, names, i, k, alpha, marginal, bias or {}, words, own)
    if not blocks:
        lines = lines.withColumn("cands0", F.array().cast(f"array<{CANDIDATE}>"))
    cands = F.col("cands0")
    if len(blocks) > 1:
        key = lambda c: F.struct((-c["score"]).alias("minus"), c["label"].alias("label"), c["n_lines"].alias("n_lines"), c["n_tokens"].alias("n_tokens"))
        back = lambda c: F.struct((-c["minus"]).alias("score"), c["label"].alias("label"), c["n_lines"].alias("n_lines"), c["n_tokens"].alias("n_tokens"))
        every = F.array_sort(F.transform(F.concat(*(F.col(f"cands{i}") for i in range(len(blocks)))), key))
        cands = F.transform(every if k is None else F.slice(every, 1, k), back)
    out = lines.withColumn("cands", cands)
    if own is not None and blocks:
        mine = F.coalesce(*(F.col(f"own{i}") for i in range(len(blocks))))
        more = mine.isNotNull() & ~F.exists("cands", lambda c: c["label"] == mine["label"])
        out = out.withColumn("cands", F.when(more, F.concat("cands", F.array(mine))).otherwise(F.col("cands")))
    return out.select(*keep, F.when(F.size("cands") > 0, "SCORED").otherwise("EMPTY").alias("status"), "cands")


def segment_words(lines: DataFrame, model: DataFrame, words: Words = Words()) -> DataFrame:
    """The columns of lines but text, with tokens: the best path of each text (y, text), word by word, under its own label y.

    Different words are segmented once a label, and a worker keeps up to about MOST_PATHS of them. Labels beyond MOST_MODEL bytes go block by block, each in
    the same rows; a text whose label the model lacks has no tokens (null), one without words an empty list.
    """
    rows = weight_rows(model)
    keep, blocks = [c for c in lines.columns if c != "text"], _label_blocks(rows)
    for i, names in enumerate(blocks):
        lines = _paths_pass(lines, rows, names, i, words)
    tokens = F.coalesce(*(F.col(f"tokens{i}") for i in range(len(blocks)))) if blocks else F.lit(None).cast("array<string>")
    return lines.select(*keep, tokens.alias("tokens"))


def _paths_pass(lines: DataFrame, rows: DataFrame, names: list[str], at: int, words: Words) -> DataFrame:
    """lines with tokens{at}, the paths of the texts whose label is in the block."""
    held, place = lines.sparkSession.sparkContext.broadcast(_lattice(rows, names)[0]), {y: i for i, y in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bytes], list[str]] = {}
        for batch in by_size(batches):
            labels = [place.get(y, -1) for y in batch.column("y").to_pylist()]
            cut = [words.cut(words.normal(t)) if label >= 0 else [] for t, label in zip(batch.column("text").to_pylist(), labels, strict=True)]
            if len(known) > MOST_PATHS:
                known.clear()
            pairs = list(dict.fromkeys(pair for label, own in zip(labels, cut, strict=True) for w in own if (pair := (label, w)) not in known))
            found = held.value.paths(words.marked([w for _, w in pairs]), np.array([label for label, _ in pairs], np.int64))
            known.update(zip(pairs, found, strict=True))
            tokens = [None if label < 0 else [t for w in own for t in known[label, w]] for label, own in zip(labels, cut, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string()))], names=[*batch.schema.names, f"tokens{at}"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + f", tokens{at} array<string>"
    return lines.mapInArrow(run, schema)


# EM. The model is a table of packed rows, one a label: its tokens in order and their weights. A label's words come in
# blocks by hash, each with a copy of that one row, so neither the driver nor a task holds more than one label's row.

BLOCK_WORDS = 20_000
EXPECTED = "y string, id int, n double, error string"


def expected_counts(tokens: list[str], weights: np.ndarray, words: list[str], n: np.ndarray) -> tuple[np.ndarray, float]:
    """The E-step of one block of one label's words: expected counts by token, and the log-likelihood."""
    return WordLattice(tokens, weights[None]).expectations(words, n)


def packed(model: DataFrame) -> DataFrame:
    """(y, tokens, w) of a long model (y, token, w), written: a row a label, both arrays in the tokens' order."""
    cells = F.array_sort(F.collect_list(F.struct("token", "w"))).alias("cells")
    rows = model.groupBy("y").agg(cells)
    return table(rows.select("y", F.transform("cells", lambda c: c["token"]).alias("tokens"), F.transform("cells", lambda c: c["w"].cast("double")).alias("w")), "packed")


def unpacked(rows: DataFrame) -> DataFrame:
    """The long model (y, token, w) of packed rows."""
    return rows.select("y", F.explode(F.arrays_zip("tokens", "w")).alias("c")).select("y", F.col("c.tokens").alias("token"), F.col("c.w").alias("w"))


def uniform(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Packed rows of equal weights for the labels of words (y, word, n) and a vocabulary (token)."""
    row = tokens.agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    weight = -F.log(F.size("tokens").cast("double"))
    return table(words.select("y").distinct().crossJoin(F.broadcast(row)).select("y", "tokens", F.transform("tokens", lambda t: weight).alias("w")), "packed")


def e_step(words: DataFrame, rows: DataFrame, step: Callable = expected_counts) -> DataFrame:
    """(y, id, n, error), written: expected counts by label and place of the token, the log-likelihood under id -1, and what a label's worker raised.

    Every label has all ids, so a sum by label is dense.
    """
    blocks = words.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_WORDS)).cast("int").alias("blocks"))
    blocks = table(blocks, "blocks")  # a row a label
    left = words.join(F.broadcast(blocks), "y").select("y", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), "word", "n")
    right = rows.join(F.broadcast(blocks), "y", "left").select("y", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), "tokens", "w")

    def count(key: tuple, own: pa.Table, model: pa.Table) -> pa.Table:
        y = key[0].as_py()

        def out(ids, n, error=None):
            return pa.table({"y": pa.array([y] * len(ids), pa.string()), "id": pa.array(ids, pa.int32()), "n": pa.array(n, pa.float64()), "error": pa.array([error] * len(ids), pa.string())})

        if not len(model):
            return out([], [])
        try:
            tokens, weights = model["tokens"][0].as_py(), model["w"].combine_chunks().flatten().to_numpy()
            found, like = np.zeros(len(tokens)), 0.0
            if len(own):
                found, like = step(tokens, weights, own["word"].to_pylist(), own["n"].to_numpy().astype(np.float64))
            ids = np.arange(len(tokens)) if key[1].as_py() == 0 else np.flatnonzero(found)
            return out([*ids, -1], [*np.asarray(found)[ids], like])
        except Exception as e:  # any: one label's data must not end the others' training; strict callers raise it again
            return out([-1], [0.0], f"{type(e).__name__}: {e}"[:500])

    each = left.groupBy("y", "block").cogroup(right.groupBy("y", "block")).applyInArrow(count, EXPECTED)
    return table(each.groupBy("y", "id").agg(F.sum("n").alias("n"), F.max("error").alias("error")), "expected")


def train_em(words: DataFrame, tokens: DataFrame, rounds: int = 3, floor: float = 1e-12, isolate: bool = False, step: Callable = expected_counts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packed model rows, likelihoods (round, y, like), failures (y, error)) after EM from uniform weights over words (y, word, n).

    The E-step's sums and the M-step's normalisation are grouped sums over tables; nothing comes to the driver but
    whether there are failures. A label whose worker raised, whose counts aren't finite, or that has no token, stops
    the training; with `isolate` it is listed with its error and the others go on. `step` is the E-step of a block.
    """
    rows = uniform(words, tokens)
    likes, failures = None, None
    for i in range(rounds):
        sums = e_step(words, rows, step)
        whole = sums.groupBy("y").agg(F.max("error").alias("error"), F.sum(F.when(F.col("id") >= 0, F.col("n"))).alias("total"), F.sum(F.when(F.col("id") < 0, F.col("n"))).alias("like"))
        odd = F.isnan("total") | F.isnan("like") | F.col("total").isin(float("inf"), float("-inf")) | F.col("like").isin(float("inf"), float("-inf"))
        error = F.coalesce("error", F.when(odd, "an expected count isn't finite"), F.when(~(F.coalesce("total", F.lit(0.0)) > 0), "no token was counted"))
        whole = table(whole.select("y", "total", "like", error.alias("error")), "sums")
        if not isolate:
            whole = require(whole, F.col("error").isNotNull(), "a label's training failed")
        good = whole.filter("error IS NULL")
        cells = sums.filter("id >= 0").join(F.broadcast(good.select("y", "total")), "y")
        new = cells.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("id", F.log(F.greatest(F.col("n") / F.col("total"), F.lit(floor))).alias("w")))).alias("cells"))
        rows = table(rows.select("y", "tokens").join(new, "y").select("y", "tokens", F.transform("cells", lambda c: c["w"]).alias("w")), "packed")
        like, bad = good.select(F.lit(i).alias("round"), "y", "like"), whole.filter("error IS NOT NULL").select("y", "error")
        likes, failures = (like, bad) if likes is None else (likes.unionByName(like), failures.unionByName(bad))
    return rows, likes, failures


def train_isolated(spark: SparkSession, labels: list[str], words: DataFrame, tokens: DataFrame, path: str, rounds: int = 3, wave: int = 8, step: Callable = expected_counts) -> DataFrame:
    """(y, status, error): trains the labels that `path` doesn't hold whole and commits them there, a partition a label.

    Labels go in waves of `wave`; each wave's weights are committed before the next begins, so a run that is killed
    keeps what it has, and the next call with the path goes on from there. A label whose data raises in a worker fails
    alone. Where a whole job fails (a worker that dies takes its wave along), the wave is halved until the label that
    does it stands alone; that one is listed with the error. Failed labels are tried again by the next call.
    """
    from glossa.sources.lines import written

    size = tokens.select("token").distinct().count()
    there = written(spark, path)
    if there is not None:  # labels as they were written, not as numbers
        there = spark.read.schema("token string, w double, y string").parquet(path)
    done = set() if there is None else {r["y"] for r in there.groupBy("y").count().filter(F.col("count") == size).collect()}
    status = {y: ("present", None) for y in labels if y in done}
    todo = sorted(set(labels) - done)
    waves = [todo[i : i + wave] for i in range(0, len(todo), wave)]
    while waves:
        own = waves.pop(0)
        try:
            rows, _, failed = train_em(words.filter(F.col("y").isin(own)), tokens, rounds, isolate=True, step=step)
            errors = {r["y"]: r["error"] for r in failed.collect()}
            trained = {r["y"] for r in rows.select("y").collect()} - done
            unpacked(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("y").parquet(path)
        except Exception as e:  # a failed job, of whatever kind
            if len(own) > 1:
                waves[:0] = [own[: len(own) // 2], own[len(own) // 2 :]]
                continue
            errors, trained = {own[0]: f"{type(e).__name__}: {e}"[:500]}, set()
        for y in own:
            status[y] = ("trained", None) if y in trained else ("failed", errors.get(y, "no words"))
    return spark.createDataFrame([(y, *status[y]) for y in sorted(status)], "y string, status string, error string")
