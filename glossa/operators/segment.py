"""Segmentation of whole texts under unigram token models: best and summed paths of all labels at once.

Texts go through in blocks of similar length, place by place: one numpy step adds a token of one length to a whole
block under all labels. Which tokens stand where is found once a block, in a trie held as sorted arrays, and serves
every label. Weights are one matrix, tokens by labels, that Spark broadcasts; its size is known before it is
collected, and more labels than fit are scored in several blocks of labels.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.sources.store import table

UNKNOWN_PENALTY = 10.0  # below the least weight of a row; the value is this library's own
MOST_BYTES = 2 << 30
BLOCK_CELLS = 1 << 20  # code points (times labels, times token lengths) of a block of texts
BLOCK_TEXTS = 512
POINTS = 0x110000
BATCH_BYTES = 1 << 20  # of texts that a worker takes at once, however many rows of a batch come in


def ends_by_size(size: np.ndarray, most: int = BATCH_BYTES) -> list[int]:
    """Where runs of rows end that have about `most` in sum: a run goes on until it has as much, so it exceeds that by less than a row."""
    cell = (np.cumsum(size) - size) // most
    return [*(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(size)] if len(size) else []


def by_size(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of a column of texts, without a copy, so that a worker's memory doesn't follow the rows of a batch."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        for end in ends_by_size(size, most):
            yield batch.slice(start, end - start)
            start = end


class Lattice:
    """Tokens with a weight under each label; `unknown` is the weight of a code point that no token covers."""

    def __init__(self, tokens: list[str], weights: np.ndarray):
        if weights.nbytes > MOST_BYTES:
            raise ValueError(f"a model of {weights.nbytes} bytes is too large to broadcast; score its labels in blocks")
        self.names = list(tokens)
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens), default=1)
        # rows: the tokens, an unknown code point, and no token at all; the only copy of the weights
        self.rows = np.empty((len(tokens) + 2, len(weights)))
        self.rows[:-2], self.rows[-2], self.rows[-1] = weights.T, weights.min(axis=1) - UNKNOWN_PENALTY, -np.inf
        self._trie(tokens)
        if self.longest == 1:  # the row of each code point
            self.row_of = np.full(POINTS, len(tokens), np.int64)
            self.row_of[[ord(t) for t in tokens if t]] = [i for i, t in enumerate(tokens) if t]

    @property
    def weights(self) -> np.ndarray:
        return self.rows[:-2].T

    @property
    def unknown(self) -> np.ndarray:
        return self.rows[-2]

    def _trie(self, tokens: list[str]) -> None:
        """Nodes numbered from the root 0; an edge's key is node * POINTS + code point."""
        children: dict[int, int] = {}
        ends = {}
        for i, token in enumerate(tokens):
            node = 0
            for c in token:
                node = children.setdefault(node * POINTS + ord(c), len(children) + 1)
            ends[node] = i
        keys = np.fromiter(children, np.int64, len(children))
        order = np.argsort(keys)
        self.edge_keys, self.edge_nodes = keys[order], np.fromiter(children.values(), np.int64, len(children))[order]
        self.node_token = np.full(len(children) + 1, -1, np.int32)
        for node, i in ends.items():
            self.node_token[node] = i

    def _blocks(self, texts: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of the texts, tok) by blocks of similar length; tok[k - 1, s, b] is the token of k code points from place s."""
        size = np.array([len(t) for t in texts])
        order = np.argsort(size, kind="stable")[::-1]
        order = order[size[order] > 0]
        at = 0
        while at < len(order):
            most = max(1, BLOCK_CELLS // (int(size[order[at]]) * width))
            part = order[at : at + min(most, BLOCK_TEXTS)][::-1]
            at += len(part)
            yield part, self._tokens_at([texts[i] for i in part])

    def _parts(self, texts: list[str]) -> Iterator[list[int]]:
        """Consecutive texts of about BLOCK_CELLS code points, and no more of them than have as many counts of tokens."""
        part, size, most = [], 0, max(1, BLOCK_CELLS // len(self.rows))
        for i, text in enumerate(texts):
            part.append(i)
            size += len(text)
            if size >= BLOCK_CELLS or len(part) == most:
                yield part
                part, size = [], 0
        if part:
            yield part

    def _tokens_at(self, texts: list[str]) -> np.ndarray:
        n, none = max(map(len, texts)), len(self.names) + 1
        codes = np.full((n, len(texts)), -1, np.int64)
        for b, t in enumerate(texts):
            codes[: len(t), b] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.full((self.longest, n, len(texts)), none, np.int32)
        nodes = np.zeros(codes.shape, np.int64)
        for k in range(self.longest):
            rows = n - k
            if rows <= 0 or not len(self.edge_keys):
                break
            here, code = nodes[:rows], codes[k:]
            keys = here * POINTS + code
            found = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            ok = (here >= 0) & (code >= 0) & (self.edge_keys[found] == keys)
            nodes = np.where(ok, self.edge_nodes[found], -1)
            token = np.where(ok, self.node_token[nodes], -1)
            out[k, :rows] = np.where(token >= 0, token, none)
            if not ok.any():
                break
        out[0] = np.where((codes >= 0) & (out[0] == none), none - 1, out[0])
        return out

    def scores(self, texts: list[str], marginal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(scores, numbers of tokens), texts by labels: of the best path, or of all paths together (then the best's number)."""
        labels = self.rows.shape[1]
        total, size = np.zeros((len(texts), labels)), np.zeros((len(texts), labels), np.int64)
        if self.longest == 1:  # one path only: counts of code points times weights
            for part in self._parts(texts):
                codes = np.frombuffer("".join([texts[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32)
                length = np.array([len(texts[i]) for i in part])
                cells = self.row_of[codes] + np.repeat(np.arange(len(part)) * len(self.rows), length)
                n = np.bincount(cells, minlength=len(part) * len(self.rows)).reshape(len(part), len(self.rows))[:, :-1]
                total[part], size[part] = n.astype(np.float64) @ self.rows[:-1], length[:, None]
            return total, size
        for part, tok in self._blocks(texts, max(self.longest, labels // 8 + 1)):
            total[part], size[part] = self._walk(tok, np.array([len(texts[i]) for i in part]), marginal)
        return total, size

    def _walk(self, tok: np.ndarray, ends: np.ndarray, marginal: bool) -> tuple[np.ndarray, np.ndarray]:
        longest, n, texts = tok.shape
        used = (tok <= len(self.names)).any(axis=2)
        ring = longest + 1
        shape = (ring, texts, self.rows.shape[1])
        best, steps = np.full(shape, -np.inf), np.zeros(shape, np.int32)
        summed = np.full(shape, -np.inf) if marginal else None
        best[0] = 0
        if marginal:
            summed[0] = 0
        total, size = np.zeros(shape[1:]), np.zeros(shape[1:], np.int64)
        for s in range(n + 1):
            here = s % ring
            done = ends == s
            if done.any():
                total[done], size[done] = (summed if marginal else best)[here][done], steps[here][done]
            if s == n:
                break
            for k in range(min(longest, n - s)):
                if not used[k, s]:
                    continue
                there, w = (s + k + 1) % ring, self.rows[tok[k, s]]
                new = best[here] + w
                better = new > best[there]
                steps[there] = np.where(better, steps[here] + 1, steps[there])
                np.maximum(best[there], new, out=best[there])
                if marginal:
                    np.logaddexp(summed[there], summed[here] + w, out=summed[there])
            best[here] = -np.inf
            if marginal:
                summed[here] = -np.inf
        return total, size

    def score(self, text: str, marginal: bool = False) -> np.ndarray:
        return self.scores([text], marginal)[0][0]


def weight_rows(model: DataFrame) -> DataFrame:
    """A long model (y, token, w and perhaps n_lines) as a written table of one row a label: its tokens in order, with a hash of them, and their weights."""
    lines = F.first("n_lines") if "n_lines" in model.columns else F.lit(None).cast("long")
    rows = model.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("token", "w"))).alias("cells"), lines.alias("n_lines"))
    tokens = F.transform("cells", lambda c: c["token"])
    return table(rows.select("y", "n_lines", tokens.alias("tokens"), F.xxhash64(tokens).alias("of"), F.transform("cells", lambda c: c["w"]).alias("w")), "weights")


def _sizes(rows: DataFrame) -> tuple[list[str], int]:
    """The labels, which are few by nature, and the most tokens of one; a missing or doubled cell is an error."""
    found = rows.select("y", F.size("tokens").alias("n"), "of", F.exists("w", lambda w: w.isNull()).alias("bad")).orderBy("y").collect()
    if any(r["bad"] for r in found) or len({(r["n"], r["of"]) for r in found}) > 1:
        raise ValueError("the model lacks weights of some labels and tokens")
    return [r["y"] for r in found], max((r["n"] for r in found), default=0)


def _collected(rows: DataFrame, labels: list[str], n_tokens: int) -> tuple[list[str], np.ndarray, list[int | None]]:
    """(tokens, weights, n_lines) of these labels, in their order; the weights come as Arrow buffers once their size is known to fit."""
    if len(labels) * n_tokens * 8 > MOST_BYTES:
        raise ValueError(f"a model of {len(labels)} labels and {n_tokens} tokens is too large to broadcast; score its labels in blocks")
    tokens = rows.filter(F.col("y") == labels[0]).first()["tokens"] if labels else []
    found = rows.filter(F.col("y").isin(labels)).select("y", "n_lines", "w").toArrow()
    at = {y: i for i, y in enumerate(found["y"].to_pylist())}
    order = [at[y] for y in labels]
    weights = found["w"].combine_chunks().flatten().to_numpy().reshape(len(labels), len(tokens))[order] if labels else np.zeros((0, 0))
    n_lines = found["n_lines"].to_pylist()
    return tokens, weights, [n_lines[i] for i in order]


def preprocess(text: str | None, form: str | None = None, space: str | None = None) -> str:
    """A text in a Unicode normal form, runs of white space as one `space` where that is given; null and empty give ""."""
    text = unicodedata.normalize(form, text) if form and text else text or ""
    return space.join(text.split()) if space else text


CANDIDATE = "struct<score:double,label:string,n_lines:long,n_tokens:long>"


def _score_block(lines: DataFrame, rows: DataFrame, names: list[str], n_tokens: int, k, alpha, marginal, bias, normalise, own) -> DataFrame:
    tokens, weights, counted = _collected(rows, names, n_tokens)
    lattice = Lattice(tokens, weights)
    add = np.array([(bias or {}).get(x, 0.0) for x in names])
    label, n_lines, place = pa.array(names, pa.string()), pa.array(counted, pa.int64()), {x: i for i, x in enumerate(names)}
    most = len(names) if k is None else min(k, len(names))
    keep = [c for c in lines.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name != "text") + f", status string, cands array<{CANDIDATE}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            texts = [normalise(t) if normalise else t or "" for t in batch.column("text").to_pylist()]
            scores, size = lattice.scores(texts, marginal)
            scores = np.round(scores, 4) + add
            if alpha is not None:
                scores = np.where(size > 0, scores / np.maximum(size, 1) ** alpha, -np.inf)
            scores = np.round(scores, 4)
            some = np.array([bool(t) for t in texts])
            which = np.argsort(-scores, axis=1, kind="stable")[:, :most]  # names ascend, so the lesser of equals comes first
            chosen = np.repeat(some[:, None], most, axis=1)
            if own is not None:  # one more place, for the line's own label
                mine = np.array([place.get(y, -1) for y in batch.column(own).to_pylist()], np.int64)[:, None]
                which, chosen = np.hstack([which, mine]), np.hstack([chosen, some[:, None] & (mine >= 0) & (which != mine).all(axis=1, keepdims=True)])
            text, column = np.nonzero(chosen)
            i = which[text, column]
            entries = pa.StructArray.from_arrays([pa.array(scores[text, i]), label.take(pa.array(i)), n_lines.take(pa.array(i)), pa.array(size[text, i])], names=["score", "label", "n_lines", "n_tokens"])
            cands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(chosen.sum(axis=1)))), pa.int32()), entries)
            status = pa.array(np.where(some, "SCORED", "EMPTY").tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), status, cands], names=[*keep, "status", "cands"])

    return lines.mapInArrow(run, schema)


def score_lines(
    lines: DataFrame, model: DataFrame, k: int | None = 5, alpha: float | None = None, marginal: bool = False, bias: dict[str, float] | None = None,
    normalise: Callable[[str | None], str] | None = None, own: str | None = None,
) -> DataFrame:
    """The columns of lines but text, with status and cands: the k best labels (score, label, n_lines, n_tokens), best first, the lesser on ties.

    Empty texts keep their row with status EMPTY and no candidates. `own` names a column whose label is appended where
    it isn't among the k best. Labels that don't fit into one broadcast are scored in blocks, whose candidates meet by
    line_idx, which must then be unique.
    """
    rows = weight_rows(model)
    labels, tokens = _sizes(rows)
    step = max(1, MOST_BYTES // max(1, tokens * 8))
    if len(labels) <= step:
        return _score_block(lines, rows, labels, tokens, k, alpha, marginal, bias, normalise, own)
    parts = [_score_block(lines, rows, labels[a : a + step], tokens, k, alpha, marginal, bias, normalise, None) for a in range(0, len(labels), step)]
    one = parts[0]
    for part in parts[1:]:
        one = one.unionByName(part)
    keep = [c for c in one.columns if c not in ("line_idx", "cands")]
    key = lambda c: F.struct((-c["score"]).alias("minus"), c["label"].alias("label"), c["n_lines"].alias("n_lines"), c["n_tokens"].alias("n_tokens"))
    back = lambda c: F.struct((-c["minus"]).alias("score"), c["label"].alias("label"), c["n_lines"].alias("n_lines"), c["n_tokens"].alias("n_tokens"))
    merged = F.array_sort(F.transform(F.flatten(F.collect_list("cands")), key))
    best = F.transform(merged if k is None else F.slice(merged, 1, k), back)
    return one.groupBy("line_idx").agg(*(F.first(c).alias(c) for c in keep), best.alias("cands"))


def score_texts(lines: DataFrame, model: DataFrame, k: int = 1, alpha: float | None = None, marginal: bool = False, bias: dict[str, float] | None = None) -> DataFrame:
    """line_idx, status, pred and candidates (label, score), best first, of lines (line_idx, text); empty texts keep a row without pred."""
    rows = score_lines(lines.select("line_idx", "text"), model, k, alpha, marginal, bias)
    pairs = F.transform("cands", lambda c: F.struct(c["label"].alias("label"), c["score"].alias("score")))
    return rows.select("line_idx", "status", F.get("cands", F.lit(0))["label"].alias("pred"), pairs.alias("candidates"))


def preflight(tokens: list[str], lines: DataFrame, special: list[str] = (), size: int | None = None, least_lines: int = 1) -> DataFrame:
    """(check, passed, found) before a training: special tokens are there, no token twice or empty, the vocabulary has `size`, every label `least_lines` lines."""
    missing = [t for t in special if t not in set(tokens)]
    few = lines.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") < least_lines), F.count(F.lit(1))).first()
    checks = [
        ("special tokens", not missing, ",".join(missing)), ("vocabulary size", size in (None, len(tokens)), str(len(tokens))),
        ("tokens unique and not empty", len(set(tokens)) == len(tokens) and "" not in tokens, str(len(set(tokens)))), ("lines a label", few[1] > 0 and few[0] == 0, str(few[0])),
    ]
    return lines.sparkSession.createDataFrame(checks, "check string, passed boolean, found string")
