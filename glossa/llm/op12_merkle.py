"""Merkle manifest of a dataset: blocks of leaves are collapsed by higher-order functions, then the blocks' roots in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import read, small, written

# The levels of one block, leaves first: each level's runs of two become their hash, k times.
LEVELS = """
aggregate(
  if(k > 0, sequence(1, k), cast(array() AS array<int>)),
  array(transform(items, i -> i.digest)),
  (done, turn) -> concat(done, array(transform(
    sequence(0, cast((size(element_at(done, -1)) - 1) div 2 AS int)),
    run -> sha2(array_join(slice(element_at(done, -1), 2 * run + 1, 2), ''), 256)))))
"""

# Each item of a block with its sibling on every level (null where a run is one node) and whether that stands before it.
PATHS = """
transform(items, (item, at) -> named_struct('item', item, 'path', transform(
  if(k > 0, sequence(0, k - 1), cast(array() AS array<int>)),
  level -> named_struct('sibling', get(levels[level], shiftright(at, level) ^ 1), 'before', (shiftright(at, level) & 1) = 1))))
"""

PATH = "array<struct<sibling:string,before:boolean>>"


def field(value: Column) -> Column:
    """A value as a leaf's part: - for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows of a written table with pos, their place from 0 among the rows of their key, in the given order.

    Rows are dealt by ranges of (key, order) and sorted there; the counts by key and partition, partitions x keys rows
    at most, give each run's offset. A hot key spans many partitions.
    """
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    dealt = written(dealt.withColumn("seen", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("seen", 33)
    runs = dealt.groupBy("key", part.alias("part")).agg(F.min("seen").alias("start"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("key", "part", (before - F.col("start")).alias("shift")), "merkle-runs")
    return dealt.withColumn("part", part).join(small(runs), ["key", "part"]).withColumn("pos", F.col("seen") + F.col("shift")).drop("seen", "part", "shift")


def collapsed(nodes: DataFrame, block: int) -> list[DataFrame]:
    """The trees over nodes (key, pos, digest, more), one a key, as written tables of blocks, the lowest first.

    A block is (key, block, items, k, levels, root): at most `block` consecutive nodes, all their levels, and the node
    that they collapse to. A key of several blocks goes on with their roots; of the last table a key has one block.
    """
    tables = []
    height = block.bit_length() - 1
    while True:
        counts = written(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")
        rest = [c for c in nodes.columns if c not in ("key", "pos", "digest")]
        gathered = F.array_sort(F.collect_list(F.struct("pos", "digest", *rest))).alias("items")
        found = nodes.groupBy("key", F.expr(f"pos div {block}").alias("block")).agg(gathered).join(small(counts), "key")
        levels = F.when(F.col("n") > block, height).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
        found = written(found.select("key", "block", "items", levels.cast("int").alias("k")).withColumn("levels", F.expr(LEVELS)), "merkle-blocks")
        tables.append(found)
        if counts.filter(F.col("n") > block).isEmpty():
            return tables
        nodes = found.select("key", F.col("block").alias("pos"), _root().alias("digest"))


def _root() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def proofs(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """Each leaf of the trees with its path: the siblings level by level, then those of `above` (key, path, and more)."""
    more = [c for c in above.columns if c not in ("key", "path")]
    found = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tables):
        rows = blocks.join(small(found), ["key", "block"])
        each = rows.select("key", "path", *more, F.explode(F.expr(PATHS)).alias("each"))
        inner = [c for c in blocks.schema["items"].dataType.elementType.names if c not in ("pos", "digest")]
        full = F.concat("each.path", "path").alias("path")
        found = each.select("key", F.col("each.item.pos").alias("block"), F.col("each.item.digest").alias("digest"), full, *more, *(F.col(f"each.item.{c}").alias(c) for c in inner))
    return found.withColumnRenamed("block", "pos")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def step(node: Column, level: Column) -> Column:
        other = F.coalesce(level["sibling"], F.lit(""))
        return F.sha2(F.when(level["before"], F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", block: int = 1024) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified) for each row of docs.

    Leaves hash the given fields; per value of `group` they ascend by `order` and form a tree, and the trees' roots,
    ordered by that value (null first, bytewise), form another. `block` is a power of two. folded_root starts from the
    leaf of the row as changed by `tampered` (expressions by field), with the original siblings.

    Nulls in any field have a leaf of their own; rows without an order value come first in their tree; rows of equal
    order value ascend by leaf, so repeated rows stand side by side and each counts. A null group is a group. Columns
    besides the fields aren't hashed; an empty table gives an empty result.
    """
    if block < 2 or block & (block - 1):
        raise ValueError("block must be a power of two")
    values = [F.col(f) for f in fields]
    other = [(tampered or {}).get(f, F.col(f)) for f in fields]
    changed = F.lit(False)
    for a, b in zip(values, other, strict=True):
        changed = changed | ~a.eqNullSafe(b)
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # "-" sorts before "="
    rows = docs.select(key.alias("key"), F.col(order).alias("id"), leaf(*values).alias("digest"), F.when(changed, leaf(*other)).alias("other"), F.monotonically_increasing_id().alias("nth"))
    leaves = numbered(written(rows, "merkle-leaves"), ["id", "digest", "nth"])
    tables = collapsed(leaves.select("key", "pos", "digest", "id", "other"), block)
    subroots = written(tables[-1].select("key", _root().alias("digest")), "merkle-subroots")
    top = collapsed(numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("member"), "digest"), ["member"]), block)
    root = top[-1].select("key", F.array().cast(PATH).alias("path"), _root().alias("root"))
    above = written(proofs(top, root).select(F.col("member").alias("key"), "path", "root", F.col("digest").alias("subroot")), "merkle-top")
    out = proofs(tables, above).withColumn("folded_root", folded(F.coalesce("other", "digest"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: p["sibling"]), ""), 256)  # nulls are left out
    return out.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampering() -> dict[str, Column]:
    """One more in n_chars where 7 divides the crc32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """All documents, a tree per language and one over the languages."""
    return manifest(read(spark, sf_dir, "documents"), tampering()).drop("path")


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
# crc32 bit by bit over the codes of the decimal doc_id; 3988292384 and 4294967295 are the checksum's fixed values
_BITS = "list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))"
_CODES = "list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_CODES}), lambda a, c: {_BITS}), 4294967295::BIGINT)"

SQL = f"""
WITH RECURSIVE marked AS (
  SELECT *, CASE WHEN {_CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS changed FROM documents
), leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
    {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="changed")} AS other FROM marked
), tree AS (
  SELECT lang, 0 AS height, pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT lang, height + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, height, pos // 2, n
), tops AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS height, pos, digest, n FROM tops
  UNION ALL
  SELECT height + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM crown WHERE n > 1 GROUP BY height, pos // 2, n
), steps AS (
  SELECT l.doc_id, t.height AS step, s.digest AS sibling, (l.pos >> t.height) % 2 = 1 AS before
  FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.pos = (l.pos >> t.height) AND t.n > 1
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.height = t.height AND s.pos = xor(l.pos >> t.height, 1)
  UNION ALL
  SELECT l.doc_id, 1000 + c.height, s.digest, (o.pos >> c.height) % 2 = 1
  FROM leaves l JOIN tops o ON o.lang IS NOT DISTINCT FROM l.lang JOIN crown c ON c.pos = (o.pos >> c.height) AND c.n > 1
  LEFT JOIN crown s ON s.height = c.height AND s.pos = xor(o.pos >> c.height, 1)
), paths AS (
  SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256, list({{'s': coalesce(sibling, ''), 'b': before}} ORDER BY step) AS path FROM steps GROUP BY doc_id
), fold AS (
  SELECT l.doc_id, l.other AS node, 1 AS turn, p.path FROM leaves l LEFT JOIN paths p USING (doc_id)
  UNION ALL
  SELECT doc_id, sha256(CASE WHEN path[turn].b THEN path[turn].s || node ELSE node || path[turn].s END), turn + 1, path FROM fold WHERE turn <= coalesce(len(path), 0)
), root AS (SELECT digest AS root FROM crown WHERE n = 1)
SELECT l.doc_id, l.leaf, o.digest AS subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = root.root AS verified
FROM leaves l JOIN tops o ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root LEFT JOIN paths p USING (doc_id)
JOIN fold f ON f.doc_id = l.doc_id AND f.turn = coalesce(len(f.path), 0) + 1
"""
