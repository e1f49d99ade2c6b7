"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of each host."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import read, small, written

# Elements and class words that mark what isn't the article.
NOT_TEXT = set("nav header footer aside form script style noscript template button select textarea iframe svg object dialog menu head title".split())
NOT_TEXT_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu header masthead footer sidebar aside "
    "comment comments reply replies disqus respond cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login search share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar contentinfo complementary dialog".split()
)
# Words that don't change what a listed word beside them says ("site-header", "comment-list").
BESIDE = set("site box bar list links buttons".split())
ARTICLE = {"article", "main"}
NEVER_BARRED = {"html", "body", *ARTICLE}
ARTICLE_WORDS = set("article main content post entry story".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
CLOSED_BY = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
HOLDERS = set("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot blockquote figure details fieldset".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:"[^"]*"|'[^']*'|[^'">])*/>|"""
    r"<(script|style|noscript|template|textarea|title|svg|iframe)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|"
    r"""<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""",
    re.S | re.I,
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NOT_LETTERS = re.compile(r"[^a-z]+")


def bars(name: str) -> bool:
    """Whether a class, id or role (lower case) says that an element holds no article: all its words do, or stand beside one that does."""
    parts = [w for w in NOT_LETTERS.split(name) if w]
    return not NOT_TEXT_WORDS.isdisjoint(parts) and all(w in NOT_TEXT_WORDS or w in BESIDE for w in parts)


def blocks(page: str | None) -> Iterator[tuple[str, str]]:
    """(path, text) of each block with text, in page order; a path names the open elements with their class words, "!" before those that hold no article."""
    stack: list[tuple[str, str]] = []
    path, pieces = "", []

    def done():
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        pieces.clear()
        return text

    for m in TOKEN.finditer(page or ""):
        token = m[0]
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1] or (token[0] == "<" and len(token) > 1):
                continue  # a comment, declaration, script or the like
            pieces.append(token)
            continue
        if name in INLINE or name == "br" or name == "wbr":
            if name == "br":
                pieces.append(" ")
            continue
        if text := done():
            yield path, text
        if name in VOID:
            continue
        if m[2] or m[5]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name not in HOLDERS and stack[i][0] in HOLDERS:
                    break  # a stray end of a smaller element
        else:
            if name in CLOSES_ITSELF or name in HOLDERS:
                shut = CLOSED_BY.get(name, {name}) if name in CLOSES_ITSELF else {"p"}
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in shut:
                        del stack[i:]
                        break
                    if stack[i][0] in HOLDERS:
                        break
            attributes = m[4] or m[7] or ""
            names = [n for found in MARKS.findall(attributes) for n in "".join(found).lower().split()] if attributes else []
            marks = [w for n in names for w in NOT_LETTERS.split(n) if w]
            bad = name in NOT_TEXT or (name not in NEVER_BARRED and any(map(bars, names)))
            stack.append((name, ("!" if bad else "") + ".".join([name, *dict.fromkeys(marks)])))
        path = ">".join(label for _, label in stack)
    if text := done():
        yield path, text


def is_article(path: str) -> bool:
    """Whether a path lies in an article element or one named so, and in nothing that is none."""
    labels = path.split(">")
    return not any(x.startswith("!") for x in labels) and any(x.split(".")[0] in ARTICLE or not ARTICLE_WORDS.isdisjoint(x.split(".")[1:]) for x in labels)


def text_slot(path: str, text: str) -> int:
    """A 64-bit hash of a block's path and text."""
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


# A wrapper is the expression that takes all streams of a host that it was made from: {"pages": their number, "nodes": [...]},
# each node a dict of
#   path, text (the string's hash; null: a text slot), n (pages that have it), chars (of all its strings), many (repeated), or
#   group (the nodes of a repeated group), n.
# A node that fewer than all pages have is optional.


def of_stream(paths: list[str], texts: list[int | None], chars: list[int], pages: int = 1) -> dict:
    """The wrapper of pages with one sequence of paths, whose strings are equal (a hash) or not (null) at each place."""
    return {"pages": pages, "nodes": [{"path": p, "text": t, "n": pages, "chars": c, "many": False} for p, t, c in zip(paths, texts, chars, strict=True)]}


def shape(node: dict) -> tuple:
    """What a node is apart from its strings: its path, or a group's nodes' shapes."""
    return ("", *map(shape, node["group"])) if "group" in node else (node["path"],)


def constant(node: dict) -> bool:
    """Whether several pages have the node with one string."""
    return "group" not in node and node["text"] is not None and node["n"] > 1 and not node["many"]


def joined(x: dict, y: dict) -> dict:
    """Two nodes of one shape, of different pages, as one; strings that differ make a slot."""
    n = x["n"] + y["n"]
    if "group" in x:
        return {"group": list(map(joined, x["group"], y["group"])), "n": n}
    return {"path": x["path"], "text": x["text"] if x["text"] == y["text"] else None, "n": n, "chars": x["chars"] + y["chars"], "many": x["many"] or y["many"]}


def turn(x: dict, y: dict) -> dict:
    """Two nodes of one shape that stand in two turns of a group: what one of them lacks somewhere is optional in it."""
    if "group" in x:
        return {"group": list(map(turn, x["group"], y["group"])), "n": min(x["n"], y["n"])}
    return {**joined(x, y), "n": min(x["n"], y["n"])}


def pages_of(*turns: list[dict]) -> int:
    """Pages that have one of the turns: as many as their nodes, if these agree; else no less than that, so that their nodes are optional in the group."""
    ns = {x["n"] for t in turns for x in t}
    return ns.pop() if len(ns) == 1 else sum(max(x["n"] for x in t) for t in turns)


def folded(nodes: list[dict], longest: int = 4) -> list[dict]:
    """nodes with each run of equal shapes, one after another, as a repeated slot or group; constant strings are never folded."""
    out: list[dict] = []
    for node in nodes:
        out.append(node)
        shrunk = True
        while shrunk:
            shrunk = False
            for k in range(1, longest + 1):
                last, before = out[-k:], out[-2 * k : -k]
                if len(before) < k or any(map(constant, [*before, *last])):
                    continue
                if [*map(shape, last)] == [*map(shape, before)]:
                    if k > 1:
                        one = {"group": list(map(turn, before, last)), "n": pages_of(before, last)}
                    elif "group" in last[0]:
                        one = {"group": list(map(turn, before[0]["group"], last[0]["group"])), "n": pages_of(before, last)}
                    else:
                        one = {**joined(before[0], last[0]), "n": max(before[0]["n"], last[0]["n"]), "many": True}
                    out[-2 * k :] = [one]
                    shrunk = True
                    break
                if k > 1 and len(out) > k and "group" in out[-k - 1] and shape(out[-k - 1]) == ("", *map(shape, last)):
                    out[-k - 1 :] = [{"group": list(map(turn, out[-k - 1]["group"], last)), "n": pages_of([out[-k - 1]], last)}]
                    shrunk = True
                    break
    return out


def grouped(nodes: list[dict], groups: list[dict]) -> list[dict]:
    """nodes with each run that is one turn of a known group as that group, so that it meets its repeated form."""
    out, i = [], 0
    shapes = {shape(g)[1:] for g in groups}
    while i < len(nodes):
        for k in sorted(map(len, shapes), reverse=True):
            run = nodes[i : i + k]
            if len(run) == k and not any(map(constant, run)) and tuple(map(shape, run)) in shapes:
                out.append({"group": run, "n": min(x["n"] for x in run)})
                i += k
                break
        else:
            out.append(nodes[i])
            i += 1
    return out


def gap(a: list[dict], b: list[dict]) -> list[dict]:
    """Two runs of nodes without a string in common: what repeats is folded, equal shapes meet, and what only one has becomes optional."""
    a, b = folded(a), folded(b)
    a, b = grouped(a, [x for x in b if "group" in x]), grouped(b, [x for x in a if "group" in x])
    key = lambda x: (shape(x), x["text"] if constant(x) else None)
    out: list[dict] = []
    for kind, i, j, k, m in SequenceMatcher(None, list(map(key, a)), list(map(key, b)), autojunk=False).get_opcodes():
        out += [joined(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)] if kind == "equal" else [*a[i:j], *b[k:m]]
    return out


def align(one: dict, two: dict) -> dict:
    """One wrapper of two: strings that both have anchor it; between them strings that differ become slots, and nodes of different shape optional or repeated ones."""
    a, b, out, i, k = one["nodes"], two["nodes"], [], 0, 0
    string = lambda nodes, side: [(x["path"], x["text"]) if "group" not in x and x["text"] is not None and not x["many"] else (side, i) for i, x in enumerate(nodes)]
    for m in SequenceMatcher(None, string(a, 0), string(b, 1), autojunk=False).get_matching_blocks():
        out += gap(a[i : m.a], b[k : m.b])
        out += [joined(x, y) for x, y in zip(a[m.a : m.a + m.size], b[m.b : m.b + m.size], strict=True)]
        i, k = m.a + m.size, m.b + m.size
    pages = one["pages"] + two["pages"]
    rare = lambda x: constant(x) and 4 * x["n"] < pages
    return {"pages": pages, "nodes": folded([{**x, "text": None} if rare(x) else x for x in out])}


def leaves(nodes: list[dict]) -> Iterator[dict]:
    for x in nodes:
        yield from leaves(x["group"]) if "group" in x else (x,)


def template(wrapper: dict) -> list[int]:
    """The hashes of the host's template texts: constant strings of the wrapper that half of its pages have or more, in one place, and outside articles.

    Where constant strings outweigh all others the pages are copies of one another and tell nothing; then there is none.
    """
    outside = [x for x in leaves(wrapper["nodes"]) if not is_article(x["path"])]
    texts = [x["text"] for x in outside]
    fixed = [x for x in outside if constant(x) and 2 * x["n"] >= wrapper["pages"] and texts.count(x["text"]) == 1]
    if 2 * sum(x["chars"] for x in fixed) >= sum(x["chars"] for x in leaves(wrapper["nodes"])):
        return []
    return sorted(x["text"] for x in fixed)


def choose(wrapper: dict) -> list[str]:
    """The paths of the article's text slots: those in an article element; else those under the element that holds most text and yet most of its parent's.

    Template texts are none; a constant text in an article or in several places of the wrapper is a slot like another.
    """
    fixed, chars = set(template(wrapper)), {}
    for x in leaves(wrapper["nodes"]):
        if x["text"] is None or x["text"] not in fixed:
            chars[x["path"]] = chars.get(x["path"], 0) + x["chars"]
    named = [p for p in chars if p.split(">")[-1] and is_article(p)]
    elements = [p for p in named if any(x.split(".")[0] in ARTICLE for x in p.split(">"))]
    if named:
        return sorted(set(elements or named))
    free = {p: n for p, n in chars.items() if "!" not in p}
    if not free:  # class words alone don't reject all that there is
        by_tag = lambda path: any(x[0] == "!" and x[1:].split(".")[0] in NOT_TEXT for x in path.split(">") if x)
        free = {p: n for p, n in chars.items() if not by_tag(p)}
    total = sum(free.values())
    root = ""
    while free:
        below: dict[str, float] = {}
        for p, n in free.items():
            if p.startswith(root) and p != root:
                step = p[len(root) :].lstrip(">").split(">")
                if len(step) > 1:
                    below["".join([root, ">" if root else "", step[0]])] = below.get("".join([root, ">" if root else "", step[0]]), 0.0) + n
        best = max(below, key=below.get, default=None)
        if best is None or below[best] < 0.6 * total:
            break
        root = best
    return sorted({p for p in free if p == root or p.startswith(root + ">") or not root})


def own_slots(page: list[tuple[str, str]]) -> list[str]:
    """The article slots that a page's own stream gives, for pages whose host's wrapper finds nothing in them."""
    return choose(of_stream([p for p, _ in page], [None] * len(page), [len(t) for _, t in page]))


def _host() -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col("url")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def page_streams(pages: DataFrame) -> DataFrame:
    """host, page (a hash of all blocks), shape (a hash of their paths), paths, texts (hashes of path and string), chars of the blocks of each page (url, html) that has any."""
    schema = "host string, page long, shape long, paths array<string>, texts array<long>, chars array<int>"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = list(blocks(page.as_py()))
                texts, paths = [text_slot(path, text) for path, text in own], [path for path, _ in own]
                if own:
                    rows.append((host, text_slot("", repr(texts)), text_slot("", repr(paths)), paths, texts, [len(text) for _, text in own]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["host", "page", "shape", "paths", "texts", "chars"])

    return pages.select(_host().alias("host"), "html").mapInArrow(found, schema)


def shape_wrappers(streams: DataFrame, salts: int = 64) -> DataFrame:
    """host, wrapper (JSON) of the pages of each host that have one sequence of paths, each different page once; up to `salts` of them a sequence.

    What is shuffled of a page are the hashes and lengths of its blocks, not its paths; a sorted partition holds one
    page and one wrapper at a time.
    """
    names = streams.groupBy("host", "shape").agg(F.first("paths").alias("paths"))
    light = streams.select("host", "shape", "page", "texts", "chars").repartition("host", "shape", F.pmod("page", F.lit(salts))).sortWithinPartitions("host", "shape", "page")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, page, texts, chars, n = None, None, [], np.zeros(0, np.int64), 0

        def out():
            columns = [[key[0]], [key[1]], [texts], [chars.tolist()], [n]]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "shape", "texts", "chars", "pages"])

        for batch in batches:
            for host, own, this, words, sizes in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "page", "texts", "chars")), strict=True):
                if (host, own) != key:
                    if key is not None:
                        yield out()
                    key, page, texts, chars, n = (host, own), this, words, np.array(sizes, np.int64), 1
                elif this != page:
                    page, texts, n = this, [a if a == b else None for a, b in zip(texts, words, strict=True)], n + 1
                    chars += np.array(sizes, np.int64)
        if key is not None:
            yield out()

    merged = light.mapInArrow(merge, "host string, shape long, texts array<long>, chars array<long>, pages long")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of_stream(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("paths", "texts", "chars", "pages")), strict=True)]
            found = [{**w, "nodes": folded(w["nodes"])} if w["pages"] > 1 else w for w in found]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(list(map(json.dumps, found)), pa.string())], names=["host", "wrapper"])

    return merged.join(names, ["host", "shape"]).select("host", "paths", "texts", "chars", "pages").mapInArrow(name, "host string, wrapper string")


def align_all(wrappers: DataFrame, at_once: int = 32) -> DataFrame:
    """host, wrapper: the wrappers of each host (host, wrapper) aligned into one.

    Rounds of groups of about `at_once`, whose wrappers are aligned in the next round: a task holds a few however many
    a host has, and the rounds grow with the logarithm of that number. In a group those of most pages come first, so
    that strings are known to be constant before rare pages are met.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        found = sorted(map(json.loads, sorted(rows["wrapper"])), key=lambda w: (-w["pages"], len(w["nodes"])))
        whole = found[0]
        for w in found[1:]:
            whole = align(whole, w)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(whole)]})

    rows, groups = written(wrappers, "html-shapes"), 0
    while groups != 1:
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 1
        groups = -(-most // at_once)
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(groups)).alias("salt")
        rows = written(rows.select("host", "wrapper", salt).groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string"), "html-aligned")
    return rows


def infer(pages: DataFrame, at_once: int = 32) -> DataFrame:
    """(host, wrapper, slots, template): a wrapper as JSON, the paths of its article slots and the hashes of its template texts.

    Pages of a host with one sequence of paths are one stream whose strings are compared place by place; the different
    sequences are aligned, strings that both have first, in groups of about `at_once`, round by round. A host's pages
    are never gathered; its wrapper is one row.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [json.loads(w) for w in rows["wrapper"]]
            yield pd.DataFrame({"host": rows["host"], "wrapper": rows["wrapper"], "slots": list(map(choose, found)), "template": list(map(template, found))})

    streams = written(page_streams(pages), "html-streams")
    picked = align_all(shape_wrappers(streams), at_once).mapInPandas(pick, "host string, wrapper string, slots array<string>, template array<long>")
    return written(picked, "html-wrappers")


TEXTS = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html): the texts of the host's article slots, in page order.

    A block is what stands between two tags that aren't inline; template texts of the host are left out, but none that
    stands in an article. A page that
    has none of the slots is read by its own stream. Null and empty pages have an empty text; pages without a host form one; repeated rows stay; a page's length isn't bounded.
    """
    wrappers = infer(pages).select(F.col("host").alias("h"), "slots", "template")
    joined = pages.select("page_id", "url", "html", _host().alias("host")).join(small(wrappers), F.col("host") == F.col("h"), "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, slots, fixed in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                wanted, own = set(slots.as_py() or ()), list(blocks(page.as_py()))
                if own and not any(path in wanted for path, _ in own):
                    wanted = set(own_slots(own))
                constant = set(fixed.as_py() or ())
                out.append("\n\n".join(text for path, text in own if path in wanted and not (constant and text_slot(path, text) in constant)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "slots", "template").mapInArrow(texts, TEXTS)


def op7_html(spark, sf_dir: str) -> DataFrame:
    """Article texts of all pages."""
    return extract(read(spark, sf_dir, "pages"))
