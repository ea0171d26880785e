"""Markup left in texts: its kinds, and clean text that keeps the structure.

A tolerant parser takes everything that could be HTML, Markdown, wiki or LaTeX markup, closed or cut
off, as a node of a tree; HTML tags are paired to a tree of elements. Gradient-boosted trees rate each
node by its syntax, attribute tokens, depth, siblings and the density of nodes below it; they are fitted on synthetic texts of fixed number
(``SAMPLES``) with known markup and look-alikes, no table is read for it. Decoding chooses the nodes of the
best total log odds over the tree such that no node inside chosen code, comment, formula or template is
chosen too, of overlapping nodes one, and of an element's two tags both or none.

Clean text drops the marks, scripts and styles and keeps: headings as lines of their own, list items as
``- ``, table cells separated by tabs, code and formulas as they are, bare mathematical commands too.
``blocks`` tells where these lie, those of HTML elements included.

Results for odd input: NULL texts have no kinds and NULL clean text; empty texts stay empty;
texts without any candidate mark (tested in the JVM) come out unchanged without being parsed;
repeated rows give equal rows, once in ``found``.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .markup_nodes import ANY, KINDS, Node, agree, candidates, decode, features, link_tree
from .markup_samples import sample

SAMPLES = 4000
SEED = 11


def labelled_nodes(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(samples):
        text, spans = sample(r)
        nodes = candidates(text)
        if not nodes:
            continue
        link_tree(nodes)
        xs.append(features(text, nodes))
        ys += [any(k == n.kind and a <= n.start < b and (n.end <= b + 2 or n.start <= a + 2) for k, a, b in spans) for n in nodes]
    return np.concatenate(xs), np.array(ys, float)


@cache
def fit(samples: int = SAMPLES, seed: int = SEED) -> BoostedTrees:
    return BoostedTrees().fit(*labelled_nodes(samples, seed))


def chosen_nodes(text: str, model: BoostedTrees) -> list[Node]:
    return chosen_of([text], model)[0]


def chosen_of(texts: list[str], model: BoostedTrees) -> list[list[Node]]:
    """The markup nodes of each text, in order; all nodes of the texts are rated at once."""
    trees, rows = [], []
    for text in texts:
        nodes = candidates(text)
        roots = link_tree(nodes)
        trees.append((nodes, roots))
        if nodes:
            rows.append(features(text, nodes))
    odds = model.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes, roots in trees:
        for n in nodes:
            n.odds = float(odds[at])
            at += 1
        agree(nodes)
        decode(roots)
        out.append([n for n in nodes if n.chosen])
    return out


def kinds_of(nodes: list[Node]) -> list[str]:
    there = {n.kind for n in nodes}
    return [k for k in KINDS if k in there]


_HEADINGS, _BREAKS = frozenset("h1 h2 h3 h4 h5 h6 title caption".split()), frozenset("p div br tr table ul ol li dl dt dd section article header footer pre blockquote hr h1 h2 h3 h4 h5 h6 tbody thead center form".split())


#: Structures that elements are, elements whose content goes, and commands that stand for mathematics.
_ELEMENTS = {**{f"h{i}": "heading" for i in range(1, 7)}, "title": "heading", "ul": "list", "ol": "list", "dl": "list", "table": "table", "pre": "code", "code": "code", "kbd": "code", "samp": "code", "tt": "code"}
_SILENT = frozenset(("script", "style"))
_MATHS = frozenset("alpha beta cdot delta epsilon frac gamma geq infty int lambda ldots leq ln log mathbf mathcal mathrm mu omega operatorname partial pi prod sigma sqrt sum theta times vec".split())


def _replacement(text: str, n: Node) -> tuple[str, str | None, bool]:
    """(what stands for a node, the structure it is, whether its content is cleaned further)."""
    inner = text[n.inner[0] : n.inner[1]]
    match n.type:
        case "comment" | "doctype" | "fenceend" | "begin":
            return "", None, False
        case "tag":
            name = n.name.lower()
            return ("\n- " if name == "li" else "\t" if name in ("td", "th") else "\n" if name in _BREAKS else ""), None, False
        case "endtag":
            return ("\n" if n.name.lower() in _BREAKS - {"li"} else ""), None, False
        case "entity":
            return html.unescape(text[n.start : n.end]).replace("\xa0", " "), None, False
        case "atx" | "setext" | "wikihead":
            return inner, "heading", True
        case "strong" | "quotes":
            return inner, None, True
        case "link" | "image":
            return inner, None, True
        case "code" | "fence":
            return (inner.strip("\n") if n.type == "fence" else inner), "code", False
        case "pipetable":
            lines = [text[n.start : n.end].split("\n")[0], *inner.split("\n")]
            return "\n".join("\t".join(c.strip() for c in x.strip().strip("|").split("|")) for x in lines if x.strip()), "table", False
        case "bracetable":
            cells = [re.split(r"\|\||!!", x.lstrip("|!")) for x in inner.split("\n")[1:] if x.strip() and not x.startswith(("|-", "|+", "|}"))]
            return "\n".join("\t".join(c.strip() for c in row) for row in cells), "table", False
        case "wikilink":
            target, _, shown = inner.partition("|")
            return ("" if re.match(r"(?i)(category|file|image):", target) else shown or target), None, False
        case "template":
            return " ".join(p.partition("=")[2] or p for p in inner.split("|")[1:]), None, False
        case "environment":
            if re.match(r"(?:equation|align|math|gather|displaymath|eqnarray)", n.name):
                return inner.strip(), "formula", False
            if n.name in ("verbatim", "lstlisting"):
                return inner.strip("\n"), "code", False
            return re.sub(r"\\item\b *", "- ", inner).strip("\n"), "list" if n.name in ("itemize", "enumerate") else None, False
        case "display" | "inline" | "paren" | "cutinline":
            return inner.strip(), "formula", False
        case "command" | "cutcommand":
            name = n.name
            if name in ("cite", "label", "ref", "eqref", "bibliography", "usepackage", "documentclass", "noindent"):
                return "", None, False
            if name == "item":
                return "- ", None, False
            if name in _MATHS:
                return text[n.start : n.end], "formula", False
            shown = "".join(re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}?", inner if n.type == "command" else "{" + inner)) or ("" if inner or not n.name else "")
            return shown, "heading" if name.endswith(("section", "chapter")) else None, False
    return inner, None, True


def clean(text: str, nodes: list[Node]) -> tuple[str, list[tuple[str, int, int]]]:
    """(clean text, (structure, start, end) in it) of a text with its markup nodes."""
    for n in nodes:
        n.children, n.mate = [], None
    roots = link_tree(sorted((n for n in nodes if n.chosen), key=lambda n: (n.start, -n.end)))
    out: list[str] = []
    size = 0
    blocks: list[tuple[str, int, int]] = []
    opened: dict[int, int] = {}

    def put(s: str) -> None:
        nonlocal size
        out.append(s)
        size += len(s)

    def walk(lo: int, hi: int, inside: list[Node]) -> None:
        at = lo
        for n in inside:
            if n.start < at or n.end > hi:
                continue
            put(text[at : n.start])
            name = n.name.lower() if n.type in ("tag", "endtag") else ""
            if n.type == "tag" and name in _SILENT:
                at = n.mate.start if n.mate is not None and n.mate.chosen else n.end
                continue
            if n.type == "endtag" and id(n.mate) in opened:
                begin = opened.pop(id(n.mate))
                if size > begin:
                    blocks.append((_ELEMENTS[name], begin, size))
            shown, structure, deeper = _replacement(text, n)
            begin = size
            if deeper:
                walk(*n.inner, n.children)
            else:
                put(shown)
            if structure and size > begin:
                blocks.append((structure, begin, size))
            if n.type == "tag" and name in _ELEMENTS and n.mate is not None:
                opened[id(n)] = size
            at = n.end
        put(text[at:hi])

    walk(0, len(text), roots)
    return "".join(out), sorted(blocks, key=lambda b: (b[1], -b[2]))


def _parse(shared: Broadcast, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for lo in range(0, len(texts), 500):
                part = texts[lo : lo + 500]
                nodes = chosen_of([t or "" for t in part], model)
                columns = [batch.column(i).slice(lo, len(part)) for i in range(3)] + [pa.array([kinds_of(n) for n in nodes], pa.list_(pa.string()))]
                names = ["origin", "record_id", "pos", "kinds"]
                if with_text:
                    done = [(t, []) if t is None else clean(t, n) for t, n in zip(part, nodes)]
                    columns += [pa.array([d[0] for d in done], pa.string()), pa.array([[dict(zip(("structure", "start", "end"), b)) for b in d[1]] for d in done], _BLOCKS)]
                    names += ["text", "blocks"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_BLOCKS = pa.list_(pa.struct([("structure", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_KEYS = "origin string, record_id string, pos int, kinds array<string>"
_CLEAN = _KEYS + ", text string, blocks array<struct<structure: string, start: int, end: int>>"


def texts_of(chunks: DataFrame, golden: DataFrame) -> DataFrame:
    """origin, record_id, pos, text of all chunk contents and context texts; NULL elements keep their place."""
    a = chunks.select(F.lit("chunk").alias("origin"), F.col("id").cast("string").alias("record_id"), F.lit(0).alias("pos"), F.col("content").cast("string").alias("text"))
    b = golden.select(F.lit("context").alias("origin"), F.col("id").cast("string").alias("record_id"), F.posexplode("context_chunks").alias("pos", "c"))
    return a.unionByName(b.select("origin", "record_id", "pos", F.col("c.text").alias("text")))


def found(texts: DataFrame) -> DataFrame:
    """origin, record_id, pos, kind: one row per kind of markup in a text."""
    model = texts.sparkSession.sparkContext.broadcast(fit())
    parsed = texts.where(F.col("text").rlike(ANY)).mapInArrow(_parse(model, False), _KEYS)
    return parsed.select("origin", "record_id", "pos", F.explode("kinds").alias("kind")).distinct()


def cleaned(texts: DataFrame) -> DataFrame:
    """origin, record_id, pos, kinds, text (clean), blocks of every row."""
    model = texts.sparkSession.sparkContext.broadcast(fit())
    marked = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    parsed = texts.where(marked).mapInArrow(_parse(model, True), _CLEAN)
    plain = texts.where(~marked).select("origin", "record_id", "pos", F.array().cast("array<string>").alias("kinds"), "text", F.array().cast("array<struct<structure: string, start: int, end: int>>").alias("blocks"))
    return parsed.unionByName(plain)
