"""Candidate markup nodes of a text as a tree, and their features."""

from __future__ import annotations

import html.entities
import re
from dataclasses import dataclass, field

import numpy as np

KINDS = ("html", "markdown", "wiki", "latex")
# Names of elements and commands.
TAGS = frozenset(
    "a abbr address article aside b blockquote body br button caption center cite code col dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video".split()
)
COMMANDS = frozenset(
    "alpha begin beta bf bibliography caption cdot chapter cite color delta documentclass emph end epsilon eqref footnote frac gamma geq href include includegraphics infty int it item label lambda ldots left leq ln log mathbf mathcal mathrm mu newcommand noindent omega operatorname over paragraph partial pi prod quad ref right rm section sigma sqrt subsection subsubsection sum text textbf textit textsc texttt theta times title underline url usepackage vec".split()
)
VOID = frozenset("br hr img input link meta".split())
ATTRIBUTES = "class id style href src alt align target name width".split()
#: Node type: (kind, pattern, closing group or None, content group or None, opaque)
_S, _M = re.S, re.M
TYPES = {
    "comment": ("html", re.compile(r"<!--(?P<in>.*?)(?P<end>-->|\Z)", _S)),
    "doctype": ("html", re.compile(r"<!DOCTYPE[^<>]*(?P<end>>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?xml[^<>]*(?:\?>|\Z)", _S | re.I)),
    "tag": ("html", re.compile(r"<(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<in>(?:[\s/][^<>]*)?)(?P<end>>|\Z)")),
    "endtag": ("html", re.compile(r"</(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<in>)\s*(?P<end>>|\Z)")),
    "entity": ("html", re.compile(r"&(?P<name>#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31})(?P<end>;|\b)(?P<in>)")),
    "atx": ("markdown", re.compile(r"^ {0,3}(?P<name>#{1,6})[ \t]+(?P<in>\S[^\n]*?)[ \t]*(?P<end>$)", _M)),
    "setext": ("markdown", re.compile(r"^(?=[^\n]*[^\s|])(?P<in>[^\n]+)\n {0,3}(?P<name>={3,}|-{3,})[ \t\r]*(?P<end>$)", _M)),
    "strong": ("markdown", re.compile(r"(?P<name>\*\*|__)(?=[^\s*_])(?P<in>[^\n]*?[^\s*_])(?:(?P<end>(?P=name))|\*?\Z)")),
    "link": ("markdown", re.compile(r"(?<![!\[])\[(?P<in>[^\[\]\n]+)\]\((?P<name>[^()\n]*)(?P<end>\)|\Z)")),
    "image": ("markdown", re.compile(r"!\[(?P<in>[^\[\]\n]*)(?:\](?:\((?P<name>[^()\n]*)(?P<end>\)|\Z)|\Z)|\Z)")),
    "code": ("markdown", re.compile(r"(?<!`)(?P<name>`)(?P<in>[^`\n]+)(?:(?P<end>`(?!`))|\Z)")),
    "fence": ("markdown", re.compile(r"^[ \t]*(?P<fence>`{3,}|~{3,})(?P<name>[^\n`]*)(?:\n(?P<in>.*?)(?:(?P<end>^[ \t]*(?P=fence)[ \t\r]*$)|\Z)|\Z)", _S | _M)),
    "fenceend": ("markdown", re.compile(r"^[ \t]*(?P<name>```)[ \t\r]*(?P<end>$)(?P<in>)", _M)),
    "pipetable": ("markdown", re.compile(r"^(?=[^\n]*\|)[^\n]*\n[ \t]*(?P<name>\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?)[ \t\r]*(?P<end>$)(?P<in>(?:\n[^\n]*\|[^\n]*)*)", _M)),
    "wikihead": ("wiki", re.compile(r"^(?P<name>={2,6})[ \t]*(?P<in>[^=\s][^=\n]*?)[ \t]*(?:(?P<end>(?P=name))[ \t\r]*$|=*\Z)", _M)),
    "wikilink": ("wiki", re.compile(r"\[\[(?P<in>[^\[\]\n]+)(?:(?P<end>\]\])|\]?\Z)")),
    "quotes": ("wiki", re.compile(r"(?<!')(?P<name>'{2,5})(?=[^'\s])(?P<in>[^'\n]*(?:'[^'\n]+)*?)(?:(?P<end>(?P=name))|'*\Z)")),
    "template": ("wiki", re.compile(r"\{\{(?P<in>[^{}]+)(?:(?P<end>\}\})|\}?\Z)")),
    "bracetable": ("wiki", re.compile(r"^\{\|(?P<in>.*?)(?:(?P<end>^\|\})|\Z)", _S | _M)),
    "environment": ("latex", re.compile(r"\\(?P<side>begin|end)\{(?P<name>[a-zA-Z]+\*?)\}")),  # its two sides are paired
    "begin": ("latex", re.compile(r"\\(?:begin|end)\{?(?P<name>[a-zA-Z]*\*?)(?:(?P<end>\})|\Z)(?P<in>)")),
    "command": ("latex", re.compile(r"\\(?P<name>[a-zA-Z]+)\*?(?P<in>(?:\[[^\[\]\n]*\])?(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})*)(?P<end>)")),
    "cutcommand": ("latex", re.compile(r"\\(?P<name>[a-zA-Z]+)\{(?P<in>[^{}\n]*)\Z")),
    "display": ("latex", re.compile(r"\$\$(?P<in>[^$]+)(?:(?P<end>\$\$)|\$?\Z)")),
    "inline": ("latex", re.compile(r"(?<![\\$])\$(?=(?P<in>[^$\n]+)(?P<end>\$)(?!\$))")),
    "cutinline": ("latex", re.compile(r"(?<![\\$])\$(?P<in>[^$\n]+)\Z")),
    "paren": ("latex", re.compile(r"\\(?P<name>[(\[])(?P<in>.+?)(?:(?P<end>\\[)\]])|\Z)", _S)),
}
OPAQUE = frozenset({"comment", "code", "fence", "display", "inline", "paren", "template"})
_NUMBER = {t: i for i, t in enumerate(TYPES)}
#: A text without any of these has no candidate.
ANY = r"<[!/?A-Za-z]|&[#A-Za-z]|`|\*\*|__|\]\(|!\[|\[\[|\{\{|\{\||''|\\[A-Za-z(\[]|\$|(?m:^ {0,3}#{1,6}[ \t])|(?m:^ {0,3}(?:={2,}|-{3,}))|(?m:^[ \t]*[|:]?[ |:]*-{3,})|~~~"


@dataclass
class Node:
    type: str
    start: int
    end: int
    inner: tuple[int, int]
    name: str
    closed: bool
    children: list["Node"] = field(default_factory=list)
    depth: int = 0
    parent: "Node | None" = None
    odds: float = 0.0
    chosen: bool = False
    mate: "Node | None" = None  # the other tag of an element
    level: int = 0  # elements around a tag
    beside: int = 0  # tags in the same element
    density: float = 0.0  # share of tags in an element's text

    @property
    def kind(self) -> str:
        return TYPES[self.type][0]


def environments(text: str) -> list[Node]:
    """Environments from each begin to the end of its name; in one pass, whatever is left open."""
    out: list[Node] = []
    open_: dict[str, list[tuple[int, int]]] = {}
    for m in TYPES["environment"][1].finditer(text):
        if m["side"] == "begin":
            open_.setdefault(m["name"], []).append(m.span())
        elif open_.get(m["name"]):
            start, inner = open_[m["name"]].pop()
            out.append(Node("environment", start, m.end(), (inner, m.start()), m["name"], True))
    return out


def candidates(text: str) -> list[Node]:
    out = environments(text)
    for name, (_, pattern) in TYPES.items():
        if name == "environment":
            continue
        for m in pattern.finditer(text):
            g = m.groupdict()
            lo, hi = m.span("in") if g.get("in") is not None else (m.end(), m.end())
            end = m.end("end") if name == "inline" else m.end()
            if end > m.start():
                out.append(Node(name, m.start(), end, (lo, hi), g.get("name") or "", bool(g.get("end")) or (g.get("end") == "" and name != "entity")))
    out.sort(key=lambda n: (n.start, -n.end, _NUMBER[n.type]))
    return out


def link_tree(nodes: list[Node]) -> list[Node]:
    """Make each node a child of the smallest node around it; the roots come back."""
    roots: list[Node] = []
    stack: list[Node] = []
    for n in nodes:
        while stack and not (stack[-1].start <= n.start and n.end <= stack[-1].end):
            stack.pop()
        n.parent, n.depth = (stack[-1], stack[-1].depth + 1) if stack else (None, 0)
        (stack[-1].children if stack else roots).append(n)
        stack.append(n)
    pair_tags(nodes)
    return roots


def pair_tags(nodes: list[Node]) -> None:
    """Give each tag its place in the tree of elements: its mate, the elements around it, the tags beside it, its element's density.

    An end tag closes the last open element of its name; elements open inside of that one end with it.
    """
    tags = [n for n in nodes if n.type in ("tag", "endtag")]
    open_: list[tuple[Node, int]] = []
    count: dict[str, int] = {}
    inside: dict[int, list[Node]] = {}
    covered = np.concatenate([[0], np.cumsum([n.end - n.start for n in tags])])
    for i, n in enumerate(tags):
        name = n.name.lower()
        if n.type == "endtag" and count.get(name):
            while True:
                other, at = open_.pop()
                count[other.name.lower()] -= 1
                if other.name.lower() == name:
                    break
            n.mate, other.mate = other, n
            n.level, n.density = other.level, float(covered[i] - covered[at + 1]) / max(1, n.start - other.end)
            other.density = n.density
        else:
            n.level = len(open_)
        inside.setdefault(id(open_[-1][0]) if open_ else 0, []).append(n)
        if n.type == "tag" and name not in VOID:
            open_.append((n, i))
            count[name] = count.get(name, 0) + 1
    for group in inside.values():
        for n in group:
            n.beside = len(group) - 1


_WORD, _OPS, _ATTR = re.compile(r"\w"), re.compile(r"[\\^_={}+<>]"), re.compile(r"[\w:-]+\s*=")
_URL = re.compile(r"^(?:https?:|/|\.|#|\w+/)|\.\w{2,4}$")


def features(text: str, nodes: list[Node]) -> np.ndarray:
    """One row a node: its type and syntax, its content, and its place in the tree."""
    rows = np.zeros((len(nodes), len(_NUMBER) + 33 + len(ATTRIBUTES)), np.float32)
    n_text = len(text)
    by_kind = {k: sum(n.kind == k for n in nodes) for k in KINDS}
    by_type: dict[str, int] = {}
    for n in nodes:
        by_type[n.type] = by_type.get(n.type, 0) + 1
    for i, n in enumerate(nodes):
        content = text[n.inner[0] : n.inner[1]]
        size = max(1, len(content))
        words = len(_WORD.findall(content))
        digits = sum(c.isdigit() for c in content)
        before, after = text[n.start - 1 : n.start], text[n.end : n.end + 1]
        siblings = n.parent.children if n.parent else None
        name = n.name.lower()
        rows[i, _NUMBER[n.type]] = 1
        named = {a.rstrip("= \t\n").lower() for a in _ATTR.findall(content)} if n.type == "tag" else set()
        rows[i, -5 - len(ATTRIBUTES) :] = (n.mate is not None, min(9, n.level), min(9, n.beside), min(2.0, n.density), len(named), *(a in named for a in ATTRIBUTES))
        rows[i, len(_NUMBER) : len(_NUMBER) + 28] = (
            n.closed, n.end >= n_text, n.start == 0, np.log1p(n.end - n.start), np.log1p(len(content)), words / size, digits / size, content.count(" ") / size,
            "\n" in content, content[:1].isspace(), content[-1:].isspace(), content[:1].isdigit(), len(_OPS.findall(content)), len(_ATTR.findall(content)), min(3, content.count("|")),
            name in TAGS or name in COMMANDS or f"{n.name};" in html.entities.html5 or name.startswith("#") and n.type == "entity", bool(_URL.search(n.name)), len(n.name),
            bool(before) and (before.isalnum() or before in ":_\\."), before in ("", "\n"), after in ("", "\n", "\r"), after in ("\\", "/", "_") or after.isdigit(),
            n.parent is not None and n.parent.type in OPAQUE and n.parent.closed and n.parent.kind != n.kind,
            n.depth, sum(c.end - c.start for c in n.children) / max(1, n.end - n.start), min(9, len(siblings)) if siblings else 0, min(9, by_kind[n.kind]), min(9, by_type[n.type]),
        )
    return rows


def agree(nodes: list[Node]) -> None:
    """The two tags of an element are one choice: both get their mean log odds."""
    for n in nodes:
        if n.mate is not None and n.type == "tag":
            n.odds = n.mate.odds = (n.odds + n.mate.odds) / 2


def decode(roots: list[Node]) -> float:
    """Choose the nodes of the best total log odds: a chosen opaque node takes all below it, and of overlapping siblings the better stays.

    A closed opaque node is also chosen where it is surer than any single node below it: what it holds is its text.
    """
    total = 0.0
    for n in roots:
        below = decode(n.children)
        take = n.odds + (_same_kind(n.children, n.kind) if n.type in OPAQUE else below)
        if n.odds > 0 and (take >= below or (n.type in OPAQUE and n.closed and n.odds >= _strongest(n.children, n.kind))):
            n.chosen = True
            if n.type in OPAQUE:
                _clear(n.children)
            total += take
        else:
            n.chosen = False
            total += below
    last: Node | None = None
    for n in roots:
        if n.chosen:
            if last is not None and n.start < last.end:
                worse = n if n.odds <= last.odds else last
                worse.chosen = False
                if worse is last:
                    last = n
                continue
            last = n
    return total


def _strongest(nodes: list[Node], kind: str) -> float:
    """The best log odds among nodes below of another kind than ``kind``."""
    return max((max(n.odds if n.kind != kind else 0.0, _strongest(n.children, kind)) for n in nodes), default=0.0)


def _same_kind(nodes: list[Node], kind: str) -> float:
    """What nodes below say for an opaque node of their own kind."""
    return sum((max(0.0, n.odds) if n.kind == kind else 0.0) + _same_kind(n.children, kind) for n in nodes)


def _clear(nodes: list[Node]) -> None:
    for n in nodes:
        n.chosen = False
        _clear(n.children)
