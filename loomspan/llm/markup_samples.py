"""Synthetic texts with known markup and with text that only looks like it, for fitting."""

from __future__ import annotations

import random
from collections.abc import Callable

_SYLLABLES = "ba de fi go lu mar nes tor vik sa ren po kel dri am ol".split()
_SCRIPTS = ("latin", "latin", "latin", "cyrillic", "han", "kana")


class _Words:
    def __init__(self, r: random.Random) -> None:
        self.r, self.script = r, r.choice(_SCRIPTS)

    def word(self) -> str:
        r = self.r
        if self.script == "latin":
            w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
            return w.capitalize() if r.random() < 0.2 else w
        low, high = {"cyrillic": (0x430, 0x44F), "han": (0x4E00, 0x9F00), "kana": (0x3042, 0x3093)}[self.script]
        return "".join(chr(r.randint(low, high)) for _ in range(r.randint(2, 6)))

    def phrase(self, lo: int = 1, hi: int = 5) -> str:
        return ("" if self.script in ("han", "kana") else " ").join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self) -> str:
        return self.phrase(4, 12) + ("。" if self.script in ("han", "kana") else self.r.choice(". . . ! ?".split()))


def _html(w: _Words) -> str:
    r, p = w.r, w.phrase
    tag = r.choice("b i em strong span div p li td th code h2 h4 sup small font".split())
    attr = r.choice(["", "", ' class="x"', " id=a1", ' style="color:red"', " align=left"])
    return r.choice([
        lambda: f"<{tag}{attr}>{p()}</{tag}>", lambda: f"<!-- {p()} -->", lambda: f"{p()}<br>{p()}<br/>", lambda: f"<ul>\n<li>{p()}</li>\n<li>{p()}</li>\n</ul>",
        lambda: f'<a href="/{r.randint(1, 99)}/x" target=_blank>{p()}</a>', lambda: f"{p()}&nbsp;&amp;&nbsp;{p()} &#{r.randint(33, 9999)};", lambda: f"{p()}</td></tr></table>", lambda: f"&lt;{p()}&gt; &quot;{p()}&quot;",
        lambda: f"<PRE><CODE>{w.word()} = {r.randint(1, 9)}\n{w.word()}()</CODE></PRE>", lambda: f"<table><tr><td>{p()}</td><td>{r.randint(1, 99)}</td></tr>\n<tr><td>{p()}</td>", lambda: f'<img src="{w.word()}.png" alt="{p()}">',
        lambda: f"<h{r.randint(1, 6)}>{p()}</h{r.randint(1, 6)}>\n<p>{w.sentence()}</p>", lambda: f"</{tag}>", lambda: f"<hr>\n{p()}", lambda: f"<div{attr}>\n<p>{w.sentence()}", lambda: f"{p()} &mdash; {p()}",
    ])()


def _markdown(w: _Words) -> str:
    r, p = w.r, w.phrase
    return r.choice([
        lambda: f"\n{'#' * r.randint(1, 6)} {p()}\n", lambda: f"\n{p()}\n{r.choice('=-') * r.randint(3, 15)}\n", lambda: f"**{p()}**", lambda: f"__{p()}__", lambda: f"[{p()}](/kb/{r.randint(1, 99)}.md)",
        lambda: f"[{p()}](https://{w.word()}.org)", lambda: f"![{p()}](img/f{r.randint(1, 9)}.png)", lambda: f"`{w.word()} --{w.word()} {r.randint(1, 9)}`", lambda: f"`{w.word()}()`",
        lambda: f"\n```{r.choice(['', 'python', 'sh', 'json'])}\n{w.word()}({r.randint(1, 9)})\nx = y[{r.randint(1, 9)}] ** 2\n```\n", lambda: f"\n| {p()} | {p()} |\n|---|:---:|\n| {r.randint(1, 99)} | {p()} |\n", lambda: f"\n{p()} | {p()}\n--- | ---\n{p()} | {r.randint(1, 9)}\n",
    ])()


def _wiki(w: _Words) -> str:
    r, p = w.r, w.phrase
    eq = "=" * r.randint(2, 5)
    return r.choice([
        lambda: f"\n{eq} {p()} {eq}\n", lambda: f"\n{eq}{p()}{eq}\n", lambda: f"[[{p()}]]", lambda: f"[[{p()}|{p()}]]", lambda: f"[[Category:{p()}]]", lambda: f"'''{p()}'''", lambda: f"''{p()}''",
        lambda: f"{{{{Infobox|{w.word()}={p()}|rev={r.randint(1, 99)}}}}}", lambda: f"{{{{{w.word()}}}}}", lambda: f'\n{{| class="wikitable"\n|-\n! {p()} !! {p()}\n|-\n| {r.randint(1, 99)} || {p()}\n|}}\n', lambda: f"\n{{|\n| {p()}\n|-\n| {p()}\n|}}\n",
    ])()


def _latex(w: _Words) -> str:
    r, p = w.r, w.phrase
    n = r.randint(1, 99)
    return r.choice([
        lambda: f"\\section{{{p()}}}", lambda: f"\\textbf{{{p()}}}", lambda: f"\\emph{{{p()}}} \\cite{{ref{n}}}", lambda: f"\\begin{{itemize}}\n\\item {p()}\n\\item {p()}\n\\end{{itemize}}", lambda: f"\\begin{{equation}}\nE_{n} = {n} \\cdot q\n",
        lambda: f"$$\\frac{{x_{n}}}{{{n}}} \\leq \\sum_i w_i$$", lambda: f"$$a^2 + b_{n} = {n}$$", lambda: f"$x_{n} = {n}$", lambda: f"$\\alpha + {n}$", lambda: f"$E = mc^2$", lambda: f"$n$", lambda: f"\\(n = {n}^{{2}}\\)",
        lambda: f"\\[ y_{n} = \\sqrt{{x}} \\]", lambda: f"\\label{{eq:{n}}}", lambda: f"\\ref{{fig{n}}}", lambda: f"\\begin{{equation}}\nx = {n}\n\\end{{equation}}", lambda: f"$f(x) = {n}x$",
    ])()


def _plain(w: _Words) -> str:
    r, p = w.r, w.phrase
    n, m = r.randint(1, 99), r.randint(1, 999)
    return r.choice([
        lambda: f"[{n}] [{n + 1}]", lambda: f"[{n}][{m}]", lambda: f"{{{w.word()}}}", lambda: f'{{"pct": {n}}}', lambda: f"{n} < {m} and {m} > {n}", lambda: f"x != {n} && y == {m}", lambda: f"C:\\{w.word()}\\{w.word()}_{n}",
        lambda: f"\\\\{w.word()}\\share\\{w.word()}", lambda: f"C:\\data\\import_{n} C:\\data\\import_{n}", lambda: "R&D", lambda: "AT&T", lambda: f"${n} to ${m}", lambda: f"${n}", lambda: f"${n},000 and ${m}.50", lambda: f"US${n} ... US${m}", lambda: f"list[{n}]", lambda: f"{n} * {m} * 2",
        lambda: f"- {n}\n- {m}", lambda: f"\n* {p()}\n* {p()}\n", lambda: f"\n1. {p()}\n2. {p()}\n", lambda: f"{w.word()}_size and max_{w.word()}_size", lambda: f"'{n}'", lambda: f"'{p()}'", lambda: f'"{p()}"', lambda: f"{n} = {m} - {m - n}",
        lambda: f"~{n} %", lambda: f"ticket #{n}", lambda: f"#{w.word()}", lambda: "C# and F#", lambda: f"/usr/{w.word()}/{w.word()}", lambda: f"{w.word()}[{n}]({m})", lambda: f"a <= b, c >= d, e -> f => {n}", lambda: f"x<{n} y>{m}",
        lambda: f"https://{w.word()}.org/?a={n}&b={m}", lambda: f"SELECT {w.word()} FROM t WHERE n > {n}", lambda: f"| {p()} | {p()}", lambda: f"{n} | {m} | 3", lambda: f"POST /api/v1/{w.word()}/{{id}}/x", lambda: f"2^{n}", lambda: f"{w.word()}=={w.word()}",
        lambda: f"({p()}) [{n}]", lambda: f"{p()} -- {p()}", lambda: f"{w.word()}__init__", lambda: f"{n}'{m}''", lambda: "<3 :-)", lambda: f"if (a && b) || !c", lambda: f"{n} & {m}", lambda: f"{{{n}}} {{x}}", lambda: f"\\{n} \\ {p()}", lambda: f"***", lambda: f"{w.word()}&{w.word()}={n}",
    ])()


MAKERS: dict[str, Callable[[_Words], str]] = {"html": _html, "markdown": _markdown, "wiki": _wiki, "latex": _latex}


def sample(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A text and its markup: (kind, start, end) of each snippet."""
    w = _Words(r)
    parts: list[tuple[str | None, str]] = []
    for _ in range(r.randint(1, 4)):
        x = r.random()
        if x < 0.5:
            kind = r.choice(list(MAKERS))
            parts.append((kind, MAKERS[kind](w)))
        elif x < 0.85:
            parts.extend((None, _plain(w)) for _ in range(r.randint(1, 3)))
        parts.extend((None, w.sentence()) for _ in range(r.randint(0, 3)))
    r.shuffle(parts) if r.random() < 0.5 else None
    text, spans = "", []
    for kind, s in parts:
        text += "" if not text or text[-1] == "\n" or s[:1] == "\n" else r.choice([" ", " ", " ", "\n", "\n\n"])
        if kind:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s
    if spans and r.random() < 0.25:  # cut off inside the last snippet, with some of it left
        kind, lo, hi = spans[-1]
        stripped = len(text[lo:hi]) - len(text[lo:hi].lstrip())
        at = lo + stripped + r.randint(min(4, hi - lo), max(4, hi - lo))
        if at < len(text):
            text = text[:at]
            spans = [(k, a, min(b, at)) for k, a, b in spans if a < at]
    return text, spans
