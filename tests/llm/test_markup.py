import random
import time

import pytest

from loomspan.llm import markup as M
from loomspan.llm import markup_nodes as N
from loomspan.llm.markup_samples import sample


@pytest.fixture(scope="module")
def model():
    return M.fit()


def test_held_out_accuracy(model):
    r = random.Random(2024)
    texts = [sample(r) for _ in range(600)]
    wrong = sum(set(M.kinds_of(n)) != {k for k, _, _ in spans} for (_, spans), n in zip(texts, M.chosen_of([t for t, _ in texts], model)))
    assert wrong / len(texts) < 0.05


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Costs $5 to $9, then $12.", []), ("see [1] [2] and {name} or C:\\data\\import_3", []), ("1 < 2 and 3 > 2, R&D", []), ("- a\n- b\n1. c", []), ("", []),
        ("a <b>x</b> &amp; y", ["html"]), ("## Title\n\ntext", ["markdown"]), ("use `kb sync` now", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("| a | b |", []),
        ("== Title ==\n[[link|text]]", ["wiki"]), ("'''bold''' and {{Infobox|a=b}}", ["wiki"]), ("\\textbf{x} and $x_1 = 2$", ["latex"]), ("\\begin{equation}\nE = 3", ["latex"]), ("x\n```python\nf(1)\n```\n", ["markdown"]), ("rest</td></tr></tbody>", ["html"]),
    ],
)
def test_kinds(model, text, kinds):
    assert M.kinds_of(M.chosen_nodes(text, model)) == kinds


def test_clean_keeps_structure(model):
    text = "# Title\n\nSome **bold** [link](/a.md) &amp; `code`.\n\n```py\nx = '**a**'\n```\n\n<ul>\n<li>one</li>\n</ul>\n\n\\(n = 2^{3}\\)"
    out, blocks = M.clean(text, M.chosen_nodes(text, model))
    assert "Title" in out and "Some bold link & code." in out and "x = '**a**'" in out and "- one" in out and "n = 2^{3}" in out
    assert "<" not in out and "**bold**" not in out
    assert {"heading", "code", "formula"} <= {b[0] for b in blocks} and all(0 <= a < z <= len(out) for _, a, z in blocks)

def test_elements_are_a_tree(model):
    text = '<div class="a"><ul><li>one</li><li>two <b>x</b></li></ul></div> <p>open'
    nodes = N.candidates(text)
    N.link_tree(nodes)
    tags = [n for n in nodes if n.type == "tag"]
    assert [(n.name, n.level, n.mate is not None) for n in tags] == [("div", 0, True), ("ul", 1, True), ("li", 2, True), ("li", 2, True), ("b", 3, True), ("p", 0, False)]
    assert tags[0].density > tags[3].density > tags[4].density == 0
    assert {n.chosen for n in M.chosen_nodes(text, model)} == {True} and len(M.chosen_nodes(text, model)) == 11


def test_clean_html(model):
    text = "<h2>Title here</h2><p>Some words <b>bold</b>.</p><ul><li>one</li><li>two</li></ul><pre><code>x = 1\n  y()</code></pre><script>var a = '<b>';</script><style>p {color: red}</style><table><tr><td>a</td><td>b</td></tr></table> end"
    out, blocks = M.clean(text, M.chosen_nodes(text, model))
    assert {"heading", "list", "code", "table"} <= {b[0] for b in blocks}
    assert [out[a:z].strip() for s, a, z in blocks if s == "heading"] == ["Title here"] and any(out[a:z] == "x = 1\n  y()" for s, a, z in blocks if s == "code")
    assert "var a" not in out and "color" not in out and "a\tb" in out and "- one" in out and out.endswith("end")


def test_bare_formulas_and_many_environments(model):
    text = "so \\frac{a}{b} \\leq \\sqrt{c} holds"
    assert M.clean(text, M.chosen_nodes(text, model))[0] == text
    began = time.time()
    N.candidates("\\begin{a}" * 8000)
    assert time.time() - began < 2


def test_long_formulas(model):
    body = " + ".join(f"\\frac{{a_{{{k}}}}}{{b_{{{k}}}^2}}" for k in range(40))
    for text in (f"We have $x = {body}$ in all.", f"We have $x = {body}"):
        nodes = M.chosen_nodes(text, model)
        assert any(n.type in ("inline", "cutinline") for n in nodes) and M.kinds_of(nodes) == ["latex"]
        out, blocks = M.clean(text, nodes)
        assert "\\frac{a_{0}}{b_{0}^2}" in out and "formula" in {b[0] for b in blocks}


def test_opaque_nodes_take_what_is_inside(model):
    chosen = M.chosen_nodes("```\n<b>x</b> [[y]]\n```\n", model)
    assert {n.type for n in chosen} == {"fence"}


def test_tables(spark):
    chunks = spark.createDataFrame([("a", "<b>x</b> text here", "k"), ("a", "<b>x</b> text here", "k"), ("b", None, "k"), ("c", "plain", "k")], "id string, content string, kind string")
    golden = spark.createDataFrame([("q", [("x", None), (None, None), ("**bold words** here", "s")], "k"), ("r", None, "k"), ("s", [], "k")], "id string, context_chunks array<struct<text: string, source: string>>, pos string")
    texts = M.texts_of(chunks, golden)
    assert {tuple(r) for r in M.found(texts).collect()} == {("chunk", "a", 0, "html"), ("context", "q", 2, "markdown")}
    out = M.cleaned(texts).collect()
    assert len(out) == 7 and {r["text"] for r in out if r["record_id"] == "a"} == {"x text here"} and sum(r["text"] is None for r in out) == 2
    assert M.found(texts.where("false")).count() == 0
