import random

import pytest

from loomspan.llm import pairs as P
from loomspan.llm.languages import FUNCTION_WORDS, LANGS


def clean(seed, n):
    """Pairs of made-up sentences out of function words and names."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        lang = r.choice(LANGS)
        words = FUNCTION_WORDS[lang].split()
        wide = lang not in ("ja", "zh")

        def sentence(end, words=words, wide=wide):
            name = "".join(r.choice(["ba", "dor", "kel", "min", "sa", "tru"]) for _ in range(3)).capitalize()
            parts = [*r.choices(words, k=r.randint(7, 12)), name, *r.choices(words, k=3)]
            return (" ".join(parts).capitalize() if wide else "".join(parts)) + end

        dot = "." if wide else "。"
        out.append((sentence("?" if wide else "？"), (" " if wide else "").join(sentence(dot) for _ in range(r.randint(1, 3)))))
    return out


@pytest.fixture(scope="module")
def model():
    return P.fit_model(clean(1, 1500))


def test_held_out_defects(model):
    rows, y = P.synthesise(P.clean_pairs(clean(2, 500)), seed=3)
    said = P.classify(rows, model)
    for k, defect in enumerate(P.DEFECTS):
        tp = sum(d == defect and y[i, k] > 0 for i, (d, _) in enumerate(said))
        fp = sum(d == defect and y[i, k] == 0 for i, (d, _) in enumerate(said))
        fn = int(y[:, k].sum()) - tp
        assert tp / max(1, tp + fp) > 0.9 and tp / max(1, tp + fn) > 0.9, defect


def test_single_answers(model):
    q = "How does the night shift handle the delivery note?"
    good = "The night shift stores the delivery note in the archive and sends a copy to the office."
    cases = {
        None: "empty", "": "empty", "　": "empty", "N/A": "empty", "...": "empty", q: "copy", f'"{q}"': "copy", f"{q} {good}": None, good: None, good + " [1][2]": None, "42 %": None, "2024-05-01": None,
        good[:50]: "truncated", good + "\n```\nGET /a": "truncated", good + "\n```\nGET /a\n```": None, "I'm sorry, but I can't help with that request.": "refusal", "Die Nachtschicht legt den Lieferschein in das Archiv und sendet eine Kopie an das Büro.": "language",
    }
    said = P.classify([(q, a) for a in cases], model)
    assert {a: d for a, (d, _) in zip(cases, said)} == cases


def test_asked_language(model):
    assert P.asked_language("Why is it so? Please answer in German.") == "de" and P.asked_language("如何处理？请用法语回答。") == "fr" and P.asked_language("How do I learn German?") is None
    said = P.classify([("Why does the shift store the note? Please answer in German.", "Die Nachtschicht legt den Lieferschein in das Archiv und sendet eine Kopie an das Büro.")], model)
    assert said[0][0] != "language"


def test_tables(spark, model):
    golden = spark.createDataFrame([("q1", "What is it?", None, "k"), ("q1", "What is it?", None, "k"), ("q2", None, None, "k")], "id string, question string, golden_answer string, defect string")
    results = spark.createDataFrame([("r1", None, "n/a", "k"), (None, None, None, "k")], "result_id string, question string, answer string, origin string")
    got = {tuple(r)[:3] for r in P.pair_defects(P.all_pairs(golden, results), model).collect()}
    assert got == {("golden", "q1", "empty"), ("golden", "q2", "empty"), ("eval", "r1", "empty"), ("eval", None, "empty")}
    assert P.pair_defects(P.all_pairs(golden.where("false"), results.where("false")), model).count() == 0


def test_training_on_an_empty_table(spark):
    rows = spark.createDataFrame([], "origin string, pair_id string, question string, answer string")
    assert P.classify([("What is it?", None)], P.train(rows))[0][0] == "empty"


def test_bounds_of_the_sentence_model_are_named():
    from loomspan.llm import pairs

    assert (pairs.CONTENT_SENTENCES, pairs.QUESTION_SENTENCES) == (2600, 300)
    assert "CONTENT_SENTENCES" in pairs.fit_sentences.__doc__
