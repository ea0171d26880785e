import pytest

from loomspan.llm import languages as L

TEXTS = {
    "en": "The committee will review the report before the meeting starts, and everyone who works there should read it carefully.",
    "de": "Der Ausschuss prüft den Bericht, bevor die Sitzung beginnt, und alle, die dort arbeiten, sollten ihn sorgfältig lesen.",
    "fr": "Le comité examine le rapport avant la réunion et tous ceux qui travaillent dans le service doivent le lire avec soin.",
    "es": "El comité revisa el informe antes de la reunión y todos los que trabajan en la oficina deben leerlo con cuidado.",
    "pt": "A comissão analisa o relatório antes da reunião e todos os que trabalham no escritório não devem deixar de o ler.",
    "ru": "Комитет проверяет отчёт до начала собрания, и все, кто там работает, должны внимательно его прочитать.",
    "ja": "委員会は会議が始まる前に報告書を確認しますので、そこで働いている人はみな注意して読んでください。",
    "zh": "委员会在会议开始之前审查这份报告，在那里工作的每一个人都应该仔细阅读它的内容。",
}


def schema_rows(rows):
    return [(i, t, lang, "x") for i, (t, lang) in enumerate(rows)]


def test_function_words_alone_tell_languages():
    profiles = L.fit_profiles({})
    near = L.document_distances(list(TEXTS.values()), profiles).argmin(axis=1)
    assert [L.LANGS[i] for i in near] == list(TEXTS)


@pytest.mark.parametrize(("label", "code"), [("en-US", "en"), ("zh_Hans", "zh"), ("GERMAN", "de"), (" fra ", "fr"), ("Portuguese", "pt"), ("it", "other"), ("Klingon", "other"), ("und", None), ("", None), (None, None), ("n/a", None), ("Unknown", None), ("?", None)])
def test_labels(spark, label, code):
    df = spark.createDataFrame([(label,)], "lang string")
    assert df.select(L.label_language(df["lang"])).first()[0] == code


def test_defects(spark):
    rows = [
        (TEXTS["en"], "en_GB"), (TEXTS["en"], "de"), (TEXTS["de"], None), (TEXTS["zh"] * 3 + "\n" + TEXTS["ru"], "zh"), (None, "en"), ("", None), ("123 +/-", "xx"), (TEXTS["ja"], "Italian"),
        (TEXTS["zh"] + "\nSELECT id FROM t WHERE n > 5\nPOST /api/v1/x/{id}\nchunk_size=3 overlap=2", "zh"), (TEXTS["ru"] + " Комитет Zelkabrin проверяет отчёт Fankladu.", "ru"),
    ]
    df = spark.createDataFrame(schema_rows(rows), "doc_id bigint, text string, lang string, language string")
    got = {tuple(r) for r in L.label_defects(L.document_languages(df)).collect()}
    assert got == {(1, "wrong", "en"), (2, "missing", "de"), (3, "mixed", "zh"), (3, "mixed", "ru"), (7, "wrong", "ja")}


def test_segments_cover_the_text(spark):
    text = TEXTS["en"] + "\n" + TEXTS["ja"] + "\n" + TEXTS["en"]
    df = spark.createDataFrame([(1, text, "en", "x"), (2, None, None, "x")], "doc_id bigint, text string, lang string, language string")
    got = sorted(L.language_segments(df, L.fit_profiles({})).collect(), key=lambda r: r["start"])
    assert [r["language"] for r in got] == ["en", "ja", "en"] and all(0 <= r["confidence"] <= 1 for r in got)
    assert got[0]["start"] == 0 and got[-1]["end"] == len(text)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.label_defects(L.document_languages(df)).count() == 0 and L.language_segments(df).count() == 0
    long = spark.createDataFrame([(1, TEXTS["es"] * 20_000, "pt")], "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in L.label_defects(L.document_languages(long)).collect()] == [(1, "wrong", "es")]


def test_short_and_quoted_sentences(spark):
    en = TEXTS["en"] + " " + TEXTS["en"]
    rows = [(en + " Das stimmt nicht. " + en, "en"), (en + " “Der Bericht wurde gestern geprüft.” " + en, "en"), (en + " Bitte schreiben Sie an post@beispiel.de für den Bericht. " + en, "en"), (en + " Pri…se en main\n" + en, "en")]
    df = spark.createDataFrame(schema_rows(rows), "doc_id bigint, text string, lang string, language string")
    got = {tuple(r) for r in L.label_defects(L.document_languages(df, L.fit_profiles({}))).collect()}
    assert got == {(i, "mixed", c) for i in range(3) for c in ("de", "en")}


def test_labels_without_profile_are_trusted_unless_the_text_is_sure(spark):
    rows = [(1, "fr", ["fr"], 0.2, "it"), (2, "fr", ["fr"], 0.9, "it"), (3, "fr", ["fr"], 0.2, "de"), (4, "fr", ["fr"], 0.2, "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, language string, languages array<string>, confidence double, label string")
    assert {tuple(r) for r in L.label_defects(df).collect()} == {(2, "wrong", "fr"), (3, "wrong", "fr")}
