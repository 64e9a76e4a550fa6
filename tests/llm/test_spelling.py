import pytest

from spanweave.llm.unicode_forms import canonical, canonical_column, lookalike_rows


@pytest.mark.parametrize(("given", "usual"), [
    ("K", "K"), ("Ω", "Ω"), ("\U0001d400bc", "Abc"), ("क़", "क़"), ("ொ", "ொ"),
    ("wоrd", "word"), ("ᎪBC", "ABC"), ("Henry Ⅳ", "Henry IV"), ("a b", "a b"), ("é", "é"), ("zero​width", "zerowidth"),
    ("ｆｕｌｌ１", "full1"), ("", ""), (None, None),
    # not cases: whole words in another script, raised digits, Telugu digits, curly quotes, line breaks
    ("Москва", "Москва"), ("x²", "x²"), ("౧౨", "౧౨"), ("“so”", "“so”"), ("a\n\n b", "a\n\n b"), ("日本のカナ", "日本のカナ"),
])
def test_usual_spelling(given, usual):
    assert canonical(given) == usual
    assert canonical(canonical(given)) == canonical(given)


def test_whole_word_is_decided_by_its_text():
    assert canonical("сосо") == "сосо"  # Cyrillic, looks like coco
    assert canonical("coco and сосо") == "coco and coco"


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, "wоrd", "x"), (4, "wоrd", "x"), (5, "నది", "x")], "id int, text string, canonical2 string")
    assert sorted((r["id"], r["canonical"]) for r in lookalike_rows(df, "text", "id").collect()) == [(4, "word"), (4, "word")]
    assert [r["out"] for r in canonical_column(df, "text", "out").orderBy("id").collect()] == [None, "", "plain", "word", "word", "నది"]
    assert lookalike_rows(df.where("false"), "text", "id").count() == 0
