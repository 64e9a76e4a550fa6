import random
import re
import unicodedata

from pyspark.sql import functions as F

from spanweave.functions import text as tx
from spanweave.functions.lexicon import Lexicon
from spanweave.functions.similarity import indel_ratio, lcs_length, token_set_ratio, token_sort_ratio


def texts():
    rng = random.Random(5)
    parts = ["the", "A", "an", "x-y", "చైనాలో", "క్షామం", "naïve", "a_b", "12", "!", " ", "‌", "😀", "  ", "\t", "\n", "The-x", "'s", "²"]
    return ["", " ", "the-x", "a a a"] + [rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(150)]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", expr(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def py_punct_first(s):
    s = re.sub(r"[^\w\s]", "", s.lower())
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def py_articles_first(s):
    return " ".join(re.sub(r"[^\w\s]", "", re.sub(r"\b(a|an|the)\b", " ", s.lower())).split())


def py_script(s):
    return " ".join(re.sub(r"[^ఀ-౿a-zA-Z0-9\s]", "", s).lower().split())


def test_normalizers_match_python(spark):
    data = texts()
    assert column(spark, data, tx.normalize_punctuation_first) == [py_punct_first(s) for s in data]
    assert column(spark, data, tx.normalize_articles_first) == [py_articles_first(s) for s in data]
    assert column(spark, data, tx.normalize_script) == [py_script(s) for s in data]
    assert column(spark, data, tx.squeeze) == [" ".join(s.split()) for s in data]
    assert column(spark, data, tx.tokens) == [s.split() for s in data]


def test_the_two_orders_differ(spark):
    assert column(spark, ["the-x"], tx.normalize_punctuation_first) == ["thex"]
    assert column(spark, ["the-x"], tx.normalize_articles_first) == ["x"]


def test_nulls(spark):
    assert column(spark, [None], tx.normalize_script) == [""]
    assert column(spark, [None], tx.squeeze) == [None]
    assert column(spark, [None], tx.clean_prediction) == [""]
    assert column(spark, [None], tx.has_script) == [False]


def test_find_all_overlapping(spark):
    rng = random.Random(3)
    pairs = [("aaaa", "aa"), ("", "a"), ("abc", ""), ("😀a😀a", "a"), ("x.y.x.", "."), ("ababa", "aba"), ("a\\Eb", "\\E"), ("abc", "abcd"), (None, "a"), ("a", None)]
    pairs += [("".join(rng.choices("ab", k=12)), "".join(rng.choices("ab", k=rng.randint(1, 3)))) for _ in range(80)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t string, a string")
    got = {r["i"]: r["y"] for r in rows.select("i", tx.find_all(F.col("t"), F.col("a")).alias("y")).collect()}
    for i, (t, a) in enumerate(pairs):
        want = [k for k in range(len(t) - len(a) + 1) if t[k : k + len(a)] == a] if t and a else []
        assert got[i] == want, (t, a)


def test_word_boundary(spark):
    cases = [("one two three", p) for p in range(14)] + [("", 0), ("nowhere", 3)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, p int")
    got = rows.select("i", tx.word_boundary(F.col("t"), F.col("p"), True).alias("f"), tx.word_boundary(F.col("t"), F.col("p"), False).alias("b")).collect()
    for r in got:
        t, p = cases[r["i"]]
        nxt = t.find(" ", p)
        assert r["f"] == (nxt if nxt >= 0 else len(t))
        assert r["b"] == t.rfind(" ", 0, p) + 1


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    return row[-1]


def test_lcs_against_table():
    rng = random.Random(9)
    for _ in range(300):
        a, b = "".join(rng.choices("abcచ", k=rng.randint(0, 14))), "".join(rng.choices("abcచ", k=rng.randint(0, 14)))
        assert lcs_length(a, b) == dp(a, b)
        assert indel_ratio(a, b) == indel_ratio(b, a)
    assert indel_ratio("", "") == 1.0 and indel_ratio("", "a") == 0.0
    assert token_sort_ratio("b a", "a b") == 1.0
    assert token_set_ratio("a b c", "a b") == 1.0


def test_lexicon_order():
    lex = Lexicon()
    assert lex.base("చైనాలో") == "చైన"  # a variation outranks the ending
    assert lex.base("తో") == "కలిసి"  # a form of the group begins with the word
    assert lex.base("ను") == ""  # nothing is left of a bare ending
    assert lex.base("దాదాపు") == "సుమారు"
    assert lex.equivalent("దాదాపు", "సుమారు")
    assert unicodedata.normalize("NFC", lex.base("పుస్తకంలో")) == "పుస్తకం"
