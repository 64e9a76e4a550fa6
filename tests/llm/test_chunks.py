import random

from spanweave.llm.chunks import split_text, split_texts


def sample(n, seed=1):
    rng = random.Random(seed)
    words = ["bridge", "river", "నది", "వంతెన", "old", "town", "built", "café", "x" * 30]
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(words) + rng.choice([" ", " ", " ", ". ", ", ", "\n", "\n\n", "\r\n"]))
    return "".join(out)


def test_pieces_cover_the_text_and_keep_the_limit():
    for seed in range(20):
        text = sample(6000, seed)
        pieces = split_text(text, 500, 100)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for (_, end), (start, _) in zip(pieces, pieces[1:]):
            assert start == end - 100
        assert all(0 < b - a <= 500 for a, b in pieces)
        rejoined = text[pieces[0][0] : pieces[0][1]] + "".join(text[a + 100 : b] for a, b in pieces[1:])
        assert rejoined == text


def test_unbroken_text_is_cut_between_clusters():
    text = "కా" * 2000
    pieces = split_text(text, 500, 100)
    assert all(b - a <= 500 for a, b in pieces) and all(b % 2 == 0 for _, b in pieces)


def test_an_edit_changes_neighbours_only():
    text = sample(30_000, 5)
    at = 15_000
    edited = text[:at] + "inserted words here. " + text[at:]
    own = lambda t: {t[a + (100 if a else 0) : b] for a, b in split_text(t, 500, 100)}
    before, after = own(text), own(edited)
    assert len(before - after) <= 8 and len(before & after) >= 0.8 * len(before)


def test_null_empty_short_and_extra_columns(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "short", 3), ("c", "short", 3), ("d", "word " * 300, 4)], "key string, text string, piece int")
    rows = split_texts(df, "key", "text", 500, 100).collect()
    by = {k: [r for r in rows if r["key"] == k] for k in "abcd"}
    assert not by["a"] and [r["piece"] for r in by["b"]] == [""] and [r["piece"] for r in by["c"]] == ["short", "short"]
    assert len(by["d"]) > 3 and all(r["length"] == len(r["piece"]) <= 500 for r in by["d"])
    assert split_texts(df.where("false"), "key", "text").count() == 0
