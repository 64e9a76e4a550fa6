import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from spanweave.functions.similarity import indel_ratio, sequence_ratio, token_similarity
from spanweave.operators import spans


def test_place_takes_a_character_boundary():
    search = spans.WindowSearch()
    assert search.place("చైనాలో లో ఉంది", "లో", 7) == 7  # not the ending inside the first word
    assert search.place("the old bridge", "old", 0) == 4
    assert search.place("nothing like it here", "qqqqq", 3) == 3
    assert search.place("the olb bridge", "the old", 0) == 0


def brute(search, context, answer):
    words, want = context.split(), answer.split()
    bases = search.lexicon.base
    best = (0.0, None)
    for i in range(len(words)):
        for size in range(len(want), len(want) + 4):
            if size and i + size <= len(words):
                window, target = " ".join(words[i : i + size]), " ".join(want)
                wb, ab = [bases(w) for w in words[i : i + size]], [bases(w) for w in want]
                score = 100 * (0.4 * indel_ratio(window.lower(), target.lower()) + 0.3 * token_similarity(window.lower(), target.lower()) + 0.3 * search.meaning(wb, ab))
                score += 20 * (set(ab) <= {x for x in wb if x})
                if score > best[0]:
                    best = (score, window)
    return best


def test_search_equals_brute_force():
    rng = random.Random(3)
    words = ["నది", "వంతెన", "చైనాలో", "పట్టణం", "పాత", "old", "bridge", "1887", "లోని"]
    search = spans.WindowSearch()
    for _ in range(60):
        context, answer = " ".join(rng.choices(words, k=12)), " ".join(rng.choices(words, k=rng.randint(1, 3)))
        score, window = brute(search, context, answer)
        start, end, found, got = search.search(context, answer)
        assert found == window and abs(got - score) < 1e-6 and end - start == len(window)


def test_sequence_ratio_is_the_usual_one():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcdef ", k=rng.randint(0, 30))) for _ in range(2))
        assert sequence_ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_adjusted_dataset_routes_answers(spark):
    ans = "array<struct<text:string,answer_start:int>>"
    rows = [
        (0, 0, 0, "T", "c1", "The old bridge was built in 1887 by the town.", "q1", "When?", False, [("in 1886", 3), ("old bridge", 0)], [("town", 1)]),
        (0, 0, 1, "T", "c1", "The old bridge was built in 1887 by the town.", "q2", "Who?", True, [("town", 1)], [("the town", 0)]),
        (1, 0, 0, None, "c2", "Nothing here.", "q3", "Where?", False, [("పూర్తిగా వేరే", 2), ("", 0), (None, None)], None),
        (1, 1, 0, None, "c3", None, "q4", "Where?", None, None, None),
    ]
    flat = spark.createDataFrame(rows, f"article_idx int, para_idx int, qa_idx int, title string, context_id string, context string, id string, question string, is_impossible boolean, answers {ans}, plausible_answers {ans}")
    flat = flat.withColumn("is_impossible", F.coalesce("is_impossible", F.lit(False)))
    adjusted, lows = spans.adjust_dataset(flat)
    got = {r["id"]: r for r in adjusted.collect()}
    context = rows[0][5]
    assert [(a["text"], a["answer_start"]) for a in got["q1"]["answers"]] == [("in 1887", context.index("in 1887")), ("old bridge", 4)]
    assert got["q1"]["plausible_answers"] == [] and got["q2"]["answers"] == []
    assert [a["text"] for a in got["q2"]["plausible_answers"]] == ["the town."] or [a["text"] for a in got["q2"]["plausible_answers"]][0].startswith("the town")
    assert len(got["q3"]["answers"]) == 3 and got["q4"]["answers"] == []
    report = spans.low_report(lows).collect()
    assert {r["title"] for r in report} == {None} and all(q["id"] == "q3" for r in report for p in r["paragraphs"] for q in p["qas"])


def test_fuzzy_validity_and_diagnosis(spark):
    rows = [(1, "The old bridge.", "old  Bridge", 4), (2, "The old bridge.", "old brigde", 4), (3, "The old bridge.", "river", 4), (4, None, "x", 0), (5, "abc", None, None), (6, "aXbXa", "a", 1), (7, "abc", "", 0)]
    df = spark.createDataFrame(rows, "id int, c string, a string, s int")
    got = {r["id"]: r["valid"] for r in spans.with_fuzzy_valid(df, "c", "a", "s").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    d = {r["id"]: r for r in spans.diagnosed(df, "c", "a", "s").collect()}
    assert d[6]["places"] == "0,4" and d[6]["n_places"] == 2 and d[6]["verdict"] == "found at 0" and d[3]["verdict"] == "not found" and d[4]["verdict"] == "missing"


def test_occurrence_of_the_same_rank(spark):
    df = spark.createDataFrame([("red. blue. red.", "red", 11, "ఎరుపు నీలం ఎరుపు", "ఎరుపు"), ("a a a", "a", 4, "బ బ", "బ"), ("a", "a", 0, "x", "y")], "s string, sa string, at int, t string, ta string")
    assert [r[0] for r in df.select(spans.by_occurrence(df.s, df.sa, df["at"], df.t, df.ta)).collect()] == [11, 2, None]
