import random

from spanweave.operators.chunking import place_answers, split_contexts, windows


def loops(questions, contexts, compat=False):
    """Placing by plain loops."""
    out = {}
    for id_, c, impossible, text, start in questions:
        if c not in contexts or contexts[c] is None or (not impossible and (text is None or start is None)):
            continue
        w = [contexts[c][a:b] for a, b in windows(contexts[c], 60, 15)]
        at = [a for a, _ in windows(contexts[c], 60, 15)]
        if compat:
            at = [sum(map(len, w[:i])) for i in range(len(w))]
        if impossible:
            out[id_] = (f"{c}_01", None)
            continue
        near = min(range(len(w)), key=lambda i: (abs(start - at[i]), i))
        found = next((i for i in [near, near + 1, near - 1, *range(len(w))] if 0 <= i < len(w) and text in w[i]), None)
        out[id_] = (None, None) if found is None else (f"{c}_{found + 1:02}", w[found].index(text))
    return out


def test_placing_equals_loops(spark):
    rng = random.Random(6)
    words = ["నది", "వంతెన", "old", "bridge", "1887", "in", "town"]
    contexts = {f"c{i}": " ".join(rng.choices(words, k=rng.randint(1, 60))) for i in range(25)} | {"none": None, "empty": ""}
    rows = []
    for k in range(150):
        c = rng.choice(sorted(contexts))
        t = contexts[c] or "x"
        a = rng.randrange(len(t))
        text = rng.choice([t[a : a + rng.randint(1, 12)], t[a : a + 70], "absent", None, ""])
        rows.append((f"q{k}", c, rng.random() < 0.2, text, rng.choice([a, a + 40, None, -1])))
    q = spark.createDataFrame(rows, "id string, context_id string, is_impossible boolean, answer_text string, answer_start int")
    c = spark.createDataFrame(sorted(contexts.items()), "context_id string, context string")
    for compat in (False, True):
        found = {r["id"]: (r["sub_id"], r["answer_start"]) for r in place_answers(q, c, 60, 15, compat).collect()}
        assert found == loops(rows, contexts, compat)


def test_windows_cover_and_move_on(spark):
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choices("ab  ", k=rng.randint(0, 300)))
        w = windows(t, 40, 10)
        assert w[0][0] == 0 and w[-1][1] == len(t) and all(a2 > a1 and a2 <= b1 for (a1, b1), (a2, _) in zip(w, w[1:]))
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "x y " * 300)], "k string, t string")
    rows = split_contexts(df, "k", "t").collect()
    assert [r["sub_id"] for r in rows if r["k"] == "b"] == ["b_01"] and not [r for r in rows if r["k"] == "a"] and len([r for r in rows if r["k"] == "c"]) > 2
