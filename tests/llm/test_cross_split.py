import random

from spanweave.llm import queries


def tables(spark, folder, **rows):
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def split_of(i):
    return "train" if i % 3 else "validation"


def test_pairs_of_common_words_are_found(spark, tmp_path):
    """Copies of a template differ in one rare word: what they share is common, what they differ in is rare."""
    rng = random.Random(3)
    template = "in which year was the old bridge of the town over river called built".split()
    words = [f"w{i}" for i in range(4000)]
    boilerplate = " ".join(f"b{i}" for i in range(40))
    asked, shown = [], []
    for i in range(300):
        rare = " ".join(rng.sample(words, 13))
        asked.append((f"q{i:03}", split_of(i), " ".join([*template, f"name{i}"]) if i < 60 else rare))
        own = " ".join(f"c{i}x{k}" for k in range(15))
        shown.append((f"p{i:03}", split_of(i), f"{boilerplate} {own}" if i < 60 else " ".join(rng.choices(words, k=50))))
    d = tables(spark, tmp_path, qas=("id string, split string, question string", asked), paragraphs=("context_id string, split string, context string", shown))
    found = {(r["kind"], r["id_1"], r["id_2"]) for r in queries.p7_found(spark, d).collect()}
    expected = set()
    for kind, rows, width, least in (("question", asked, 1, 0.85), ("context", shown, 4, 0.5)):
        sets = []
        for key, split, text in rows:
            w = text.split()
            sets.append((key, split, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}))
        for a, sa, x in sets:
            for b, sb, y in sets:
                if a < b and (sa == "train") != (sb == "train") and len(x & y) >= least * len(x | y):
                    expected.add((kind, a, b))
    assert len({e for e in expected if e[0] == "question"}) >= 800 and len({e for e in expected if e[0] == "context"}) >= 800
    assert found == expected


def test_similar_sets_share_a_bucket():
    from spanweave.llm.cross_split import prefix_keys

    rng = random.Random(8)
    rarity = {g: rng.choice([0.5, 1.0, 2.0]) for g in range(60)}
    for similarity in (0.5, 0.7, 0.85):
        for agree in (1, 2, 3):
            for _ in range(1500):
                x = rng.sample(range(60), rng.randint(1, 45))
                y = list(set(x) - set(rng.sample(x, rng.randint(0, len(x) // 2))) | set(rng.sample(range(60), rng.randint(0, 5))))
                if y and len({*x} & {*y}) / len({*x} | {*y}) >= similarity:
                    keys = [set(prefix_keys(s, [rarity[g] for g in s], similarity, agree)) for s in (x, y)]
                    assert keys[0] & keys[1]


def test_counts_have_both_kinds(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    shown = [("a", "train", "web", text), ("b", "test", None, text), ("c", "validation", "app", "short")]
    asked = [("1", "a", "train", "who built it"), ("2", "c", "test", "who built it"), ("3", "b", "validation", "Who built it?"), ("3", "b", "validation", "Who built it?")]
    d = tables(
        spark, tmp_path, paragraphs=("context_id string, split string, source string, context string", shown),
        qas=("id string, context_id string, split string, question string", asked),
    )
    rows = {(r["kind"], r["split"], r["source"]): (r["n_pairs"], r["n_records"]) for r in queries.p7_counts(spark, d).collect()}
    assert rows == {("context", "test", ""): (1, 1), ("question", "test", "app"): (1, 1), ("question", "validation", ""): (1, 1)}


def test_hot_buckets_and_copies(spark, tmp_path, monkeypatch):
    """A template of a third of all rows and a large class of copies, with buckets cut into parts."""
    from spanweave.llm import cross_split

    monkeypatch.setattr(cross_split, "HOT_ROWS", 5)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"a{i:03}", split_of(i), "what is the name of this one thing here") for i in range(40)]
    rows += [(f"b{i:03}", split_of(i), " ".join(rng.choices(words, k=8))) for i in range(80)]
    rows += [(f"c{i:03}", split_of(i), f"what is the name of this one thing number {i % 5}") for i in range(40)]
    rows += [("n1", "train", None), ("n2", "test", ""), ("n3", None, "what is the name")]
    df = spark.createDataFrame(rows, "id string, split string, text string")
    found = {(r["train_id"], r["eval_id"]) for r in cross_split.cross_split_pairs(df, width=1, similarity=0.85, agree=2).collect()}
    sets = [(k, s, set(t.split())) for k, s, t in rows if t]
    expected = {(a, b) for a, x, u in sets for b, y, v in sets if x == "train" and y not in ("train", None) and len(u & v) >= 0.85 * len(u | v)}
    assert found == expected and len(expected) > 300
    counts = {r["eval_id"]: r["n_pairs"] for r in cross_split.pairs_per_record(df, width=1, similarity=0.85, agree=2).collect()}
    assert sum(counts.values()) == len(expected)
