import random

from spanweave.llm import sentence_alignment as sa


def corpus(n=120, seed=4):
    """Pairs of three-sentence paragraphs in an invented language pair; the sentences are reordered."""
    rng = random.Random(seed)
    words = {f"stone{chr(97 + i)}": "రాయి" + chr(0x0C15 + i) for i in range(20)}
    rows, truth = [], set()
    for k in range(n):
        sents = [rng.sample(sorted(words), 4) for _ in range(3)]
        order = rng.sample(range(3), 3)
        a = " ".join("Then " + " ".join(s) + "." for s in sents)
        b = " ".join(" ".join(words[w] for w in sents[j]) + "." for j in order)
        rows += [(f"e{k}", None, a), (f"t{k}", f"e{k}", b)]
        truth |= {(f"e{k}", order[j], f"t{k}", j) for j in range(3)}
    return rows, truth


def test_reordered_sentences_are_found(spark):
    rows, truth = corpus()
    rows += [("x", None, None), ("y", "x", "ఏదో ఉంది."), ("z", "missing", "ఏదో."), ("t0", "e0", rows[1][2])]
    df = spark.createDataFrame(rows, "context_id string, orig_context_id string, context string")
    found = {tuple(r) for r in sa.aligned_sentences(df).collect()}
    assert len(found & truth) >= 0.97 * len(truth) and len(found - truth) <= 0.03 * len(truth)
    assert sa.aligned_sentences(df.where("false")).count() == 0


def brute_em(bags, rounds):
    t = {}
    vocab = {w for _, d in bags for w in d}
    for _ in range(rounds):
        c = {}
        for s, d in bags:
            for w in d:
                z = {v: t.get((v, w), 0.0) if t else 1 / len(vocab) for v in [*s, None]}
                total = sum(z.values())
                for v, x in z.items():
                    c[v, w] = c.get((v, w), 0.0) + x / total
        sums = {}
        for (v, _), x in c.items():
            sums[v] = sums.get(v, 0.0) + x
        t = {k: x / sums[k[0]] for k, x in c.items()}
    return t


def test_dense_table_equals_brute_force(spark):
    rng = random.Random(2)
    bags = [(sorted(rng.sample(range(6), 3)), sorted(rng.sample(range(5), 3))) for _ in range(40)]
    df = spark.createDataFrame([(s, d) for s, d in bags], "src array<int>, dst array<int>")
    a, b = {f"a{i}": i for i in range(6)}, {f"b{i}": i for i in range(5)}
    table = sa.estimate_table(df, a, b, 3)
    expected = brute_em(bags, 3)
    for i in range(7):
        for j in range(5):
            assert abs(table[i, j] - expected.get((i if i < 6 else None, j), 0.0)) < 1e-4


def test_rarer_words_are_translated_without_a_table(spark):
    """Nothing is frequent here: the sparse table alone must pair the words."""
    rows = []
    for k in range(12):
        for copy in range(3):
            rows.append((f"s{k}-{copy}", f"t{k}-{copy}", [], [], [f"alpha{k}", f"beta{(k + copy) % 12}"], [f"ఆ{k}", f"బీ{(k + copy) % 12}"]))
    bags = spark.createDataFrame(rows, "source_id string, target_id string, src array<int>, dst array<int>, rare_a array<string>, rare_b array<string>")
    counts = spark.createDataFrame([(s, w, 3) for k in range(12) for s, w in (("a", f"alpha{k}"), ("a", f"beta{k}"), ("b", f"ఆ{k}"), ("b", f"బీ{k}"))], "side string, word string, n long")
    best = {}
    for r in sa.rare_translations(bags, counts, rounds=4).collect():
        for x in r["tail"]:
            if x["p"] > best.get(x["a"], ("", 0.0))[1]:
                best[x["a"]] = (x["b"], x["p"])
    assert sum(best.get(f"alpha{k}", ("",))[0] == f"ఆ{k}" for k in range(12)) >= 10
    assert sum(best.get(f"beta{k}", ("",))[0] == f"బీ{k}" for k in range(12)) >= 10


def test_columns_beyond_the_dense_part_are_exact(spark, monkeypatch):
    rng = random.Random(3)
    bags = [(f"s{k}", f"t{k}", sorted(rng.sample(range(6), 3)), sorted(rng.sample(range(5), 3))) for k in range(40)]
    df = spark.createDataFrame(bags, "source_id string, target_id string, src array<int>, dst array<int>")
    a, b = {f"a{i}": i for i in range(6)}, {f"b{i}": i for i in range(5)}
    monkeypatch.setattr(sa, "TABLE_CELLS", 14, raising=False)  # two of the five columns
    table, further, _ = sa.estimate_tables(df, a, b, 3)
    assert table.shape == (7, 2)
    got = {(r["a"], r["b"]): r["t"] for r in further.collect()}
    expected = brute_em([(s, d) for _, _, s, d in bags], 3)
    for i in range(7):
        for j in range(5):
            x = table[i, j] if j < 2 else got.get((i, j), 0.0)
            assert abs(x - expected.get((i if i < 6 else None, j), 0.0)) < 1e-4


def test_links_do_not_depend_on_the_dense_part(spark, monkeypatch):
    rows, _ = corpus(60)
    df = spark.createDataFrame(rows, "context_id string, orig_context_id string, context string")
    whole = sorted(map(tuple, sa.aligned_sentences(df, rounds=3).collect()))
    monkeypatch.setattr(sa, "TABLE_WORDS", 5, raising=False)  # the former cap
    monkeypatch.setattr(sa, "TABLE_CELLS", 22 * 5, raising=False)
    assert whole and sorted(map(tuple, sa.aligned_sentences(df, rounds=3).collect())) == whole
