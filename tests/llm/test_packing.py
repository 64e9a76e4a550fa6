import random

from spanweave.llm.packing import best_fit, fill_report, pack


def test_best_fit_holds_the_capacity_and_separates_duplicates():
    rng = random.Random(1)
    for sources in (1, 5):
        sizes = sorted((rng.randint(1, 400) for _ in range(800)), reverse=True)
        clusters = [rng.choice([-1] * 9 + [0, 1, 2]) for _ in sizes]
        bins = best_fit(sizes, [rng.randrange(sources) for _ in sizes], clusters, 512, 2)
        load, held = {}, set()
        for s, c, b in zip(sizes, clusters, bins):
            load[b] = load.get(b, 0) + s
            assert c < 0 or (b, c) not in held
            held.add((b, c))
        assert max(load.values()) <= 512 and sum(sizes) / (512 * len(load)) > 0.95


def test_tightest_compatible_bin_is_taken():
    # Bins with residuals 112 (source 0 used up), 212; an item of source 0 goes on to the second.
    assert best_fit([400, 300, 100], [0, 1, 0], [-1, -1, -1], 512, 1) == [0, 1, 1]
    # Where every bin conflicts by source, the tightest one is taken all the same.
    assert best_fit([400, 300, 100], [0, 0, 0], [-1, -1, -1], 512, 1) == [0, 1, 0]


def test_one_source_fills_up(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["river", "bridge", "town"]) for _ in range(rng.randint(20, 120))), "only") for i in range(600)]
    rows += [(1000, None, "only"), (1001, "", None), (1002, "word " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("source", "source")
    packed = pack(df, capacity=512).cache()
    assert fill_report(packed).first()["fill"] > 0.95
    per = {r["container"]: r["n"] for r in packed.where("container is not null").groupBy("container").agg({"n_tokens": "sum"}).toDF("container", "n").collect()}
    assert max(per.values()) <= 512
    assert {r["doc_id"] for r in packed.where("container is null").collect()} == {1000, 1001}
    big = packed.where("doc_id = 1002").orderBy("piece_no").collect()
    assert len(big) > 1 and all(r["n_tokens"] == 512 for r in big[:-1])
    assert pack(df.where("false")).count() == 0
