import itertools
import random

import numpy as np

from spanweave.llm import mixing as m


def test_rates_are_the_constrained_optimum():
    rng = np.random.default_rng(1)
    for _ in range(5):
        P = np.vstack([np.eye(3), rng.dirichlet(np.ones(3), 5)])
        mass, caps, goal = rng.uniform(1, 10, 8), rng.choice([1.0, 2.0], 8), rng.uniform(0, 20, 3)
        M = P.T @ mass
        loss = lambda r: (((P.T @ (mass * r) - goal) ** 2) / M).sum()
        best = m.fit_rates(mass, P, caps, goal)
        assert (best >= 0).all() and (best <= caps).all()
        for _ in range(2000):
            other = np.clip(best + rng.normal(0, 0.05, 8), 0, caps)
            assert loss(best) <= loss(other) + 1e-3


def test_nearest_sum_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 40) for _ in range(6)]
        spare = [rng.randint(0, 2) for _ in sizes]
        want = rng.randint(1, 150)
        sums = [sum(n * k for n, k in zip(sizes, ks)) for ks in itertools.product(*(range(s + 1) for s in spare))]
        got = m.nearest_sum(sizes, spare, want)
        assert all(0 <= g <= s for g, s in zip(got, spare))
        reached = sum(n * g for n, g in zip(sizes, got))
        assert abs(reached - want) <= max(min(abs(s - want) for s in sums), 0.001 * want)
        bits = m.reachable(sizes, 2)
        two = [sum(n * k for n, k in zip(sizes, ks)) for ks in itertools.product(range(3), repeat=6)]
        assert m._gap(bits, want) == min(abs(s - want) for s in two)


def test_units():
    assert m.in_units(np.array([0.5, 0.3, 0.2])).tolist() == [2, 1, 1]
    assert m.membership(m.membership_key(np.array([0, 3, 1])), 3).tolist() == [0, 0.75, 0.25]


def test_targets_are_met(spark):
    rng = random.Random(7)
    topics = {"rivers": ["river", "water", "bank", "boat"], "songs": ["song", "music", "drum", "voice"], "forts": ["fort", "wall", "king", "stone"]}
    rows, key = [], 0
    for source, n in (("rivers", 500), ("songs", 30), ("forts", 200)):
        for _ in range(n):
            rows.append((key, " ".join(rng.choices(topics[source], k=rng.randint(5, 60))), source))
            key += 1
    for source in (None, "elsewhere"):
        for _ in range(40):
            rows.append((key, " ".join(rng.choices(topics["songs"], k=20)), source))
            key += 1
    rows += [(9000, None, "songs"), (9001, "", None), (9002, "song " * 4000, "songs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("rivers", 0.5, 1), ("songs", 0.2, 3), ("forts", 0.2, 2), ("absent", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    mixture, shares = m.mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert all(got[s]["met"] for s in ("rivers", "songs", "forts")) and got["absent"]["n_tokens"] == 0
    taken = mixture.collect()
    cap = {"rivers": 1, "songs": 3, "forts": 2}
    assert all(1 <= r["repeats"] <= cap[r["domain"]] for r in taken)
    label = {k: s for k, _, s in rows}
    soft = [r for r in taken if r["soft"]]
    assert soft and all(label[r["doc_id"]] in (None, "elsewhere") for r in soft) and {r["domain"] for r in soft} == {"songs"}
    assert m.mix(docs, targets.where("false"))[0].count() == 0 and m.mix(docs.where("false"), targets)[0].count() == 0
