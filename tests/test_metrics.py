import math
import random
from collections import Counter

from pyspark.sql import functions as F

from spanweave.operators import decode, metrics


def frame(spark, pairs):
    return spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "i int, pred string, gold string")


def values(df, **exprs):
    return [r.asDict() for r in df.select("i", *(e.alias(k) for k, e in exprs.items())).orderBy("i").collect()]


def cols():
    return F.col("pred"), F.col("gold")


PAIRS = [("x x", "x x"), ("", ""), (".", ""), ("a", ""), ("", "a"), ("చైనా దేశం", "చైనా"), ("b", "c"), (None, "a"), ("a b", "b a")]


def test_set_f1_and_em(spark):
    P, G = cols()
    r = values(frame(spark, PAIRS), em=metrics.exact_match(P, G), f1=metrics.f1(P, G), kind=metrics.error_type(P, G))
    assert [round(x["f1"], 4) for x in r] == [0.5, 1.0, 1.0, 0.0, 0.0, 0.6667, 0.0, 0.0, 1.0]
    assert [x["em"] for x in r] == [1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert [x["kind"] for x in r] == ["Correct", "Correct", "Correct", "Unanswerable FP", "Unanswerable FN", "Partial Span", "No Overlap", "Unanswerable FN", "Other"]


def brute_bleu(p, g, order):
    p, g = p.split(), g.split()
    if not p or not g:
        return 0.0
    out = 0.0
    for n, w in enumerate(metrics.BLEU_WEIGHTS[order], 1):
        a = Counter(tuple(p[i : i + n]) for i in range(len(p) - n + 1))
        b = Counter(tuple(g[i : i + n]) for i in range(len(g) - n + 1))
        hit, total = sum(min(c, b[x]) for x, c in a.items()), max(1, len(p) - n + 1)
        if n == 1 and not hit:
            return 0.0
        out += w * math.log((hit or 0.1) / total)
    return math.exp(out + (0 if len(p) > len(g) else 1 - len(g) / len(p)))


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_bleu_and_rouge_against_loops(spark):
    P, G = cols()
    rng = random.Random(4)
    pairs = [(" ".join(rng.choices("abcd", k=rng.randint(0, 6))), " ".join(rng.choices("abcd", k=rng.randint(0, 6)))) for _ in range(60)]
    df = frame(spark, pairs)
    parts = metrics.bleu_parts(P, G, 4)
    r = values(df, **{f"b{k}": metrics.bleu_from(parts, k) for k in range(1, 5)}, rl=metrics.rouge_l(P, G), r2=metrics.rouge_n(P, G, 2)[1])
    for x, (p, g) in zip(r, pairs):
        for k in range(1, 5):
            assert math.isclose(x[f"b{k}"], brute_bleu(p, g, k), abs_tol=1e-9), (p, g, k)
        a, b = p.split(), g.split()
        hit = brute_lcs(a, b)
        assert math.isclose(x["rl"], 2 * hit / (len(a) + len(b)) if hit else 0.0)


def test_confusion_and_impossible(spark):
    P, G = cols()
    df = frame(spark, PAIRS)
    row = metrics.derived(df.agg(*metrics.confusion(P, G))).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (4, 2, 2, 1)
    assert df.agg(metrics.impossible_accuracy(P, G).alias("x")).first()["x"] == 100.0 / 3
    assert df.where("gold = 'a'").agg(metrics.impossible_accuracy(P, G).alias("x")).first()["x"] == 100.0
    empty = metrics.derived(df.where("false").agg(*metrics.confusion(P, G))).first()
    assert empty["accuracy"] == 0.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 2, 27, 28, 29)], "v int")
    assert {r["bin_start"]: r["n"] for r in metrics.histogram(df, "v").collect()} == {0: 2, 2: 1, 26: 2}


def brute_nbest(s, e, n, longest, null):
    top = lambda a: sorted(range(len(a)), key=lambda i: (-a[i], i))[:n]
    legal = [(-(s[i] + e[j]), i, j) for i in top(s) for j in top(e) if j >= i and j - i + 1 <= longest]
    if not legal:
        return None
    k, i, j = min(legal)
    return None if null is not None and -k - (s[0] + e[0]) < null else (i, j)


def test_decoders_against_loops(spark):
    rng = random.Random(2)
    rows = [(k, [float(rng.randint(0, 4)) for _ in range(8)], [float(rng.randint(0, 4)) for _ in range(8)]) for k in range(60)]
    rows += [(90, [9.0] + [0.0] * 7, [9.0] + [0.0] * 7), (91, [0.0] * 7 + [5.0], [5.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "k int, s array<double>, e array<double>")
    S, E = F.col("s"), F.col("e")
    got = {r["k"]: r for r in df.select(
        "k", decode.nbest_span(S, E, 3, 4, None).alias("nb"), decode.nbest_span(S, E, 3, 4, 0.0).alias("nn"),
        decode.argmax_span(S, E).alias("strict"), decode.argmax_span(S, E, swap=True).alias("swap"), decode.serving_span(S, E).alias("serve"),
    ).collect()}
    for k, s, e in rows:
        pair = lambda x: None if x is None else (x["s"], x["e"])
        a, b = s.index(max(s)), e.index(max(e))
        assert pair(got[k]["nb"]) == brute_nbest(s, e, 3, 4, None)
        assert pair(got[k]["nn"]) == brute_nbest(s, e, 3, 4, 0.0)
        assert pair(got[k]["strict"]) == ((a, b) if a <= b else None)
        assert pair(got[k]["swap"]) == (min(a, b), max(a, b))
        assert pair(got[k]["serve"]) == (a, max(a, b))


def test_span_text(spark):
    df = spark.sql("select 'hello world' as c, array(named_struct('s', 0, 'e', 5), named_struct('s', 6, 'e', 11)) as o, named_struct('s', 0, 'e', 1) as sp, cast(null as struct<s:int,e:int>) as no")
    r = df.select(decode.span_text(F.col("c"), F.col("o"), F.col("sp")).alias("a"), decode.span_text(F.col("c"), F.col("o"), F.col("no")).alias("b")).first()
    assert (r["a"], r["b"]) == ("hello world", "")
