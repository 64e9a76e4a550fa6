import re

from pyspark.sql import functions as F

from spanweave.functions.stemmer import stem
from spanweave.operators import decode, features, serving

CONTEXT = "The old bridge of the town was built in 1887, and a new one in 1950."


def test_windows_cover_the_context_with_the_stride(spark):
    df = spark.createDataFrame([("1", "When was it built?", CONTEXT), ("2", None, None), ("3", "w " * 60, CONTEXT), ("4", "", "")], "id string, question string, context string")
    rows = features.build_windows(df, max_length=16, stride=4).orderBy("id", "feature_idx").collect()
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", CONTEXT)]
    own = [[(o["s"], o["e"]) for o, q in zip(r["offsets"], r["sequence_ids"]) if q == 1] for r in rows if r["id"] == "1"]
    assert own[0] == words[: len(own[0])] and own[-1][-1] == words[-1]
    for a, b in zip(own, own[1:]):
        assert a[-4:] == b[:4]
    assert all(len(r["input_ids"]) <= 16 for r in rows) and {r["id"] for r in rows} == {"1", "2", "3", "4"}
    assert len([r for r in rows if r["id"] == "3"]) == len(words)  # one token of room: the stride gives way
    padded = features.padded(features.build_windows(df, max_length=16), 16).collect()
    assert all(len(r[c]) == 16 for r in padded for c in ("input_ids", "attention_mask", "sequence_ids", "offsets"))
    assert all(len(r["input_ids"]) == 16 for r in features.build_windows(df, max_length=16, pad=True).collect())


def test_labels_native_and_in_windows_agree(spark):
    at = CONTEXT.index("1887")
    df = spark.createDataFrame([("1", "When 1887?", CONTEXT, at, at + 4), ("2", "x", CONTEXT, 9999, 10003), ("3", "x", CONTEXT, None, None)], "id string, question string, context string, a int, z int")
    for mode in ("context", "first", "last"):
        w = features.build_windows(df, 64, carry=("a", "z"), label=("a", "z", mode))
        for r in w.select("*", features.label_span(F.col("offsets"), F.col("sequence_ids"), F.col("a"), F.col("z"), mode).alias("l")).collect():
            assert (r["start_position"], r["end_position"]) == (r["l"]["start_position"], r["l"]["end_position"])
    r = {x["id"]: x for x in features.build_windows(df, 64, label=("a", "z", "lenient")).collect()}
    o = r["1"]["offsets"][r["1"]["start_position"]]
    assert CONTEXT[o["s"] : o["e"]] == "1887" and r["2"]["start_position"] == 1 and r["2"]["end_position"] == len(r["2"]["input_ids"]) - 1


def test_saved_features(spark, tmp_path):
    df = spark.createDataFrame([("1", "q", CONTEXT, "train"), ("2", "q", CONTEXT, "test")], "id string, question string, context string, split string")
    features.save_features(features.build_windows(df, carry=("split",)), str(tmp_path / "f"))
    assert [r["id"] for r in features.load_features(spark, str(tmp_path / "f"), "test").collect()] == ["2"]


def _model():
    def model(pdf):
        out = [[float(s == 1 and i in {x for x, t in zip(ids, seq) if t == 0}) for i, s in zip(ids, seq)] for ids, seq in zip(pdf["input_ids"], pdf["sequence_ids"])]
        return out, out

    return model  # a closure, as workers cannot import this module


model = _model()


def test_serving(spark, tmp_path):
    assert serving.predict_one(spark, " which town ", CONTEXT, model) == {"question": "which town", "answer": "town"}
    assert serving.predict_one(spark, "  ", CONTEXT, model) == {"error": serving.REJECTED} == serving.predict_one(spark, "q", None, model)
    assert serving.predict_one(spark, "xyz", CONTEXT, model)["answer"] == decode.NO_ANSWER
    # An answer at the very start is not given.
    assert serving.predict_one(spark, "The", "The end", model)["answer"] == decode.NO_ANSWER
    spark.createDataFrame([("1", "town", CONTEXT), ("2", None, "x")], serving.REQUEST).write.json(str(tmp_path / "r"))
    got = {r["id"]: (r["answer"], r["error"]) for r in serving.respond(serving.read_requests(spark, str(tmp_path / "r")), model).collect()}
    assert got == {"1": ("town", None), "2": (None, serving.REJECTED)}


def test_masked_tokens_never_win(spark):
    df = spark.createDataFrame([("abcdef", [0.0, 1.0, 9.0], [0.0, 1.0, 9.0], [1, 1, 0])], "c string, s array<double>, e array<double>, m array<int>")
    o = F.array(*(F.struct(F.lit(2 * i).alias("s"), F.lit(2 * i + 2).alias("e")) for i in range(3)))
    assert df.select(decode.serving_answer(df.c, o, df.s, df.e, df.m)).first()[0] == "cd"
    assert df.select(decode.serving_answer(df.c, o, df.s, df.e)).first()[0] == "ef"


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor", "hopping": "hop", "filing": "file", "relational": "relat", "triplicate": "triplic",
             "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controlling": "control", "sky": "sky", "generalizations": "gener"}
    assert {w: stem(w) for w in pairs} == pairs
