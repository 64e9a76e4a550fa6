from spanweave.llm import queries


def test_rates_have_contexts_and_answers(spark, tmp_path):
    rows = {
        "paragraphs": ("context_id string, source string, context string", [
            ("a", "form", "The bridge was built by careful engineers."), ("b", None, "The river is long."), ("c", "form", "It was built by care"),
        ]),
        "qas": ("id string, context_id string, question string, is_impossible boolean", [("1", "a", "By whom?", False), ("2", "b", "What is long?", None)]),
        "answers": ("answer_id long, qa_id string, text string, answer_start int", [
            (1, "1", "careful engin", 24), (1, "1", "careful engin", 24), (2, "1", "engineers", 32), (3, "2", "The river", 0),
        ]),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {(r["source"], r["tab"]): (r["n_texts"], r["n_cut"], r["cut_share"]) for r in queries.p5_rates(spark, str(tmp_path)).collect()}
    assert found == {
        ("form", "paragraphs"): (2, 1, 0.5), ("", "paragraphs"): (1, 0, 0.0), ("form", "answers"): (2, 1, 0.5), ("", "answers"): (1, 0, 0.0),
    }


def test_spikes_are_found_in_characters_and_bytes(spark):
    from spanweave.llm import truncation as t

    rows = [("form", "x" * 30, "open")] * 12 + [("form", "y" * n, "open") for n in range(10, 28)] + [("app", "నది" * 8, "open")] * 9 + [(None, None, "n")]
    df = t.with_lengths(spark.createDataFrame(rows, "source string, text string, other string"), "text")
    found = {(r["source"], r["unit"], r["length"]) for r in t.length_spikes(t.length_profile(df)).collect()}
    assert ("form", "chars", 30) in found and ("app", "bytes", 72) in found and not any(s == "" for s, _, _ in found)


def test_endings_look_at_the_whole_text_and_word():
    from spanweave.llm.truncation import judge_ending, word_class

    long = "w" * 450
    assert word_class("a" * 30 + "b") != word_class("a" * 30 + "c")
    verdict, grams = judge_ending("the old bridge " + "- " * 300)
    assert verdict == "cut" or grams
    assert judge_ending("Name Rav and Ravi " + "… " * 250 + "Rav")[0] in ("cut", "look")
    assert judge_ending(f"one {long} two")[1][0].split()[0] == word_class("one") or judge_ending(f"one {long} two")[1]


def test_answers_by_spike_and_passage(spark):
    from spanweave.llm import truncation as t

    context = "The bridge was built by careful engineers from the northern town."
    rows = [(str(i), "form", f"built by careful engi{'' if i % 2 else ''}"[:20], context, 15) for i in range(6)] + [("z", "web", "careful engi", context, 24), ("n", "web", None, context, None), ("w", "form", "build by careful eng", context, None)]
    df = t.with_lengths(spark.createDataFrame(rows, "row_id string, source string, text string, context string, answer_start int"), "text")
    judged = df.select("row_id", "source", "open", "chars", "bytes", t.stops_inside_word(df.text, df.context, df.answer_start).alias("inside"), t.last_word_is_part(df.text, df.context).alias("partial"))
    got = {r["row_id"]: r["reason"] for r in t.cut_answers(judged).collect()}
    assert got == {**{str(i): "spike" for i in range(6)}, "z": "passage", "w": "spike"}
