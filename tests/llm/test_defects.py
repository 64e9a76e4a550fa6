from spanweave.llm.pair_defects import defects

CASES = [
    # qa, answer, question, impossible, context, types
    ("q1", None, "Who built it?", False, "x", ["empty"]),
    ("q2", "  n/a ", "Who built it?", False, "x", ["empty"]),
    ("q3", None, "Who built it?", True, "x", []),
    ("q4", "I'm sorry, I cannot help with that.", "Who built it?", False, "x", ["refusal"]),
    ("q5", "క్షమించండి, నేను చెప్పలేను", "ఎవరు కట్టారు?", False, "x", ["refusal"]),
    ("q6", "Answer: who built the old bridge", "Who built the old bridge?", False, "x", ["copied_question"]),
    ("q7", "the old bri", "What did they build?", False, "They built the old bridge there.", ["truncated"]),
    ("q8", "the old bridge", "What did they build?", False, "They built the old bridge there.", []),
    ("q9", "der alte Turm am Fluss", "What did they build?", False, "They built the old tower.", ["other_language"]),
    ("q10", "el puente de la ciudad", "¿Cuál es el nombre de la calle y el río?", False, "otro texto", []),
    ("q11", "the bridge (of", "What is it?", False, "It is the bridge (of the town).", ["unclosed"]),
    ("q12", "1887", "ఎప్పుడు?", False, "x", []),
]


def test_rules(spark):
    pairs = spark.createDataFrame([(i, q, a, None, s, imp, c) for i, (q, a, s, imp, c, _) in enumerate(CASES)],
                                  "answer_id long, qa_id string, usual string, answer_start int, question string, is_impossible boolean, context string")
    asked = spark.createDataFrame([(q, imp) for q, _, _, imp, _, _ in CASES] + [("none", False), ("none2", True)], "qa_id string, is_impossible boolean")
    rows = {r["qa_id"]: r for r in defects(pairs, asked).collect()}
    for q, *_, types in CASES:
        assert (rows[q]["fired"] if q in rows else []) == types, q
    assert rows["q11"]["defect"] is None and rows["none"]["defect"] == "empty" and "none2" not in rows
    assert defects(pairs.where("false"), asked.where("false")).count() == 0
