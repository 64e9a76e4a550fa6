import json
from datetime import datetime

from spanweave.operators.nested import flat_tables, node_table

SCHEMA = "record_id long, payload string, loaded_at timestamp, parent string"


def nodes(payload):
    """The nodes of one payload by plain recursion."""
    def listed(v):
        return v if isinstance(v, list) else [v] if isinstance(v, dict) else []

    out = []
    for i, a in enumerate(listed(payload.get("data"))):
        if isinstance(a, dict):
            out.append(f"data[{i}]")
            for j, p in enumerate(listed(a.get("paragraphs"))):
                if isinstance(p, dict):
                    out.append(f"data[{i}].paragraphs[{j}]")
                    for k, q in enumerate(listed(p.get("qas"))):
                        if isinstance(q, dict):
                            here = f"data[{i}].paragraphs[{j}].qas[{k}]"
                            out.append(here)
                            for kind in ("answers", "plausible_answers"):
                                v = q.get(kind)
                                if isinstance(v, dict) and isinstance(v.get("text"), list):
                                    out += [f"{here}.{kind}[{m}]" for m in range(max(len(v["text"]), len(v.get("answer_start", []))))]
                                else:
                                    out += [f"{here}.{kind}[{m}]" for m, x in enumerate(listed(v)) if isinstance(x, dict)]
    return out


PAYLOADS = [
    {"data": [{"title": "A", "paragraphs": [{"context": "c", "qas": [{"id": 7, "question": "q", "is_impossible": "true", "answers": [{"text": "t", "answer_start": "3"}, None, {"text": "u"}]}, None]}, None]}, None, 5]},
    {"data": {"title": "single", "paragraphs": {"context": "c", "qas": {"id": "x", "answers": {"text": "one", "answer_start": 1}}}}},
    {"data": [{"paragraphs": [{"qas": [{"id": "p", "answers": {"text": ["a", "b", "c"], "answer_start": [1, 2]}, "plausible_answers": []}]}]}]},
    {"data": []}, {"data": None}, {}, {"data": [{"paragraphs": []}, {"title": None}]},
]


def test_nodes_of_odd_payloads(spark):
    early, late = datetime(2020, 1, 1), datetime(2021, 1, 1)
    rows = [(i, json.dumps(p), early, "clash") for i, p in enumerate(PAYLOADS)]
    rows += [(50, json.dumps(json.dumps(PAYLOADS[0])), early, ""), (51, None, early, ""), (52, '{"data": [{"title": "cut', early, ""), (53, "", early, ""), (54, "[1]", early, None)]
    rows += [(60, json.dumps(PAYLOADS[1]), early, ""), (60, json.dumps(PAYLOADS[2]), late, ""), (0, json.dumps(PAYLOADS[0]), late, "")]
    table = node_table(spark.createDataFrame(rows, SCHEMA)).cache()
    found = sorted((r["record_id"], r["node"]) for r in table.collect())
    expected = [(i, n) for i, p in enumerate(PAYLOADS) for n in nodes(p)] + [(50, n) for n in nodes(PAYLOADS[0])] + [(60, n) for n in nodes(PAYLOADS[2])]
    assert found == sorted(expected)
    tables = flat_tables(table)
    q = {(r["record_id"], r["node"]): r for r in tables["questions"].collect()}
    first = q[0, "data[0].paragraphs[0].qas[0]"]
    assert (first["id"], first["is_impossible"], first["parent"]) == ("7", True, "data[0].paragraphs[0]")
    answers = {r["node"]: r for r in tables["answers"].where("record_id = 0").collect()}
    assert answers["data[0].paragraphs[0].qas[0].answers[0]"]["answer_start"] == 3
    known = {(r["record_id"], r["node"]) for r in table.collect()}
    assert all(r["parent"] is None or (r["record_id"], r["parent"]) in known for r in table.collect())
    assert node_table(spark.createDataFrame([], SCHEMA)).count() == 0
