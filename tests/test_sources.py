import json

import pytest

from spanweave import session
from spanweave.sources import squad


def document(title="T"):
    qa = {"id": 1, "question": "q", "answers": [{"text": "నది", "answer_start": 0}]}
    return {"version": "v2.0", "data": [{"title": title, "paragraphs": [{"context": "నది \"q\"\n", "qas": [qa, {"id": "2", "question": "r", "is_impossible": True}]}, {"context": "empty", "qas": []}]}]}


def test_read_flatten_write(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document(), indent=4, ensure_ascii=False), encoding="utf-8")
    flat = squad.flatten(squad.read_squad(spark, str(tmp_path / "a.json")))
    rows = {r["id"]: r for r in flat.collect()}
    assert set(rows) == {"1", "2"} and rows["2"]["is_impossible"] and rows["2"]["answers"] == [] and not rows["1"]["is_impossible"]
    squad.write_squad(flat, str(tmp_path / "out"), part=1)
    again = squad.flatten(squad.read_squad(spark, str(tmp_path / "out"), lines=True))
    assert sorted((r["id"], r["context"], r["title"]) for r in again.collect()) == sorted((r["id"], r["context"], r["title"]) for r in rows.values())
    squad.export_document(flat, str(tmp_path / "whole.json"))
    text = (tmp_path / "whole.json").read_text(encoding="utf-8")
    assert "నది" in text and len(json.loads(text)["data"][0]["paragraphs"]) == 1
    with pytest.raises(ValueError):
        squad.export_document(flat, str(tmp_path / "x.json"), limit=1)


def test_tolerant_and_strict(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"data": [')
    assert squad.read_squad(spark, str(tmp_path / "bad.json"), strict=False).first()["_corrupt_record"]
    assert squad.read_squad(spark, str(tmp_path / "none.json"), strict=False).count() == 0
    with pytest.raises(Exception):
        squad.read_squad(spark, str(tmp_path / "bad.json")).collect()
    assert squad.missing_files(spark, str(tmp_path), ["bad.json", "none.json"]) == ["none.json"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a,"b"\\n\n\r\n'), (2, ""), (3, None), (4, "\\")], "k int, t string")
    assert squad.write_report(df, str(tmp_path / "r"), kind="csv") and not squad.write_report(df.where("false"), str(tmp_path / "e"))
    back = {r["k"]: r["t"] for r in squad.read_csv(spark, str(tmp_path / "r"), "k int, t string").collect()}
    assert back[1] == ' a,"b"\\n\n\r\n' and back[2] == "" and back[3] is None and back[4] == "\\"
    assert "| k | t" in squad.format_table(df.where("k = 2"), "Title")
    squad.log_metrics(df, str(tmp_path / "log"), "one")
    squad.log_metrics(df, str(tmp_path / "log"), "two")
    assert {r["run"] for r in spark.read.parquet(str(tmp_path / "log")).select("run").distinct().collect()} == {"one", "two"}


def test_intermediates_are_in_the_named_folder(spark):
    df = session.materialize(spark.range(3).toDF("id"), "probe")
    assert all(session.shared_dir(spark) in f for f in df.inputFiles()) and df.count() == 3
