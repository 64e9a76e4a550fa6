from spanweave.llm import personal_data
from spanweave.llm.personal_data import Finder, candidates, find_items, fit_finder, propose, redact


def test_late_telugu_names_are_proposed():
    late = "words in English only. " * 30 + "డా రాము గారు"
    found = [c for c in candidates(late, frozenset()) if c[0] == "person"]
    assert [(late[c[1] : c[2]]) for c in found] and all(c[3][7] == 1 for c in found)


def test_long_local_part_is_whole():
    local = "a" * 200 + ".b"
    text = f"write to {local}@mail.example today"
    mail = next(c for c in candidates(text, frozenset()) if c[0] == "email")
    assert text[mail[1] : mail[2]] == f"{local}@mail.example"


def test_items_are_replaced_and_all_else_kept(spark):
    names = spark.createDataFrame([("Ravi", "en"), ("Anna", "en"), (None, "en")], "given_name string, lang string")
    texts = []
    for i in range(60):
        texts += [f"Please call Mr. Ravi Rao{i} on +91 98480 {10000 + i} or write to ravi{i}@mail.example for help.", f"The shelf mark is 1887-20{i:02}-33 and the Old Bridge stands there.",
                  f"Anna Weber{i} lives at {i + 1} Mill Lane, Springfield and her identity card number is 1234 5678 {1000 + i}."]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "nothing here"), (903, "x" * 120_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    proposals = propose(docs, names)
    finder = fit_finder(proposals, names)
    items = find_items(proposals, finder).collect()
    kinds = {(r["doc_id"], r["kind"]) for r in items}
    assert (0, "email") in kinds and (0, "phone") in kinds and not [k for k in kinds if k[0] >= 900]
    out = {r["doc_id"]: r["text"] for r in redact(docs, finder).collect()}
    assert out[900] is None and out[901] == "" and out[902] == "nothing here" and "[EMAIL]" in out[0] and "[PHONE]" in out[0]
    by = {}
    for r in items:
        by.setdefault(r["doc_id"], []).append(r)
    for k, t in rows:
        if t and k in by:
            kept, at = [], 0
            for r in sorted(by[k], key=lambda r: r["char_start"]):
                kept.append(t[at : r["char_start"]] + f"[{r['kind'].upper()}]")
                at = r["char_end"]
            assert "".join(kept) + t[at:] == out[k]


def test_unseen_word_has_no_label_to_take_out():
    finder = Finder(frozenset())
    finder.context["person"] = {"<near": (3.0, 4.0)}
    assert finder.score("person", "far", "<", 1) == finder.score("person", "far", "<") == 0.2
    assert finder.score("person", "near", "<", 1) == (2.0 + 0.2) / 4


def test_counts_have_no_cap_and_blocks_change_nothing(spark, monkeypatch):
    names = spark.createDataFrame([("Ravi",), ("Anna",)], "given_name string")
    texts = []
    for i in range(80):
        texts += [f"we met {('Ravi', 'Anna', 'Zuri', 'Omar')[i % 4]} Person{chr(97 + i % 26)} yesterday and left.", f"the Old Bridge{chr(97 + i % 26)} stands here. the Stone Gate fell.",
                  f"they saw Odd{chr(97 + i % 26)} Case near x{i} and called +91 98480 {10000 + i} at noon."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def found():
        proposals = propose(docs, names)
        finder = fit_finder(proposals, names)
        return {tuple(r) for r in find_items(proposals, finder).collect()}, {tuple(r) for r in redact(docs, finder).collect()}, proposals

    whole, texts_whole, _ = found()
    monkeypatch.setattr(personal_data, "KNOWN_WORDS", 3, raising=False)
    monkeypatch.setattr(personal_data, "BLOCK", 4, raising=False)
    parts, texts_parts, proposals = found()
    assert parts == whole and texts_parts == texts_whole
    assert {k for _, k, _, _ in whole} >= {"person", "phone"}
    assert proposals.select("block").distinct().count() > 20
