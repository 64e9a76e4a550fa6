"""Single-process loops over the same tables: what the headline queries are compared with.

No reference timing is published, so this is our own baseline: plain Python over lists of dicts,
one row at a time, as such data sets are usually processed. Prints one JSON line of seconds.
BENCH_SF_DIR chooses the data; names on the command line choose queries.
"""

from __future__ import annotations

import json
import math
import os
import re
import string
import sys
import time
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from pathlib import Path

import pyarrow.parquet as pq

D = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def once(name: str, key: str) -> list[dict]:
    return list({r[key]: r for r in pq.read_table(f"{D}/{name}.parquet").to_pylist()}.values())


def tables():
    p, q, a = once("paragraphs", "context_id"), once("qas", "id"), once("answers", "answer_id")
    return {r["context_id"]: r for r in p}, {r["id"]: r for r in q}, a


def spans():
    p, q, a = tables()
    for r in a:
        yield r, p[q[r["qa_id"]]["context_id"]]["context"] or ""


def scored():
    p, q, a = tables()
    by = defaultdict(list)
    for r in sorted(a, key=lambda r: (r["answer_no"], r["answer_id"])):
        by[r["qa_id"], bool(r["is_plausible"])].append(r)
    for r in q.values():
        context, own, other = p[r["context_id"]]["context"] or "", by[r["id"], False], by[r["id"], True]
        gold = "" if r["is_impossible"] or not own else own[0]["text"] or ""
        s = own[0]["answer_start"] if own else None
        cut = "" if r["is_impossible"] or s is None or s < 0 else context[s : s + len(own[0]["text"] or "")]
        last = (other[0]["text"] if other else "") if r["is_impossible"] else (own[-1]["text"] if own else "")
        yield r, gold, cut
        yield r, gold, last or ""


def script(x: str) -> str:
    return " ".join(re.sub(r"[^ఀ-౿a-zA-Z0-9\s]", "", x).lower().split())


def f1(pred: str, gold: str) -> float:
    p, g = script(pred).split(), script(gold).split()
    if not p or not g:
        return float(len(p) == len(g))
    both = len(set(p) & set(g))
    return 2 * both / (len(p) + len(g)) if both else 0.0


def dataset_counts():
    p, q, _ = tables()
    split = {c: r["split"] for c, r in p.items()}
    return Counter(split[r["context_id"]] for r in q.values()), Counter(split.values()), {r["split"]: r["article_id"] for r in p.values()}


def filter_answerable():
    _, q, a = tables()
    have = {r["qa_id"] for r in a if not r["is_plausible"]}
    return [r["id"] for r in q.values() if not r["is_impossible"] and r["id"] in have]


def normalize_train():
    drop = set(string.punctuation)
    out = []
    for r in once("answers", "answer_id"):
        t = re.sub(r"[^\w\s]", "", "".join(c for c in (r["text"] or "").lower() if c not in drop))
        out.append(" ".join(re.sub(r"\b(a|an|the)\b", " ", t).split()))
    return out


def find_all():
    out = []
    for r, c in spans():
        at, found = c.find(r["text"]) if r["text"] else -1, []
        while at >= 0:
            found.append(at)
            at = c.find(r["text"], at + 1)
        out.append(found)
    return out


def span_validate_exact():
    return [c[r["answer_start"] : r["answer_start"] + len(r["text"])] == r["text"] if r["text"] and r["answer_start"] is not None else None for r, c in spans()]


def span_validate_fuzzy():
    out = []
    for r, c in spans():
        t, s = r["text"], r["answer_start"]
        if not t or s is None or s < 0 or s + len(t) > len(c):
            out.append(False)
            continue
        a, b = " ".join(c[s : s + len(t)].split()).lower(), " ".join(t.split()).lower()
        out.append(a == b or SequenceMatcher(None, a, b).ratio() >= 0.9)
    return out


def windows(t: str):
    at = 0
    while True:
        end = min(at + 500, len(t))
        if end < len(t):
            blank = t.find(" ", end)
            end = len(t) if blank < 0 else blank
        yield at, t[at:end]
        if end >= len(t):
            return
        nxt = t.rfind(" ", 0, end - 100) + 1
        at = nxt if at < nxt < end else end


def split_contexts():
    return [list(windows(r["context"] or "")) for r in once("paragraphs", "context_id")]


def place_answers():
    p, q, a = tables()
    first = {}
    for r in sorted(a, key=lambda r: (r["answer_no"], r["answer_id"])):
        if not r["is_plausible"]:
            first.setdefault(r["qa_id"], r)
    subs = {c: list(windows(r["context"] or "")) for c, r in p.items()}
    out = []
    for r in q.values():
        w, own = subs[r["context_id"]], first.get(r["id"])
        if r["is_impossible"]:
            out.append((r["id"], 0, None))
        elif own and own["text"] is not None and own["answer_start"] is not None:
            near = min(range(len(w)), key=lambda i: (abs(w[i][0] - own["answer_start"]), i))
            for i in [near, near + 1, near - 1, *range(len(w))]:
                if 0 <= i < len(w) and own["text"] in w[i][1]:
                    out.append((r["id"], i, w[i][1].find(own["text"])))
                    break
    return out


def qa_metrics_mean():
    return [(float(script(p) == script(g)), f1(p, g)) for _, g, p in scored()]


def error_taxonomy():
    out = []
    for _, g, p in scored():
        score = f1(p, g)
        out.append("Correct" if script(p) == script(g) else "FP" if not g.strip() and p.strip() else "FN" if g.strip() and not p.strip() else "Partial" if 0 < score < 1 else "None")
    return out


def confusion_matrix():
    return Counter((bool(g.strip()), bool(p.strip())) for _, g, p in scored())


def bleu():
    weights = {1: [1.0], 2: [0.5, 0.5], 3: [0.33, 0.33, 0.34], 4: [0.25] * 4}
    out = []
    for _, g, p in scored():
        a, b = script(p).split(), script(g).split()
        row = []
        for order, w in weights.items():
            logs = 0.0
            for n, x in enumerate(w, 1):
                ga, gb = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
                hit = sum((ga & gb).values())
                logs += x * math.log((hit or 0.1) / max(sum(ga.values()), 1))
            short = 0.0 if len(a) > len(b) else 1 - len(b) / max(len(a), 1)
            row.append(math.exp(short + logs) if a and b else 0.0)
        out.append(row)
    return out


def rouge_l():
    out = []
    for _, g, p in scored():
        a, b = re.findall(r"\w+", p.lower()), re.findall(r"\w+", g.lower())
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        out.append(2 * row[-1] / (len(a) + len(b)) if a and b else 0.0)
    return out


def decode_nbest_null():
    out = []
    for r in pq.read_table(f"{D}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist():
        st, en = r["embedding"][:32], r["embedding"][32:64]
        tops = [sorted(range(32), key=lambda i: -x[i])[:20] for x in (st, en)]
        best = max(((st[i] + en[j], -i, -j) for i in tops[0] for j in tops[1] if i <= j < i + 30), default=None)
        out.append(best if best and best[0] >= st[0] + en[0] else None)
    return out


def feature_rows():
    p, q, _ = tables()
    token = re.compile(r"\w+|[^\w\s]")
    out = []
    for r in q.values():
        a = [(m.start(), m.end()) for m in token.finditer(r["question"] or "")]
        c = [(m.group(), m.start(), m.end()) for m in token.finditer(p[r["context_id"]]["context"] or "")]
        room = max(1, 384 - len(a) - 3)
        step, at = room - min(128, room - 1), 0
        while True:
            part = c[at : at + room]
            out.append(([0, *(hash(t) for t, _, _ in part)], [0] * len(a) + [1] * len(part), [*a, *((s, e) for _, s, e in part)]))
            if at + room >= len(c):
                break
            at += step
    return len(out)


QUERIES = [dataset_counts, filter_answerable, normalize_train, find_all, span_validate_exact, span_validate_fuzzy, split_contexts, place_answers,
           qa_metrics_mean, error_taxonomy, confusion_matrix, bleu, rouge_l, decode_nbest_null, feature_rows]


def main() -> None:
    times = {}
    for f in QUERIES:
        if sys.argv[1:] and f.__name__ not in sys.argv[1:]:
            continue
        began = time.perf_counter()
        f()
        times[f.__name__] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(D).name}))


if __name__ == "__main__":
    main()
