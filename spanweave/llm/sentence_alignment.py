"""Sentence alignment in bilingual documents (problem 3).

Method: a translation table t(target word | source word) is estimated by expectation
maximization (IBM model 1 over paragraph pairs), distributed, in two tiers. Frequent words have
one table. Its columns of the most frequent target words, ``TABLE_CELLS`` cells at most, are
dense: every task keeps the current ones, adds up the expected counts of its pairs, and the
counts are summed row by row. Further columns, if there are any, are sparse: the same counts,
joined and summed by word pair on the cluster. A target word's counts need no other column, and
rows are normalized over both parts, so that the table does not depend on where it is cut. All
rarer words have a sparse table of their own. Sparse tables are never gathered anywhere: each
paragraph pair gets the entries of its own words.
Names, which translation respells, are also compared through a common transliteration, and
numbers by value. Competitive linking then accepts, within a paragraph pair, the best scored
span pair anywhere, again and again: a link claims the words it explains, so that a sentence
merged from several statements can link again with the words that remain, reordering costs
nothing, and sentences without a counterpart stay unlinked.

Null, empty and one-sentence texts give no or few links; nothing fails on them. A paragraph
delivered twice counts once. Ties are broken by sentence numbers.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .unicode_forms import canonical_column

#: Cells that the dense part of the table has at most.
TABLE_CELLS = 4_000_000

_SENTENCE_END = re.compile(r"(?<=[.?!।])\s+")
_TOKEN = re.compile(r"\d+|(?:[^\W\d_]|[̀-ͯऀ-ःऺ-ॏఀ-ఄ఼-ౖౢౣ])+")

# Latin spelling of Telugu letters, coarse enough to meet English spelling.
_TE_LATIN = dict(zip(
    "కఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరఱలళవశషసహ",
    "k k g g n c c j j n t t d d n t t d d n p p b b m y r r l l v s s s h".split(),
))
_TE_VOWELS = dict(zip("అఆఇఈఉఊఎఏఐఒఓఔాిీుూెేైొోౌ", "a a i i u u e e ai o o au a i i u u e e ai o o au".split()))


def sentences(text: str | None) -> list[str]:
    """Sentences end at . ? ! or danda before white space or the end."""
    return [s for s in _SENTENCE_END.split(text.strip()) if s] if text else []


def telugu_key(word: str) -> str:
    """A Telugu word in Latin letters; the inherent vowel is written unless a sign follows."""
    out = []
    for i, ch in enumerate(word):
        if ch in _TE_LATIN:
            out.append(_TE_LATIN[ch])
            nxt = word[i + 1 : i + 2]
            if nxt not in _TE_VOWELS and nxt != "్":
                out.append("a")
        elif ch in _TE_VOWELS:
            out.append(_TE_VOWELS[ch])
        elif ch == "ం":
            out.append("m")
    return "".join(out)


def latin_key(word: str) -> str:
    """An English spelling brought near ``telugu_key``."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    return bare.replace("ch", "c").replace("sh", "s").replace("th", "t").replace("w", "v")


def english_words(sentence: str) -> list[str]:
    """Tokens: numbers as they are, names as ``=key``, other words lower-cased with a light stem."""
    out = []
    for k, m in enumerate(_TOKEN.finditer(sentence)):
        w = m.group(0)
        if w.isdigit():
            out.append(str(int(w)))
        elif w[0].isupper() and k:
            out.append("=" + latin_key(w))
        else:
            low = w.lower()
            out.append(low[:-1] if len(low) > 4 and low.endswith("s") and not low.endswith("ss") else low)
            if k == 0:
                out[-1] = "^" + out[-1]
    return out


def telugu_words(sentence: str) -> list[str]:
    """Tokens: numbers in ASCII digits; other words as they are."""
    return [str(int(m.group(0))) if m.group(0).isdigit() else m.group(0) for m in _TOKEN.finditer(sentence)]


def _plain(w: str) -> str:
    return w[1:] if w[:1] == "^" else w


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document frequencies of the words on each side."""
    seen: Counter = Counter()
    for pdf in batches:
        for a, b in zip(pdf["source_text"], pdf["target_text"]):
            seen["n", ""] += 1
            for w in {_plain(w) for s in sentences(a) for w in english_words(s)}:
                if not w.isdigit() and w[:1] != "=":
                    seen["a", w] += 1
            for w in {w for s in sentences(b) for w in telugu_words(s)}:
                if not w.isdigit():
                    seen["b", w] += 1
    yield pd.DataFrame([(side, w, n) for (side, w), n in seen.items()], columns=["side", "word", "n"])


#: What the empty word contributes to the explanation of a rarer word.
_EMPTY = 0.05


def document_frequencies(pairs: DataFrame) -> DataFrame:
    """(side, word, n): in how many pairs each word stands; side ``n`` has the number of pairs."""
    return materialize(
        pairs.select("source_text", "target_text").mapInPandas(_bags, "side string, word string, n long")
        .groupBy("side", "word").agg(F.sum("n").alias("n")), "bags"
    )


def vocabulary(counts: DataFrame, share: float = 0.003, least: int = 3) -> tuple[dict[str, int], dict[str, int], dict[str, float]]:
    """Frequent words, in at least ``share`` of the pairs: ids per side, and their idf.

    The share bounds their number by that of a pair's distinct words. Of the target side the most
    frequent words have the first ids, which are the columns of the dense part.
    """
    n = (counts.where("side = 'n'").first() or {"n": 0})["n"]
    kept = [
        r for side in "ab"
        for r in counts.where((F.col("side") == side) & (F.col("n") >= max(least, share * n))).orderBy(F.desc("n"), "word").collect()
    ]
    a = {w: i for i, w in enumerate(r["word"] for r in kept if r["side"] == "a")}
    b = {w: i for i, w in enumerate(r["word"] for r in kept if r["side"] == "b")}
    idf = {r["side"] + r["word"]: math.log((n + 1) / (r["n"] + 0.5)) for r in kept}
    return a, b, idf


def _ids(batches: Iterator[pd.DataFrame], a: dict[str, int], b: dict[str, int]) -> Iterator[pd.DataFrame]:
    """Ids of the frequent words, and the rarer words themselves, on both sides."""
    for pdf in batches:
        src, dst, rare_a, rare_b = [], [], [], []
        for x, y in zip(pdf["source_text"], pdf["target_text"]):
            u = {_plain(t) for s in sentences(x) for t in english_words(s)}
            v = {w for s in sentences(y) for w in telugu_words(s)}
            src.append(sorted(a[w] for w in u if w in a))
            dst.append(sorted(b[w] for w in v if w in b))
            rare_a.append(sorted(w for w in u if w not in a and not w.isdigit() and w[:1] != "="))
            rare_b.append(sorted(w for w in v if w not in b and not w.isdigit()))
        yield pd.DataFrame({"source_id": pdf["source_id"], "target_id": pdf["target_id"], "src": src, "dst": dst, "rare_a": rare_a, "rare_b": rare_b})


def word_bags(pairs: DataFrame, a: dict[str, int], b: dict[str, int]) -> DataFrame:
    return materialize(pairs.mapInPandas(
        lambda batches: _ids(batches, a, b),
        "source_id string, target_id string, src array<int>, dst array<int>, rare_a array<string>, rare_b array<string>"), "em")


def _sum_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row": pdf["row"].iloc[:1], "counts": [np.sum(np.stack(pdf["counts"].to_numpy()), axis=0)]})


def dense_columns(a: dict[str, int], b: dict[str, int]) -> int:
    """How many columns, from the first, the dense part has."""
    return min(len(b), TABLE_CELLS // (len(a) + 1))


def estimate_table(bags: DataFrame, a: dict[str, int], b: dict[str, int], rounds: int = 6) -> np.ndarray:
    """The dense part of the translation table, |a|+1 rows (the last is the empty word) by ``dense_columns``."""
    return estimate_tables(bags, a, b, rounds)[0]


def estimate_tables(bags: DataFrame, a: dict[str, int], b: dict[str, int], rounds: int = 6) -> tuple[np.ndarray, DataFrame | None, DataFrame | None]:
    """The dense part; the entries (a, b, t) of the further columns and their cells, None if there are none."""
    na, nb, dense = len(a) + 1, len(b), dense_columns(a, b)
    table = np.full((na, dense if nb else 1), 1.0 / max(nb, 1))
    if not a or not b:
        return table, None, None
    cells = further = None
    pair = ["source_id", "target_id"]
    if dense < nb:
        cells = further_cells(bags, na - 1, dense)
        further = cells.select("a", "b").distinct().withColumn("t", F.lit(1.0 / nb))
    for _ in range(rounds):
        current = table.astype(np.float32)

        def expect(batches: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            counts = np.zeros(current.shape)
            for pdf in batches:
                for src, dst in zip(pdf["src"], pdf["dst"]):
                    dst = np.asarray(dst, np.int64)
                    dst = dst[dst < dense]
                    if len(dst):
                        rows = np.append(np.asarray(src, np.int64), na - 1)
                        block = current[np.ix_(rows, dst)]
                        counts[np.ix_(rows, dst)] += block / np.maximum(block.sum(axis=0), 1e-30)
            used = np.flatnonzero(counts.any(axis=1))
            yield pd.DataFrame({"row": used, "counts": [counts[i] for i in used]})

        # One row per source word and task, then one per source word: bounded by the vocabulary.
        schema = "row int, counts array<double>"
        total = np.zeros(current.shape)
        if dense:
            for r in bags.select("src", "dst").mapInPandas(expect, schema).groupBy("row").applyInPandas(_sum_rows, schema).toLocalIterator():
                total[r["row"]] = r["counts"]
        sums = total.sum(axis=1, keepdims=True)
        if cells is not None:
            scored = cells.join(further, ["a", "b"])
            each = scored.groupBy(*pair, "b").agg(F.sum("t").alias("k"))
            expected = materialize(
                scored.join(each, [*pair, "b"]).groupBy("a", "b").agg(F.sum(F.col("t") / F.greatest("k", F.lit(1e-30))).alias("c")), "expected")
            for r in expected.groupBy("a").agg(F.sum("c").alias("c")).toLocalIterator():
                sums[r["a"]] += r["c"]
            rows = bags.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(sums[:, 0])], "a int, all double")
            further = materialize(expected.join(rows, "a").select("a", "b", (F.col("c") / F.greatest("all", F.lit(1e-30))).alias("t")), "further")
        table = total / np.maximum(sums, 1e-30)
    return table, further, cells


def further_cells(bags: DataFrame, empty: int, dense: int) -> DataFrame:
    """(source_id, target_id, a, b): every frequent source word, and the empty one, with every target word beyond the dense columns."""
    some = bags.select("source_id", "target_id", "src", F.explode(F.filter("dst", lambda w: w >= dense)).alias("b"))
    return materialize(some.select("source_id", "target_id", F.explode(F.concat("src", F.array(F.lit(empty)))).alias("a"), "b"), "further-cells")


def further_translations(cells: DataFrame, further: DataFrame, a: dict[str, int], b: dict[str, int]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """For each pair the entries (a, b, t) of its words in the further columns, and which words those columns translate with some certainty."""
    sure = further.where((F.col("a") < len(a)) & (F.col("t").cast("float") > 0.25))
    sure_a, sure_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for name, known in (("a", sure_a), ("b", sure_b)):
        for r in sure.select(name).distinct().toLocalIterator():
            known[r[name]] = True
    entry = F.struct("a", "b", F.col("t").cast("float").alias("t"))
    own = cells.join(further, ["a", "b"]).groupBy("source_id", "target_id").agg(F.collect_list(entry).alias("further"))
    return own, sure_a, sure_b


def rare_translations(bags: DataFrame, counts: DataFrame, rounds: int = 2, least: float = 2.0) -> DataFrame:
    """(source_id, target_id, tail): for each pair the translations (a, b, p) of its rarer words.

    Expectation maximization over the rarer words of both sides. Words seen in one pair only can
    be translated by nothing that they do not share with every other such word, so they are left
    to the transliteration; so are entries whose expected count stays below ``least``.
    """
    again = counts.where("n >= 2")
    pair = ["source_id", "target_id"]

    def side(name: str) -> DataFrame:
        return bags.select(*pair, F.explode(f"rare_{name}").alias(name)).join(
            again.where(F.col("side") == name).select(F.col("word").alias(name)), name, "left_semi")

    cells = materialize(side("a").join(side("b"), pair), "cells")
    # From the uniform table: every rarer word of the pair explains a target word alike, and so does the empty word.
    each = cells.groupBy(*pair, "b").agg(F.count("*").alias("k"))
    expected = cells.join(each, [*pair, "b"]).groupBy("a", "b").agg(F.sum(1.0 / (F.col("k") + 1)).alias("c"))
    for _ in range(rounds):
        table = expected.join(expected.groupBy("a").agg(F.sum("c").alias("all")), "a").select("a", "b", (F.col("c") / F.col("all")).alias("t"))
        scored = materialize(cells.join(table, ["a", "b"]), "scored")
        each = scored.groupBy(*pair, "b").agg((F.sum("t") + _EMPTY).alias("k"))
        expected = scored.join(each, [*pair, "b"]).groupBy("a", "b").agg(F.sum(F.col("t") / F.col("k")).alias("c"))
    known = expected.join(expected.groupBy("a").agg(F.sum("c").alias("all")), "a").where(F.col("c") >= least)
    known = known.select("a", "b", (F.col("c") / F.col("all")).cast("float").alias("p"))
    return cells.join(known, ["a", "b"]).groupBy(*pair).agg(F.collect_list(F.struct("a", "b", "p")).alias("tail"))


def _type_matches(src: list[str], dst: list[str], a: dict, b: dict, table: np.ndarray, keys: dict[str, str], tail: dict, further: dict) -> np.ndarray:
    """How well each distinct target word is explained by each distinct source word, from 0 to 1."""
    out = np.zeros((len(src), len(dst)), np.float32)
    at = {v: i for i, v in enumerate(src)}
    names = [(i, v.lstrip("=^")) for i, v in enumerate(src) if v[0] in "=^"]
    names = [(i, v, v[:-1] if len(v) > 5 else v, len(v) + 6) for i, v in names if len(v) > 3]
    for j, w in enumerate(dst):
        if w.isdigit():
            if w in at:
                out[at[w], j] = 1.0
            continue
        k = keys.get(w)
        if k is None:
            k = keys[w] = telugu_key(w) if "ఀ" <= w[0] <= "౿" else latin_key(w)
        for i, v, stem, longest in names:
            if k.startswith(stem) and (len(k) <= longest or k.startswith(v)):
                out[i, j] = 1.0
    rows = np.array([a.get(_plain(v), -1) for v in src])
    cols = np.array([b.get(w, -1) for w in dst])
    r, c = np.flatnonzero(rows >= 0), np.flatnonzero((cols >= 0) & (cols < table.shape[1]))
    if len(r) and len(c):
        p = table[np.ix_(rows[r], cols[c])]
        strength = np.minimum(p / 0.25, 1) * (p > 2 * table[-1][cols[c]])
        block = np.ix_(r, c)
        out[block] = np.maximum(out[block], strength)
    empty = len(a)
    for j in np.flatnonzero(cols >= table.shape[1]) if further else ():
        p = np.array([further.get((v, cols[j]), 0.0) for v in rows], np.float32)
        strength = np.minimum(p / 0.25, 1) * (p > 2 * np.float32(further.get((empty, cols[j]), 0.0))) * (rows >= 0)
        out[:, j] = np.maximum(out[:, j], strength)
    if tail:
        plain = {_plain(v): i for i, v in enumerate(src)}
        column = {w: j for j, w in enumerate(dst)}
        for (v, w), p in tail.items():
            if v in plain and w in column:
                out[plain[v], column[w]] = max(out[plain[v], column[w]], min(p / 0.25, 1.0))
    return out


def known_words(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which source and target words the dense part translates with some certainty."""
    return (table[:-1] > 0.25).any(axis=1), (table[:-1] > 0.25).any(axis=0)


def align(
    source_text: str, target_text: str, a: dict, b: dict, idf: dict, table: np.ndarray, least: float = 0.5,
    keys: dict | None = None, known: tuple | None = None, tail: dict | None = None, further: dict | None = None,
) -> list[tuple[int, int]]:
    """Links (source sentence, target sentence) of one paragraph pair, by competitive linking.

    ``tail``: translations (source word, target word) -> probability of the pair's rarer words.
    ``further``: those of its frequent words beyond the dense columns, by ids.
    """
    S, D = [english_words(s) for s in sentences(source_text)], [telugu_words(s) for s in sentences(target_text)]
    if not S or not D:
        return []
    keys = {} if keys is None else keys
    known_a, known_b = known_words(table) if known is None else known
    rare = max(idf.values(), default=3.0)
    tail = {k: p for k, p in (tail or {}).items() if p > 0.25}
    tail_words = {v for v, _ in tail}
    in_source = Counter(w for s in S for w in set(s))
    in_target = Counter(w for s in D for w in set(s))

    def weight_s(w: str) -> float:
        if w.isdigit():
            return 5.0
        if w[0] == "=":
            return 1.5 / in_source[w] ** 0.5
        i = a.get(_plain(w))
        if i is None:
            return 1.5 if _plain(w) in tail_words else 0.0
        return idf["a" + _plain(w)] if known_a[i] else 0.0

    def weight_d(w: str) -> float:
        if w.isdigit():
            return 5.0
        j = b.get(w)
        if j is None:
            return 1.5 / in_target[w] ** 0.5
        return min(idf["b" + w], rare) if known_b[j] else 0.0

    src, dst = list(in_source), list(in_target)
    types = _type_matches(src, dst, a, b, table, keys, tail, further or {})
    si, di = {w: i for i, w in enumerate(src)}, {w: i for i, w in enumerate(dst)}
    ws, wd = np.array([weight_s(w) for w in src]), np.array([weight_d(w) for w in dst])
    IS, ID = [np.array([si[w] for w in s], np.int64) for s in S], [np.array([di[w] for w in d], np.int64) for d in D]
    # Open weights: what no accepted link has explained yet.
    W, V = [ws[i] for i in IS], [wd[j] for j in ID]
    M: dict[tuple[int, int], np.ndarray] = {}
    open_s, open_d = [np.ones(len(s)) for s in S], [np.ones(len(d)) for d in D]

    def score(i: int, j: int) -> tuple[float, float]:
        """Explained share of the smaller side's open weight, and the explained weight."""
        m = M[i, j] * open_s[i][:, None] * open_d[j]
        v, w = W[i] * open_s[i], V[j] * open_d[j]
        all_s, all_d = v.sum(), w.sum()
        if all_s <= 0 or all_d <= 0:
            return 0.0, 0.0
        got_s, got_d = m.max(axis=1) @ W[i], m.max(axis=0) @ V[j]
        share_s, share_d = got_s / all_s, got_d / all_d
        return 0.5 * max(share_s, share_d) + 0.5 * math.sqrt(max(share_s * share_d, 0)), min(got_s, got_d)

    # What two sentences share of their distinct words bounds the weight a link could explain.
    has_s, has_d = np.zeros((len(S), len(src)), np.float32), np.zeros((len(D), len(dst)), np.float32)
    for i, x in enumerate(IS):
        np.add.at(has_s[i], x, 1)
    for j, x in enumerate(ID):
        np.add.at(has_d[j], x, 1)
    bound = (has_s * ws) @ types @ np.minimum(has_d, 1).T
    scored = {}
    for i, j in zip(*np.nonzero(bound >= 1.5)):
        M[i, j] = types[np.ix_(IS[i], ID[j])]
        x = score(i, j)
        if x[1] >= 1.5:
            scored[int(i), int(j)] = x
    links: list[tuple[int, int]] = []
    while scored:
        (i, j), (share, mass) = max(scored.items(), key=lambda x: (x[1][0] * math.log1p(x[1][1]), -x[0][0], -x[0][1]))
        del scored[i, j]
        if not (share >= least and mass >= 4.0 or share >= least + 0.2 and mass >= 1.5):
            continue
        links.append((i, j))
        m = M[i, j]
        open_s[i] = open_s[i] * (1 - np.clip(m.max(axis=1) * 1.25, 0, 1))
        open_d[j] = open_d[j] * (1 - np.clip(m.max(axis=0) * 1.25, 0, 1))
        for x in [k for k in scored if k[0] == i or k[1] == j]:
            scored[x] = score(*x)
            if scored[x][1] < 1.5:  # the explained weight can only fall
                del scored[x]
    return sorted(links)


def paragraph_pairs(paragraphs: DataFrame) -> DataFrame:
    """(source_id, target_id, source_text, target_text): originals with their translations.

    The originals' texts are shuffled only if some translation names them (semi-join first).
    """
    p = paragraphs.select("context_id", "orig_context_id", "context")
    t = p.where("orig_context_id is not null").dropDuplicates(["context_id"])
    o = p.select("context_id", "context").join(
        t.select(F.col("orig_context_id").alias("context_id")).distinct(), "context_id", "left_semi"
    ).dropDuplicates(["context_id"])
    t = canonical_column(t, "context", "target_text").select(F.col("context_id").alias("target_id"), F.col("orig_context_id").alias("source_id"), "target_text")
    o = canonical_column(o, "context", "source_text").select(F.col("context_id").alias("source_id"), "source_text")
    return t.join(o, "source_id").where("source_text is not null and target_text is not null")


def aligned_sentences(paragraphs: DataFrame, share: float = 0.003, rounds: int = 6, least: float = 0.5) -> DataFrame:
    """(source_id, source_sent, target_id, target_sent) for all translated paragraphs."""
    pairs = materialize(paragraph_pairs(paragraphs), "pairs")
    counts = document_frequencies(pairs)
    a, b, idf = vocabulary(counts, share)
    bags = word_bags(pairs, a, b)
    table, further, cells = estimate_tables(bags, a, b, rounds)
    table = table.astype(np.float32)
    known = known_words(table)
    texts = pairs.join(rare_translations(bags, counts), ["source_id", "target_id"], "left")
    if further is not None:
        entries, sure_a, sure_b = further_translations(cells, further, a, b)
        sure_b[: table.shape[1]] = known[1]
        known = known[0] | sure_a, sure_b
        texts = texts.join(entries, ["source_id", "target_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: dict[str, str] = {}
        for pdf in batches:
            rows = []
            more = pdf["further"] if "further" in pdf else [None] * len(pdf)
            for s, t, x, y, tail, beyond in zip(pdf["source_id"], pdf["target_id"], pdf["source_text"], pdf["target_text"], pdf["tail"], more):
                own = {(r["a"], r["b"]): r["p"] for r in tail} if tail is not None else {}
                beyond = {(r["a"], r["b"]): r["t"] for r in beyond} if beyond is not None else {}
                rows += [(s, i, t, j) for i, j in align(x, y, a, b, idf, table, least, keys, known, own, beyond)]
            if len(keys) > 500_000:
                keys.clear()
            yield pd.DataFrame(rows, columns=["source_id", "source_sent", "target_id", "target_sent"])

    return texts.mapInPandas(
        run, "source_id string, source_sent int, target_id string, target_sent int")
