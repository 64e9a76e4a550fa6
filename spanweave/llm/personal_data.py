"""Personal information inside free text (problem 10).

Method: candidate gradient boosting. Generators with high recall propose overlapping spans for
each kind; boosted trees score them by format and context features; thresholds calibrated on
held-out candidates select the redactions, and of overlapping spans the most probable stays.

There are no labels, so the trees learn from weak ones: cues in the context label numbers and
addresses, the table of given names (incomplete) labels persons. How often a context word stands
next to such labelled candidates is a feature; that is how persons with other names are found.
Candidates about which the weak labels say nothing are left out of the fit, and are decided by
the trees.

Candidates are proposed once, in one pass over the texts, and written. Context words, common
words and learned names are counted over the candidates of all texts; only the trees are fitted
on those of a bounded sample (``TRAINING_TEXTS``). The counts of all words stay in tables on the
cluster, whatever their number: they are joined with the words of each block of texts, and a
block's candidates are judged with the entries of its own words.

Defined cases: null and empty texts have no items; an item starts at its first character, a
person at the first letter of the name without title. Offsets are code points.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .boosting import Boosted, best_threshold, fit_boosted

#: The trees are fitted on the candidates of at most about this many texts.
TRAINING_TEXTS = 6000
#: With so many candidates a block of texts, whose words are looked up together, is closed.
BLOCK = 20_000
KINDS = ("email", "phone", "id_number", "address", "person")
_SUMS = "kind string, word string, good double, n double"

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_CAP = f"[{_UP}][{_LOW}]+(?:['’-][{_UP}{_LOW}]+)*"
_TE = "[ఀ-౿]+"

_AT = re.compile(r"\s?(?:@|[(\[{<]\s?at\s?[)\]}>])\s?")
_LOCAL = re.compile(r"[\w.+-]")
_TELUGU = re.compile("[ఀ-౿]").search
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?)[\w-]+)*")
_CHAIN = re.compile(r"(?<![\w.+@/-])(?:\+|\()?\d(?:\d|[ .-](?=[\d(])|\) ?(?=\d)){5,}(?![\w@])")
_CODE = re.compile(r"(?<!\w)[A-Z]{5}\d{4}[A-Z](?!\w)")
_ADDRESS = re.compile(
    rf"(?<![\w./-])\d{{1,4}}(?:[-/]\d{{1,4}}){{0,2}},? (?P<road>(?:{_CAP} ){{1,3}}{_CAP}), {_CAP}(?: \d{{6}}(?!\d))?"
    rf"|(?<![\w./-])\d{{1,4}}(?:[-/]\d{{1,4}}){{1,2}}, (?P<te>{_TE}(?: {_TE}){{0,3}}), {_TE}(?: \d{{6}}(?!\d))?"
)
# Titles.
_TITLE_EN = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Smt|Shri|Frau|Herr"
_TITLE_TE = "శ్రీమతి|శ్రీ|డా|ప్రొ|కుమారి"
_PERSON_EN = re.compile(
    rf"(?<![\w@.+-])(?:(?P<title>{_TITLE_EN})\.? )?"
    rf"(?P<name>[{_UP}]{{3,}}, {_CAP}|{_CAP} [{_UP}]\. {_CAP}|[{_UP}]\. {_CAP}|{_CAP} {_CAP}|(?<=\. ){_CAP}|(?<=[rsc] ){_CAP})(?![\w@])"
)
_PERSON_TE = re.compile(rf"(?<![\wఀ-౿])(?:(?P<title>{_TITLE_TE})\.? )(?P<name>{_TE}(?: {_TE})?)")
_TE_PAIR = re.compile(
    rf"(?<=— )(?P<name>{_TE} {_TE})(?= *\n)"
    rf"|(?<![\wఀ-౿])(?P<name2>{_TE} {_TE})(?= (?:గారిని|పేరు మీద|పరిశీలించారు|రాశారు|జవాబులు ఇచ్చారు|ఇల్లు \d))"
)

# Formats of phones and identity numbers, tried within a chain of digits.
_PHONES = [
    r"\+\d{2}[ -]?\d{4,5}[ -]?\d{5,6}", r"00\d{2}-\d{4,5}-\d{5,6}", r"\(\d{3}\) ?\d{3}-\d{4}", r"\d{3}\.\d{3}\.\d{4}",
    r"[0౦]\d{2} \d{4} \d{4}", r"\d{5} \d{5}", r"[0౦]\d{10}",
]
_NUMBERS = [r"\d{4} \d{4} \d{4}", r"\d{4}-\d{4}-\d{4}", r"\d{12}", r"\d{3}-\d{2}-\d{4}"]
_SHAPES = [(re.compile(rf"(?<!\d){p}(?!\d)"), k, i) for i, (p, k) in enumerate([(p, "phone") for p in _PHONES] + [(p, "id_number") for p in _NUMBERS])]

# Cues for the weak labels, lower-cased.
_PHONE_CUES = ("ring", "call", "phone", "tel", "ఫోన్", "నంబరులో", "మెయిల్", "contact", "or")
_ID_CUES = ("identity", "card number", "గుర్తింపు సంఖ్య", "కార్డు", "pay slip", "tax number", "id number")
_PLAIN_CUES = ("పటం సంఖ్య", "shelf mark", "dated", "version", "grid", "ran for", "మంది", "రూపాయ", "plate")
_ROADS = ("street", "road", "lane", "row", "quay", "close", "avenue", "way", "square", "drive", "వీధి", "సందు", "రోడ్డు", "నగర్", "బజారు")
_COLUMNS = {
    "email": ["letter_share", "last_part", "domain_share", "spaced", "length", "left", "right"],
    "phone": ["shape", "digits", "groups", "plus", "paren", "zero", "dots", "dashes", "spaces", "cue", "id_cue", "plain_cue", "left", "right", "line"],
    "id_number": ["shape", "digits", "groups", "plus", "paren", "zero", "dots", "dashes", "spaces", "cue", "id_cue", "plain_cue", "left", "right", "line"],
    "address": ["dash", "slash", "pin", "words", "comma", "number_length", "left", "line"],
    "person": ["title", "form", "left", "right", "line_start", "line_end", "first_common", "telugu", "last_common", "listed"],
}


def _word_before(text: str, at: int) -> str:
    chunk = text[max(0, at - 24) : at]
    if not chunk.rstrip(" ") or chunk.rstrip(" ")[-1:] == "\n":
        return "\n"
    parts = chunk.split()
    if not parts:
        return "\n"
    # A short function word says little by itself.
    return " ".join(parts[-2:] if len(parts[-1]) <= 4 and len(parts) > 1 else parts[-1:])[-16:].lower()


def _word_after(text: str, at: int) -> str:
    chunk = text[at : at + 24]
    if not chunk.strip(" ") or chunk.lstrip(" ")[:1] == "\n":
        return "\n"
    if chunk[0] in ",.;:)":
        return chunk[0]
    parts = chunk.split()
    return parts[0][:12].lower().strip(",.;:") if parts else "\n"


def candidates(text: str, names: frozenset[str]) -> list[tuple]:
    """(kind, start, end, features, left word, right word, weak label or None) of one text.

    Context scores are put into the features later, from the words.
    """
    out: list[tuple] = []
    last_at = 0
    for m in _AT.finditer(text) if "@" in text or "at" in text else ():
        a, b = m.start(), _DOMAIN.match(text, m.end())
        while a > last_at and _LOCAL.match(text, a - 1):
            a -= 1
        if a == m.start() or not b:
            continue
        local, domain = text[a : m.start()].lstrip(".-+"), b.group(0).rstrip(".-")
        last_at = m.end()
        start = m.start() - len(local)
        if not local:
            continue
        letters = any(c.isalpha() for c in local)
        dots = domain.count(".") + domain.count("dot")
        good = letters and dots and any(c.isalpha() for c in domain)
        end = m.end() + len(domain)
        f = [sum(map(str.isalpha, local)) / len(local), len(re.split(r"\W|_", domain)[-1]), sum(map(str.isalpha, domain)) / max(len(domain), 1),
             m.group(0) != "@", min(len(local), 40), 0.0, 0.0]
        out.append(("email", start, end, f, _word_before(text, start), _word_after(text, end), 1 if good else 0))
    for m in _CHAIN.finditer(text):
        chain, at = m.group(0), m.start()
        found = [(x.start() + at, x.end() + at, kind, i) for p, kind, i in _SHAPES for x in p.finditer(chain)]
        found = [x for x in found if x[0] == at or text[x[0] - 1] in " -("]
        # The longest format wins where one holds another; what is left overlaps at most.
        found = [x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0] for y in found)]
        found = found or [(at, m.end(), "phone", 20)]
        for s, e, kind, i in found:
            out.append(_number(text, s, e, kind, i))
    for m in _CODE.finditer(text):
        out.append(_number(text, m.start(), m.end(), "id_number", 30))
    for m in _ADDRESS.finditer(text):
        road = (m.group("road") or m.group("te")).lower()
        last = road.split()[-1]
        left = _word_before(text, m.start())
        number = re.match(r"[\d/-]+", m.group(0)).group(0)
        pin = bool(re.search(r" \d{6}$", m.group(0)))
        f = [number.count("-"), number.count("/"), pin, len(road.split()), m.group(0)[len(number)] == ",", len(number), 0.0, left == "\n"]
        out.append(("address", m.start(), m.end(), f, left, "", 1 if last in _ROADS else 0 if left in ("in", "before", "between", "and") else None))
    last_end, last_left = -9, ""
    for m in _PERSON_EN.finditer(text):
        title, name = m.group("title"), m.group("name")
        parts = name.replace(",", "").split()
        if len(parts) < 2 and not title:
            continue
        form = 3 if "," in name else 2 if name[1] == "." else 1 if len(parts) == 3 else 0 if len(parts) == 2 else 4
        start = m.start("name")
        left, right = _word_before(text, m.start()), _word_after(text, m.end())
        if m.start() - last_end == 5 and text[last_end : m.start()] == " and ":
            left = "& " + last_left  # the second of two joined names has the context of the first
        last_end, last_left = m.end(), left
        given = parts[-1] if form == 3 else parts[0]
        label = 1 if given in names or title or form == 2 else None if form in (1, 3) else 0
        out.append(("person", start, m.end(), [bool(title), form, 0.0, 0.0, left == "\n", right == "\n", 0.0, 0, 0.0, 0.0], left, right, label, given, parts[0] if form == 3 else parts[-1]))
    if _TELUGU(text):
        seen = set()
        for m in _PERSON_TE.finditer(text):
            name, end = m.group("name"), m.end()
            right = _word_after(text, end)
            seen.add(m.start("name"))
            parts = name.split()
            out.append(("person", m.start("name"), end, [1, 0, 0.0, 0.0, 0, right == "\n", 0.0, 1, 0.0, 0.0], _word_before(text, m.start()), right, 1 if set(parts) & names else None, parts[0], parts[-1]))
        for m in _TE_PAIR.finditer(text):
            name = m.group("name") or m.group("name2")
            start, end = m.end() - len(name), m.end()
            if start in seen or any(s < end and start < e for s in seen for e in (s + 12,)):
                continue
            parts = name.split()
            if parts[0] in ("శ్రీమతి", "శ్రీ", "డా"):
                continue
            left, right = _word_before(text, start), _word_after(text, end)
            out.append(("person", start, end, [0, 0, 0.0, 0.0, left in ("\n", "—"), right == "\n", 0.0, 1, 0.0, 0.0], left, right, 1 if set(parts) & names else None, parts[0], parts[-1]))
    return out


def _number(text: str, s: int, e: int, kind: str, shape: int) -> tuple:
    body = text[s:e]
    digits = sum(c.isdigit() for c in body)
    around = text[max(0, s - 28) : s].lower()
    after = text[e : e + 22].lower()
    near = around[-22:]
    phone = any(c in near for c in _PHONE_CUES[:-1]) or any(c in after for c in ("నంబరులో", "ఫోన్", "మెయిల్", "and ask"))
    ident = any(c in near for c in _ID_CUES) and "phone" not in near[-10:]
    plain = any(c in around for c in _PLAIN_CUES) or any(c in after for c in ("visitors", "మంది", "మీటర్లు", " n,", " e ", "hours", "holds"))
    left = _word_before(text, s)
    f = [shape, digits, len(re.findall(r"\d+", body)), body[0] == "+", "(" in body, body[0] in "0౦", body.count("."), body.count("-"), body.count(" "),
         phone, ident, plain, 0.0, 0.0, left == "\n"]
    label = None
    if shape == 20 or plain:
        label = 0
    elif kind == "phone" and phone and not ident or kind == "id_number" and ident:
        label = 1
    elif kind == "phone" and ident or kind == "id_number" and phone and not ident:
        label = 0
    return (kind, s, e, f, left, _word_after(text, e), label)


class Finder:
    """Fitted models, and what is known about words.

    The tables of all words are ``words``; ``context``, ``common`` and ``learned`` are what they
    say about the words at hand (``knowing``).
    """

    def __init__(self, names: frozenset[str]):
        self.names = names
        self.context: dict[str, dict[str, tuple[float, float]]] = {}
        self.common: dict[str, float] = {}
        self.learned: frozenset[str] = frozenset()
        self.models: dict[str, Boosted] = {}
        self.words: DataFrame | None = None
        self.fitted: tuple[DataFrame, DataFrame] | None = None  # proposals and their words

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None, "fitted": None}

    def knowing(self, rows: pd.DataFrame) -> Finder:
        """With the same models, a finder that knows the words of ``rows`` (kind, word, good, n).

        Of kind ``name``, ``good`` is how common the word is, ``n`` whether it is a learned name.
        """
        out = Finder(self.names)
        out.models = self.models
        for kind, part in rows.groupby("kind"):
            if kind == "name":
                out.common = dict(zip(part["word"], part["good"]))
                out.learned = frozenset(part["word"][part["n"] > 0])
            else:
                out.context[kind] = dict(zip(part["word"], zip(part["good"], part["n"])))
        return out

    def _fit_kind(self, kind: str, mine: list[tuple]) -> Boosted:
        rng = np.random.default_rng(7)
        labelled = [r for r in mine if r[6] is not None]
        if kind == "person":
            # An unlisted name beside a word that listed names stand beside says nothing.
            labelled = [r for r in labelled if r[6] or self.nearby(kind, r) < 0.3]
        x = self.features(kind, labelled, fitting=True)
        y = np.array([float(r[6]) for r in labelled])
        if kind == "person" and len(y):
            # Being listed is hidden from half of the rows, so that contexts are learned as well.
            x[rng.random(len(y)) < 0.5, _COLUMNS[kind].index("listed")] = 0.0
        if not len(y) or y.min() == y.max():
            return Boosted(10.0 if len(y) and y.min() == 1 else -10.0, 1, np.full((1, 3), -1), np.zeros((1, 3)))
        # Calibrated on held-out rows: the threshold belongs to the model it was chosen with.
        held = rng.random(len(y)) < 0.25
        if y[~held].min(initial=1) == y[~held].max(initial=0):
            held[:] = False
        model = fit_boosted(x[~held], y[~held])
        model.threshold = best_threshold(model.probability(x[held]), y[held])
        return model

    def score(self, kind: str, word: str, side: str, own: float | None = None) -> float:
        """Share of labelled items among the candidates beside ``word``, without the row's ``own`` label."""
        good, n = self.context.get(kind, {}).get(side + word, (0.0, 0.0))
        if own is not None and n >= 1:  # an unseen word does not count the row's label either
            good, n = good - own, n - 1
        return (good + 0.2) / (n + 1.0)

    def nearby(self, kind: str, r: tuple) -> float:
        """How much the words on either side speak for an item, its own label aside."""
        return max(self.score(kind, r[4], "<", r[6]), self.score(kind, r[5], ">", r[6]))

    def features(self, kind: str, rows: list[tuple], fitting: bool = False) -> np.ndarray:
        columns = _COLUMNS[kind]
        x = np.array([[float(v) for v in r[3]] for r in rows]).reshape(len(rows), len(columns))
        for name, side, k in (("left", "<", 4), ("right", ">", 5)):
            if name in columns and len(rows):
                x[:, columns.index(name)] = [self.score(kind, r[k], side, r[6] if fitting else None) for r in rows]
        if kind == "person" and len(rows):
            known = self.names | self.learned
            x[:, columns.index("listed")] = [r[7] in known or bool(r[3][7]) and r[8] in known for r in rows]
            x[:, columns.index("first_common")] = [self.common.get(r[7], 0.0) for r in rows]
            x[:, columns.index("last_common")] = [self.common.get(r[8], 0.0) for r in rows]
        return x

    def select(self, rows: list[tuple]) -> np.ndarray:
        """Probability of each candidate, 0 where the threshold is not met."""
        p = np.zeros(len(rows))
        for kind in KINDS:
            at = [i for i, r in enumerate(rows) if r[0] == kind]
            if at:
                model = self.models[kind]
                q = model.probability(self.features(kind, [rows[i] for i in at]))
                p[at] = np.where(q > model.threshold, q, 0.0)
        return p

    def choose(self, proposed: list[list[tuple]]) -> list[list[tuple[str, int, int]]]:
        """Of the candidates of each text the selected, non-overlapping items in order."""
        rows, owner = [], []
        for i, found in enumerate(proposed):
            rows += found
            owner += [i] * len(found)
        out: list[list[tuple[str, int, int]]] = [[] for _ in proposed]
        p = self.select(rows)
        by: dict[int, list[int]] = defaultdict(list)
        for k in np.flatnonzero(p > 0):
            by[owner[k]].append(int(k))
        for i, ks in by.items():
            taken: list[tuple[str, int, int]] = []
            for k in sorted(ks, key=lambda k: (-p[k], rows[k][1] - rows[k][2], rows[k][1])):
                kind, s, e = rows[k][:3]
                if all(e <= a or s >= b for _, a, b in taken):
                    taken.append((kind, s, e))
            out[i] = sorted(taken, key=lambda x: x[1])
        return out


def propose(documents: DataFrame, names: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, block, train, found): the pickled candidates of every text that has some.

    ``names`` is the small table of given names (column given_name), fixed in size; ``train``
    marks the sample on which the trees are fitted.
    """
    return _propose(documents, _names(names), text, key, False)


def _propose(documents: DataFrame, known: frozenset[str], text: str, key: str, keep: bool) -> DataFrame:
    """With ``keep`` all rows and their text; ``found`` is null where there are no candidates.

    A block has texts of one task, sampled ones (odd numbers) apart from the others. It ends when
    it has ``BLOCK`` candidates (a kept text counts by its length too), so that what is held at
    once has a bound that does not depend on the rows.
    """
    part = min(1.0, TRAINING_TEXTS / max(documents.count(), 1))
    train = F.pmod(F.xxhash64(key, F.lit("train")), F.lit(1_000_000)) < int(part * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 32
        number, size = [0, 1], [0, 0]
        for pdf in batches:
            rows = []
            for k, t, x in zip(pdf["key"], map(int, pdf["train"]), pdf["text"]):
                found = candidates(x, known) if x else []
                if found or keep:
                    if size[t] >= BLOCK:
                        number[t], size[t] = number[t] + 2, 0
                    if found:
                        size[t] += len(found) + keep * len(x) // 500
                    rows.append((k, task + number[t], bool(t), pickle.dumps(found, 5) if found else None, *([x] if keep else [])))
            yield pd.DataFrame(rows, columns=["key", "block", "train", "found", *(["text"] if keep else [])])

    kind = documents.schema[key].dataType.simpleString()
    texts = documents.select(F.col(key).alias("key"), train.alias("train"), F.col(text).alias("text"))
    return materialize(texts.mapInPandas(run, f"key {kind}, block long, train boolean, found binary" + ", text string" * keep), "proposals")


def _names(names: DataFrame) -> frozenset[str]:
    return frozenset(r[0] for r in names.select("given_name").where("given_name is not null").collect())


def _add(sums: dict, kind: str, word: str, good: float, n: float = 1.0) -> None:
    entry = sums.setdefault((kind, word), [0.0, 0.0])
    entry[0] += good
    entry[1] += n


def _block_words(proposals: DataFrame) -> DataFrame:
    """(block, kind, word, good, n): the words beside each block's candidates with sums of the labels, and its names (kind ``name``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blocks: dict[int, dict] = defaultdict(dict)
            for block, b in zip(pdf["block"], pdf["found"]):
                sums = blocks[block]
                for r in pickle.loads(b):
                    for word in ("<" + r[4], ">" + r[5]):
                        _add(sums, r[0], word, r[6] or 0.0, r[6] is not None)
                    for word in r[7:9]:
                        _add(sums, "name", word, 0.0, 0.0)
            yield pd.DataFrame([(block, *k, *v) for block, sums in blocks.items() for k, v in sums.items()], columns=["block", "kind", "word", "good", "n"])

    return materialize(proposals.select("block", "found").mapInPandas(run, f"block long, {_SUMS}"), "words")


def _known(own: DataFrame, *tables: DataFrame) -> DataFrame:
    """(block, kind, word, good, n): what the tables (kind, word, good, n) say about each block's own words."""
    return own.select("block", "kind", "word").join(reduce(DataFrame.unionByName, tables), ["kind", "word"])


def _by_block(proposals: DataFrame, known: DataFrame, finder: Finder, use, schema: str) -> DataFrame:
    """What ``use`` makes of the texts of each block, with the finder that knows the block's words."""
    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        return use(finder.knowing(words), texts)

    return proposals.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(run, schema)


def _name_sums(proposals: DataFrame, known: DataFrame, finder: Finder, count) -> DataFrame:
    """(word, good, n): sums of what ``count`` adds for the names of all persons."""
    def use(knowing: Finder, texts: pd.DataFrame) -> pd.DataFrame:
        sums: dict[tuple[str, str], list[float]] = {}
        rows = [r for b in texts["found"] for r in pickle.loads(b) if r[0] == "person"]
        count(knowing, rows, sums)
        return pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["kind", "word", "good", "n"])

    sums = _by_block(proposals.select("block", "found"), known, finder, use, _SUMS)
    return sums.groupBy("word").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))


def _common(finder: Finder, rows: list[tuple], sums: dict) -> None:
    for r in rows:
        if r[6] == 0 and finder.nearby("person", r) < 0.3:
            for w in r[7:9]:
                _add(sums, "name", w, 0.0)


def _votes(finder: Finder, rows: list[tuple], sums: dict) -> None:
    for r, q in zip(rows, finder.models["person"].probability(finder.features("person", rows))):
        for w in {r[7], r[8]} if r[3][7] else {r[7]}:
            _add(sums, "name", w, float(q))


def fit_finder(proposals: DataFrame, names: DataFrame) -> Finder:
    """The finder of a corpus from its ``propose``d candidates."""
    finder = Finder(_names(names))
    own = _block_words(proposals)
    context = materialize(
        own.where("kind != 'name'").groupBy("kind", "word").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).where("n > 0"), "context")
    size = proposals.agg(F.count("*").alias("n"), F.count_if("train").alias("t")).first()
    part = size["t"] / max(size["n"], 1)

    # Counts in proportion to the sample, so that they mean the same at every size.
    words = _name_sums(proposals, _known(own, context), finder, _common).where(F.col("n") * part > 1)
    common = materialize(words.select(F.lit("name").alias("kind"), "word", F.log1p(F.col("n") * part).alias("good"), F.lit(0.0).alias("n")), "common")

    sample: dict[str, list[tuple]] = defaultdict(list)
    for b in proposals.where("train").select("found").toLocalIterator():
        for r in pickle.loads(b["found"]):
            sample[r[0]].append(r)

    def with_sample(names: DataFrame) -> Finder:
        """The finder that knows the words of the sample, which bounds them."""
        return finder.knowing(_known(own.where("block % 2 = 1"), context, names).drop("block").distinct().toPandas())

    fitting = with_sample(common)
    for kind in KINDS:
        finder.models[kind] = fitting._fit_kind(kind, sample[kind])

    # Names that stand where listed names stand are learned; then the trees are fitted again.
    words = _name_sums(proposals, _known(own, context, common), finder, _votes).where((F.col("n") >= 2) & (F.col("good") / F.col("n") > 0.6))
    learned = words.select("word", F.lit(1.0).alias("n")).join(common.select("word", "good"), "word", "full")
    usual = F.coalesce("good", F.lit(0.0))
    named = materialize(learned.select(
        F.lit("name").alias("kind"), "word", usual.alias("good"), F.when(usual < 3, F.coalesce("n", F.lit(0.0))).otherwise(0.0).alias("n")), "names")
    finder.models["person"] = with_sample(named)._fit_kind("person", sample["person"])
    finder.words, finder.fitted = context.unionByName(named), (proposals, own)
    return finder


def _selected(proposals: DataFrame, finder: Finder, use, schema: str) -> DataFrame:
    """What ``use`` makes of rows and their items, for every block."""
    def run(knowing: Finder, texts: pd.DataFrame) -> pd.DataFrame:
        parts = [texts.iloc[at : at + 500] for at in range(0, len(texts), 500)]
        return pd.concat([use(part, knowing.choose([pickle.loads(b) for b in part["found"]])) for part in parts])

    own = finder.fitted[1] if finder.fitted and finder.fitted[0] is proposals else _block_words(proposals)
    return _by_block(proposals, _known(own, finder.words), finder, run, schema)


def find_items(proposals: DataFrame, finder: Finder, key: str = "doc_id") -> DataFrame:
    """(key, kind, char_start, char_end) of every item."""
    def items(part: pd.DataFrame, found: list[list[tuple]]) -> pd.DataFrame:
        rows = [(k, *item) for k, of in zip(part["key"], found) for item in of]
        return pd.DataFrame(rows, columns=["key", "kind", "char_start", "char_end"])

    kind = proposals.schema["key"].dataType.simpleString()
    return _selected(proposals, finder, items, f"key {kind}, kind string, char_start long, char_end long").withColumnRenamed("key", key)


def redact(documents: DataFrame, finder: Finder, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) with every item replaced by ``[KIND]`` and all else unchanged."""
    def replaced(part: pd.DataFrame, found: list[list[tuple]]) -> pd.DataFrame:
        out = []
        for t, items in zip(part["text"], found):
            for kind, a, b in reversed(items):
                t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
            out.append(t)
        return pd.DataFrame({"key": part["key"], "text": out})

    rows = _propose(documents, finder.names, text, key, True)
    kind = documents.schema[key].dataType.simpleString()
    done = _selected(rows.where("found is not null"), finder, replaced, f"key {kind}, text string")
    return rows.where("found is null").select("key", "text").unionByName(done).withColumnRenamed("key", key)
