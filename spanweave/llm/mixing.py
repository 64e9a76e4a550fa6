"""Mixing sources to target weights (problem 9).

Method: soft-membership mixing. A text whose source is a target belongs to it with certainty.
Every other text (source null, or not a target) gets the posterior over the targets of a
classifier that is trained on the labelled texts (naive Bayes on hashed words), in units of
1/``UNITS``. Nonnegative rates of the documents are then fitted by projected gradient on the
weighted least squares of expected tokens against goals: each step moves a document's rate by
its membership times the sources' residuals and projects it onto [0, its allowed repeats].

Documents of equal membership and cap have equal steps throughout, so they share a rate. The
distributed part is one aggregate over all documents to the token mass of each membership; the
steps then need nothing but these masses. With K targets there are at most C(K + 3, 4)
memberships, whatever the number of documents.

Rates become whole repeats: for texts of soft membership by a hash of the id; the labelled ones
take up what that leaves of each source's goal, by a hash threshold from two histograms, and a
subset-sum over documents that still may be repeated closes what the threshold leaves. One
membership and one cap hold throughout: the shares count a text by its membership, as the fit
does.

The size of the mixture is the largest at which the labelled texts of every present source can
meet its share within the allowed repeats, lowered by up to half where sources of at most
``_FEW`` texts could not be put together to their share otherwise; or it is given. Targets of sources without texts
cannot be met; the others' shares are scaled to sum to 1, and the report shows all of them.

Defined cases: null or empty text has no tokens and is left out; a text of soft membership may
be repeated as often as the strictest of its sources allows; target rows with null or
nonpositive share count as 0, repeated ones are added up; without any present target the
mixture is empty; ties of the hash are kept together, those of size are broken by id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .token_sizes import token_count

FEATURES = 4096
#: The classifier is fitted on at most about this many labelled texts.
TRAINING_TEXTS = 4000
#: Memberships are multiples of 1 / UNITS.
UNITS = 4
_BINS = 4096
#: Sources of at most this many texts are rounded by subset-sum alone.
_FEW = 64
#: Documents a source that one subset-sum looks at; further ones follow in the next.
_CLOSING = 1024


def hashed_words(text: str | None) -> np.ndarray:
    """Counts of hashed words."""
    import zlib

    words = re.findall(r"[^\W\d_]{2,}", text.lower()) if text else []
    return np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES for w in words], minlength=FEATURES) if words else np.zeros(FEATURES, int)


def fit_posteriors(labelled: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities (domains x features) and log priors, from (text, source)."""
    index = {d: i for i, d in enumerate(domains)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((len(domains), FEATURES)), np.zeros(len(domains))
        for pdf in batches:
            for text, source in zip(pdf["text"], pdf["source"]):
                if source in index:
                    sums[index[source]] += np.minimum(hashed_words(text), 1)
                    n[index[source]] += 1
        for i in np.flatnonzero(n):
            yield pd.DataFrame({"domain": [i], "n": [n[i]], "counts": [sums[i]]})

    sums, n = np.ones((len(domains), FEATURES)), np.ones(len(domains))
    for r in labelled.select("text", "source").mapInPandas(count, "domain int, n double, counts array<double>").toLocalIterator():
        sums[r["domain"]] += np.array(r["counts"])
        n[r["domain"]] += r["n"]
    return np.log(sums / sums.sum(axis=1, keepdims=True)), np.log(n / n.sum())


def posteriors(text: str | None, model: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Posterior over the domains; the evidence is tempered by the text's length."""
    x = np.minimum(hashed_words(text), 1)
    z = prior + (model @ x) / max(1.0, np.sqrt(x.sum()))
    p = np.exp(z - z.max())
    return p / p.sum()


def in_units(p: np.ndarray) -> np.ndarray:
    """A posterior as whole units that add up to ``UNITS``: largest remainders, ties by position."""
    scaled = p * UNITS
    units = np.floor(scaled + 1e-9).astype(int)
    short = UNITS - units.sum()
    units[np.argsort(-(scaled - units), kind="stable")[:short]] += 1
    return units


def membership_key(units: np.ndarray) -> str:
    return ",".join(f"{k}:{u}" for k, u in enumerate(units) if u)


def membership(key: str, k: int) -> np.ndarray:
    p = np.zeros(k)
    for part in key.split(","):
        at, units = part.split(":")
        p[int(at)] = int(units) / UNITS
    return p


def fit_rates(mass: np.ndarray, P: np.ndarray, caps: np.ndarray, goal: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Rates r in [0, caps] that minimize sum_k ((P' (mass r))_k - goal_k)**2 / M_k.

    ``P``: memberships (classes x sources), ``mass``: tokens of each class, M = P' mass. In the
    metric of the masses the objective's curvature is at most 1, so the gradient step of
    length 1 never overshoots.
    """
    M = np.maximum(P.T @ mass, 1e-9)
    rates = np.minimum(goal.sum() / max(mass.sum(), 1e-9), caps)
    for _ in range(rounds):
        residual = goal - P.T @ (mass * rates)
        moved = np.clip(rates + P @ (residual / M), 0, caps)
        if np.abs(moved - rates).max(initial=0) < 1e-9:
            break
        rates = moved
    return rates


def nearest_sum(sizes: list[int], spare: list[int], want: float) -> list[int]:
    """How often to take each size, at most ``spare`` times, so that the sum is nearest to ``want``.

    Second and further copies are used only where single ones cannot come within 0.1 % of it.
    """
    want = int(round(want))
    taken = [0] * len(sizes)
    if want <= 0 or not sizes:
        return taken
    full = (1 << 2 * want + 1) - 1
    reach, items = [1], []

    def off() -> int:
        return next(d for d in range(want + 1) if reach[-1] >> (want - d) & 1 or reach[-1] >> (want + d) & 1)

    for copy in range(max(spare)):
        for i, n in enumerate(sizes):
            if copy < spare[i]:
                items.append(i)
                reach.append((reach[-1] | reach[-1] << n) & full)
        if off() <= 0.001 * want:
            break
    left = want - off() if reach[-1] >> (want - off()) & 1 else want + off()
    for k in range(len(items) - 1, -1, -1):
        if not reach[k] >> left & 1:
            taken[items[k]] += 1
            left -= sizes[items[k]]
    return taken


def reachable(sizes: list[int], cap: int) -> int:
    """The sums that texts of these sizes can have, each taken at most ``cap`` times, as bits."""
    bits = 1
    for n in sizes:
        for _ in range(cap):
            bits |= bits << n
    return bits


def _gap(bits: int, want: int) -> int:
    """Distance from ``want`` to the nearest sum."""
    above = bits >> want
    up = (above & -above).bit_length() - 1 if above else want
    below = bits & (1 << want + 1) - 1
    return min(up, want - (below.bit_length() - 1))


def best_total(most: int, goal_share: dict[str, float], few: dict[str, int], steps: int = 200) -> int:
    """The largest of ``steps`` totals from half of ``most`` up for which the fewest sources of
    few texts (``few``: their reachable sums) miss their goal by more than 0.5 %."""
    def misses(total: int) -> int:
        return sum(_gap(bits, round(goal_share[d] * total)) > 0.005 * goal_share[d] * total for d, bits in few.items())

    totals = [most - most * k // (2 * steps) for k in range(steps)]
    return min(totals, key=lambda t: (misses(t), -t))


def mix(
    documents: DataFrame, targets: DataFrame, total: int | None = None, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: doc_id, domain (its source, or the likeliest one), soft (whether by membership),
    n_tokens, rate, repeats, for every text with at least one repeat. shares: source,
    target_share, goal_share (scaled to the sources that have texts), n_tokens (by membership),
    actual_share, max_repeats, met (within 1 % of the goal).
    """
    spark = documents.sparkSession
    # The target table is a configuration of fixed size: one row for each source.
    goals = targets.where("source is not null").groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")
    ).orderBy("source").collect()
    domains = [g["source"] for g in goals]
    K = len(domains)
    share, cap = np.array([g["share"] for g in goals], float), np.array([g["cap"] for g in goals], float)
    known = F.col("source").isin(domains) if domains else F.lit(False)
    sized = materialize(
        documents.select("doc_id", "source", token_count("text", folder).alias("n"))
        .withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(_BINS * _BINS))), "mix"
    ).where("n > 0")  # only after writing, or the tokens would be counted for the filter as well
    hard = sized.where(known).select("doc_id", F.col("source").alias("domain"), "n", "u")
    stats = {r["domain"]: r for r in hard.groupBy("domain").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()}
    tokens = np.array([stats[d]["n"] if d in stats else 0 for d in domains], float)
    docs = np.array([stats[d]["docs"] if d in stats else 0 for d in domains], int)
    present = (tokens > 0) & (share > 0)
    goal_share = np.where(present, share, 0) / max(share[present].sum(), 1e-12) if present.any() else share * 0
    if total is None:
        total = int(min((cap * tokens)[present] / goal_share[present])) if present.any() else 0
        small = [d for d, n, p in zip(domains, docs, present) if p and n <= _FEW]
        sizes = hard.where(F.col("domain").isin(small)).groupBy("domain").agg(F.collect_list("n").alias("n")).collect() if small else []
        caps = dict(zip(domains, cap.astype(int)))
        total = best_total(total, dict(zip(domains, goal_share)), {r["domain"]: reachable(r["n"], caps[r["domain"]]) for r in sizes})
    goal = goal_share * total

    soft = _soft_members(documents, sized, known, domains, present, cap, int(docs.sum()))
    masses = {r["key"]: float(r["n"]) for r in soft.groupBy("key").agg(F.sum("n").alias("n")).collect()}
    keys = list(masses)
    P = np.vstack([np.eye(K)[present], *(membership(k, K) for k in keys)]) if present.any() else np.zeros((0, K))
    mass = np.array([*tokens[present], *masses.values()])
    top = np.array([*cap[present], *(min(cap[np.flatnonzero(membership(k, K))]) for k in keys)])
    rates = fit_rates(mass, P, top, goal) if present.any() else np.zeros(0)
    soft_rates = dict(zip(keys, rates[int(present.sum()) :]))

    by_key = spark.createDataFrame([(k, float(r)) for k, r in soft_rates.items()], "key string, rate double")
    soft = soft.join(F.broadcast(by_key), "key").withColumn(
        "repeats", F.floor("rate").cast("int") + (F.col("u") < (F.col("rate") - F.floor("rate")) * (_BINS * _BINS)).cast("int")
    )
    taken = np.zeros(K)
    for r in soft.groupBy("key").agg(F.sum(F.col("n") * F.col("repeats")).alias("n")).collect():
        taken += membership(r["key"], K) * (r["n"] or 0)
    hard = _round_labelled(hard, domains, tokens, docs, cap, goal - taken)
    mixture = hard.withColumn("soft", F.lit(False)).unionByName(soft.withColumn("soft", F.lit(True)).drop("key")).where("repeats > 0").select(
        "doc_id", "domain", "soft", F.col("n").alias("n_tokens"), "rate", "repeats"
    )

    by_label = {r["domain"]: float(r["n"]) for r in hard.groupBy("domain").agg(F.sum(F.col("n") * F.col("repeats")).alias("n")).collect()}
    got = taken + np.array([by_label.get(d, 0.0) for d in domains]) if K else taken
    whole = max(got.sum(), 1e-9)
    shares = spark.createDataFrame(
        [(d, float(s), round(float(g), 6), float(t), round(float(t / whole), 6), int(c), bool(abs(t / whole - g) <= 0.01 * g))
         for d, s, g, t, c in zip(domains, share, goal_share, got, cap)],
        "source string, target_share double, goal_share double, n_tokens double, actual_share double, max_repeats int, met boolean",
    )
    return mixture, shares


def _soft_members(documents: DataFrame, sized: DataFrame, known, domains: list[str], present: np.ndarray, cap: np.ndarray, labelled: int) -> DataFrame:
    """(doc_id, key, domain, n, u) of the texts without a target source."""
    schema = "doc_id long, key string, domain string"
    if not present.any():
        return sized.where("false").select("doc_id", F.lit("").alias("key"), F.lit("").alias("domain"), "n", "u")
    part = min(1.0, TRAINING_TEXTS / max(labelled, 1))
    sample = documents.where(known & (F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(part * 1_000_000)))
    model, prior = fit_posteriors(sample, domains)
    prior = np.where(present, prior, -1e9)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = [in_units(posteriors(t, model, prior)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": [membership_key(u) for u in units], "domain": [domains[int(u.argmax())] for u in units]})

    unknown = documents.where(F.col("text").isNotNull() & ~F.coalesce(known, F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(unknown.mapInPandas(members, schema).join(sized.select("doc_id", "n", "u"), "doc_id"), "soft")


def _round_labelled(hard: DataFrame, domains: list[str], tokens: np.ndarray, docs: np.ndarray, cap: np.ndarray, need: np.ndarray) -> DataFrame:
    """(doc_id, domain, n, u, rate, repeats): whole repeats that add up to ``need`` in each domain.

    All texts of a domain get the whole part of its rate; one more goes to those whose hash is
    below a threshold, which two histograms of bounded size place; the rest is closed by a
    subset-sum over the largest texts that fit into it, each up to its cap.
    """
    spark = hard.sparkSession
    need = np.maximum(need, 0)
    rate = np.where(tokens > 0, np.minimum(need / np.maximum(tokens, 1), cap), 0)
    base = np.floor(rate + 1e-12)
    more = np.where(tokens > 0, np.minimum(need, cap * tokens) - base * tokens, 0)
    cut = {d: 0 for d in domains}
    left = dict(zip(domains, more))
    wide = [d for d, n, x in zip(domains, docs, more) if n > _FEW and x > 0]
    if wide:
        at = hard.where(F.col("domain").isin(wide)).withColumn("bin", F.floor(F.col("u") / _BINS))
        coarse = at.groupBy("domain", "bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
        bins = []
        for d, h in coarse.groupby("domain"):
            upto = h["n"].cumsum().to_numpy()
            k = min(int(np.searchsorted(upto, left[d], side="right")), len(h) - 1)
            left[d] -= float(upto[k] - h["n"].iloc[k])
            bins.append((d, int(h["bin"].iloc[k])))
            cut[d] = bins[-1][1] * _BINS
        fine = at.join(F.broadcast(spark.createDataFrame(bins, "domain string, bin long")), ["domain", "bin"]).groupBy("domain", "u").agg(F.sum("n").alias("n"))
        for d, h in fine.toPandas().sort_values("u").groupby("domain"):
            for u, n in zip(h["u"], h["n"]):
                if n > left[d]:
                    break
                left[d] -= n
                cut[d] = int(u) + 1
    levels = F.broadcast(spark.createDataFrame(
        [(d, float(r), int(b), int(cut[d]), int(c)) for d, r, b, c in zip(domains, rate, base, cap)],
        "domain string, rate double, base int, cut long, cap int"))
    placed = hard.join(levels, "domain").withColumn("whole", F.col("base") + (F.col("u") < F.col("cut")).cast("int"))
    added: list[tuple[int, int]] = []
    open_ = {d: x for d, x in left.items() if x >= 1}
    while open_:
        gaps = F.broadcast(spark.createDataFrame([(d, float(x)) for d, x in open_.items()], "domain string, gap double"))
        rest = placed.join(gaps, "domain").where((F.col("whole") < F.col("cap")) & (F.col("n") <= 2 * F.col("gap")))
        if added:
            rest = rest.join(F.broadcast(spark.createDataFrame(added, "doc_id long, more int")), "doc_id", "left_anti")
        # Ranked within hash parts first, so that no task holds all texts of a source.
        order = (F.desc("n"), F.col("doc_id"))
        part = Window.partitionBy("domain", F.pmod("u", F.lit(64))).orderBy(*order)
        few = rest.withColumn("k", F.row_number().over(part)).where(F.col("k") <= _CLOSING)
        few = few.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where(F.col("k") <= _CLOSING)
        few = few.select("domain", "doc_id", "n", (F.col("cap") - F.col("whole")).cast("int").alias("spare")).toPandas()
        still: dict[str, float] = {}
        for d, h in few.sort_values(["n", "doc_id"], ascending=[False, True]).groupby("domain"):
            sizes, spare = h["n"].tolist(), h["spare"].tolist()
            often = nearest_sum(sizes, spare, open_[d])
            added += [(int(k), m) for k, m in zip(h["doc_id"], often) if m]
            gap = open_[d] - sum(n * m for n, m in zip(sizes, often))
            if len(h) == _CLOSING and often == spare and gap >= 1:
                still[d] = gap  # all of them are in, and more may follow
        open_ = still
    if added:
        extra = F.broadcast(spark.createDataFrame(added, "doc_id long, more int"))
        placed = placed.join(extra, "doc_id", "left").withColumn("whole", F.col("whole") + F.coalesce("more", F.lit(0)))
    return placed.select("doc_id", "domain", "n", "u", "rate", F.col("whole").cast("int").alias("repeats"))
