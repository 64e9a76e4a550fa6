"""Same or nearly the same records across splits (problem 7).

Method: an exact prefix-filter join of shingle sets. All records order their shingles alike,
from those of the rarest words to those of the commonest. Two records with the required
Jaccard similarity share so much that they share a shingle already among the first few of
each (the prefix, whose length follows from the similarity), or ``agree`` shingles if the
prefix is longer by ``agree - 1``; these are the buckets. No pair is lost, however common its
words are, and as prefixes hold the rarest shingles, unrelated records seldom meet. Buckets
pair train records with validation or test records only; pairs whose sizes or shared prefix
shingles cannot reach the similarity are dropped, the exact, unweighted Jaccard similarity of
the others is then verified, and the pairs can be counted by split and source.

Exact copies (the same words in the same order) form a class: buckets and verification see its
representative once. ``cross_split_classes`` gives the pairs of classes and the membership,
whose size is that of the input; only ``cross_split_pairs`` writes out the pairs of members.
Null texts and texts below ``least_words`` words have no pairs. Nothing is capped or sampled.

A bucket that many train records have is cut into salted parts, so that no task holds it whole.

Only words and hashes leave the Python stages; texts are never shuffled, except that those of
candidate records are read again for the verification.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .unicode_forms import canonical

#: Hash slots of the ids that the second read keeps; at most this many are broadcast.
SLOTS = 1 << 19
#: A bucket with more train records than this is cut into salted parts of about this size.
HOT_ROWS = 10_000
#: The filter of buckets has this many bits (as a power of 2): 4 MB.
FILTER_BITS = 25
_BLOCKS = 64
_KEPT = 500_000


class Words:
    """Words of texts, memoized by the raw token: what stands between white space, in the usual
    spelling, lowered, keeping letters, marks and digits."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[str, ...]] = {}

    def _clean(self, token: str) -> tuple[str, ...]:
        usual = canonical(token).lower().split()
        words = ("".join(c for c in w if unicodedata.category(c)[0] in "LMN") for w in usual)
        out = self._known[token] = tuple(w for w in words if w)
        return out

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        known, out = self._known, []
        if len(known) > _KEPT:
            known.clear()
        for token in text.split():
            words = known.get(token)
            if words is None:
                words = self._clean(token)
            out += words
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words_of, seen, n = Words(), Counter(), 0
    for pdf in batches:
        for text in pdf["text"]:
            words = set(words_of(text))
            n += bool(words)
            seen.update(words)
        if len(seen) > _KEPT:
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
            seen.clear()
    yield pd.DataFrame({"word": [*seen, ""], "n": [*seen.values(), n]})


def common_words(df: DataFrame, share: float = 0.002) -> dict[str, float]:
    """Words in at least ``share`` of all texts, with their document share.

    At most (mean number of distinct words per text) / share words qualify, however many texts
    there are; that bound is what makes the result fit on the driver and in each task.
    """
    counts = df.select("text").mapInPandas(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    total = (counts.where("word = ''").first() or {"n": 0})["n"]
    rows = counts.where("word <> ''").where(F.col("n") >= share * total).collect()
    return {r["word"]: r["n"] / total for r in rows}


class Shingler:
    """Distinct shingle hashes of texts and the rarity of their words."""

    def __init__(self, width: int, common: dict[str, float], common_share: float):
        import xxhash

        self._hash = xxhash.xxh64_intdigest
        self.words, self.width = Words(), width
        self.rare = float(-np.log(common_share / 2))
        self.idf = {w: float(-np.log(min(p, 0.999))) for w, p in common.items()}
        self.ids: dict[str, tuple[int, float]] = {}

    def __call__(self, words: list[str]):
        """Hashes of the distinct shingles and the idf sums of their words: arrays, or sequences for single words."""
        width, ids = self.width, self.ids
        if len(ids) > _KEPT:
            ids.clear()
        pairs = []
        for w in words:
            p = ids.get(w)
            if p is None:
                p = ids[w] = (self._hash(w), self.idf.get(w, self.rare))
            pairs.append(p)
        if width == 1:
            return tuple(zip(*set(pairs)))
        h = np.array([p[0] for p in pairs], np.uint64)
        s = np.array([p[1] for p in pairs], np.float32)
        n = len(words) - width + 1
        with np.errstate(over="ignore"):
            mixed, weight = h[:n], s[:n]
            for k in range(1, width):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) ^ (mixed >> np.uint64(29)) ^ h[k : k + n]
                weight = weight + s[k : k + n]
        out, first = np.unique(_mix(mixed), return_index=True)
        return out, weight[first]


def least_shared(n: int, similarity: float) -> int:
    """Of ``n`` shingles, how many any record with the required similarity shares at least."""
    return max(1, math.ceil(similarity * n - 1e-9))


def prefix_keys(grams: Sequence[int], rarity: Sequence[float], similarity: float, agree: int = 1) -> list[int]:
    """Bucket keys of one record: two records with the required similarity have one in common.

    With m shared shingles at least, the first ``agree`` shared ones are among the first
    n - m + agree of either record, in any order that both follow. Where so few are shared that
    ``agree`` is too much, both have keys of fewer shingles.
    """
    n = len(grams)
    m = least_shared(n, similarity)
    order = np.lexsort((np.asarray(grams, np.uint64), -np.asarray(rarity))) if n > 32 else sorted(range(n), key=lambda i: (-rarity[i], grams[i]))
    first = [int(grams[i]) for i in order[: n - m + agree]]
    if agree == 1:
        return [hash((1, g)) for g in first]
    out = []
    for k in range(min(agree, least_shared(m, similarity)), min(agree, m) + 1):  # m is also the least size of a similar record
        out += [hash((k, *c)) for c in combinations(first[: n - m + k], k)]
    return out


def _signer(make: Callable[[], Shingler], similarity: float, agree: int, least_words: int, bits: np.ndarray | None = None) -> Callable:
    """Rows (id, rep, n, buckets) of records; only buckets in the bitmap ``bits``, if there is one."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingle = make()
        for pdf in batches:
            keep, reps, sizes, keys = [], [], [], []
            for i, text in enumerate(pdf["text"]):
                words = shingle.words(text)
                if len(words) < max(least_words, shingle.width):
                    continue
                grams, rarity = shingle(words)
                keep.append(i)
                reps.append(xxhash.xxh64_intdigest(" ".join(words)))
                sizes.append(len(grams))
                keys.append(prefix_keys(grams, rarity, similarity, agree))
            out = pdf.iloc[keep][["id"]].copy()
            out["rep"] = np.array(reps, np.uint64).view(np.int64)
            out["n"] = np.array(sizes, np.int32)
            out["buckets"] = pd.Series(_kept(keys, bits) if keep else [], out.index, dtype=object)
            yield out

    return sign


def _kept(keys: list[list[int]], bits: np.ndarray | None) -> list[np.ndarray]:
    """Mixed keys of each record, without those that the bitmap does not have."""
    mixed = _mix(np.array([k for ks in keys for k in ks], np.int64).view(np.uint64))
    bounds = np.cumsum([len(ks) for ks in keys])
    if bits is not None:
        k = mixed >> np.uint64(64 - FILTER_BITS)
        on = (bits[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63)) & np.uint64(1)).astype(bool)
        mixed, bounds = mixed[on], np.cumsum(on)[bounds - 1]
    return np.split(mixed.view(np.int64), bounds[:-1])


def _setter(make: Callable[[], Shingler]) -> Callable:
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = make()
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["rep"], "grams": [np.array(shingle(shingle.words(t))[0], np.uint64).view(np.int64) for t in pdf["text"]]})

    return sets


def _bucket_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    for pdf in batches:
        if len(pdf):
            k = np.concatenate(pdf["buckets"].to_numpy()).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            np.bitwise_or.at(bits, (k >> np.uint64(6)).astype(np.int64), np.uint64(1) << (k & np.uint64(63)))
    blocks = [(i, b.tobytes()) for i, b in enumerate(bits.reshape(_BLOCKS, -1)) if b.any()]
    yield pd.DataFrame(blocks, columns=["block", "bits"])


def _any_bits(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint64) for b in pdf["bits"]])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [bits.tobytes()]})


def bucket_filter(signed: DataFrame) -> np.ndarray:
    """A bitmap of the buckets of ``signed``: 2**FILTER_BITS bits whatever the number of rows.

    With very many rows it fills up and filters less, but never loses a bucket.
    """
    schema = "block int, bits binary"
    rows = signed.select("buckets").mapInPandas(_bucket_bits, schema).groupBy("block").applyInPandas(_any_bits, schema)
    bits = np.zeros((_BLOCKS, (1 << FILTER_BITS - 6) // _BLOCKS), np.uint64)
    for r in rows.collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint64)
    return bits.ravel()


def _meetings(trained: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``trained`` (bucket, a, n_a) and ``asked`` (bucket, b, n_b) that share a bucket.

    Buckets with more than ``HOT_ROWS`` train records, of which there can be at most (keys /
    ``HOT_ROWS``), are cut by a hash of the record; their evaluation records go to every part.
    """
    count = trained.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS)
    hot = materialize(count.join(asked.select("bucket"), "bucket", "left_semi").select("bucket", F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        return trained.join(asked, "bucket")
    parts = F.broadcast(hot)
    trained = trained.join(parts, "bucket", "left").withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), "parts")).cast("int"))
    asked = asked.join(parts, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return trained.drop("parts").join(asked.drop("parts"), ["bucket", "salt"])


def cross_split_classes(
    df: DataFrame, width: int, similarity: float, agree: int = 1, least_words: int = 1, common_share: float = 0.002
) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a: train side, b: evaluation side, jaccard) and members (id, rep, train).

    ``df``: id, split, text. A class that has records on both sides is a pair with itself.
    ``width``: words per shingle; ``similarity``: least exact Jaccard similarity of the shingle
    sets; ``agree``: shingles in a bucket key. More make fewer chance meetings but more keys, and
    change no result.
    """
    base = df.where("text is not null").select("id", (F.col("split") == "train").alias("train"), "text")
    common = common_words(base, common_share)

    def make() -> Shingler:
        return Shingler(width, common, common_share)

    def sign(rows: DataFrame, name: str, bits: np.ndarray | None = None) -> DataFrame:
        schema = "id string, rep long, n int, buckets array<long>"
        return materialize(rows.select("id", "text").mapInPandas(_signer(make, similarity, agree, least_words, bits), schema), name)

    # Train buckets that no evaluation record has are dropped at once.
    evals = sign(base.where("not train"), "evals")
    train = sign(base.where("train"), "train", bucket_filter(evals))
    signed = train.select("id", "rep", F.lit(True).alias("train")).unionByName(evals.select("id", "rep", F.lit(False).alias("train")))

    def exploded(rows: DataFrame, rep: str, n: str) -> DataFrame:
        keys = rows.select(F.col("rep").alias(rep), F.col("n").alias(n), F.explode("buckets").alias("bucket"))
        return keys.repartition("bucket").dropDuplicates(["bucket", rep])

    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    met = (
        _meetings(exploded(train, "a", "n_a"), exploded(evals, "b", "n_b"))
        .where((F.col("a") != F.col("b")) & (small >= similarity * large - 1e-9))
        .groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.count("*").alias("n_met"))
    )
    if agree == 1:
        # Beyond the shingles that meet, the shared ones follow the prefix of either record.
        rest = F.ceil(similarity * large - 1e-9) - 1
        met = met.where(F.col("n_met") + rest >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    candidates = materialize(met.select("a", "b"), "candidates")
    wanted = candidates.select(F.col("a").alias("rep")).union(candidates.select("b")).distinct()
    wanted = materialize(signed.select("id", "rep").join(wanted, "rep", "left_semi").groupBy("rep").agg(F.min("id").alias("id")), "wanted")
    # The second read: only texts in a wanted hash slot are shuffled, by id.
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int").alias("slot")
    slots = F.broadcast(wanted.select(slot).distinct())
    read = base.select("id", "text", slot).join(slots, "slot", "left_semi").drop("slot").join(wanted.hint("merge"), "id")
    sets = materialize(read.select("rep", "text").mapInPandas(_setter(make), "rep long, grams array<long>").dropDuplicates(["rep"]), "sets")
    inter = F.size(F.array_intersect("grams_a", "grams_b"))
    verified = (
        candidates.join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("grams_a")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("grams").alias("grams_b")), "b")
        .select("a", "b", (inter / (F.size("grams_a") + F.size("grams_b") - inter)).alias("jaccard"))
        .where(F.col("jaccard") >= similarity)
    )
    members = signed.dropDuplicates(["id"])
    both = signed.groupBy("rep").agg(F.bool_or("train").alias("t"), F.bool_and("train").alias("only")).where("t and not only")
    same = both.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard"))
    return verified.unionByName(same), members


def cross_split_pairs(df: DataFrame, *args, **kwargs) -> DataFrame:
    """All pairs (train_id, eval_id, jaccard) of records, written out from the pairs of classes."""
    pairs, members = cross_split_classes(df, *args, **kwargs)
    trained = members.where("train").select(F.col("id").alias("train_id"), F.col("rep").alias("a"))
    evaluated = members.where("not train").select(F.col("id").alias("eval_id"), F.col("rep").alias("b"))
    return trained.join(pairs, "a").join(evaluated, "b").select("train_id", "eval_id", "jaccard")


def pairs_per_record(df: DataFrame, *args, **kwargs) -> DataFrame:
    """(eval_id, n_pairs): how many train records each evaluation record is paired with.

    Counted from the classes and their sizes; the pairs themselves are not written out.
    """
    pairs, members = cross_split_classes(df, *args, **kwargs)
    sizes = members.where("train").groupBy(F.col("rep").alias("a")).agg(F.count("*").alias("n"))
    per_class = pairs.join(sizes, "a").groupBy(F.col("b").alias("rep")).agg(F.sum("n").alias("n_pairs"))
    return members.where("not train").join(per_class, "rep").select(F.col("id").alias("eval_id"), "n_pairs")
