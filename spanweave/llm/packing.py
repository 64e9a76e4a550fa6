"""Filling fixed-capacity containers with texts (problem 8).

Method: conflict-constrained best fit. Items, largest first, go to the open bin with the least
residual that still fits; bins are ordered by residual, and each carries a bitmap of the sources
and one of the duplicate clusters it holds. An item conflicts with a bin that has its duplicate
cluster, and with one that has ``per_source`` items of its source; the successor search goes on
to the next larger residual until the tightest compatible bin is found. As unused space weighs
more than variety, an item that conflicts by source with every bin that could hold it goes to
the tightest of them; only a duplicate (or a lack of room) opens a new bin. Bins of one residual
are kept by their source bitmap, so that those which conflict are passed over together. An item
larger than the capacity is cut into full containers and a remainder, which is packed like
any other item; no other item is split.

The items are spread by a hash of their id over shards of bounded total size, and each shard is
packed by one task; the number of shards grows with the corpus, so a task's work does not, and
no source or cluster can skew it. At most a few bins a shard stay unfilled.

Defined cases: null and empty texts have no tokens and come out with a null container; ties are
broken by id; texts that are equal but for white space and case form a duplicate cluster.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .token_sizes import token_count


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each item; items must come in descending size."""
    # Open bins by residual, and among those by the bitmap of the sources that are used up in them.
    levels: dict[int, dict[int, list[int]]] = {}
    live: list[int] = []  # residuals that have bins, ascending
    held: list[list[int]] = []  # source bitmaps: one for each allowed repetition
    dup: list[int] = []
    out = []

    def take(size: int, s_bit: int, c_bit: int) -> tuple[int, int]:
        for at in range(bisect.bisect_left(live, size), len(live)):
            r = live[at]
            for used, bins in levels[r].items():
                if used & s_bit:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    b = bins[k]
                    if not dup[b] & c_bit:
                        bins[k] = bins[-1]
                        bins.pop()
                        if not bins:
                            del levels[r][used]
                            if not levels[r]:
                                del levels[r]
                                live.pop(at)
                        return b, r
        return -1, capacity

    for size, source, cluster in zip(sizes, sources, clusters):
        s_bit, c_bit = 1 << source, 1 << cluster if cluster >= 0 else 0
        chosen, r = take(size, s_bit, c_bit)
        if chosen < 0:
            chosen, r = take(size, 0, c_bit)  # no bin without a conflict by source
        if chosen < 0:
            chosen = len(held)
            held.append([0] * per_source)
            dup.append(0)
        dup[chosen] |= c_bit
        for k, bits in enumerate(held[chosen]):
            if not bits & s_bit:
                held[chosen][k] |= s_bit
                break
        r -= size
        if r > 0:
            if r not in levels:
                bisect.insort(live, r)
            levels.setdefault(r, {}).setdefault(held[chosen][-1], []).append(chosen)
        out.append(chosen)
    return out


def _pack_shard(capacity: int, per_source: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "piece_no"], ascending=[False, True, True], kind="stable")
        sources = pd.factorize(pdf["source"])[0].tolist()
        # Only clusters with several items in the shard can conflict.
        cluster = pd.factorize(pdf["cluster"])[0]
        many = pd.Series(cluster).map(pd.Series(cluster).value_counts()).to_numpy() > 1
        clusters = [-1] * len(pdf)
        names: dict[int, int] = {}
        for i in range(len(pdf)):
            if many[i]:
                clusters[i] = names.setdefault(int(cluster[i]), len(names))
        bins = best_fit(pdf["size"].tolist(), sources, clusters, capacity, per_source)
        out = pdf[["id", "piece_no"]].copy()
        out["container"] = [f"{s}-{b}" for s, b in zip(pdf["shard"], bins)]
        return out

    return pack


def pack(
    df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 512,
    per_source: int = 2, shard_containers: int = 2000, folder: str | None = None,
) -> DataFrame:
    """(id, piece_no, container, token_start, n_tokens, source): every text in containers.

    ``per_source``: how many items of one source a container holds before it counts as
    conflicting. ``shard_containers``:
    about how many containers' worth of tokens a task packs.
    """
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\s+", " ")))
    sized = materialize(
        df.select(F.col(id_).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"),
                  F.xxhash64(flat).alias("cluster"), token_count(text, folder).alias("n")), "sizes"
    )
    total = sized.agg(F.sum(F.col("n") % capacity)).first()[0] or 0
    shards = max(1, round(total / (capacity * shard_containers)))
    full = (
        sized.where(F.col("n") >= capacity)
        .select("id", "source", F.posexplode(F.sequence(F.lit(0), (F.col("n") / capacity).cast("int") - 1)).alias("piece_no", "_"))
        .select("id", "source", "piece_no", F.concat_ws("-", F.lit("f"), "id", "piece_no").alias("container"), F.lit(capacity).cast("long").alias("n_tokens"))
    )
    rest = sized.where(F.col("n") % capacity > 0).select(
        "id", "source", "cluster", (F.col("n") / capacity).cast("int").alias("piece_no"), (F.col("n") % capacity).cast("int").alias("size"),
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
    )
    packed = rest.groupBy("shard").applyInPandas(_pack_shard(capacity, per_source), "id long, piece_no int, container string")
    rest = rest.join(packed, ["id", "piece_no"]).select("id", "source", "piece_no", "container", F.col("size").cast("long").alias("n_tokens"))
    none = sized.where("n = 0").select("id", "source", F.lit(0).alias("piece_no"), F.lit(None).cast("string").alias("container"), F.lit(0).cast("long").alias("n_tokens"))
    return full.unionByName(rest).unionByName(none).select(
        F.col("id").alias(id_), "piece_no", "container", (F.col("piece_no").cast("long") * capacity).alias("token_start"), "n_tokens", F.col("source").alias("source")
    )


def fill_report(packed: DataFrame, capacity: int = 512) -> DataFrame:
    """Containers, tokens and the share of the capacity that is used."""
    return packed.where("container is not null").agg(
        F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")
    ).select("n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("fill"))
