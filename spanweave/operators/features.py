"""Model features: tokens with offsets, windows, and labels of the answer's tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tokenizer = Callable[[str], list[tuple[int, int, int]]]
CLS, SEP, PAD = 0, 1, 2


def word_tokenizer(text: str) -> list[tuple[int, int, int]]:
    """(id, start, end) of words and single signs; ids are hashes above the special ones."""
    import zlib

    return [(3 + zlib.crc32(m.group(0).encode("utf-8", "surrogatepass")) % 2_000_000_000, m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", text)]


_OFFSETS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
FIELDS = [("feature_idx", pa.int32()), ("input_ids", pa.list_(pa.int32())), ("attention_mask", pa.list_(pa.int32())),
          ("sequence_ids", pa.list_(pa.int32())), ("offsets", _OFFSETS)]
SCHEMA = "feature_idx int, input_ids array<int>, attention_mask array<int>, sequence_ids array<int>, offsets array<struct<s:int,e:int>>"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _pairs(lists: pa.Array, ends: pa.Array) -> pa.Array:
    values = pa.StructArray.from_arrays([lists.values, ends.values], ["s", "e"])
    return pa.ListArray.from_arrays(lists.offsets, values)


def window_rows(q: np.ndarray, c: np.ndarray, max_length: int, stride: int | None, pad: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window number, rows id / start / end / sequence of all its tokens, mask) of one pair of token arrays."""
    q = q[:, : max(max_length - 4, 0)]
    room = max(1, max_length - q.shape[1] - 3)
    # The overlap cannot reach the room for context, or windows would not move on.
    step = room if stride is None else room - min(stride, room - 1)
    special = lambda i: np.array([[i], [0], [0], [-1]], np.int32)
    with_sequence = lambda t, k: np.vstack([t, np.full((1, t.shape[1]), k, np.int32)])
    head = np.hstack([special(CLS), with_sequence(q, 0), special(SEP)])
    at, k = 0, 0
    while True:
        rows = np.hstack([head, with_sequence(c[:, at : at + room], 1), special(SEP)])
        mask = np.ones(rows.shape[1], np.int32)
        if pad and rows.shape[1] < max_length:
            more = max_length - rows.shape[1]
            rows, mask = np.hstack([rows, np.repeat(special(PAD), more, axis=1)]), np.hstack([mask, np.zeros(more, np.int32)])
        yield k, rows, mask
        at, k = at + step, k + 1
        if stride is None or at + room - step >= c.shape[1]:
            return


def label_positions(rows: np.ndarray, start: int | None, end: int | None, mode: str) -> tuple[int, int]:
    """Positions of the tokens that hold the first and the last character, as ``label_span``.

    Mode ``lenient`` is ``last`` but, where that finds none, goes from the first token with text
    to the last before a token that begins after the answer. Null bounds give (0, 0).
    """
    if start is None or end is None:
        return 0, 0
    s, e = rows[1], rows[2]
    usable = rows[3] == 1 if mode == "context" else np.ones(len(s), bool)
    i, j = np.flatnonzero(usable & (s <= start) & (start < e)), np.flatnonzero(usable & (s < end) & (end <= e))
    at = -1 if mode in ("last", "lenient") else 0
    if len(i) and len(j) and j[at] >= i[at]:
        return int(i[at]), int(j[at])
    if mode != "lenient" or not e.any():
        return 0, 0
    first = int(np.flatnonzero(e > 0)[0])
    beyond = np.flatnonzero(np.append(s[first + 1 :] > end, True))
    return first, first + int(beyond[0])


def build_windows(
    examples: DataFrame, max_length: int = 512, stride: int | None = None, tokenizer: Tokenizer = word_tokenizer, pad: bool = False,
    carry: tuple[str, ...] = (), label: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Feature rows of (id, question, context): [CLS] question [SEP] context [SEP].

    Only the context is cut to ``max_length``. Without ``stride`` one row; with it one row for
    each window, neighbouring windows sharing ``stride`` context tokens (fewer where the room
    for context is smaller). Special and padding tokens have offset (0, 0) and sequence id -1;
    the question's is 0, the context's 1. Rows are stored unpadded unless ``pad``. ``carry``:
    further columns to keep. ``label``: columns with the answer's start and end, and a mode of
    ``label_positions``; the windows then have start_position and end_position.

    The last contexts' tokens are kept in each worker: examples that come from a join on the
    context's key arrive by context, and each context is tokenized once.
    """
    kept = ("id", *carry)
    bounds = label[:2] if label else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def tokens(text: str) -> np.ndarray:
            return np.array(tokenizer(text), np.int32).reshape(-1, 3).T

        for batch in batches:
            out = 0
            while out < batch.num_rows:
                part = batch.slice(out, 1000)
                out += 1000
                source, ks, wide, masks, labels = [], [], [], [], []
                spans = list(zip(*(part[c].to_pylist() for c in bounds)))
                for i, (question, context) in enumerate(zip(part["question"].to_pylist(), part["context"].to_pylist())):
                    for k, rows, mask in window_rows(tokens(question or ""), tokens(context or ""), max_length, stride, pad):
                        source.append(i)
                        ks.append(k)
                        wide.append(rows)
                        masks.append(mask)
                        if label:
                            labels.append(label_positions(rows, *spans[i], label[2]))
                own = [part[c].take(pa.array(source, pa.int64())) for c in kept]
                ids, starts, ends, sequence = (_lists([r[j] for r in wide]) for j in range(4))
                columns = [*own, pa.array(ks, pa.int32()), ids, _lists(masks), sequence, _pairs(starts, ends)]
                columns += [pa.array([x[j] for x in labels], pa.int32()) for j in (0, 1)] if label else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*kept, *(f for f, _ in FIELDS), *(("start_position", "end_position") if label else ())]
    types = ", ".join(f"{c} {examples.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"{types}, {SCHEMA}" + (", start_position int, end_position int" if label else "")
    return examples.select(*dict.fromkeys([*kept, *bounds, "question", "context"])).mapInArrow(run, schema)


def padded(features: DataFrame, length: int | None = None) -> DataFrame:
    """Collate: all sequences filled up to ``length``, or to the longest row's."""
    if length is None:
        length = features.agg(F.max(F.size("input_ids"))).first()[0] or 0
    fill = {"input_ids": F.lit(PAD), "attention_mask": F.lit(0), "sequence_ids": F.lit(-1), "offsets": F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))}
    return features.withColumns({
        c: F.concat(c, F.array_repeat(x, F.greatest(F.lit(length) - F.size(c), F.lit(0)))) for c, x in fill.items()
    })


def save_features(features: DataFrame, path: str, split: str = "split") -> None:
    """The feature table as parquet, one folder for each split."""
    features.write.mode("overwrite").partitionBy(split).parquet(path)


def load_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A saved feature table; with ``split`` only that folder is read."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def label_span(offsets: Column, sequence_ids: Column, start: Column, end: Column, mode: str = "context") -> Column:
    """struct(start_position, end_position) of the tokens that hold the first and last character.

    mode ``context`` looks at context tokens only; ``first`` and ``last`` look at all tokens, as
    some feature builders do, and take the first or the last that fits. Without a pair in order
    the position of the first token (0, 0).
    """
    tokens = F.arrays_zip(offsets.alias("o"), sequence_ids.alias("q"))
    usable = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t["o"]["s"].alias("s"), t["o"]["e"].alias("e"), t["q"].alias("q")))
    if mode == "context":
        usable = F.filter(usable, lambda t: t["q"] == 1)
    a = F.filter(usable, lambda t: (t["s"] <= start) & (start < t["e"]))
    b = F.filter(usable, lambda t: (t["s"] < end) & (end <= t["e"]))
    at = F.lit(-1) if mode == "last" else F.lit(1)
    i, j = F.try_element_at(a, at)["i"], F.try_element_at(b, at)["i"]
    return F.when(i.isNotNull() & (j >= i), F.struct(i.alias("start_position"), j.alias("end_position"))).otherwise(
        F.struct(F.lit(0).alias("start_position"), F.lit(0).alias("end_position"))
    )


def exact_or_found(context: Column, text: Column, start: Column) -> Column:
    """``start`` where the text stands there, else its first occurrence, else null."""
    there = (start >= 0) & (start < F.length(context)) & (F.substring(context, start + 1, F.length(text)) == text)
    return F.when(F.coalesce(there, F.lit(False)), start).when(F.contains(context, text), F.instr(context, text) - 1)


def fallback_chunks(examples: DataFrame, size: int = 256, step: int = 128, least: int = 32) -> DataFrame:
    """Plain character windows of contexts longer than ``least``: (id_i, text, labels at 0)."""
    n = F.length("context")
    return (
        examples.where(n > least)
        .select("id", "context", F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("i", "at"))
        .select(
            F.concat_ws("_", "id", "i").alias("id"), F.substring("context", F.col("at") + 1, F.lit(size)).alias("text"),
            F.lit(0).alias("start_position"), F.lit(0).alias("end_position"), F.lit(True).alias("is_impossible"),
        )
    )


def boundary_weights(position: Column, length: int, window: int = 3, peak: float = 2.0) -> Column:
    """Weights around a position: peak * (1 - d / window) where above 1, else 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.greatest(F.lit(1.0), peak * (1.0 - F.abs(i - position) / window)))


def infer(features: DataFrame, predict: Callable[[pd.DataFrame], tuple[list, list]], batch: int = 16) -> DataFrame:
    """Add start_logits and end_logits by a caller's model, loaded once in each worker.

    ``predict`` gets up to ``batch`` rows and returns two lists of score lists.
    """
    schema = features.schema.simpleString()[7:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch].copy()
                s, e = predict(part)
                part["start_logits"], part["end_logits"] = list(map(np.asarray, s)), list(map(np.asarray, e))
                yield part

    return features.mapInPandas(run, schema + ",start_logits:array<float>,end_logits:array<float>")
