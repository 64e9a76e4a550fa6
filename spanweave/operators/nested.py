"""Deeply nested question-answering records turned into related flat tables (problem 4).

Method: payloads are parsed once, in the JVM, into one uniform nested array per record; then an
Arrow stage flattens it on buffers: the list offsets of each level give the parent index of each
child, and the keys of the parents are propagated with ``take``. No row is parsed or looped over
in Python.

What counts, by case:

* null, unreadable or incomplete payload: no rows; a payload wrapped as a JSON string (once or
  more, up to ``MAX_WRAPS`` times) is unwrapped;
* a single object where an array is usual stands at position 0; null entries and entries that
  are no objects keep their position but give no rows; absent, null and empty arrays give none;
* ``answers`` as an object of parallel arrays gives one row per position of the longer array;
* flags given as text or number are read as booleans, ids as text;
* records delivered twice count once (the last delivery); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WRAPS = 3

#: Columns of the node table; those that a level does not have are null.
NODES = (
    "record_id long, node string, parent string, level string, kind string, position int, title string, context string, "
    "context_id string, id string, question string, is_impossible boolean, text string, answer_start int"
)


def _list(v: Column, path: str) -> Column:
    """The array at ``path``; a single object becomes an array of one; else null."""
    return F.coalesce(
        F.try_variant_get(v, path, "array<variant>"),
        F.when(_is_object(F.try_variant_get(v, path, "variant")), F.array(F.try_variant_get(v, path, "variant"))),
    )


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _flag(v: Column, path: str) -> Column:
    word = F.lower(F.trim(_text(v, path)))
    return F.when(word.isin("true", "1", "yes", "y", "t"), True).when(word.isin("false", "0", "no", "n", "f", ""), False)


def _start(v: Column, path: str) -> Column:
    return _text(v, path).try_cast("int")


def _answers(v: Column, path: str) -> Column:
    """Answer structs; a struct of parallel arrays is turned into an array of structs."""
    texts = F.try_variant_get(v, path + ".text", "array<variant>")
    starts = F.try_variant_get(v, path + ".answer_start", "array<variant>")
    n = F.greatest(F.coalesce(F.size(texts), F.lit(0)), F.coalesce(F.size(starts), F.lit(0)))
    parallel = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.lit(True).alias("ok"),
            F.get(texts, i).try_cast("string").alias("text"),
            F.get(starts, i).try_cast("string").try_cast("int").alias("answer_start"),
        ),
    )
    listed = F.transform(
        _list(v, path),
        lambda a: F.struct(
            _is_object(a).alias("ok"), _text(a, "$.text").alias("text"), _start(a, "$.answer_start").alias("answer_start")
        ),
    )
    return F.when(texts.isNotNull() | starts.isNotNull(), parallel).otherwise(listed)


def parsed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``articles``, the uniform nested array, to the rows whose payload is complete JSON."""
    v = F.try_parse_json(F.col(payload))
    for _ in range(MAX_WRAPS):
        v = F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.variant_get(v, "$", "string"))).otherwise(v)
    df = df.withColumn("doc", v).where("doc is not null")
    articles = F.transform(_list(F.col("doc"), "$.data"), lambda a: F.struct(
        _is_object(a).alias("ok"), _text(a, "$.title").alias("title"),
        F.transform(_list(a, "$.paragraphs"), lambda p: F.struct(
            _is_object(p).alias("ok"), _text(p, "$.context").alias("context"), _text(p, "$.context_id").alias("context_id"),
            F.transform(_list(p, "$.qas"), lambda q: F.struct(
                _is_object(q).alias("ok"), _text(q, "$.id").alias("id"), _text(q, "$.question").alias("question"),
                _flag(q, "$.is_impossible").alias("is_impossible"),
                _answers(q, "$.answers").alias("answers"), _answers(q, "$.plausible_answers").alias("plausible_answers"),
            )).alias("qas"),
        )).alias("paragraphs"),
    ))
    return df.withColumn("articles", articles).drop("doc")


def _level(lists: pa.Array, path: pa.Array, records: pa.Array, name: str):
    """Flatten one level: the child structs with their path, parent path, record and position."""
    index = pc.list_parent_indices(lists)
    values = pc.list_flatten(lists)
    # Position in the parent: place among all children minus the place of the parent's first one.
    lengths = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
    first = pc.subtract(pc.cumulative_sum(lengths), lengths)
    position = pc.subtract(pa.array(np.arange(len(values))), pc.take(first, index))
    parent = pc.take(path, index)
    own = pc.binary_join_element_wise(
        pc.if_else(pc.equal(parent, ""), name, pc.binary_join_element_wise(parent, name, ".")), "[", position.cast(pa.string()), "]", ""
    )
    ok = pc.fill_null(pc.struct_field(values, "ok"), False)
    record = pc.take(records, index)
    keep = lambda a: pc.filter(a, ok)
    return keep(values), keep(own), keep(parent), keep(record), keep(position)


def _chunk(a) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


_SCHEMA = pa.schema([
    ("record_id", pa.int64()), ("node", pa.string()), ("parent", pa.string()), ("level", pa.string()), ("kind", pa.string()),
    ("position", pa.int32()), ("title", pa.string()), ("context", pa.string()), ("context_id", pa.string()), ("id", pa.string()),
    ("question", pa.string()), ("is_impossible", pa.bool_()), ("text", pa.string()), ("answer_start", pa.int32()),
])


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        records = _chunk(table["record_id"])
        root = pa.array([""] * len(records), pa.string())

        def emit(level: str, kind: str, values, own, parent, record, position, fields):
            n = len(own)
            have = {f: pc.struct_field(values, f) for f in fields}
            have |= {
                "record_id": record, "node": own, "parent": pc.if_else(pc.equal(parent, ""), pa.scalar(None, pa.string()), parent),
                "level": pa.array([level] * n, pa.string()), "kind": pa.array([kind] * n, pa.string()),
                "position": position.cast(pa.int32()),
            }
            return pa.RecordBatch.from_arrays(
                [_chunk(have[f.name]).cast(f.type) if f.name in have else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA
            )

        a = _level(_chunk(table["articles"]), root, records, "data")
        yield emit("article", "data", *a, ("title",))
        p = _level(pc.struct_field(a[0], "paragraphs"), a[1], a[3], "paragraphs")
        yield emit("paragraph", "paragraphs", *p, ("context", "context_id"))
        q = _level(pc.struct_field(p[0], "qas"), p[1], p[3], "qas")
        yield emit("question", "qas", *q, ("id", "question", "is_impossible"))
        for kind in ("answers", "plausible_answers"):
            x = _level(pc.struct_field(q[0], kind), q[1], q[3], kind)
            yield emit("answer", kind, *x, ("text", "answer_start"))


def last_delivery(records: DataFrame) -> DataFrame:
    """One row per ``record_id``: the payload delivered last (ties: the greater payload)."""
    order = F.struct(F.col("loaded_at"), F.col("payload"))
    return records.groupBy("record_id").agg(F.max_by("payload", order).alias("payload"))


def node_table(records: DataFrame) -> DataFrame:
    """Every article, paragraph, question and answer of ``records`` (record_id, payload, loaded_at)."""
    rows = parsed(last_delivery(records)).select("record_id", "articles").where("articles is not null")
    return rows.mapInArrow(_flatten, NODES)


def flat_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The four related tables; (record_id, node) is the key and (record_id, parent) the foreign key.

    Where more than one of them is used, give a written node table (``session.materialize``), so
    that the payloads are parsed once.
    """
    def of(level: str, *columns: str) -> DataFrame:
        return nodes.where(F.col("level") == level).select("record_id", "node", "parent", "position", *columns)

    return {
        "articles": of("article", "title"),
        "paragraphs": of("paragraph", "context_id", "context"),
        "questions": of("question", "id", "question", "is_impossible"),
        "answers": of("answer", "kind", "text", "answer_start"),
    }
