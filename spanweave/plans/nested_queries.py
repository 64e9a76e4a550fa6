"""Queries of problem 4: nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.nested import flat_tables, node_table
from ..session import read_table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return node_table(read_table(spark, d, "raw_records", "record_id", "payload", "loaded_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("record_id", "node")


def p4_articles(spark: SparkSession, d: str) -> DataFrame:
    return flat_tables(_nodes(spark, d))["articles"]


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return flat_tables(_nodes(spark, d))["paragraphs"]


def p4_questions(spark: SparkSession, d: str) -> DataFrame:
    return flat_tables(_nodes(spark, d))["questions"]


def p4_answers(spark: SparkSession, d: str) -> DataFrame:
    return flat_tables(_nodes(spark, d))["answers"]


def _sq_list(x: str, path: str) -> str:
    """The array at ``path``; a single object as an array of one."""
    return f"CASE json_type({x}, '{path}') WHEN 'ARRAY' THEN json_extract({x}, '{path}[*]') WHEN 'OBJECT' THEN [json_extract({x}, '{path}')] ELSE [] END"


def _sq_level(name: str, parent: str, path: str, node: str) -> str:
    """CTE name(record_id, parent, node, position, x): the objects at ``path`` of the parents' objects."""
    at = f"CASE WHEN node IS NULL THEN '' ELSE node || '.' END || '{node}[' || position || ']'"
    return (
        f"{name} AS (SELECT record_id, up AS parent, node, position, x FROM (SELECT record_id, node AS up, position, x, {at} AS node FROM "
        f"(SELECT record_id, node, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS position FROM (SELECT record_id, node, {_sq_list('x', path)} AS l FROM {parent}))) WHERE json_type(x) = 'OBJECT')"
    )


def _sq_answers(name: str, kind: str) -> str:
    """As ``_sq_level``, also for objects of parallel arrays."""
    each = _sq_level(name + "_l", f"(SELECT * FROM qas WHERE json_type(x, '$.{kind}.text') IS DISTINCT FROM 'ARRAY' AND json_type(x, '$.{kind}.answer_start') IS DISTINCT FROM 'ARRAY')", f"$.{kind}", kind)
    n = f"greatest(coalesce(json_array_length(x, '$.{kind}.text'), 0), coalesce(json_array_length(x, '$.{kind}.answer_start'), 0))"
    item = f"json_object('text', json_extract(x, '$.{kind}.text[' || position || ']'), 'answer_start', json_extract(x, '$.{kind}.answer_start[' || position || ']'))"
    return (
        f"{each}, {name} AS (SELECT * FROM {name}_l UNION ALL SELECT record_id, node, node || '.{kind}[' || position || ']', position, {item} FROM "
        f"(SELECT record_id, node, x, unnest(range(0, CAST({n} AS BIGINT))) AS position FROM qas WHERE json_type(x, '$.{kind}.text') = 'ARRAY' OR json_type(x, '$.{kind}.answer_start') = 'ARRAY'))"
    )


def _sq_unwrapped(x: str) -> str:
    inner = f"json_extract_string({x}, '$')"
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({inner}) THEN CAST({inner} AS JSON) END ELSE {x} END"


_SQ = "WITH " + ", ".join([
    "last AS (SELECT record_id, payload FROM raw_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC, payload DESC NULLS LAST) = 1)",
    "j0 AS (SELECT record_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS x FROM last)",
    *(f"j{k + 1} AS (SELECT record_id, {_sq_unwrapped('x')} AS x FROM j{k})" for k in range(3)),
    "roots AS (SELECT record_id, CAST(NULL AS VARCHAR) AS node, x FROM j3 WHERE x IS NOT NULL)",
    _sq_level("data", "roots", "$.data", "data"), _sq_level("paras", "data", "$.paragraphs", "paragraphs"), _sq_level("qas", "paras", "$.qas", "qas"),
    _sq_answers("ans", "answers"), _sq_answers("pla", "plausible_answers"),
]) + " "
_SQ_FLAG = "CASE WHEN lower(trim(x->>'$.is_impossible')) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower(trim(x->>'$.is_impossible')) IN ('false', '0', 'no', 'n', 'f', '') THEN false END"
SQL = {
    "p4_found": _SQ + "SELECT record_id, node FROM data UNION ALL SELECT record_id, node FROM paras UNION ALL SELECT record_id, node FROM qas UNION ALL SELECT record_id, node FROM ans UNION ALL SELECT record_id, node FROM pla",
    "p4_articles": _SQ + "SELECT record_id, node, parent, position, x->>'$.title' AS title FROM data",
    "p4_paragraphs": _SQ + "SELECT record_id, node, parent, position, x->>'$.context_id' AS context_id, x->>'$.context' AS context FROM paras",
    "p4_questions": _SQ + f"SELECT record_id, node, parent, position, x->>'$.id' AS id, x->>'$.question' AS question, {_SQ_FLAG} AS is_impossible FROM qas",
    "p4_answers": _SQ + "SELECT record_id, node, parent, position, kind, x->>'$.text' AS text, TRY_CAST(x->>'$.answer_start' AS INT) AS answer_start FROM (SELECT *, 'answers' AS kind FROM ans UNION ALL SELECT *, 'plausible_answers' FROM pla)",
}

QUERIES = {k: v for k, v in globals().items() if k.startswith("p4_")}
