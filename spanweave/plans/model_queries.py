"""Queries of features, decoding, similarity, translation and serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import TELUGU_ENDINGS, TELUGU_MEANINGS, TELUGU_VARIATIONS, Lexicon
from ..functions.similarity import indel_ratio, sequence_ratio, token_similarity
from ..operators import decode, features, serving
from ..session import read_table
from . import base as b
from .base import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# Scores: the vectors' first half as start, second half as end; token i covers 3 characters.

def _logits(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings", "vec_id", "embedding")
    offsets = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((i * 3).alias("s"), (i * 3 + 3).alias("e")))
    return e.select("vec_id", F.slice("embedding", 1, 32).alias("st"), F.slice("embedding", 33, 32).alias("en"),
                    F.repeat(F.lpad(F.pmod("vec_id", F.lit(1000)).cast("string"), 3, "0"), F.lit(32)).alias("context"), offsets.alias("offsets"))


_LG = "lg AS (SELECT vec_id, embedding[1:32] AS st, embedding[33:64] AS en, repeat(lpad(CAST(vec_id % 1000 AS VARCHAR), 3, '0'), 32) AS context FROM embeddings)"
_ARG = "list_position({0}, list_max({0})) - 1"
_S, _E = _ARG.format("st"), _ARG.format("en")


def _decoded(df: DataFrame, span) -> DataFrame:
    out = df.withColumn("span", span)
    return out.select("vec_id", F.coalesce("span.s", F.lit(-1)).cast("long").alias("s"), F.coalesce("span.e", F.lit(-1)).cast("long").alias("e"),
                      decode.span_text(F.col("context"), F.col("offsets"), F.col("span")).alias("text"))


def _sq_text(s: str, e: str) -> str:
    return f"SELECT vec_id, CAST({s} AS BIGINT) AS s, CAST({e} AS BIGINT) AS e, CASE WHEN {s} < 0 THEN '' ELSE substr(context, 3 * ({s}) + 1, 3 * (({e}) - ({s}) + 1)) END AS text"


@query("decode_argmax_swap", f"WITH {_LG}, x AS (SELECT *, least({_S}, {_E}) AS s0, greatest({_S}, {_E}) AS e0 FROM lg) {_sq_text('s0', 'e0')} FROM x")
def decode_argmax_swap(spark, d):
    return _decoded(_logits(spark, d), decode.argmax_span(F.col("st"), F.col("en"), swap=True))


@query("decode_argmax_strict", f"WITH {_LG}, x AS (SELECT *, CASE WHEN {_S} <= {_E} THEN {_S} ELSE -1 END AS s0, CASE WHEN {_S} <= {_E} THEN {_E} ELSE -1 END AS e0 FROM lg) {_sq_text('s0', 'e0')} FROM x")
def decode_argmax_strict(spark, d):
    return _decoded(_logits(spark, d), decode.argmax_span(F.col("st"), F.col("en")))


_SERVED = """sv AS (SELECT vec_id, context, list_transform(range(1, 33), lambda i: CASE WHEN (vec_id + i) % 5 > 0 THEN CAST(st[i] AS DOUBLE) ELSE -1e300 END) AS st,
list_transform(range(1, 33), lambda i: CASE WHEN (vec_id + i) % 5 > 0 THEN CAST(en[i] AS DOUBLE) ELSE -1e300 END) AS en FROM lg)"""


@query("decode_serving", f"WITH {_LG}, {_SERVED}, x AS (SELECT vec_id, context, {_S} AS s0, greatest({_S}, {_E}) AS e0 FROM sv) SELECT vec_id, "
       "CASE WHEN s0 = 0 THEN 'No answer found in the given context.' ELSE substr(context, 3 * s0 + 1, 3 * (e0 - s0 + 1)) END AS text FROM x")
def decode_serving(spark, d):
    """Token i is masked where vec_id + i + 1 is divisible by 5."""
    l = _logits(spark, d)
    mask = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: (F.pmod(F.col("vec_id") + i, F.lit(5)) > 0).cast("int"))
    return l.select("vec_id", decode.serving_answer(F.col("context"), F.col("offsets"), F.col("st"), F.col("en"), mask).alias("text"))


def _sq_nbest(n: int, longest: int, null: bool) -> str:
    top = "list_slice(list_sort(list_transform(range(1, 33), lambda i: {{'k': -CAST({0}[i] AS DOUBLE), 'i': i - 1}})), 1, {1})"
    s0, e0 = "coalesce(m.s, -1)", "coalesce(m.e, -1)"
    if null:
        keep = "m IS NOT NULL AND -m.k - none >= 0"
        s0, e0 = f"CASE WHEN {keep} THEN m.s ELSE -1 END", f"CASE WHEN {keep} THEN m.e ELSE -1 END"
    return (
        f"WITH {_LG}, t AS (SELECT vec_id, context, CAST(st[1] AS DOUBLE) + CAST(en[1] AS DOUBLE) AS none, {top.format('st', n)} AS a, {top.format('en', n)} AS b FROM lg), "
        f"pairs AS (SELECT vec_id, x.x AS x, unnest(b) AS y FROM (SELECT vec_id, b, unnest(a) AS x FROM t) AS x), "
        f"best AS (SELECT vec_id, min({{'k': x.k + y.k, 's': x.i, 'e': y.i}}) AS m FROM pairs WHERE y.i >= x.i AND y.i - x.i + 1 <= {longest} GROUP BY vec_id), "
        f"x AS (SELECT t.vec_id, t.context, {s0} AS s0, {e0} AS e0 FROM t LEFT JOIN best USING (vec_id)) {_sq_text('s0', 'e0')} FROM x"
    )


@query("decode_nbest", _sq_nbest(20, 100, False))
def decode_nbest(spark, d):
    return _decoded(_logits(spark, d), decode.nbest_span(F.col("st"), F.col("en"), 20, 100, None))


@query("decode_nbest_null", _sq_nbest(20, 30, True))
def decode_nbest_null(spark, d):
    return _decoded(_logits(spark, d), decode.nbest_span(F.col("st"), F.col("en"), 20, 30, 0.0))


@query("decode_nbest10_null", _sq_nbest(10, 100, True))
def decode_nbest10_null(spark, d):
    return _decoded(_logits(spark, d), decode.nbest_span(F.col("st"), F.col("en"), 10, 100, 0.0))


# Features.

def _examples(spark, d) -> DataFrame:
    """Examples by context, so that a worker meets each context's questions one after the other."""
    return b.examples(spark, d).sortWithinPartitions("context_id")


# The stand-in tokenizer in SQL: runs of letters, digits and underscores, and single other signs.
_WS = tx.WS[1:-1]
_PIECE = f"[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{_WS}]"


def _sq_tokens_of(name: str, table: str, key: str, text: str, most: int | None = None) -> str:
    """CTE name(key, k, s, e): the tokens with their offsets."""
    limit = f" WHERE k < {most}" if most else ""
    return (
        f"{name}_l AS (SELECT {key}, regexp_extract_all({text}, '[{_WS}]+|{_PIECE}') AS l FROM {table} WHERE {text} IS NOT NULL), "
        f"{name}_u AS (SELECT {key}, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM {name}_l), "
        f"{name}_s AS (SELECT {key}, i, t, coalesce(sum(length(t)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {name}_u), "
        f"{name} AS (SELECT * FROM (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS k, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + length(t) AS e, t FROM {name}_s WHERE NOT regexp_full_match(t, '[{_WS}]+')){limit})"
    )


def _sq_sizes(length: int) -> str:
    return (
        f"fq AS (SELECT ex.id, ex.context_id, coalesce(first_start, -1) AS a, coalesce(first_start, -1) + length(coalesce(first_text, '')) AS z, first_start, first_text, ex.context, "
        f"coalesce((SELECT count(*) FROM qt WHERE qt.id = ex.id), 0) AS q, coalesce((SELECT count(*) FROM ct WHERE ct.context_id = ex.context_id), 0) AS n FROM ex), "
        f"fr AS (SELECT *, greatest(1, {length} - q - 3) AS room FROM fq)"
    )


def _sq_all_tokens(length: int) -> str:
    """CTE tk(id, i, s, e): all tokens of the single window, special ones at (0, 0)."""
    return (
        "tk AS (SELECT id, 0 AS i, 0 AS s, 0 AS e FROM fr UNION ALL SELECT id, 1 + k, s, e FROM qt JOIN fr USING (id) UNION ALL SELECT id, q + 1, 0, 0 FROM fr "
        "UNION ALL SELECT id, q + 2 + k, ct.s, ct.e FROM fr JOIN ct USING (context_id) WHERE k < room UNION ALL SELECT id, q + 2 + least(n, room), 0, 0 FROM fr)"
    )


_TOK = [_sq_tokens_of("ct", "p", "context_id", "context"), _sq_tokens_of("qt", "q", "id", "question", 380)]


@query("feature_rows", sql("""SELECT w.id, feature_idx, q + 3 + least(room, n - frm) AS length,
CASE WHEN s.k >= frm AND s.k < frm + room AND e.k >= s.k AND e.k < frm + room THEN q + 2 + s.k - frm ELSE 0 END AS start_position,
CASE WHEN s.k >= frm AND s.k < frm + room AND e.k >= s.k AND e.k < frm + room THEN q + 2 + e.k - frm ELSE 0 END AS end_position
FROM w LEFT JOIN ct s ON s.context_id = w.context_id AND s.s <= w.a AND w.a < s.e LEFT JOIN ct e ON e.context_id = w.context_id AND e.s < w.z AND w.z <= e.e""",
    *_TOK, _sq_sizes(384), """w AS (SELECT *, feature_idx * step AS frm FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - room) / step)) AS BIGINT) + 1)) AS feature_idx
FROM (SELECT *, room - least(128, room - 1) AS step FROM fr)))"""))
def feature_rows(spark, d):
    """Windows of 384 tokens with a stride of 128, and the labels of the first answer."""
    a = F.coalesce("first_start", F.lit(-1))
    e = _examples(spark, d).withColumns({"a": a, "z": a + F.length(F.coalesce("first_text", F.lit("")))})
    w = features.build_windows(e, max_length=384, stride=128, label=("a", "z", "context"))
    return w.select("id", "feature_idx", F.size("input_ids").alias("length"), "start_position", "end_position")


def _sq_label(i: str, j: str) -> str:
    return f"CASE WHEN {j} >= {i} THEN {i} || '-' || {j} ELSE '0-0' END"


@query("feature_labels_by_mode", sql(f"""SELECT count(*) AS n, count(*) FILTER (WHERE {_sq_label('ci', 'cj')} = {_sq_label('fi', 'fj')}) AS first_agrees, count(*) FILTER (WHERE {_sq_label('ci', 'cj')} = {_sq_label('li', 'lj')}) AS last_agrees FROM (
SELECT fr.id, min(i) FILTER (WHERE s <= a AND a < e AND i > q + 1) AS ci, min(i) FILTER (WHERE s < z AND z <= e AND i > q + 1) AS cj, min(i) FILTER (WHERE s <= a AND a < e) AS fi, min(i) FILTER (WHERE s < z AND z <= e) AS fj,
max(i) FILTER (WHERE s <= a AND a < e) AS li, max(i) FILTER (WHERE s < z AND z <= e) AS lj FROM fr JOIN tk USING (id) WHERE first_start >= 0 AND first_text IS NOT NULL GROUP BY fr.id)""", *_TOK, _sq_sizes(512), _sq_all_tokens(512)))
def feature_labels_by_mode(spark, d):
    """How often the three labelling rules put the answer's tokens at different places."""
    e = _examples(spark, d).where("first_start >= 0 and first_text is not null").withColumn("z", F.col("first_start") + F.length("first_text"))
    w = features.build_windows(e, max_length=512, carry=("first_start", "z"))
    labels = [features.label_span(F.col("offsets"), F.col("sequence_ids"), F.col("first_start"), F.col("z"), m).alias(m) for m in ("context", "first", "last")]
    s = w.select("id", *labels)
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("context") == F.col("first")).alias("first_agrees"), F.count_if(F.col("context") == F.col("last")).alias("last_agrees"))


_MATCHED = """mt AS (SELECT x.id, max(i) FILTER (WHERE s <= x.a AND x.a < e) AS i, max(i) FILTER (WHERE s < x.z AND x.z <= e) AS j, min(i) FILTER (WHERE e > 0) AS first, max(i) AS last FROM x JOIN tk USING (id) GROUP BY x.id)"""


@query("answerable_features", sql("SELECT x.id, CASE WHEN j >= i THEN i ELSE 0 END AS start_position, CASE WHEN j >= i THEN j ELSE 0 END AS end_position, x.first_text AS gold_text FROM x JOIN mt USING (id)",
    *_TOK, _sq_sizes(384), _sq_all_tokens(384), "x AS (SELECT fr.id, first_start AS a, first_start + length(first_text) AS z, first_text FROM fr JOIN q ON q.id = fr.id WHERE NOT q.is_impossible AND first_text IS NOT NULL AND first_start IS NOT NULL)", _MATCHED))
def answerable_features(spark, d):
    """One row of 384 tokens for each answerable question, the last fitting tokens as labels."""
    e = _examples(spark, d).where("not is_impossible and first_text is not null and first_start is not null").withColumn("z", F.col("first_start") + F.length("first_text"))
    w = features.build_windows(e, max_length=384, carry=("first_text",), label=("first_start", "z", "last"))
    return w.select("id", "start_position", "end_position", F.col("first_text").alias("gold_text"))


@query("lenient_features", sql("""SELECT x.id, CASE WHEN j >= i THEN i ELSE first END AS start_position, CASE WHEN j >= i THEN j ELSE coalesce((SELECT min(t.i) FROM tk t LEFT JOIN tk u ON u.id = t.id AND u.i = t.i + 1
WHERE t.id = x.id AND t.i >= first AND (t.i >= last OR u.s > x.z)), first) END AS end_position, x.a AS answer_start FROM x JOIN mt USING (id)""",
    *_TOK, _sq_sizes(512), _sq_all_tokens(512), """x AS (SELECT id, a, a + length(first_text) AS z FROM (SELECT id, first_text, CASE WHEN first_start >= 0 AND first_start < length(context) AND substr(context, first_start + 1, length(first_text)) = first_text THEN first_start
ELSE strpos(context, first_text) - 1 END AS a FROM fr WHERE first_text IS NOT NULL) WHERE a >= 0)""", _MATCHED))
def lenient_features(spark, d):
    """Answers that are not at their place are sought; those that are nowhere lose their row."""
    e = _examples(spark, d).where("first_text is not null")
    e = e.withColumn("a", features.exact_or_found(F.col("context"), F.col("first_text"), F.col("first_start"))).where("a >= 0").withColumn("z", F.col("a") + F.length("first_text"))
    w = features.build_windows(e, max_length=512, carry=("a",), label=("a", "z", "lenient"))
    return w.select("id", "start_position", "end_position", F.col("a").alias("answer_start"))


@query("fallback_chunks", sql("""SELECT id || '_' || (pos // 128) AS id, length(substr(context, pos + 1, 256)) AS len FROM (SELECT id, context, unnest(range(0, length(context), 128)) AS pos FROM ex WHERE length(context) > 32)"""))
def fallback_chunks(spark, d):
    return features.fallback_chunks(_examples(spark, d)).select("id", F.length("text").cast("long").alias("len"))


@query("boundary_weights", sql("SELECT id, round(list_sum(list_transform(range(0, 16), lambda i: greatest(1.0, 2.0 * (1.0 - abs(i - length(id) % 16) / 3.0)))), 6) AS total FROM q"))
def boundary_weights(spark, d):
    w = features.boundary_weights(F.pmod(F.length("id"), F.lit(16)), 16)
    return b.questions(spark, d).select("id", F.round(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _shared_word_model(pdf):
    """A stand-in for a model: start and end at the context token that the question shares last."""
    scores = [[float(s == 1 and i in asked) for i, s in zip(ids, seq)]
              for ids, seq in zip(pdf["input_ids"], pdf["sequence_ids"]) for asked in [{i for i, s in zip(ids, seq) if s == 0}]]
    return scores, scores


@query("serve_one", sql(f"""SELECT rq.id, question, CASE WHEN question <> '' AND context <> '' THEN CASE WHEN coalesce(m.m.s, 0) > 0 THEN substr(context, m.m.s + 1, m.m.e - m.m.s) ELSE 'No answer found in the given context.' END END AS answer,
CASE WHEN question = '' OR context = '' THEN 'Both question and context are required.' END AS error FROM rq LEFT JOIN
(SELECT c.id, min({{'s': c.s, 'e': c.e}}) AS m FROM rc c JOIN qx USING (id, t) JOIN (SELECT id, count(*) AS n FROM rt GROUP BY id) USING (id) WHERE c.k < greatest(1, 509 - n) GROUP BY c.id) m USING (id)""",
    "rq AS (SELECT id, trim(coalesce(question, '')) AS question, trim(coalesce(context, '')) AS context FROM ex)", _sq_tokens_of("rc", "rq", "id", "context"), _sq_tokens_of("rt", "rq", "id", "question", 508),
    "qx AS (SELECT DISTINCT id, t FROM rt)"))
def serve_one(spark, d):
    """The online path: the same plan over request rows; requests with an empty side get an error."""
    return serving.respond(b.examples(spark, d).select("id", "question", "context"), _shared_word_model)


# Similarity and lexicon.

def _rows(table: dict[str, list[str]]) -> str:
    pairs = [(k, f) for k, forms in table.items() for f in forms]
    return ", ".join(f"({i}, '{k}', '{f}')" for i, (k, f) in enumerate(pairs))


@query("base_words", sql(f"""SELECT word, coalesce((SELECT base FROM vr WHERE word = form OR starts_with(word, base) ORDER BY n LIMIT 1), (SELECT base FROM mg WHERE form = word ORDER BY n LIMIT 1),
(SELECT base FROM mg WHERE starts_with(form, word) OR starts_with(word, form) OR (2.0 * least(length(word), length(form)) / (length(word) + length(form)) > 0.8 AND {b.sq_indel('lower(word)', 'lower(form)')} > 0.8) ORDER BY n DESC LIMIT 1),
(SELECT substr(word, 1, length(word) - length(ending)) FROM en WHERE ends_with(word, ending) ORDER BY n LIMIT 1), word) AS base FROM wd""",
    f"wd AS (SELECT DISTINCT unnest({b.sq_tokens('text')}) AS word FROM a WHERE text IS NOT NULL)", f"vr AS (SELECT * FROM (VALUES {_rows(TELUGU_VARIATIONS)}) AS t(n, base, form))",
    f"mg AS (SELECT * FROM (VALUES {_rows(TELUGU_MEANINGS)}) AS t(n, base, form))", "en AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(TELUGU_ENDINGS)) + ") AS t(n, ending))"))
def base_words(spark, d):
    """Base forms of the distinct words of all answers: each word once."""
    words = b.answers(spark, d).select(F.explode(tx.tokens(F.coalesce("text", F.lit("")))).alias("word")).distinct()

    @F.pandas_udf("string")
    def base(s):
        lexicon = Lexicon()
        return s.map(lexicon.base)

    return words.select("word", base("word").alias("base"))


def _answer_and_place(spark, d) -> DataFrame:
    s = b.spans(spark, d).where("text is not null and answer_start >= 0")
    return s.select("answer_id", "text", F.substring("context", F.col("answer_start") + 1, F.length("text")).alias("there"))


_PAIR = ["ap AS (SELECT answer_id, text, substr(context, answer_start + 1, length(text)) AS there FROM spans WHERE text IS NOT NULL AND answer_start >= 0)",
         f"tk AS (SELECT *, {b.sq_tokens('text')} AS a, {b.sq_tokens('there')} AS c FROM ap)",
         """st AS (SELECT *, array_to_string(list_sort(a), ' ') AS sa, array_to_string(list_sort(c), ' ') AS sc, array_to_string(list_sort(list_distinct(list_intersect(a, c))), ' ') AS common_words,
array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(c, x)))), ' ') AS la, array_to_string(list_sort(list_distinct(list_filter(c, lambda x: NOT list_contains(a, x)))), ' ') AS lc FROM tk)""",
         "ts AS (SELECT *, trim(common_words || ' ' || la) AS one, trim(common_words || ' ' || lc) AS two FROM st)"]


@query("answer_similarities", sql(f"""SELECT answer_id, round({b.sq_indel('lower(text)', 'lower(there)')}, 6) AS indel, round((({b.sq_indel('sa', 'sc')}) + CASE WHEN len(a) = 0 OR len(c) = 0 THEN 0.0 WHEN common_words <> '' AND (la = '' OR lc = '') THEN 1.0
WHEN common_words = '' THEN {b.sq_indel('one', 'two')} ELSE greatest({b.sq_indel('one', 'two')}, {b.sq_indel('common_words', 'one')}, {b.sq_indel('common_words', 'two')}) END) / 2, 6) AS token FROM ts""", *_PAIR))
def answer_similarities(spark, d):
    """Similarity in spelling and in tokens between an answer and what stands at its offset."""
    @F.pandas_udf("struct<indel:double,token:double>")
    def score(a, c):
        import pandas as pd

        # Most answers are at their place; equal pairs need no computation.
        rows = [(1.0, 1.0 if x.split() else 0.5) if x == y else (indel_ratio(x.lower(), y.lower()), token_similarity(x, y)) for x, y in zip(a, c)]
        return pd.DataFrame(rows, columns=["indel", "token"]).round(6)

    return _answer_and_place(spark, d).select("answer_id", score("text", "there").alias("s")).select("answer_id", "s.*")


@query("answer_sequence_ratio")
def answer_sequence_ratio(spark, d):
    """Ratcliff and Obershelp's ratio between an answer and what stands at its offset."""
    @F.pandas_udf("double")
    def score(a, c):
        import pandas as pd

        return pd.Series([1.0 if x == y else sequence_ratio(x, y) for x, y in zip(a, c)], dtype="float64").round(6)

    return _answer_and_place(spark, d).select("answer_id", score("text", "there").alias("ratio"))


# Translation stage and reports.

def _lexicon_engine(spark, d):
    from ..operators.translate import word_for_word

    # The lexicon is a fixed table of a hundred-odd rows.
    rows = read_table(spark, d, "lexicon", "lex_id", "en_term", "te_term").where("te_term is not null").orderBy("lex_id").select("en_term", "te_term").collect()
    return word_for_word({r[0].lower(): r[1] for r in rows if r[0]})


# The lexicon as a map; of terms that differ in case only, the later one counts.
_LX = "lx AS (SELECT map(list(k), list(v)) AS m FROM (SELECT lower(en_term) AS k, arg_max(te_term, lex_id) AS v FROM lexicon WHERE te_term IS NOT NULL AND en_term IS NOT NULL GROUP BY 1))"


def _sq_translated(x: str) -> str:
    letters = "\\p{L}\\p{Nl}\\p{No}"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[{letters}]+|[^{letters}]+'), lambda w: coalesce(m[lower(w)], w)), '')"


@query("translated_questions", sql(f"SELECT id, {_sq_translated('question')} AS translated FROM q, lx WHERE question IS NOT NULL", _LX))
def translated_questions(spark, d):
    """Questions through a word-for-word engine made of the lexicon: distinct strings once, joined back."""
    from ..operators.translate import translate_strings

    q = b.questions(spark, d).select("id", "question")
    return q.join(translate_strings(q, "question", _lexicon_engine(spark, d)), "question").select("id", "translated")


@query("translated_dataset", sql(f"""SELECT q.id, {_sq_translated('p.title')} AS title, {_sq_translated('q.question')} AS question, md5({_sq_translated('p.context')}) AS context_hash,
(SELECT string_agg({_sq_translated('a.text')} || '@' || coalesce(a.answer_start::VARCHAR, ''), '|' ORDER BY answer_no, answer_id) FROM a, lx WHERE a.qa_id = q.id AND NOT is_plausible AND a.text IS NOT NULL) AS answers
FROM q JOIN p ON p.context_id = q.context_id, lx WHERE p.orig_context_id IS NULL""", _LX))
def translated_dataset(spark, d):
    """Titles, contexts, questions and answers translated independently; offsets kept from the original."""
    from ..operators.translate import translate_flat

    p = b.paragraphs(spark, d).where("orig_context_id is null").select("context_id", "title", "context")
    q = b.questions(spark, d).select("id", "context_id", "question", "is_impossible")
    a = b.answers(spark, d).where("not is_plausible").groupBy(F.col("qa_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("answer_no", "answer_id", "text", "answer_start"))), lambda x: F.struct(x["text"].alias("text"), x["answer_start"].alias("answer_start"))).alias("answers"))
    flat = q.join(p, "context_id").join(a, "id", "left")
    out = translate_flat(flat, ["title", "context", "question"], ["answers"], _lexicon_engine(spark, d))
    shown = F.transform(F.filter("answers", lambda x: x["text"].isNotNull()), lambda x: F.concat(x["text"], F.lit("@"), F.coalesce(x["answer_start"].cast("string"), F.lit(""))))
    return out.select("id", "title", "question", F.md5("context").alias("context_hash"), F.nullif(F.array_join(shown, "|"), F.lit("")).alias("answers"))


@query("translation_progress", sql("""SELECT count(DISTINCT p.context_id) FILTER (WHERE p.orig_context_id IS NULL) AS originals, count(DISTINCT p.context_id) FILTER (WHERE p.orig_context_id IS NOT NULL) AS translations,
max(p.context_id) FILTER (WHERE p.orig_context_id IS NOT NULL) AS last_translation FROM p"""))
def translation_progress(spark, d):
    t = F.col("orig_context_id").isNotNull()
    return b.paragraphs(spark, d).agg(F.count_if(~t).alias("originals"), F.count_if(t).alias("translations"), F.max(F.when(t, F.col("context_id"))).alias("last_translation"))
