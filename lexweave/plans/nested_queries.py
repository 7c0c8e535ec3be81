"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import nested

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _raw(spark, folder):
    return spark.read.parquet(f"{folder}/role_labelled_raw.parquet")


def _summaries(spark, folder):
    return spark.read.parquet(f"{folder}/summarization_dataset.parquet")


_KEYS = list(nested.KEYS)


def _cases(spark, folder, level: str | None = None):
    rows = nested.case_rows(nested.read_cases(_raw(spark, folder)))
    return rows.where(F.col("level") == level) if level else rows


def _of_summaries(spark, folder, level: str | None = None):
    rows = nested.summary_rows(nested.latest_summaries(_summaries(spark, folder)))
    return rows.where(F.col("level") == level) if level else rows


@query
def p5_found(spark, folder):
    return _cases(spark, folder).select(*_KEYS).unionByName(_of_summaries(spark, folder).select(*_KEYS))


@query
def p5_paragraphs(spark, folder):
    return _cases(spark, folder, "paragraph").select("case_id", "para_no", "para_id", "text", "position", "role_source", F.expr("try_cast(role_confidence as double)").alias("role_confidence"))


@query
def p5_roles(spark, folder):
    return _cases(spark, folder, "role").select("case_id", "para_no", F.col("item_no").alias("role_no"), "role")


@query
def p5_sentences(spark, folder):
    return _cases(spark, folder, "sentence").select("case_id", "para_no", F.col("item_no").alias("sentence_no"), "start", "end")


@query
def p5_cites(spark, folder):
    """Every cite; `value` is one that is no object, as it was written."""
    return _cases(spark, folder, "cite").select("case_id", "para_no", F.col("item_no").alias("sentence_no"), F.col("sub_no").alias("cite_no"), "law", "section", "raw", "score", "value")


@query
def p5_rejects(spark, folder):
    """The lines that give no case, and why."""
    return nested.rejects(_raw(spark, folder)).select("line_no", "reason")


@query
def p5_sections(spark, folder):
    """Long form of structured_summary: a row per written section."""
    return _of_summaries(spark, folder, "section").select("case_id", F.col("name").alias("section"), "text")


@query
def p5_summary_statutes(spark, folder):
    return _of_summaries(spark, folder, "summary_statute").select("case_id", F.col("item_no").alias("statute_no"), F.col("value").alias("statute"))


# ---------------------------------------------------------------- the same in SQL


def _array(x: str) -> str:
    """SQL of a JSON value as a list: an array's elements, those of an array sent as text, else the value alone."""
    return f"""case json_type({x}) when 'ARRAY' then json_extract({x}, '$[*]') when 'VARCHAR' then case when ltrim({x} ->> '$') like '[%' then json_extract(({x} ->> '$')::json, '$[*]') else [{x}] end
when 'NULL' then []::json[] else case when {x} is null then []::json[] else [{x}] end end"""


def _unnest(source: str, keys: str, x: str, number: str) -> str:
    return f"(select {keys}, generate_subscripts(l, 1)::int as {number}, unnest(l) as e from (select *, {_array(x)} as l from {source}))"


_CASES = """(select try_cast(trim(coalesce(j ->> '$.case_id', j ->> '$.case.case_id')) as bigint) as case_id, coalesce(j -> '$.paragraphs', j -> '$.case.paragraphs') as x
from (select line_no, ingested_at, case when json_valid(record) then record::json end as j from role_labelled_raw where record is not null and trim(record) <> '') where j is not null and json_type(j) = 'OBJECT'
and try_cast(trim(coalesce(j ->> '$.case_id', j ->> '$.case.case_id')) as bigint) is not null qualify row_number() over (partition by case_id order by ingested_at desc, line_no desc) = 1)"""
_P = _unnest(_CASES, "case_id", "x", "para_no")
_R = _unnest(f"(select *, e -> '$.paragraph_roles' as x from {_P})", "case_id, para_no", "x", "role_no")
_S = _unnest(f"(select *, e -> '$.sentences' as x from {_P})", "case_id, para_no", "x", "sentence_no")
_C = _unnest(f"(select *, e -> '$.cites' as x from {_S})", "case_id, para_no, sentence_no", "x", "cite_no")
_LATEST = "(select case_id, arg_max(structured_summary, ingested_at) as s from summarization_dataset where case_id is not null group by case_id)"
_SECT = " union all ".join(f"select case_id, '{n}' as section, s.{n} as text from {_LATEST} where regexp_matches(s.{n}, '\\S')" for n in nested.SECTIONS)
_STAT = f"select * from (select case_id, generate_subscripts(s.statutes, 1)::int as statute_no, unnest(s.statutes) as statute from {_LATEST}) where statute is not null"
_HERE = "where json_type(e) <> 'NULL'"

ORACLES = {
    "p5_found": f"""select 'paragraph' as level, case_id, para_no, 0 as item_no, 0 as sub_no, '' as name from {_P} {_HERE} union all select 'role', case_id, para_no, role_no, 0, '' from {_R} {_HERE}
union all select 'sentence', case_id, para_no, sentence_no, 0, '' from {_S} {_HERE} union all select 'cite', case_id, para_no, sentence_no, cite_no, '' from {_C} {_HERE}
union all select 'section', case_id, 0, 0, 0, section from ({_SECT}) union all select 'summary_statute', case_id, 0, statute_no, 0, '' from ({_STAT})""",
    "p5_roles": f"select case_id, para_no, role_no, e ->> '$' as role from {_R} {_HERE}",
    "p5_sentences": f"select case_id, para_no, sentence_no, (e ->> '$.start')::int as start, (e ->> '$.end')::int as end from {_S} {_HERE}",
    "p5_paragraphs": f"select case_id, para_no, e ->> '$.para_id' as para_id, e ->> '$.text' as text, e ->> '$.position' as position, e ->> '$.role_source' as role_source, try_cast(e ->> '$.role_confidence' as double) as role_confidence from {_P} {_HERE}",
    "p5_cites": f"select case_id, para_no, sentence_no, cite_no, e ->> '$.law' as law, e ->> '$.section' as section, e ->> '$.span.raw' as raw, (e ->> '$.span.score')::double as score, case when json_type(e) <> 'OBJECT' then e ->> '$' end as value from {_C} {_HERE}",
    "p5_rejects": """select line_no, case when record is null or not regexp_matches(record, '\\S') then 'blank' when j is null or json_type(j) <> 'OBJECT' then 'unparsed' else 'no_case_id' end as reason
from (select line_no, record, case when json_valid(record) then record::json end as j from role_labelled_raw)
where j is null or json_type(j) <> 'OBJECT' or try_cast(trim(coalesce(j ->> '$.case_id', j ->> '$.case.case_id')) as bigint) is null""",
    "p5_sections": _SECT,
    "p5_summary_statutes": _STAT,
}
