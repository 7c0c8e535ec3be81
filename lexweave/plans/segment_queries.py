"""Queries of cleaning, segmentation, the quality gate and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import cleaning, quality, scans, segments
from lexweave.plans.base import ORACLES, PARAS, STRIP, paragraphs, query, table

_HALF4 = "floor(({}) * 10000.0::double + 0.5) / 10000.0::double"

# ---------------------------------------------------------------- cleaning


@query("""with l as (select doc_id, i, lines[i] as line from (select doc_id, lines, unnest(generate_series(1, len(lines))) as i from (select doc_id, string_split(text || chr(10) || text || chr(10) || text, chr(10)) as lines from documents where text is not null))),
k as (select *, count(*) over (partition by doc_id, line) as n from l)
select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where length(trim(line)) < 30 or n <= 5), '') as text from k group by doc_id""")
def repeated_lines(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.concat("text", F.lit("\n"), "text", F.lit("\n"), "text").alias("text"))
    return cleaning.drop_repeated_lines(d, ["doc_id"], "text")


# every seventh text opens with a page of appearances, so that all ways to a start occur
_HEADED = """(select case_id, case when case_id % 7 = 0 then 'HIGH COURT' || chr(10) || 'Appearance of counsel' || chr(10) || 'For the petitioner: A' || chr(10) || 'x' || chr(10) || 'y' || chr(10) || 'z' || chr(10) || 'q' || chr(10) || 'r' || chr(10) || 's' || chr(10) else '' end
|| case when case_id % 5 = 0 then 'Bench of two' || chr(10) || 'JUDGMENT' || chr(10) else '' end || case when case_id % 11 = 0 then 'Counsel present' || chr(10) || '-----' || chr(10) else '' end || coalesce(input_text, '') as text
from (select case_id, any_value(input_text) as input_text from summarization_dataset group by case_id))"""


def _headed(spark, folder):
    s = table(spark, folder, "summarization_dataset").groupBy("case_id").agg(F.min("input_text").alias("input_text"))
    part = lambda k, x: F.when(F.col("case_id") % k == 0, F.lit(x)).otherwise("")
    text = F.concat(part(7, "HIGH COURT\nAppearance of counsel\nFor the petitioner: A\nx\ny\nz\nq\nr\ns\n"), part(5, "Bench of two\nJUDGMENT\n"), part(11, "Counsel present\n-----\n"), F.coalesce("input_text", F.lit("")))
    return s.select("case_id", text.alias("text"))


_APP = "(" + "|".join(cleaning.APPEARANCE) + ")"
_STRONG = "(" + "|".join(f"({p})" for p in cleaning.STRONG_STARTS) + ")"
_WEAK = "(" + "|".join(f"({p})" for p in cleaning.WEAK_STARTS) + ")"
_STARTS = rf"""(with d as (select case_id, list_filter(string_split(text, chr(10)), lambda el: trim(el) <> '') as lines from {_HEADED}),
l as (select case_id, i - 1 as i, lines[i] as line, len(lines) as n from (select case_id, lines, unnest(generate_series(1, len(lines))) as i from d)),
f as (select *, regexp_matches(line, '(?i){_APP}') as seen from l),
g as (select *, coalesce(bool_or(seen) over w, false) as on_, coalesce(max(case when seen then i end) over w, 0) as last from f window w as (partition by case_id order by i rows unbounded preceding)),
c as (select *, case when regexp_matches(trim(line), '(?i){_STRONG}') then greatest(0, i - 2) when on_ and i > last + 4 and regexp_matches(line, '(?i){_WEAK}') then greatest(0, i - 3)
when on_ and regexp_matches(trim(line), '{cleaning.RULES}') then i + 1 end as cand from g),
s as (select case_id, arg_min(cand, i) filter (where cand is not null) as first, max(last) as last, max(n) as n from c group by case_id)
select d.case_id, d.lines, coalesce(s.first, case when s.last > 4 and s.last < s.n - 6 then least(s.last + 6, s.n - 1) end, len(d.lines)) as start from d left join s on s.case_id = d.case_id)"""


@query(f"select case_id, start from {_STARTS}")
def body_start(spark, folder):
    d = _headed(spark, folder).withColumn("lines", cleaning.full_lines(F.col("text")))
    return cleaning.body_starts(d, ["case_id"], "lines").select("case_id", F.col("start").cast("bigint").alias("start"))


_PREAMBLE = f"""(select case_id, {STRIP(f'''array_to_string(list_transform(lines[s + 1:len(lines)], lambda el: case when regexp_matches(lower(el), '{T.BENCH_WORDS.replace("'", "''")}') then '' else el end), chr(10))''')} as text
from (select case_id, lines, case when start >= len(lines) - 3 then least(20, len(lines)) else start end as s from {_STARTS}))"""


@query(f"select case_id, text from {_PREAMBLE}")
def strip_preamble(spark, folder):
    return cleaning.strip_preamble(_headed(spark, folder), ["case_id"], "text")


_GATED = f"(select h.case_id, length(h.text) as raw, length(p.text) as clean from {_HEADED} h join {_PREAMBLE} p on p.case_id = h.case_id)"


def _gated(spark, folder):
    h = _headed(spark, folder).withColumn("raw", F.length(T.strip(F.col("text"))))
    return cleaning.strip_preamble(h, ["case_id", "raw"], "text").withColumn("clean", F.length("text"))


@query(f"select case_id from {_GATED} where raw >= 100 and clean >= 100")
def clean_gate(spark, folder):
    return _gated(spark, folder).where("raw >= 100 and clean >= 100").select("case_id")


@query(f"""select count(*) as total, count(*) filter (where raw >= 100 and clean >= 100) as kept, count(*) filter (where raw < 100) as skipped_raw, count(*) filter (where raw >= 100 and clean < 100) as skipped_clean,
sum(raw) filter (where raw >= 100 and clean >= 100)::bigint // greatest(1, count(*) filter (where raw >= 100 and clean >= 100)) as mean_raw, sum(clean) filter (where raw >= 100 and clean >= 100)::bigint // greatest(1, count(*) filter (where raw >= 100 and clean >= 100)) as mean_clean,
{_HALF4.format("max(1.0::double - clean::double / raw) filter (where raw >= 100 and clean >= 100)")} as max_ratio, count(*) filter (where raw >= 100 and clean >= 100 and 1.0::double - clean::double / raw > 0.5) as over_half from {_GATED}""")
def cleaning_stats(spark, folder):
    return quality.cleaning_stats(_gated(spark, folder))


# ---------------------------------------------------------------- segmentation

_PARTS = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '\n\s*\n', chr(1), 'g'),
'\n(\d+\.\s|\[\d+\]\s|\([ivx]+\)\s|[A-Z][a-z]+:\s|[•\-]+\s)', chr(1) || '\1', 'g'), chr(1)), lambda el: {STRIP('el')}), lambda el: el <> '')"""
_MERGED = """list_reduce(list_transform({0}, lambda el: {{'d': []::varchar[], 'c': el}}), lambda acc, nx: case when length(nx.c) < 50 then {{'d': acc.d, 'c': acc.c || ' ' || nx.c}} else {{'d': list_append(acc.d, acc.c), 'c': nx.c}} end)"""


def _texts(spark, folder):
    return table(spark, folder, "summarization_dataset").where("input_text is not null").groupBy("case_id").agg(F.min("input_text").alias("text"))


_TEXTS = "(select case_id, min(input_text) as text from summarization_dataset where input_text is not null group by case_id)"


@query(f"select case_id, {_PARTS} as parts from {_TEXTS}")
def para_split(spark, folder):
    return _texts(spark, folder).select("case_id", segments.split_paragraphs(F.col("text")).alias("parts"))


_ISLANDS = f"(select case_id, text, list_append(r.d, r.c) as parts from (select case_id, text, {_MERGED.format(_PARTS)} as r from {_TEXTS}))"


@query(f"select case_id, parts from {_ISLANDS}")
def fragment_merge(spark, folder):
    return _texts(spark, folder).select("case_id", segments.merge_fragments(segments.split_paragraphs(F.col("text"))).alias("parts"))


def _packed(parts: str, limit: int) -> str:
    return f"""(list_reduce(list_transform({parts}, lambda el: {{'d': []::varchar[], 'c': el}}), lambda acc, nx: case when length(acc.c) + length(nx.c) + 1 <= {limit} then {{'d': acc.d, 'c': case when acc.c <> '' then acc.c || ' ' || nx.c else nx.c end}}
else {{'d': case when acc.c <> '' then list_append(acc.d, trim(acc.c)) else acc.d end, 'c': nx.c}} end, {{'d': []::varchar[], 'c': ''}}))"""


_LEGAL = r"""string_split(regexp_replace(regexp_replace(regexp_replace(p, '(\.)\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '(\.)\s+(\([a-z]\)\s)', '\1' || chr(1) || '\2', 'g'), '([.;])\s+(\d+\.)', '\1' || chr(1) || '\2', 'g'), chr(1))"""
_SENT = r"string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _long(limit: int) -> str:
    """SQL from rows (k, p) to (k, chunks)."""
    return f"""(select k, case when length(p) <= {limit} then [p] when len(legal) > 1 and len(list_filter(packed, lambda el: length(el) <= {limit})) > 0 then packed
else flatten(list_transform(sent, lambda el: list_transform(generate_series(0, (length(el) - 1) // {limit}), lambda j: substr(el, (j * {limit} + 1)::bigint, {limit})))) end as chunks
from (select *, list_append(a.d, trim(a.c)) as packed, list_append(b.d, trim(b.c)) as sent from (select k, p, {_LEGAL} as legal, {_packed(_LEGAL, limit)} as a, {_packed(_SENT, limit)} as b from t)))"""


@query(f"with t as (select case_id::varchar || '-' || para_id as k, text as p from {PARAS}) select k, chunks from {_long(400)}")
def split_long(spark, folder):
    p = paragraphs(spark, folder)
    return p.select(F.concat_ws("-", "case_id", "para_id").alias("k"), segments.split_long(F.col("text"), 400).alias("chunks"))


@query(f"with t as (select case_id::varchar || '-' || para_id as k, text as p from {PARAS}) select k, chunks from {_long(1500)}")
def split_long_full(spark, folder):
    """At the limit of production."""
    p = paragraphs(spark, folder)
    return p.select(F.concat_ws("-", "case_id", "para_id").alias("k"), segments.split_long(F.col("text")).alias("chunks"))


@query(f"""with t as (select {{'c': case_id, 'j': j}} as k, p from (select case_id, unnest(parts) as p, generate_subscripts(parts, 1) as j from {_ISLANDS})),
s as (select k.c as case_id, flatten(list(chunks order by k.j))[1:800] as parts from {_long(1500)} group by 1) select case_id, generate_subscripts(parts, 1) as para_id, unnest(parts) as text from s""")
def segment_cases(spark, folder):
    """The segmentation stage as a whole, with its limits."""
    d = _texts(spark, folder).select("case_id", F.posexplode(segments.segment(F.col("text"))).alias("at", "text"))
    return d.select("case_id", (F.col("at") + 1).cast("bigint").alias("para_id"), "text")


# a paragraph of three is spaced otherwise, one of ten is not in the text
_ALIGN = f"(select case_id, text, list_transform(parts, lambda el, ix: case when ix % 10 = 0 then 'zzz ' || el when ix % 3 = 0 then replace(el, ' ', '  ') else el end) as parts from {_ISLANDS})"
_SPACED = r"regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query(f"""select case_id, list_transform(r.d, lambda el: el.s) as starts, list_transform(r.d, lambda el: el.m) as modes from (select case_id, list_reduce(list_transform(parts, lambda el: {{'d': []::struct(s bigint, m varchar)[], 'at': 0::bigint, 'p': el}}),
lambda acc, nx: (case when strpos(substr(text, acc.at + 1), nx.p) > 0 then {{'d': list_append(acc.d, {{'s': (acc.at + strpos(substr(text, acc.at + 1), nx.p) - 1)::bigint, 'm': 'exact'}}), 'at': (acc.at + strpos(substr(text, acc.at + 1), nx.p) - 1 + length(nx.p))::bigint, 'p': ''}}
when strpos({_SPACED.format('substr(text, acc.at + 1)')}, {_SPACED.format('nx.p')}) > 0 then {{'d': list_append(acc.d, {{'s': (acc.at + strpos({_SPACED.format('substr(text, acc.at + 1)')}, {_SPACED.format('nx.p')}) - 1)::bigint, 'm': 'spaced'}}), 'at': (acc.at + strpos({_SPACED.format('substr(text, acc.at + 1)')}, {_SPACED.format('nx.p')}) - 1 + length(nx.p))::bigint, 'p': ''}}
else {{'d': list_append(acc.d, {{'s': null::bigint, 'm': 'failed'}}), 'at': (acc.at + length(nx.p))::bigint, 'p': ''}} end), {{'d': []::struct(s bigint, m varchar)[], 'at': 0::bigint, 'p': ''}}) as r from {_ALIGN})""")
def align_paras(spark, folder):
    parts = segments.merge_fragments(segments.split_paragraphs(F.col("text")))
    d = _texts(spark, folder).withColumn("parts", F.transform(parts, lambda p, i: F.when((i + 1) % 10 == 0, F.concat(F.lit("zzz "), p)).when((i + 1) % 3 == 0, F.replace(p, F.lit(" "), F.lit("  "))).otherwise(p)))
    d = d.select("case_id", segments.align(F.col("text"), F.col("parts")).alias("a"))
    return d.select("case_id", F.transform("a", lambda x: x["start"].cast("bigint")).alias("starts"), F.transform("a", lambda x: x["mode"]).alias("modes"))


@query(rf"select case_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda el: {STRIP('el')}), lambda el: el <> '') as sentences from {_TEXTS}")
def sentence_split(spark, folder):
    return _texts(spark, folder).select("case_id", segments.sentences(F.col("text")).alias("sentences"))


def _blocks(spark, folder):
    return paragraphs(spark, folder).select("case_id", "para_id", F.ceil(F.col("para_id") / 4).cast("int").alias("page_number"), "text")


_PACK = rf"""(with s as (select case_id, ceil(para_id / 4)::int as page, para_id, unnest(list_filter(list_transform({_SENT.replace('(p,', '(text,')}, lambda el: {STRIP('el')}), lambda el: el <> '')) as t, generate_subscripts(list_filter(list_transform({_SENT.replace('(p,', '(text,')}, lambda el: {STRIP('el')}), lambda el: el <> ''), 1) as j from {PARAS}),
g as (select case_id, list({{'t': t, 'pg': page, 'n': len(list_filter(regexp_split_to_array(t, '\s+'), lambda el: el <> ''))::int}} order by para_id, j) as ss from s group by case_id),
r as (select case_id, list_reduce(list_transform(ss, lambda el: {{'d': []::struct(t varchar, pg int, n int)[], 'w': [el.t], 'pg': el.pg, 'n': el.n}}), lambda acc, nx: case when acc.n + nx.n > 400 and acc.n > 0
then {{'d': list_append(acc.d, {{'t': array_to_string(acc.w, ' '), 'pg': acc.pg, 'n': acc.n}}), 'w': nx.w, 'pg': nx.pg, 'n': nx.n}} else {{'d': acc.d, 'w': list_concat(acc.w, nx.w), 'pg': least(acc.pg, nx.pg), 'n': acc.n + nx.n}} end) as x from g),
c as (select case_id, list_append(x.d, {{'t': array_to_string(x.w, ' '), 'pg': x.pg, 'n': x.n}}) as cs from r)
select case_id, generate_subscripts(cs, 1)::int as chunk_id, unnest(cs) as c from c)"""


def _chunks(spark, folder):
    return segments.chunk_blocks(_blocks(spark, folder), "case_id", ["para_id"])


@query(f"select case_id, chunk_id, c.t as text, c.pg as page_number, c.n as word_count from {_PACK}")
def chunk_pack(spark, folder):
    return _chunks(spark, folder)


@query(f"select case_id, chunk_id, c.pg as page_number, c.n as word_count, len(list_distinct(regexp_extract_all(c.t, '(?i)(?:^|[^A-Za-z0-9_])(IPC\\s*[0-9]+|BNS\\s*[0-9]+|CrPC\\s*[0-9]+|Section\\s*[0-9]+\\s+of\\s+[A-Za-z\\s]+Act|Art(?:icle)?s?\\.?\\s*[0-9]+)(?:[^A-Za-z0-9_]|$)', 1)))::int as n_statutes from {_PACK}")
def chunk_enrich(spark, folder):
    return _chunks(spark, folder).select("case_id", "chunk_id", "page_number", "word_count", F.size(T.statute_references(F.col("text"))).alias("n_statutes"))


# ---------------------------------------------------------------- order within a case


@query(f"select case_id, para_id, row_number() over (partition by case_id order by para_id) as number from {PARAS}")
def para_number(spark, folder):
    p = scans.numbered(paragraphs(spark, folder).select("case_id", "para_id"), ["case_id"], ["para_id"], "number")
    return p.withColumn("number", F.col("number") + 1)


@query(f"""select case_id, para_id, case when i * 5 < n then 'start' when i * 5 > n * 4 then 'end' else 'middle' end as position
from (select case_id, para_id, row_number() over (partition by case_id order by para_id) - 1 as i, count(*) over (partition by case_id) as n from {PARAS})""")
def position_bucket(spark, folder):
    p = paragraphs(spark, folder).select("case_id", "para_id")
    return segments.positions(p, "case_id", "para_id")


# ---------------------------------------------------------------- the gate

_CASES = f"""(select case_id, count(*) as n, count(*) filter (where alignment_failed) as failed, count(*) filter (where len_ > 2000) as long, sum(len_)::bigint as total,
bool_or(list_contains(coalesce(paragraph_roles, []), 'reasoning') or list_contains(coalesce(paragraph_roles, []), 'facts')) as argued from (select *, coalesce(nullif(length, 0), length(text)) as len_ from {PARAS}) group by case_id)"""
_REASONS = f"""(select *, list_filter([case when n < 5 then 'too_few_paragraphs_' || n end, case when n > 800 then 'too_many_paragraphs_' || n end, case when failed * 10 > n * 3 then 'high_align_fail' end, case when long > 5 then 'too_many_long_paragraphs_' || long end,
case when total < 800 then 'doc_too_short_' || total end, case when not argued and total < 2000 then 'no_reasoning_or_facts' end], lambda el: el is not null) as reasons from {_CASES})"""


@query(f"select case_id, len(reasons) = 0 as valid, reasons from {_REASONS}")
def validate_case(spark, folder):
    return quality.validated(table(spark, folder, "judgments_paragraphs")).select("case_id", "valid", "reasons")


@query(f"select reason, count(*) as n from (select unnest(reasons) as reason from {_REASONS}) group by 1")
def removal_breakdown(spark, folder):
    return quality.breakdown(quality.validated(table(spark, folder, "judgments_paragraphs")))


@query(f"select reason, count(*) as n from (select unnest(reasons) as reason from {_REASONS}) group by 1 order by n desc, reason limit 12")
def removal_top12(spark, folder):
    return quality.breakdown(quality.validated(table(spark, folder, "judgments_paragraphs"))).orderBy(F.desc("n"), "reason").limit(12)


@query(f"select count(*) as total, count(*) filter (where len(reasons) = 0) as kept, count(*) filter (where len(reasons) > 0) as removed, floor(count(*) filter (where len(reasons) = 0) * 10000.0::double / count(*) + 0.5) / 100.0::double as kept_pct from {_REASONS}")
def filter_report(spark, folder):
    return quality.report(quality.validated(table(spark, folder, "judgments_paragraphs")))


@query(f"select case_id, para_id, case when length(text) > 2000 then substr(text, 1, 2000) else text end as text, case when length(text) > 2000 then 2000 else length end as length, case when length(text) > 2000 then true end as truncated from {PARAS}")
def truncate_paras(spark, folder):
    return quality.truncated(paragraphs(spark, folder)).select("case_id", "para_id", "text", "length", "truncated")


@query()
def filter_metadata(spark, folder):
    return quality.with_metadata(quality.validated(table(spark, folder, "judgments_paragraphs")).where("valid")).select("case_id", "filter")


@query(f"select case_id, para_id from {PARAS} where coalesce(usable_for_evidence, true)")
def usable_filter(spark, folder):
    return paragraphs(spark, folder).where(F.coalesce("usable_for_evidence", F.lit(True))).select("case_id", "para_id")


@query(f"""select count(*) as cases, sum(n)::bigint as paragraphs, {_HALF4.format('sum(n)::double / count(*)')} as mean_paragraphs, max(n) as most, min(n) as least, count(*) filter (where failed > 0) as with_failures, count(*) filter (where failed * 10 > n * 3) as low_quality from {_CASES}""")
def segmentation_stats(spark, folder):
    return quality.segmentation_stats(quality.validated(table(spark, folder, "judgments_paragraphs")))


@query(f"""with c as (select case_id, n from {_CASES}) select 'first' as sample, * from (select case_id, n from c order by case_id limit 50) union all
select 'longest', * from (select case_id, n from c order by n desc, case_id limit 25) union all select 'shortest', * from (select case_id, n from c order by n, case_id limit 25)""")
def segment_samples(spark, folder):
    return quality.samples(quality.validated(table(spark, folder, "judgments_paragraphs")).select("case_id", "n"))


@query(ORACLES["cleaning_stats"])
def report_roundtrip(spark, folder):
    """The cleaning report written as one JSON file and read back."""
    from lexweave.sources import jsonl

    path = f"{jsonl.shared_folder(spark)}/report-{spark.sparkContext.applicationId}-{folder.strip('/').replace('/', '-')}"
    report = quality.cleaning_stats(_gated(spark, folder))
    jsonl.write_report(report, path)
    return spark.read.schema(report.schema).json(path)
