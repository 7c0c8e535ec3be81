"""Queries of role labelling and structured summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.functions import roles as R
from lexweave.functions import text as T
from lexweave.operators import labelling
from lexweave.plans.base import PARAS, STRIP, any_of, paragraphs, query, table


def _m(p: str) -> str:
    return f"regexp_matches(tl, '{p}')"


_ROUTE = [(_m(R.DECISION), "final_decision", "decision"), (f"n < 400 and {_m(R.REASONING)}", "reasoning", "reasoning"), (f"n < 500 and {_m(R.FACT)}", "facts", "facts"), (f"n < 300 and {_m(R.STATUTE)}", "statutory", "statutory"), (f"n < 600 and {_m(R.PROCEDURE)}", "procedural", "procedural")]
_ROUTED = "case " + " ".join(f"when {c} then '{r}'" for c, r, _ in _ROUTE) + " end"
_SOURCE = "case " + " ".join(f"when {c} then 'regex_{s}'" for c, _, s in _ROUTE) + " end"
_HARD = f"""case when {_ROUTED} is not null then {_ROUTED} when {any_of('tl', R.DECISION_WORDS)} then 'final_decision' when {any_of('tl', R.ARGUMENT_WORDS)} then 'arguments'
when position = 'start' and {any_of('tl', R.START_FACT_WORDS)} then 'facts' when {any_of('tl', R.FACT_WORDS)} then 'facts'
when {any_of('tl', ['section', 'article'])} and not {any_of('tl', R.ANALYSIS_WORDS)} and n < 400 then 'statutory' when position = 'start' and {any_of('tl', R.START_PROCEDURE_WORDS)} then 'procedural'
when {any_of('tl', R.ISSUE_WORDS)} then 'issues' end"""
_SPARE = f"""case when position = 'start' and n < 500 then 'facts' when position = 'end' and {_m(R.DECISION)} then 'final_decision' when {_m(R.STATUTE)} then 'statutory' when {_m(R.REASONING)} then 'reasoning'
when {_m(R.FACT)} then 'facts' when {_m(R.PROCEDURE)} then 'procedural' when {any_of('tl', R.OPINION_WORDS)} then 'reasoning' else 'other' end"""
_P = f"(select *, lower(text) as tl, length(text) as n from {PARAS})"
_RULED = f"(select *, {_ROUTED} as routed, {_SOURCE} as routed_source, {_HARD} as rule, {_SPARE} as spare from {_P})"
_BATCHED = f"(select *, (row_number() over (partition by case_id order by para_id) - 1) // 4 as batch from {_RULED} where coalesce(usable_for_evidence, true))"
_OFFLINE = f"""(select case_id, para_id, case when ruled then rule when routed is not null then routed else spare end as role, case when ruled then 'rule' when routed is not null then routed_source else 'rule_fallback' end as source,
case when ruled or routed is not null then 0.9::double else 0.4::double end as confidence from (select *, bool_and(rule is not null) over (partition by case_id, batch) as ruled from {_BATCHED})
union all select case_id, para_id, 'other', 'auto_filled', 0.0::double from {PARAS} where not coalesce(usable_for_evidence, true))"""


def _ruled(spark, folder):
    """The rules' columns without the texts, which are not shuffled to find what was sent again."""
    r = labelling.ruled(table(spark, folder, "judgments_paragraphs"))
    return r.select("case_id", "para_id", "usable_for_evidence", "routed", "rule", "spare").dropDuplicates(["case_id", "para_id"])


def _labels(spark, folder):
    return labelling.label(table(spark, folder, "judgments_paragraphs"))


@query(f"select case_id, para_id, {_ROUTED} as role, {_SOURCE} as source from {_P}")
def regex_router(spark, folder):
    return _ruled(spark, folder).select("case_id", "para_id", F.col("routed.role").alias("role"), F.col("routed.source").alias("source"))


@query(f"select case_id, para_id, {_HARD} as role from {_P}")
def hard_rules(spark, folder):
    return _ruled(spark, folder).select("case_id", "para_id", F.col("rule").alias("role"))


@query(f"select case_id, para_id, {_SPARE} as role from {_P}")
def fallback_rule(spark, folder):
    return _ruled(spark, folder).select("case_id", "para_id", F.col("spare").alias("role"))


_SAFE = f"""case when r = 'issues' and not {any_of('tl', R.QUESTION_WORDS)} and {any_of('tl', R.COURT_WORDS)} then 'reasoning' when r = 'issues' and not {any_of('tl', R.QUESTION_WORDS)} and n > 450 and {any_of('tl', R.LONG_FACT_WORDS)} then 'facts'
when r = 'arguments' and {any_of('tl', R.COURT_WORDS)} then 'reasoning' when r = 'statutory' and {any_of('tl', R.HELD_WORDS)} then 'reasoning' when r = 'facts' and {any_of('tl', R.PROCEDURE_WORDS)} then 'procedural' else r end"""
_BOOST = f"case when {any_of('tl', R.REASONING_CUES)} then 'reasoning' else {{}} end"
_BIAS = f"case when {{0}} = 'statutory' and {any_of('tl', R.BIAS_WORDS)} then 'reasoning' else {{0}} end"
_CYCLE = "['facts', 'arguments', 'statutory', 'issues', 'procedural', 'other']"


@query(f"select case_id, para_id, {_BIAS.format('r')} as unbiased, {_BOOST.format('r')} as boosted, {_SAFE} as safe from (select *, {_CYCLE}[(para_id % 6 + 1)::int] as r from {_P})")
def role_postfix(spark, folder):
    names = F.array(*[F.lit(x) for x in ["facts", "arguments", "statutory", "issues", "procedural", "other"]])
    p = labelling.ruled(paragraphs(spark, folder)).withColumn("r", F.element_at(names, (F.col("para_id") % 6 + 1).cast("int")))
    low = F.col("lower")
    return p.select("case_id", "para_id", R.unbias(low, F.col("r")).alias("unbiased"), R.boost(low, F.col("r")).alias("boosted"), R.safety(low, F.col("size"), F.col("r")).alias("safe"))


def _cases(table_: dict[str, str], c: str) -> str:
    return "case " + " ".join(f"when {c} = '{k}' then '{v}'" for k, v in table_.items()) + " end"


_IN = "('" + "','".join(R.ROLES) + "')"
_WORDS = "(select distinct unnest(string_split(lower(metadata.section) || ' Held ' || ' analysis ' || ' Background ' || ' nothing ' || ' law ' || ' decision. ' || ' statutory ', ' ')) as label from pdf_chunks where metadata.section is not null)"


def _words(spark, folder):
    s = table(spark, folder, "pdf_chunks").where("metadata.section is not null")
    text = F.concat(F.lower("metadata.section"), F.lit(" Held  analysis  Background  nothing  law  decision.  statutory "))
    return s.select(F.explode(F.split(text, " ")).alias("label")).distinct()


@query(f"select label, case when l in {_IN} then l else coalesce({_cases(R.DRIFT, 'l')}, 'other') end as role from (select label, regexp_replace(lower(trim(label)), '[^a-z_]', '', 'g') as l from {_WORDS})")
def normalize_label(spark, folder):
    return _words(spark, folder).select("label", R.drifted(F.col("label")).alias("role"))


@query(f"select label, case when coalesce({_cases(R.SYNONYMS, 'l')}, l) in {_IN} then coalesce({_cases(R.SYNONYMS, 'l')}, l) else 'other' end as role from (select label, lower(trim(label)) as l from {_WORDS})")
def label_synonyms(spark, folder):
    return _words(spark, folder).select("label", R.synonym(F.col("label")).alias("role"))


_ANSWER = """case case_id % 3 when 0 then 'Here: {"labels": ["facts", "issues"]} done' when 1 then 'I say Facts, then reasoning and other' else 'none of these' end"""


@query(f"""select case_id, case when case_id % 3 = 0 then ['facts', 'issues'] when len(regexp_extract_all(lower(a), '\\b(facts|arguments|reasoning|statutory|procedural|issues|final_decision|other)\\b', 1)) >= 2
then regexp_extract_all(lower(a), '\\b(facts|arguments|reasoning|statutory|procedural|issues|final_decision|other)\\b', 1)[1:2] end as labels from (select distinct case_id, {_ANSWER} as a from summarization_dataset)""")
def parse_labels(spark, folder):
    a = F.expr(_ANSWER)
    d = table(spark, folder, "summarization_dataset").select("case_id", a.alias("a")).distinct()
    return d.select("case_id", R.parsed_labels(F.col("a"), 2, T.json_part(F.col("a"))).alias("labels"))


@query(f"select case_id, para_id, (row_number() over (partition by case_id order by para_id) - 1) // 4 as batch from {PARAS} where coalesce(usable_for_evidence, true)")
def batch_assign(spark, folder):
    return labelling.batched(paragraphs(spark, folder).select("case_id", "para_id", "usable_for_evidence")).select("case_id", "para_id", "batch")


@query(f"select case_id, batch, bool_and(rule is not null) as all_ruled from {_BATCHED} group by all")
def batch_all_ruled(spark, folder):
    b = labelling.batched(_ruled(spark, folder).select("case_id", "para_id", "usable_for_evidence", "rule"))
    return b.groupBy("case_id", "batch").agg(F.bool_and("all_ruled").alias("all_ruled"))


@query(f"select case_id, para_id, role, source, confidence from {_OFFLINE}")
def label_offline(spark, folder):
    return _labels(spark, folder)


_FAKE = "case length(text) % 5 when 0 then 'background' when 1 then 'statutory' when 2 then 'arguments' when 3 then 'Analysis' else 'nonsense' end"
_NORM = "case length(text) % 5 when 0 then 'facts' when 1 then 'statutory' when 2 then 'arguments' when 3 then 'reasoning' else 'other' end"
_FIX1 = f"(select *, {_BIAS.format('f0')} as f1 from (select *, {_NORM} as f0 from {_BATCHED}))"
_FIX2 = f"(select *, {_BOOST.format('f1')} as f2 from {_FIX1})"
_FIX3 = f"(select *, {_BIAS.format('f2')} as r from {_FIX2})"
_FIX4 = f"(select *, {_SAFE} as answer from {_FIX3})"


@query(f"""select case_id, para_id, coalesce(rule, answer) as role, case when rule is not null then 'rule' else 'llm' end as source, case when rule is not null then 0.9::double when answer = 'other' then 0.5::double else 0.8::double end as confidence from {_FIX4}
union all select case_id, para_id, 'other', 'auto_filled', 0.0::double from {PARAS} where not coalesce(usable_for_evidence, true)""")
def label_with_model(spark, folder):
    return labelling.label(table(spark, folder, "judgments_paragraphs"), F.expr(_FAKE))


@query(f"select p.case_id, p.para_id, p.position, o.role from {PARAS} p left join {_OFFLINE} o on o.case_id = p.case_id and o.para_id = p.para_id")
def role_scatter(spark, folder):
    p = paragraphs(spark, folder).select("case_id", "para_id", "position")
    return p.join(_labels(spark, folder).select("case_id", "para_id", "role"), ["case_id", "para_id"], "left")


@query(f"select case_id, role, count(*) as n from {_OFFLINE} group by all")
def role_distribution(spark, folder):
    return labelling.distribution(_labels(spark, folder))


@query(f"select role, count(*) as n, floor(count(*) * 10000.0::double / sum(count(*)) over () + 0.5) / 100.0::double as share from {_OFFLINE} group by role")
def role_share(spark, folder):
    g = _labels(spark, folder).groupBy("role").agg(F.count("*").alias("n"))
    return g.select("role", "n", (F.floor(F.col("n") * F.lit(10000.0) / F.sum("n").over(Window.partitionBy()) + 0.5) / F.lit(100.0)).alias("share"))  # a row per role


@query(f"select case_id, floor(avg(case when source in ('rule_fallback', 'llm_fallback') then 1.0::double else 0.0::double end) * 10000.0::double + 0.5) / 10000.0::double as rate from {_OFFLINE} group by case_id")
def fallback_rate(spark, folder):
    hit = F.when(F.col("source").isin("rule_fallback", "llm_fallback"), 1.0).otherwise(0.0)
    return _labels(spark, folder).groupBy("case_id").agg(T.half_up(F.avg(hit), 4).alias("rate"))


_S = lambda r: f"coalesce(string_agg(text, chr(10) || chr(10) order by para_id) filter (where role = '{r}'), '')"


_ROLE7 = "['facts', 'reasoning', 'issues', 'arguments', 'final_decision', 'statutory', 'procedural'][(para_id % 7 + 1)::int]"


@query(f"""select * from (select case_id, {_S('facts')} as facts, {_S('issues')} as issues, {_S('arguments')} as arguments, {_S('reasoning')} as reasoning, {_S('final_decision')} as decision
from (select case_id, para_id, text, {_ROLE7} as role from {PARAS}) group by case_id) where length(facts) > 100 and length(reasoning) > 100""")
def structured_summary(spark, folder):
    p = paragraphs(spark, folder)
    names = F.array(*[F.lit(x) for x in ["facts", "reasoning", "issues", "arguments", "final_decision", "statutory", "procedural"]])
    labels = p.select("case_id", "para_id", F.element_at(names, (F.col("para_id") % 7 + 1).cast("int")).alias("role"))
    return labelling.summaries(p, labels)


@query(f"""select * from (select case_id, {_S('facts')} as facts, {_S('issues')} as issues, {_S('arguments')} as arguments, {_S('reasoning')} as reasoning, {_S('final_decision')} as decision
from (select p.case_id, p.para_id, p.text, o.role from {PARAS} p join {_OFFLINE} o on o.case_id = p.case_id and o.para_id = p.para_id) group by case_id) where length(facts) > 100 and length(reasoning) > 100""")
def labelled_summary(spark, folder):
    """Summaries by the labeller's own roles."""
    return labelling.summaries(paragraphs(spark, folder), _labels(spark, folder))


@query(f"select case_id, sha256(string_agg({STRIP('text')}, '' order by para_id)) as text_hash from {PARAS} where coalesce(usable_for_evidence, true) group by case_id")
def text_hash(spark, folder):
    return labelling.text_hashes(paragraphs(spark, folder))


@query(f"select distinct case_id from {PARAS} where case_id not in (select case_id from summarization_dataset)")
def resume_anti(spark, folder):
    done = table(spark, folder, "summarization_dataset").select("case_id")
    return table(spark, folder, "judgments_paragraphs").select("case_id").distinct().join(done, "case_id", "left_anti")


_ONE = "case length(text) % 5 when 0 then ' Facts. ' when 1 then 'statutory' when 2 then 'nonsense' when 3 then null else 'Final_Decision!' end"
_ONE_ROLE = "case length(text) % 5 when 0 then 'facts' when 1 then 'statutory' when 4 then 'final_decision' end"


@query(f"""select case_id, para_id, coalesce(routed, {_ONE_ROLE}, spare) as role, case when routed is not null then routed_source when length(text) % 5 = 3 then 'rule_fallback' when length(text) % 5 = 2 then 'llm_fallback' else 'llm_single' end as source,
case when routed is not null then 0.9::double when length(text) % 5 = 3 then 0.4::double when length(text) % 5 = 2 then 0.5::double else 0.75::double end as confidence from {_RULED}""")
def label_single(spark, folder):
    return labelling.label_single(table(spark, folder, "judgments_paragraphs"), F.expr(_ONE))


@query(f"select case_id, map_from_entries(list((role, n) order by role)) as role_distribution from (select case_id, role, count(*) as n from {_OFFLINE} group by all) group by case_id")
def role_maps(spark, folder):
    return labelling.distribution_maps(_labels(spark, folder))
