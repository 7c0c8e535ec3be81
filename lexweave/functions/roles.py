"""Rhetorical roles of paragraphs by rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.text import contains_any

ROLES = ["facts", "arguments", "reasoning", "statutory", "final_decision", "procedural", "issues", "other"]

# Patterns and phrases of the rules, on lower-cased text.
DECISION = r"\b(allowed|dismissed|disposed|quashed|set aside|acquitted|convicted|rule made absolute|petition stands disposed|appeal stands dismissed|no order as to costs|accordingly allowed)\b"
REASONING = r"\b(in my view|we hold|we are of the opinion|it follows that|therefore we hold|thus we conclude)\b"
STATUTE = r"\b(section\s+\d+|article\s+\d+|rule\s+\d+|act\s+of\s+\d{4}|sub-?section\s*\(\d+\))\b"
FACT = r"\b(petitioner|respondent|plaintiff|defendant|filed|arose|background|case of|incident|facts of the case)\b"
PROCEDURE = r"^(coram|appearance|before:|present:|order sheet|registry|bench:)\b"
DECISION_WORDS = ["allowed", "dismissed", "disposed", "quashed", "set aside"]
ARGUMENT_WORDS = ["learned counsel", "petitioner submits", "respondent contends"]
START_FACT_WORDS = ["notification", "corrigendum", "applications", "filed"]
FACT_WORDS = ["according to the petitioners", "according to the respondents", "the facts of the case"]
ANALYSIS_WORDS = ["held", "observed", "therefore", "thus", "we conclude", "it follows"]
START_PROCEDURE_WORDS = ["notification", "circular", "application"]
ISSUE_WORDS = ["question is", "issue is"]
OPINION_WORDS = ["we are of the opinion", "it follows that"]
BIAS_WORDS = [*ANALYSIS_WORDS, "we are of the opinion"]
REASONING_CUES = [
    "we are of the opinion", "it follows that", "therefore we hold", "thus we conclude", "in our view", "we hold", "this court has held", "as held in", "indira sawhney",
    "pradeep tandon", "compartmentalised", "overall reservation", "horizontal reservation", "vertical reservation", "article 15", "article 16", "it is clear that",
    "it would be better", "in the interest of", "we must yet take notice", "on a careful consideration", "we may explain", "it is not possible to give", "res judicata",
    "judgment in rem", "res sub-judice",
]
QUESTION_WORDS = ["the question is", "point for determination", "main question", "issue that arises"]
COURT_WORDS = ["we are of the opinion", "it follows that", "it would be better", "on a careful consideration"]
LONG_FACT_WORDS = ["candidate", "seat", "reservation", "petition"]
HELD_WORDS = ["held by this court", "indira sawhney", "pradeep tandon", "it follows that"]
PROCEDURE_WORDS = ["procedure", "application", "ia no", "section 10"]
SYNONYMS = {"background": "facts", "case history": "facts", "events": "facts", "analysis": "reasoning", "discussion": "reasoning", "observation": "reasoning", "decision": "final_decision", "held": "reasoning"}
DRIFT = {
    **SYNONYMS, "history": "facts", "narration": "facts", "story": "facts", "opinion": "reasoning", "order": "final_decision", "relief": "final_decision", "statute": "statutory",
    "law": "statutory", "provision": "statutory", "preamble": "procedural", "header": "procedural", "metadata": "procedural", "question": "issues", "point": "issues",
}


def _like(t: Column, pattern: str) -> Column:
    return t.rlike("(?U)" + pattern)


def routed(lower: Column, length: Column) -> Column:
    """struct<role, source> of the first pattern that matches within its length, else null. lower: the text in lower case."""
    rule = lambda role, kind: F.struct(F.lit(role).alias("role"), F.lit(f"regex_{kind}").alias("source"))
    return (
        F.when(_like(lower, DECISION), rule("final_decision", "decision"))
        .when((length < 400) & _like(lower, REASONING), rule("reasoning", "reasoning"))
        .when((length < 500) & _like(lower, FACT), rule("facts", "facts"))
        .when((length < 300) & _like(lower, STATUTE), rule("statutory", "statutory"))
        .when((length < 600) & _like(lower, PROCEDURE), rule("procedural", "procedural"))
    )


def hard_rule(lower: Column, length: Column, position: Column, routed_role: Column) -> Column:
    """The role that rules alone decide, else null."""
    start = F.coalesce(position == "start", F.lit(False))
    return (
        F.when(routed_role.isNotNull(), routed_role)
        .when(contains_any(lower, DECISION_WORDS), "final_decision")
        .when(contains_any(lower, ARGUMENT_WORDS), "arguments")
        .when(start & contains_any(lower, START_FACT_WORDS), "facts")
        .when(contains_any(lower, FACT_WORDS), "facts")
        .when(contains_any(lower, ["section", "article"]) & ~contains_any(lower, ANALYSIS_WORDS) & (length < 400), "statutory")
        .when(start & contains_any(lower, START_PROCEDURE_WORDS), "procedural")
        .when(contains_any(lower, ISSUE_WORDS), "issues")
    )


def fallback(lower: Column, length: Column, position: Column) -> Column:
    """A role for every text, by position and patterns."""
    return (
        F.when((position == "start") & (length < 500), "facts")
        .when((position == "end") & _like(lower, DECISION), "final_decision")
        .when(_like(lower, STATUTE), "statutory")
        .when(_like(lower, REASONING), "reasoning")
        .when(_like(lower, FACT), "facts")
        .when(_like(lower, PROCEDURE), "procedural")
        .when(contains_any(lower, OPINION_WORDS), "reasoning")
        .otherwise("other")
    )


def unbias(lower: Column, role: Column) -> Column:
    return F.when((role == "statutory") & contains_any(lower, BIAS_WORDS), "reasoning").otherwise(role)


def boost(lower: Column, role: Column) -> Column:
    return F.when(contains_any(lower, REASONING_CUES), "reasoning").otherwise(role)


def safety(lower: Column, length: Column, role: Column) -> Column:
    asked = contains_any(lower, QUESTION_WORDS)
    return (
        F.when((role == "issues") & ~asked & contains_any(lower, COURT_WORDS), "reasoning")
        .when((role == "issues") & ~asked & (length > 450) & contains_any(lower, LONG_FACT_WORDS), "facts")
        .when((role == "arguments") & contains_any(lower, COURT_WORDS), "reasoning")
        .when((role == "statutory") & contains_any(lower, HELD_WORDS), "reasoning")
        .when((role == "facts") & contains_any(lower, PROCEDURE_WORDS), "procedural")
        .otherwise(role)
    )


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def synonym(label: Column) -> Column:
    """A model's label by its synonym; labels that are no role are other."""
    t = F.lower(F.trim(label))
    t = F.coalesce(_mapped(SYNONYMS, t), t)
    return F.when(t.isin(ROLES), t).otherwise("other")


def drifted(label: Column) -> Column:
    """A label reduced to letters and underscores, by the wider table; null, empty and unknown labels are other."""
    t = F.regexp_replace(F.lower(F.trim(label)), "[^a-z_]", "")
    return F.when(t.isin(ROLES), t).otherwise(F.coalesce(_mapped(DRIFT, t), F.lit("other")))


def parsed_labels(answer: Column, n: int, part: Column) -> Column:
    """n labels of a model's answer: the JSON list `labels` if it has n, else the first n role names in it, else those of its
    lines that are a role name once all but letters and underscores is dropped, else null.

    part: the answer's JSON part.
    """
    names = F.regexp_extract_all(F.lower(answer), F.lit(r"(?U)\b(" + "|".join(ROLES) + r")\b"), F.lit(1))
    lines = F.filter(F.transform(F.split(F.lower(answer), "\n"), lambda x: F.regexp_replace(x, "[^a-z_]", "")), lambda x: x.isin(ROLES))
    listed = F.from_json(part, "labels array<string>")["labels"]
    return F.when(F.size(listed) == n, listed).when(F.size(names) >= n, F.slice(names, 1, n)).when(F.size(lines) >= n, F.slice(lines, 1, n))
