"""Statute keys, references and clauses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.text import strip

# How articles, sections and codes are cited, and how punishments and explanations are introduced.
_ARTICLE = r"(?iU)^(?:Art(?:icle)?s?\.?\s*)(\d+[A-Za-z]*)"
_CODE = r"(?iU)^(IPC|BNS|CrPC|BNSS)[_\s]*"
_SECTION = r"(?iU)^Section\s+(\d+[A-Za-z]*)\s+(?:of\s+)?(?:the\s+)?(IPC|BNS|CrPC|Indian Penal Code|Bharatiya Nyaya Sanhita)"
_DIRECT = r"(?iU)^(IPC|BNS|CrPC|BNSS)[_\s]+(\d+[A-Za-z]*)"
_PUNISHMENTS = [r"shall be punished with (.+?)(?:\.|\z)", r"punishable with (.+?)(?:\.|\z)", r"punishment[:\s]+(.+?)(?:\.|\z)"]
_SIMPLE = r"(?isU)in Simple Words\s*\n(.+)"


def statute_key(law: Column, section: Column) -> Column:
    """The key of an entry: ARTICLE_n for articles and the constitution, else LAW_section. Null in either counts as ''."""
    law = F.upper(strip(F.coalesce(law, F.lit(""))))
    section = strip(F.coalesce(section, F.lit("")))
    article = F.regexp_extract(section, _ARTICLE, 1)
    bare = strip(F.regexp_replace(section, _CODE, ""))
    bare = F.when(bare == "", section).otherwise(bare)
    return (
        F.when(article != "", F.concat(F.lit("ARTICLE_"), F.upper(article)))
        .when(law == "CONSTITUTION", F.concat(F.lit("ARTICLE_"), F.upper(F.regexp_replace(F.replace(section, F.lit("Article"), F.lit("")), "[^0-9A-Za-z]", ""))))
        .otherwise(F.upper(F.concat(law, F.lit("_"), bare)))
    )


def reference_key(ref: Column) -> Column:
    """The key that a typed reference means, by its beginning; what fits no form is upper-cased with underscores."""
    ref = strip(ref)
    article = F.regexp_extract(ref, _ARTICLE, 1)
    number, law = F.regexp_extract(ref, _SECTION, 1), F.upper(F.regexp_extract(ref, _SECTION, 2))
    law = F.when(F.contains(law, F.lit("NYAYA")), "BNS").when(F.contains(law, F.lit("PENAL")), "IPC").otherwise(law)
    return (
        F.when(article != "", F.concat(F.lit("ARTICLE_"), F.upper(article)))
        .when(number != "", F.concat(law, F.lit("_"), F.upper(number)))
        .when(F.regexp_extract(ref, _DIRECT, 1) != "", F.concat(F.upper(F.regexp_extract(ref, _DIRECT, 1)), F.lit("_"), F.upper(F.regexp_extract(ref, _DIRECT, 2))))
        .otherwise(F.regexp_replace(F.upper(ref), r"(?U)\s+", "_"))
    )


def punishment(text: Column) -> Column:
    """The punishment clause, up to its full stop, of the first of three forms; over 300 characters cut with '...'; else null."""
    clause = strip(F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?iUd){f}", 1), F.lit("")) for f in _PUNISHMENTS]))
    return F.when(F.length(clause) > 300, F.concat(F.substring(clause, 1, 300), F.lit("..."))).otherwise(clause)


def simple_words(text: Column) -> Column:
    """All that follows the line 'in simple words'; null if there is none."""
    return strip(F.nullif(F.regexp_extract(text, _SIMPLE, 1), F.lit("")))


def law_badge(law: Column) -> Column:
    """The badge of an entry, by its law; a null law has that of unknown ones."""
    return F.when(law.isin("IPC", "BNS"), law).when(law == "CONSTITUTION", "ART").otherwise("UNKNOWN")


def cited_badge(ref: Column) -> Column:
    """The badge of a reference as it was typed."""
    u = F.upper(ref)
    return F.when(F.contains(u, F.lit("ART")), "ART").when(F.contains(u, F.lit("IPC")), "IPC").otherwise("BNS")
