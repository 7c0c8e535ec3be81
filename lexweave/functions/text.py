"""Text functions as column expressions. Patterns follow Python's reading of them: Unicode classes, `\\n` as the only line end."""

from __future__ import annotations

import html.parser
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that decide the type of a case, in the order in which they are tried.
CIVIL_WORDS = ["land", "property", "service", "tax", "civil"]
# Lines that a page leaves in a text; only what matches is removed.
FOOTERS = [r"^page\s*\d+(\s*of\s*\d+)?$", r"^indian\s*kanoon", r"^https?://indiankanoon\.org", r"^reportable\s*/\s*non.?reportable", r"^©\s*\d{4}\s*indian\s*kanoon"]
# Parts of a line that name the bench.
BENCH_WORDS = r"coram|bench|hon'?ble|justice|mr\.|ms\.|dr\."
# Phrases that a reasoned paragraph opens with.
REASONING_OPENERS = ["in the result", "therefore", "accordingly", "hence", "thus", "we hold", "we find", "in conclusion"]
# References to statutes, rules drawn across a page, marks that open a paragraph, and what tells citations and statutes.
STATUTE_REFERENCE = r"\b(IPC\s*\d+|BNS\s*\d+|CrPC\s*\d+|Section\s*\d+\s+of\s+[A-Za-z\s]+Act|Art(?:icle)?s?\.?\s*\d+(?:\(\d+\))?(?:\([a-z]\))?)\b"
SEPARATOR_RUN = r"[_=\-★☆♦—━]{4,}"
PARAGRAPH_MARKER = r"(?U)^(\(?\d+\)?\.|[a-zA-Z]\)|[A-Z][a-z]+:)"
CITATION = r"(?U)\bAIR\b|\bSCC\b|\bvs\.\b"
STATUTE_NAMED = r"(?iU)\bSection\s+\d+|\bArticle\s+\d+"
# Words that are no keywords.
STOPWORDS = """the a an is are was were be been being have has had do does did will would could should may might shall can
to of in for on with at by from as into through during before after above below between and but or not no nor so yet both
each all any few more most other some such than too very just also now then here there when where why how what which who
whom this that these those it its he she they them his her their our your about up out if because until while against""".split()


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether a lower-cased text contains one of the words, as plain parts of it."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def map_case_type(c: Column) -> Column:
    """civil, criminal, constitutional or other; civil words win over criminal ones. Null and empty are other."""
    t = F.lower(c)
    return F.when(contains_any(t, CIVIL_WORDS), "civil").when(F.contains(t, F.lit("criminal")), "criminal").when(F.contains(t, F.lit("constitution")), "constitutional").otherwise("other")


def normalize_case_type(c: Column) -> Column:
    """As map_case_type, by the words civil, criminal and constitution only."""
    t = F.lower(F.coalesce(c, F.lit("none")))
    return F.when(F.contains(t, F.lit("civil")), "civil").when(F.contains(t, F.lit("criminal")), "criminal").when(F.contains(t, F.lit("constitution")), "constitutional").otherwise("other")


def first_nonempty(*columns: Column) -> Column:
    """The first text that is neither null nor empty, stripped; '' if there is none."""
    return strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit("")))


def removal_ratio(raw: Column, clean: Column) -> Column:
    """1 - len(clean) / len(raw); null where raw is empty or null."""
    return F.lit(1.0) - F.length(clean).cast("double") / F.nullif(F.length(raw), F.lit(0))


def half_up(c: Column, digits: int) -> Column:
    """Rounded half up in doubles, the same on every engine."""
    k = F.lit(float(10**digits))
    return F.floor(c * k + 0.5) / k


def nfkc(c: Column) -> Column:
    """Compatibility composition. ASCII texts are left to the JVM; others go through an Arrow UDF."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    # a UDF runs for every row of a projection, so what is plain ASCII reaches it as null
    plain = c.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain, c).otherwise(compose(F.when(~plain, c)))


def html_to_text(c: Column) -> Column:
    """The text nodes of a page, each stripped, one a line; scripts, styles and comments are left out. Null stays null."""

    class Nodes(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            if tag in ("script", "style") and self.hidden:
                self.hidden -= 1

        def handle_data(self, data):
            if not self.hidden and data.strip():
                self.out.append(data.strip())

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            p = Nodes()
            p.feed(t)
            p.close()
            return "\n".join(p.out)

        return s.map(one)

    return text(c)


def strip_footers(c: Column) -> Column:
    for p in FOOTERS:
        c = F.regexp_replace(c, f"(?iUdm){p}", "")
    return c


def split_separators(c: Column) -> Column:
    """Runs of four or more rule characters become a line end."""
    return F.regexp_replace(c, SEPARATOR_RUN, "\n")


def collapse_space(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\n{4,}", "\n\n")
    return strip(F.regexp_replace(c, "[ \t]{2,}", " "))


def blank_bench_lines(c: Column) -> Column:
    """Lines that contain a bench word anywhere, even inside another word, are emptied."""
    return F.regexp_replace(c, f"(?iUdm)^.*({BENCH_WORDS}).*$", "")


def match_form(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def block_text(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "\n", " "), r"(?U)\s+", " "))


def paragraph_marker(c: Column) -> Column:
    """What a paragraph opens with: a number and a point, a letter and a bracket, or a word and a colon; else null."""
    return F.nullif(F.regexp_extract(c, PARAGRAPH_MARKER, 1), F.lit(""))


def reasoning_cue(c: Column) -> Column:
    return c.rlike("(?iU)^(" + "|".join(REASONING_OPENERS) + ")")


def has_citation(c: Column) -> Column:
    return c.rlike(CITATION)


def has_statute(c: Column) -> Column:
    return c.rlike(STATUTE_NAMED)


def statute_references(c: Column) -> Column:
    """The distinct references in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("(?iU)" + STATUTE_REFERENCE), F.lit(1))))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def keywords(c: Column) -> Column:
    """The distinct words of three or more ASCII letters or digits that are no stop words, sorted."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[a-zA-Z0-9]+\b"), F.lit(0))
    kept = F.filter(F.array_distinct(words), lambda w: F.length(w) > 2)
    return F.array_sort(F.array_except(kept, F.array(*[F.lit(w) for w in STOPWORDS])))


def head_tail(c: Column, head: int = 800, tail: int = 400) -> Column:
    """A long text's first and last characters around an ellipsis; a text of up to head + tail + 20 stays."""
    t = strip(c)
    return F.when(F.length(t) <= head + tail + 20, t).otherwise(F.concat(F.substring(t, 1, head), F.lit("\n…\n"), F.right(t, F.lit(tail))))


def json_part(c: Column) -> Column:
    """From the first opening to the last closing brace, else the whole text."""
    a, b = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when((a > 0) & F.contains(c, F.lit("}")), F.substring(c, a, F.greatest(b - a + 1, F.lit(0)))).otherwise(c)


def limit_words(c: Column, most: int = 2500) -> Column:
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("..."))).otherwise(c)


def clean_rewrite(answer: Column, question: Column) -> Column:
    """A rewritten question without quotation marks around it; the original where fewer than 10 characters are left."""
    t = F.regexp_replace(strip(answer), "^[\"']+|[\"']+$", "")
    return F.when(F.length(F.coalesce(t, F.lit(""))) < 10, question).otherwise(t)


# The sections of a judgment, in the order in which they are looked for.
SECTIONS = ["FACTS", "ISSUES", "ARGUMENTS", "REASONING", "JUDGMENT"]


def section_named(c: Column) -> Column:
    """The first of the sections that a model's answer names, else UNKNOWN."""
    u, out = F.upper(c), F
    for s in SECTIONS:
        out = out.when(F.contains(u, F.lit(s)), s)
    return out.otherwise("UNKNOWN")
