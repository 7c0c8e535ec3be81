"""Cleaning of whole texts: repeated lines, where the body starts, what stands before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import blank_bench_lines, strip

# Patterns of lines that open the body, hint at it, or name who appeared.
STRONG_STARTS = [
    r"^\s*j\s*u\s*d\s*g\s*m\s*e\s*n\s*t\s*$", r"^\s*o\s*r\s*d\s*e\s*r\s*$", r"^oral\s+(judgment|order)",
    r"the\s+judgment\s+of\s+the\s+court\s+was\s+delivered\s+by", r"^reasons\s+for\s+(order|judgment)",
]
WEAK_STARTS = [
    r"\b(held|we\s+hold|in\s+our\s+view|opinion|considered|ratio)\b", r"(section|article|rule|order|clause)\s+\d+",
    r"\(\d{4}\)\s*\d+\s*(scc|air|pat|blr|jl|crilj|compcas|taxman|itr)", r"(writ|petition|appeal|revision|application).*?(is|stands|hereby)",
]
APPEARANCE = ["appearance", "advocat", "counsel", r"for the.*(petitioner|respondent)", "paag", "aag"]
RULES = r"^(={3,}|-{3,}|_{3,})$"


def full_lines(text: Column) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))


def drop_repeated_lines(df: DataFrame, keys: list[str], text: str, most: int = 5, least_chars: int = 30) -> DataFrame:
    """keys, text without any copy of a long line that stands more than `most` times in its text.

    Counted within the row: lines are sorted once, no text is shuffled. Null stays null.
    """
    # each step is a column of its own: a lambda would work it out anew for every line
    d = df.select(*keys, text, F.split(text, "\n").alias("__lines"))
    d = d.withColumn("__long", F.array_sort(F.filter("__lines", lambda x: F.length(x) >= least_chars)))
    d = d.withColumn("__ahead", F.slice("__long", F.lit(most + 1), F.greatest(F.size("__long"), F.lit(1))))
    # a line that equals the one `most` places on stands more than `most` times
    same = F.zip_with(F.slice("__long", F.lit(1), F.greatest(F.size("__ahead"), F.lit(0))), F.col("__ahead"), lambda x, y: F.when((x == y) & (F.length(strip(x)) >= least_chars), x))
    d = d.withColumn("__often", F.array_distinct(F.array_compact(same)))
    kept = F.array_join(F.filter("__lines", lambda x: ~F.array_contains(F.col("__often"), x)), "\n")
    return d.select(*keys, F.when(F.size("__often") > 0, kept).otherwise(F.col(text)).alias(text))



def body_starts(df: DataFrame, keys: list[str], lines: str) -> DataFrame:
    """keys, lines, start: the index (from 0) of the line where the body starts; the number of lines if none is found.

    A fold over the lines in order. Its state is whether someone's appearance was seen, the
    last such line, and the first start found: a strong marker two lines on, a weak hint
    three lines on if it is more than four lines behind the last appearance, or the line after a rule.
    """
    x = "(?iU)"
    seen = lambda v: v.rlike(x + "(" + "|".join(APPEARANCE) + ")")
    strong = lambda v: strip(v).rlike(x + "(" + "|".join(f"({p})" for p in STRONG_STARTS) + ")")
    weak = lambda v: v.rlike(x + "(" + "|".join(f"({p})" for p in WEAK_STARTS) + ")")
    facts = F.transform(F.col(lines), lambda v, i: F.struct(i.alias("i"), seen(v).alias("seen"), strong(v).alias("strong"), weak(v).alias("weak"), strip(v).rlike(RULES).alias("rule")))
    zero = F.struct(F.lit(False).alias("on"), F.lit(0).alias("last"), F.lit(None).cast("int").alias("start"))

    def step(s, v):
        on, last = s["on"] | v["seen"], F.when(v["seen"], v["i"]).otherwise(s["last"])
        found = F.when(v["strong"], F.greatest(v["i"] - 2, F.lit(0))).when(on & (v["i"] > last + 4) & v["weak"], F.greatest(v["i"] - 3, F.lit(0))).when(on & v["rule"], v["i"] + 1)
        done = s["start"].isNotNull()
        return F.struct(F.when(done, s["on"]).otherwise(on).alias("on"), F.when(done, s["last"]).otherwise(last).alias("last"), F.coalesce(s["start"], found).alias("start"))

    n = F.size(lines)
    end = F.aggregate(facts, zero, step)
    last = F.col("__end.last")
    late = F.when((last > 4) & (last < n - 6), F.least(last + 6, n - 1))
    return df.select(*keys, lines, end.alias("__end")).select(*keys, lines, F.coalesce(F.col("__end.start"), late, n).alias("start"))



def strip_preamble(df: DataFrame, keys: list[str], text: str, skip: int = 20) -> DataFrame:
    """keys, text from where the body starts, lines of the bench emptied; where no start is found, or it lies
    within the last three lines, the first `skip` lines are left out. A null text gives null, a blank one ''."""
    b = body_starts(df.withColumn("__lines", full_lines(F.col(text))), keys, "__lines")
    n = F.size("__lines")
    start = F.when(F.col("start") >= n - 3, F.least(F.lit(skip), n)).otherwise(F.col("start"))
    rest = F.slice("__lines", start + 1, F.greatest(n, F.lit(1)))
    return b.select(*keys, strip(blank_bench_lines(F.array_join(rest, "\n"))).alias(text))
