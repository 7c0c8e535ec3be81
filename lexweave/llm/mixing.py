"""Problem 7: sources combined to target weights.

Every leaf of a tree domain / language / source has a share of the total and can give its
tokens at most `max_repeats` times. From the root down, a node's budget goes to its children
by weight; what a child cannot give goes to its siblings, and only what they all cannot give
goes up. A leaf fills its budget with whole epochs and a token-prefix of a seeded order.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import durable

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 4096
#: Leaves of the tree; it is worked out on the driver.
MOST_LEAVES = 100_000


def token_counter(spark, path: str = TOKENIZER, pattern: str = PATTERN):
    """A pandas UDF: the number of tokens of a text by the vocabulary in `path`; 0 for null.

    Between two words a single blank always begins a token, so the words' counts, remembered
    by each task, add up to the text's.
    """
    ranks = spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))})

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[str, int] = {}
        cut = re.compile(r"(?<=\S) (?=\S)")

        def one(text):
            if not text:
                return 0
            parts = text.split(" ")
            if "" in parts or any(p[0].isspace() or p[-1].isspace() for p in parts):
                parts = cut.split(text)
            n = 0
            for k, p in enumerate(parts):
                if k:
                    p = " " + p
                c = known.get(p)
                if c is None:
                    if len(known) > 500_000:
                        known.clear()
                    c = len(enc.encode_ordinary(p))
                    if len(p) < 64:
                        known[p] = c
                n += c
            return n

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "bigint")


def source_name(c):
    """Sources are compared in lower case, trimmed, with underscores for dashes and blanks."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def share_out(budget: float, children: list[tuple[str, float, float]]) -> dict[str, float]:
    """The budget dealt to (name, weight, capacity) by weight; what one cannot hold goes to the others that can.

    Weights that are all zero count as equal. More than all can hold is left.
    """
    got = {n: 0.0 for n, _, _ in children}
    open_ = [(n, w, c) for n, w, c in children if c > 0 and w > 0]
    left = min(budget, sum(c for _, _, c in open_))
    while open_ and left > 1e-9:
        total = sum(w for _, w, _ in open_)
        full = [(n, w, c) for n, w, c in open_ if c - got[n] <= left * w / total + 1e-9]
        if not full:
            for n, w, _ in open_:
                got[n] += left * w / total
            break
        give = 0.0
        for n, _, c in full:
            give += c - got[n]
            got[n] = c
        left -= give
        names = {n for n, _, _ in full}
        open_ = [x for x in open_ if x[0] not in names]
    return got


def plan_budgets(leaves: list[dict], total: float) -> dict[tuple, float]:
    """leaves: path (tuple), weight, capacity. The leaves' budgets, shortages going to siblings before ancestors."""
    out: dict[tuple, float] = {}

    def down(prefix: tuple, below: list[dict], budget: float):
        if len(below) == 1 and below[0]["path"] == prefix:
            out[prefix] = min(budget, below[0]["capacity"])
            return
        children: dict[tuple, list[dict]] = {}
        for leaf in below:
            children.setdefault(leaf["path"][: len(prefix) + 1], []).append(leaf)
        dealt = share_out(budget, [(p, sum(x["weight"] for x in c), sum(x["capacity"] for x in c if x["weight"] > 0)) for p, c in sorted(children.items())])
        for p, c in children.items():
            down(p, c, dealt[p])

    down((), leaves, total)
    return out


class Mixture:
    """`chosen` (doc_id, source, n_tokens, uses) and `shares` per source of the targets.

    shares tells in `shortfall` why a source has less than its target: no_documents, repeats_used_up
    (every document is used as often as allowed), or null where it has not, but for the size of a document.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER, domains: dict | None = None):
        """docs: doc_id, text, lang, source; targets: source, target_weight, max_repeats.

        total is the size in tokens, by default what the listed sources hold once. Documents
        of unlisted or null sources, with null ids or without a token are not used; an id
        given twice counts once. domains names the domain of a source (by default each is its own).
        A null language is one of its own. A source without documents gets 0 and its
        weight goes to its siblings. Null weights count as 0, null repeats as 1.
        """
        spark = docs.sparkSession
        domains = domains or {}
        count = token_counter(spark, tokenizer)
        wanted = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("m"))
        wanted = wanted.where("source is not null").groupBy("source").agg(F.sum("w").alias("w"), F.max("m").alias("m"))
        rows = wanted.limit(MOST_LEAVES + 1).collect()
        if len(rows) > MOST_LEAVES:
            raise ValueError("more sources than the tree may have leaves")
        weight = {r["source"]: (r["w"], max(0, r["m"])) for r in rows}
        listed = F.create_map(*[F.lit(x) for s in sorted(weight) for x in (s, True)]) if weight else None
        base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"), count(F.col("text")).alias("n_tokens"))
        base = base.where(F.col("doc_id").isNotNull() & (F.try_element_at(listed, F.col("source")).isNotNull() if listed is not None else F.lit(False))).where("n_tokens > 0")
        self.tokens = durable(base.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "n_tokens")).alias("x")).select("doc_id", "x.*"))
        held = self.tokens.groupBy("source", "lang").agg(F.sum("n_tokens").alias("have")).limit(MOST_LEAVES + 1).collect()
        if len(held) > MOST_LEAVES:
            raise ValueError("more leaves than the tree may have")
        per_source: dict[str, int] = {}
        for r in held:
            per_source[r["source"]] = per_source.get(r["source"], 0) + r["have"]
        leaves = [
            {"path": (domains.get(r["source"], r["source"]), r["lang"], r["source"]), "weight": weight[r["source"]][0] * r["have"] / per_source[r["source"]], "capacity": r["have"] * weight[r["source"]][1], "have": r["have"]}
            for r in held
        ]
        # a source without documents keeps its place in the tree, with nothing to give
        leaves += [{"path": (domains.get(s, s), "und", s), "weight": w, "capacity": 0, "have": 0} for s, (w, _) in weight.items() if s not in per_source]
        self.total = sum(per_source.values()) if total is None else total
        budget = plan_budgets(leaves, self.total)
        self.plan = [(x["path"][2], x["path"][1], x["have"], int(budget[x["path"]]), int(budget[x["path"]] // x["have"]) if x["have"] else 0) for x in leaves]
        plan = spark.createDataFrame(self.plan or [], "source string, lang string, have bigint, budget bigint, epochs bigint").withColumn("rest", F.col("budget") - F.col("have") * F.col("epochs"))
        plan = F.broadcast(plan)  # at most MOST_LEAVES rows
        order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
        d = self.tokens.join(plan, ["source", "lang"]).withColumn("order", order).withColumn("bucket", F.shiftrightunsigned(F.col("order"), 64 - 12).cast("int"))
        # each leaf's sums by bucket give where its budget ends; only that bucket is put in order
        sums = d.groupBy("source", "lang", "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source", "lang").orderBy("bucket"))).withColumn("before", F.col("upto") - F.col("n"))
        edge = upto.where("upto > rest and before <= rest").groupBy("source", "lang").agg(F.min(F.struct("bucket", "before")).alias("e")).select("source", "lang", "e.*").toDF("source", "lang", "edge", "before")
        d = d.join(F.broadcast(edge), ["source", "lang"], "left")  # at most a row per leaf
        sure = d.where("edge is null or bucket <> edge").withColumn("more", (F.col("edge").isNull() & (F.col("rest") > 0) | (F.col("bucket") < F.col("edge"))).cast("int"))
        w = Window.partitionBy("source", "lang").orderBy("order", "doc_id")
        at_edge = d.where("bucket = edge").withColumn("more", (F.col("before") + F.sum("n_tokens").over(w) <= F.col("rest")).cast("int"))
        cols = ["doc_id", "source", "lang", "n_tokens", (F.col("epochs") + F.col("more")).cast("int").alias("uses")]
        self.chosen = sure.select(*cols).union(at_edge.select(*cols)).where("uses > 0")
        budgets: dict[str, float] = {}
        for x in leaves:
            budgets[x["path"][2]] = budgets.get(x["path"][2], 0.0) + budget[x["path"]]
        weights = sum(w for w, _ in weight.values()) or 1.0
        why = []
        for s, (w, m) in weight.items():
            missing = budgets.get(s, 0.0) < w / weights * self.total - 1
            why.append((s, None if not missing else "no_documents" if not per_source.get(s) else "repeats_used_up" if budgets[s] >= per_source[s] * m - 1 else None))
        why = F.broadcast(spark.createDataFrame(why or [], "source string, shortfall string"))  # at most MOST_LEAVES rows
        got = self.chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
        all_ = self.chosen.agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("whole"))
        self.shares = (
            wanted.join(got, "source", "left")
            .join(why, "source", "left")
            .crossJoin(F.broadcast(all_))  # one row
            .select("source", F.col("w").alias("target_weight"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"), "shortfall")
        )
