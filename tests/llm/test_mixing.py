import os
import random

import pytest
from pyspark.sql import functions as F

from lexweave.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer here")


def test_share_out_and_tree():
    assert mixing.share_out(100, [("a", 1, 10), ("b", 1, 500), ("c", 2, 500)]) == pytest.approx({"a": 10, "b": 30, "c": 60})
    assert mixing.share_out(100, [("a", 1, 10), ("b", 0, 500)]) == {"a": 10, "b": 0.0} and mixing.share_out(5, []) == {}
    leaves = [{"path": ("d", "x"), "weight": 0.25, "capacity": 5}, {"path": ("d", "y"), "weight": 0.25, "capacity": 100}, {"path": ("e", "z"), "weight": 0.5, "capacity": 100}]
    # what x lacks goes to its sibling y before z
    assert mixing.plan_budgets(leaves, 100) == pytest.approx({("d", "x"): 5, ("d", "y"): 45, ("e", "z"): 50})


def test_counts_equal_the_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c  d\n\t.,'s 12क é") for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["", " ", "a  b", " a b "]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "k int, t string").select("k", mixing.token_counter(spark)(F.col("t")).alias("n"))
    got = dict(map(tuple, df.collect()))
    assert got == {**{k: len(enc.encode_ordinary(t)) for k, t in enumerate(texts)}, -1: 0}


def test_mixture(spark):
    docs = [(i, "word " * (1 + i % 7), "en" if i % 3 else None, ["big", "Big ", "small", None, "other"][i % 5]) for i in range(400)] + [(None, "x", "en", "big"), (900, None, "en", "big"), (901, "", "en", "big")]
    df = spark.createDataFrame(docs + docs[:9], "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3)], "source string, target_weight double, max_repeats int")
    m = mixing.Mixture(df, targets, total=600)
    rows = m.chosen.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} <= {"big", "small"}
    assert all(1 <= r["uses"] <= (2 if r["source"] == "small" else 1) for r in rows)
    shares = {r["source"]: r["share"] for r in m.shares.collect()}
    why = {r["source"]: r["shortfall"] for r in m.shares.collect()}
    more = {r["source"]: r["shortfall"] for r in mixing.Mixture(df, targets, total=6000).shares.collect()}
    assert why["absent"] == "no_documents" and why["small"] is None and more["small"] == "repeats_used_up"
    assert shares["absent"] == 0 and sum(shares.values()) == pytest.approx(1)
    used = sum(r["uses"] * r["n_tokens"] for r in rows)
    budget = sum(b for _, _, _, b, _ in m.plan)
    assert budget - 8 * len(m.plan) <= used <= budget
    assert sorted(map(tuple, mixing.Mixture(df.repartition(7), targets, total=600).chosen.collect())) == sorted(map(tuple, rows))
    assert mixing.Mixture(df.where("doc_id < 0"), targets).chosen.count() == 0
