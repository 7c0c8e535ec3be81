import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import near_duplicates as nd
from lexweave.llm.components import connected_components


def brute(rows, n, t):
    sets = {}
    for i, text in rows:
        if i is not None and text is not None:
            w = re.findall(r"[^\W_]+", text.lower())
            s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if s:
                sets[i] = s
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def texts(seed, n_docs, vocabulary):
    rng = random.Random(seed)
    out = []
    for i in range(n_docs):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, max(1, len(w) // 6))):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            out.append(" ".join(w) or "x")
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))))
    return out


@pytest.mark.parametrize("n,t,words", [(3, 0.6, 400), (5, 0.8, 400), (2, 0.5, 12)])
def test_all_pairs_against_brute_force(spark, n, t, words):
    docs = texts(words + n, 120, [f"w{k}" for k in range(words)])
    rows = list(enumerate(docs)) + [(500, None), (None, "a b c d e f"), (501, ""), (502, "  "), (503, docs[0]), (504, docs[0].upper() + " !")]
    df = spark.createDataFrame(rows + rows[:30], "k bigint, t string").withColumn("id", F.lit("clash")).repartition(5)
    got = [tuple(r) for r in nd.NearDuplicates(df, "k", "t", n, t).all_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, n, t)


def test_salted_hot_ngrams_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 5)
    docs = texts(9, 80, [f"w{k}" for k in range(8)])
    df = spark.createDataFrame(list(enumerate(docs)), "k bigint, t string")
    assert {tuple(r) for r in nd.NearDuplicates(df, "k", "t", 2, 0.5).all_pairs().collect()} == brute(list(enumerate(docs)), 2, 0.5)


def test_counts_by_shuffle_lose_nothing(spark, monkeypatch):
    docs = texts(10, 90, [f"w{k}" for k in range(60)])
    df = spark.createDataFrame([*enumerate(docs), (200, docs[0]), (201, None), (202, "w1")], "k bigint, t string")
    want = brute([*enumerate(docs), (200, docs[0])], 3, 0.6)
    monkeypatch.setattr(nd, "TABLE_BITS", 0)
    assert {tuple(r) for r in nd.NearDuplicates(df, "k", "t", 3, 0.6).all_pairs().collect()} == want
    monkeypatch.setattr(nd, "HOT", 4)
    assert {tuple(r) for r in nd.NearDuplicates(df, "k", "t", 3, 0.6).all_pairs().collect()} == want
    assert nd.NearDuplicates(df.where("k < 0"), "k", "t").all_pairs().count() == 0


def test_an_ngram_of_very_many_texts_is_split(spark):
    # 80,000 texts share one n-gram that is outside of their prefixes for a partner, and two of them are near copies
    words = lambda k: " ".join(f"u{k}x{j}" for j in range(6))
    rows = [(k, f"a b c {words(k)}") for k in range(80_000)] + [(90_000, "a b c " + words(7) + " more"), (90_001, "a b c d")]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(8)
    assert [tuple(r) for r in nd.NearDuplicates(df, "k", "t", 3, 0.6).all_pairs().collect()] == [(7, 90_000)]
    counts = np.array([1, 100, 101, 65_535, 80_000, 10**7])
    assert np.all(np.diff(nd._scale(counts).astype(int)) > 0) and np.all(nd._unscale(nd._scale(counts)) >= counts * 0.99)


def shuffled(spark, f):
    """Bytes that a call writes for shuffles."""
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (lambda x: [x.apply(k) for k in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = stages()
    f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before)


def phrased(n_docs):
    rng = random.Random(3)
    phrases = [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(400)]
    rows = [(k, " ".join(rng.choice(phrases) for _ in range(20))) for k in range(n_docs)]
    return rows + [(n_docs + k, rows[k][1] + " and more") for k in range(5)]


def test_the_shuffle_is_of_slices_not_of_ngrams_or_pairs(spark, monkeypatch):
    monkeypatch.setattr(nd, "TABLE_BITS", 14)  # a corpus beyond the frequency table
    rows = phrased(1_200)
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(4)
    found: list[int] = []
    size = shuffled(spark, lambda: found.append(nd.NearDuplicates(df, "k", "t", 3, 0.6).all_pairs().count()))
    # an n-gram is two bytes of a slice (10.6 with all else that is shuffled); neither its row nor a row for each two texts that share it is shuffled
    ngrams = sum(len(t.split()) - 2 for _, t in rows)
    assert found == [5] and size < 20 * ngrams, size / ngrams


def test_pairs_of_all_size_classes(spark):
    # pairs across the classes' limits of 64 and 256 n-grams, and of few n-grams
    for t, n in ((0.6, 1), (0.6, 3), (0.2, 2)):
        rows = []
        for k, words in enumerate([1, 2, 3, 5, 50, 62, 64, 66, 100, 240, 254, 258, 300, 400, 900]):
            base = [f"u{k}x{j}" for j in range(words + n - 1)]
            cut = int(len(base) * (1 - t))
            rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[cut // 2 :])), (10 * k + 2, " ".join(base[cut:])), (10 * k + 3, " ".join([*base, *(f"v{k}x{j}" for j in range(cut))])), (10 * k + 4, " ".join(base[: 1 + len(base) // 4]))]
        df = spark.createDataFrame(rows, "k bigint, t string").repartition(3)
        assert {tuple(r) for r in nd.NearDuplicates(df, "k", "t", n, t).all_pairs().collect()} == brute(rows, n, t), (t, n)


def test_groups(spark):
    base = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, base), (2, base), (3, base + " u"), (4, "other words that nothing else has at all here"), (5, None)]
    g = {r["id"]: (r["group"], r["links"]) for r in nd.NearDuplicates(spark.createDataFrame(rows, "k bigint, t string"), "k", "t", 5, 0.8).groups().collect()}
    assert g == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0)}


def test_empty_table(spark):
    d = nd.NearDuplicates(spark.createDataFrame([], "k bigint, t string"), "k", "t")
    assert d.all_pairs().count() == 0 and d.groups().count() == 0


def test_components(spark):
    e = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 103: 100}
