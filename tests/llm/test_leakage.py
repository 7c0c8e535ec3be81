import random
import re

import numpy as np

from lexweave.llm import leakage


def grams(t, n=5):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute(docs, items, share):
    return {(d, i) for d, t in docs for i, x in items if d is not None and grams(x) and len(grams(t) & grams(x)) >= share * len(grams(x)) - 1e-12}


def data(seed, letters):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    voc = [word() for _ in range(300)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randint(3, 60)))) for i in range(25)] + [(99, "short one"), (98, None)]
    docs = []
    for d in range(150):
        w = [rng.choice(voc) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            x = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(x) + 1)
            part = x[a : a + rng.randint(1, 40)]
            if rng.random() < 0.4 and part:
                part[rng.randrange(len(part))] = "edit"
            k = rng.randrange(len(w) + 1)
            w[k:k] = part
        docs.append((d, " ".join(w)))
    return docs + [(200, None), (201, ""), (None, docs[0][1]), (202, "one two")], items


def test_against_brute_force(spark):
    for seed, letters in ((1, "abcdefgh"), (2, "abकखगé"), (3, "ab")):
        docs, items = data(seed, letters)
        df = spark.createDataFrame(docs + docs[:20], "doc_id bigint, text string").repartition(3)
        it = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
        got = [(r["doc_id"], r["item_id"]) for r in leakage.leaked(df, "doc_id", "text", it, "item_id", "text").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items, 0.3)


def test_runs_shorter_than_a_qgram_count_before_an_edit():
    # 12 words, 8 runs, of which 3 are needed; 'no 1 2 a b' has 10 bytes, and other words follow it
    words = "witness statement said no 1 2 a b afterwards nothing further happened".split()
    item = (7, " ".join(words))
    ix = leakage.Index([item])
    assert ix.q == 16 and list(ix.need) == [3]
    docs = ["", "other words statement said no 1 2 a bc", " ".join(["zz", *words[1:8], "changed", "end"]), " ".join([*words[4:8], "x", *words[1:8]]), " ".join(words[2:8]), item[1]]
    t, i, held, matched, edits = ix.search(docs, leakage.WordHashes())
    kept = held >= ix.need[i]
    t, i, held = t[kept], i[kept], held[kept]
    want = {d: len(grams(x) & grams(item[1])) for d, x in enumerate(docs)}
    assert dict(zip(t.tolist(), held.tolist())) == {d: n for d, n in want.items() if n >= 3} and want[2] == 3 and (i == 0).all()


def test_parts_and_nothing(spark, monkeypatch):
    docs, items = data(5, "abcdefgh")
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(leakage, "PART", 7)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked(df, "doc_id", "text", it, "item_id", "text").collect()} == brute(docs, items, 0.3)
    monkeypatch.undo()
    assert leakage.leaked(df, "doc_id", "text", it.where("item_id < 0"), "item_id", "text").count() == 0
    assert leakage.leaked(df.where("doc_id < 0"), "doc_id", "text", it, "item_id", "text").count() == 0


def local(a, b):
    """Score of the best local alignment of two lists of words."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -leakage.EDIT_COST), row[j + 1] - leakage.EDIT_COST, new[j] - leakage.EDIT_COST))
        row = new
        best = max(best, *row)
    return best


def test_edited_passages_are_found_and_aligned():
    rng = random.Random(11)
    voc = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randint(40, 90)))) for i in range(30)]
    docs, planted = [], []
    for d in range(300):
        i, text = rng.choice(items)
        w = text.split()
        n = rng.randint(int(0.6 * len(w)), len(w))
        a = rng.randrange(len(w) - n + 1)
        part = []
        for k, x in enumerate(w[a : a + n]):
            kind = rng.choice("cai") if k % 10 == 9 else ""  # one word in ten changed, added or left out
            part += {"": [x], "c": ["edited"], "a": [x, "added"], "i": []}[kind]
        docs.append(" ".join([rng.choice(voc) for _ in range(rng.randint(0, 80))] + part + [rng.choice(voc) for _ in range(rng.randint(0, 80))]))
        planted.append((d, i))
    ix = leakage.Index(items)
    t, i, held, matched, edits = ix.search(docs, leakage.WordHashes())
    got = dict(zip(zip(t.tolist(), ix.ids[i].tolist()), zip(matched.tolist(), edits.tolist())))
    assert set(planted) <= set(got) and len(got) < len(planted) + 10
    # the band holds the best alignment of the passage
    texts = dict(items)
    for d, k in planted[:60]:
        m, e = got[d, k]
        assert m - leakage.EDIT_COST * e == local(texts[k].split(), docs[d].split())


def test_short_runs_at_the_ends_against_brute_force():
    rng = random.Random(4)
    long, short = ["witness", "statement", "recorded", "magistrate", "afterwards", "property"], ["a", "1", "of", "no", "x", "2"]
    words = lambda n: [rng.choice(long if rng.random() < 0.5 else short) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n)]
    items = [(i, " ".join([*(rng.choice(short) for _ in range(rng.randint(0, 7))), *words(rng.randint(8, 40)), *(rng.choice(short) for _ in range(rng.randint(0, 7)))])) for i in range(400)]
    docs = []
    for d in range(400):
        x = items[rng.randrange(400)][1].split()
        a = rng.randrange(len(x))
        docs.append((d, " ".join(words(rng.randint(0, 20)) + x[a : a + rng.randint(5, 20)] + words(rng.randint(0, 20)))))
    ix = leakage.Index(items)
    t, i, held, _, _ = ix.search([x for _, x in docs], leakage.WordHashes())
    kept = held >= ix.need[i]
    assert set(zip(t[kept].tolist(), ix.ids[i[kept]].tolist())) == brute(docs, items, 0.3)
    assert np.all(held[kept] <= np.array([len(o) for o in ix.own])[i[kept]])
