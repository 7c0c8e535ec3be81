import pytest

from lexweave.llm.canonical import ALIASES, Vocabulary, allowed, edits, map_mentions, section_number

ENTRIES = [
    (1, "IPC", "IPC_302", "Forging of census sheets at night"),
    (2, "ipc ", " 92 ", "Delay of dock permits by a trustee"),
    (3, "IPC", "92A", None),
    (4, "BNS", "BNS 302", "Sale of ferry tickets on a highway"),
    (5, "CONSTITUTION", "Article_14", "Neglect of public wells at night"),
    (6, "IPC", "302", "Forging of census sheets at night"),
    (7, "CRPC", "5", "Delay of dock permits by a trustee"),
    (8, None, None, None),
    (9, "IPC", "77", "Sale of court registers at night"),
]


CASES = [
    ("IPC 302", 1), ("Section 302 of the Indian Penal Code", 1), ("Setion 3O2, I.P.C.;", 1), ("302 B N S", 4), ("u/s 92-a Ind. Penal Code", 3), ("§ 92(2)(a) IPC", 2),
    ("S. 92, Explanation Penal Code", 2), ("IPC ९२A", 3), ("Art.14", 5), ("A. 14, Const.", 5), ("article  14A", -1), ("IPC 303", -1), ("Sec 302 of Quarry Dues Act", -1),
    ("FORGING OF CENSUS SHEETS AT NIGHT", 1), ("census sheets at nihgt, forgng (IPC)", 1), ("Forging of census sheets at night, BNS", -1), ("Sale of census sheets at night", -1),
    ("Delay - dock permits by a truste (CrPC)", 7), ("Delay of dock permits by a trustee", 2), ("302", -1), ("ibid", -1), ("??", -1), ("  ", None), ("", None), (None, None), ("CrPC S", 7), ("sale court registrs at night", 9),
    ]


def mapped(spark, entries, values, **more):
    canon = spark.createDataFrame(entries, "statute_id bigint, law string, section string, title string")
    df = spark.createDataFrame([(1, list(values))], "k int, m array<string>")
    return {r["mention"]: r["entry_id"] for r in map_mentions(df, ["k"], "m", canon, **more).collect()}


def test_matcher(spark):
    assert mapped(spark, ENTRIES, [v for v, _ in CASES]) == {v: w for v, w in CASES if w is not None}


def test_numbers_and_edits():
    assert section_number("1 66") == "166" and section_number("IS9") == "159" and section_number("SO6E") == "506E" and section_number("9l") == "91" and section_number("abc") is None
    assert edits("garin", "grain", 2) == 1 and edits("abc", "xyz", 2) == 3 and edits("", "ab", 2) == 2


def test_map_mentions(spark):
    canon = spark.createDataFrame(ENTRIES, "statute_id bigint, law string, section string, title string")
    rows = [(1, 1, ["IPC 302", None, " ", "nothing"]), (1, 1, ["IPC 302", None, " ", "nothing"]), (1, 2, None), (1, 3, [])]
    df = spark.createDataFrame(rows, "pdf_id bigint, chunk_id int, m array<string>")
    got = sorted(tuple(r) for r in map_mentions(df, ["pdf_id", "chunk_id"], "m", canon).collect())
    assert got == [(1, 1, 1, "IPC 302", 1), (1, 1, 4, "nothing", -1)]
    assert map_mentions(df, ["pdf_id", "chunk_id"], "m", canon.where("statute_id > 99")).where("entry_id <> -1").count() == 0


def test_lists_in_parts_agree(spark, monkeypatch):
    from lexweave.llm import canonical

    canon = spark.createDataFrame(ENTRIES, "statute_id bigint, law string, section string, title string")
    df = spark.createDataFrame([(1, ["IPC 302", "Art. 14", "302 BNS", "IPC 5"])], "k int, m array<string>")
    whole = sorted(map(tuple, map_mentions(df, ["k"], "m", canon).collect()))
    monkeypatch.setattr(canonical, "PART", 3)
    assert sorted(map(tuple, map_mentions(df, ["k"], "m", canon).collect())) == whole


def test_the_size_of_parts_changes_no_answer(spark, monkeypatch):
    from lexweave.llm import canonical

    # the nearer title has the larger id; one value names two titles; a word of one title is near to another's
    entries = [
        (1, "IPC", "1", "Cheating by false promise"), (2, "IPC", "2", "Cheating by false premises"), (3, "IPC", "3", "Transfer of wells"), (4, "IPC", "4", "Transport of wells"),
        (5, "IPC", "5", "Theft of seed"), (6, "BNS", "5", "Theft of seed"), *ENTRIES[1:5],
    ]
    entries = [(i, *e[1:]) for i, e in enumerate(entries, 1)]
    values = ["Cheating by false premise", "Cheating by false promises", "Transfer of wells and Theft of seed", "Transfr of wells", "Transports of wells", "Theft of seed", "seed theft, BNS", "IPC 5", *[v for v, w in CASES if w is not None]]
    whole = mapped(spark, entries, values)
    assert (whole["Cheating by false premise"], whole["Transfer of wells and Theft of seed"], whole["Theft of seed"], whole["seed theft, BNS"]) == (2, -1, 5, 6)
    for size in (1, 3):
        monkeypatch.setattr(canonical, "PART", size)
        monkeypatch.setattr(canonical, "BROADCAST_VALUES", 2)
        assert mapped(spark, entries, values) == whole


def test_longer_titles_may_differ_in_a_word(spark):
    entries = [(1, "IPC", "1", "Removal of survey pegs from river banks after lawful notice"), (2, "X", "2", None)]
    values = ["removal survey pegs river banks lawful notice after removal", "Removal pegs river banks lawful notice survey lawful", "survey pegs river banks", "X 2"]
    assert mapped(spark, entries, values) == {values[0]: 1, values[1]: 1, values[2]: -1, "X 2": 2}
    assert mapped(spark, entries, [values[2]], similarity=0.5) == {values[2]: 1}
    assert mapped(spark, entries, ["Trade Act 7"], aliases={"X": ["trade act"]}) == {"Trade Act 7": -1} and "IPC" in ALIASES


def test_nearest_of_many_words():
    import random

    rng = random.Random(3)
    words = {"".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 9))) for _ in range(400)}
    v = Vocabulary(words)
    for _ in range(200):
        t = "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 9)))
        fits = lambda w: edits(t, w, 3) <= allowed(w) and abs(len(t) - len(w)) <= min(allowed(w), allowed(t + "??"))
        want = (0, t) if t in words else min(((edits(t, w, 3), w) for w in words if fits(w)), default=None)
        assert v.nearest(t) == want
