from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import pieces


def starts(t):
    return [t[a : a + 6] for a in pieces.sentence_starts(t)]


def test_sentences():
    t = '23. The sum of Rs. 4,034 was paid to Dr. A. B. Smith on 1.2.2003. "No map." That is so. (It was seen at p. 5 of the record.) In X v. Y, AIR 1990 SC 5 we held. Why? 47 persons, i.e. the clerk, came.\n(a) One; two.\n\nORDER'
    assert starts(t) == ["23. Th", '"No ma', "That i", "(It wa", "In X v", "Why? 4", "47 per", "(a) On", "ORDER"]
    assert pieces.sentence_starts("") == [] and pieces.sentence_starts("  xy. Zed") == [0, 6] and starts("in 1994. then more") == ["in 199", "then m"]
    assert starts("It went to I. E. Smith. He and I. The end.") == ["It wen", "He and", "The en"]


words = st.text(alphabet="ab. \n;", max_size=4000)


@settings(max_examples=300, deadline=None)
@given(words, st.integers(20, 300), st.integers(0, 19))
def test_pieces_cover_the_text(t, limit, overlap):
    p = pieces.split_item(t, limit, overlap)
    assert p[0][0] == 0 and all(b - a <= limit for a, b, _ in p)
    covered = set()
    for a, b, _ in p:
        covered |= set(range(a, b))
    assert all(t[i].isspace() for i in range(len(t)) if i not in covered)
    for (a, b, _), (c, d, r) in zip(p, p[1:]):
        assert a < c and b < d and r == max(0, b - c) and r <= overlap + 1


def test_pieces_of_one_word_and_of_sentences():
    assert pieces.split_item("x" * 50, 20, 5)[0] == (0, 20, 0) or len(pieces.split_item("x" * 50, 20, 5)) >= 3
    t = " ".join(f"Sentence number {k} ends here." for k in range(100))
    for a, b, _ in pieces.split_item(t):
        assert t[a:b].startswith("Sentence") and t[a:b].endswith("here.")


def test_sections_and_lines_that_fit_are_kept_whole():
    s = lambda name, n: " ".join(f"{name} number {k} ends here." for k in range(n))
    for gap in ("\n\n", "\n"):
        parts = [s("Alpha", 40), s("Beta", 30), s("Gamma", 45), s("Delta", 5), s("Omega", 150), s("Last", 44)]
        t = gap.join(parts)
        p = pieces.split_item(t)
        for x in parts:
            if len(x) <= pieces.LIMIT - pieces.OVERLAP:
                assert any(x in t[a:b] for a, b, _ in p)
        assert all(b - a <= pieces.LIMIT for a, b, _ in p)
    # a section's end is preferred to a later line's, and that to a later sentence's
    t = s("Alpha", 30) + "\n\n" + s("Beta", 5) + "\n" + s("Gamma", 60)
    assert t[: pieces.split_item(t)[0][1]] == s("Alpha", 30)
    assert [t[a : a + 5] for a, v in pieces.boundaries(t) if v == pieces.SECTION] == ["Alpha", "Beta "]
    assert [a for a, _ in pieces.split_units(pieces.boundaries(t), t, 0, pieces.SENTENCE)] == pieces.sentence_starts(t)


def test_rows(spark):
    long = "One is here. " * 200
    rows = [(1, 1, long, "a"), (1, 1, long, "b"), (1, 2, "short", "a"), (1, 3, None, "a"), (1, 4, "", "a")]
    df = spark.createDataFrame(rows, "case_id bigint, para_id bigint, text string, sent_start string")
    got = [tuple(r) for r in pieces.long_sentences(df, ["case_id", "para_id"], "text").collect()]
    assert len(got) == len(set(got)) == 200 and (1, 1, 0) in got
    assert pieces.split_long(df.where("para_id > 1"), ["case_id", "para_id"], "text").count() == 0
    assert {r["piece_no"] for r in pieces.split_long(df, ["case_id", "para_id"], "text").collect()} == {1, 2}
    checks = pieces.piece_checks(pieces.split_long(df, ["case_id", "para_id"], "text"), df, ["case_id", "para_id"], "text").collect()
    assert [tuple(r) for r in checks] == [(1, 1, True, True, True, True)]


def test_a_section_that_ends_at_1009_and_long_words():
    s = lambda name, n: " ".join(f"{name} number {k:02d} ends here." for k in range(n))
    a = s("Alpha", 37)
    a += " " + "x" * (1009 - len(a) - 2) + "."
    t = a + "\n\n" + s("Beta", 55)
    assert len(a) == 1009 and pieces.split_item(t)[0] == (0, 1009, 0)
    # a word of any length is judged as a whole: here it ends in an abbreviation's letters
    assert pieces.sentence_starts("Section " + "q" * 400 + "no. The end.") == [0, 8 + 400 + 4]


def test_white_space_before_a_long_word():
    for t in (" " + ";" * 20, " " * 30 + ";" * 25, "a" + " " * 45 + "b" * 30, "\t" * 50):
        for overlap in (0, 5, 19):
            p = pieces.split_item(t, 20, overlap)
            assert p[0][0] == 0 and all(b - a <= 20 for a, b, _ in p)
            covered = {i for a, b, _ in p for i in range(a, b)}
            assert all(t[i].isspace() for i in range(len(t)) if i not in covered)
