import random
import textwrap

from lexweave.llm import scans

BODY = "The appellant worked at the orchard and drew wages until the election was held near the river."


def pages():
    out = []
    for pdf in range(1, 9):
        for page in range(1, 6):
            lines = [f"W.P. No. {pdf} of 2002", ""] + [f"{BODY[k:]} {BODY[:k]}".strip() for k in (0, 4, 14, 21, 28, 32, 44)] + [f"Page {page} of 5"]
            lines[4] = "which the owner of the orchard had bought for the elec-"
            lines[5] = "tion and the self-"
            lines[6] = "serving word of the appellant, who read the wri¬"
            lines[7] = "ting with care before the election."
            out.append((pdf, page, "\n".join(lines)))
    return out


def test_defects_by_line(spark):
    rows = pages()
    text = rows[3][2].split("\n")
    text[2] = text[2].replace("appellant", "appe1lant").replace("river", "rivcr")
    rows[3] = (rows[3][0], rows[3][1], "\n".join(text))
    extra = [(1, 99, ""), (1, 98, None), (None, 1, "x"), (2, None, "x"), (50, 1, "self-serving self-serving word")]
    df = spark.createDataFrame(rows + rows[:3] + extra, "pdf_id bigint, page_number int, text string")
    got = [tuple(r) for r in scans.Scans(df).found().collect()]
    assert len(got) == len(set(got))
    assert {r for r in got if r[3] == "furniture" and r[0] < 50} == {(p, n, k, "furniture") for p in range(1, 9) for n in range(1, 6) for k in (1, 10)}
    assert {r for r in got if r[3] == "broken_word"} == {(p, n, k, "broken_word") for p in range(1, 9) for n in range(1, 6) for k in (5, 7)}
    assert {r for r in got if r[3] == "misread"} == {(rows[3][0], rows[3][1], 3, "misread")}
    paras = scans.Scans(df).paragraphs().collect()
    whole = " ".join(r["text"] for r in paras)
    assert "election and the self-serving word" in whole and "writing with care" in whole and "Page 1" not in whole and "W.P." not in whole


def test_no_pages(spark):
    df = spark.createDataFrame([], "pdf_id bigint, page_number int, text string")
    s = scans.Scans(df)
    assert s.found().count() == 0 and s.paragraphs().count() == 0


def test_words():
    assert scans.noisy("appea1") and scans.noisy("ord!nary") and scans.noisy("On(e") and not scans.noisy("B46") and not scans.noisy("appeal")
    assert not scans.is_word("P-59") and not scans.is_word("26E") and not scans.is_word("R/4") and scans.is_word("counter-affidavit")
    assert "framed" in dict(scans.variants("frarned")) and "weight" in dict(scans.variants("weigbt")) and "initial" in dict(scans.variants("in1tia1"))


NOUNS = "orchard election river licence tenancy boundary deed survey mortgage partition auction ledger bridge canal permit tender pension harvest workman landlord appellant respondent magistrate".split()
VERBS = "denied admitted examined produced recorded withheld returned mortgaged surrendered photographed".split()
NAMES = "Halrepur Dromakan Velchivit Lumdral Oskwadi Tanchiner Kesnemek Zalrepalli".split()


def scanned(seed, pdfs=30):
    """Paragraphs, and pages made of them: wrapped lines, divided words, headers and page numbers; paragraphs run on over pages, also at names and numbers."""
    rng = random.Random(seed)
    sentence = lambda: f"{rng.choice(['The', 'Hence the', 'Besides, the', 'Dr. ' + rng.choice(NAMES) + ' said that the'])} {rng.choice(NOUNS)} of {rng.choice(NAMES)} was {rng.choice(VERBS)} by the {rng.choice(NOUNS)} on {rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1980, 2015)} and {rng.choice(VERBS)} before the {rng.choice(NOUNS)} near {rng.choice(NAMES)}."
    paras, pages = {}, []
    for pdf in range(pdfs):
        own = [(f"{k + 1}. " if rng.random() < 0.5 else "") + " ".join(sentence() for _ in range(rng.randint(1, 6))) for k in range(rng.randint(8, 16))]
        paras[pdf] = own
        lines = []
        for k, p in enumerate(own):
            wrapped = textwrap.wrap(p, rng.choice([56, 60]), break_on_hyphens=False)
            for j in range(len(wrapped) - 1):
                head = wrapped[j + 1].split(" ", 1)
                if rng.random() < 0.15 and head[0].isalpha() and head[0].islower() and len(head[0]) > 6:
                    wrapped[j] += f" {head[0][:4]}-"
                    wrapped[j + 1] = head[0][4:] + (" " + head[1] if len(head) > 1 else "")
            lines += (["\n"] if k else []) + wrapped
        n = 1
        while lines:
            body, lines = lines[:24], lines[24:]
            while lines and lines[0] == "\n":
                lines.pop(0)
            text = [f"High Court at Undgarh - C.S. {pdf} of 2015", ""] + ["" if x == "\n" else x for x in body] + [f"Page {n}"]
            pages.append((pdf, n, "\n".join(text)))
            n += 1
    return paras, pages


def test_paragraphs_of_held_out_pages(spark):
    paras, pages = scanned(7)
    rng = random.Random(1)
    bad = {"orchard": "orcbard", "magistrate": "magi5trate", "respondent": "resporident"}
    wrong = 0
    for k, (pdf, n, text) in enumerate(pages):
        for word, misread in bad.items():
            if rng.random() < 0.05 and f" {word} " in text:
                text, wrong = text.replace(f" {word} ", f" {misread} ", 1), wrong + 1
        pages[k] = (pdf, n, text)
    df = spark.createDataFrame(pages, "pdf_id bigint, page_number int, text string").repartition(5)
    got = {(r["pdf_id"], r["text"]) for r in scans.Scans(df).paragraphs().collect()}
    want = {(pdf, p) for pdf, own in paras.items() for p in own}
    assert wrong > 5 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_pages_that_go_on_with_a_name_or_a_number():
    lines = [(x, [scans.BREAK if not y else scans.BODY for y in x]) for _, _, t in scanned(3, 10)[1] for x in [t.split("\n")[2:-1]]]
    m = scans.BreakModel(lines)
    shape = scans.shape_of
    before = shape("and the ledger was examined before the river near", 52)
    assert not m.begins(before, shape("Oskwadi. The canal of Lumdral was admitted by the", 52)) and not m.begins(before, shape("12.3.1990 and withheld", 52))
    assert m.begins(shape("the ledger.", 52), shape("4. The canal of Lumdral was admitted by the", 52))


def test_words_of_any_length_are_judged(spark):
    long = "inter" + "national" * 6
    rows = [(1, k, f"the {long} tribunal of it and so on the {long} tribunal") for k in range(40)] + [(2, 1, f"the {long.replace('na', 'ua', 1).replace('er', 'cr', 1)} tribunal 1t of so"), (3, 1, "x" * 300 + " " + "l" * 5000)]
    df = spark.createDataFrame(rows, "pdf_id bigint, page_number int, text string")
    s = scans.Scans(df)
    assert len(long) > 40 and s.rows.where("pdf_id = 3 and kind not in ('furniture', 'first', 'labels')").count() == 0
    assert not scans.is_word("l" * 65) and len(scans.variants("l" * 64)) >= 64


def test_parts_of_the_filter_agree(spark):
    words = spark.createDataFrame([(f"w{k}",) for k in range(1000)], "word string").repartition(70)
    table = scans.bloom(words).value
    assert table[scans._places([f"w{k}" for k in range(1000)])].all() and table.sum() <= 1000
