import re

import numpy as np

from lexweave.llm import keyword_pages as kp

PROSE = "The appellant worked at the orchard and drew wages until the election was held, but the respondent denied that he had been there. "
HINDI = "न्यायालय ने लिखित साक्ष्य को उचित माना और गवाह का कहना है कि भूमि पर वादी का कब्ज़ा था। "


def pages():
    rows = [(i, PROSE * (2 + i % 4) + ("Keywords: a, b, c" if i % 3 else "")) for i in range(60)] + [(100 + i, HINDI * (3 + i % 3)) for i in range(30)]
    spam = [
        (201, "cheap bail lawyer Dunpur, best bail lawyer, bail lawyer near, top bail lawyer Dunpur price, " * 5),
        (202, "\n".join(f"Related: https://law-desk{k}.test/bail-lawyer-{k}" for k in range(12))),
        (203, "\n".join(f"Stamp ink bottle Rs {k} Add to cart" for k in range(100, 130))),
        (204, " ".join(f"#bail_lawyer_{k}" for k in range(30))),
        (205, "सस्ता वकील | फैसला pdf | तलाक वकील | धारा सूची | " * 8),
        (206, PROSE + "\n" + "moot memo Halrepur | fast judgment pdf | " * 20),
    ]
    other = [
        (301, None), (302, ""), (303, "Page not found"), (304, PROSE * 4 + "\nRead also: https://a.test/b"),
        (305, "\n".join(f"A v. B, AIR 19{k} SC 12; (1990) {k} SCC 5" for k in range(50, 70))), (306, "bail lawyer, bail lawyer"),
    ]
    return rows, spam, other


def test_pages(spark):
    rows, spam, other = pages()
    df = spark.createDataFrame(rows + spam + other + spam[:2] + [(None, spam[0][1])], "id bigint, text string").repartition(3)
    got = [r["id"] for r in kp.keyword_pages(df, "id", "text").collect()]
    assert sorted(got) == [i for i, _ in spam]


def test_half_is_most_of_a_long_page(spark):
    rows, _, _ = pages()
    half = lambda n: PROSE * n + "\n" + "moot memo Halrepur | fast judgment pdf | " * (4 * n)
    df = spark.createDataFrame(rows + [(401, half(20)), (402, half(2))], "id bigint, text string")
    got = {r["id"]: r["keyword_share"] for r in kp.keyword_pages(df, "id", "text").collect()}
    assert list(got) == [401] and 0.5 < got[401] < 0.58


def test_nothing(spark):
    assert kp.keyword_pages(spark.createDataFrame([], "id bigint, text string"), "id", "text").count() == 0
    assert kp.measure("", kp.Languages({}, {})) is None and kp.measure("a\n\nb", kp.Languages({}, {})) is None


FRENCH = """Le tribunal a considéré que la demande du requérant était fondée, car le bailleur n'avait pas remis les clés dans le délai prévu par le contrat.
Il ressort des pièces du dossier que la société avait connaissance du défaut, mais qu'elle n'a rien entrepris pour le réparer avant la vente de la maison.
Dans ces conditions, le jugement doit être confirmé, sans qu'il soit nécessaire d'examiner les autres moyens soulevés par les parties au litige."""
TAMIL = """நீதிமன்றம் வாதியின் சாட்சியத்தை ஏற்று பிரதிவாதியின் மறுப்பை நிராகரித்தது. நிலம் வாதிக்கு சொந்தமானது என்று ஆவணங்கள் தெளிவாக காட்டுகின்றன.
மேல்முறையீடு உரிய காரணங்கள் இல்லாததால் தள்ளுபடி செய்யப்பட்டது. செலவுத் தொகை குறித்து எந்த உத்தரவும் பிறப்பிக்கப்படவில்லை."""
TOPICS = "orchard wages election harvest licence tenancy fence boundary deed survey mortgage partition auction ledger bridge canal permit school tender pension".split()


def varied(k):
    t = TOPICS[k % 20], TOPICS[(k * 7 + 3) % 20], TOPICS[(k * 3 + 11) % 20], TOPICS[(k * 13 + 5) % 20]
    return f"The claim of the owner to the {t[0]} was denied by the clerk, who had kept the {t[1]} for a year. It was held that the {t[2]} of {k} persons should be returned before the {t[3]} is sold. No costs were asked for by either side, and the court made no order as to them."


def test_languages_that_the_corpus_does_not_know_give_no_case(spark):
    rows = [(k, varied(k), ["en", "EN", None][k % 3]) for k in range(200)] + [(1001, FRENCH, "fr"), (1002, TAMIL, None), (1003, FRENCH.replace("\n", " "), "en"), (1004, "\n".join([FRENCH, "Lire aussi: https://a.test/b"]), "")]
    rows += [(2001, "avocat pas cher, avocat divorce, avocat bail, avocat pas cher, avocat divorce, " * 6, "fr")]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string")
    assert {r["id"]: r["language"] for r in kp.keyword_pages(df, "id", "text", "lang").collect()} == {2001: ""}


def test_every_measure_decides_chunks():
    b = {"function_words": 10, "usual": 20, "separators": 8, "pairs": 2, "top_word": 5}
    c = np.zeros(10, kp.CHUNK_KIND)
    c["function_words"] = 25
    c["function_words"][0] = 9  # lacks function words
    c["link"][1] = c["repeated"][2] = 1
    for k, two in ((3, ("separators", "pairs")), (4, ("pairs", "top_word")), (5, ("separators", "top_word"))):
        c["function_words"][k] = 19
        for name in two:
            c[name][k] = 9
    for name in ("separators", "pairs", "top_word"):
        c[name][6] = 9  # all three, with as many function words as usual
        c[name][7] = 9  # a list of references
    c["figures"][7] = 1
    c["pairs"][8] = 9  # one alone
    assert np.flatnonzero(kp.keyword_chunks(c, b, True)).tolist() == [0, 1, 2, 3, 4, 5, 6]
    assert np.flatnonzero(kp.keyword_chunks(c, b, False)).tolist() == [1, 2, 3, 4, 5, 6]
    for name, lost in (("separators", [3, 5, 6]), ("pairs", [3, 4, 6]), ("top_word", [4, 5, 6]), ("link", [1]), ("repeated", [2])):
        d = c.copy()
        d[name] = 0
        assert np.flatnonzero(kp.keyword_chunks(d, b, True)).tolist() == [k for k in range(7) if k not in lost], name


def test_bounds():
    h = np.zeros(kp.BINS, np.int64)
    assert kp.upper_bound(h) == kp.BINS and kp.function_bounds(h) == {"function_words": 0, "usual": 0}
    h[20:24] = 100
    assert kp.upper_bound(h) == 23 and 6 <= kp.function_bounds(h)["function_words"] <= 11


def test_separators_and_pairs_are_counted_in_full():
    line = "a - b | c/d; e, f: g \u2022 h \u00b7 i \u00bb j * k > l x-y -z a*b -"
    assert kp.separators_in(line) == len(re.findall(r"[|/\u2022\u00b7\u00bb;,:]|(?<=\s)[-*>](?=\s)", line)) == 11
    words = " ".join(f"w{k}x" for k in range(20))
    none = kp.Languages({}, {})
    top_pair = lambda text: round(kp.measure(text, none)[4] * len(text.split()))
    assert [top_pair(t) for t in (words, words.replace(" ", "\n"), words + " w3x w4x", words + " w3x w5x", words + " a b a b a b")] == [1, 0, 2, 1, 3]
