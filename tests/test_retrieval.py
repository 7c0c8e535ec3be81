import pytest
from pyspark.sql import functions as F

from lexweave.functions import roles as R
from lexweave.functions import statutes as S
from lexweave.functions import text as T
from lexweave.operators import labelling, models, retrieval, scans, segments, vectors
from lexweave.operators.statutes import first_entries
from lexweave.sources import tables

CHUNKS = "vec_id bigint, text string, page_number int, section string, statutes array<string>"
KB = [(1, "IPC", "302", "Murder", "Whoever commits murder shall be punished with death."), (2, "CONSTITUTION", "Article 14", "Equality", "The State shall not deny.")]


def chunks(spark):
    rows = [
        (0, "The tender condition was held arbitrary and struck down.", 3, "REASONING", ["Article 14", None, "IPC 302"]),
        (1, "The witness saw the accused near the river.", 1, "FACTS", ["IPC 302"]),
        (2, None, 2, None, None), (3, "", None, None, []), (4, "Costs were not ordered.", None, None, None), (5, "The tender condition was held arbitrary and struck down.", 4, None, ["Section 999"]),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def kb(spark):
    return first_entries(spark.createDataFrame(KB, "statute_id bigint, law string, section string, title string, text string"), "statute_id")


def test_response_of_a_question(spark):
    q = spark.createDataFrame([(7, "Was the tender condition arbitrary?"), (8, None), (None, "x"), (9, "")], "query_id bigint, question string")
    out = {r["query_id"]: r for r in retrieval.responses(q, chunks(spark), kb(spark), 3).collect()}
    assert set(out) == {7, 9}
    r = out[7]
    # equal texts are ranked by their number
    assert [s["vec_id"] for s in r["sources"]][:2] == [0, 5] and [s["rank"] for s in r["sources"]] == [1, 2, 3]
    first = r["sources"][0]
    assert (first["page"], first["section"], first["statutes"], first["matching"]) == (3, "REASONING", ["Article 14", None, "IPC 302"], ["arbitrary", "condition", "tender"])
    entries = {s["key"]: s for s in r["statutes"]}
    assert entries["ARTICLE_14"]["law"] == "CONSTITUTION" and entries["IPC_302"]["title"] == "Murder" and 3 in entries["IPC_302"]["pages"]
    unknown = [s for s in r["statutes"] if s["law"] == "UNKNOWN"]
    assert [s["ref"] for s in unknown] == ["Section 999"]
    assert "STATUTE REFERENCE TABLE" in r["prompt"] and r["prompt"].endswith("Was the tender condition arbitrary?") and "[Source 1]" in r["prompt"]
    assert [(t["step"], t["action"]) for t in r["trace"]] == [(1, "rewrite"), (2, "search"), (3, "statutes"), (4, "answer")]
    assert r["trace"][1]["output"] == "3 chunks" and r["trace"][2]["output"] == f"{len(r['statutes'])} statutes" and r["trace"][3]["output"] == "answered"


def test_clients_that_rewrite_and_fail(spark):
    q = spark.createDataFrame([(1, "IPC?")], "query_id bigint, question string")
    long = retrieval.rewritten(q, lambda prompts: ['"Indian Penal Code provisions"' for _ in prompts]).first()
    assert (long["rewritten"], long["search"]) == ("Indian Penal Code provisions",) * 2

    def broken(prompts):
        raise OSError("no server")

    assert retrieval.rewritten(q, broken).first()["search"] == "IPC?" and retrieval.rewritten(q, lambda p: ["short"] * len(p)).first()["search"] == "IPC?"
    r = retrieval.responses(q, chunks(spark), kb(spark), 2, client=broken).first()
    assert r["answer"] is None and r["trace"][3]["output"] == "none" and len(r["sources"]) == 2


def test_bounds_of_a_search(spark):
    q = spark.createDataFrame([(1, "tender")], "query_id bigint, question string")
    for k in (0, 11):
        with pytest.raises(ValueError):
            retrieval.retrieve(q, chunks(spark), k)
    with pytest.raises(ValueError):
        retrieval.responses(q, chunks(spark).where("vec_id < 0"), kb(spark))
    assert retrieval.retrieve(q.where("query_id < 0"), chunks(spark)).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    other = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None)], "query_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="dimensions"):
        vectors.nearest_each(v, other, 1).collect()
    assert vectors.nearest_each(v, other.where("query_id = 2"), 1).count() == 0


def test_hashed_words():
    e = models.hashing_embedder(64)(["Tender, tender; river", "", "river TENDER tender"])
    assert abs(float((e[0] ** 2).sum()) - 1) < 1e-6 and (e[0] == e[2]).all() and not e[1].any()


def test_documents_are_replaced(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        tables.stored_documents(spark, path)
    rows = lambda *r: spark.createDataFrame(list(r), "k bigint, v string")
    tables.replace_documents(rows((1, "a"), (1, "b"), (2, "c"), (None, "x")), path, "k", 4)
    tables.replace_documents(rows((1, "new"), (3, None)), path, "k", 4)
    tables.replace_documents(rows((9, "x")).where("k < 0"), path, "k", 4)
    assert sorted(map(tuple, tables.stored_documents(spark, path).collect()), key=str) == [(1, "new"), (2, "c"), (3, None)]


def test_numbers_within_groups(spark):
    rows = [(1, k) for k in range(500)] + [(2, 5), (None, 3), (None, 1)]
    df = spark.createDataFrame(rows, "g int, k int").repartition(7)
    got = {(r["g"], r["k"]): r["n"] for r in scans.numbered(df, ["g"], ["k"], "n").collect()}
    assert got == {**{(1, k): k for k in range(500)}, (2, 5): 0, (None, 3): 1, (None, 1): 0}
    assert scans.numbered(df.where("k < 0"), ["g"], ["k"], "n").count() == 0
    at = {(r["g"], r["k"]): r["position"] for r in segments.positions(df, "g", "k").collect()}
    assert [at[1, k] for k in (0, 99, 100, 400, 401)] == ["start", "start", "middle", "middle", "end"] and at[None, 1] == "start"


def test_segments_of_a_text(spark):
    long = "One sentence of the order is here. " * 60
    text = f"1. First paragraph of the order, long enough to stand on its own here.\n\nshort\n\n{long}\n\n" + "x" * 3200
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a")], "k int, t string")
    got = {r["k"]: r["s"] for r in df.select("k", segments.segment(F.col("t")).alias("s")).collect()}
    assert got[2] is None and got[3] == [] and got[4] == ["a"]
    assert got[1][0].endswith("here. short") and all(len(p) <= 1500 for p in got[1]) and [len(p) for p in got[1][-3:]] == [1500, 1500, 200]
    capped = df.where("k = 1").select(segments.segment(F.col("t"), most=2).alias("s")).first()["s"]
    assert capped == got[1][:2]


def test_a_text_of_very_many_parts_is_aligned_in_time(spark):
    words = [f"part{k} of  the text" for k in range(20_000)]
    parts = [w.replace("  ", " ") for w in words]
    df = spark.createDataFrame([("\n".join(words), parts)], "t string, p array<string>")
    modes = df.select(segments.align(F.col("t"), F.col("p")).alias("a")).select(F.expr("array_distinct(transform(a, x -> x.mode))").alias("m"), F.expr("size(a)").alias("n")).first()
    assert modes["m"] == ["spaced"] and modes["n"] == 20_000


def test_chunks_of_documents(spark):
    rows = [(1, 1, 4, "a b c. d e f. g h."), (1, 2, 3, "i j k l m n o p q. r."), (2, 1, 1, ""), (2, 2, 1, None), (3, 1, None, "x y. z.")]
    df = spark.createDataFrame(rows, "g int, o int, page_number int, text string")
    got = sorted(tuple(r) for r in segments.chunk_blocks(df, "g", ["o"], 6).collect())
    assert got == [(1, 1, "a b c. d e f.", 4, 6), (1, 2, "g h.", 4, 2), (1, 3, "i j k l m n o p q.", 3, 9), (1, 4, "r.", 3, 1), (3, 1, "x y. z.", None, 3)]


@pytest.mark.parametrize(
    "answer,n,want",
    [
        ('{"labels": ["facts", "other"]}', 2, ["facts", "other"]),
        ("the first is facts, then arguments and other", 2, ["facts", "arguments"]),
        ("1. f a c t s\n2) Final_Decision.\n- issu es", 3, ["facts", "final_decision", "issues"]),
        ("nothing", 1, None), (None, 1, None), ("facts", 2, None),
    ],
)
def test_labels_of_an_answer(spark, answer, n, want):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(R.parsed_labels(F.col("a"), n, T.json_part(F.col("a"))).alias("l")).first()["l"] == want


# what each rule says, written out: the SQL of the queries is built from the same word lists as the operators
LITERAL = [
    ("The appeal is allowed.", "middle", "final_decision"), ("The appeal stands dismissed with costs.", "end", "final_decision"),
    ("We are of the opinion that the claim fails.", "middle", "reasoning"), ("It was submitted by learned counsel that the deed is void.", "middle", "arguments"),
]


@pytest.mark.parametrize("text,position,want", LITERAL)
def test_literal_labels(spark, text, position, want):
    df = spark.createDataFrame([(1, 1, text, position, True)], "case_id bigint, para_id bigint, text string, position string, usable_for_evidence boolean")
    assert labelling.label(df).first()["role"] == want


def test_single_labels(spark):
    rows = [(1, k, t, "middle") for k, t in enumerate(["The appeal is allowed.", "quiet text", "quiet text two", "quiet text three"])]
    df = spark.createDataFrame(rows, "case_id bigint, para_id bigint, text string, position string")
    answer = F.expr("case para_id when 1 then ' Issues!' when 2 then 'no idea' end")
    got = {r["para_id"]: (r["source"], r["confidence"]) for r in labelling.label_single(df, answer).collect()}
    assert got[0][0].startswith("regex_") and got[0][1] == 0.9 and got[1] == ("llm_single", 0.75) and got[2] == ("llm_fallback", 0.5) and got[3] == ("rule_fallback", 0.4)


def test_badges_and_sections(spark):
    df = spark.createDataFrame([("IPC",), ("CONSTITUTION",), ("CRPC",), (None,)], "c string")
    assert [r[0] for r in df.select(S.law_badge(F.col("c"))).collect()] == ["IPC", "ART", "UNKNOWN", "UNKNOWN"]
    d = spark.createDataFrame([("Part of the reasoning",), ("none",), (None,)], "c string")
    assert [r[0] for r in d.select(T.section_named(F.col("c"))).collect()] == ["REASONING", "UNKNOWN", "UNKNOWN"]


def test_clients_over_http(spark):
    import http.server
    import json
    import threading

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if body["model"] == "down":
                self.send_error(500)
                return
            out = {"response": f" {body['prompt'].upper()} {body['options']} "} if "prompt" in body else {"embeddings": [[float(len(t)), 1.0] for t in body["input"]]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        df = spark.createDataFrame([(1, "abc"), (2, None)], "k int, t string")
        got = {r["k"]: r["a"] for r in df.select("k", models.generated(F.col("t"), models.http_generate(url, "m", {"temperature": 0}, 5)).alias("a")).collect()}
        assert got == {1: "ABC {'temperature': 0}", 2: None}
        assert df.select(models.generated(F.col("t"), models.http_generate(url, "down")).alias("a")).where("a is not null").count() == 0
        e = {r["k"]: r["embedding"] for r in models.embedded(df, "t", models.http_embed(url, "m", 5)).collect()}
        assert e == {1: [3.0, 1.0], 2: None} and models.embedding_dimension(models.http_embed(url, "m")) == 2
    finally:
        server.shutdown()
