import os

import pytest
from pyspark.sql import functions as F

from lexweave.functions import statutes as S
from lexweave.functions import text as T
from lexweave.operators import cleaning, models, quality, scans, segments, vectors
from lexweave.sources import jsonl, tables


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,want", [("criminal tax", "civil"), ("CRIMINAL", "criminal"), ("Constitutional", "constitutional"), (None, "other"), ("", "other")])
def test_case_type(spark, value, want):
    assert one(spark, T.map_case_type, value) == want


@pytest.mark.parametrize("law,section,want", [("IPC", "IPC_302", "IPC_302"), ("IPC", "302", "IPC_302"), ("CONSTITUTION", "Article_14", "ARTICLE_14"), ("", "Art. 14", "ARTICLE_14"), (None, None, "_")])
def test_statute_key(spark, law, section, want):
    df = spark.createDataFrame([(law, section)], "a string, b string")
    assert df.select(S.statute_key(F.col("a"), F.col("b")).alias("k")).first()["k"] == want


@pytest.mark.parametrize("ref,want", [("IPC 302", "IPC_302"), ("Section 302 IPC", "IPC_302"), ("Section 5 of the Indian Penal Code", "IPC_5"), ("Art.21", "ARTICLE_21"), ("IPC302", "IPC302"), (None, None)])
def test_reference_key(spark, ref, want):
    assert one(spark, S.reference_key, ref) == want


def test_statute_references_quirks(spark):
    got = one(spark, T.statute_references, "IPC 302, ipc302 Article 19(1)(a) of Article 21A and IPC 420A; IPC 302")
    assert got == ["Article 19", "IPC 302", "ipc302"]
    assert one(spark, T.statute_references, None) is None


def test_nfkc_and_html(spark):
    assert one(spark, T.nfkc, "ﬁne ２") == "fine 2" and one(spark, T.nfkc, "a\nb") == "a\nb" and one(spark, T.nfkc, None) is None
    assert one(spark, T.html_to_text, "<p> a &amp; b<script>x</script></p><b>c") == "a & b\nc" and one(spark, T.html_to_text, None) is None


def test_nfkc_has_every_document(spark, tmp_path):
    import unicodedata

    from lexweave.plans import registry

    rows = [(1, "ﬁne ２", "en"), (2, "क़ानून ①", "hi"), (3, "½ page", None), (4, "№ 5 e\u0301", "EN"), (5, None, "en"), (6, "", ""), (7, "plain", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["nfkc"](spark, str(tmp_path)).collect())
    assert got == [(i, t and unicodedata.normalize("NFKC", t)) for i, t, _ in rows]


def test_json_part_and_words(spark):
    assert one(spark, T.json_part, 'x {"a": {}} y') == '{"a": {}}' and one(spark, T.json_part, "none") == "none"
    assert one(spark, T.limit_words, None) is None and one(spark, lambda c: T.limit_words(c, 2), " a  b c ") == "a b..."


def test_dense_ids_with_ties_in_other_columns(spark):
    df = spark.range(100).select((100 - F.col("id")).alias("k"), F.lit("same").alias("v"))
    got = {r["k"]: r["n"] for r in scans.dense_ids(df, ["k"], "n").collect()}
    assert got == {k: k - 1 for k in range(1, 101)}
    assert scans.dense_ids(df.where("k < 0"), ["k"], "n").count() == 0


def test_repeated_lines(spark):
    line = "this line is long enough to be counted"
    df = spark.createDataFrame([(1, "\n".join([line] * 6 + ["x"] * 9)), (2, "\n".join([line] * 5)), (3, None), (4, "")], "k int, text string")
    got = dict(tuple(r) for r in cleaning.drop_repeated_lines(df, ["k"], "text").collect())
    assert got == {1: "\n".join(["x"] * 9), 2: "\n".join([line] * 5), 3: None, 4: ""}


@pytest.mark.parametrize(
    "lines,want",
    [
        (["a", "b", "c", "JUDGMENT", "d"], 1),
        (["counsel", "x", "-----", "y"], 3),
        (["counsel", "1", "2", "3", "4", "we hold that", "y"], 2),
        (["0", "1", "2", "3", "4", "advocate"] + ["z"] * 10, 11),
        (["a", "b"], 2),
        ([], 0),
    ],
)
def test_body_start(spark, lines, want):
    df = spark.createDataFrame([(1, lines)], "k int, lines array<string>")
    assert cleaning.body_starts(df, ["k"], "lines").first()["start"] == want


def test_segments(spark):
    assert one(spark, lambda c: segments.merge_fragments(segments.split_paragraphs(c)), "short\n\nalso\n\n" + "x" * 60) == ["short also", "x" * 60]
    assert one(spark, lambda c: segments.merge_fragments(segments.split_paragraphs(c)), "") == []
    assert one(spark, lambda c: segments.split_long(c, 10), "y" * 25) == ["y" * 10, "y" * 10, "y" * 5]
    got = one(spark, lambda c: segments.align(c, F.array(F.lit("a b"), F.lit("zz"), F.lit("c"))), "a b  c")
    assert [(r["start"], r["mode"]) for r in got] == [(0, "exact"), (None, "failed"), (5, "exact")]


def test_gate_on_nulls_and_nothing(spark):
    kind = "case_id bigint, para_id bigint, text string, length int, alignment_failed boolean, paragraph_roles array<string>"
    df = spark.createDataFrame([(1, 1, None, None, None, None), (1, 2, "x", 0, True, ["facts"])], kind)
    r = quality.validated(df).first()
    assert not r["valid"] and r["total"] == 1 and "doc_too_short_1" in r["reasons"] and "high_align_fail" in r["reasons"]
    assert quality.validated(df.where("case_id > 1")).count() == 0
    assert quality.report(quality.validated(df.where("case_id > 1"))).first()["kept_pct"] is None


def test_nearest_each_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(60, 4)), 1)
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id bigint, embedding array<double>").repartition(5)
    got = {}
    for r in vectors.nearest_each(df, df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding"), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(3):
        d = ((v - v[q]) ** 2).sum(1).round(9)
        assert list(dict(sorted(got[q].items())).values()) == sorted(range(60), key=lambda i: (d[i], i))[:5]


def test_nearest_each_with_many_equal_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 8))
    same = rng.permutation(200)[:50]
    v[same] = v[same[0]]
    near = rng.permutation(np.setdiff1d(np.arange(200), same))[:40]
    v[near] = v[near[0]] + 1e-9 * rng.integers(0, 3, size=(40, 8))
    rows = [(int(i), [float(x) for x in v[i]]) for i in rng.permutation(200)]
    queries = [int(same[0]), int(near[0]), *range(3)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(parts)
        got = {}
        for r in vectors.nearest_each(df, df.where(F.col("vec_id").isin(queries)).select(F.col("vec_id").alias("query_id"), "embedding"), 5).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
        for q in queries:
            d = np.zeros(200)
            for j in range(8):  # term by term; sum() corrects its rounding
                d += (v[:, j] - v[q, j]) ** 2
            assert [got[q][k] for k in range(1, 6)] == sorted((d[i], i) for i in range(200))[:5]
        assert [got[int(same[0])][k][1] for k in range(1, 6)] == sorted(map(int, same))[:5]


def test_every_20th_vector_is_searched(spark, tmp_path):
    from lexweave.plans import registry

    rows = [(i, [float(i), float(i % 7)], 0) for i in range(101)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("knn_batch", "similarity_band"):
        got = [r["query_id"] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == [q for q in range(0, 101, 20) for _ in range(5)]


def test_index_and_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    tables.save_index(df, str(tmp_path / "ix"))
    back, manifest = tables.load_index(spark, str(tmp_path / "ix"))
    assert back.count() == 2 and manifest["dimension"] == 2
    with pytest.raises(FileNotFoundError):
        tables.load_index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        tables.save_index(df.union(spark.createDataFrame([(3, [1.0])], df.schema)), str(tmp_path / "bad"))
    path = str(tmp_path / "lines.jsonl")
    with open(path, "w") as f:
        f.write('{"a": 1}\n\n{"a": \n{"a": null, "b": 2}\n')
    rows = jsonl.read_jsonl(spark, path, "a int").collect()
    assert sum(r["_bad"] is not None for r in rows) == 1 and len(rows) == 3
    assert tables.read_csv_optional(spark, str(tmp_path / "no.csv"), "a string") is None
    (tmp_path / "a.csv").write_text('Section,Title\n"1","x, y"\n')
    assert tables.read_csv_optional(spark, str(tmp_path / "a.csv"), "Section string, Title string").first()["Title"] == "x, y"


def test_models_degrade(spark):
    def broken(prompts):
        raise OSError("no server")

    assert one(spark, lambda c: models.generated(c, broken), "x") is None
    assert one(spark, lambda c: models.generated(c), None) is None


def test_core_does_not_import_llm():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for root, _, files in os.walk(f"{here}/lexweave"):
        if f"{os.sep}llm" not in root:
            for f in files:
                if f.endswith(".py"):
                    assert "lexweave.llm" not in open(os.path.join(root, f)).read(), f
