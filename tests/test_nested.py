import datetime as dt
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.operators import nested

T0 = dt.datetime(2024, 1, 1)


def rows(spark, records):
    data = [(i, json.dumps(r) if not isinstance(r, str) and r is not None else r, T0 + dt.timedelta(days=i)) for i, r in enumerate(records, 1)]
    return spark.createDataFrame(data, "line_no bigint, record string, ingested_at timestamp")


def found(spark, records):
    return {tuple(r) for r in nested.case_rows(nested.read_cases(rows(spark, records))).select(*nested.KEYS).collect()}


def test_positions_nulls_and_bare_values(spark):
    case = {"case_id": "7", "paragraphs": [None, {"text": "x", "paragraph_roles": "facts", "sentences": json.dumps([{"start": 0, "cites": [None, {"law": "A"}]}])}]}
    assert found(spark, [case]) == {("paragraph", 7, 2, 0, 0, ""), ("role", 7, 2, 1, 0, ""), ("sentence", 7, 2, 1, 0, ""), ("cite", 7, 2, 1, 2, "")}


def test_single_object_envelope_and_latest(spark):
    old = {"case_id": 1, "paragraphs": [{"paragraph_roles": ["a", None, "b"]}]}
    new = {"version": 2, "case": {"case_id": 1, "paragraphs": {"paragraph_roles": []}}}
    broken = '{"case_id": 1, "paragraphs": [{"te'
    assert found(spark, [old, new, broken]) == {("paragraph", 1, 1, 0, 0, "")}


def test_nothing_to_read(spark):
    assert found(spark, [None, "", "   ", "nonsense", {"paragraphs": []}, {"case_id": "x", "paragraphs": [{}]}, {"case_id": 2}]) == set()


def test_unnest_kernel_keeps_parents_of_empty_and_null_lists():
    values, parent, number = nested.unnest(pa.array([[1, 2], None, [], [3]]))
    assert values.to_pylist() == [1, 2, 3] and parent.to_pylist() == [0, 0, 3] and number.to_pylist() == [1, 2, 1]
    cut = pa.array([[9], [1, 2], [3]]).slice(1)
    values, parent, number = nested.unnest(cut)
    assert values.to_pylist() == [1, 2, 3] and parent.to_pylist() == [0, 0, 1] and number.to_pylist() == [1, 2, 1]


def test_flatten_and_clash(spark):
    df = spark.createDataFrame([(1, [("a", 2)]), (2, None), (3, [])], "k int, x array<struct<n:string,m:int>>").withColumn("n", F.lit("outer"))
    assert [tuple(r) for r in nested.flatten(df, ["k"], "x", "no").collect()] == [(1, 1, "a", 2)]
    with pytest.raises(ValueError):
        nested.flatten(df, ["k", "n"], "x", "no")


def test_summary_sections(spark):
    kind = "case_id bigint, structured_summary struct<facts:string,issues:string,arguments:string,reasoning:string,decision:string,statutes:array<string>>, ingested_at timestamp"
    data = [(1, ("x", " \n", None, "", "d", ["s", None, "s"]), T0), (1, ("x", " \n", None, "", "d", ["s", None, "s"]), T0), (2, None, T0), (None, None, None)]
    out = {tuple(r) for r in nested.summary_rows(nested.latest_summaries(spark.createDataFrame(data, kind))).select(*nested.KEYS).collect()}
    assert out == {("section", 1, 0, 0, 0, "facts"), ("section", 1, 0, 0, 0, "decision"), ("summary_statute", 1, 0, 1, 0, ""), ("summary_statute", 1, 0, 3, 0, "")}


def test_every_cite_has_a_row_and_every_line_an_end(spark, tmp_path):
    from lexweave.plans import nested_queries as q

    sentences = [{"start": 0, "end": 4, "cites": ["IPC 302", {"law": "IPC", "section": "34", "span": {"raw": "s. 34", "score": 0.5}}, {"other": 1}, None, 12]}, {"cites": "AIR 1950 SC 27"}]
    case = {"case_id": 7, "paragraphs": [{"para_id": 1, "text": "x", "paragraph_roles": ["facts"], "sentences": sentences}]}
    data = [case, None, "", " \t", "{broken", {"paragraphs": []}, {"case_id": "seven", "paragraphs": [{}]}, {"case_id": 8}]
    rows(spark, data).write.parquet(str(tmp_path / "role_labelled_raw.parquet"))
    empty = "case_id bigint, structured_summary struct<facts:string,issues:string,arguments:string,reasoning:string,decision:string,statutes:array<string>>, ingested_at timestamp"
    spark.createDataFrame([], empty).write.parquet(str(tmp_path / "summarization_dataset.parquet"))
    run = lambda n: q.QUERIES[n](spark, str(tmp_path)).collect()
    cites = {(r["sentence_no"], r["cite_no"]): (r["law"], r["section"], r["raw"], r["score"], r["value"]) for r in run("p5_cites")}
    assert cites == {(1, 1): (None, None, None, None, "IPC 302"), (1, 2): ("IPC", "34", "s. 34", 0.5, None), (1, 3): (None,) * 5, (1, 5): (None,) * 4 + ("12",), (2, 1): (None,) * 4 + ("AIR 1950 SC 27",)}
    found = run("p5_found")
    for level, name in (("paragraph", "p5_paragraphs"), ("role", "p5_roles"), ("sentence", "p5_sentences"), ("cite", "p5_cites")):
        assert sum(r["level"] == level for r in found) == len(run(name)) > 0
    assert {r["line_no"]: r["reason"] for r in run("p5_rejects")} == {2: "blank", 3: "blank", 4: "blank", 5: "unparsed", 6: "no_case_id", 7: "no_case_id"}


def test_latest_is_the_same_joined_by_shuffle(spark, monkeypatch):
    records = [{"case_id": k % 3, "paragraphs": [{"text": str(k), "paragraph_roles": ["a"] * (k + 1)}]} for k in range(9)]
    small = found(spark, records)
    monkeypatch.setattr(nested, "BROADCAST_KEYS", 0)
    assert found(spark, records) == small and {r for r in small if r[0] == "role" and r[3] > 6} == {("role", 0, 1, 7, 0, ""), ("role", 1, 1, 7, 0, ""), ("role", 1, 1, 8, 0, ""), ("role", 2, 1, 7, 0, ""), ("role", 2, 1, 8, 0, ""), ("role", 2, 1, 9, 0, "")}
