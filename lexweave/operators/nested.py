"""Problem 5: deeply nested records as related flat tables.

Records of drifting shape are read level by level into one typed nested column. Flattening is
done on Arrow buffers: a list column's offsets give its elements' parent rows and positions,
the keys are taken by parent index, and no row is looked at on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import durable


def as_array(text: Column) -> Column:
    """JSON text, or a bare value, as an array of texts: an array's elements, else an array of one; null stays null."""
    t = F.trim(text)
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).when(text.isNotNull(), F.array(text))


#: Deliveries named in a broadcast; above, the same join is shuffled.
BROADCAST_KEYS = 500_000


def _lines(raw: DataFrame, record: str, order: tuple[str, ...]) -> DataFrame:
    """The order columns, whether the line is blank or parses, case_id (null if there is none) and the paragraphs' JSON."""
    top = "case_id string, paragraphs string, `case` string, _bad string"
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    r = raw.select(*order, F.col(record).alias("line"), F.from_json(F.col(record), top, options).alias("r"))
    inner = F.from_json(F.col("r.case"), "case_id string, paragraphs string")
    r = r.withColumn("i", F.when(F.col("r.case").isNotNull(), inner))
    return r.select(
        *order,
        (F.col("line").isNull() | ~F.col("line").rlike(r"\S")).alias("blank"),
        (F.col("r").isNotNull() & F.col("r._bad").isNull()).alias("parses"),
        F.expr("try_cast(trim(coalesce(r.case_id, i.case_id)) as bigint)").alias("case_id"),
        F.coalesce("r.paragraphs", "i.paragraphs").alias("p"),
    )


def rejects(raw: DataFrame, record: str = "record", order: tuple[str, ...] = ("ingested_at", "line_no")) -> DataFrame:
    """The order columns and `reason` of the lines that give no case: blank (also null), unparsed, no_case_id (none that is a number)."""
    r = _lines(raw, record, order)
    reason = F.when(F.col("blank"), "blank").when(~F.col("parses"), "unparsed").when(F.col("case_id").isNull(), "no_case_id")
    return r.select(*order, reason.alias("reason")).where("reason is not null")


def read_cases(raw: DataFrame, record: str = "record", order: tuple[str, ...] = ("ingested_at", "line_no")) -> DataFrame:
    """(case_id, paragraphs) of each case's latest delivery that parses.

    paragraphs: array<struct<here, fields, roles: array<>, sentences: array<struct<here, fields, cites: array<struct<here, value, fields>>>>>>;
    `here` tells an element from a null one, which keeps its position; a cite's `value` is the element
    if it is no object. Lines that give no case are those of `rejects`. Of equally late deliveries that
    with the highest line_no counts. A case may stand in an envelope under `case`.

    The latest deliveries are found on their keys alone; texts are not shuffled as long as the
    keys were counted to be few enough for a broadcast.
    """
    r = _lines(raw, record, order).where("parses and case_id is not null")
    last = r.groupBy("case_id").agg(F.max(F.struct(*order)).alias("last")).select("case_id", *[F.col(f"last.{c}").alias(f"last_{c}") for c in order])
    last = durable(last)
    small = last.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = [r["case_id"] == F.col("last_case")] + [r[c].eqNullSafe(F.col(f"last_{c}")) for c in order]
    last = last.withColumnRenamed("case_id", "last_case")
    r = r.join(F.broadcast(last) if small else last, same, "left_semi")

    def cite(c):
        v = F.from_json(c, "law string, section string, span struct<raw: string, score: double>")
        return F.struct(c.isNotNull().alias("here"), F.when(~F.trim(c).startswith("{"), c).alias("value"), v["law"].alias("law"), v["section"].alias("section"), v["span"]["raw"].alias("raw"), v["span"]["score"].alias("score"))

    def sentence(s):
        v = F.from_json(s, "start int, end int, cites string")
        return F.struct(s.isNotNull().alias("here"), v["start"].alias("start"), v["end"].alias("end"), F.transform(as_array(v["cites"]), cite).alias("cites"))

    def paragraph(p):
        v = F.from_json(p, "para_id string, text string, position string, role_source string, role_confidence string, paragraph_roles string, sentences string")
        own = [v[c].alias(c) for c in ("para_id", "text", "position", "role_source", "role_confidence")]
        return F.struct(p.isNotNull().alias("here"), *own, as_array(v["paragraph_roles"]).alias("roles"), F.transform(as_array(v["sentences"]), sentence).alias("sentences"))

    return r.select("case_id", F.transform(as_array(F.col("p")), paragraph).alias("paragraphs"))


# ---------------------------------------------------------------- kernels


def unnest(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """A list array's elements, each one's parent row, and its position in its list from 1."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = pc.list_flatten(lists)
    parent = pc.list_parent_indices(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(pc.cast(lengths, pa.int64()))
    first = pc.subtract(ends, pc.cast(lengths, pa.int64()))
    number = pc.subtract(pa.array(np.arange(len(values))), first.take(parent))
    return values, parent, pc.cast(pc.add(number, 1), pa.int32())


def field(structs: pa.Array, name: str) -> pa.Array:
    """A struct array's child, null where the struct is."""
    return pc.struct_field(structs, name)


KEYS = {"level": pa.string(), "case_id": pa.int64(), "para_no": pa.int32(), "item_no": pa.int32(), "sub_no": pa.int32(), "name": pa.string()}
FIELDS = {
    "para_id": pa.string(), "text": pa.string(), "position": pa.string(), "role_source": pa.string(), "role_confidence": pa.string(), "role": pa.string(), "start": pa.int32(), "end": pa.int32(),
    "law": pa.string(), "section": pa.string(), "raw": pa.string(), "score": pa.float64(), "value": pa.string(),
}
_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.float64(): "double"}


def _schema(columns) -> str:
    return ", ".join(f"`{c}` {_SQL[{**KEYS, **FIELDS}[c]]}" for c in columns)


def _table(level: str, keys: dict, fields: dict | None = None, columns=(*KEYS, *FIELDS)) -> pa.RecordBatch:
    """A batch of rows of one level; numbers that are not given are 0, names '', fields null."""
    n = len(keys["case_id"])
    fields = fields or {}

    def column(c):
        if c in keys:
            return keys[c].cast(KEYS[c])
        if c in fields:
            return fields[c]
        if c in KEYS:
            return pa.repeat(pa.scalar(level if c == "level" else "" if c == "name" else 0, KEYS[c]), n)
        return pa.nulls(n, FIELDS[c])

    return pa.RecordBatch.from_arrays([column(c) for c in columns], names=list(columns))


def case_rows(cases: DataFrame) -> DataFrame:
    """All paragraphs, roles, sentences and cites that are not null: level, their parents' keys and numbers, and their fields.

    A flat table is the rows of its level with the level's fields; the other fields are null.
    """
    columns = (*KEYS, *FIELDS)

    def run(batches):
        for b in batches:
            case = b.column("case_id")
            para, up, para_no = unnest(b.column("paragraphs"))
            case = case.take(up)
            here = pc.fill_null(field(para, "here"), False)
            own = {f: field(para, f).filter(here) for f in ("para_id", "text", "position", "role_source", "role_confidence")}
            yield _table("paragraph", {"case_id": case.filter(here), "para_no": para_no.filter(here)}, own, columns)
            role, up, role_no = unnest(field(para, "roles"))
            here = pc.is_valid(role)
            up = up.filter(here)
            yield _table("role", {"case_id": case.take(up), "para_no": para_no.take(up), "item_no": role_no.filter(here)}, {"role": role.filter(here)}, columns)
            sent, up, sent_no = unnest(field(para, "sentences"))
            s_case, s_para = case.take(up), para_no.take(up)
            here = pc.fill_null(field(sent, "here"), False)
            own = {f: field(sent, f).filter(here) for f in ("start", "end")}
            yield _table("sentence", {"case_id": s_case.filter(here), "para_no": s_para.filter(here), "item_no": sent_no.filter(here)}, own, columns)
            cite, up, cite_no = unnest(field(sent, "cites"))
            here = pc.fill_null(field(cite, "here"), False)
            up = up.filter(here)
            own = {f: field(cite, f).filter(here) for f in ("law", "section", "raw", "score", "value")}
            yield _table("cite", {"case_id": s_case.take(up), "para_no": s_para.take(up), "item_no": sent_no.take(up), "sub_no": cite_no.filter(here)}, own, columns)

    return cases.select("case_id", "paragraphs").mapInArrow(run, _schema(columns))


SECTIONS = ["facts", "issues", "arguments", "reasoning", "decision"]


def latest_summaries(df: DataFrame) -> DataFrame:
    """(case_id, structured_summary) of each case's latest delivery; of equally late ones, which have the same content, one.

    As for read_cases the latest is found on the keys, and the texts are not shuffled while the keys are few.
    """
    d = df.where("case_id is not null")
    last = durable(d.groupBy("case_id").agg(F.max("ingested_at").alias("last"), F.count("*").alias("n")))
    small = last.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    d = d.select("case_id", "ingested_at", "structured_summary").join(F.broadcast(last) if small else last, "case_id").where(F.col("ingested_at").eqNullSafe(F.col("last")))
    # only a case that came more than once can have several rows that are equally late
    once = d.where("n = 1").select("case_id", "structured_summary")
    return once.union(d.where("n > 1").select("case_id", "structured_summary").dropDuplicates(["case_id"]))


def summary_rows(summaries: DataFrame) -> DataFrame:
    """The written sections (name, text) and the statutes that are not null (item_no, value) of latest_summaries, with their case's key."""
    columns = (*KEYS, "text", "value")

    def run(batches):
        for b in batches:
            case, s = b.column("case_id"), b.column("structured_summary")
            for name in SECTIONS:
                text = field(s, name)
                here = pc.fill_null(pc.match_substring_regex(text, r"\S"), False)
                own = case.filter(here)
                yield _table("section", {"case_id": own, "name": pa.repeat(pa.scalar(name), len(own))}, {"text": text.filter(here)}, columns)
            value, up, no = unnest(field(s, "statutes"))
            here = pc.is_valid(value)
            yield _table("summary_statute", {"case_id": case.take(up.filter(here)), "item_no": no.filter(here)}, {"value": value.filter(here)}, columns)

    return summaries.select("case_id", "structured_summary").mapInArrow(run, _schema(columns))


def flatten(df: DataFrame, keys: list[str], lists: str, number: str) -> DataFrame:
    """keys, `number` (position from 1), and the element's fields, or `value` if it has none, for each element of a list column.

    Null and empty lists give no row; a null element gives a row of nulls at its position.
    Columns besides keys and the list are not carried along, so none can clash.
    """
    kind = df.schema[lists].dataType.elementType
    fields = kind.fieldNames() if hasattr(kind, "fieldNames") else []
    clash = set(fields or ["value"]) & {*keys, number}
    if clash:
        raise ValueError(f"element fields named like keys: {sorted(clash)}")
    parts = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{number}` int"]
    parts += [f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields] if fields else [f"`value` {kind.simpleString()}"]

    def run(batches):
        for b in batches:
            values, up, no = unnest(b.column(lists))
            columns = [b.column(k).take(up) for k in keys] + [no]
            columns += [field(values, f) for f in fields] if fields else [values]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, number, *(fields or ["value"])])

    return df.select(*keys, lists).mapInArrow(run, ", ".join(parts))
