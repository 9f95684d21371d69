"""Loaders and writers: s-expressions, CSV, JSON, JSON lines and Parquet, each as a DataFrame plan or, when small, in memory."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Leaf, relation_of
from ..terms import Term, TermError, parse, parse_one, sym, transform

MAX_DEPTH = 512


# ---------------------------------------------------------------------------------------------- text


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value of a text file: dense numbers from 0 in file order. Counts of partitions are all that the driver sees."""
    raw = spark.read.text(path).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"), "value")
    counts = sorted((r["p"], r["n"]) for r in raw.groupBy("p").agg(F.count("*").alias("n")).collect())
    before, at = [], 0
    for p, n in counts:
        before.append((p, at))
        at += n
    starts = spark.createDataFrame(before or [(0, 0)], "p int, start long")
    return raw.join(F.broadcast(starts), "p").select((F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("line"), "value")


def load_sexprs(space, path: str, head: str, arity: int) -> None:
    """Flat atoms ``(head a1 … an)``, one a line, at scale: lines of that form are split natively, all others go to the parser."""
    lines = space.spark.read.text(path)
    word = r"([^\s()\";$]+)"
    form = r"^\s*\(\s*" + _regex(head) + "".join(rf"\s+{word}" for _ in range(arity)) + r"\s*\)\s*$"
    flat = lines.where(F.col("value").rlike(form)).select(*[F.regexp_extract("value", form, i + 1).alias(f"c{i}") for i in range(arity)])
    space.add_table(flat, head, [f"c{i}" for i in range(arity)])
    for row in lines.where(~F.col("value").rlike(form) & (F.trim("value") != "")).toLocalIterator():
        space.add(row["value"])


def _regex(s: str) -> str:
    import re

    return re.escape(s)


# ---------------------------------------------------------------------------------------------- CSV


def csv_rows(spark: SparkSession, path: str, fields: int, sep: str = ",") -> DataFrame:
    """i, f1 … fn: the 0-based line number and the fields. No quoting; blank lines are skipped but counted; other lengths are left out."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    parts = F.split("value", _regex(sep), -1)
    return rows.where(F.size(parts) == fields).select("line", *[parts.getItem(i).alias(f"f{i + 1}") for i in range(fields)])


def load_csv(space, path: str, pattern: str, template: str, sep: str = ",") -> None:
    """Each row is ``(i f1 … fn)``; what the pattern takes from it goes through the template."""
    both = parse_one(f"({pattern} {template})")
    n = len(both[0]) - 1
    df = csv_rows(space.spark, path, n, sep)
    _transformed(space, df, ["line", *[f"f{i + 1}" for i in range(n)]], both[0], both[1])


def _transformed(space, df: DataFrame, columns: list[str], pattern: Term, template: Term) -> None:
    from ..plans.compiler import Relation, Source, matches, project

    r = Relation(tuple(Leaf(c) for c in columns), df)
    for m in matches([Source("plain", (pattern,))], [r], [template]):
        space.add_relation(project(m, template))


# ---------------------------------------------------------------------------------------------- JSON


def number_text(x: str) -> str:
    """A JSON number as integer mantissa and exponent: 1.5 is 15e-1."""
    m, _, e = x.lower().partition("e")
    whole, _, part = m.partition(".")
    exponent = int(e or 0) - len(part)
    digits = (whole + part).lstrip("0") if not whole.startswith("-") else "-" + (whole[1:] + part).lstrip("0")
    digits = digits if digits not in ("", "-") else digits + "0"
    return digits if exponent == 0 else f"{digits}e{exponent}"


class _Number(str):
    pass


def json_atoms(text: str) -> Iterator[tuple]:
    """Path atoms of a document: (key value) nested for objects, (index value) for arrays; scalars as text."""
    doc = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)

    def walk(x, depth: int) -> Iterator[Term]:
        if depth > MAX_DEPTH:
            raise TermError("a document is nested more than 512 deep")
        if isinstance(x, dict):
            if not x:
                yield b"{}"
            for k, v in x.items():
                for t in walk(v, depth + 1):
                    yield (sym(k)[:63], t)
        elif isinstance(x, list):
            if not x:
                yield b"[]"
            for i, v in enumerate(x):
                for t in walk(v, depth + 1):
                    yield (sym(i), t)
        elif isinstance(x, _Number):
            yield number_text(str(x)).encode()
        elif x is None or isinstance(x, bool):
            yield {None: b"null", True: b"true", False: b"false"}[x]
        else:
            yield sym(x)[:63] or b'""'

    yield from walk(doc, 0)


def load_json(space, text: str, prefix: str | None = None) -> int:
    """Adds a document's path atoms, below a constant prefix ``(p1 (p2 …))`` if one is given; the number of them."""
    atoms = list(json_atoms(text))
    if prefix is not None:
        lead = parse_one(prefix)
        atoms = [(lead, a) for a in atoms]
    space._put(atoms)
    return len(atoms)


def load_jsonl(space, path: str, head: str = "JSONL") -> DataFrame:
    """(head line key value) for the scalar members of each line's object, natively; nested values stay JSON text. Returns line, k, v."""
    rows = numbered_lines(space.spark, path).where(F.trim("value") != "")
    out = json_members(rows, "line", "value")
    space.add_table(out, head, ["line", "k", "v"])
    return out


def json_members(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, k, v for each member of the objects in a column of JSON texts; scalars as text, without a Python function."""
    members = F.from_json(F.col(text), T.MapType(T.StringType(), T.StringType()))
    return df.select(key, F.explode(members).alias("k", "v")).where(F.col("v").isNotNull())


def json_paths(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, path: every path atom of every document as text, for documents of any depth; one Arrow batch at a time."""
    import pyarrow as pa

    from ..terms import render

    def run(batches):
        for b in batches:
            ids, out = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for a in json_atoms(t or ""):
                        ids.append(k)
                        out.append(render(a))
                except (ValueError, TermError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(out, pa.string())], [key, "path"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, path string")


# ---------------------------------------------------------------------------------------------- conversion


def convert(text: str, pattern: str = "$x", template: str = "$x") -> str:
    """S-expressions through a pattern and a template, as text; other formats are not offered."""
    from ..terms import render

    both = parse_one(f"({pattern} {template})")
    found = [transform(t, both[0], both[1]) for t in parse(text)]
    return "\n".join(render(t) for t in found if t is not None)


def table_relation(df: DataFrame, head: str):
    """A DataFrame's rows as a relation ``(head c1 …)``."""
    tree = (sym(head), *[Leaf(c) for c in df.columns])
    return relation_of(df.dropna(), tree, {Leaf(c): (F.col(c), None) for c in df.columns})
