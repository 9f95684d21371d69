"""Sinks over DataFrames: what the matches of a rule become."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns
from ..functions.scalar import Drop, evaluate
from ..functions.text import number_of, text_of, whole_of
from ..plans.compiler import Leaf, Match, Relation, leaves, project, relation_of, signature, union
from ..terms import Term, Var, canon, key, least_general, most_general, render, substitute, variables
from .rules import top_n

BIG = 1.7976931348623157e308


def united(relations: list[Relation]) -> list[Relation]:
    """Relations of the same shape as one."""
    by: dict[tuple, Relation] = {}
    for r in relations:
        by[r.signature] = union(by[r.signature], r) if r.signature in by else r
    return list(by.values())


def order_key(r: Relation) -> Column:
    """The order-keeping encoding of a relation's atoms."""
    parts: list[Column] = []
    seen: dict[Var, int] = {}

    def place(t: Term) -> None:
        if isinstance(t, tuple):
            parts.append(F.lit(bytes([len(t)])))
            for x in t:
                place(x)
        elif isinstance(t, Var):
            parts.append(F.lit(bytes([0x80 | seen[t]]) if t in seen else b"\xc0"))
            seen.setdefault(t, len(seen))
        elif isinstance(t, bytes):
            parts.append(F.lit(key(t)))
        else:
            text = text_of(F.col(t.name), r.kind(t.name), r.shown.get(t.name))
            parts.append(F.concat(F.unhex(F.hex(F.octet_length(text) + 192)), text.cast("binary")))

    place(r.shape)
    return F.concat(*parts)


def top(relations: list[Relation], n: int, last: bool) -> list[Relation]:
    """The n smallest (or largest) atoms of all relations together."""
    ranked = []
    for i, r in enumerate(relations):
        k = order_key(r)
        ranked.append((i, r, r.df.withColumn("order_key", k).orderBy(F.col("order_key").desc() if last else F.col("order_key").asc()).limit(n)))
    if len(ranked) == 1:
        return [Relation(ranked[0][1].shape, ranked[0][2].drop("order_key"), ranked[0][1].shown)]
    keys = sorted(((bytes(row[0]), i) for i, _, df in ranked for row in df.select("order_key").collect()), reverse=last)[:n]
    return [Relation(r.shape, df.where(F.col("order_key").isin([bytearray(k) for k, j in keys if j == i])).drop("order_key"), r.shown) for i, r, df in ranked]


def reduction(kind: str, matches: list[Match], args: tuple[Term, Term, Term]) -> list[Relation]:
    """(kind R S V): groups of the set of (R, S, V) by R and S (count: by R), then guard, plain result or spliced value."""
    rows: dict[tuple, list] = {}
    for m in matches:
        trees = tuple(m.term(t) for t in args)
        names: dict[Leaf, str] = {x: f"k{i}" for i, x in enumerate(dict.fromkeys(leaves(trees)))}
        same = repr(canon(_named(trees, names)))
        df = m.df.select(*[F.col(x.column).alias(n) for x, n in names.items()]) if names else m.df.select(F.lit(1).alias("k"))
        rows.setdefault(same, []).append((df, trees, names, m))
    out = []
    for group in rows.values():
        df, (result, slot, value), names, m = group[0]
        for other in group[1:]:
            df = df.union(other[0])
        out += _reduced(kind, df.distinct(), result, slot, value, names, m)
    return out


def _named(t: Term, names: dict) -> Term:
    if isinstance(t, tuple):
        return tuple(_named(x, names) for x in t)
    return names[t].encode() if isinstance(t, Leaf) else t


def _reduced(kind: str, df: DataFrame, result: Term, slot: Term, value: Term, names: dict, m: Match) -> list[Relation]:
    by_result = list(dict.fromkeys(names[x] for x in leaves(result)))
    by_slot = [names[slot]] if isinstance(slot, Leaf) and names[slot] not in by_result else []
    if isinstance(value, Leaf):
        v, vk, vs = F.col(names[value]), m.kind(value), m.shown(value)
    else:
        v, vk, vs = F.lit(value.decode() if isinstance(value, bytes) else None).cast("string"), T.StringType(), None
    text = text_of(v, vk, vs)
    number = number_of(text if vs else v, T.StringType() if vs else vk)
    plain = F.when(~F.isnan(number), number)
    how, shown, width = {
        "count": lambda: (F.count("*"), None, None),
        "sum": lambda: (F.coalesce(F.sum(whole_of(v, vk)), F.lit(0)) % (2**32), None, None),
        "and": lambda: (F.bit_and(F.conv(F.hex(F.substring(text.cast("binary"), 1, 1)), 16, 10).cast("int")), None, None),
        "hash": lambda: (F.bit_xor(F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")), None, None),
        "fsum": lambda: (F.coalesce(F.sum(number), F.lit(0.0)), "display", 63),
        "fprod": lambda: (F.coalesce(F.product(number), F.lit(1.0)), "display", 63),
        "fmin": lambda: (F.coalesce(F.min(plain), F.lit(BIG)), "display", 63),
        "fmax": lambda: (F.coalesce(F.max(plain), F.lit(-BIG)), "display", 63),
    }[kind]()
    if kind == "count":
        done = df.groupBy(*by_result).agg(how.alias("value"))
        if by_slot:
            done = df.select(*by_result, *by_slot).distinct().join(done, by_result) if by_result else df.select(*by_slot).distinct().crossJoin(done)
    else:
        done = df.groupBy(*by_result, *by_slot).agg(how.alias("value"))
    if not by_result and not by_slot:
        done = done.where(F.lit(True)) if kind != "count" else done.where("value > 0")
        if kind != "count":
            done = df.agg(how.alias("value"), F.count("*").alias("rows_")).where("rows_ > 0").drop("rows_")
    if kind == "and":
        done = done.withColumn("value", F.unhex(F.lpad(F.hex("value"), 2, "0")).cast("string"))
    if kind == "hash":
        done = done.withColumn("value", F.unhex(F.lpad(F.hex("value"), 16, "0")))
    if width:  # longer texts than a symbol holds are dropped
        x = F.abs("value")
        done = done.where((x == 0) | F.isnan("value") | ((x < 1e60) & (x > 1e-40)) | (F.length(text_of(F.col("value"), T.DoubleType(), shown)) <= width))
    at = {Leaf(n): (F.col(n), m.shown(x)) for x, n in names.items()}
    tree = _leafed(result, names)
    if isinstance(slot, Var):
        if slot in variables(result):
            tree = substitute(tree, {slot: Leaf("value")})
            at[Leaf("value")] = (F.col("value"), shown)
        return [relation_of(done, tree, at)]
    written = text_of(F.col("value"), done.schema["value"].dataType, shown)
    guard = F.lit(slot.decode()) if isinstance(slot, bytes) else text_of(F.col(names[slot]), m.kind(slot), m.shown(slot))
    return [relation_of(done.where(written == guard), tree, at)]


def _leafed(t: Term, names: dict) -> Term:
    if isinstance(t, tuple):
        return tuple(_leafed(x, names) for x in t)
    return Leaf(names[t]) if isinstance(t, Leaf) else t


def computed(m: Match, template: Term, slot: Term, formula: Term) -> Relation | None:
    """(pure T S F): native Columns where the formula allows, else an Arrow-batched function."""
    tree, slot, formula = m.term(template), m.term(slot), m.term(formula)
    if not isinstance(slot, Var):
        return None
    at = {x: (F.col(x.column), m.shown(x)) for x in leaves(tree)}
    if slot not in variables(tree):
        return relation_of(m.df, tree, at)
    built = columns.build(formula, m.text, lambda x: (F.col(x.column), m.kind(x)))
    inputs = list(dict.fromkeys(leaves(formula)))
    if built is not None and built[0] is not None and built[1] == "text":
        df = m.df.withColumn("value", built[0])
    else:
        texts = [m.text(x).alias(x.column) for x in inputs]
        df = m.df.withColumn("value", _function(formula, inputs)(*[t for t in texts]) if texts else F.lit(_value({}, formula)))
    df = df.where((F.col("value").isNotNull()) & F.octet_length("value").between(1, 63))
    return relation_of(df, substitute(tree, {slot: Leaf("value")}), at | {Leaf("value"): (F.col("value"), None)})


def _value(values: dict, formula: Term) -> str | None:
    def fill(t: Term) -> Term:
        if isinstance(t, tuple):
            return tuple(fill(x) for x in t)
        return values[t].encode() if isinstance(t, Leaf) else t

    try:
        got = evaluate(fill(formula))
    except Drop:
        return None
    try:
        return got.decode() if isinstance(got, bytes) else render(got)
    except UnicodeDecodeError:
        return None


def _function(formula: Term, inputs: list[Leaf]):
    @F.pandas_udf("string")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else _value(dict(zip(inputs, row, strict=True)), formula) for row in zip(*series, strict=True)], dtype=object)

    return run


def unified(relations: list[Relation]) -> Term | None:
    """The most general unifier of all atoms; two distinct ground ones of a shape already conflict, so two rows a shape are enough."""
    terms = []
    for r in relations:
        for row in r.df.limit(2).collect():
            terms.append(term_of(r, row))
    return most_general(sorted(terms, key=key)) if terms else None


def generalised(relations: list[Relation]) -> Term | None:
    """The least general generalisation, from one aggregate over each shape: constant columns stay, columns that agree in every row share a variable."""
    out = []
    for r in relations:
        names = [x.name for x in leaves(r.shape)]
        text = {n: text_of(F.col(n), r.kind(n), r.shown.get(n)) for n in names}
        pairs = [(p, q) for i, p in enumerate(names) for q in names[i + 1 :]]
        aggs = [F.count("*").alias("n")] + [F.min(text[n]).alias(f"lo_{n}") for n in names] + [F.max(text[n]).alias(f"hi_{n}") for n in names] + [F.min(text[p] == text[q]).alias(f"eq_{p}_{q}") for p, q in pairs]
        row = r.df.agg(*aggs).first()
        if not row["n"]:
            continue
        group = {n: n for n in names}
        for p, q in pairs:
            if row[f"eq_{p}_{q}"]:
                group[q] = group[p]

        def place(t: Term, row=row, group=group) -> Term:
            if isinstance(t, tuple):
                return tuple(place(x) for x in t)
            if not isinstance(t, Leaf):
                return t
            lo = row[f"lo_{t.name}"]
            return lo.encode() if lo == row[f"hi_{t.name}"] else Var(("col", group[t.name]))

        out.append(canon(place(r.shape)))
    return least_general(sorted(out, key=key)) if out else None


def term_of(r: Relation, row) -> Term:
    """The atom of a row that was collected as it is."""
    from ..functions.scalar import debug, display

    def text(x: Leaf) -> bytes:
        v = row[x.name]
        if isinstance(v, float):
            return (display if r.shown.get(x.name) == "display" else debug)(v).encode()
        if isinstance(v, (bytes, bytearray)):
            return bytes(v)
        return ("true" if v else "false").encode() if isinstance(v, bool) else str(v).encode("utf-8", "surrogateescape")

    def place(t: Term) -> Term:
        if isinstance(t, tuple):
            return tuple(place(x) for x in t)
        return text(t) if isinstance(t, Leaf) else t

    return canon(place(r.shape))


__all__ = ["computed", "generalised", "project", "reduction", "signature", "term_of", "top", "top_n", "unified", "united"]
