"""Compiles pattern lists over shape-partitioned relations to DataFrame plans.

A relation is a DataFrame with a shape: a term whose symbols are columns (``Leaf``) but for the head, and in which
variables may stand. Unification of patterns with shapes happens once, on the driver, with columns as opaque constants:
a column against a symbol becomes a filter, two columns become a join key, a column against a compound can't match. No
row-wise unification is left, and Catalyst sees plain filters, joins and projections.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import literal, text_of
from ..terms import Term, Var, apply, canon, deref, occurs, scoped, variables, walk


@dataclass(frozen=True)
class Leaf:
    """A column that holds a symbol; ``source`` tells the conjuncts of a query apart."""

    name: str
    source: int = -1

    @property
    def column(self) -> str:
        return self.name if self.source < 0 else f"s{self.source}_{self.name}"


@dataclass
class Relation:
    """Atoms of one shape. ``shown`` names columns of doubles that are written by ``display``."""

    shape: Term
    df: DataFrame
    shown: dict[str, str] = field(default_factory=dict)

    @property
    def signature(self) -> tuple:
        return signature(self.shape)

    def kind(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType


def signature(shape: Term) -> tuple:
    """What atoms of two shapes must share to be the same: structure, head and variables."""

    def of(t: Term, head: bool) -> object:
        if isinstance(t, tuple):
            return tuple(of(x, i == 0 and head) for i, x in enumerate(t))
        return t if isinstance(t, Var) or (head and isinstance(t, bytes)) else "*"

    s = canon(shape) if not isinstance(shape, Leaf) else shape
    return ("*",) if not isinstance(s, tuple) else (tuple(of(x, i == 0) if not isinstance(x, tuple) else of(x, False) for i, x in enumerate(s)),)


def leaves(t: Term) -> list[Leaf]:
    return [x for x in walk(t) if isinstance(x, Leaf)]


def _unify(a: Term, c: Term, b: dict, conditions: list) -> bool:
    todo = [(a, c)]
    while todo:
        x, y = todo.pop()
        x, y = deref(x, b), deref(y, b)
        if x == y:
            continue
        if isinstance(x, Var) or isinstance(y, Var):
            v, t = (x, y) if isinstance(x, Var) else (y, x)
            if occurs(v, t, b):
                return False
            b[v] = t
        elif isinstance(x, Leaf) or isinstance(y, Leaf):
            if isinstance(x, tuple) or isinstance(y, tuple):
                return False
            conditions.append((x, y) if isinstance(x, Leaf) else (y, x))
        elif isinstance(x, tuple) and isinstance(y, tuple) and len(x) == len(y):
            todo.extend(zip(x, y, strict=True))
        else:
            return False
    return True


def may_match(pattern: Term, shape: Term) -> bool:
    return _unify(scoped(pattern, "p"), scoped(shape, "d"), {}, [])


@dataclass
class Source:
    """A conjunct: the pattern, or for == and != two patterns over one or two atoms."""

    kind: str
    patterns: tuple[Term, ...]


@dataclass
class Match:
    """One way to choose relations for the conjuncts: a DataFrame of columns and what variables stand for."""

    df: DataFrame
    bindings: dict
    relations: list[Relation]

    def term(self, t: Term) -> Term:
        return apply(t, self.bindings)

    def kind(self, x: Leaf) -> T.DataType:
        return self.relations[x.source].kind(x.name)

    def shown(self, x: Leaf) -> str | None:
        return self.relations[x.source].shown.get(x.name)

    def text(self, x: Term) -> Column:
        return F.lit(x.decode()) if isinstance(x, bytes) else text_of(F.col(x.column), self.kind(x), self.shown(x))


def _condition(a: Leaf, b: Term, rels: list[Relation]) -> Column:
    ka, sa = rels[a.source].kind(a.name), rels[a.source].shown.get(a.name)
    if isinstance(b, bytes):
        value = literal(b, ka) if sa is None else None
        if isinstance(ka, (T.DateType, T.TimestampType, T.BinaryType)) or sa is not None:
            return text_of(F.col(a.column), ka, sa) == b.decode()
        return F.lit(False) if value is None else F.col(a.column) == F.lit(value)
    kb, sb = rels[b.source].kind(b.name), rels[b.source].shown.get(b.name)
    if ka == kb and sa == sb:
        return F.col(a.column) == F.col(b.column)
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(ka, whole) and isinstance(kb, whole):
        return F.col(a.column) == F.col(b.column)
    return text_of(F.col(a.column), ka, sa) == text_of(F.col(b.column), kb, sb)


def matches(sources: list[Source], relations: list[Relation], outputs: list[Term], endpoints: bool = True) -> list[Match]:
    """Every choice of relations under which the sources unify, as a plan over the columns that outputs need."""
    atoms = [(i, p, s.kind, len(s.patterns)) for i, s in enumerate(sources) for p in (s.patterns if s.kind == "!=" else s.patterns[:1])]
    options = [[r for r in relations if may_match(p, r.shape)] for _, p, _, _ in atoms]
    found = []
    for chosen in itertools.product(*options):
        m = _plan(sources, atoms, list(chosen), outputs, endpoints)
        if m is not None:
            found.append(m)
    return found


def _plan(sources, atoms, rels: list[Relation], outputs: list[Term], endpoints: bool) -> Match | None:
    b: dict = {}
    conditions: list[tuple[Leaf, Term]] = []
    data, apart = [], []
    for k, r in enumerate(rels):
        shape = scoped(r.shape, ("d", k))
        data.append(_placed(shape, k))
    for k, (i, p, kind, _) in enumerate(atoms):
        if not _unify(p, data[k], b, conditions):
            return None
        if kind == "==" and not _unify(sources[i].patterns[1], data[k], b, conditions):
            return None
        if kind == "!=" and k and atoms[k - 1][0] == i:
            apart.append((k - 1, k))
    wanted = {x for t in outputs for x in leaves(apply(t, b))}
    links = [(a, c, {a.source} | ({c.source} if isinstance(c, Leaf) else set())) for a, c in conditions]
    differ = []
    for p, q in apart:
        if rels[p].signature == rels[q].signature:
            differ.append((p, q))
            wanted |= set()
    used = wanted | {x for a, c, _ in links for x in (a, c) if isinstance(x, Leaf)} | {x for pair in differ for k in pair for x in leaves(data[k])}
    frames = []
    for k, r in enumerate(rels):
        need = sorted({x.name for x in used if x.source == k})
        df = r.df.select(*[F.col(n).alias(Leaf(n, k).column) for n in need]) if need else r.df.select(F.lit(1).alias(f"s{k}_")).limit(1)
        for a, c, at in links:
            if at == {k}:
                df = df.where(_condition(a, c, rels))
        frames.append(df)
    left = list(range(len(rels)))
    pending = [(a, c, at) for a, c, at in links if len(at) > 1]
    semi = {k for k in left if len(left) > 1 and not any(x.source == k for x in wanted) and not any(k in d for d in differ)}
    order: list[int] = []
    first = min((k for k in left if k not in semi), default=0)
    left.remove(first)
    order.append(first)
    df = frames[first]
    # a conjunct that adds no column and is linked to joined ones only closes a cycle or filters: it comes before the next that widens
    while left:
        def ready(k):
            return [x for x in pending if k in x[2] and x[2] <= {*order, k}]

        linked = [k for k in left if ready(k)]
        closing = [k for k in linked if k in semi and all(x[2] <= {*order, k} for x in pending if k in x[2])]
        open_ = closing or [k for k in linked if k not in semi] or linked
        k = (open_ or left)[0]
        on = ready(k)
        whole = all(x in on for x in pending if k in x[2])
        pending = [x for x in pending if x not in on]
        on_columns = None
        for a, c, _ in on:
            e = _condition(a, c, rels)
            on_columns = e if on_columns is None else on_columns & e
        for p, q in differ:
            if k in (p, q) and {p, q} <= {*order, k}:
                same = None
                for x, y in zip(leaves(data[p]), leaves(data[q]), strict=True):
                    e = F.col(x.column).eqNullSafe(F.col(y.column))
                    same = e if same is None else same & e
                on_columns = ~same if on_columns is None else on_columns & ~same
        if on_columns is None:
            df = df.crossJoin(frames[k])
        else:
            df = df.join(frames[k], on_columns, "left_semi" if k in semi and whole else "inner")
        order.append(k)
        left.remove(k)
        if endpoints and left and len(rels) > 2:  # columns that nothing needs any more go, and with them the paths they tell apart
            alive = {x.column for x in wanted} | {x.column for a, c, _ in pending for x in (a, c) if isinstance(x, Leaf)} | {x.column for d in differ for s in d if s in left for t in d for x in leaves(data[t])}
            keep = [c for c in df.columns if c in alive]
            if len(keep) < len(df.columns) and keep:
                df = df.select(*keep).distinct()
    return Match(df, b, rels)


def _placed(shape: Term, k: int) -> Term:
    if isinstance(shape, tuple):
        return tuple(_placed(x, k) for x in shape)
    return Leaf(shape.name, k) if isinstance(shape, Leaf) else shape


def project(m: Match, template: Term) -> Relation:
    """The relation of a template's instances over a match; each instance once."""
    return relation_of(m.df, m.term(template), {x: (F.col(x.column), m.shown(x)) for x in leaves(m.term(template))})


def relation_of(df: DataFrame, tree: Term, columns: dict) -> Relation:
    """A relation whose shape keeps structure, head and variables of a tree; all else becomes columns c0, c1, …"""
    made: list[Column] = []
    shown: dict[str, str] = {}

    def place(t: Term, head: bool) -> Term:
        if isinstance(t, tuple):
            return tuple(place(x, head and i == 0 and not isinstance(x, tuple)) for i, x in enumerate(t))
        if isinstance(t, Var) or (head and isinstance(t, bytes)):
            return t
        name = f"c{len(made)}"
        c, how = (F.lit(t.decode()), None) if isinstance(t, bytes) else columns[t]
        made.append(c.alias(name))
        if how:
            shown[name] = how
        return Leaf(name)

    top = tuple(place(x, i == 0) if not isinstance(x, tuple) else place(x, False) for i, x in enumerate(tree)) if isinstance(tree, tuple) else place(tree, False)
    shape = canon(top)
    out = df.select(*made).distinct() if made else df.select(F.lit(1).alias("c")).limit(1)
    return Relation(shape, out, shown)


def union(a: Relation, b: Relation) -> Relation:
    """Both relations' atoms once; columns of different types meet as text."""
    names = [x.name for x in leaves(a.shape)]
    other = [x.name for x in leaves(b.shape)]
    shown, left, right = {}, [], []
    for i, (p, q) in enumerate(zip(names, other, strict=True)):
        n = f"c{i}"
        same = a.kind(p) == b.kind(q) and a.shown.get(p) == b.shown.get(q)
        left.append((F.col(p) if same else text_of(F.col(p), a.kind(p), a.shown.get(p))).alias(n))
        right.append((F.col(q) if same else text_of(F.col(q), b.kind(q), b.shown.get(q))).alias(n))
        if same and p in a.shown:
            shown[n] = a.shown[p]
    shape = _renamed(a.shape)
    if not names:
        return Relation(shape, a.df.unionByName(b.df, allowMissingColumns=True).limit(1), {})
    return Relation(shape, a.df.select(*left).union(b.df.select(*right)).distinct(), shown)


def minus(a: Relation, b: Relation) -> Relation:
    """a without the atoms of b."""
    names, other = [x.name for x in leaves(a.shape)], [x.name for x in leaves(b.shape)]
    if not names:
        return Relation(a.shape, a.df.join(b.df.select(F.lit(1).alias("gone")).limit(1), F.lit(True), "left_anti"), a.shown)
    right = b.df.select(*[F.col(q).alias(f"gone_{i}") for i, q in enumerate(other)])
    on = None
    for i, (p, q) in enumerate(zip(names, other, strict=True)):
        e = F.col(p) == F.col(f"gone_{i}") if a.kind(p) == b.kind(q) and a.shown.get(p) == b.shown.get(q) else text_of(F.col(p), a.kind(p), a.shown.get(p)) == text_of(F.col(f"gone_{i}"), b.kind(q), b.shown.get(q))
        on = e if on is None else on & e
    return Relation(a.shape, a.df.join(right, on, "left_anti"), a.shown)


def _renamed(shape: Term) -> Term:
    count = itertools.count()

    def place(t: Term) -> Term:
        if isinstance(t, tuple):
            return tuple(place(x) for x in t)
        return Leaf(f"c{next(count)}") if isinstance(t, Leaf) else t

    return place(shape)


def from_terms(spark: SparkSession, terms: list[Term]) -> list[Relation]:
    """Relations of the given terms, one for each shape; their symbols are strings."""
    by: dict[tuple, list[tuple]] = {}
    shapes: dict[tuple, Term] = {}
    for t in terms:
        row: list[str] = []

        def place(x: Term, head: bool, row=row) -> Term:
            if isinstance(x, tuple):
                return tuple(place(y, False) for y in x)
            if isinstance(x, Var) or (head and isinstance(x, bytes)):
                return x
            row.append(x.decode("utf-8", "surrogateescape"))
            return Leaf(f"c{len(row) - 1}")

        shape = canon(tuple(place(x, i == 0) for i, x in enumerate(t)) if isinstance(t, tuple) else place(t, False))
        shapes[signature(shape)] = shape
        by.setdefault(signature(shape), []).append(tuple(row))
    out = []
    for s, rows in by.items():
        n = len(rows[0])
        df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(n))) if n else spark.range(1).select(F.lit(1).alias("c"))
        out.append(Relation(shapes[s], df))
    return out


def free(t: Term) -> list[Var]:
    return variables(t)
