"""A space: a set of facts and rules, small parts in memory and large ones in DataFrames.

Every shape of atoms lives in one place. What comes from text stays in memory; tables come as DataFrames. A rule whose
patterns can only meet atoms in memory runs there, without a Spark job; as soon as a large relation can match, the rule
becomes one DataFrame plan over a snapshot and the small shapes it touches become relations as well. Rules themselves
are always in memory: the smallest by the order key runs next and is removed before it runs.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import sinks
from .operators.local import Facts, Matcher
from .operators.rules import IMMEDIATE, Rule, RuleError, finish, instantiate, is_exec, pure, rule_of, sink_kind
from .plans.compiler import Leaf, Match, Relation, Source, from_terms, leaves, matches, may_match, minus, project, relation_of, signature, union
from .storage import prepare, settled, shared_dir
from .terms import Term, TermError, Var, canon, key, match, parse, parse_one, render, sym, transform, unify, variables, walk

log = logging.getLogger(__name__)


@dataclass
class Space:
    """Facts and rules. Without a session only facts in memory are possible."""

    spark: SparkSession | None = None
    facts: Facts = field(default_factory=Facts)
    relations: dict[tuple, Relation] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    snapshots: dict[str, list[Term]] = field(default_factory=dict)
    regions: dict[str, Space] = field(default_factory=dict)
    timing: bool = False
    endpoints: bool = True
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        if self.spark is not None:
            prepare(self.spark)

    # ------------------------------------------------------------------------------------------ loading

    def add(self, text: str) -> int:
        """Adds all atoms of a text; the number of them."""
        terms = parse(text)
        self._put(terms)
        return len(terms)

    def remove(self, text: str) -> int:
        """Removes exactly the atoms of a text; the number of them."""
        terms = parse(text)
        self._take(terms)
        return len(terms)

    def add_as(self, text: str, pattern: str, template: str) -> int:
        """Adds template instances for the ground atoms of a text that the pattern matches."""
        got = self._transformed(parse(text), pattern, template)
        self._put(got)
        return len(got)

    def remove_as(self, text: str, pattern: str, template: str) -> int:
        got = self._transformed(parse(text), pattern, template)
        self._take(got)
        return len(got)

    @staticmethod
    def _transformed(terms: Iterable[Term], pattern: str, template: str) -> list[Term]:
        both = parse_one(f"({pattern} {template})")
        return [x for x in (transform(t, both[0], both[1]) for t in terms) if x is not None]

    def add_table(self, df: DataFrame, head: str, columns: list[str] | None = None, nest: str | None = None) -> None:
        """Rows as atoms ``(head c1 c2 …)``, columns keeping their types; rows with a null are left out, repeats are one atom.

        ``nest`` is a pattern over the column names instead, such as ``(ord (key $o_orderkey) $o_custkey)``.
        """
        if nest is not None:
            names: dict[Var, str] = {}
            tree = parse_named(nest, names)
        else:
            cols = columns or df.columns
            tree = (sym(head), *[Leaf(c) for c in cols])
        used = [x.name for x in leaves(tree)]
        rows = df.select(*dict.fromkeys(used)).dropna()
        self._merge(relation_of(rows, tree, {x: (F.col(x.name), None) for x in leaves(tree)}))

    def add_relation(self, r: Relation) -> None:
        self._merge(r)

    def _merge(self, r: Relation) -> None:
        if isinstance(r.shape, tuple) and r.shape and r.shape[0] == b"exec":
            self._put([sinks.term_of(r, row) for row in r.df.collect()])  # rules are few and live on the driver
            return
        self._promote([r.signature])
        s = r.signature
        self.relations[s] = union(self.relations[s], r) if s in self.relations else r

    def _put(self, terms: Iterable[Term]) -> None:
        large: list[Term] = []
        for t in terms:
            if self.relations and signature(t) in self.relations and not is_exec(t):
                large.append(t)
            else:
                self.facts.add(t)
        for r in from_terms(self.spark, large) if large else []:
            self.relations[r.signature] = union(self.relations[r.signature], r)

    def _take(self, terms: Iterable[Term]) -> None:
        large = [t for t in terms if not self.facts.remove(t) and signature(t) in self.relations]
        for r in from_terms(self.spark, large) if large else []:
            if r.signature in self.relations:
                self.relations[r.signature] = minus(self.relations[r.signature], r)

    def _promote(self, signatures: Iterable[tuple]) -> None:
        """Moves the shapes' atoms from memory to relations."""
        want = set(signatures)
        moved = [t for t in self.facts if not is_exec(t) and signature(t) in want]
        for t in moved:
            self.facts.remove(t)
        for r in from_terms(self.spark, moved) if moved else []:
            s = r.signature
            self.relations[s] = union(self.relations[s], r) if s in self.relations else r

    # ------------------------------------------------------------------------------------------ running

    def run(self, steps: int = 10**9) -> int:
        """Runs rules, smallest first, until none is left or the budget is spent; up to steps + 1 run, and steps is the most that counts."""
        done = 0
        while True:
            rule = self._next()
            if rule is None:
                return done
            began = time.monotonic_ns()
            self.facts.remove(rule)
            try:
                self._fire(rule_of(rule))
            except (RuleError, TermError) as e:
                log.info("dropped %s: %s", render(rule), e)
                done += 1
                continue
            if self.timing:
                self.facts.add((b"timing", rule, sym(done), sym(time.monotonic_ns() - began)))
            if done >= steps:
                return done
            done += 1

    def run_at(self, place: str, steps: int = 10**9) -> int:
        """Runs only rules ``(exec (place x) p t)``; a malformed one ends the run."""
        at, done = parse_one(place), 0
        while True:
            rule = self._next(lambda t: len(t) == 4 and isinstance(t[1], tuple) and len(t[1]) == 2 and unify(t[1][0], at) is not None)
            if rule is None:
                return done
            self.facts.remove(rule)
            self._fire(rule_of(rule, scoped_run=True))
            if done >= steps:
                return done
            done += 1

    def region(self, name: str) -> Space:
        """The named part of this space: a space of its own with the same session and functions."""
        if name not in self.regions:
            self.regions[name] = Space(self.spark, functions=self.functions, snapshots=self.snapshots)
        return self.regions[name]

    def run_in(self, name: str, steps: int = 10**9) -> int:
        """Runs the rules of a region; sources cannot be named there, and a malformed rule ends the run."""
        part, done = self.region(name), 0
        while (rule := part._next()) is not None:
            part.facts.remove(rule)
            part._fire(rule_of(rule, scoped_run=True))
            if done >= steps:
                return done
            done += 1
        return done

    def transform(self, patterns: str | list[str], template: str) -> None:
        """Adds the template for every match of the patterns; no rule is stored."""
        text = " ".join([patterns] if isinstance(patterns, str) else patterns)
        self._fire(rule_of(parse_one(f"(exec transform (, {text}) (, {template}))")))

    def export(self, pattern: str, template: str, path: str) -> None:
        """Writes the template's instances as Parquet with their order key, for any size."""
        part = Space(self.spark)
        for r in self.query(pattern, template):
            part._merge(r)
        part.lines().write.mode("overwrite").parquet(path)

    def _next(self, allowed: Callable[[Term], bool] | None = None) -> Term | None:
        """The rule with the least key, of all or of those allowed."""
        if allowed is None:
            return self.facts.least_rule()
        rules = ((k, t) for (_, head), ts in self.facts.index.items() if head == b"exec" for k, t in ts.items() if allowed(t))
        return min(rules, default=(None, None))[1]

    def _fire(self, rule: Rule) -> None:
        patterns = [p for s in rule.sources for p in stored_patterns(s, rule.typed_sources, self.functions)]
        if any(may_match(p, r.shape) for p in patterns for r in self.relations.values()) or self._reads_relations(rule):
            self._fire_large(rule)
        else:
            self._fire_small(rule)

    def _reads_relations(self, rule: Rule) -> bool:
        """A snapshot that was written from relations is read as relations."""
        named = [s[1].decode() for s in rule.sources if rule.typed_sources and isinstance(s, tuple) and len(s) == 3 and s[0] == b"ACT" and isinstance(s[1], bytes)]
        return self.spark is not None and any(n not in self.snapshots for n in named)

    def _sinks(self, rule: Rule) -> list[tuple[str, tuple]]:
        return [sink_kind(t) if rule.typed_sinks else ("add", (t,)) for t in rule.sinks]

    def _fire_small(self, rule: Rule) -> None:
        kinds = self._sinks(rule)
        rows: list[set] = [set() for _ in kinds]
        # the rule sees itself where it asks for rules; nothing is written before all matches are in
        back = any(may_match(p, rule.atom) for s in rule.sources for p in stored_patterns(s, rule.typed_sources, self.functions)) and self.facts.add(rule.atom)
        try:
            for b in Matcher(self.facts, self._snapshot, self.functions).run(list(rule.sources), rule.typed_sources):
                for (_, args), seen in zip(kinds, rows, strict=True):
                    seen.add(instantiate(args, b))
        finally:
            if back:
                self.facts.remove(rule.atom)
        added: list[Term] = []
        for (kind, args), seen in zip(kinds, rows, strict=True):
            if kind == "add":
                added += [canon(r[0]) for r in seen]
            elif kind == "pure":
                added += [x for x in (pure(*r) for r in seen) if x is not None]
        self._put(added)
        for (kind, args), seen in zip(kinds, rows, strict=True):
            if kind in IMMEDIATE or not seen:
                continue
            if kind == "act":
                self._save_terms(args[0], [canon(r[1]) for r in seen])
                continue
            new, gone = finish(kind, seen)
            self._take(gone)
            self._put(new)

    def _fire_large(self, rule: Rule) -> None:
        kinds = self._sinks(rule)
        found = self._matches(list(rule.sources), rule.typed_sources, [a for _, args in kinds for a in args], rule.atom)
        later = []
        added: list[Relation] = []
        for kind, args in kinds:
            if kind == "add":
                added += [project(m, args[0]) for m in found]
            elif kind == "pure":
                added += [r for m in found if (r := sinks.computed(m, *args)) is not None]
            else:
                later.append((kind, args))
        prepared = []
        for kind, args in later:
            if kind in ("head", "tail"):
                prepared.append((kind, args, sinks.top(sinks.united([project(m, args[1]) for m in found]), sinks.top_n(args[0]), kind == "tail")))
            elif kind == "remove":
                prepared.append((kind, args, [project(m, args[0]) for m in found]))
            elif kind == "act":
                prepared.append((kind, args, sinks.united([project(m, args[1]) for m in found])))
            elif kind in ("unify", "generalise"):
                prepared.append((kind, args, sinks.united([project(m, args[0]) for m in found])))
            else:
                prepared.append((kind, args, sinks.reduction(kind, found, args)))
        for r in added:
            self._merge(r)
        for kind, args, rels in prepared:
            if kind == "remove":
                for r in rels:
                    self._promote([r.signature])
                    if r.signature in self.relations:
                        self.relations[r.signature] = minus(self.relations[r.signature], r)
            elif kind == "act":
                self._save(args[0].decode(), rels)
            elif kind in ("unify", "generalise"):
                t = sinks.unified(rels) if kind == "unify" else sinks.generalised(rels)
                if t is not None:
                    self._put([t])
            else:
                for r in rels:
                    self._merge(r)

    def _matches(self, sources: list[Term], typed: bool, outputs: list[Term], atom: Term | None = None) -> list[Match]:
        plain: list[Source] = []
        calls: list[Term] = []
        extra: list[Relation] = []
        for s in sources:
            head = s[0] if typed and isinstance(s, tuple) and s and isinstance(s[0], bytes) else None
            if head is not None and head.decode("utf-8", "replace") in self.functions:
                calls.append(s)
            elif head == b"BTM" and len(s) == 2:
                plain.append(Source("plain", (s[1],)))
            elif head in (b"==", b"!=") and len(s) == 3:
                plain.append(Source(head.decode(), (s[1], s[2])))
            elif head == b"ACT" and len(s) == 3:
                tag = f"\x00{s[1].decode()}".encode()
                plain.append(Source("plain", ((tag, s[2]),)))
                extra += [Relation((tag, r.shape), r.df, r.shown) for r in self._load(s[1].decode())]
            else:
                plain.append(Source("plain", (s,)))
        if not plain:
            plain = [Source("plain", ((b"\x00one",),))]
            extra.append(Relation((b"\x00one",), self.spark.range(1).select(F.lit(1).alias("c"))))
        patterns = [p for s in plain for p in s.patterns]
        small = [t for t in self.facts if any(may_match(p, t) for p in patterns)]
        if atom is not None and any(may_match(p, atom) for p in patterns):
            small.append(atom)
        self._promote({signature(t) for t in small if not is_exec(t)})
        rules = from_terms(self.spark, [t for t in small if is_exec(t)]) if any(is_exec(t) for t in small) else []
        found = matches(plain, [*self.relations.values(), *rules, *extra], [*outputs, *calls], self.endpoints)
        for c in calls:
            found = [self._called(m, c) for m in found]
        return found

    def _called(self, m: Match, call: Term) -> Match:
        f, args = self.functions[call[0].decode()], [m.term(a) for a in call[1:]]
        inputs = list(dict.fromkeys(leaves(tuple(args))))

        @F.pandas_udf("boolean")
        def holds(*series: pd.Series) -> pd.Series:
            out = []
            for row in zip(*series, strict=True):
                at = dict(zip(inputs, row, strict=True))
                try:
                    got = f([at[a] if isinstance(a, Leaf) else a.decode() if isinstance(a, bytes) else render(a) for a in args])
                except Exception:
                    got = None
                out.append(got is not None and (isinstance(got, str) or len(got) > 0))
            return pd.Series(out)

        return Match(m.df.where(holds(*[m.text(x) for x in inputs])), m.bindings, m.relations)

    # ------------------------------------------------------------------------------------------ reading

    def query(self, patterns: str | list[str], template: str) -> list[Relation]:
        """Relations of the template's instances, one for each shape, over all matches of the patterns."""
        text = " ".join([patterns] if isinstance(patterns, str) else patterns)
        both = parse_one(f"((, {text}) {template})")
        both = _variables_named(both)
        found = self._matches(list(both[0][1:]), False, [both[1]])
        return sinks.united([project(m, both[1]) for m in found])

    def select(self, patterns: str | list[str], typed: bool = False, **names: str) -> DataFrame:
        """A DataFrame of distinct rows: column name = variable such as ``"$x"``; columns keep their types.

        ``typed`` reads the patterns as sources, so that BTM, ACT, ==, != and registered functions are understood.
        """
        text = " ".join([patterns] if isinstance(patterns, str) else patterns)
        both = _variables_named(parse_one(f"((, {text}) ({' '.join(names.values())}))"))
        found = self._matches(list(both[0][1:]), typed, list(both[1]))
        out = None
        for m in found:
            cols = []
            for n, v in zip(names, both[1], strict=True):
                t = m.term(v)
                if not isinstance(t, (Leaf, bytes)):
                    raise ValueError(f"{n} is not a symbol in every match")
                cols.append((F.col(t.column) if isinstance(t, Leaf) else F.lit(t.decode())).alias(n))
            df = m.df.select(*cols)
            out = df if out is None else out.union(df)
        if out is None:
            return self.spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
        return out.distinct()

    def table(self, head: str, arity: int, names: list[str] | None = None) -> DataFrame:
        """Flat atoms ``(head a1 … an)`` as columns, with their types."""
        s = (tuple([sym(head)] + ["*"] * arity),)
        self._promote([s])
        r = self.relations.get(s)
        if r is None:
            return self.spark.createDataFrame([], ", ".join(f"{n} string" for n in names or [f"c{i}" for i in range(arity)]))
        cols = [x.name for x in leaves(r.shape)]
        return r.df.select(*[F.col(c).alias(n) for c, n in zip(cols, names or cols, strict=True)])

    def count(self, pattern: str = "$x") -> int:
        """Atoms that unify with a pattern."""
        p = parse_one(pattern)
        small = sum(unify(p, _apart(t)) is not None for t in self.facts)
        if pattern == "$x":
            return len(self.facts) + sum(r.df.count() for r in self.relations.values())
        if not any(may_match(p, r.shape) for r in self.relations.values()):
            return small
        return sum(r.df.count() for r in self.query(pattern, pattern))

    def statistics(self) -> dict[str, int]:
        return {"atoms": self.count(), "in_memory": len(self.facts), "relations": len(self.relations)}

    def dump(self) -> list[str]:
        """Text of all atoms in key order; for spaces that fit the driver."""
        terms = [*self.facts, *[sinks.term_of(r, row) for r in self.relations.values() for row in r.df.toLocalIterator()]]
        return [render(t) for t in sorted(terms, key=key)]

    def dump_as(self, pattern: str, template: str) -> list[str]:
        """One line a match, repeats included."""
        both = _variables_named(parse_one(f"({pattern} {template})"))
        if not self.relations:
            return sorted(render(instantiate(both[1], b)) for b in Matcher(self.facts).run([both[0]], False))
        out = []
        for m in self._matches([both[0]], False, [both[1], both[0]]):
            r = Relation(m.term(both[1]), m.df, {})
            out += [render(sinks.term_of(Relation(_plain(r.shape), m.df, {x.column: m.shown(x) for x in leaves(r.shape) if m.shown(x)}), row)) for row in m.df.collect()]
        return sorted(out)

    def lines(self) -> DataFrame:
        """All atoms as (key, atom), ordered; the large-scale form of ``dump``, for atoms without variables."""
        from .functions.text import text_of

        parts = []
        self._promote({signature(t) for t in self.facts if not is_exec(t)})
        for r in self.relations.values():

            def show(t: Term, r=r):
                if isinstance(t, tuple):
                    inner = [x for i, y in enumerate(t) for x in ([F.lit(" ")] if i else []) + [show(y)]]
                    return F.concat(F.lit("("), *inner, F.lit(")"))
                return F.lit(t.decode()) if isinstance(t, bytes) else F.lit(render(t)) if isinstance(t, Var) else text_of(F.col(t.name), r.kind(t.name), r.shown.get(t.name))

            parts.append(r.df.select(sinks.order_key(r).alias("key"), show(r.shape).alias("atom")))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.orderBy("key")

    def browse(self, pattern: str, limit: int | None = None) -> list[tuple[bytes, str, int]]:
        """Per next symbol below a pattern's ground prefix: (prefix, a representative, atoms), in order; all of them, or the first ``limit``.

        Relations are counted where they are; the driver gets one row a child.
        """
        p = parse_one(pattern)
        from .terms import ground_prefix

        lead = ground_prefix(p)
        groups: dict[bytes, tuple[bytes, str, int]] = {}

        def note(child: bytes, k: bytes, atom: str, n: int) -> None:
            old = groups.get(child)
            groups[child] = (k, atom, n) if old is None else (*min(old[:2], (k, atom)), old[2] + n)

        if any(may_match(p, r.shape) for r in self.relations.values()):
            # facts in memory that meet the pattern become relations here, so none counts twice
            below = Space(self.spark, relations={r.signature: r for r in self.query(pattern, pattern)})
            rows = below.lines().where(F.col("key").startswith(F.lit(lead)) & (F.octet_length("key") > len(lead)))
            first = F.conv(F.hex(F.substring(F.col("key"), len(lead) + 1, 1)), 16, 10).cast("int")
            size = len(lead) + 1 + F.when(first > 0xC0, first.bitwiseAND(63)).otherwise(0)
            child = F.substring(F.col("key"), F.lit(1), size)
            for r in rows.groupBy(child.alias("child")).agg(F.min(F.struct("key", "atom")).alias("first"), F.count("*").alias("n")).collect():
                note(bytes(r["child"]), bytes(r["first"]["key"]), r["first"]["atom"], r["n"])
        for t in self.facts:
            k = key(t)
            if k.startswith(lead) and len(k) > len(lead) and unify(p, _apart(t)) is not None:
                n = 1 + (k[len(lead)] & 63 if k[len(lead)] > 0xC0 else 0)
                note(k[: len(lead) + n], k, render(t), 1)
        return [(child, atom, n) for child, (_, atom, n) in sorted(groups.items())[:limit]]

    # ------------------------------------------------------------------------------------------ whole spaces

    def clear(self, pattern: str) -> None:
        """Removes the atoms that unify with a pattern."""
        p = parse_one(pattern)
        self._take([t for t in list(self.facts) if unify(p, _apart(t)) is not None])
        for s, r in list(self.relations.items()):
            if may_match(p, r.shape):
                for gone in self.query(pattern, pattern):
                    if gone.signature == s:
                        self.relations[s] = minus(r, gone)

    def copy(self, pattern: str, template: str) -> None:
        """Adds the template for each atom that the pattern matches."""
        if self.relations:
            for r in self.query(pattern, template):
                self._merge(r)
        else:
            both = _variables_named(parse_one(f"({pattern} {template})"))
            self._put([instantiate(both[1], b) for b in Matcher(Facts(self.facts)).run([both[0]], False)])

    def settle(self) -> None:
        """Writes all relations to the shared folder, which cuts their lineage."""
        for s, r in self.relations.items():
            self.relations[s] = Relation(r.shape, settled(r.df), r.shown)

    def backup(self, path: str) -> None:
        """All atoms as Parquet below a path, one folder a shape."""
        save_relations(path, [*self.relations.values(), *(from_terms(self.spark, list(self.facts)) if len(self.facts) else [])])

    def restore(self, path: str) -> None:
        """Adds the atoms of a backup."""
        for r in load_relations(self.spark, path):
            if isinstance(r.shape, tuple) and r.shape and r.shape[0] == b"exec":
                self._put([sinks.term_of(r, row) for row in r.df.collect()])
            else:
                self._merge(r)

    # ------------------------------------------------------------------------------------------ snapshots

    def _save_terms(self, name: Term, terms: list[Term]) -> None:
        if terms and isinstance(name, bytes):
            self.snapshots[name.decode()] = sorted(set(terms), key=key)
            if self.spark is not None:
                save_relations(self._snapshot_path(name.decode()), from_terms(self.spark, terms))

    def _save(self, name: str, relations: list[Relation]) -> None:
        if relations and any(not r.df.isEmpty() for r in relations):
            self.snapshots.pop(name, None)
            save_relations(self._snapshot_path(name), relations)

    def _snapshot_path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/atomweave/snapshots/{self.name}/{name}"

    def _snapshot(self, name: str) -> list[Term]:
        if name in self.snapshots:
            return self.snapshots[name]
        if self.spark is None:
            return []
        return [sinks.term_of(r, row) for r in self._load(name) for row in r.df.toLocalIterator()]

    def _load(self, name: str) -> list[Relation]:
        return load_relations(self.spark, self._snapshot_path(name))


def save_relations(path: str, relations: list[Relation]) -> None:
    """Each relation as Parquet below a path, and an index of shapes."""
    if not relations:
        return
    spark = relations[0].df.sparkSession
    index = []
    for i, r in enumerate(relations):
        r.df.write.mode("overwrite").parquet(f"{path}/part={i}")
        index.append((i, _shape_text(r.shape), ",".join(f"{k}={v}" for k, v in r.shown.items())))
    spark.createDataFrame(index, "part int, shape string, shown string").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def load_relations(spark: SparkSession, path: str) -> list[Relation]:
    out = []
    for row in spark.read.parquet(f"{path}/index").orderBy("part").collect():
        shown = dict(x.split("=") for x in row["shown"].split(",") if x)
        out.append(Relation(_shape_read(row["shape"]), spark.read.parquet(f"{path}/part={row['part']}"), shown))
    return out


def _shape_text(shape: Term) -> str:
    import json

    def of(t: Term):
        if isinstance(t, tuple):
            return [of(x) for x in t]
        return {"leaf": t.name} if isinstance(t, Leaf) else {"var": t.name} if isinstance(t, Var) else t.decode("latin-1")

    return json.dumps(of(shape))


def _shape_read(text: str) -> Term:
    import json

    def of(x):
        if isinstance(x, list):
            return tuple(of(y) for y in x)
        if isinstance(x, dict):
            return Leaf(x["leaf"]) if "leaf" in x else Var(x["var"])
        return x.encode("latin-1")

    return of(json.loads(text))


def stored_patterns(s: Term, typed: bool, functions: dict) -> list[Term]:
    """The patterns of a source that stored atoms answer."""
    if typed and isinstance(s, tuple) and s and isinstance(s[0], bytes):
        head = s[0]
        if head.decode("utf-8", "replace") in functions or (head == b"ACT" and len(s) == 3):
            return []
        if head == b"BTM" and len(s) == 2:
            return [s[1]]
        if head in (b"==", b"!=") and len(s) == 3:
            return [s[1], s[2]]
    return [s]


def parse_named(text: str, names: dict) -> Term:
    """A pattern whose variables are column names, as a tree of columns."""
    import re

    order = list(dict.fromkeys(re.findall(r"\$(\w+)", text)))
    t = parse_one(text)
    at = dict(zip(variables(t), order, strict=True))

    def place(x: Term) -> Term:
        if isinstance(x, tuple):
            return tuple(place(y) for y in x)
        return Leaf(at[x]) if isinstance(x, Var) else x

    return place(t)


def _variables_named(t: Term) -> Term:
    return canon(t)


def _apart(t: Term) -> Term:
    from .terms import scoped

    return scoped(t, "data")


def _plain(t: Term) -> Term:
    if isinstance(t, tuple):
        return tuple(_plain(x) for x in t)
    return Leaf(t.column) if isinstance(t, Leaf) else t


__all__ = ["Space", "load_relations", "match", "save_relations", "walk"]
