"""Path sets: DataFrames with one BINARY column ``path``, their algebra and the register machine over them.

A path is a sequence of components; each is a length byte and that many bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def component(x: bytes | str) -> bytes:
    b = x.encode() if isinstance(x, str) else x
    return bytes([len(b)]) + b


def path(*parts: bytes | str) -> bytes:
    return b"".join(map(component, parts))


def path_of(*columns: Column) -> Column:
    """A path from text columns."""
    return F.concat(*[F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 2, "0")), c.cast("binary")) for c in columns])


def path_set(spark: SparkSession, paths: list[bytes]) -> DataFrame:
    return spark.createDataFrame([(bytearray(p),) for p in paths], "path binary")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(F.col("path").alias("other")), F.col("path") == F.col("other"), "left_semi").distinct()


def subtraction(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(F.col("path").alias("other")), F.col("path") == F.col("other"), "left_anti").distinct()


def prefixes(c: Column, most: int | None = None) -> Column:
    """All component-wise prefixes of a path, itself included; an array. ``most``: components that are looked at, if not all."""

    def step(acc, _):
        at = acc["at"]
        size = F.conv(F.hex(F.substring(c, at + 1, F.lit(1))), 16, 10).cast("int")
        end = at + 1 + size
        more = at < F.octet_length(c)
        return F.struct(F.when(more, end).otherwise(at).alias("at"), F.when(more, F.concat(acc["out"], F.array(F.substring(c, F.lit(1), end)))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<binary>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most) if most else F.greatest(F.octet_length(c), F.lit(1))), start, step, lambda acc: acc["out"])


def restriction(a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    """Paths of a that have a prefix in b: a hash join on prefixes, not a comparison of all with all."""
    each = a.select("path", F.explode(prefixes(F.col("path"), most)).alias("lead"))
    return each.join(b.select(F.col("path").alias("other")), F.col("lead") == F.col("other"), "left_semi").select("path").distinct()


def wrap(a: DataFrame, lead: bytes) -> DataFrame:
    return a.select(F.concat(F.lit(lead), F.col("path")).alias("path"))


def unwrap(a: DataFrame, lead: bytes) -> DataFrame:
    """Paths below a prefix, without it."""
    return a.where(F.substring("path", 1, len(lead)) == F.lit(lead)).select(F.substring(F.col("path"), F.lit(len(lead) + 1), F.octet_length("path")).alias("path"))


def first(c: Column) -> Column:
    """The first component, its length byte included."""
    return F.substring(c, F.lit(1), F.conv(F.hex(F.substring(c, 1, 1)), 16, 10).cast("int") + 1)


def drop_head(a: DataFrame) -> DataFrame:
    """Every path without its first component; equal rests are one."""
    c = F.col("path")
    return a.where(F.octet_length(c) > 0).select(F.substring(c, F.octet_length(first(c)) + 1, F.octet_length(c)).alias("path")).distinct()


def heads(a: DataFrame) -> DataFrame:
    return a.where(F.octet_length("path") > 0).select(first(F.col("path")).alias("path")).distinct()


class Relationship(Enum):
    """How two paths stand to each other as prefixes."""

    EQUAL = "equal"
    BOTH_EMPTY = "both empty"
    LEFT_EMPTY = "left empty"
    RIGHT_EMPTY = "right empty"
    LEFT_PREFIX = "left is a prefix"
    RIGHT_PREFIX = "right is a prefix"
    SHARED = "they share a prefix"
    DISJOINT = "they share nothing"


def compare(a: bytes, b: bytes) -> Relationship:
    if not a or not b:
        return Relationship.BOTH_EMPTY if not a and not b else Relationship.LEFT_EMPTY if not a else Relationship.RIGHT_EMPTY
    if a == b:
        return Relationship.EQUAL
    if b.startswith(a):
        return Relationship.LEFT_PREFIX
    if a.startswith(b):
        return Relationship.RIGHT_PREFIX
    return Relationship.SHARED if a[0] == b[0] else Relationship.DISJOINT


def covering(paths: list[bytes]) -> list[bytes]:
    """For each path the shortest of all that is its prefix."""
    out = []
    for p in paths:
        out.append(min((q for q in paths if p.startswith(q)), key=len))
    return out


# ---------------------------------------------------------------------------------------------- register machine


class Op(Enum):
    EMPTY = "empty"
    SINGLETON = "singleton"
    UNION = "union"
    INTERSECTION = "intersection"
    SUBTRACTION = "subtraction"
    RESTRICTION = "restriction"
    WRAP = "wrap"
    UNWRAP = "unwrap"
    DROP_HEAD = "drop_head"
    CONSTANT = "constant"
    CONCAT = "concat"
    EXTRACT_PATH = "extract_path"
    EXTRACT_SPACE = "extract_space"
    CALL = "call"
    ITERATE = "iterate"
    EXIT = "exit"


class MachineError(ValueError):
    """malformed, value_not_memoed, unknown_routine or out_of_fuel."""


@dataclass
class Machine:
    """Routines are lists of (op, target, *operands); space registers hold path sets, path registers bytes.

    A routine is called with a path; it starts with the path in register p0 and gives back space register s0. Results are
    kept by (routine, path). ``fuel`` bounds the instructions of a run.
    """

    spark: SparkSession
    routines: dict[str, list[tuple]] = field(default_factory=dict)
    spaces: dict[bytes, DataFrame] = field(default_factory=dict)
    memo: dict[tuple[str, bytes], DataFrame] = field(default_factory=dict)

    def run(self, name: str, at: bytes = b"", fuel: int = 10_000) -> DataFrame:
        out, _ = self._call(name, at, fuel)
        return out

    def _call(self, name: str, at: bytes, fuel: int) -> tuple[DataFrame, int]:
        if (name, at) in self.memo:
            return self.memo[name, at], fuel
        if name not in self.routines:
            raise MachineError("unknown_routine")
        s: dict[str, DataFrame] = {}
        p: dict[str, bytes] = {"p0": at}
        empty = path_set(self.spark, [])
        two: dict[Op, Callable] = {Op.UNION: union, Op.INTERSECTION: intersection, Op.SUBTRACTION: subtraction, Op.RESTRICTION: restriction}
        for op, target, *x in self.routines[name]:
            fuel -= 1
            if fuel < 0:
                raise MachineError("out_of_fuel")
            if op is Op.EXIT:
                break
            if op is Op.EMPTY:
                s[target] = empty
            elif op is Op.SINGLETON:
                s[target] = path_set(self.spark, [p[x[0]]])
            elif op in two:
                s[target] = two[op](s[x[0]], s[x[1]])
            elif op is Op.WRAP:
                s[target] = wrap(s[x[0]], p[x[1]])
            elif op is Op.UNWRAP:
                s[target] = unwrap(s[x[0]], p[x[1]])
                if s[target].isEmpty():
                    raise MachineError("malformed")
            elif op is Op.DROP_HEAD:
                s[target] = drop_head(s[x[0]])
            elif op is Op.CONSTANT:
                p[target] = x[0]
            elif op is Op.CONCAT:
                p[target] = p[x[0]] + p[x[1]]
            elif op is Op.EXTRACT_PATH:
                p[target] = p[x[0]][x[1] : x[2]]
            elif op is Op.EXTRACT_SPACE:
                lead = p[x[0]]
                found = [unwrap(wrap(df, k), lead) for k, df in self.spaces.items() if k.startswith(lead) or lead.startswith(k)]
                if not found:
                    raise MachineError("value_not_memoed")
                s[target] = reduce(union, found)
            elif op is Op.CALL:
                s[target], fuel = self._call(x[0], p[x[1]], fuel)
            elif op is Op.ITERATE:
                out = empty
                for row in heads(s[x[0]]).orderBy("path").collect():
                    got, fuel = self._call(x[1], bytes(row["path"]), fuel)
                    out = union(out, got)
                s[target] = out
        self.memo[name, at] = s.get("s0", empty)
        return self.memo[name, at], fuel
