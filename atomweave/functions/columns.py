"""Scalar functions as Columns, for formulas whose types Spark holds: i8 to i64, u8 to u32, f32 and f64.

``build`` gives None for what has no native form (128 bits, u64, raw bytes as symbols); the caller then falls back to an
Arrow-batched function. A null Column means that the row is dropped. ANSI mode has to be off: integers wrap, casts narrow
modularly and saturate from floats.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..terms import Term
from .text import debugged

INTS = {"i8": "byte", "i16": "short", "i32": "int", "i64": "long"}
WIDE = {"u8": 8, "u16": 16, "u32": 32}
FLOATS = {"f32": "float", "f64": "double"}
LOW = {"i8": -(2**7), "i16": -(2**15), "i32": -(2**31), "i64": -(2**63)}
_MONOTONE = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp}
_COMPARE = {"lt": lambda x, y: x < y, "gt": lambda x, y: x > y, "lte": lambda x, y: x <= y, "gte": lambda x, y: x >= y, "eq": lambda x, y: x == y, "ne": lambda x, y: x != y}
_CONSTANT = {"inf": math.inf, "neginf": -math.inf, "e": math.e, "pi": math.pi, "tau": math.tau, "phi": (1 + math.sqrt(5)) / 2}


def _nan(c: Column) -> Column:
    return F.isnan(c)


def _log(f, x: Column) -> Column:
    return F.when(_nan(x) | (x < 0), F.lit(math.nan)).when(x == 0, F.lit(-math.inf)).otherwise(f(x))


def _divide(x: Column, y: Column) -> Column:
    zero = F.when((x == 0) | _nan(x), F.lit(math.nan)).when((x > 0) == (y.cast("string") == "0.0"), F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(y == 0, zero).otherwise(x / y)


def _trunc(x: Column) -> Column:
    big = F.abs(x) >= 2.0**52
    return F.when(_nan(x) | big, x).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))


def _round(x: Column) -> Column:
    t = _trunc(x)
    return F.when(F.abs(x - t) >= 0.5, t + F.signum(x)).otherwise(t)


def _whole(f, x: Column) -> Column:
    return F.when(_nan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))


def _negative(x: Column) -> Column:
    return (x < 0) | (x.cast("string") == "-0.0")


def _least(a: Column, b: Column) -> Column:
    return F.when(_nan(a), b).when(_nan(b), a).otherwise(F.least(a, b))


def _greatest(a: Column, b: Column) -> Column:
    return F.when(_nan(a), b).when(_nan(b), a).otherwise(F.greatest(a, b))


def _int_op(op: str, t: str, a: list[Column]) -> Column | None:
    kind = INTS[t]
    x = a[0] if a else None
    wrap = lambda c: c.cast(kind)
    if op == "one":
        return F.lit(1).cast(kind)
    if op == "neg":
        return wrap(-x)
    if op == "abs":
        return wrap(F.when(x < 0, -x).otherwise(x))
    if op == "signum":
        return F.signum(x).cast(kind)
    if op == "sub":
        return wrap(x - a[1])
    if op in ("div", "mod"):
        y = a[1]
        ok = (y != 0) & ~((x == F.lit(LOW[t]).cast(kind)) & (y == -1)) if op == "div" else y != 0
        q = F.call_function("div", x, F.nullif(y, F.lit(0).cast(kind))).cast(kind) if op == "div" else (x % F.nullif(y, F.lit(0).cast(kind))).cast(kind)
        return F.when(ok, q)
    if op == "clamp":
        return F.when(a[1] <= a[2], F.least(F.greatest(x, a[1]), a[2]))
    if op == "sum":
        return reduce(lambda p, q: wrap(p + q), a, F.lit(0).cast(kind))
    if op == "product":
        return reduce(lambda p, q: wrap(p * q), a, F.lit(1).cast(kind))
    if op == "max":
        return reduce(F.greatest, a, F.lit(LOW[t]).cast(kind))
    if op == "min":
        return reduce(F.least, a, F.lit(-LOW[t] - 1).cast(kind))
    if op in _COMPARE:
        return _COMPARE[op](x, a[1]).cast("byte")
    return None


def _float_op(op: str, t: str, a: list[Column]) -> Column | None:
    kind = FLOATS[t]
    d = [c.cast("double") for c in a]
    x = d[0] if d else None
    if op in _CONSTANT:
        out = F.lit(_CONSTANT[op])
    elif op in _MONOTONE:
        out = _MONOTONE[op](x)
    elif op in ("ln", "log2", "log10"):
        out = _log({"ln": F.ln, "log2": F.log2, "log10": F.log10}[op], x)
    elif op == "exp2":
        out = F.pow(F.lit(2.0), x)
    elif op == "neg":
        out = -x
    elif op == "abs":
        out = F.abs(x)
    elif op in ("floor", "ceil"):
        out = _whole(F.floor if op == "floor" else F.ceil, x)
    elif op == "trunc":
        out = _trunc(x)
    elif op == "round":
        out = _round(x)
    elif op == "fract":
        out = x - _trunc(x)
    elif op == "recip":
        out = _divide(F.lit(1.0), x)
    elif op == "signum":
        out = F.when(_nan(x), x).when(_negative(x), F.lit(-1.0)).otherwise(F.lit(1.0))
    elif op == "to_radians":
        out = x * F.lit(math.pi / 180)
    elif op == "to_degrees":
        out = x * F.lit(180 / math.pi)
    elif op == "copysign":
        out = F.when(_negative(d[1]), -F.abs(x)).otherwise(F.abs(x))
    elif op == "powf":
        out = F.pow(x, d[1])
    elif op == "sub":
        out = x - d[1]
    elif op == "div":
        out = _divide(x, d[1])
    elif op == "atan2":
        out = F.atan2(x, d[1])
    elif op == "hypot":
        out = F.hypot(x, d[1])
    elif op == "clamp":
        out = F.when(d[1] <= d[2], F.when(_nan(x), x).otherwise(F.least(F.greatest(x, d[1]), d[2])))
    elif op == "sum":
        out = reduce(lambda p, q: (p + q).cast(kind).cast("double"), d, F.lit(0.0))
    elif op == "product":
        out = reduce(lambda p, q: (p * q).cast(kind).cast("double"), d, F.lit(1.0))
    elif op == "max":
        out = reduce(_greatest, d, F.lit(-math.inf))
    elif op == "min":
        out = reduce(_least, d, F.lit(math.inf))
    elif op in _COMPARE:
        plain = ~_nan(x) & ~_nan(d[1])
        return (F.when(plain, _COMPARE[op](x, d[1])).otherwise(F.lit(op == "ne"))).cast("byte")
    else:
        return None
    return out.cast(kind)


def _bits(op: str, t: str, a: list[Column]) -> Column | None:
    """Unsigned values are longs below 2**bits."""
    n = WIDE[t]
    mask = F.lit(2**n - 1).cast("long")
    x = a[0] if a else None
    if op == "zeros":
        return F.lit(0).cast("long")
    if op == "ones":
        return mask
    if op == "not":
        return F.bitwise_not(x).bitwiseAND(mask)
    if op in ("nand", "andn", "nor", "xor", "xnor"):
        y = a[1]
        out = {"nand": lambda: F.bitwise_not(x.bitwiseAND(y)), "andn": lambda: x.bitwiseAND(F.bitwise_not(y)), "nor": lambda: F.bitwise_not(x.bitwiseOR(y)), "xor": lambda: x.bitwiseXOR(y), "xnor": lambda: F.bitwise_not(x.bitwiseXOR(y))}[op]()
        return out.bitwiseAND(mask)
    if op in ("shl", "shr"):
        y = a[1].cast("int")
        ok = a[1] < n
        return F.when(ok, F.call_function("shiftleft", x, y).bitwiseAND(mask) if op == "shl" else F.call_function("shiftright", x, y))
    if op == "count_ones":
        return F.bit_count(x).cast("long")
    if op == "count_zeros":
        return (F.lit(n) - F.bit_count(x)).cast("long")
    if op == "leading_zeros":
        return F.when(x == 0, F.lit(n)).otherwise(F.lit(n) - F.length(F.bin(x))).cast("long")
    if op == "leading_ones":
        return _bits("leading_zeros", t, [F.bitwise_not(x).bitwiseAND(mask)])
    if op == "reverse_bits":
        return F.conv(F.reverse(F.lpad(F.bin(x), n, "0")), 2, 10).cast("long")
    if op == "swap_bytes":
        parts = [F.call_function("shiftleft", F.call_function("shiftright", x, F.lit(8 * i)).bitwiseAND(F.lit(255).cast("long")), F.lit(n - 8 - 8 * i)) for i in range(n // 8)]
        return reduce(lambda p, q: p.bitwiseOR(q), parts)
    if op == "and":
        return reduce(lambda p, q: p.bitwiseAND(q), a, mask)
    if op == "or":
        return reduce(lambda p, q: p.bitwiseOR(q), a, F.lit(0).cast("long"))
    if op == "parity":
        return reduce(lambda p, q: p.bitwiseXOR(q), a, F.lit(0).cast("long"))
    return None


def _direct(name: str, leaf: Term, typed) -> tuple[Column, str] | None:
    """Number from text where the leaf is a number already: the way over text is left out."""
    kind = name.removesuffix("_from_string")
    if typed is None or kind == name or isinstance(leaf, (tuple, bytes)):
        return None
    got = typed(leaf)
    if got is None:
        return None
    c, dtype = got
    whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if kind in INTS and whole:
        low = LOW[kind]
        return F.when(c.between(low, -low - 1), c).cast(INTS[kind]), kind
    if kind == "f64" and (whole or isinstance(dtype, T.DoubleType)):
        return c.cast("double"), kind
    return None


def build(t: Term, column, typed=None) -> tuple[Column, str] | None:
    """(Column, type) of a formula; ``column(leaf)`` gives a leaf's text, ``typed(leaf)`` its Column and Spark type.

    Types: text, and the names of number types.
    """
    if not isinstance(t, tuple):
        return column(t), "text"
    if not t or not isinstance(t[0], bytes):
        return None
    name = t[0].decode("utf-8", "replace")
    if len(t) == 2 and (straight := _direct(name, t[1], typed)) is not None:
        return straight
    args = [build(x, column, typed) for x in t[1:]]
    if any(x is None for x in args):
        return None
    if name == "ifnz" and len(args) in (3, 5) and t[2] == b"then" and (len(args) == 3 or t[4] == b"else"):
        (c, ct), (y, yt) = args[0], args[2]
        if ct == "text" or (len(args) == 5 and args[4][1] != yt):
            return None
        other = args[4][0] if len(args) == 5 else None
        every = y.isNotNull() & c.isNotNull() & (other.isNotNull() if other is not None else F.lit(True))
        return F.when(every, F.when(c != 0, y).otherwise(other) if other is not None else F.when(c != 0, y)), yt
    cols, kinds = [a for a, _ in args], [k for _, k in args]
    head, _, tail = name.partition("_")
    lead, _, last = name.rpartition("_")
    if tail == "from_string" and kinds == ["text"] and (head in INTS or head in FLOATS):
        s = cols[0]
        if head in INTS:
            return F.when(s.rlike(r"^[+-]?[0-9]+$"), s).try_cast(INTS[head]), head
        return F.when(s.rlike(r"^(?i)[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"), s).try_cast(FLOATS[head]), head
    if tail == "to_string" and kinds == [head]:
        return (cols[0].cast("string") if head in INTS else debugged(cols[0])) if head != "f32" else None, "text"
    if "_as_" in name:
        a, _, b = name.partition("_as_")
        if kinds == [a] and b in (INTS | FLOATS):
            return cols[0].cast((INTS | FLOATS)[b]), b
        return None
    if head in WIDE:
        want = [head, "u32"] if tail in ("shl", "shr") else [head] * len(cols)
        out = _bits(tail, head, cols) if kinds == want else None
        known = reduce(lambda p, q: p & q, [c.isNotNull() for c in cols], F.lit(True))
        return None if out is None else (F.when(known, out), "u32" if "count" in tail or "leading" in tail else head)
    if head in INTS and tail == "one":
        return _int_op("one", head, []), head
    family = _int_op if last in INTS else _float_op if last in FLOATS else None
    if family is None or any(k != last for k in kinds):
        return None
    try:
        out = family(lead, last, cols)
    except IndexError:
        return None
    if out is None:
        return None
    known = reduce(lambda p, q: p & q, [c.isNotNull() for c in cols], F.lit(True))  # a dropped argument drops the row
    return F.when(known, out), "i8" if lead in _COMPARE else last
