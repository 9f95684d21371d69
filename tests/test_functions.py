import math
import struct

import pytest
from pyspark.sql import functions as F

from atomweave.functions import columns, text
from atomweave.functions.scalar import OPS, Drop, debug, display, evaluate
from atomweave.storage import prepare
from atomweave.terms import Var, parse_one


def test_inventory():
    assert len(OPS) == 370


FLOATS = {61.0: ("61", "61.0"), 1e20: ("100000000000000000000", "1e20"), 1e-7: ("0.0000001", "1e-7"), -0.0: ("-0", "-0.0"), math.inf: ("inf", "inf"), -1.5: ("-1.5", "-1.5"), 123456789.25: ("123456789.25", "123456789.25"), 1e16: ("10000000000000000", "1e16"), 0.0001: ("0.0001", "0.0001"), 1.25e-5: ("0.0000125", "1.25e-5")}


def test_float_text(spark):
    for x, (plain, full) in FLOATS.items():
        assert (display(x), debug(x)) == (plain, full)
    rows = spark.createDataFrame([(x,) for x in [*FLOATS, math.nan]], "x double").select("x", text.display(F.col("x")).alias("a"), text.debugged(F.col("x")).alias("b")).collect()
    for r in rows:
        assert (r["a"], r["b"]) == (("NaN", "NaN") if math.isnan(r["x"]) else FLOATS[r["x"]])


CASES = {
    "(i8_to_string (sum_i8 (i8_from_string 127) (i8_from_string 1)))": b"-128",
    "(i64_to_string (pow_i64 (i64_from_string -3) (i64_from_string 3)))": b"-27",
    "(i32_to_string (f64_as_i32 (f64_from_string 1e30)))": b"2147483647",
    "(i32_to_string (f64_as_i32 (f64_from_string NaN)))": b"0",
    "(i8_to_string (i32_as_i8 (i32_from_string 300)))": b"44",
    "(f64_to_string (round_f64 (f64_from_string -2.5)))": b"-3.0",
    "(f64_to_string (ln_f64 (f64_from_string -1)))": b"NaN",
    "(f64_to_string (div_f64 (f64_from_string 1) (f64_from_string 0)))": b"inf",
    "(f64_to_string (max_f64 (f64_from_string NaN) (f64_from_string 2)))": b"2.0",
    "(i128_to_string (product_i128 (i128_from_string 9223372036854775807) (i128_from_string 4)))": b"36893488147419103228",
    "(encode_hex (u32_shl (decode_hex 00000001) (decode_hex 00000004)))": b"00000010",
    "(encode_hex (u8_ternarylogic (decode_hex f0) (decode_hex cc) (decode_hex aa) (decode_hex 96)))": b"96",
    "(encode_hex (u16_swap_bytes (decode_hex 1234)))": b"3412",
    "(encode_hex (u8_reverse_bits (decode_hex 01)))": b"80",
    "(encode_hex (u32_leading_zeros (decode_hex 00ff0000)))": b"00000008",
    "(collapse_symbol (explode_symbol abc))": b"abc",
    "(decode_base64url (encode_base64url hello))": b"hello",
    "(ifnz (gt_i64 (i64_from_string 3) (i64_from_string 2)) then yes else no)": b"yes",
    "(tuple (' (a b)) c)": ((b"a", b"b"), b"c"),
}


@pytest.mark.parametrize("formula", CASES)
def test_value(formula):
    assert evaluate(parse_one(formula)) == CASES[formula]


@pytest.mark.parametrize("formula", ["(div_i8 (i8_from_string -128) (i8_from_string -1))", "(mod_i64 (i64_from_string 1) (i64_from_string 0))", "(i8_from_string 128)", "(i64_from_string 1_0)", "(i64_from_string 0x1)", "(u8_shl (decode_hex 01) (decode_hex 00000008))", "(no_such 1)", "(neg_i8 (i16_from_string 1))", "(clamp_i8 (i8_from_string 1) (i8_from_string 3) (i8_from_string 2))", "(ifnz (decode_hex 00) then a)", "(sub_i8 (i8_from_string 1))"])
def test_dropped(formula):
    with pytest.raises(Drop):
        evaluate(parse_one(formula))


VALUES = ["0", "1", "-1", "7", "-7", "127", "-128", "255", "2147483647", "-2147483648", "9223372036854775807", "1.5", "-2.5", "1e300", "NaN", "inf", "x", " 7", "-0.0", "0.3"]
INT2 = ["sub", "div", "mod", "sum", "product", "max", "min", "lt", "gte", "eq", "ne"]
FLOAT1 = ["sqrt", "ln", "log2", "log10", "abs", "neg", "floor", "ceil", "trunc", "round", "fract", "recip", "signum", "exp2", "atan", "cbrt"]
FLOAT2 = ["sub", "div", "max", "min", "sum", "product", "lt", "ne", "eq", "copysign"]


def test_columns_agree_with_scalars(spark):
    """Every native form gives what the scalar function gives, and null exactly where that is dropped."""
    prepare(spark)
    x, y = Var("x"), Var("y")

    def formula(op, t, n, out):
        args = [(f"{t}_from_string".encode(), v) for v in (x, y)[:n]]
        return (f"{out}_to_string".encode(), (f"{op}_{t}".encode(), *args))

    forms = [formula(op, t, 2, "i8" if op in ("lt", "gte", "eq", "ne") else t) for op in INT2 for t in ("i8", "i32", "i64")]
    forms += [formula(op, "f64", 1, "f64") for op in FLOAT1] + [formula(op, "f64", 2, "i8" if op in ("lt", "ne", "eq") else "f64") for op in FLOAT2]
    df = spark.createDataFrame([(a, b) for a in VALUES for b in VALUES], "x string, y string").repartition(4).cache()
    for at in range(0, len(forms), 12):
        part = forms[at : at + 12]
        built = [columns.build(f, lambda v: F.col(v.name)) for f in part]
        assert all(b is not None and b[1] == "text" for b in built)
        for row in df.select("x", "y", *[b[0].alias(f"v{i}") for i, b in enumerate(built)]).collect():
            for i, f in enumerate(part):
                try:
                    want = evaluate(_filled(f, {x: row["x"].encode(), y: row["y"].encode()})).decode()
                except Drop:
                    want = None
                got = row[f"v{i}"]
                if got != want:
                    assert got is not None and want is not None and math.isclose(float(got), float(want), rel_tol=1e-14), (f, row["x"], row["y"], got, want)


def _filled(t, at):
    return tuple(_filled(x, at) for x in t) if isinstance(t, tuple) else at.get(t, t) if isinstance(t, Var) else t


def test_single_precision_is_rounded():
    got = evaluate(parse_one("(sum_f32 (f32_from_string 0.1) (f32_from_string 0.2))"))
    assert struct.unpack(">f", got)[0] == pytest.approx(0.3, abs=1e-7) and len(got) == 4
