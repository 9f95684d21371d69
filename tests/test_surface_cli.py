import pytest

from atomweave import cli
from atomweave.sources import surface
from atomweave.space import Space
from atomweave.terms import TermError, fold, parse_one, render, shift


def test_tokens():
    t = surface.Tokens()
    t.register(r"[0-9]+", int)
    t.register(r"0[0-9]*", lambda w: ("octal", w))
    assert t.values('(a 12 007 $x "q\\n\\x41\\u{e9}") ; end') == [(b"a", 12, ("octal", "007"), surface.Var("x"), "q\nAé")]
    n = t.tree("(a (b))")[0]
    assert (n.start, n.end, n.content[1].kind) == (0, 7, "list")
    for bad in ("(a", ")", '"x'):
        with pytest.raises(TermError):
            t.tree(bad)


def test_typed_round_trip():
    for text in ('(a 1.5 "x\\"y" $v (b -2e10))', "7"):
        x = surface.typed(text)
        assert surface.typed(surface.typed_text(x[0])) == x
    assert render(surface.as_term(surface.typed("(a 2 $x)")[0])) == "(a 2.0 $a)"


def test_fold_and_shift():
    assert fold(parse_one("(a (b c) $x)"), lambda _: 1, sum) == 4
    assert render(shift(parse_one("(a $x $y)"), 3)) == "(a $a $b)"


def test_command_line(tmp_path, capsys):
    (tmp_path / "p.sexp").write_text("(a 1) (exec 0 (, (a $x)) (, (b $x)))")
    (tmp_path / "q.sexp").write_text("(a 2)")
    assert cli.main(["run", str(tmp_path / "p.sexp"), "--aux", str(tmp_path / "q.sexp"), "--out", str(tmp_path / "o.sexp"), "--timing"]) == 0
    assert {"(b 1)", "(b 2)"} <= set((tmp_path / "o.sexp").read_text().split("\n"))
    assert cli.main(["convert", str(tmp_path / "p.sexp"), str(tmp_path / "c.sexp"), "--pattern", "(a $x)", "--template", "(c $x)"]) == 0
    assert (tmp_path / "c.sexp").read_text() == "(c 1)\n"
    with pytest.raises(SystemExit):
        cli.main(["convert", "a.json", "b.sexp"])


def test_regions_and_transform(spark, tmp_path):
    s = Space(spark)
    s.region("r").add("(n 1) (exec 0 (, (n $x)) (, (m $x)))")
    assert s.run_in("r") == 1 and s.region("r").dump() == ["(m 1)", "(n 1)"] and s.dump() == []
    s.add("(n 2)")
    s.transform("(n $x)", "(k $x)")
    assert s.dump() == ["(k 2)", "(n 2)"]
    s.export("(k $x)", "(out $x)", str(tmp_path / "x"))
    assert [r["atom"] for r in spark.read.parquet(str(tmp_path / "x")).collect()] == ["(out 2)"]
