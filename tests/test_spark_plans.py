"""The DataFrame executor against the one in memory: same programs, same facts."""

import random

import pytest

from atomweave.space import Space
from atomweave.terms import parse, render


def both(spark, facts: dict[str, list[tuple]], program: str) -> tuple[set, set]:
    small, large = Space(), Space(spark)
    for head, rows in facts.items():
        small.add(" ".join(f"({head} {' '.join(map(str, r))})" for r in rows))
        large.add_table(spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"c{i} string" for i in range(len(rows[0])))), head)
    for s in (small, large):
        s.add(program)
        s.run(50)
    return set(small.dump()), set(large.dump())


FACTS = {"e": [(1, 2), (2, 3), (3, 4), (2, 4), (4, 4)], "n": [(1, "a"), (2, "b"), (3, "a"), (4, "c")], "v": [(1,), (3,)]}
PROGRAMS = [
    "(exec 0 (, (e $x $y) (e $y $z)) (, (p $x $z)))",
    "(exec 0 (, (e $x $y) (e $y $z) (e $z $w)) (, (q $x $w)))",
    "(exec 0 (, (e $x $y) (n $x $l) (n $y $l)) (, (same $x $y)))",
    "(exec 0 (, (v $x) (n $x $l)) (, (l (deep $l $x))))",
    "(exec 0 (, (e $x $x)) (, (loop $x)))",
    "(exec 0 (, (e $x $y) (e $x $z) (e $y $z)) (, (triangle $x $y $z)))",
    "(exec 0 (, (e $x $y) (e $y $z) (e $z $w) (e $x $z) (e $y $w)) (, (strip $x $y $z $w)))",
    "(exec 0 (, (e 2 $y)) (, (two $y 2 $y)))",
    "(exec 0 (, (v $x) (v $y)) (, (pair $x $y)))",
    "(exec 0 (, (e $x $y)) (O (- (e $x $y)) (+ (was $y $x))))",
    "(exec 0 (, (e $x $y)) (O (count (out $x $k) $k $y) (count (all $k) $k (p $x $y)) (count (many $x) 2 $y)))",
    "(exec 0 (, (e $x $y)) (O (sum (t $x $k) $k $y) (fsum (f $k) $k $y) (fmin (i $x $k) $k $y) (fmax (a $k) $k $y) (fprod (p $k) $k $y)))",
    "(exec 0 (, (n $x $l)) (O (head 2 (h $l $x)) (tail 1 (t $x))))",
    "(exec 0 (, (n $x $l)) (O (AU (g $l k)) (U (u $l))))",
    "(exec 0 (, (v $x)) (O (U (u $x $y)) (and (b $k) $k $x)))",
    "(exec 0 (, (e $x $y)) (O (pure (s $x $y $r) $r (i64_to_string (sum_i64 (i64_from_string $x) (i64_from_string $y))))))",
    "(exec 0 (, (n $x $l)) (O (pure (h $x $r) $r (encode_hex $l))))",
    "(exec 0 (I (== (v $x) (v $y))) (, (eq $x $y)))",
    "(exec 0 (I (!= (n $x $l) (n $y $m))) (, (ne $x $y)))",
    "(exec 0 (I (BTM (v $x)) (!= (v $x) (v $y))) (, (other $x $y)))",
    "(mark $ x) (exec 0 (, (n $x $l) (mark $x $w)) (, (m $l $w)))",
    "(exec 0 (, ($h 1 $y)) (, (by $h $y)))",
    "(exec 0 (, (v $x)) (O (ACT kept (k $x)))) (exec 1 (I (ACT kept (k $x))) (, (got $x)))",
    "(exec 0 (, (v $x)) (, (exec 1 (, (e $x $y)) (, (next $y)))))",
    "(exec 0 (, (e $x $y) (e $y $z)) (, (e $x $z))) (exec 1 (, (e 1 $z)) (, (from1 $z)))",
]


@pytest.mark.parametrize("program", PROGRAMS)
def test_same_facts(spark, program):
    small, large = both(spark, FACTS, program)
    assert small == large


def test_random_conjunctions(spark):
    """Random queries over random facts, all in one space each so that few jobs run."""
    rng = random.Random(5)
    facts = {h: [(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(8)] for h in "abc"}
    program = ""
    for i in range(8):
        pats = " ".join(f"({rng.choice('abc')} {rng.choice(['$x', '$y', '$z', '2'])} {rng.choice(['$x', '$y', '$z', '1'])})" for _ in range(rng.randint(1, 3)))
        program += f"(exec {i} (, {pats}) (, (out{i} $x $y)))"
    small, large = both(spark, facts, program)
    assert small == large


def test_typed_columns_meet_symbols(spark):
    s = Space(spark)
    s.add_table(spark.createDataFrame([(1, 2.5, "a"), (2, 3.0, "b"), (None, 1.0, "c")], "k int, w double, t string"), "row")
    s.add("(w 3.0) (w 2.5) (w 2) (k 1) (exec 0 (, (row $k $w $t) (w $w)) (, (hit $t))) (exec 1 (, (row 2 3.0 $t)) (, (const $t))) (exec 2 (, (row $k $w $t) (k $k)) (, (key $t)))")
    s.run()
    assert {"(hit a)", "(hit b)", "(const b)", "(key a)"} <= set(s.dump())
    assert not any(x.startswith("(row") and "c)" in x for x in s.dump())
    assert {r["k"] for r in s.select("(row $k $w $t)", k="$k").collect()} == {1, 2}


def test_plan_prunes_and_pushes(spark, tmp_path):
    spark.range(100).selectExpr("id k", "id % 3 m", "id * 2 unused").write.parquet(str(tmp_path / "t"))
    s = Space(spark)
    s.add_table(spark.read.parquet(str(tmp_path / "t")).select("k", "m"), "t")
    plan = s.select("(t $k 1)", k="$k")._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "EqualTo(m,1)" in plan


def test_empty_table_and_copy_clear_backup(spark, tmp_path):
    s = Space(spark)
    s.add_table(spark.createDataFrame([], "a string, b string"), "none")
    s.add_table(spark.createDataFrame([("x", "y"), ("x", "y"), ("p", "q")], "a string, b string"), "ab")
    s.copy("(ab $a $b)", "(ba $b $a)")
    s.copy("(none $a $b)", "(never $a)")
    s.clear("(ab x $b)")
    s.backup(str(tmp_path / "b"))
    other = Space(spark)
    other.restore(str(tmp_path / "b"))
    assert other.dump() == s.dump() == ["(ab p q)", "(ba q p)", "(ba y x)"]
    assert s.count("(ba $x $y)") == 2
    assert [r["atom"] for r in s.lines().collect()] == s.dump()
    assert {render(t) for t in parse(" ".join(s.dump()))} == set(s.dump())


def test_hash_is_the_same_digest_in_memory_and_over_relations(spark):
    rule = "(exec 0 (, (w $g $x)) (O (hash (h $g $v) $v $x)))"
    rows = [("a", "pear"), ("a", "plum"), ("b", "fig")]
    large = Space(spark)
    large.add_table(spark.createDataFrame(rows, "g string, x string"), "w")
    large.add(rule)
    large.run()
    small = Space()
    small.add(" ".join(f"(w {g} {x})" for g, x in rows) + rule)
    small.run()
    assert large.dump() == small.dump() and len([x for x in small.dump() if x.startswith("(h ")]) == 2


def test_browse_sees_relations_and_facts(spark):
    s = Space(spark)
    s.add_table(spark.createDataFrame([(f"k{i % 150:03d}", str(i)) for i in range(400)], "k string, v string"), "row")
    s.add("(row (deep 1) 2) (other 1)")
    got = {atom.split()[1]: n for _, atom, n in s.browse("(row $k $v)")}
    assert len(got) == 151 and got["k000"] == 3 and got["k149"] == 2 and got["(deep"] == 1
    assert len(s.browse("(row $k $v)", 7)) == 7


def test_spaces_keep_their_own_snapshots(spark):
    for name in ("one", "two"):
        s = Space(spark)
        s.add_table(spark.createDataFrame([(name,)], "x string"), "src")
        s.add("(exec 0 (, (src $x)) (O (ACT kept (got $x)))) (exec 1 (I (ACT kept (got $x))) (, (back $x)))")
        s.run()
        assert s.select("(back $x)", x="$x").collect() == [(name,)]
        del s
