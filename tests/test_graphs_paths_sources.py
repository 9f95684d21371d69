import itertools
import random

import pytest

from atomweave.operators import algebra as A
from atomweave.operators import graph as G
from atomweave.sources import loaders as L
from atomweave.space import Space


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    return sorted({(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(45)})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_graphs(spark, pairs):
    e = spark.createDataFrame(pairs, "src long, dst long")
    reach = set(pairs)
    while True:
        new = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not new:
            break
        reach |= new
    assert rows(G.closure(e)) == sorted(reach)
    hops = {0: 0}
    front = [0]
    while front:
        front = [d for a in front for s, d in pairs if s == a and d not in hops and not hops.update({d: hops[a] + 1})]
    assert rows(G.reachable(e, spark.createDataFrame([(0,)], "node long"))) == sorted(hops.items())
    assert rows(G.k_hop(e, 2)) == sorted({(a, d) for a, b in pairs for c, d in pairs if b == c})
    und = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    for k in (3, 4):
        want = [c for c in itertools.combinations(range(15), k) if all(p in und for p in itertools.combinations(c, 2))]
        assert rows(G.cliques(e, k)) == sorted(want)
    f = G.flow(spark.createDataFrame([(1, 2, 3), (9, 2, 1), (2, 3, 1), (9, 3, 9)], "src long, dst long, w long"), spark.createDataFrame([(1,)], "node long"), 0.5)
    assert rows(f) == [(1, 0), (2, 1)]


def test_graph_queries_over_whole_tables(spark, tmp_path):
    from atomweave import catalog

    rng = random.Random(5)
    supplier, customer = [(k, rng.randint(0, 7)) for k in range(1, 16)], [(k, rng.randint(0, 7)) for k in range(1, 16)]
    orders = [(k, rng.randint(1, 15)) for k in range(1, 13)]
    lineitem = [(o, n, rng.randint(1, 15), float(rng.randint(1, 50))) for o, _ in orders for n in (1, 2)]
    tables = {"supplier": (supplier, "s_suppkey long, s_nationkey long"), "customer": (customer, "c_custkey long, c_nationkey long"), "orders": (orders, "o_orderkey long, o_custkey long"), "lineitem": (lineitem, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = {(dict(supplier)[s], dict(customer)[dict(orders)[o]]) for o, _, s, _ in lineitem}
    got = {q: rows(catalog.QUERIES[q](spark, str(tmp_path))) for q in ("closure", "reachability", "endpoint_chain", "chain_rule", "clique3", "clique4")}
    step = lambda pairs: {(a, d) for a, b in pairs for c, d in edges if b == c}
    reach = set(edges)
    while step(reach) - reach:
        reach |= step(reach)
    first = min(a for a, _ in edges)
    far, und = sorted(step(step(edges))), {tuple(sorted(p)) for p in edges if p[0] != p[1]}
    assert got["closure"] == sorted(reach) and got["reachability"] == sorted({(first,), *[(d,) for a, d in reach if a == first]})
    assert got["endpoint_chain"] == far and sorted((int(a), int(b)) for a, b in got["chain_rule"]) == far
    for k in (3, 4):
        assert got[f"clique{k}"] == [c for c in itertools.combinations(range(8), k) if all(p in und for p in itertools.combinations(c, 2))]


def test_path_algebra(spark):
    p = [A.path("a", "x"), A.path("a", "y"), A.path("b", "x"), A.path("c")]
    a, b = A.path_set(spark, p[:3]), A.path_set(spark, p[1:])
    got = lambda df: sorted(bytes(r["path"]) for r in df.collect())
    assert got(A.union(a, b)) == sorted(p) and got(A.intersection(a, b)) == sorted(p[1:3]) and got(A.subtraction(a, b)) == [p[0]]
    assert got(A.restriction(a, A.path_set(spark, [A.path("a"), A.path("b", "x")]))) == sorted(p[:3])
    assert got(A.unwrap(A.wrap(a, A.path("z")), A.path("z"))) == sorted(p[:3])
    assert got(A.drop_head(a)) == [A.path("x"), A.path("y")]
    m = A.Machine(spark, spaces={b"": a})
    Op = A.Op
    m.routines = {"tail": [(Op.CONSTANT, "p1", b""), (Op.EXTRACT_SPACE, "s1", "p1"), (Op.UNWRAP, "s0", "s1", "p0"), (Op.EXIT, "")], "all": [(Op.CONSTANT, "p1", b""), (Op.EXTRACT_SPACE, "s1", "p1"), (Op.ITERATE, "s0", "s1", "tail")]}
    assert got(m.run("all")) == [A.path("x"), A.path("y")] and ("tail", A.path("a")) in m.memo
    with pytest.raises(A.MachineError, match="malformed"):
        m.run("tail", A.path("none"))
    with pytest.raises(A.MachineError, match="out_of_fuel"):
        m.run("tail", A.path("b", "q"), fuel=1)
    assert A.compare(A.path("a"), A.path("a", "b")) is A.Relationship.LEFT_PREFIX
    assert A.covering([A.path("a", "b"), A.path("a")]) == [A.path("a"), A.path("a")]


def test_extract_space_takes_all_spaces_below_a_prefix(spark):
    spaces = {A.path("p", k): A.path_set(spark, [A.path(k), A.path("x")]) for k in "abc"} | {A.path("q"): A.path_set(spark, [A.path("y")])}
    m = A.Machine(spark, routines={"r": [(A.Op.CONSTANT, "p1", A.path("p")), (A.Op.EXTRACT_SPACE, "s0", "p1"), (A.Op.EXIT, "")]}, spaces=spaces)
    assert sorted(bytes(r["path"]) for r in m.run("r").collect()) == sorted(A.path(k, v) for k in "abc" for v in (k, "x"))


def test_json():
    text = '{"a": 1.5, "b": [true, {"c": null}], "d": {}, "e": [], "f": -12e3, "g": "s"}'
    from atomweave.terms import render

    assert [render(x) for x in L.json_atoms(text)] == ["(a 15e-1)", "(b (0 true))", "(b (1 (c null)))", "(d {})", "(e [])", "(f -12e3)", "(g s)"]
    s = Space()
    assert L.load_json(s, '{"k": 1}', "(doc 7)") == 1 and s.dump() == ["((doc 7) (k 1))"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,1\n\ny,2\nbad\nz,3\n")
    s = Space(spark)
    L.load_csv(s, str(tmp_path / "a.csv"), "($i $k $v)", "(row $k $v $i)")
    assert s.dump() == ["(row x 1 0)", "(row y 2 2)", "(row z 3 4)"]
    (tmp_path / "a.sexp").write_text('(p a b)\n(p c d)\n(q "x y")\n\n')
    s = Space(spark)
    L.load_sexprs(s, str(tmp_path / "a.sexp"), "p", 2)
    assert s.dump() == ['(q "x y")', "(p a b)", "(p c d)"]
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "t"}\n\n{"a": null, "c": true}\n')
    s = Space(spark)
    out = L.load_jsonl(s, str(tmp_path / "a.jsonl"))
    assert rows(out) == [(0, "a", "1"), (0, "b", "t"), (2, "c", "true")]
    texts = spark.createDataFrame([(1, '{"a": [1]}'), (2, "not json"), (3, None)], "k long, t string")
    assert rows(L.json_paths(texts, "k", "t")) == [(1, "(a (0 1))")]
    assert L.convert("(a 1) (b 2)", "(a $x)", "(c $x)") == "(c 1)"


def test_stream(spark, tmp_path):
    from atomweave.streaming.feed import feed

    src = tmp_path / "in"
    spark.createDataFrame([("a", "b"), ("b", "c")], "x string, y string").write.parquet(str(src))
    s = Space(spark)
    stream = spark.readStream.schema("x string, y string").parquet(str(src))
    q = feed(stream, s, "e", ["x", "y"], "(exec 0 (, (e $x $y) (e $y $z)) (, (p $x $z)))", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert "(p a c)" in s.dump()


def test_restriction_by_a_prefix_of_many_components(spark):
    from atomweave.operators import algebra

    path = lambda n: b"".join(algebra.path(f"c{i}") for i in range(n))
    got = algebra.restriction(algebra.path_set(spark, [path(40), path(9)]), algebra.path_set(spark, [path(30)]))
    assert [bytes(r[0]) for r in got.collect()] == [path(40)]
