"""Queries over the driver's tables, each through the engine's operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns, text
from .operators import algebra, graph
from .sources import loaders
from .space import Space

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def space(spark: SparkSession, sf: str, **tables: list[str]) -> Space:
    """A space with the named columns of tables as relations."""
    s = Space(spark)
    for name, cols in tables.items():
        s.add_table(spark.read.parquet(f"{sf}/{name}.parquet").select(*cols), name)
    return s


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------------------------------------- scans, filters, joins


@query("SELECT DISTINCT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def located_nations(spark, sf):
    s = space(spark, sf, nation=["n_nationkey", "n_name", "n_regionkey"], region=["r_regionkey", "r_name"])
    s.add("(exec 0 (, (nation $n $name $r) (region $r $where)) (, (located $name $where)))")
    s.run()
    return s.table("located", 2, ["nation", "region"])


@query("SELECT DISTINCT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderstatus = 'F'")
def scan_filter(spark, sf):
    s = space(spark, sf, orders=["o_orderkey", "o_custkey", "o_orderstatus"])
    return s.select("(orders $k $c F)", k="$k", c="$c")


@query("SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'R'")
def scan_constants(spark, sf):
    s = space(spark, sf, lineitem=["l_orderkey", "l_linenumber", "l_returnflag"])
    return s.select("(lineitem $k 7 R)", k="$k")


@query("SELECT DISTINCT c_custkey AS c, c_nationkey AS n FROM customer WHERE c_custkey = c_nationkey")
def back_reference(spark, sf):
    s = space(spark, sf, customer=["c_custkey", "c_nationkey"])
    return s.select("(customer $x $x)", c="$x", n="$x")


@query("SELECT DISTINCT c_name AS name, o_orderpriority AS priority FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner2(spark, sf):
    s = space(spark, sf, customer=["c_custkey", "c_name"], orders=["o_orderkey", "o_custkey", "o_orderpriority"])
    return s.select("(customer $c $name) (orders $o $c $p)", name="$name", priority="$p")


@query("SELECT DISTINCT c_mktsegment AS segment, l_returnflag AS flag, o_orderstatus AS status FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def join_chain3(spark, sf):
    s = space(spark, sf, customer=["c_custkey", "c_mktsegment"], orders=["o_orderkey", "o_custkey", "o_orderstatus"], lineitem=["l_orderkey", "l_returnflag"])
    return s.select("(customer $c $m) (orders $o $c $s) (lineitem $o $f)", segment="$m", flag="$f", status="$s")


@query("SELECT DISTINCT s_name AS supplier, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_star(spark, sf):
    s = space(spark, sf, supplier=["s_suppkey", "s_name", "s_nationkey"], nation=["n_nationkey", "n_name", "n_regionkey"], region=["r_regionkey", "r_name"])
    return s.select("(supplier $s $name $n) (nation $n $nn $r) (region $r $rn)", supplier="$name", nation="$nn", region="$rn")


@query("SELECT DISTINCT c_name AS name, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey")
def join_nested_key(spark, sf):
    s = space(spark, sf, customer=["c_custkey", "c_name"])
    s.add_table(_table(spark, sf, "orders"), "", nest="(ord (of (customer $o_custkey)) $o_orderkey)")
    return s.select("(customer $c $name) (ord (of (customer $c)) $k)", name="$name", k="$k")


@query("SELECT DISTINCT n_nationkey AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey")
def join_meet(spark, sf):
    s = Space(spark)
    s.add_table(_table(spark, sf, "nation").select("n_nationkey"), "a")
    s.add_table(_table(spark, sf, "supplier").select("s_nationkey"), "b")
    s.add_table(_table(spark, sf, "customer").select("c_nationkey"), "c")
    return s.select("(a $n) (b $n) (c $n)", n="$n")


@query("SELECT DISTINCT r_name AS region, n_name AS nation FROM region CROSS JOIN nation")
def cross_product(spark, sf):
    s = space(spark, sf, region=["r_name"], nation=["n_name"])
    return s.select("(region $r) (nation $n)", region="$r", nation="$n")


@query("SELECT DISTINCT n_name AS nation FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def semi_join(spark, sf):
    s = space(spark, sf, nation=["n_nationkey", "n_name"], supplier=["s_suppkey", "s_nationkey"])
    return s.select("(nation $n $name) (supplier $s $n)", nation="$name")


@query("SELECT DISTINCT r_name AS region FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)) ")
def ground_conjunct(spark, sf):
    s = space(spark, sf, region=["r_name"], nation=["n_name"])
    first = _table(spark, sf, "nation").agg(F.min("n_name")).first()[0]
    return s.select(f"(region $r) (nation {first})", region="$r")


@query("SELECT 'nation' AS kind, n_nationkey AS k FROM nation UNION SELECT 'region', r_regionkey FROM region")
def head_variable(spark, sf):
    s = space(spark, sf, region=["r_regionkey", "r_name"])
    s.add_table(_table(spark, sf, "nation").select("n_nationkey", "n_name"), "nation")
    return s.select("($kind $k $name)", kind="$kind", k="$k")


@query("SELECT DISTINCT n_name AS nation, CASE WHEN n_regionkey = 1 THEN 'x' ELSE NULL END AS w FROM nation WHERE n_regionkey = 1")
def data_variable(spark, sf):
    """A stored variable takes any value: one wildcard fact beside a relation."""
    s = space(spark, sf, nation=["n_name", "n_regionkey"])
    s.add("(mark $ x)")
    return s.select("(nation $n 1) (mark $n $w)", nation="$n", w="$w")


# ---------------------------------------------------------------------------------------------- sources


@query("SELECT r_regionkey AS x, r_regionkey AS y FROM region")
def source_eq(spark, sf):
    s = space(spark, sf, region=["r_regionkey"])
    return s.select("(== (region $x) (region $y))", typed=True, x="$x", y="$y")


@query("SELECT DISTINCT a.r_regionkey AS x, b.r_regionkey AS y FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey")
def source_ne(spark, sf):
    s = space(spark, sf, region=["r_regionkey"])
    return s.select("(!= (region $x) (region $y))", typed=True, x="$x", y="$y")


@query("SELECT DISTINCT n_nationkey AS n, a.r_regionkey AS r, b.r_regionkey AS other FROM nation JOIN region a ON n_regionkey = a.r_regionkey JOIN region b ON a.r_regionkey <> b.r_regionkey")
def source_mixed(spark, sf):
    s = space(spark, sf, nation=["n_nationkey", "n_regionkey"], region=["r_regionkey"])
    return s.select("(BTM (nation $n $r)) (!= (region $r) (region $o))", typed=True, n="$n", r="$r", other="$o")


@query("SELECT DISTINCT p_partkey AS p, p_brand AS brand FROM part WHERE length(p_name) % 2 = 0")
def grounded_filter(spark, sf):
    """A registered Python function as a source keeps the matches for which it has a result."""
    s = space(spark, sf, part=["p_partkey", "p_name", "p_brand"])
    s.functions["even"] = lambda a: "yes" if len(a[0]) % 2 == 0 else None
    return s.select("(part $p $name $brand) (even $name)", typed=True, p="$p", brand="$brand")


@query("SELECT DISTINCT n_name AS nation, n_regionkey AS r FROM nation")
def act_roundtrip(spark, sf):
    s = space(spark, sf, nation=["n_name", "n_regionkey"])
    s.add("(exec 0 (, (nation $n $r)) (O (ACT kept (pair $n $r)))) (exec 1 (I (ACT kept (pair $a $b))) (, (back $a $b)))")
    s.run()
    return s.table("back", 2, ["nation", "r"])


@query("SELECT DISTINCT conv_id, role FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL")
def backup_restore(spark, sf):
    from .storage import shared_dir

    s = space(spark, sf, conversations=["conv_id", "role"])
    path = f"{shared_dir(spark)}/atomweave/backup-{s.name}"
    s.backup(path)
    other = Space(spark)
    other.restore(path)
    return other.table("conversations", 2, ["conv_id", "role"])


@query("SELECT event_id, j.key AS k, j.value ->> '$' AS v FROM events, json_each(events.props) AS j WHERE props IS NOT NULL AND j.type <> 'NULL'")
def json_members(spark, sf):
    return loaders.json_members(_table(spark, sf, "events"), "event_id", "props")


# ---------------------------------------------------------------------------------------------- sinks


def _sunk(spark, sf, rule: str, head: str, names: list[str], **tables) -> DataFrame:
    s = space(spark, sf, **tables)
    s.add(rule)
    s.run()
    return s.table(head, len(names), names)


@query("SELECT c_nationkey AS nation, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1")
def sink_count(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (customer $c $n)) (O (count (cnt $n $k) $k $c)))", "cnt", ["nation", "n"], customer=["c_custkey", "c_nationkey"])


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def sink_count_all(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (orders $c $s)) (O (count (all $k) $k $c)))", "all", ["n"], orders=["o_custkey", "o_orderstatus"])


@query("SELECT c_nationkey AS nation FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = 5")
def sink_count_guard(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (customer $n $m)) (O (count (full $n) 5 $m)))", "full", ["nation"], customer=["c_nationkey", "c_mktsegment"])


@query("SELECT p_brand AS brand, CAST(sum(DISTINCT p_size) % 4294967296 AS BIGINT) AS total FROM part GROUP BY 1")
def sink_sum(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (part $b $z)) (O (sum (tot $b $t) $t $z)))", "tot", ["brand", "total"], part=["p_brand", "p_size"])


_LINES = {"lineitem": ["l_returnflag", "l_linenumber", "l_quantity"]}


@query("SELECT l_returnflag AS flag, sum(DISTINCT l_quantity) AS total FROM lineitem GROUP BY 1")
def sink_fsum(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (lineitem $f $n $q)) (O (fsum (tot $f $t) $t $q)))", "tot", ["flag", "total"], **_LINES)


@query("SELECT l_returnflag AS flag, l_linenumber AS line, min(l_quantity) AS least FROM lineitem GROUP BY 1, 2")
def sink_fmin(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (lineitem $f $n $q)) (O (fmin (lo $f $n $t) $t $q)))", "lo", ["flag", "line", "least"], **_LINES)


@query("SELECT l_returnflag AS flag, l_linenumber AS line, max(l_quantity) AS most FROM lineitem GROUP BY 1, 2")
def sink_fmax(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (lineitem $f $n $q)) (O (fmax (hi $f $n $t) $t $q)))", "hi", ["flag", "line", "most"], **_LINES)


@query("SELECT n_regionkey AS region, CAST(product(DISTINCT n_nationkey + 1) AS DOUBLE) AS p FROM nation GROUP BY 1")
def sink_fprod(spark, sf):
    s = Space(spark)
    s.add_table(_table(spark, sf, "nation").select("n_regionkey", (F.col("n_nationkey") + 1).alias("k")), "nation")
    s.add("(exec 0 (, (nation $r $k)) (O (fprod (p $r $t) $t $k)))")
    s.run()
    return s.table("p", 2, ["region", "p"])


@query("SELECT c_nationkey AS nation, chr(bit_and(ascii(substr(c_mktsegment, 1, 1)))) AS bits FROM customer GROUP BY 1")
def sink_and(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (customer $n $m)) (O (and (b $n $t) $t $m)))", "b", ["nation", "bits"], customer=["c_nationkey", "c_mktsegment"])


@query("SELECT n_regionkey AS region, printf('%016x', bit_xor(CAST('0x' || substr(md5(n_name), 1, 16) AS UBIGINT))) AS hash FROM nation GROUP BY 1")
def sink_hash(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (nation $n $r)) (O (hash (h $r $t) $t $n)))", "h", ["region", "hash"], nation=["n_name", "n_regionkey"]).withColumn("hash", F.lower(F.hex("hash")))


@query("SELECT name FROM (SELECT DISTINCT p_name AS name FROM part) ORDER BY strlen(name), name LIMIT 10")
def sink_head(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (part $n)) (O (head 10 (low $n))))", "low", ["name"], part=["p_name"])


@query("SELECT k FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS k FROM orders) ORDER BY strlen(k) DESC, k DESC LIMIT 5")
def sink_tail(spark, sf):
    out = _sunk(spark, sf, "(exec 0 (, (orders $k)) (O (tail 5 (top $k))))", "top", ["k"], orders=["o_orderkey"])
    return out.select(F.col("k").cast("string").alias("k"))


@query("SELECT DISTINCT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_difference(spark, sf):
    s = Space(spark)
    s.add_table(_table(spark, sf, "customer").select("c_nationkey"), "a")
    s.add_table(_table(spark, sf, "supplier").where("s_acctbal < 0").select("s_nationkey"), "b")
    s.add("(exec 0 (, (a $x) (b $y)) (O (+ (d $x)) (- (d $y))))")
    s.run()
    return s.table("d", 1, ["n"])


@query("SELECT DISTINCT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf):
    s = Space(spark)
    s.add_table(_table(spark, sf, "customer").select("c_nationkey"), "a")
    s.add_table(_table(spark, sf, "supplier").select("s_nationkey"), "b")
    s.add("(exec 0 (, (a $x) (b $x)) (, (i $x)))")
    s.run()
    return s.table("i", 1, ["n"])


@query("SELECT c_nationkey AS n FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_union(spark, sf):
    s = Space(spark)
    s.add_table(_table(spark, sf, "customer").where("c_acctbal < 0").select("c_nationkey"), "a")
    s.add_table(_table(spark, sf, "supplier").where("s_acctbal > 9000").select("s_nationkey"), "b")
    s.add("(exec 0 (, (a $x) (b $y)) (, (u $x) (u $y)))")
    s.run()
    return s.table("u", 1, ["n"])


@query("(SELECT c_nationkey AS n FROM customer WHERE c_acctbal < -900 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < -900)")
def set_symmetric_difference(spark, sf):
    s = Space(spark)
    s.add_table(_table(spark, sf, "customer").where("c_acctbal < -900").select("c_nationkey"), "a")
    s.add_table(_table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"), "b")
    s.add("(exec 0 (, (a $x) (b $y) (a $m) (b $m)) (O (+ (d $x)) (+ (d $y)) (- (d $m))))")
    s.run()
    return s.table("d", 1, ["n"])


@query("SELECT '(region ' || r_name || ')' AS atom FROM region UNION SELECT '(fact (f $a c))' UNION SELECT '(fact (f a $a))' UNION SELECT '(f a c)'")
def sink_unify(spark, sf):
    s = space(spark, sf, region=["r_name"])
    s.add("(fact (f $x c)) (fact (f a $y)) (exec 0 (, (fact $e) (region $r)) (O (U $e)))")
    s.run()
    return spark.createDataFrame([(x,) for x in s.dump()], "atom string")


@query("SELECT CASE WHEN count(DISTINCT r_name) = 1 THEN '(n ' || min(r_name) || ' k)' ELSE '(n $a k)' END AS atom FROM region")
def sink_generalise(spark, sf):
    s = space(spark, sf, region=["r_name"])
    s.add("(exec 0 (, (region $r)) (O (AU (n $r k))))")
    s.run()
    return spark.createDataFrame([(x,) for x in s.dump() if x.startswith("(n ")], "atom string")


# ---------------------------------------------------------------------------------------------- scalar functions


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS k, CAST((o_custkey - 7) % 11 AS VARCHAR) AS v FROM orders")
def pure_integers(spark, sf):
    f = "(i64_to_string (mod_i64 (sub_i64 (i64_from_string $c) (i64_from_string 7)) (i64_from_string 11)))"
    out = _sunk(spark, sf, f"(exec 0 (, (orders $k $c)) (O (pure (r $k $v) $v {f})))", "r", ["k", "v"], orders=["o_orderkey", "o_custkey"])
    return out.select(F.col("k").cast("string").alias("k"), "v")


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_acctbal < 0 THEN '1' ELSE '0' END AS v FROM customer")
def pure_comparison(spark, sf):
    f = "(i8_to_string (lt_f64 (f64_from_string $b) (f64_from_string 0)))"
    out = _sunk(spark, sf, f"(exec 0 (, (customer $k $b)) (O (pure (r $k $v) $v {f})))", "r", ["k", "v"], customer=["c_custkey", "c_acctbal"])
    return out.select(F.col("k").cast("string").alias("k"), "v")


@query("SELECT p_partkey AS k, sqrt(p_size) AS root, ln(p_size) AS log, p_size & 12 AS bits, bit_count(p_size) AS ones, round(p_retailprice) AS r FROM part")
def pure_columns(spark, sf):
    """Native forms of scalar functions on typed columns."""
    from .terms import parse_one

    p = _table(spark, sf, "part")

    def value(f: str, **at):
        tree = parse_one(f)
        names = iter(at.values())
        return columns.build(tree, lambda leaf: next(names) if not isinstance(leaf, bytes) else F.lit(leaf.decode()))

    size, price = F.col("p_size").cast("string"), text.text_of(F.col("p_retailprice"), p.schema["p_retailprice"].dataType)
    root = value("(sqrt_f64 (f64_from_string $x))", x=size)[0]
    log = value("(ln_f64 (f64_from_string $x))", x=size)[0]
    bits = columns._bits("and", "u32", [F.col("p_size").cast("long"), F.lit(12).cast("long")])
    ones = columns._bits("count_ones", "u32", [F.col("p_size").cast("long")])
    near = value("(round_f64 (f64_from_string $x))", x=price)[0]
    return p.select(F.col("p_partkey").alias("k"), root.alias("root"), log.alias("log"), bits.cast("int").alias("bits"), ones.cast("int").alias("ones"), near.alias("r"))


@query("SELECT DISTINCT n_name AS k, reverse(n_name) AS v FROM nation")
def pure_symbols(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (nation $k)) (O (pure (r $k $v) $v (reverse_symbol $k))))", "r", ["k", "v"], nation=["n_name"])


@query("SELECT DISTINCT r_name AS k, lower(hex(CAST(r_name AS BLOB))) AS v FROM region")
def pure_hex(spark, sf):
    return _sunk(spark, sf, "(exec 0 (, (region $k)) (O (pure (r $k $v) $v (encode_hex $k))))", "r", ["k", "v"], region=["r_name"])


@query("SELECT DISTINCT c_custkey AS k, CASE WHEN c_nationkey > 12 THEN 'high' ELSE 'low' END AS v FROM customer")
def pure_control(spark, sf):
    f = "(ifnz (gt_i64 (i64_from_string $n) (i64_from_string 12)) then high else low)"
    return _sunk(spark, sf, f"(exec 0 (, (customer $k $n)) (O (pure (r $k $v) $v {f})))", "r", ["k", "v"], customer=["c_custkey", "c_nationkey"])


# ---------------------------------------------------------------------------------------------- graphs


def _trade(spark, sf) -> DataFrame:
    """Supplier and customer nations of all order lines: a graph of nations."""
    li, o = _table(spark, sf, "lineitem"), _table(spark, sf, "orders")
    s, c = _table(spark, sf, "supplier"), _table(spark, sf, "customer")
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return e.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()


_TRADE = "SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey"


def _reached(e: DataFrame) -> DataFrame:
    return graph.reachable(e, e.agg(F.min("src").alias("node")).where("node IS NOT NULL")).select("node")


def _far(e: DataFrame) -> DataFrame:
    s = Space(e.sparkSession)
    s.add_table(e, "e")
    s.add("(exec 0 (, (e $a $b) (e $b $c) (e $c $d)) (, (far $a $d)))")
    s.run()
    return s.table("far", 2, ["src", "dst"])


@query(f"WITH RECURSIVE e AS ({_TRADE}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src, dst FROM r")
def closure(spark, sf):
    return graph.closure(_trade(spark, sf))


@query(f"WITH RECURSIVE e AS ({_TRADE}), r AS (SELECT (SELECT min(src) FROM e) AS node UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT DISTINCT node FROM r WHERE node IS NOT NULL")
def reachability(spark, sf):
    return _reached(_trade(spark, sf))


@query(f"WITH e AS ({_TRADE}) SELECT DISTINCT a.src AS src, c.dst AS dst FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src")
def endpoint_chain(spark, sf):
    return graph.k_hop(_trade(spark, sf), 3)


@query(f"WITH e AS ({_TRADE}) SELECT DISTINCT a.src AS src, c.dst AS dst FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src")
def chain_rule(spark, sf):
    """The same chain as one rule; endpoints are made distinct at every hop by the compiler."""
    return _far(_trade(spark, sf))


@query(f"WITH t AS ({_TRADE}), u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM t WHERE src <> dst) SELECT x.a AS c1, x.b AS c2, y.b AS c3 FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def clique3(spark, sf):
    return graph.cliques(_trade(spark, sf), 3)


@query(f"WITH t AS ({_TRADE}), u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM t WHERE src <> dst) SELECT x.a AS c1, x.b AS c2, y.b AS c3, w.b AS c4 FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b JOIN u w ON w.a = y.b JOIN u p ON p.a = x.a AND p.b = w.b JOIN u q ON q.a = x.b AND q.b = w.b")
def clique4(spark, sf):
    return graph.cliques(_trade(spark, sf), 4)


# ---------------------------------------------------------------------------------------------- path algebra


def _paths(spark, sf, name: str, *cols: str) -> DataFrame:
    return _table(spark, sf, name).select(algebra.path_of(*[F.col(c).cast("string") for c in cols]).alias("path")).distinct()


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.hex("path").alias("path"))


def _sql_path(*cols: str) -> str:
    return " || ".join(f"lpad(upper(hex(strlen(CAST({c} AS VARCHAR)))), 2, '0') || upper(hex(CAST(CAST({c} AS VARCHAR) AS BLOB)))" for c in cols)


@query(f"SELECT {_sql_path('c_nationkey')} AS path FROM customer WHERE c_acctbal < 0 UNION SELECT {_sql_path('s_nationkey')} FROM supplier")
def vm_union(spark, sf):
    a = _table(spark, sf, "customer").where("c_acctbal < 0").select(algebra.path_of(F.col("c_nationkey").cast("string")).alias("path"))
    return _shown(algebra.union(a, _paths(spark, sf, "supplier", "s_nationkey")))


@query(f"SELECT {_sql_path('c_nationkey')} AS path FROM customer INTERSECT SELECT {_sql_path('s_nationkey')} FROM supplier WHERE s_acctbal > 5000")
def vm_intersection(spark, sf):
    b = _table(spark, sf, "supplier").where("s_acctbal > 5000").select(algebra.path_of(F.col("s_nationkey").cast("string")).alias("path"))
    return _shown(algebra.intersection(_paths(spark, sf, "customer", "c_nationkey"), b))


@query(f"SELECT {_sql_path('c_nationkey')} AS path FROM customer EXCEPT SELECT {_sql_path('s_nationkey')} FROM supplier WHERE s_acctbal > 5000")
def vm_subtraction(spark, sf):
    b = _table(spark, sf, "supplier").where("s_acctbal > 5000").select(algebra.path_of(F.col("s_nationkey").cast("string")).alias("path"))
    return _shown(algebra.subtraction(_paths(spark, sf, "customer", "c_nationkey"), b))


@query(f"SELECT DISTINCT {_sql_path('p_brand', 'p_type')} AS path FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7)")
def vm_restriction(spark, sf):
    b = _table(spark, sf, "part").where("p_size = 7").select(algebra.path_of(F.col("p_brand")).alias("path"))
    return _shown(algebra.restriction(_paths(spark, sf, "part", "p_brand", "p_type"), b, 2))


@query(f"SELECT DISTINCT {_sql_path('p_type')} AS path FROM part")
def vm_drop_head(spark, sf):
    return _shown(algebra.drop_head(_paths(spark, sf, "part", "p_brand", "p_type")))


@query(f"SELECT DISTINCT {_sql_path('n_name')} AS path FROM nation WHERE n_regionkey = 1")
def vm_machine(spark, sf):
    """A routine that takes the paths below one component, wraps and drops it again."""
    m = algebra.Machine(spark, spaces={b"": _paths(spark, sf, "nation", "n_regionkey", "n_name")})
    Op = algebra.Op
    m.routines["below"] = [(Op.CONSTANT, "p1", b""), (Op.EXTRACT_SPACE, "s1", "p1"), (Op.UNWRAP, "s2", "s1", "p0"), (Op.WRAP, "s3", "s2", "p0"), (Op.DROP_HEAD, "s0", "s3"), (Op.EXIT, "")]
    return _shown(m.run("below", algebra.path("1")))


# ---------------------------------------------------------------------------------------------- whole rules


@query("SELECT n_name AS nation, count(DISTINCT o_orderkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def rule_pipeline(spark, sf):
    """Two rules: the first derives a relation, the second counts over it."""
    s = space(spark, sf, nation=["n_nationkey", "n_name"], customer=["c_custkey", "c_nationkey"], orders=["o_orderkey", "o_custkey", "o_orderstatus"])
    s.add("(exec 0 (, (customer $c $n) (orders $o $c F)) (, (closed $n $o))) (exec 1 (, (closed $n $o) (nation $n $name)) (O (count (cnt $name $k) $k $o)))")
    s.run()
    return s.table("cnt", 2, ["nation", "n"])


@query("SELECT atom FROM (SELECT DISTINCT '(nation ' || n_nationkey || ' ' || n_regionkey || ')' AS atom FROM nation)")
def dump_lines(spark, sf):
    return space(spark, sf, nation=["n_nationkey", "n_regionkey"]).lines().select("atom")


# ---------------------------------------------------------------------------------------------- loading and reading


def _shared(spark, s: Space, name: str) -> str:
    from .storage import shared_dir

    return f"{shared_dir(spark)}/atomweave/{name}-{s.name}"


@query("SELECT DISTINCT n_name AS nation, n_regionkey AS region FROM nation")
def load_csv(spark, sf):
    """Rows written as CSV and loaded through a pattern and a template."""
    s = Space(spark)
    path = _shared(spark, s, "csv")
    _table(spark, sf, "nation").select(F.concat_ws(",", F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey"))).write.text(path)
    loaders.load_csv(s, path, "($i $k $name $r)", "(in $name $r)")
    return s.table("in", 2, ["nation", "region"]).select("nation", F.col("region").cast("long").alias("region"))


@query("SELECT DISTINCT j.key AS k, j.value ->> '$' AS v FROM events, json_each(events.props) AS j WHERE props IS NOT NULL AND j.type <> 'NULL'")
def load_jsonl(spark, sf):
    s = Space(spark)
    path = _shared(spark, s, "jsonl")
    _table(spark, sf, "events").where("props IS NOT NULL").select("props").write.text(path)
    loaders.load_jsonl(s, path, "ev")
    return s.select("(ev $i $k $v)", k="$k", v="$v")


@query("SELECT event_id, '(' || j.key || ' ' || (j.value ->> '$') || ')' AS path FROM events, json_each(events.props) AS j WHERE props IS NOT NULL")
def json_paths(spark, sf):
    return loaders.json_paths(_table(spark, sf, "events"), "event_id", "props")


@query("SELECT '(has ' || replace(r_name, ' ', '_') || ' ' || r_regionkey || ')' AS atom FROM region WHERE r_regionkey <> 1")
def load_transformed(spark, sf):
    """Text atoms go in and out through a pattern and a template."""
    s = Space(spark)
    text = "\n".join(f"(row {r['r_regionkey']} {r['name']}) (note {r['name']})" for r in _table(spark, sf, "region").withColumn("name", F.replace("r_name", F.lit(" "), F.lit("_"))).collect())
    s.add_as(text, "(row $k $name)", "(has $name $k)")
    s.remove_as(text, "(row 1 $name)", "(has $name 1)")
    return spark.createDataFrame([(x,) for x in s.dump()], "atom string")


@query("SELECT '(in ' || n_regionkey || ' ' || n_nationkey || ')' AS line FROM nation")
def dump_by_pattern(spark, sf):
    s = space(spark, sf, nation=["n_nationkey", "n_regionkey"])
    s.add("(other 1 2)")
    return spark.createDataFrame([(x,) for x in s.dump_as("(nation $n $r)", "(in $r $n)")], "line string")


@query("SELECT DISTINCT n_regionkey AS region, n_nationkey AS nation FROM nation")
def copy_template(spark, sf):
    s = space(spark, sf, nation=["n_nationkey", "n_regionkey"])
    s.copy("(nation $n $r)", "(of $r $n)")
    return s.table("of", 2, ["region", "nation"])


@query("SELECT DISTINCT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def transform_patterns(spark, sf):
    s = space(spark, sf, customer=["c_name", "c_nationkey"], nation=["n_nationkey", "n_name"])
    s.transform(["(customer $c $n)", "(nation $n $name)"], "(lives $c $name)")
    return s.table("lives", 2, ["name", "nation"])


@query("SELECT CAST(n_regionkey AS VARCHAR) AS child, count(*) AS n FROM nation GROUP BY 1")
def browse_children(spark, sf):
    """The symbols below a ground prefix and how many atoms each leads to."""
    s = space(spark, sf, nation=["n_regionkey", "n_nationkey"])
    got = s.browse("(nation $r $n)")
    return spark.createDataFrame([(atom.split()[1], n) for _, atom, n in got], "child string, n long")


@query("SELECT count(*) AS atoms, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS some FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
def count_atoms(spark, sf):
    s = space(spark, sf, orders=["o_custkey", "o_orderstatus"])
    return spark.createDataFrame([(s.statistics()["atoms"], s.count("(orders $c F)"))], "atoms long, some long")


@query("SELECT DISTINCT n_nationkey AS n FROM nation WHERE n_regionkey <> 1")
def clear_pattern(spark, sf):
    s = space(spark, sf, nation=["n_nationkey", "n_regionkey"])
    s.clear("(nation $n 1)")
    return s.select("(nation $n $r)", n="$n")


# ---------------------------------------------------------------------------------------------- places, regions, forms of rules


@query("SELECT DISTINCT n_name AS nation FROM nation")
def run_at_place(spark, sf):
    """Only the rules of one place run; the other one stays."""
    s = space(spark, sf, nation=["n_nationkey", "n_name"])
    s.add("(exec (here 1) (, (nation $k $n)) (, (seen $n))) (exec (there 1) (, (nation $k $n)) (, (seen $k)))")
    s.run_at("here")
    return s.table("seen", 1, ["nation"])


@query("SELECT DISTINCT r_name AS region FROM region")
def run_in_region(spark, sf):
    s = Space(spark)
    part = s.region("low")
    part.add_table(_table(spark, sf, "region").select("r_name"), "r")
    part.add("(exec 0 (, (r $x)) (, (got $x)))")
    s.add("(r outside)")
    s.run_in("low")
    return part.table("got", 1, ["region"])


@query("SELECT DISTINCT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_compat(spark, sf):
    """Members of an I list without a source's name are plain patterns."""
    s = space(spark, sf, nation=["n_name", "n_regionkey"], region=["r_regionkey", "r_name"])
    s.add("(exec 0 (I (nation $n $r) (region $r $w)) (, (at $n $w)))")
    s.run()
    return s.table("at", 2, ["nation", "region"])


@query("SELECT DISTINCT n_name AS nation, n_regionkey AS region FROM nation")
def sink_compat(spark, sf):
    """Members of an O list without a sink's name are added as they are."""
    s = space(spark, sf, nation=["n_name", "n_regionkey"])
    s.add("(exec 0 (, (nation $n $r)) (O (told $n $r)))")
    s.run()
    return s.table("told", 2, ["nation", "region"])


@query("SELECT '(open ' || r_name || ' $a)' AS atom FROM region")
def free_variable(spark, sf):
    """A variable that no pattern binds stays one."""
    s = space(spark, sf, region=["r_name"])
    s.add("(exec 0 (, (region $r)) (, (open $r $any)))")
    s.run()
    return spark.createDataFrame([(x,) for x in s.dump() if x.startswith("(open ")], "atom string")


@query("SELECT r_name AS region, 'yes' AS made FROM region")
def empty_conjunction(spark, sf):
    """A rule without patterns fires once."""
    s = space(spark, sf, region=["r_name"])
    s.add("(exec 0 (,) (, (made yes))) (exec 1 (, (region $r) (made $m)) (, (both $r $m)))")
    s.run()
    return s.table("both", 2, ["region", "made"])


@query("SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS v FROM part")
def pure_casts(spark, sf):
    """Text to integer to float and back."""
    f = "(i64_to_string (f64_as_i64 (i64_as_f64 (i64_from_string $s))))"
    return _sunk(spark, sf, f"(exec 0 (, (part $k $s)) (O (pure (c $k $v) $v {f})))", "c", ["k", "v"], part=["p_partkey", "p_size"]).select(F.col("k").cast("string").alias("k"), "v")


# ---------------------------------------------------------------------------------------------- more of the path machine


@query(f"SELECT DISTINCT {_sql_path('n_name')} AS path FROM nation")
def vm_iterate(spark, sf):
    """A routine for each first component; the results are one set."""
    m = algebra.Machine(spark, spaces={b"": _paths(spark, sf, "nation", "n_regionkey", "n_name")})
    Op = algebra.Op
    m.routines["one"] = [(Op.CONSTANT, "p1", b""), (Op.EXTRACT_SPACE, "s1", "p1"), (Op.UNWRAP, "s0", "s1", "p0"), (Op.EXIT, "")]
    m.routines["all"] = [(Op.CONSTANT, "p1", b""), (Op.EXTRACT_SPACE, "s1", "p1"), (Op.ITERATE, "s0", "s1", "one"), (Op.EXIT, "")]
    return _shown(m.run("all"))


@query(f"SELECT DISTINCT {_sql_path('r_name')} AS path FROM region UNION SELECT {_sql_path('k')} FROM (SELECT 'one' AS k)")
def vm_singleton(spark, sf):
    m = algebra.Machine(spark, spaces={b"": _paths(spark, sf, "region", "r_name")})
    Op = algebra.Op
    m.routines["x"] = [(Op.EMPTY, "s1"), (Op.SINGLETON, "s2", "p0"), (Op.UNION, "s3", "s1", "s2"), (Op.CONSTANT, "p1", b""), (Op.EXTRACT_SPACE, "s4", "p1"), (Op.UNION, "s0", "s3", "s4"), (Op.EXIT, "")]
    return _shown(m.run("x", algebra.path("one")))
