"""Personal data by bootstrapped contextual extraction.

Regular expressions give the base spans: e-mail addresses, IP addresses, card and phone numbers. They are the seeds;
long hexadecimal values are seeds of one more kind, secrets, which has no base rule. The words around a seed are lexical
patterns of its kind: the two words before it, the one word before it, and the words before and after it. Pattern-instance
edges are counted over the whole corpus, and patterns and instances score each other in turn: a pattern by the share of
its occurrences that reliable instances fill, an instance by the patterns it is found with, seeds being certain. Values
that look like an identifier of a kind but fail its base rule are found where a confident pattern of that kind stands
around them; a secret, seed or not, is found only there.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import documents, forget, written

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
#: A value that is a seed of a secret: hexadecimal, with digits and letters.
HEX = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,128}$"
# Possessive forms of the contract's patterns that match the same strings in linear time: after a failed start nothing
# else in the same run can match, so a match begins at the edge of a run or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: A token with a digit or an at sign: what an unseen identifier can look like.
TOKEN = r"(?<![^\s\"'(<\[=:])(?=[^\s\"'<>\[\]]*(?:[0-9@]|\(at\)))[A-Za-z0-9+(][^\s\"'<>\[\],;]{2,}[A-Za-z0-9](?![A-Za-z0-9@])"
#: Groups of digits with single blanks between some: what an unseen card or phone number can also look like.
RUN = r"(?<![^\s\"'(<\[=:])[+(]?+[0-9]++(?![A-Za-z@])(?:[().-]*+\x20?+[().-]*+[0-9]++(?![A-Za-z@]))++"
#: Code points before a span, and behind it, that are searched for words.
REACH = 1000
#: Where a value can begin inside a word: the character before it and its first one.
GLUE = r"[^A-Za-z0-9._%+-][A-Za-z0-9._%+-]|[^0-9][0-9]|.\+|[\"'(<\[=:]\("
SPAN = "array<struct<k:int,s:int,e:int,v:string,left:string,right:string>>"
LEAST_SUPPORT, LEAST_PATTERN, LEAST_INSTANCE, ROUNDS = 3, 0.5, 0.5, 3


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        d = back.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_PARTS)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, kind: int, passes) -> Column:
    """Spans in code points of the leftmost non-overlapping matches that pass, with value and the text around.

    Matches and the pieces between them alternate, so their lengths give the places.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(pieces.alias("p"), found.alias("m"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        left = F.right(F.concat(acc["tail"], x["p"]), F.lit(REACH))
        left = F.when(start > REACH, F.regexp_replace(left, r"^\S+", "")).otherwise(left)  # no part of a word
        right = text.substr(end + 1, F.lit(REACH + 1))
        right = F.when(F.length(right) > REACH, F.regexp_replace(right, r"\S+$", "")).otherwise(right)
        span = F.array(F.struct(F.lit(kind).alias("k"), start.alias("s"), end.alias("e"), x["m"].alias("v"), left.alias("left"), right.alias("right"))).cast(SPAN)
        out = F.when(x["m"].isNotNull() & F.coalesce(passes(x["m"]), F.lit(False)), F.concat(acc["out"], span)).otherwise(acc["out"])
        tail = F.right(F.concat(acc["tail"], x["p"], F.coalesce(x["m"], F.lit(""))), F.lit(REACH))
        return F.struct(end.alias("pos"), tail.alias("tail"), out.alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])


def _words(left: Column, right: Column) -> Column:
    """The patterns around a span, lower-cased: `2 a b`, the two words before it; `1 b`, the word before it, if a blank

    follows; `x b c`, that word and the first word that begins after a blank behind the span. Any may be missing.
    """
    left, right = F.lower(left), F.lower(right)
    two = F.trim(F.regexp_replace(F.regexp_extract(left, r"(?<!\S)(\S++\s++\S++\s*+)$", 1), r"\s+", " "))
    one = F.regexp_extract(left, r"(?<!\S)(\S++)\s++$", 1)
    after = F.regexp_extract(right, r"^\S*+\s++(\S++)(?:\s|$)", 1)
    both = F.when((one != "") & (after != ""), F.concat(F.lit("x "), one, F.lit(" "), after))
    return F.array_compact(F.array(F.when(two != "", F.concat(F.lit("2 "), two)), F.when(one != "", F.concat(F.lit("1 "), one)), both))


def _shape(v: Column) -> Column:
    """Kind that a value looks like (index in KINDS), or null."""
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    return (
        F.when(v.contains("@") | v.contains("(at)"), F.lit(0))
        .when(v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), F.lit(1))
        .when(v.rlike(r"^[0-9 -]+$") & (digits >= 13), F.lit(2))
        .when(v.rlike(r"^[+(]?[0-9(). -]+$") & digits.between(7, 12), F.lit(3))
        .when(v.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=.-]{16,}$"), F.lit(SECRET))
    )


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the columns pii_base (spans of all kinds in order) and pii_other (tokens that look like identifiers elsewhere)."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    need = {"email": t.contains("@"), "ip": t.rlike("[0-9]"), "card": t.rlike("[0-9]"), "phone": t.contains("+")}
    parts = [F.when(need[k], _spans(t, PATTERNS[k], i, lambda m, k=k: _passes(k, m))).otherwise(none) for i, k in enumerate(KINDS)]
    found = docs.withColumn("pii_base", F.concat(*parts))
    base = F.col("pii_base")
    blank = F.when(t.rlike(r"[0-9][().-]*\x20[().-]*[0-9]"), _spans(t, RUN, 0, lambda m: m.contains(" ") & _shape(m).isNotNull())).otherwise(none)
    other = F.concat(F.when(t.rlike(r"[0-9@]|\(at\)"), _spans(t, TOKEN, 0, lambda m: _shape(m).isNotNull())).otherwise(none), blank)
    clash = lambda o, b: (b["s"] < o["e"]) & (o["s"] < b["e"]) & ~((_shape(o["v"]) == SECRET) & (o["s"] <= b["s"]) & (b["e"] <= o["e"]))
    apart = F.filter(other, lambda o: ~F.exists(base, lambda b: clash(o, b)))
    return found.withColumn("pii_other", F.transform(apart, lambda o: o.withField("k", _shape(o["v"]))))


def _occurrences(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """ctx, t: places in all of docs where the words of the pattern ctx stand.

    The second of two words may have a value glued to it; between the words of an `x` pattern stands one word.
    """
    words = docs.select(F.split(F.lower("text"), r"\s+").alias("w"))
    after = lambda n: F.slice("w", F.lit(n), F.size("w"))
    each = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), after(2).alias("b"), after(3).alias("c"))).alias("x")).select("x.a", "x.b", "x.c")
    part = F.split("ctx", " ")
    parted = contexts.select("ctx", part[0].alias("type"), part[1].alias("l"), part[2].alias("r"))
    found = [spread.select("ctx") for spread in _meet(each, parted)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("ctx").agg(F.count("*").alias("t"))


def _meet(each: DataFrame, parted: DataFrame) -> list[DataFrame]:
    """Rows of ``each`` at which a pattern stands, by type of pattern; types without a pattern are left out."""
    glued = F.substring(F.col("b"), F.length("r"), F.lit(2)).rlike(GLUE)
    here = {
        "2": (each["a"] == parted["l"]) & each["b"].startswith(parted["r"]) & ((F.col("b") == F.col("r")) | glued),
        "1": each["a"] == parted["l"],
        "x": (each["a"] == parted["l"]) & (each["c"] == parted["r"]),
    }
    present = {r["type"] for r in parted.select("type").distinct().collect()} or {"2"}
    return [each.join(parted.where(F.col("type") == t), on) for t, on in here.items() if t in present]


def bootstrap(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), k, s, e of each unseen identifier in docs (doc_id, text), written to the shared folder."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    lean = with_base(docs.select("doc_id", "text")).select("doc_id", digest.alias("h"), "pii_base", "pii_other")
    lean = lean.where((F.size("pii_base") > 0) | (F.size("pii_other") > 0))
    mark = lambda c, seed: F.transform(c, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v"), x["left"].alias("left"), x["right"].alias("right"), (F.lit(True) if seed else (x["k"] == SECRET) & x["v"].rlike(HEX)).alias("seed")))
    each = lean.select("doc_id", "h", F.explode(F.concat(mark(F.col("pii_base"), True), mark(F.col("pii_other"), False))).alias("o"))
    patterns_of = F.explode(_words(F.col("o.left"), F.col("o.right"))).alias("ctx")
    seen = written(each.select("doc_id", "h", "o.k", "o.s", "o.e", "o.v", patterns_of, "o.seed"), "pii-seen")
    size = seen.count() * 200
    edges = seen.groupBy("k", "ctx", "v").agg(F.count("*").alias("c"), F.max("seed").alias("seed"), F.min("seed").alias("closed"))
    # only contexts that several seeds share, or that hold a look-alike beside one, can matter
    wide = edges.groupBy("k", "ctx").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("closed").alias("closed")).where(F.col("n") >= LEAST_SUPPORT)
    wide = written(wide, "pii-patterns", size)
    # where seeds alone stand there is nothing to find, so the share plays no part
    totals = _occurrences(docs, wide.where("NOT closed").select("ctx").distinct())
    patterns = written(wide.join(totals, "ctx", "left").select("k", "ctx", F.greatest("c", F.coalesce("t", F.lit(0))).alias("total")), "pii-totals", size)
    graph = written(edges.join(patterns, ["k", "ctx"]).select("k", "ctx", "v", "c", "seed", "total"), "pii-graph", size)
    score = graph.groupBy("k", "v").agg(F.max(F.col("seed").cast("double")).alias("r"))
    good = None
    for _ in range(ROUNDS):
        filled = graph.join(score, ["k", "v"]).groupBy("k", "ctx").agg(F.sum(F.col("c") * F.col("r")).alias("x"), F.max("total").alias("total"), F.sum((F.col("r") >= LEAST_INSTANCE).cast("int")).alias("n"))
        good = written(filled.where(F.col("n") >= LEAST_SUPPORT).select("k", "ctx", (F.col("x") / (F.col("total") + 1)).alias("p")), "pii-scores", size)
        miss = F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))
        score = graph.join(good, ["k", "ctx"]).groupBy("k", "v").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(1 - miss).alias("r"))
        score = written(score, "pii-instances", size)
    sure = good.where(F.col("p") >= LEAST_PATTERN).select("k", "ctx")
    hits = seen.where(~F.col("seed") | (F.col("k") == SECRET)).join(sure, ["k", "ctx"], "left_semi").join(score.where(F.col("r") >= LEAST_INSTANCE).select("k", "v"), ["k", "v"], "left_semi")
    out = written(hits.select("doc_id", "h", "k", "s", "e").distinct(), "pii-found", size)
    forget(seen, graph, wide, patterns)
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """docs and the columns pii_base, pii_spans: array of (k index in KINDS, s, e), by kind, then start.

    docs needs doc_id and text; a null text counts as empty, a long one is read whole. Discovered spans never overlap
    base spans, except for secrets that hold one. Rows that share doc_id and text have the same spans, and each counts.
    """
    found = bootstrap(docs).groupBy("doc_id", "h").agg(F.collect_set(F.struct("k", "s", "e")).alias("pii_new"))
    lean = lambda c: F.transform(c, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    based = with_base(docs).drop("pii_other").withColumn("pii_base", lean(F.col("pii_base")))
    found = found.select(F.col("doc_id").alias("pii_id"), F.col("h").alias("pii_h"), "pii_new")
    joined = based.join(found, based["doc_id"].eqNullSafe(found["pii_id"]) & (F.xxhash64(F.coalesce(based["text"], F.lit(""))) == found["pii_h"]), "left")
    # of found values within each other the longest stays
    inside = lambda x: F.exists("pii_new", lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (y["e"] - y["s"] > x["e"] - x["s"]))
    new = F.coalesce(F.filter("pii_new", lambda x: ~inside(x)), F.array().cast("array<struct<k:int,s:int,e:int>>"))
    return joined.withColumn("pii_spans", F.array_sort(F.concat("pii_base", new))).drop("pii_id", "pii_h", "pii_new")


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in angle brackets; all other columns stay as they are."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in NAMES])
    ordered = F.array_sort(F.transform("pii_spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

    def step(acc, x):
        text = F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, x["s"] - acc["pos"]), F.element_at(names, x["k"] + 1))
        later = x["s"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(later, text).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(ordered, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    out = F.when(F.size("pii_spans") > 0, whole).otherwise(F.col("text"))
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("pii_row"))  # no name can clash
    return personal_data(packed).select(*[out.alias("text") if c == "text" else F.col("pii_row").getField(c).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("pii_base", lambda x: x["k"] == kind)).cast("long")


def op1_pii(spark, sf_dir):
    """Base spans and what the patterns add."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = personal_data(docs)
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    secrets = F.size(F.filter("pii_spans", lambda x: x["k"] == SECRET)).cast("long").alias("n_secret")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(F.col("pii_spans")).alias("spans"), secrets, F.size("pii_spans").cast("long").alias("n_spans"))
