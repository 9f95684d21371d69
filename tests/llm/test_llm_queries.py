"""The registered queries against brute force, through the files they read, with schemas."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_documents import base_spans, near, words

from atomweave.llm import mixing, queries
from atomweave.space import Space

SCHEMAS = {
    "op1_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_neardup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
}
WORDS = "the of and to in that was with for on as by at from this is it be or are north river stone winter garden".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder with documents.parquet, rows)"""
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ly", "ing"]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 90)), rng.choice(["en", "xx", None]), rng.choice(["a", "b", "c", "d", None])) for i in range(70)]
    rows += [(100 + i, rows[i][1], "en", "b") for i in range(6)] + [(200, None, None, "a"), (201, "", "en", None), (202, "12 34", "xx", "c")]
    rows += [(300 + i, f"write to user{i}@site.org or call +1 (017) 555-{1000 + i} now", "en", "a") for i in range(5)]
    rows = [(i, t if lang != "xx" or not t else t.translate(str.maketrans("aeiou", "uoiea")), lang, s) for i, t, lang, s in rows]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def run(spark, tables, name):
    df = queries.QUERIES[name](spark, tables[0])
    have = dict(df.dtypes)
    assert all(have.get(c) == t for c, t in SCHEMAS[name].items()), have
    rows = df.collect()
    assert len(rows) == len(tables[1])
    return {r["doc_id"]: r for r in rows}


def test_op1(spark, tables):
    got = run(spark, tables, "op1_pii")
    kinds = ("email", "ip", "card", "phone")
    for i, t, *_ in tables[1]:
        spans = base_spans(t)
        digest = ",".join(f"{kinds[k]}:{s}:{e}" for k, s, e in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(x[0] == n for x in spans) for n in range(4)]
        assert set(filter(None, digest.split(","))) <= set(got[i]["spans"].split(","))


def grams(text):
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    if not any(c.isalpha() for c in s):
        return collections.Counter()
    s = f" {' '.join(s.split())} "
    if text.lower() and not text.lower()[0].isalpha():
        s = " " + s.lstrip()
    return collections.Counter(g for n in (1, 2, 3) for g in (s[i : i + n] for i in range(len(s) - n + 1)) if g.strip(" "))


def test_op2(spark, tables):
    got = run(spark, tables, "op2_language")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], sum(ord(ch) << 21 * (len(x[0]) - 1 - k) for k, ch in enumerate(x[0]))))][:400]
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang, _ in tables[1]:
        if lang is not None and not held(i):
            counts[lang].update(grams(t or ""))
    profiles = {lang: {g: k for k, g in enumerate(rank(c))} for lang, c in counts.items()}
    for i, t, *_ in tables[1]:
        r = rank(grams(t or ""))
        far = {lang: sum(min(abs(p[g] - k), 400) if g in p else 400 for k, g in enumerate(r)) for lang, p in sorted(profiles.items())}
        want = (min(far, key=far.get), 1 - min(far.values()) / (400 * len(r))) if r else ("und", 0.0)
        assert (got[i]["held_out"], got[i]["lang_pred"]) == (held(i), want[0]) and got[i]["score"] == pytest.approx(want[1])


def queue(spark, rows):
    """Copies of each row by fair queueing, one by one."""
    df = spark.createDataFrame([(i, t, s) for i, t, _, s in rows], "doc_id long, text string, source string")
    h = {r["doc_id"]: r["h"] for r in df.select("doc_id", mixing.shuffle_hash(F.col("doc_id"), F.col("text")).alias("h")).collect()}
    size = {i: len(words(t)) for i, t, *_ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    sizes = [sum(size[i] for i, _, _, x in rows if x == s) for s in names]
    targets = dict(zip(names, mixing.fair_targets(sizes, [k % 3 + 1 for k in range(len(names))], sum(sizes)), strict=True))
    copies = []
    for s in names:
        n = 1 + -(-sum(x == s for *_, x in rows) // mixing.BUCKET_ROWS) * 0
        order = sorted((i for i, _, _, x in rows if x == s), key=lambda i: (h[i] % n, h[i], i))
        done = 0
        for e in range(3):
            for i in order:
                if size[i] and done < targets[s]:
                    copies.append(((done + size[i]) / targets[s], h[i], i))
                done += size[i]
    copies.sort()
    taken, left = collections.Counter(), sum(sizes)
    for _, _, i in copies:
        if size[i] > left:
            break
        taken[i] += size[i]
        left -= size[i]
    return size, targets, taken


def test_op4(spark, tables):
    got = run(spark, tables, "op4_mixing")
    size, targets, taken = queue(spark, tables[1])
    for i, _, _, s in tables[1]:
        assert (got[i]["size"], got[i]["taken"]) == (size[i], taken[i]) and got[i]["target"] == pytest.approx(targets[s])


def test_op5(spark, tables):
    got = run(spark, tables, "op5_neardup")
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == near([(i, t, s) for i, t, _, s in tables[1]], 4)


def test_texts_under_one_id_have_one_component(spark):
    from atomweave.llm import neardup

    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a), (4, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()} == {(5, 3), (3, 3), (9, 3), (4, 4)}


def test_op7(spark, tables):
    got = run(spark, tables, "op7_sharding")
    text = {i: t or "" for i, t, *_ in tables[1]}
    keys = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in set(text.values())], "t string").select("t", F.xxhash64("t").alias("k")).collect()}
    group = collections.Counter()
    for t in text.values():
        group[t] += len(t.encode()) + 16
    rest, own, n = sum(group.values()), [], 40
    for t in sorted(group, key=lambda t: (-group[t], keys[t])):
        if len(own) < n - 1 and group[t] * (n - len(own)) > rest:
            own.append(t)
            rest -= group[t]
        else:
            break
    order = sorted((t for t in group if t not in own), key=keys.get)

    def cut(capacity):
        shard, load, out = 0, 0, {}
        for t in order:
            if load + group[t] > capacity:
                shard, load = shard + 1, 0
            load += group[t]
            out[t] = len(own) + shard
        return out

    capacity = max(group[t] for t in order)
    while max(cut(capacity).values()) >= n:
        capacity += 1
    place = cut(capacity) | {t: k for k, t in enumerate(own)}
    slots = collections.defaultdict(list)
    for i, r in got.items():
        assert (r["shard"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (place[text[i]], len(text[i].encode()) + 16, zlib.crc32(text[i].encode()), "bytes", None)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op3_agrees_with_the_library_on_most_words(spark, tables):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    from atomweave.llm.pieces import Pieces

    m = Pieces(path)
    every = [w for _, t, *_ in tables[1] for w in (t or "").split()]
    same = sum(np.frombuffer(m.encode(w)[0][1], np.int32).tolist() == sp.encode(w) for w in every)
    assert same > 0.75 * len(every)
    long = "ab9.é" * 20000
    (score, ids), *more = m.encode(long)
    assert m.decode(ids) == long and len(more) == 3 and all(x <= score for x, _ in more)
    for r in queries.QUERIES["op3_pieces"](spark, tables[0]).collect():
        text = next(t for i, t, *_ in tables[1] if i == r["doc_id"]) or ""
        assert m.decode(np.array(r["ids"], np.int32).tobytes()) == text and r["decodes"] and zlib.crc32(np.array(r["ids"], "<i4").tobytes()) == r["ids_crc32"]


def test_settings_stay_and_relations_are_whole_after_an_operator(spark, tables):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = [spark.conf.get(k, None) for k in keys]
    queries.QUERIES["op4_mixing"](spark, tables[0]).collect()
    assert [spark.conf.get(k, None) for k in keys] == before
    s = Space(spark)
    for head in ("p", "q"):
        s.add_table(spark.range(6).selectExpr("id AS a", "id % 2 AS b").repartition(3), head)
    s.add("(exec 0 (, (p $x $y) (q $x $z)) (, (r $y $z)))")
    s.run()
    want = s.dump()
    assert len(want) == 14 and all(s.dump() == want for _ in range(40))
