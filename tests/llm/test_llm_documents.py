"""Operators over documents against brute force, on awkward tables: nulls, ties, repeats, empty texts, clashing columns."""

import collections
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from atomweave.llm import language, mixing, neardup, pieces, pii, quality, sharding, sstable, substrings
from atomweave.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, row long, h long, shard int, id long, key long, ids string"
WORDS = "the of and to in that was with for on as by at from this is it be or are".split()


def word(rng):
    return rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))


@pytest.fixture(scope="module")
def docs():
    """(doc_id, text, source): random texts, copies, near copies, a shared passage, a repeated line, null and odd ones."""
    rng = random.Random(11)
    base = [" ".join(word(rng) for _ in range(rng.randint(30, 120))) for _ in range(40)]
    passage = " ".join(word(rng) for _ in range(26))
    texts = list(base)
    for t in base[:8]:
        w = t.split()
        for _ in range(6):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = word(rng)
            texts.append(" ".join(v))
    texts += [base[3]] * 5 + [f"{b} {passage} tail{i}" for i, b in enumerate(base[20:26])]
    texts += ["same line again and again\n" * 9, None, None, "", "   ", "a", "A b", "a B", "x" * 5000, "é😀 ñandú " * 12, " lead and  double ", "tab\tand\x0bvt\x0cff\rcr"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3, texts[k], ["s1", "s2", None, "s10"][k % 4]) for i, k in enumerate(order)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", s, 1, True, 7, 8, 9, 1, 2, 3, "z") for d, t, s in docs], SCHEMA).repartition(5)


def words(t):
    return (t or "").encode().split()


def as_map(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


# ---------------------------------------------------------------------------------------------- substrings


def removed(docs, n=20):
    seen, out = set(), {}
    for d, t, _ in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [True] * n
            seen.add(k)
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substrings(spark, docs):
    got = substrings.remove_repeats(frame(spark, docs), with_text=True)
    assert as_map(got.drop("kept")) == removed(docs)
    assert all(hashlib.sha256((r["kept"]).encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_substrings_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t, None), (5, t, None), (5, t, None), (4, "q " + t, None)]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_removed"]) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    assert got == [(-1, 0), (4, 30), (5, 30), (5, 30)]


# ---------------------------------------------------------------------------------------------- near duplicates


def near(docs, width, percent=80):
    sets = {}
    for d, t, _ in docs:
        w = [x.lower() for x in words(t)]
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, docs, width):
    assert as_map(neardup.near_duplicates(frame(spark, docs), width)) == near(docs, width)


def test_near_duplicates_large_bucket_of_unlinked_members(spark):
    """Many variants of one text, most too far from the smallest id: links between them must still be found."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(160):
        v = list(base)
        for _ in range(rng.randint(0, 4)):
            v[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(v), None))
    assert as_map(neardup.near_duplicates(frame(spark, docs), 4)) == near(docs, 4)


def test_components_by_union_find_and_in_rounds(spark):
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(-3, 40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(900, i) for i in range(500, 560)] + [(7, 7), (2**62, 2**61)]
    for rows in (links, []):
        root = {x: x for pair in rows for x in pair}
        for _ in root:
            for a, b in rows:
                root[a] = root[b] = min(root[a], root[b])
        df = spark.createDataFrame(rows, "a long, b long").repartition(5)
        for few in (len(links), 0):
            assert {r["id"]: r["component"] for r in components(df, few).collect()} == root


def test_small_tables_have_few_files(spark, monkeypatch):
    import corpus_pipeline
    from atomweave.llm import _common

    files = []

    def counted(df, *args):
        out = _common.written(df, *args)
        files.append((args[0], len(out.inputFiles())))
        return out

    for module in (corpus_pipeline, mixing, neardup, pii, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "written", counted)
    texts = [" ".join(f"w{(i // 2 * 31 + j * (1 + i // 2)) % 97}" for j in range(40)) + (" end" if i % 2 else "") + f" mail m{i}@site.org" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert sorted(r["doc_id"] for r in left.collect()) == list(range(0, 60, 2))
        corpus_pipeline.mask_personal_data(spark, docs, "")
        corpus_pipeline.mix_sources(spark, docs, "")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {t for t, n in files if n > 1} <= {"sets", "pii-seen", "mix-sizes"}  # these come from the texts, in the same tasks
    assert len(files) < 45


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(0)
    a, b = np.unique(rng.integers(0, 2**63, 900, np.uint64)), np.unique(rng.integers(0, 2**63, 300, np.uint64))
    both = np.unique(np.concatenate([a, b]))
    assert (neardup.merge(neardup.sketch(a), neardup.sketch(b)) == neardup.sketch(both)).all()
    j = neardup.estimate(neardup.sketch(a)[None], neardup.sketch(both)[None], np.array([900.0]), np.array([1200.0]))[0]
    assert abs(j - 0.75) < 0.15


# ---------------------------------------------------------------------------------------------- quality, language


def test_quality(spark, docs):
    got = as_map(quality.quality(frame(spark, docs), public_tokenizers.path("piece_bpe_32k.model")))
    for d, t, _ in docs:
        w, t = words(t), t or ""
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert got[d][:5] == want and got[d][10] == failed and not (failed and got[d][11])


def quartile_bands(rows, spread=6.0, least=30):
    """Limits of each figure by class, from whole documents' figures."""
    classes = collections.defaultdict(list)
    for r in rows:
        if not r["base_failed"] and r["n_tokens"] >= 20:
            classes["en", r["n_tokens"].bit_length() - 1].append(r)
    out = {}
    for c, group in classes.items():
        for name, unit, share, floor in (("chars_per_token", 0.01, 0.005, 0.0), ("token_entropy", 0.01, 0.005, 0.0), ("fallback_share", 0.001, 0.0, 0.02)):
            v = sorted(int(r[name] / unit + 0.5) for r in group)
            q1, q2, q3 = (v[max(0, -(-len(v) * k // 4) - 1)] for k in (1, 2, 3))
            narrow = max(q2 * share, floor / unit)
            if len(group) >= least:
                out[c, name] = ((q2 - spread * max(q2 - q1, narrow)) * unit, (q2 + spread * max(q3 - q2, narrow)) * unit)
    return out


def test_quality_verdict_rejects_junk_that_the_base_rules_miss(spark):
    rng = random.Random(8)
    known = [w + e for w in WORDS for e in ("", "er", "ing", "ly", "s")]
    clean = [" ".join(rng.choice(known) for _ in range(rng.randint(105, 125))) for _ in range(160)]
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(40)) for _ in range(8)]
    junk += [" ".join("".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(9)) for _ in range(20)) for _ in range(8)]
    texts = clean + junk
    got = quality.quality(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), public_tokenizers.path("piece_bpe_32k.model")).collect()
    limits = quartile_bands(got)
    assert limits
    for r in got:
        inside = [lo - 1e-9 <= r[n] <= hi + 1e-9 for (c, n), (lo, hi) in limits.items() if c == ("en", r["n_tokens"].bit_length() - 1)]
        assert len(inside) in (0, 3) and (r["doc_id"] < 160 or inside)
        assert not inside or r["kept"] == (not r["base_failed"] and all(inside))
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not any(r["base_failed"] for r in got)
    assert len(kept & set(range(160))) >= 156 and not kept & set(range(160, 176))


def test_language(spark):
    rng = random.Random(1)
    parts = {"aa": ["tha", "ing", "ou", "wh", "er"], "bb": ["sch", "ung", "ei", "lich", "zu"], "cc": ["ción", "ado", "que", "os", "ña"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 60))), lang))
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (None, "thaing", None)], "doc_id long, text string, lang string")
    model = language.learn(df.where("doc_id % 4 <> 0"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, model).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows if i % 4 == 0) == 60
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[None][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.reject(df, model).count() == 241
    empty = language.learn(df.where("false"))
    assert language.predict(df.limit(3), empty).where("lang_pred <> 'und'").count() == 0


def test_rank_distance_is_out_of_place():
    m = language.Model({"a": [1, 2, 3], "b": [3, 9, 1]}, 3)
    m2 = language.ranked("ab ab", 5)
    assert len(m2) == 5 and m.langs == ["a", "b"]
    g = language.ranked("aab", 3)
    m = language.Model({"x": list(g), "y": list(g[::-1])}, 3)
    assert m.predict("aab") == ("x", 1.0)


# ---------------------------------------------------------------------------------------------- mixing, sharding


def test_targets():
    t = mixing.fair_targets([100, 10, 50, 0], [1, 2, 3, 1], 160)
    assert t[3] == 0 and t[1] == 30 and abs(sum(t) - 160) < 1e-9 and all(x <= 3 * s + 1e-9 for x, s in zip(t, [100, 10, 50, 0], strict=True))


def test_mixing(spark, docs):
    rows = [*docs, (None, "null id here", "s1"), (None, "null id here", "s1")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((False, d, len(words(t))) for d, t, _ in docs)
    assert sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
    by = collections.defaultdict(lambda: [0, 0.0, 0, 0])
    for r in got:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        b = by[r["source"]]
        b[0] += r["size"]
        b[1], b[2], b[3] = r["target"], b[2] + r["taken"], max(b[3], r["size"])
    for size, target, taken, most in by.values():
        assert abs(taken - target) <= most and target <= 3 * size
    again = mixing.mix(frame(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sharding(spark, docs):
    rows = [*docs, *[(1000 + i, "hot text " * 40, None) for i in range(200)]]
    got = sharding.shard(frame(spark, rows), 6).collect()
    assert len(got) == len(rows)
    text = {d: t or "" for d, t, _ in rows}
    place = {}
    slots = collections.defaultdict(list)
    for r in got:
        t = text[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
        assert place.setdefault(t, r["shard"]) == r["shard"] and 0 <= r["shard"] < 6
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_minimax_is_the_least_capacity(spark):
    rng = np.random.default_rng(4)
    for n, k in ((1, 4), (9, 3), (800, 7)):
        keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        size = {int(a): int(b) for a, b in zip(keys, rng.integers(16, 900, len(keys)), strict=True)}
        own, cuts = sharding.minimax_cuts(spark.createDataFrame(list(size.items()), "key long, size long"), k)
        rest = [(a, b) for a, b in sorted(size.items()) if a not in own]
        load = collections.Counter()
        for a, b in rest:
            load[sum(c < a for c in cuts)] += b

        def fits(c, rest=rest, k=k, own=own):
            shards, cur = 1, 0
            for _, b in rest:
                if cur + b > c:
                    shards, cur = shards + 1, 0
                cur += b
            return shards <= k - len(own)

        if rest:
            top = max(load.values())
            assert fits(top) and (top == max(b for _, b in rest) or not fits(top - 1))


# ---------------------------------------------------------------------------------------------- tokens


def test_token_shards(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    manifest = sstable.write_shards(frame(spark, docs), path, f"file://{tmp_path}/sst", shard_bytes=3000)
    assert manifest.count() > 3
    got = sorted(tuple(r) for r in sstable.read_shards(manifest).collect())
    start, want = 0, []
    ids_of = {}
    for d, text, _ in sorted(docs, key=lambda x: x[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        ids_of[d] = ids
    assert got == want
    found = sstable.lookup(manifest, [docs[0][0], 999_999])
    assert found[999_999] == [] and (found[docs[0][0]][0] == ids_of[docs[0][0]]).all()


def test_plain_words_encode_like_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), sstable.WordEncoder(path)
    words = [w for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, 0x250))) for w in (c, f"a{c}b", f"A{c}{c}9")]
    wrong = [w for w in words if e(w) != np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(words) > 1500 and not wrong


def test_texts_of_a_batch_encode_like_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), sstable.WordEncoder(path)
    e.CAP = 50
    texts = [None, "", " ", "  a\tb\x0bc\x0cd\re\x1cf\x85g\xa0h i ", "<|endoftext|> x", "aƏb ñ", "日本 ☃", "abc" * 900] + [f"the word{i} x{i * i:x}, it's" for i in range(200)]
    for at in range(0, len(texts), 7):
        part, start = texts[at : at + 7], 0
        ids, stops = e.batch(pa.array(part, pa.string()))
        for text, stop in zip(part, stops.tolist(), strict=True):
            assert ids[start:stop].tolist() == t.encode(text or "", add_special_tokens=False).ids
            start = stop
        assert len(e.memo) + len(e.old) <= 2 * e.CAP and start == len(ids)


def test_table_blocks_and_damage(tmp_path):
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    with fs.open_output_stream(str(tmp_path / "a.sst")) as out:
        w = sstable.Writer(out, width=4)
        ids = [None, *range(-50, 5000)]
        for i in ids:
            w.add(sstable.key_of(i), np.arange((i or 0) % 40, dtype=np.uint32))
        with pytest.raises(ValueError, match="ascend"):
            w.add(sstable.key_of(-60), np.zeros(1))
        w.close()
    with fs.open_input_file(str(tmp_path / "a.sst")) as f:
        r = sstable.Reader(f)
        assert len(r.index) > 3 and [sstable.id_of(k) for k, _, _ in r.scan()] == ids
        assert len(r.get(sstable.key_of(77))[0]) == 77 % 40 and r.get(sstable.key_of(10**6)) == []
        assert sum(r.may_hold(sstable.key_of(i)) for i in range(10**6, 10**6 + 2000)) < 100
    data = bytearray((tmp_path / "a.sst").read_bytes())
    data[100] ^= 1
    (tmp_path / "a.sst").write_bytes(data)
    with fs.open_input_file(str(tmp_path / "a.sst")) as f, pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(f).scan())


def segmentations(m, s):
    """Every way to cut s into pieces, with its score."""
    if not s:
        return [(0.0, [])]
    out = []
    for k in range(1, len(s) + 1):
        w = m.score.get(s[:k])
        if w is None and k == 1:
            w = m.unknown
        if w is not None:
            out += [(w + x, [s[:k], *p]) for x, p in segmentations(m, s[k:])]
    return out


def test_pieces_are_the_n_best():
    m = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 5)
    for s in ("the", "in that", "a  b", "ña☃x", "of\nof", "12 of"):
        want = sorted((x for x, _ in segmentations(m, m.normal(s))), reverse=True)[:5]
        assert [x for x, _ in m.encode(s)] == pytest.approx(want)
        assert [x for x, _ in m.search(m.normal(s), 5)] == pytest.approx(want)
        assert all(m.decode(i) == s for _, i in m.encode(s))


def test_the_n_best_of_a_text_leave_one_queue(monkeypatch):
    m, pops = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 5), []
    monkeypatch.setattr(pieces, "heappop", lambda q, pop=pieces.heappop: pops.append(pop(q)) or pops[-1])
    for s in ("of a to", "a\nat", "ña  in"):
        want = sorted((x for x, _ in segmentations(m, m.normal(s))), reverse=True)[:5]
        m.encode(s)
        pops.clear()
        got = m.encode(s)  # all chunks are known, still the best comes from the search over the whole text
        assert [x for x, _ in got] == pytest.approx(want) and len(pops) == len(want)
        assert len({i for _, i in got}) == len(want) and all(m.decode(i) == s for _, i in got)
    texts = [None, "", "a\x00b \x01", "of a to", "  a\t b", "▁ ▁▁a", "日本 ☃x"]
    for t, (total, ids, ways, lens) in zip(texts, m.batch(texts, 5), strict=True):
        want = m.encode(t or "")
        assert [total - x for x, _ in ways] == pytest.approx([x for x, _ in want] or [0]) and int(lens.sum()) == len(ids)
        assert ids.tobytes() == (want[0][1] if want else b"")


def test_memo_of_pieces_stays_small_and_keeps_what_is_frequent():
    m, free = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model")), pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    m.CAP, m.HELD = 60, 300
    texts = [f"the of x{i * i:x} y{i * 7:o} {'ab' * (i % 40)}" for i in range(200)]
    for at in range(0, len(texts), 8):
        for t, (total, ids, ways, _) in zip(texts[at : at + 8], m.batch(texts[at : at + 8], 4), strict=True):
            want = free.encode(t)
            assert (ids.tobytes(), [total - x for x, _ in ways]) == (want[0][1], pytest.approx([x for x, _ in want]))
        assert len(m.memo) <= m.CAP and "▁the" in m.memo and sum(len(c) for c, *_ in m.more) <= m.HELD + 80


def test_few_lattices_of_pieces_are_held():
    m = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for i in range(400):
        m.encode(f"the of x{i * i:x} y{i * 7:o} number{i}")
    assert sum(map(len, m.open)) <= m.OPEN and all(len(x) == 2 for x in m.more.values())


def test_pieces_round_trip(spark, docs):
    out = pieces.encode(frame(spark, docs), public_tokenizers.path("piece_bpe_32k.model"))
    assert out.where("NOT decodes").count() == 0 and out.count() == len(docs)
    assert "text" not in out.columns and "n_chars" in out.columns
    r = out.where("n_tokens > 20").first()
    assert len(r["ids"]) == r["n_tokens"] and r["score"] >= max(r["other_scores"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes())


# ---------------------------------------------------------------------------------------------- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(t):
    def ok(k, v):
        d = re.sub("[^0-9]", "", v)
        return k == "email" or (k == "ip" and all(int(x) <= 255 for x in v.split("."))) or (k == "card" and 13 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 9 <= len(d) <= 15)

    return [(i, m.start(), m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if ok(k, m.group())]


ODD = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "+1 (017) 555-7713", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é😀 me@x.org 😀 10.0.0.1", "@@a@b..c a@b.c.", None, "", "+1-", "++12345678901", "0001.002.003.004", "1" * 60, "x" * 5000 + "@" + "y" * 5000 + ".z", ".a" * 5000 + "@b", "a@b" + ".c" * 5000]


def test_personal_data(spark):
    rng = random.Random(3)
    odd = ODD + ["".join(rng.choice("a1.@+- (9)é") for _ in range(200)) for _ in range(60)]
    df = frame(spark, [(i, t, None) for i, t in enumerate(odd)])
    got = {r["doc_id"]: [tuple(x) for x in r["pii_base"]] for r in pii.personal_data(df).select("doc_id", "pii_base").collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(odd)}


def test_patterns_find_unseen_identifiers(spark):
    texts = [f"for help reach me at user{i}@host{i}.com today" for i in range(6)] + ["for help reach me at carl@localhost today", "we met at 5pm on day 12", "the code at 4111111111111112 stands"]
    df = frame(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, texts[6], None)])
    rows = pii.personal_data(df).select("doc_id", "pii_base", "pii_spans").collect()
    new = {r["doc_id"]: [tuple(x) for x in r["pii_spans"] if x not in r["pii_base"]] for r in rows}
    assert new.pop(6) == new.pop(None) == [(0, 21, 35)]
    assert not any(new.values())
    masked = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert masked[0] == "for help reach me at <EMAIL> today" and masked[6] == masked[0] and masked[7] == texts[7]
    assert pii.masked(df).columns == df.columns
    clash = pii.masked(df.withColumn("pii_base", F.lit(7)).withColumn("pii_spans", F.lit("s")).where("doc_id = 0")).first()
    assert (clash["pii_base"], clash["pii_spans"], clash["text"]) == (7, "s", masked[0])


def test_pattern_occurrences_are_counted_in_all_documents(spark):
    seeds = [f"{lead}user{i}@host{i}.com after{i}" for i in range(6) for lead in ("please write to ", 'his mail:"', 'her mail:"')]
    empty = ["we write to them and others write to us"] * 12 + ['her mail:"none of it'] * 12
    texts = [*seeds, "please write to carl@localhost today", 'his mail:"dora@localhost today', 'her mail:"evan@localhost today', *empty]
    rows = pii.personal_data(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).select("doc_id", "pii_base", "pii_spans").collect()
    assert {texts[r["doc_id"]] for r in rows if len(r["pii_spans"]) > len(r["pii_base"])} == {'his mail:"dora@localhost today'}
    contexts = spark.createDataFrame([("2 write to",), ('2 his mail:"',), ('2 her mail:"',), ("1 others",), ("x we to",)], "ctx string")
    got = {r["ctx"]: r["t"] for r in pii._occurrences(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), contexts).collect()}
    gapped = [f"mail me at user{i}@host{i}.com before noon" for i in range(4)] + ["or at carl@localhost before noon", "what at dawn before noon"]
    rows = pii.personal_data(frame(spark, [(i, t, None) for i, t in enumerate(gapped)])).collect()
    assert [gapped[r["doc_id"]][x["s"] : x["e"]] for r in rows for x in r["pii_spans"] if x not in r["pii_base"]] == ["carl@localhost"]
    assert got == {"2 write to": 6 + 1 + 24, '2 his mail:"': 7, '2 her mail:"': 7 + 12, "1 others": 12, "x we to": 12}


def test_secrets(spark):
    texts = [f'set token = "{i:x}9{"0a1b2c3d" * 4}" now' for i in range(1, 5)] + ['the token = "sk-Live_99aBcDeF0123" was set', f"commit {'0a1b2c3d' * 5} is in", 'a token = "none" here', "x" * 40]
    df = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    rows = pii.personal_data(df).collect()
    found = {texts[r["doc_id"]][x["s"] : x["e"]] for r in rows for x in r["pii_spans"] if x["k"] == pii.SECRET}
    assert found == {t.split('"')[1] for t in texts[:5]}
    assert {r["text"] for r in pii.masked(df).where("doc_id IN (1, 4, 5)").collect()} == {'set token = "<SECRET>" now', 'the token = "<SECRET>" was set', texts[5]}


def test_contexts_come_from_the_whole_text(spark):
    long = "9" * 90
    texts = [f"room 7 ext +1 017 555 {1000 + i} ok" for i in range(6)] + [f"a card {4111111111111111 if i else 5500005555555559} ok" for i in range(2)]
    texts += ["room 7 ext 555-0199 ok", "room 7 ext 555 0199 ok", "room 7 ext (017) 555-01 ok", f"see {'x' * 100} 7 ext 555-0199"]
    texts += [f"my card {c} ok" for c in (4111111111111111, 5500005555555559, 4012888888881881)] + [f"my card {long} ok", "my card 4111 1111 1111 1112 ok"]
    rows = pii.personal_data(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).select("doc_id", "pii_base", "pii_spans").collect()
    new = {texts[r["doc_id"]][x["s"] : x["e"]] for r in rows for x in r["pii_spans"] if x not in r["pii_base"]}
    assert new == {"555-0199", "555 0199", "(017) 555-01", long, "4111 1111 1111 1112"}
    lefts = {r["x"]["v"]: r["c"] for r in pii.with_base(frame(spark, [(0, "at home a(at)x.com, b(at)y.com; call 2024 ext 555-0199", None)])).select(F.explode("pii_other").alias("x")).select("x", pii._words(F.col("x.left"), F.col("x.right")).alias("c")).collect()}
    assert lefts == {"a(at)x.com": ["2 at home", "1 home", "x home b(at)y.com;"], "b(at)y.com": ["2 home a(at)x.com,", "1 a(at)x.com,", "x a(at)x.com, call"], "555-0199": ["2 2024 ext", "1 ext"]}


# ---------------------------------------------------------------------------------------------- empty tables


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(df).count() == 0
    assert substrings.remove_repeats(df).count() == 0
    assert mixing.mix(df).count() == 0
    assert sharding.shard(df, 3).count() == 0
    assert pii.personal_data(df).count() == 0
    assert language.predict(df, language.learn(df)).count() == 0
    assert quality.quality(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert pieces.encode(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert sstable.read_shards(sstable.write_shards(df, public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/e")).count() == 0
