import collections

import numpy as np
import public_tokenizers
import pytest

from atomweave.llm import queries, topk


def brute(queries, docs, k):
    out = []
    for i, a in queries:
        s = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j) for j, v in docs if j != i)
        out += [(i, r + 1, j, -t) for r, (t, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "k", "scale"), [(300, 16, 5, 1), (40, 5, 20, 1), (6, 3, 20, 1), (60, 6, 3, 2**27)])
def test_maxscore_block(n, dim, k, scale):
    rng = np.random.default_rng(n)
    d = rng.integers(-8, 9, (n, dim)) * scale
    d[n // 2 :] = d[: n - n // 2]  # many ties
    ids = rng.permutation(n * 3)[:n]
    got = topk.maxscore(d[:9], ids[:9], d, ids, k)
    rows = collections.defaultdict(list)
    for q, i, s in zip(*got, strict=True):
        rows[int(q)].append((int(i), int(s)))
    want = collections.defaultdict(list)
    for q, _, i, s in brute([(int(i), [int(x) for x in v]) for i, v in zip(ids[:9], d[:9], strict=True)], [(int(i), [int(x) for x in v]) for i, v in zip(ids, d, strict=True)], k):
        want[q].append((i, s))
    assert rows == want


def test_top_k_over_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(120)]
    odd = [(200, None), (201, [0.1, None] + [0.0] * 6), (220, [float("nan")] + [0.0] * 7), (None, rows[0][1]), (240, [0.5])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    got = sorted(tuple(r) for r in topk.top_k(v.where("vec_id % 20 = 0"), v, 7, doc_block=16, query_block=2).collect())
    exact = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in rows] + [(240, [32] + [0] * 7)]
    assert got == brute([x for x in exact if x[0] % 20 == 0], exact, 7)
    assert topk.top_k(v.where("false"), v.where("false"), 7).count() == 0


def test_vectors_of_several_lengths_and_great_components(spark):
    rng = np.random.default_rng(5)
    exact = [(i, [int(x) for x in rng.integers(-50, 51, rng.choice([0, 1, 3, 8, 40]))]) for i in range(90)]
    most = 2**62
    for rows in (exact, exact[:30] + [(100, [most, most]), (120, [most, -most]), (140, [-most, most, 1]), (160, [-most, -most])]):
        df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
        got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 20 = 0"), df, 6, doc_block=16, query_block=2).collect())
        longest = max(len(v) for _, v in rows)
        full = [(i, v + [0] * (longest - len(v))) for i, v in rows]
        want = []
        for q, a in full:
            if q % 20 == 0:
                s = sorted((-min(max(sum(x * y for x, y in zip(a, v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in full if i != q)
                want += [(q, r + 1, i, -t) for r, (t, i) in enumerate(s[:6])]
        assert got == sorted(want)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    clean = ["the river was long and the boat came by night with all of them in it and one more for luck", "what they had said to him on that day was not for us to know nor to tell any of them now"]
    rows = [(1, clean[0], "en", "a", 5), (2, clean[0], "en", "a", 5), (3, clean[1] + " mail bob@site.org", "en", "b", 5), (4, "12 34", "en", "b", 5), (5, None, "en", "a", 5), (None, clean[1] + " and then some more words at the end of it all here", "en", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "pieces"]
    docs = df
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        seen.append(sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in docs.collect()))
    assert seen[0] == [-1, 1, 2, 3] and seen[1] == seen[2] == [-1, 1, 3]
    third = corpus_pipeline.mask_personal_data(spark, df.where("doc_id = 3"), "").first()
    assert third["text"].endswith("mail <EMAIL>") and third["n_chars"] == len(third["text"])
    copies = collections.Counter(seen[3])
    assert set(copies) <= {-1, 1, 3} and max(copies.values()) <= 3
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] if r["doc_id"] is not None else -1 for r in out) == copies
    from atomweave.llm.pieces import Pieces

    m = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    want = {1: clean[0], 3: clean[1] + " mail <EMAIL>", -1: rows[-1][1]}
    assert all(m.decode(np.array(r["ids"], np.int32).tobytes()) == want[-1 if r["doc_id"] is None else r["doc_id"]] for r in out)


def test_pipeline_stages_on_awkward_tables(spark):
    import corpus_pipeline

    a, b = "the river was long and the boat came by night with all of them", "what they had said to him on that day was not for us to know"
    noise = "".join("bcdfghjklmnpqrstvwxz"[(i * i + 3 * i) % 20] + (" " if i % 9 == 8 else "") for i in range(600))
    rows = [(5, a, None, "s", "x"), (5, b, None, "s", "y"), (5, b, None, "s", "y"), (None, a + " again", None, None, "z"), (None, None, None, "s", "w"), (8, "12 3", None, "s", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, uid string")
    first = corpus_pipeline.identify_language(spark, df, "")
    assert first.columns == df.columns and first.count() == 4  # nothing is labelled: only null and letterless texts go
    labelled = spark.createDataFrame([(i, (a if i % 2 else b) * 3, "en", "s", "") for i in range(20)] + [(99, noise, None, "s", "")], df.schema)
    assert corpus_pipeline.identify_language(spark, labelled, "").count() == 20
    second = corpus_pipeline.drop_near_duplicates(spark, first, "")
    assert sorted((str(r["doc_id"]), r["text"], r["uid"]) for r in second.collect()) in ([("5", a, "x"), ("5", b, "y")], sorted([("5", b, "y"), ("None", a + " again", "z")]))
    twice = spark.createDataFrame([(1, a, "en", "s", "p")] * 3 + [(2, b, "en", "t", "q")], df.schema)
    mixed = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, twice, "").collect())
    taken = collections.Counter()
    for r in __import__("atomweave.llm.mixing", fromlist=["mix"]).mix(twice).collect():
        taken[r["doc_id"]] += r["taken"] // r["size"]
    assert mixed == +taken
    assert all(stage(spark, df.where("false"), "").count() == 0 for _, stage in corpus_pipeline.STAGES)
