import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caselight.functions import tokens as K
from caselight.operators import balls as X
from caselight.operators import blocks as B
from caselight.operators import features as FE
from caselight.operators import impact as I
from caselight.operators import retrieval as R

DOCS = ["battery drains fast", "battery drains fast", "the screen is cracked", "update broke the battery", "", "x",
        "screen screen screen battery", "order never shipped", "won't charge at all", "naïve café 设备 坏了"]
QUERIES = ["my battery drains", "cracked screen", "zzz qqq", "", "battery screen update order", "battery drains fast"]


def terms(text, stop=(), ngrams=2):
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop]
    return words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if ngrams == 2 else [])


def tfidf(docs, texts, max_features=20000):
    total, df = Counter(), Counter()
    for d in docs:
        total.update(terms(d))
        df.update(set(terms(d)))
    kept = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:max_features]}
    out = []
    for t in texts:
        raw = {w: c * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, c in Counter(terms(t)).items() if w in kept}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.append({w: v / norm for w, v in raw.items()})
    return out


def brute(docs, queries, k):
    d, q = tfidf(docs, docs), tfidf(docs, queries)
    out = []
    for i, a in enumerate(q):
        scores = [(-round(sum(v * b.get(t, 0.0) for t, v in a.items()), 9), j) for j, b in enumerate(d)]
        out += [(i, r + 1, j, round(-s, 6) + 0.0) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return out


def frames(spark, docs=DOCS, queries=QUERIES):
    return (spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("reply", F.concat(F.lit("re "), "text")),
            spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"))


def rows(hits):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6) + 0.0) for r in hits.collect())


def test_terms_equal_python(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i int, t string")
    for stop in ((), ("the", "is")):
        got = {r["i"]: r["x"] for r in df.select("i", K.terms(F.col("t"), stop).alias("x")).collect()}
        assert [sorted(got[i]) for i in range(len(DOCS))] == [sorted(terms(d, stop)) for d in DOCS]
        counts = {r["i"]: dict(r["x"]) for r in df.select("i", K.term_counts(K.terms(F.col("t"), stop)).alias("x")).collect()}
        assert all(counts[i] == dict(Counter(terms(d, stop))) for i, d in enumerate(DOCS))


@pytest.mark.parametrize("cap", [20000, 5])
def test_weights_long_and_vector(spark, cap):
    docs, _ = frames(spark)
    vocabulary = FE.fit_vocabulary(docs, "doc_id", "text", cap)
    want = tfidf(DOCS, DOCS, cap)
    long = {}
    for r in FE.tfidf_weights(docs, "doc_id", "text", vocabulary).collect():
        long.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for i, w in enumerate(want):
        assert long.get(i, {}) == pytest.approx(w, abs=1e-12)
    stages = FE.tfidf_stages(vocabulary)
    names = stages.stages[0].vocabulary
    assert sorted(names) == [r["term"] for r in vocabulary.frame.orderBy("idx").collect()]
    vectors = FE.tfidf_vectors(docs, "doc_id", "text", vocabulary, stages)
    for r in vectors.select("doc_id", vector_to_array("features").alias("v")).collect():
        assert {names[j]: x for j, x in enumerate(r["v"]) if x} == pytest.approx(want[r["doc_id"]], abs=1e-12)


def test_sparse_top_k_equals_brute_force(spark):
    docs, queries = frames(spark)
    hits = R.retrieve_sparse(queries, docs, "query_id", "text", "doc_id", "text", 3, ("reply",))
    assert rows(hits) == brute(DOCS, QUERIES, 3)
    assert all(r["reply"] == "re " + DOCS[r["doc_id"]] for r in hits.collect())


def test_many_blocks_give_the_same(spark, monkeypatch):
    docs, queries = frames(spark, DOCS * 4, QUERIES * 3)
    monkeypatch.setattr(B, "BLOCK_ROWS", 6)
    assert rows(R.retrieve_sparse(queries, docs, "query_id", "text", "doc_id", "text", 3)) == brute(DOCS * 4, QUERIES * 3, 3)


def test_small_chunks_inside_a_task(spark, monkeypatch):
    docs, queries = frames(spark, DOCS * 4, QUERIES * 3)
    monkeypatch.setattr(B, "_EXPANDED", 3)
    monkeypatch.setattr(B, "_CELLS", 100)
    assert rows(R.retrieve_sparse(queries, docs, "query_id", "text", "doc_id", "text", 2)) == brute(DOCS * 4, QUERIES * 3, 2)


def test_corpus_smaller_than_k_and_no_padding(spark):
    docs, queries = frames(spark, DOCS[:2])
    assert rows(R.retrieve_sparse(queries, docs, "query_id", "text", "doc_id", "text", 5)) == brute(DOCS[:2], QUERIES, 5)
    bare = R.retrieve_sparse(queries, docs, "query_id", "text", "doc_id", "text", 5, pad=False)
    assert {r[0] for r in rows(bare)} == {0, 4, 5} and all(r[3] > 0 for r in rows(bare))


def test_null_text_is_the_zero_vector(spark):
    docs, _ = frames(spark)
    queries = spark.createDataFrame([(0, None)], "query_id long, text string")
    hits = R.retrieve_sparse(queries, docs, "query_id", "text", "doc_id", "text", 3)
    assert rows(hits) == [(0, 1, 0, 0.0), (0, 2, 1, 0.0), (0, 3, 2, 0.0)]
    assert R.top1_scores(queries, hits, "query_id").first()["top1_score"] == 0.0


def test_top1_without_any_hit(spark):
    _, queries = frames(spark)
    none = spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    assert {r["top1_score"] for r in R.top1_scores(queries, none, "query_id").collect()} == {0.0}


def test_dense_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 8)).astype("float32")
    data[7] = data[3]
    data[9] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "doc_id long, v array<float>")
    unit = data.astype("float64")
    unit /= np.where(np.linalg.norm(unit, axis=1, keepdims=True) == 0, 1, np.linalg.norm(unit, axis=1, keepdims=True))
    scores = np.round(unit @ unit.T, 9)
    want = [(i, r + 1, int(j), round(float(scores[i, j]), 6) + 0.0) for i in range(60)
            for r, j in enumerate(np.lexsort((np.arange(60), -scores[i]))[:4])]
    for block in (20_000, 9):
        monkeypatch.setattr(B, "BLOCK_ROWS", block)
        hits = R.retrieve_dense(df.withColumnRenamed("doc_id", "query_id"), df, "query_id", "v", "doc_id", "v", 4)
        assert rows(hits) == want


def test_search_has_no_cross_join(spark, plan):
    docs, queries = frames(spark)
    text = plan(R.retrieve_sparse(queries, docs, "query_id", "text", "doc_id", "text", 3), "simple")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_block_plan():
    assert B.plan_blocks(B.Size(10, 100), B.Size(10, 100), 16) == (1, 1)
    assert B.plan_blocks(B.Size(10**9, 10**10), B.Size(20_000, 10**6), 16) == (50_000, 1)
    q, d = B.plan_blocks(B.Size(200, 10**4), B.Size(10_000, 10**7), 16)
    assert d > q and q * d >= 16


@pytest.mark.parametrize("n", [1, 130, 800, 5000])
def test_top_terms_exact_with_one_shuffle_of_terms(spark, plan, n):
    docs = spark.range(3000).selectExpr("id", "concat('t', id, repeat(concat(' t', id), cast(id % 50 as int))) AS text")
    top = FE.top_terms(FE.term_frequencies(docs, "id", "text", ngrams=1), n)
    want = sorted(range(3000), key=lambda i: (-(i % 50 + 1), f"t{i}"))[:n]
    assert [r["term"] for r in top.collect()] == [f"t{i}" for i in want]
    top.collect()
    final = plan(top, "simple").split("Initial Plan")[0]
    assert "ReusedExchange [term" in final


def clustered(spark, groups=12, per=15):
    """Texts of groups that share no word, and vectors about as many axes."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"g{g}w{rng.integers(6)}" for _ in range(8)) for g in range(groups) for _ in range(per)]
    points = np.repeat(np.eye(groups), per, axis=0) + rng.normal(scale=0.03, size=(groups * per, groups))
    return spark.createDataFrame([(i, t, [float(x) for x in p]) for i, (t, p) in enumerate(zip(texts, points))], "doc_id long, text string, v array<double>"), texts, points


def dense_brute(points, k):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    return [(i, r + 1, int(j), round(float(scores[i, j]), 6) + 0.0) for i in range(len(unit))
            for r, j in enumerate(np.lexsort((np.arange(len(unit)), -scores[i]))[:k])]


@pytest.mark.parametrize("together", [True, False])
def test_the_tree_skips_leaves_and_loses_nothing(spark, monkeypatch, together):
    docs, _, points = clustered(spark)
    asked = docs.withColumnRenamed("doc_id", "query_id")
    visits, compare = [], X.compare

    def watched(sent, tree, *rest):
        visits.append(sent.select("node").join(tree.nodes, "node").agg(F.sum("n")).first()[0] or 0)
        return compare(sent, tree, *rest)

    monkeypatch.setattr(X, "compare", watched)
    monkeypatch.setattr(X, "GROUP_ROWS", 7)
    if not together:
        monkeypatch.setattr(X, "PIVOT_VALUES", 0)
    got = rows(R.retrieve_dense(asked, docs, "query_id", "v", "doc_id", "v", 3, limits=B.Limits(20, 10**9)))
    assert got == dense_brute(points, 3)
    assert sum(visits) < len(points) ** 2 / 4


def test_the_tree_grows_with_the_rows(spark):
    rng = np.random.default_rng(2)
    leaves = []
    for n in (200, 800):
        points = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 6)))]
        points += [(n + i, [1.0] * 6) for i in range(60)]  # copies cannot be parted
        tree = X.grow(spark.createDataFrame(points, "id long, v array<double>"), "id", "v", 20)
        sizes = {r["node"]: r["n"] for r in tree.nodes.where("NOT inner").collect()}
        assert sum(sizes.values()) == len(points) == tree.rows.count()
        assert sorted(sizes.values())[-2] <= 20 and {r["node"] for r in tree.rows.select("node").distinct().collect()} == set(sizes)
        leaves.append(len(sizes))
    assert leaves[1] > 2 * leaves[0]


def test_zero_vectors_in_the_tree(spark):
    points = np.random.default_rng(3).normal(size=(60, 5))
    points[[4, 40]] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "doc_id long, v array<double>")
    got = rows(R.retrieve_dense(df.withColumnRenamed("doc_id", "query_id"), df, "query_id", "v", "doc_id", "v", 4, limits=B.Limits(9, 10**9)))
    points[[4, 40]] = 1e-300  # any direction: scores of zero vectors are zero
    unit = points / np.where(np.arange(60)[:, None] % 36 == 4, np.inf, np.linalg.norm(points, axis=1, keepdims=True))
    scores = np.round(unit @ unit.T, 9)
    assert got == [(i, r + 1, int(j), round(float(scores[i, j]), 6) + 0.0) for i in range(60) for r, j in enumerate(np.lexsort((np.arange(60), -scores[i]))[:4])]


def random_rows(rng, n, width, heavy=3):
    lengths = rng.integers(0, 30, n)
    terms = [np.sort(rng.choice(width, l, replace=False, p=None)) for l in lengths]
    weights = [rng.random(l) ** heavy for l in lengths]
    weights = [w / (np.linalg.norm(w) or 1) for w in weights]
    return lengths, np.concatenate(terms).astype(np.int64), np.concatenate(weights)


@pytest.mark.parametrize("seed", range(6))
def test_impact_lists_equal_all_products(monkeypatch, seed):
    rng, width, k = np.random.default_rng(seed), 60, 3
    if seed % 2:
        monkeypatch.setattr(I, "_ENTRIES", 50)
        monkeypatch.setattr(I, "_CELLS", 400)
    docs, asked = random_rows(rng, 150, width), random_rows(rng, 40, width)
    dense = lambda x: np.array([np.bincount(t, weights=w, minlength=width) for t, w in zip(
        np.split(x[1], np.cumsum(x[0])[:-1]), np.split(x[2], np.cumsum(x[0])[:-1]))])
    scores = dense(asked) @ dense(docs).T
    least = np.where(rng.random(40) < 0.5, -np.inf, np.sort(scores, axis=1)[:, -k])  # nothing known, or the very score of the k-th
    found, read, held = {}, 0, 0
    for start, query, row, score, h, r in I.search_block(I.Lists(*docs), *asked, least, k):
        held, read = held + h.sum(), read + r.sum()
        for q, d, s in zip(query, row, score):
            found.setdefault(q + start, []).append((-round(s, 9), d))
            assert s == pytest.approx(scores[q + start, d], abs=1e-9)
    for q in range(40):
        want = [(-round(s, 9) + 0.0, d) for s, d in sorted(((scores[q, d], d) for d in range(150)), key=lambda x: (-round(x[0], 9), x[1]))[:k] if s > 1e-12]
        assert sorted(found.get(q, []))[:len(want)] == want


def test_less_than_half_of_the_entries_is_read(spark):
    """On the given texts: the pruned search reads or probes under half of what shares a term, and finds the same."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    index = R.fit_index(docs, "doc_id", "text").written()
    held, read = R.entries_read(index, items, "item_id", "text", B.Limits(2500, 10**9)).first()
    assert 0 < read < held / 2
    whole, cut = (R.search(index, items, "item_id", "text", limits=x).withColumnRenamed("item_id", "query_id") for x in (None, B.Limits(2500, 10**9)))
    assert rows(cut) == rows(whole)


@pytest.mark.parametrize("block", [20_000, 4])
def test_repeated_ids_raise_whatever_the_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    docs, queries = frames(spark)
    for q, d in ((queries.unionByName(queries.limit(1)), docs), (queries, docs.unionByName(docs.limit(1)))):
        with pytest.raises(Exception, match="needs its own id"):
            R.retrieve_sparse(q, d, "query_id", "text", "doc_id", "text", 3).collect()


def test_odd_vectors_take_no_part(spark):
    vectors = [[1.0, 0.0], None, [1.0], [1.0, 2.0, 3.0], [0.0, 1.0], [None, 1.0], [float("nan"), 0.0], [float("inf"), 0.0], []]
    df = spark.createDataFrame(list(enumerate(vectors)), "doc_id long, v array<double>")
    got = rows(R.retrieve_dense(df.withColumnRenamed("doc_id", "query_id"), df, "query_id", "v", "doc_id", "v", 3))
    assert got == [(0, 1, 0, 1.0), (0, 2, 4, 0.0), (4, 1, 4, 1.0), (4, 2, 0, 0.0)]


def test_weights_are_map_only(spark, plan):
    docs, _ = frames(spark)
    text = plan(FE.tfidf_weights(docs, "doc_id", "text", FE.fit_vocabulary(docs, "doc_id", "text")), "simple")
    assert "Exchange" not in text and "Window" not in text


def test_a_query_is_sent_to_nodes_not_to_leaves(spark, monkeypatch):
    """Where nothing can be pruned, a query and its vector travel once per searched node, however many leaves that has."""
    points = np.random.default_rng(8).normal(size=(300, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "doc_id long, v array<double>")
    sent, compare = [], X.compare
    monkeypatch.setattr(X, "compare", lambda asked, *rest: sent.append(asked.count()) or compare(asked, *rest))
    for group in (1000, 150):
        sent.clear()
        monkeypatch.setattr(X, "GROUP_ROWS", group)
        got = rows(R.retrieve_dense(df.withColumnRenamed("doc_id", "query_id"), df, "query_id", "v", "doc_id", "v", 3, limits=B.Limits(10, 10**9)))
        assert got == dense_brute(points, 3)
        assert sum(sent) <= (300 if group == 1000 else 300 * 64)
    assert len(sent) == 2


@pytest.mark.parametrize("seed", range(6))
def test_leaves_searched_in_single_precision_give_the_exact_best(monkeypatch, seed):
    rng, k = np.random.default_rng(seed), 4
    monkeypatch.setattr(X, "_EXACT", 7 if seed % 2 else 1000)
    monkeypatch.setattr(X, "_CHUNK_ROWS", (5, 60, 1000)[seed % 3])
    vectors = rng.normal(size=(200, 8))
    vectors[50:90] = vectors[3]  # more copies than k
    vectors[90:110] = vectors[4] + rng.normal(scale=1e-9, size=(20, 8))  # nearer to each other than single precision tells
    vectors[150] = 0
    vectors /= np.where(np.linalg.norm(vectors, axis=1) == 0, 1, np.linalg.norm(vectors, axis=1))[:, None]
    leaf = rng.integers(0, 12, 200)
    asked = vectors[rng.permutation(200)[:70]]
    scores = np.round(asked @ vectors.T, 9)
    want = [np.lexsort((np.arange(200), -s))[:k] for s in scores]
    least = np.where(rng.random(70) < 0.5, -np.inf, [s[w[-1]] for s, w in zip(scores, want)])
    query, row, score = X.search_leaves(asked, vectors, leaf, least, k)
    for q in range(70):
        found = sorted((-round(s, 9), r) for r, s in zip(row[query == q], score[query == q]))
        assert [-s for s, _ in found] == pytest.approx(scores[q, want[q]], abs=2e-9)
        near = {r for r in range(90, 110)} | {4}
        assert [r for _, r in found if r not in near] == [r for r in want[q] if r not in near]


def test_terms_are_counted_over_many_rows_at_once(spark, plan, monkeypatch):
    """Whatever the slices, null and empty texts and rows whose ends must not make a bigram with the next row."""
    texts = [*DOCS, None, "", "x", "the the the", "ab", "ab cd", *[f"ab w{i % 3} cd" for i in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for most, stop, ngrams in ((2_000_000, (), 2), (7, ("the", "is"), 2), (7, (), 1)):
        monkeypatch.setattr(FE, "_TOKENS", most)
        counts = [Counter(t for t in terms(x or "", stop) if ngrams == 2 or " " not in t) for x in texts]
        got = FE.term_frequencies(docs, "doc_id", "text", stop, ngrams)
        want = {t: (sum(t in c for c in counts), sum(c[t] for c in counts)) for c in counts for t in c}
        assert {r["term"]: (r["df"], r["total"]) for r in got.collect()} == want
        assert "Generate" not in plan(got)
    assert "ArrowEvalPython" not in plan(got) and plan(got).count("MapInArrow") >= 1


def test_weights_need_no_vectors(spark, plan):
    docs, _ = frames(spark)
    vocabulary = FE.fit_vocabulary(docs, "doc_id", "text", 20000)
    weights = FE.tfidf_weights(docs, "doc_id", "text", vocabulary)
    assert "UDF(" not in plan(weights, "extended")  # no stage that turns an array of terms into a vector
