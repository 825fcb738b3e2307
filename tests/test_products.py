"""Many queries against a block: products by matrix and lists, against all products."""

import numpy as np
import pytest

from caselight.operators import blocks as B
from caselight.operators import impact as I
from caselight.operators import products as M
from caselight.operators import retrieval as R


def sparse(rng, rows, width, most):
    """Unit rows with frequent small terms, some empty and some equal."""
    parts = [np.unique((rng.random(rng.integers(0, most)) ** 3 * width).astype(int)) for _ in range(rows)]
    parts[1] = parts[0]
    weights = [(p + 1.0) / np.sqrt(((p + 1.0) ** 2).sum()) if len(p) else np.zeros(0) for p in parts]
    dense = np.zeros((rows, width))
    for i, (p, w) in enumerate(zip(parts, weights)):
        dense[i, p] = w
    return (np.array([len(p) for p in parts]), np.concatenate(parts).astype(np.int64), np.concatenate(weights)), dense


@pytest.mark.parametrize("listed", [0, 30, 10**9])  # no matrix, both, no lists
@pytest.mark.parametrize("known", [False, True])
def test_products_hold_the_best(monkeypatch, listed, known):
    monkeypatch.setattr(M, "_LISTED", listed)
    monkeypatch.setattr(M, "_CELLS", 2000)
    monkeypatch.setattr(M, "_ENTRIES", 50)
    rng, k = np.random.default_rng(3), 3
    corpus, d = sparse(rng, 150, 60, 12)
    queries, q = sparse(rng, 40, 70, 12)
    all_scores = np.round(q[:, :60] @ d.T, 9)
    least = np.sort(all_scores, axis=1)[:, -k] if known else np.full(len(q), -np.inf)
    found = {}
    for start, query, row, score in M.search_products(corpus, queries, least, k):
        for a, b, s in zip(query + start, row, score):
            found.setdefault(int(a), []).append((-round(float(s), 9), int(b)))
    for i, scores in enumerate(all_scores):
        want = sorted((-s, j) for j, s in enumerate(scores) if s > 0)[:k]
        assert sorted(found.get(i, []))[:k] == want


def test_many_messages_meet_every_block_in_one_pass(spark, plan):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{x}" for x in (rng.random(n) ** 2 * 300).astype(int))
    docs = spark.createDataFrame([(i, words(8)) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, words(rng.integers(0, 9))) for i in range(M.MANY + 20)], "query_id long, text string")
    cut, whole = (R.retrieve_sparse(asked, docs, "query_id", "text", "doc_id", "text", 3, limits=x) for x in (B.Limits(40, 10**6), None))
    assert "_homes" not in plan(cut, "simple")
    rows = lambda f: [(r[0], r[1], r[2], round(r[3], 9)) for r in f.orderBy("query_id", "rank").collect()]
    assert rows(cut) == rows(whole)


def test_nothing_is_repeated_per_block(spark, plan, monkeypatch):
    """Many queries and a corpus of many blocks: each side is dealt once, tasks read pairs of packed blocks from the checkpoint."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in (rng.random(n) ** 2 * 200).astype(int))
    docs = spark.createDataFrame([(i, words(6)) for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, words(7)) for i in range(M.MANY)], "query_id long, text string")
    monkeypatch.setattr(I, "_PACKED", 300)  # more entries in a block than expected: several rows
    search = lambda q, limits: R.retrieve_sparse(q, docs, "query_id", "text", "doc_id", "text", 2, limits=limits)
    cut, whole = search(asked, B.Limits(20, 10**6)), search(asked, None)
    text = plan(cut, "simple")
    assert "_qb" not in text and "CartesianProduct" in text and text.index("CartesianProduct") > text.rindex("Exchange")
    rows = lambda f: [(r[0], r[1], r[2], round(r[3], 9)) for r in f.orderBy("query_id", "rank").collect()]
    assert rows(cut) == rows(whole)
    with pytest.raises(Exception, match="values of query_id repeat"):
        search(asked.unionByName(asked.limit(1)), B.Limits(20, 10**6)).count()
