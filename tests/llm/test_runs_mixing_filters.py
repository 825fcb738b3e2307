"""Periodic runs, mixing and the filter audit on odd rows, and against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselight.llm import filters, mixing, queries, runs
from caselight.llm.spaced import spaced_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(300_000))  # more than one slice, more than one append
ODD = [None, "", " ", "\x0b\x0c\r\n\t", "one", " a b  c\n", "x " * 30, "ab cd " * 20 + "end", "A1 $ " * 50, LONG, "a b c " * 9 + LONG[:900], "ok ok", "ok ok",
       "日本 語 " * 12, "q" * 5000]
CLASH = "doc_id long, text string, lang string, source string, size long, place long, shard int, target double, id int, mask int, part string, runs int, begin int, n int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, " a b  c\n"), (None, "no id"), (None, None), (99, "x " * 30), (5, "other")]
    return spark.createDataFrame([(i, t, None if i == 3 else "" if i == 4 else "en", None if i in (2, 9) else f"s{(i or 0) % 3}", 1, 2, 3, 0.5, 4, 5, "p", 6, 7, 8)
                                  for i, t in rows], CLASH).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def brute_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        start = None
        for i in range(len(words) - q + 1):
            if i < len(words) - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                if i - start + q >= max(least, times * q):
                    found.setdefault((start, i + q), q)  # a larger period of the same stretch is a multiple
                start = None
    return sorted((a, b - a, q) for (a, b), q in found.items())


@pytest.mark.parametrize("appended", [1, 7, 1 << 18])
def test_runs_equal_brute_force(monkeypatch, appended):
    monkeypatch.setattr(runs, "APPENDED", appended)
    random = np.random.default_rng(appended)
    for _ in range(60 if appended == 1 else 250):
        parts = []
        for _ in range(random.integers(1, 5)):
            parts.append(np.tile(random.integers(0, 3, random.integers(1, 30)), random.integers(1, 8)))
            parts.append(random.integers(0, 40, random.integers(0, 15)))
        words = np.concatenate(parts)
        assert runs.runs_of(words) == brute_runs(words.tolist())


def test_runs_where_wrapping_fingerprints_err(monkeypatch):
    word = np.array([bin(i).count("1") & 1 for i in range(2048)])  # a block and its complement have equal wrapping fingerprints
    tried = []
    monkeypatch.setattr(runs, "_Prime", lambda trial, real=runs._Prime: tried.append(trial) or real(trial))
    text = np.concatenate([word, 1 - word, word])
    assert runs.runs_of(text) == brute_runs(text.tolist()) == []
    three = np.concatenate([word, 1 - word] * 3)
    assert (0, len(three), 4096) in runs.runs_of(three)


def test_many_nested_runs_are_found_fast():
    a, b = "a", "b"
    while len(a) < 3000:
        a, b = a + b, a
    words = np.frombuffer(a.encode(), np.uint8)
    assert runs.runs_of(words) == brute_runs(words.tolist())
    assert runs.runs_of(np.zeros(100_000, int)) == [(0, 100_000, 1)]


def collapsed(words, found):
    dropped = {i for a, n, q in found for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def test_runs_of_texts(odd, empty):
    got = runs.periodic_runs(odd).collect()
    assert runs.periodic_runs(empty).count() == 0 and len(got) == odd.count()
    want = defaultdict(list)
    for i, t in [(r.doc_id, r.text) for r in odd.collect()]:
        words = WORD.findall(t or "")
        found = brute_runs(words) if len(words) < 1000 else [(0, 300_000, 4001)]
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want[i].append((len(words), found, best, " ".join(collapsed(words, found))))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed))
    assert {k: sorted(v, key=str) for k, v in have.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_op11_by_brute_force(spark, tmp_path):
    random = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 60, random.integers(0, 300))) for _ in range(120)] + ["a b " * 40, None]
    spark.createDataFrame([(i * 13, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for i, t in enumerate(texts):
        words, h = WORD.findall(t or ""), zlib.crc32(str(i * 13).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [words[j if j < a else a + (j - a) % p] for j in range(n)], changed + 1
        found = brute_runs(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        row = got[i * 13]
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(collapsed(words, found)).encode()).hexdigest()
    assert changed > 5 and sum(r.n_runs for r in got.values()) > 5


def test_words_of_slices():
    texts = pa.array([t for t in ODD] * 2)
    at = 0
    for words in spaced_words(texts.slice(1)):
        ids, (joined, places) = words.ids(), words.joined()
        for row in range(words.stop - words.first):
            want = WORD.findall(texts[1 + words.first + row].as_py() or "")
            assert [w.decode() for w in words.of_text(row)] == want
            assert joined[places[row]:places[row + 1]].tobytes().decode() == " ".join(want)
            own = ids[words.offsets[row]:words.offsets[row + 1]]
            assert len(set(own.tolist())) == len(set(want))
            at += 1
    assert at == len(texts) - 1


# --- mixing -------------------------------------------------------------------------------------------

def test_sainte_lague_equals_handing_out_one_by_one():
    random = np.random.default_rng(1)
    for _ in range(200):
        n = int(random.integers(1, 12))
        weights, most = random.integers(0, 9, n).tolist(), random.integers(0, 30, n).tolist()
        seats = int(random.integers(0, 120))
        want = [0] * n
        for _ in range(seats):
            left = [i for i in range(n) if want[i] < most[i] and weights[i] > 0]
            if not left:
                break
            want[max(left, key=lambda i: (weights[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(weights, most, seats).tolist() == want
    large = mixing.sainte_lague([3e12, 1e12, 2e12], [10**12] * 3, 6 * 10**9)
    assert large.tolist() == [3 * 10**9, 10**9, 2 * 10**9]


def test_capped_shares():
    assert mixing.capped_shares([100, 100, 100], [3, 1, 2], 1.5, 2.0).tolist() == [200.0, 250 / 3, 500 / 3]
    assert mixing.capped_shares([10, 1000, 0], [3, 1, 2], 1.5, 2.0).tolist() == [20.0, 1495.0, 0.0]
    assert mixing.capped_shares([0, 0], [3, 1], 1.5, 2.0).tolist() == [0.0, 0.0]


def mixed_docs(spark, n=900, sources=4):
    random = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(random.integers(0, 90))), None if i % 7 == 0 else f"s{min(i % 10, sources - 1)}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("block,shard,fanout", [(64, 1 << 16, 1024), (5, 200, 1024), (5, 200, 3)])
def test_the_mix_comes_near_its_targets(spark, monkeypatch, block, shard, fanout):
    monkeypatch.setattr(mixing, "FANOUT", fanout)
    docs = mixed_docs(spark)
    rows = mixing.mix_sources(docs, block_words=block, shard_words=shard).collect()
    again = mixing.mix_sources(docs.repartition(7), block_words=block, shard_words=shard).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    targets = mixing.capped_shares([sum(r.size for r in by[s]) for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)
    for s, target in zip(order, targets):
        size = sum(r.size for r in by[s])
        assert {(r.source_size, r.target) for r in by[s]} == {(size, target)}
        shards = max(1, -(-size // shard))
        assert abs(sum(r.taken for r in by[s]) - target) <= block * (2 * shards + 1)


def test_broadcast_or_not_the_same_mix(spark, monkeypatch):
    docs = mixed_docs(spark, 200)
    want = sorted(map(str, mixing.mix_sources(docs, block_words=7, shard_words=300).collect()))
    monkeypatch.setattr(mixing, "TABLE_BYTES", 0)
    assert sorted(map(str, mixing.mix_sources(docs, block_words=7, shard_words=300).collect())) == want


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix_sources(odd).collect()
    assert mixing.mix_sources(empty).count() == 0
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in odd.collect())
    assert all(r.taken == 0 for r in rows if not r.size) and {r.source for r in rows} == {None, "s0", "s1", "s2"}


# --- filters ------------------------------------------------------------------------------------------

def brute_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        own = [x for x in labels if i is not None and x[0] == i]
        fails.append((lang or "", f, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                c = Counter()
                for p, f, good, toxic in fails:
                    if p != part:
                        continue
                    alive = not any(f[x] for x in order[:step - 1])
                    c["kept"] += alive and not f[letter]
                    c["removed"] += alive and f[letter]
                    c["redundant"] += f[letter] and not alive
                    c["unique_fails"] += f[letter] and sum(f.values()) == 1
                    c["good_lost"] += alive and f[letter] and good
                    c["toxic_lost"] += alive and f[letter] and toxic
                shapley[part, letter] += c["removed"]
                out[part, order, step] = c
    return {(*k, *[v[c] for c in filters.COUNTS], shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark, odd, empty):
    labels = [(1, 1, 0), (4, 0, 1), (8, 1, 1), (8, 0, 0), (12, 1, 0), (None, 1, 1), (77, 1, 1), (99, None, 1)]
    labelled = spark.createDataFrame([(*x, 5, "y") for x in labels], "doc_id long, quality int, toxic int, mask int, part string")
    got = {tuple(r) for r in filters.audit_filters(odd, labelled).collect()}
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in odd.collect()], labels)
    assert got == want and len(got) == 2 * 600
    assert filters.audit_filters(empty, labelled).count() == 0
    assert filters.audit_filters(odd, labelled.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_the_audit_has_no_join_on_a_text_alone(odd, plan):
    text = plan(filters.with_copies(filters.text_failures(odd), 4), "simple")
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "hashpartitioning(digest" in text
