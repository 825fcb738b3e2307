"""Every operator on odd rows, and against brute force or a library."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from caselight.llm import chains, chat, decontaminate, language, licenses, links, neardup, neighbours, pieces, privacy, tokens, toxicity

SPM = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(250_000))  # more than one slice
ODD = [None, "", " ", "\n\n", "!!!", "ok", "Ünïcode ▁ text\u00a0x", "<s> </s> <|endoftext|> [INST]", "a\\b", "x" * 3000, LONG, "日本語 ok", "12 345"]
SCHEMA = "doc_id long, text string, n_tokens int, keys int, score double, copy string, label int, row int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, ""), (5, "ok"), (None, "no id"), (99, "ok")]
    return spark.createDataFrame([(i, t, 1, 2, 0.5, "c", 3, 4) for i, t in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_counts_equal_the_library(odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    got = tokens.count_tokens(odd, WORD).collect()
    assert len(got) == len(ODD) + 4 and tokens.count_tokens(empty, WORD).count() == 0
    for row in got:
        text = ("no id" if row.doc_id is None else "ok" if row.doc_id == 99 else ODD[row.doc_id]) or ""
        assert row.n_bytes == len(text.encode())
        assert row.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert row.over_limit == (row.n_tokens > 2048)


def test_codec_equals_the_library(odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SPM)
    assert pieces.encode_decode(empty, SPM).count() == 0
    for row in pieces.encode_decode(odd, SPM, with_ids=True).collect():
        text = ("no id" if row.doc_id is None else "ok" if row.doc_id == 99 else ODD[row.doc_id]) or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert row.ids == ids and row.decoded == library.decode(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_decoder_equals_the_library_on_any_ids():
    codec, random = pieces.PieceCodec(SPM), np.random.default_rng(1)
    for _ in range(500):
        ids = [int(i) for i in np.where(random.random(9) < 0.5, random.integers(3, 259, 9), random.integers(1, 32000, 9))]
        assert codec.decode(ids) == codec.library.decode(ids)


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            total = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == 2 and 12 <= len(digits) <= 19 and total % 10 == 0 or kind == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    random = np.random.default_rng(3)
    parts = ["1", "23", "4.", "5", "0", "255", ".", " ", "-", "(", ")", "+", "a", "@", "x.", "_", "@b.c", "79927398713", "é", "1.1.1.1"]
    for _ in range(20_000):
        text = "".join(random.choice(parts, random.integers(1, 18)))
        assert privacy.base_spans(text) == plain_spans(text)


def test_a_term_that_names_an_entity_is_found(spark, odd, empty):
    fill = [f"common words number{i} stand here and there" for i in range(60)]
    texts = fill + [f"the mail of Zebulon is {a} a@b.org {b} and so on" for a, b in (("one", "two"), ("three", "four"), ("five", "six"), ("my", "own"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in privacy.find_private(docs).collect()}
    text = texts[60]
    assert f"term:{text.index('Zebulon')}:{text.index('Zebulon') + 7}" in rows[60].spans
    assert all(r.spans == "" for i, r in rows.items() if i < 60)
    assert {r.doc_id: r for r in privacy.find_private(docs, broadcast_rows=0).collect()} == rows
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert "Zebulon" not in clean[60] and "<EMAIL>" in clean[60] and clean[3] == texts[3]
    assert privacy.find_private(odd).count() == odd.count() and privacy.find_private(empty).count() == 0
    assert privacy.sanitise(odd).columns == odd.columns


def test_a_far_name_is_found_and_marked_everywhere(spark):
    fill = [f"common words number{i} stand here and there" for i in range(60)]
    gap = " ".join(["common words stand here and there"] * 9)  # 54 words
    texts = fill + [f"Zebulon {gap} {a} a@b.org {b} {gap} zebulon" for a, b in (("here", "words"), ("there", "stand"), ("and", "common"), ("words", "here"))]
    texts += ["here and there Zebulon"]
    rows = {r.doc_id: r for r in privacy.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        places = [f"term:{m.start()}:{m.end()}" for m in re.finditer("(?i)zebulon", text)]
        assert [x for x in rows[i].spans.split(",") if x.startswith("term")] == places and rows[i].n_terms == len(places)
    clean = [r.text for r in privacy.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert not any("zebulon" in t.lower() for t in clean)


def test_chats_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo </s>"), (2, 2, "user", "a\\[INST]<|x|>"),
            (3, 0, None, None), (None, 0, "user", "hi"), (4, 0, "user", "z"), (4, 0, "user", "z"), (-7, None, "assistant", "\\</s>[INST] ok [/INST]")]
    turns, tree = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = sorted(tree.collect(), key=lambda r: r.path)
    assert len(nodes) == 7  # shared beginnings once
    place = 0
    for node in nodes:
        assert node.start == place and node.end - node.start == len(node.segment)
        assert node.position == sum(x.end - x.start for x in node.attends)
        assert [n.path for n in nodes if node.path.startswith(n.path) and n.path != node.path] == [
            next(n.path for n in nodes if n.start == x.start) for x in node.attends]
        place = node.end
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    for row in chat.read_back(turns, tree).collect():
        own = sorted(convs[row.conv])
        assert row.n_turns == len(own)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        learnt = "".join(x for _, r, x in own if r == "assistant")
        assert (row.loss_chars, row.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(*chat.format_chats(none)).count() == 0


def test_long_conversations_in_chains(spark):
    rows = [(None, i, "user" if i % 2 else "assistant", f"turn {i} [INST]") for i in range(6_000)] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} [INST]") for i in range(9)]
    rows += [(2, i, "user", f"turn {i if i < 3 else -i}") for i in range(6)] + [(3, 0, "user", "turn 0"), (3, 1, "user", "turn 1"), (3, 2, None, None), (5, 0, "user", "turn 0")]
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, r or "", x or ""))
    turns = chains.chained_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    tree = chains.chained_tree(turns).cache()
    nodes = sorted(tree.collect(), key=lambda r: r.start)
    assert len(nodes) == len({tuple(sorted(own)[:i + 1])[-1:] + (i, hash(tuple(sorted(own)[:i + 1]))) for own in convs.values() for i in range(len(own))})
    by_id, place, seen = {n.id: n for n in nodes}, 0, []
    for node in nodes:
        assert node.start == place and node.end - node.start == len(node.segment)
        seen = seen[:node.n - 1]  # depth first: the parent is the last node one level up
        assert (seen[-1] if seen else None) == node.parent
        up = [by_id[i] for i in seen] if node.n < 20 or node.n % 500 == 0 else None
        if up is not None:
            assert node.position == sum(x.end - x.start for x in up)
            assert {p for x in node.attends for p in range(x.start, x.end)} == {p for x in up for p in range(x.start, x.end)}
        assert len(node.attends) <= 3 and len(node.id) < 48
        seen.append(node.id)
        place = node.end
    out = {row.conv: row for row in chains.chained_read_back(turns, tree).collect()}
    assert set(out) == set(convs)
    for c, own in convs.items():
        own = sorted(own)
        assert out[c].n_turns == len(own) and out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256("".join(x for _, r, x in own if r == "assistant").encode()).hexdigest()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = chains.chained_turns(none)
    assert chains.chained_read_back(turns, chains.chained_tree(turns)).count() == 0


def test_exact_neighbours(spark):
    random = np.random.default_rng(5)
    points = random.normal(size=(900, 8)).round(1)
    points[300:600] = points[300]  # a third are equal
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [math.nan] * 8), (2004, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0"), factor=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 900, 50):
        score = neighbours.cosines(points, points[q])
        order = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:5]
        assert got[q] == order
    assert set(got) == set(range(0, 900, 50)) and neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_languages(spark, odd, empty):
    words = {"en": "the and of to in with", "de": "der die und nicht mit ein", "fr": "le la et les une dans", "es": "el los y que una para"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(w.split(), 30)), lang) for i, (lang, w) in enumerate(list(words.items()) * 20)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), iterations=8)
    got = language.predict_languages(spark.createDataFrame([(i, w) for i, w in enumerate(words.values())], "doc_id long, text string"), model)
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == list(words)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_languages(odd, model).collect()}
    assert all(out[i] == ("und", 0.0) for i in (0, 1, 2, 3, 4, 12)) and all(0 <= s <= 1 for _, s in out.values())
    assert language.fit_languages(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert language.predict_languages(empty, None).count() == 0 and language.keep_identified(odd, model).columns == odd.columns


def test_licenses(spark, odd, empty):
    docs = spark.createDataFrame([(1, "code\nReleased under the MIT License."), (2, "This work is licensed under the GNU General Public License, version 4."),
                                  (3, "Licensed under CC BY-NC 4.0.\n" + LONG[:9000] + " Licensed under CC BY 4.0."), (4, "the license of poets")], "doc_id long, text string")
    got = [(r.doc_id, r.license) for r in licenses.scan_licenses(docs).orderBy("doc_id", "start").collect() if r.confirmed]
    assert got == [(1, "MIT"), (3, "CC-BY-NC-4.0"), (3, "CC-BY-4.0")]
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_licenses_side_by_side(spark):
    short, long = (licenses.TEMPLATES["Apache-2.0"][0], licenses.TEMPLATES["MIT"][1])
    filler = "the license of poets is a word in a line of words and of songs "
    texts = ["Released under the MIT License. " + short, "Released under the MIT License.\n" + short + "\nReleased under the MIT License.",
             filler * 22 + long, "Copyright 2020 Someone. All rights reserved.", licenses.TEMPLATES["CC-BY-SA-4.0"][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.doc_id, r.license, texts[r.doc_id][r.start:r.end]) for r in licenses.scan_licenses(docs).collect() if r.confirmed]
    mit = "Released under the MIT License"
    assert sorted(x[:2] for x in got) == [(0, "Apache-2.0"), (0, "MIT"), (1, "Apache-2.0"), (1, "MIT"), (1, "MIT"), (2, "MIT"),
                                          (3, "All-Rights-Reserved"), (4, "CC-BY-SA-4.0")]
    assert [x[2] for x in got if x[0] == 1] == [mit, short[:-1], mit] and next(x[2] for x in got if x[0] == 2) == long[:-1]


def shingle_counts(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def test_near_duplicates_equal_brute_force(spark, odd, empty):
    random, texts = np.random.default_rng(2), []
    for _ in range(12):
        base = [f"t{random.integers(500)}" for _ in range(60)]
        for edits in (0, 0, 1, 1, 2, 3, 6):
            copy = list(base)
            for at in random.integers(0, 60, edits):
                copy[at] = f"e{random.integers(500)}"
            texts.append(" ".join(copy))
    sets = [shingle_counts(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if texts[i] == texts[j] or both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.class_id for r in got] == label
    rows = [(r.doc_id, r.class_id) for r in neardup.near_duplicates(odd).collect()]
    assert len(rows) == odd.count() and (None, None) in rows and (99, 5) in rows and (1, 0) in rows
    assert neardup.near_duplicates(empty).count() == 0


def test_an_id_with_two_texts_keeps_both(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in ("left", "right"))
    rows = [(-1, "alone in the world of words"), (3, one), (3, two), (3, two), (4, one), (5, two), (12, two), (None, one)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], (3, one), (3, two), (None, one)], key=str)


def test_large_mixed_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS_PER_BUCKET", 0)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    base = [f"t{i}" for i in range(80)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(12)]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_contained_items(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "two words"), (3, None), (4, "!!"), (None, "x y")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, LONG[:200_000] + " Alpha beta, gamma delta epsilon zeta eta theta iota kappa " + LONG[:5000]), (2, "alpha beta gamma delta epsilon"),
                                  (3, "here are two words"), (None, "two words")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contained(docs, items).collect()}
    assert got == {(1, 1), (3, 2)}
    assert decontaminate.find_contained(odd, items).count() == 0 and decontaminate.find_contained(empty, items).count() == 0
    assert decontaminate.find_contained(odd, items.limit(0)).count() == 0


def test_toxicity_held_out(spark, odd, empty):
    random = np.random.default_rng(8)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "to", "vi", "we")]
    rows = [(i, " ".join(random.choice(plain + ["gragh"] * 3 * (i % 4 == 0), 60)), int(i % 4 == 0)) for i in range(240)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, t) for i, _, t in rows if i < 180], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs.drop("toxic"), labels)
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    toxic, ordinary = ([out[i] for i, _, t in rows if i >= 180 and t == c] for c in (1, 0))
    assert min(toxic) > max(ordinary) and max(ordinary) < 0.7 and sum(s >= 0.7 for s in toxic) >= 0.8 * len(toxic)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.fit_toxicity(docs.drop("toxic"), labels.limit(0)) is None and toxicity.score_toxicity(empty, None).count() == 0


def test_a_long_labelled_text_ends_no_class(spark):
    random = np.random.default_rng(9)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "to", "vi", "we")]
    rows = [(i, " ".join(random.choice(plain + ["gragh"] * 3 * (i % 4 == 0), 60)), int(i % 4 == 0)) for i in range(240)]
    ids = spark.createDataFrame([(i,) for i, _, t in rows if i < 180 and t], "doc_id long")
    first = ids.orderBy(F.xxhash64("doc_id", F.lit(10))).first().doc_id  # the first of its class in the order of the sample
    rows = [(i, (t + " ") * (7_000_000 // len(t)) if i == first else t, label) for i, t, label in rows]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows if i < 180], "doc_id long, toxic int")
    sample = {r.id for r in toxicity.bounded_sample(docs, labels, "doc_id", "text", "toxic", rows=4_000).collect()}
    assert sample == set(range(180))
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    toxic, ordinary = ([out[i] for i, _, t in rows if i >= 180 and t == c] for c in (1, 0))
    assert min(toxic) > max(ordinary) and sum(s >= 0.7 for s in toxic) >= 0.8 * len(toxic)


def test_a_worker_holds_the_tables_of_one_stage(monkeypatch):
    import sys
    import weakref

    from caselight.llm.words import worker_state

    class Tables:
        pass

    monkeypatch.delitem(sys.modules, "_caselight_worker", raising=False)
    first = weakref.ref(worker_state("codec", Tables))
    assert first() is not None and worker_state("codec", Tables) is first()
    second = worker_state("word tables", Tables)
    assert first() is None and worker_state("word tables", Tables) is second
    sys.modules.pop("_caselight_worker")


def test_toxicity_counts_stay_in_the_tasks(spark, monkeypatch):
    """The driver gets no row per sequence of the sample, and what it leaves out of the model changes no difference."""
    random = np.random.default_rng(10)
    rows = [(i, " ".join(str(x) for x in random.choice(["gragh", "kara", "lolo", "mivi"], 30)) + f" {chr(97 + i % 26)}{i * 7919}x" * 3, int(i % 3 == 0)) for i in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got, plain = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: got.append(plain(self)) or got[-1])
    monkeypatch.setattr(toxicity, "DISCOUNTS", (3.0,))
    model = toxicity.fit_toxicity(docs, labels)
    sample = {r.id: r for r in toxicity.bounded_sample(docs, labels, "doc_id", "text", "toxic", 4_000).collect()}
    batch = [pa.RecordBatch.from_arrays([pa.array([t for i, t, _ in rows if sample[i].fold > 0 and sample[i].label == c]), pa.array([c] * sum(r.fold > 0 and r.label == c for r in sample.values())),
                                         pa.array([r.weight for i, _, _ in rows if (r := sample[i]).fold > 0 and r.label == c])], ["text", "label", "weight"]) for c in (0, 1)]
    counts = pa.Table.from_batches(toxicity._counted(iter(batch))).group_by(["label", "key"]).aggregate([("n", "sum")])
    label, key, n = (counts.column(c).to_numpy() for c in ("label", "key", "n_sum"))
    assert max(t.num_rows for t in got) < len(key) / 2
    every = np.concatenate([k for _, _, k, _ in toxicity.sequences(pa.array([t for _, t, _ in rows]))])
    five, corpus = np.unique(key & ((1 << 40) - 1)), np.unique(every & ((1 << 40) - 1)) & ((1 << 32) - 1)
    whole = toxicity._model(*toxicity._arranged(label, key, n, five, toxicity._shared(five, *np.unique(corpus, return_counts=True))), 3.0)
    assert len(model.six) < len(whole.six) / 2
    assert model.differences(every) == pytest.approx(whole.differences(every), abs=1e-12)


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs.where(F.col("text").rlike(r"\p{L}"))).collect()}
    held = {r.doc_id for r in decontaminate.find_contained(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids == {i for i, c in classes.items() if i == c} - held


@pytest.mark.parametrize("kind", ["decimal(20,0)", "tinyint", "double", "date", "string"])
def test_ids_of_any_type(spark, monkeypatch, kind):
    monkeypatch.setattr(neardup, "PAIRS_PER_BUCKET", 0)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    base = [f"t{i}" for i in range(80)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(6)] + ["something else"]
    days = "date_add(date'2020-01-01', CAST(n AS INT))" if kind == "date" else f"CAST(n AS {kind})"
    docs = spark.createDataFrame(list(enumerate(texts)), "n long, text string").selectExpr(f"{days} AS doc_id", "text")
    got = neardup.near_duplicates(docs)
    assert got.select("class_id").distinct().count() == 2 and got.schema["class_id"].dataType == docs.schema["doc_id"].dataType
    assert neardup.keep_first(docs).count() == 2


def test_keeping_first_with_odd_columns(spark):
    long_text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, long_text, "mine", {"a": 1}, 1), (3, long_text, "mine", {"a": 1}, 1), (3, long_text, "other", {"b": 2}, 2), (3, "a second text", "x", None, 3),
            (-5, long_text, "low", {}, 4), (None, long_text, "no id", None, 5), (7, None, "null", None, 6), (9, "", "empty", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, class_id map<string,int>, id int")
    got = sorted(((r.doc_id, r.text, r._key, r.class_id) for r in neardup.keep_first(docs).collect()), key=str)
    assert got == sorted([(-5, long_text, "low", {}), (3, "a second text", "x", None), (None, long_text, "no id", None), (7, None, "null", None)], key=str)
    alone = docs.where("doc_id = 3 AND _key <> 'x'")
    assert [r.class_id for r in neardup.keep_first(alone).collect()] == [{"a": 1}]
    cents = docs.where("doc_id IS NOT NULL").withColumn("doc_id", (F.col("doc_id") - F.lit(8)).cast("decimal(12,2)"))
    assert {float(r.doc_id) for r in neardup.keep_first(cents).collect()} == {-13.0, -5.0, -1.0}
    assert neardup.keep_first(docs.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "an item that nothing holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd, empty = (df.withColumn("lang", F.when(F.col("text").isNotNull(), F.lit("en"))) for df in (odd, empty))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        got = stage(spark, odd, str(tmp_path))
        assert 0 < got.count() <= odd.count(), name
        if name != "piece_codec":
            assert got.columns == odd.columns, name
        if name in ("decontamination", "private_data", "piece_codec"):
            assert got.count() == odd.count(), name


def test_segments_merged_together_equal_one_by_one():
    codec, random = pieces.PieceCodec(SPM), np.random.default_rng(2)
    letters = list("abcdethr éöñß▁▁\n.,-日本1'<s>") + ["\U0001F600", "\x00", "́"]
    segments = ["".join(random.choice(letters, random.integers(1, 60))) for _ in range(4000)] + ["▁", "the" * 12]
    assert codec.merge_many(segments) == [codec.merge(s) for s in segments]


def test_slices_of_short_texts_are_bounded():
    import pyarrow as pa

    texts = pa.array([f"short text number {i}" for i in range(10_000)] + [None, "", LONG])
    sizes = [len(rows) for rows in language.trigram_features(texts)]
    assert sum(sizes) == len(texts) and max(sizes) <= language.ROWS
    whole = np.concatenate([rows for rows in language.trigram_features(texts.slice(9_900))])
    apart = np.concatenate([np.concatenate(list(language.trigram_features(texts.slice(i, 1)))) for i in range(9_900, len(texts))])
    assert np.allclose(whole, apart)


def test_the_votes_equal_plain_one_versus_one(spark):
    texts = {"en": "the house and the garden of the king", "de": "das haus und der garten des königs", "fr": "la maison et le jardin du roi"}
    docs = spark.createDataFrame([(i, f"{t} {i}", l) for i, (l, t) in enumerate(list(texts.items()) * 6)], "doc_id long, text string, lang string")
    model = language.fit_languages(docs)
    import pyarrow as pa

    features = np.concatenate(list(language.trigram_features(pa.array([r.text for r in docs.orderBy("doc_id").collect()]))))
    langs, scores = model.predict(features)

    def winner(names, prefix, x):
        chance = {(a, b): 1 / (1 + math.exp(-3 * float(x @ w + bias))) for (a, b), (w, bias) in model.machines.items()
                  if a.removeprefix(prefix) in names and b.removeprefix(prefix) in names and a.startswith(prefix)}
        votes = {n: sum((p if a == prefix + n else 1 - p) > 0.5 for (a, b), p in chance.items() if prefix + n in (a, b)) for n in names}
        best = max(names, key=lambda n: votes[n])
        return best, min([p if a == prefix + best else 1 - p for (a, b), p in chance.items() if prefix + best in (a, b)], default=1.0)

    for row, lang, score in zip(features, langs, scores):
        family, sure = winner(sorted(model.families), "family ", row)
        best, inner = winner(model.families[family], "", row)
        assert lang == best and score == pytest.approx(sure * inner)
    assert langs == [l for l in texts] * 6


def notices_of(matcher, texts):
    return [[(s, e, f["license"]) for s, e, f in matcher.notices(t, 0.15)] for t in texts]


def test_ranking_by_compression_finds_what_comparing_all_templates_finds(monkeypatch):
    import pyarrow.parquet as pq

    short, long = licenses.TEMPLATES["Apache-2.0"][0], licenses.TEMPLATES["MIT"][1]
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t and re.search(licenses.CUES, t)]
    texts += ["Released under the MIT License. " + short + "\n" + long, long + long, "words " * 300 + short + " words" * 300]
    ranked, every, turned = (licenses.Matcher(licenses.TEMPLATES) for _ in range(3))
    monkeypatch.setattr(every, "rank", lambda block: [(1, at) for at in range(len(every.known))])
    n, rank = len(turned.known), turned.rank
    monkeypatch.setattr(turned, "rank", lambda block: [(saved, (at + n // 2) % n) for saved, at in rank(block)][:2])
    found = notices_of(ranked, texts)
    assert found == notices_of(every, texts) and sum(map(len, found)) > len(texts) // 2
    assert notices_of(turned, texts) != found  # the ranking decides: with the wrong templates in front notices are lost


KEYS = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]


def test_keys_are_found():
    text = f'token = "{KEYS[0]}" and aaaaaaaaaaaaaaaaaaaaaaaa1234 plainwordthatisverylongindeed 12345678901234567890123 x{KEYS[1]}@b.org'
    assert [text[s:e] for s, e in privacy.key_spans(text, privacy.base_spans(text))] == [KEYS[0]]
    assert privacy.rewritten(text, []).startswith('token = "<KEY>" and aaaa')


def test_terms_of_a_kind_equal_brute_force(spark):
    random = np.random.default_rng(9)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    texts = []
    for i in range(600):
        text = " ".join(random.choice(words, 12, p=np.arange(400, 0, -1) / np.arange(1, 401).sum()))
        kind = i % 15
        texts.append(f"{text} token = {KEYS[i // 15]} {random.choice(words)}" if kind == 0 else
                     f"{text} write to {'contact' if i % 2 else 'mail'} u{i}@x{i}.org now" if kind == 1 else text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in privacy.find_private(docs).collect()}
    held = [{w.lower() for w in privacy.TERM.findall(re.sub(r"u\d+@x\d+\.org", " ", t)) if w not in KEYS} for t in texts]
    strong = set()
    for kind in (0, 1):
        named = [i for i in range(600) if i % 15 == kind]
        information = math.log2(600 / len(named))
        for w in set().union(*held):
            n_term, n_both = sum(w in h for h in held), sum(w in held[i] for i in named)
            if n_both >= 3 and (certain := n_both - 2 * math.sqrt(n_both)) > 0 and math.log2(certain * 600 / (len(named) * n_term)) >= 0.75 * information:
                strong.add(w)
    assert {"token", "write", "to", "now"} <= strong
    for i, text in enumerate(texts):
        terms = [s.split(":") for s in found[i].spans.split(",") if s.startswith("term")]
        assert {text[int(a):int(b)] for _, a, b in terms} == strong & held[i]
        assert found[i].n_keys == (i % 15 == 0) and found[i].n_spans == len([s for s in found[i].spans.split(",") if s])
        if i % 15 > 1:
            assert found[i].spans == ""


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_components_join_edges_inside_tasks_first(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    chain = [(i, i + 1) for i in range(1, 400)]
    loose = [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (150, 2))]
    edges = spark.createDataFrame(chain + loose, "a long, b long").repartition(4).selectExpr(f"cast(a AS {kind}) AS a", f"cast(b AS {kind}) AS b")
    low = {}
    for a, b in [*chain, *loose] * 400:
        if a != b:
            names = [n if kind != "string" else str(n) for n in (a, b)]
            least = min(*[low.get(n, n) for n in names])
            for n in names:
                low[n] = least
    written = []
    monkeypatch.setattr(links, "settled", lambda df, own=links.settled: written.append(1) or own(df))
    got = {r["id"]: r["label"] for r in links.components(edges).collect()}
    assert got == low and len(written) == 2  # no rounds: one task holds them all
    if kind == "string":
        monkeypatch.setattr(links, "EDGES_PER_TASK", 300)
        assert {r["id"]: r["label"] for r in links.components(edges).collect()} == low
    assert links.components(edges.limit(0)).count() == 0
