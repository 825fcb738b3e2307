import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caselight.operators import balls as X
from caselight.operators import clusters as C
from caselight.operators import features as FE
from caselight.operators import intents as I

TEXTS = [("battery drains", "p"), ("battery dead today", "p"), ("charge battery", "p"), ("refund order money", "q"), ("money back refund", "q"),
         ("screen crack", "r"), ("crack glass screen fall", "r"), ("battery screen", "r"), ("money charge", "q"), ("glass", "r")]


def train(spark):
    return spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(TEXTS)], "id long, text string, label string")


def test_regression_meets_the_objective(spark):
    """At the fitted point the gradient of sum(w * loss) + |beta|^2 / 2 is zero."""
    df = train(spark)
    model = I.fit_intent_model(df, "id", "text", "label", stop_words=())
    lr = model.stages.stages[-2]
    ready = model.stages.transform(FE.with_terms(df, "text", FE.Vocabulary(None, 0, (), 2), "_terms"))
    rows = ready.select("label", vector_to_array("_features").alias("x"), vector_to_array("_probability").alias("p")).collect()
    x, p = np.array([r["x"] for r in rows]), np.array([r["p"] for r in rows])
    labels = ["p", "q", "r"]
    y = np.array([[r["label"] == l for l in labels] for r in rows], float)
    weight = np.array([len(rows) / (3 * y[:, labels.index(r["label"])].sum()) for r in rows])
    gradient = ((p - y) * weight[:, None]).T @ x + lr.coefficientMatrix.toArray()
    assert np.abs(gradient).max() < 2e-2 and np.abs(((p - y) * weight[:, None]).sum(0)).max() < 2e-2


def test_balanced_weights_sum_to_n(spark):
    got = {r["label"]: r for r in I.balanced_weights(train(spark), "label").collect()}
    assert got["p"]["weight"] == pytest.approx(10 / 9) and sum(r["n"] * r["weight"] for r in got.values()) == pytest.approx(10)


def test_confidence_is_the_largest_probability(spark, tmp_path):
    df = train(spark)
    model = I.fit_intent_model(df, "id", "text", "label", stop_words=("today",))
    got = model.predict(df).collect()
    assert sum(r["intent"] == r["label"] for r in got) >= 9 and all(1 / 3 <= r["confidence"] <= 1 for r in got)
    model.save(str(tmp_path / "m"), spark)
    again = I.IntentModel.load(str(tmp_path / "m"), spark)
    assert again.stop_words == ("today",)
    assert [tuple(r) for r in again.predict(df).orderBy("id").collect()] == [tuple(r) for r in model.predict(df).orderBy("id").collect()]
    unknown = model.predict(spark.createDataFrame([("zzz",), (None,)], "text string")).collect()
    assert unknown[0]["confidence"] == unknown[1]["confidence"]


def test_one_label_raises(spark):
    with pytest.raises(ValueError):
        I.fit_intent_model(train(spark).where("label = 'p'"), "id", "text", "label")


def test_two_labels(spark):
    model = I.fit_intent_model(train(spark).where("label <> 'p'"), "id", "text", "label")
    assert {r["intent"] for r in model.predict(train(spark)).collect()} <= {"q", "r"}


def test_fixed_scores(spark):
    features = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "zzz", 1.0)], "id long, term string, weight double")
    coefficients = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "term string, label string, coefficient double")
    got = {r["id"]: r for r in I.score_linear(features, "id", coefficients, {"x": 0.5, "y": 0.0}).collect()}
    assert got[1]["intent"] == "y" and got[1]["confidence"] == pytest.approx(np.exp(2) / (np.exp(2) + np.exp(1.5)))
    assert got[2]["intent"] == "x" and got[2]["confidence"] == pytest.approx(np.exp(.5) / (1 + np.exp(.5)))


# --- clusters -----------------------------------------------------------------------

def blobs(seed=2, per=25):
    rng = np.random.default_rng(seed)
    centres = np.eye(6)[:4]
    points = np.concatenate([c + rng.normal(scale=0.08, size=(per, 6)) for c in centres] + [rng.normal(size=(12, 6))])
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def vectors(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")


def brute_density(points, eps, min_points, min_size):
    gap = np.round(2 - 2 * points @ points.T, 9)
    near = gap <= round(eps * eps, 9)
    core = near.sum(1) >= min_points
    label = np.where(core, np.arange(len(points)), -1)
    changed = True
    while changed:
        changed = False
        for i in np.flatnonzero(core):
            best = label[near[i] & core].min()
            if best < label[i]:
                label[i], changed = best, True
    out = label.copy()
    for i in np.flatnonzero(~core):
        options = np.flatnonzero(near[i] & core)
        if len(options):
            out[i] = label[options[np.lexsort((options, gap[i, options]))[0]]]
    for l in set(out) - {-1}:
        if (out == l).sum() < min_size:
            out[out == l] = -1
    return out.tolist()


@pytest.mark.parametrize("pair_rows", [4000, 11])
@pytest.mark.parametrize("eps, min_points, min_size", [(0.3, 5, 5), (0.15, 3, 2), (1.2, 4, 5)])
def test_density_equals_brute_force(spark, monkeypatch, pair_rows, eps, min_points, min_size):
    monkeypatch.setattr(C, "_PAIR_ROWS", pair_rows)
    points = blobs()
    got = C.density_clusters(vectors(spark, points), "id", "v", eps, min_points, min_size).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_density(points, eps, min_points, min_size)


def test_density_with_a_hot_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(C, "_PAIR_ROWS", 11)
    points = np.concatenate([blobs(), np.repeat(blobs()[:1], 80, axis=0)])
    got = C.density_clusters(vectors(spark, points), "id", "v", 0.3, 5, 5).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_density(points, 0.3, 5, 5)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).withColumnRenamed("id", "id")
    edges = spark.range(199).where("id <> 120").selectExpr("id + 1 AS a", "id AS b")
    got = {r["id"]: r["label"] for r in C.connected_components(nodes, edges).collect()}
    assert all(got[i] == (0 if i <= 120 else 121) for i in range(200))


def test_kmeans_finds_blobs_and_adjusts_k(spark):
    points = blobs()[:100]
    got = C.kmeans_vector_clusters(vectors(spark, points), "v", k=4, starts=4).orderBy("id").collect()
    assert sorted(C_["n"] for C_ in C.cluster_sizes(spark.createDataFrame(got)).collect()) == [25] * 4
    assert all(len({r["cluster"] for r in got[i * 25:(i + 1) * 25]}) == 1 for i in range(4))
    assert [C.cluster_count(n, 8) for n in (3, 9, 23, 24)] == [2, 3, 7, 8]


def test_kmeans_text(spark):
    docs = spark.createDataFrame([(i, ("battery drains %d" if i % 2 else "cracked screen %d") % (i % 3)) for i in range(30)], "id long, text string")
    got = C.kmeans_text_clusters(docs, "id", "text", k=2, starts=2).collect()
    assert len({(r["id"] % 2, r["cluster"]) for r in got}) == 2


def test_report_and_names(spark):
    df = spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(9)], "id long, text string, cluster int")
    rows = sorted((r["cluster"], r["rank"], r["id"], r["n"]) for r in C.cluster_report(df, "id", "text", n=2).collect())
    assert rows == [(0, 1, 0, 5), (0, 2, 2, 5), (1, 1, 1, 4), (1, 2, 3, 4)]
    named = C.cluster_label_map(df, {0: "zero"}).collect()
    assert {(r["cluster"], r["label"]) for r in named} == {(0, "zero"), (1, "other_uncategorised")}


def test_density_meets_under_a_tenth_of_the_pairs(spark):
    rng = np.random.default_rng(6)
    points = np.repeat(rng.normal(size=(80, 16)), 6, axis=0)
    points += rng.normal(scale=0.02, size=points.shape)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    df = vectors(spark, points)
    tree = X.grow(df.select("id", F.col("v").alias("weight"), F.lit(1).alias("copies")), "id", "weight", 20)
    sent = C._neighbourhoods(tree, 0.3).groupBy("node", "_to").agg(F.count(F.lit(1)).alias("n")).collect()
    size = {(r["node"], r["_to"]): r["n"] for r in sent}
    met = sum(n * size.get((b, a), 0) for (a, b), n in size.items())
    assert met < len(points) ** 2 / 10
    got = C.density_clusters(df, "id", "v", 0.3, 3, 3, leaf_rows=20).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_density(points, 0.3, 3, 3)


@pytest.mark.parametrize("crowded", [0, 3, 10**6])
@pytest.mark.parametrize("eps, min_points, min_size", [(0.3, 5, 5), (0.2, 12, 3)])
def test_small_balls_equal_brute_force(spark, monkeypatch, eps, min_points, min_size, crowded):
    """All pairs of close balls written, some, or none, in many blocks, with copies and a zero vector."""
    for name, value in (("_FEW", 0), ("_NEARBY", (10**6, 1)), ("_PAIR_ROWS", 40), ("_BALL_ROWS", 4), ("_COVERED", 9), ("_CROWDED", crowded), ("_HELD", 50)):
        monkeypatch.setattr(C, name, value)
    points = np.concatenate([blobs(per=50), np.repeat(blobs()[:1], 7, axis=0), np.zeros((1, 6))])
    got = C.density_clusters(vectors(spark, points), "id", "v", eps, min_points, min_size, leaf_rows=12).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_density(points, eps, min_points, min_size)


def test_near_copies_meet_by_their_middles(spark, monkeypatch):
    """Points with few neighbours: only the middles of small balls go to the blocks, a quarter of the points and not their vectors in double precision."""
    monkeypatch.setattr(C, "_FEW", 0)
    rng = np.random.default_rng(6)
    points = np.repeat(rng.normal(size=(300, 16)), 4, axis=0)
    points += rng.normal(scale=0.02, size=points.shape)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    met, block_pairs = [], C._block_pairs
    monkeypatch.setattr(C, "_block_pairs", lambda sent, carry: met.append((sent.select("id").distinct().count(), sent.schema["weight"].dataType.simpleString()))
                        or block_pairs(sent, carry))
    got = C.density_clusters(vectors(spark, points), "id", "v", 0.3, 3, 3, leaf_rows=40).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_density(points, 0.3, 3, 3)
    assert len(met) == 1 and met[0][0] < len(points) / 2 and met[0][1] == "array<float>"


def test_density_of_odd_vectors(spark):
    points = [[1.0, 0.0]] * 6 + [None, [1.0], [None, 1.0], [float("nan"), 1.0]]
    df = spark.createDataFrame(list(enumerate(points)), "id long, v array<double>")
    got = [r["cluster"] for r in C.density_clusters(df, "id", "v", 0.3, 5, 5).orderBy("id").collect()]
    assert got == [0] * 6 + [-1] * 4


def test_every_start_settles_on_its_means(spark):
    points = blobs(per=40)
    for k, starts in ((4, 5), (1, 1), (30, 2)):
        fit = C.fit_kmeans(vectors(spark, points).repartition(3), "v", 6, k=k, starts=starts)
        gaps = ((points[:, None, :] - fit.centres[None]) ** 2).sum(2)
        near = gaps.argmin(1)
        for c in set(near):
            assert fit.centres[c] == pytest.approx(points[near == c].mean(0), abs=1e-9)
        assert fit.cost == pytest.approx(gaps.min(1).sum(), abs=1e-9) and fit.passes < 100
    assert C.fit_kmeans(vectors(spark, points), "v", 6, k=4, starts=8).cost <= C.fit_kmeans(vectors(spark, points), "v", 6, k=4, starts=1).cost


def test_sparse_and_dense_rows_settle_alike(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "id long, text string")
    vocabulary = FE.fit_vocabulary(docs, "id", "text", 50)
    stages = FE.tfidf_stages(vocabulary)
    sparse = stages.transform(FE.with_terms(docs, "text", vocabulary))
    width = len(stages.stages[0].vocabulary)
    dense = sparse.select("id", vector_to_array("features").alias("v"))
    a, b = C.fit_kmeans(sparse, "features", width, 3, starts=3), C.fit_kmeans(dense, "v", width, 3, starts=3)
    assert a.centres == pytest.approx(b.centres) and a.cost == pytest.approx(b.cost)


def newton(x, y, weight, c, classes, rounds=60):
    """Multinomial regression by plain Newton steps, the intercepts without a penalty; the last class's intercept is held."""
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1))])
    beta, hot = np.zeros((classes, d + 1)), np.eye(classes)[y]
    ridge = np.append(np.full(d, 1 / (c * n)), 1e-12)
    for _ in range(rounds):
        z = x1 @ beta.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = ((p - hot) * weight[:, None]).T @ x1 / n + beta * ridge
        hessian = np.zeros((classes * (d + 1), classes * (d + 1)))
        for a in range(classes):
            for b in range(classes):
                v = weight * p[:, a] * ((a == b) - p[:, b])
                hessian[a * (d + 1):(a + 1) * (d + 1), b * (d + 1):(b + 1) * (d + 1)] = (x1 * v[:, None]).T @ x1 / n + (a == b) * np.diag(ridge)
        beta -= np.linalg.lstsq(hessian, slope.ravel(), rcond=None)[0].reshape(beta.shape)
    return p


@pytest.mark.parametrize("labels", [("p", "q", "r"), ("p", "q")])
def test_the_fit_is_the_only_optimum(spark, labels):
    df = train(spark).where(F.col("label").isin(list(labels)))
    model = I.fit_intent_model(df, "id", "text", "label", stop_words=())
    certificate = I.fit_certificate(model, df, "label").first()
    assert certificate["n"] == df.count() and certificate["gradient"] < 1e-5
    rows = model.stages.transform(FE.with_terms(df, "text", FE.Vocabulary(None, 0, (), 2), "_terms")).orderBy("id").select(
        "label", vector_to_array("_features").alias("x"), vector_to_array("_probability").alias("p")).collect()
    y = np.array([labels.index(r["label"]) for r in rows])
    weight = len(y) / len(labels) / np.bincount(y)[y]
    if len(labels) > 2:
        want = newton(np.array([r["x"] for r in rows]), y, weight, 1.0, len(labels))
        assert np.array([r["p"] for r in rows]) == pytest.approx(want, abs=1e-4)
    early = I.fit_intent_model(df, "id", "text", "label", stop_words=(), max_iter=2)
    worse = I.fit_certificate(early, df, "label").first()
    assert worse["gradient"] > 50 * certificate["gradient"] and worse["objective"] > certificate["objective"]


def test_density_sends_a_point_once_per_block(spark):
    """However many leaves are within reach: all of them lie in a few blocks, inside which leaves are skipped."""
    points = np.random.default_rng(9).normal(size=(400, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    df = vectors(spark, points).select("id", F.col("v").alias("weight"), F.lit(1).alias("copies"))
    tree = X.grow(df, "id", "weight", 10)
    sent = C._packed(X.cut(tree, 25), 0.8, 100).collect()
    assert tree.nodes.where("NOT inner").count() > 40
    assert len({r["_to"] for r in sent}) <= 5 and len(sent) <= 5 * 400
    assert {r["id"] for r in sent if r["node"] == r["_to"]} == set(range(400))
    target = {r["id"]: r["node"] for r in sent}
    met = {(r["id"], r["_to"]) for r in sent}
    assert all((i, target[j]) in met for i, j in zip(*np.nonzero(2 - 2 * points @ points.T <= 0.64)))


@pytest.mark.parametrize("alike", [False, True])
def test_density_moves_no_vector_for_a_lookup(spark, monkeypatch, alike):
    """Labels go by digests of the vectors, unless two of them share theirs; core flags are known before rows are repeated per block."""
    points = np.concatenate([blobs(), np.repeat(blobs()[:1], 40, axis=0)])
    points[np.abs(points) < 0.01] = 0.0
    points[-3:] = np.where(points[-3:] == 0, -0.0, points[-3:])
    keys, sent = [], []
    lookup, packed, digested = C._salted_lookup, C._packed, C._digested
    monkeypatch.setattr(C, "_salted_lookup", lambda df, key, *rest: keys.append(df.schema[key].dataType.typeName()) or lookup(df, key, *rest))
    monkeypatch.setattr(C, "_packed", lambda tree, *rest: sent.append("core" in tree.rows.columns) or packed(tree, *rest))
    if alike:
        monkeypatch.setattr(C, "_digested", lambda df, v: digested(df.withColumn(v, F.array(F.lit(1.0))), v))
    got = C.density_clusters(vectors(spark, points), "id", "v", 0.3, 5, 5).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_density(points, 0.3, 5, 5)
    assert ("array" in keys) == alike and sent == [False, True]
