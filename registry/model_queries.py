"""TF-IDF, retrieval, clusters and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight import config
from caselight.functions import text as T
from caselight.operators import clusters as C
from caselight.operators import features as FE
from caselight.operators import intents as I
from caselight.operators import pairs as O
from caselight.operators import retrieval as R
from caselight.operators.blocks import Limits
from caselight.plans import evaluation as E
from caselight.session import scratch_dir
from caselight.sources.messages import scan_pairs, write_pairs
from registry import base as B
from registry.text_queries import STOP

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def _docs(spark, sf):
    return B.table(spark, sf, "documents", spread=True)


def _asked(spark, sf):
    """All customer messages."""
    return O.customer_messages(B.messages(spark, sf)).select("tweet_id", "text")


def _pairs(spark, sf):
    """All pairs, written once and scanned back, as every later step reads them."""
    path = scratch_dir(spark, "pairs")
    write_pairs(O.build_pairs(B.messages(spark, sf), B.BRAND, None, brands=B.BRANDS), path)
    return scan_pairs(spark, path).select(
        F.col("brand_tweet_id").alias("pair_id"), F.col("cust_text_clean").alias("cust"),
        F.col("brand_text_clean").alias("reply"))


PAIRS = f"""{B.BUILT}, corpus AS (SELECT brand_tweet_id AS pair_id, cust_text_clean AS cust, brand_text_clean AS reply FROM built),
asked AS (SELECT tweet_id, text FROM msgs WHERE inbound = 'True')"""
PAIR_HITS = f"""{B.terms_ctes('corpus', 'pair_id', 'cust', 'cterm')}, {B.vocabulary_cte('cterm', 'corpus')},
{B.weights_cte('cterm', 'cw')}"""


# --- features -----------------------------------------------------------------------------------------

@query("top_terms", f"""WITH {B.terms_ctes('documents', 'doc_id', 'text', 'x')}, {B.vocabulary_cte('x', 'documents', 'voc', 500)}
SELECT term, total, df FROM voc""")
def _(spark, sf):
    return FE.top_terms(FE.term_frequencies(_docs(spark, sf), "doc_id", "text"), 500)


@query("vocabulary", f"""WITH {B.terms_ctes('documents', 'doc_id', 'text', 'x', STOP)}, {B.vocabulary_cte('x', 'documents')}
SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, df, total, round(idf, 6) AS idf FROM voc""")
def _(spark, sf):
    vocabulary = FE.fit_vocabulary(_docs(spark, sf), "doc_id", "text", stop_words=STOP)
    return vocabulary.frame.withColumn("idf", F.round("idf", 6))


@query("tfidf_weights", f"""WITH {B.terms_ctes('documents', 'doc_id', 'text', 'x')}, {B.vocabulary_cte('x', 'documents')},
{B.weights_cte('x', 'w')} SELECT id AS doc_id, term, tf::INTEGER AS tf, round(weight, 6) AS weight FROM w""")
def _(spark, sf):
    docs = _docs(spark, sf)
    weights = FE.tfidf_weights(docs, "doc_id", "text", FE.fit_vocabulary(docs, "doc_id", "text"))
    return weights.withColumn("weight", F.round("weight", 6))


@query("tfidf_transform", f"""WITH {B.terms_ctes('documents', 'doc_id', 'text', 'x')}, {B.vocabulary_cte('x', 'documents')},
{B.terms_ctes('benchmark', 'item_id', 'text', 'y')}, {B.weights_cte('y', 'w')}
SELECT id AS item_id, term, tf::INTEGER AS tf, round(weight, 6) AS weight FROM w""")
def _(spark, sf):
    vocabulary = FE.fit_vocabulary(_docs(spark, sf), "doc_id", "text")
    weights = FE.tfidf_weights(B.table(spark, sf, "benchmark"), "item_id", "text", vocabulary)
    return weights.withColumn("weight", F.round("weight", 6))


# --- retrieval -----------------------------------------------------------------------------------------

@query("retrieve_sparse", f"""WITH {PAIRS}, {PAIR_HITS}, {B.terms_ctes('asked', 'tweet_id', 'text', 'qterm')},
{B.weights_cte('qterm', 'qw')}, {B.hits_cte('asked', 'tweet_id', 'corpus', 'pair_id', 'qw', 'cw')}
SELECT query_id AS tweet_id, rank, h.doc_id AS pair_id, round(score, 6) AS score, cust, reply
FROM hits h JOIN corpus c ON c.pair_id = h.doc_id""")
def _(spark, sf):
    hits = R.retrieve_sparse(_asked(spark, sf), _pairs(spark, sf), "tweet_id", "text", "pair_id", "cust",
                             payload=("cust", "reply"))
    return hits.withColumn("score", F.round("score", 6))


@query("retrieve_sparse_documents", f"""WITH {B.terms_ctes('documents', 'doc_id', 'text', 'x')}, {B.vocabulary_cte('x', 'documents')},
{B.weights_cte('x', 'dw')}, {B.terms_ctes('benchmark', 'item_id', 'text', 'y')}, {B.weights_cte('y', 'qw')},
{B.hits_cte('benchmark', 'item_id', 'documents', 'doc_id', 'qw', 'dw')}
SELECT query_id AS item_id, rank, doc_id, round(score, 6) AS score FROM hits""")
def _(spark, sf):
    hits = R.retrieve_sparse(B.table(spark, sf, "benchmark"), _docs(spark, sf), "item_id", "text", "doc_id", "text")
    return hits.withColumn("score", F.round("score", 6))


@query("retrieve_sparse_impact", SQL["retrieve_sparse_documents"])
def _(spark, sf):
    """The same by impact-ordered lists: small blocks, so that every table has several."""
    hits = R.retrieve_sparse(B.table(spark, sf, "benchmark"), _docs(spark, sf), "item_id", "text", "doc_id", "text", limits=Limits(250, 10**6))
    return hits.withColumn("score", F.round("score", 6))


@query("top1_score", f"""WITH {PAIRS}, {PAIR_HITS}, {B.terms_ctes('documents', 'doc_id', 'text', 'qterm')},
{B.weights_cte('qterm', 'qw')}, {B.hits_cte('documents', 'doc_id', 'corpus', 'pair_id', 'qw', 'cw', k=1)}
SELECT query_id AS doc_id, round(score, 6) AS top1_score FROM hits""")
def _(spark, sf):
    docs = _docs(spark, sf)
    hits = R.retrieve_sparse(docs, _pairs(spark, sf), "doc_id", "text", "pair_id", "cust", k=1)
    return R.top1_scores(docs, hits, "doc_id").withColumn("top1_score", F.round("top1_score", 6))


UNIT = """unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / n) AS u FROM (
  SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)))"""


@query("retrieve_dense", f"""WITH {UNIT} SELECT vec_id, doc_id, rank::INTEGER AS rank, round(s, 6) AS score, label FROM (
  SELECT q.vec_id, d.vec_id AS doc_id, d.label, list_inner_product(q.u, d.u) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.u, d.u), 9) DESC, d.vec_id) AS rank
  FROM unit q CROSS JOIN unit d) WHERE rank <= 3""")
def _(spark, sf):
    e = B.table(spark, sf, "embeddings", spread=True)
    hits = R.retrieve_dense(e, e.withColumnRenamed("vec_id", "doc_id"), "vec_id", "embedding", "doc_id", "embedding",
                            payload=("label",))
    return hits.withColumn("score", F.round("score", 6))


@query("retrieve_dense_tree", SQL["retrieve_dense"])
def _(spark, sf):
    """The same by a tree of balls, with leaves small enough for several levels."""
    e = B.table(spark, sf, "embeddings", spread=True)
    hits = R.retrieve_dense(e, e.withColumnRenamed("vec_id", "doc_id"), "vec_id", "embedding", "doc_id", "embedding",
                            payload=("label",), limits=Limits(50, 10**6))
    return hits.withColumn("score", F.round("score", 6))


# --- clusters ------------------------------------------------------------------------------------------

CENTRES = """centres AS (SELECT label, list(c ORDER BY i) AS centre FROM (
  SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i
    FROM embeddings) GROUP BY label, i) GROUP BY label)"""


@query("kmeans_step", f"""WITH {CENTRES}, a AS (SELECT vec_id, c.label AS cluster, round(list_distance(e.embedding::DOUBLE[], c.centre) ** 2, 9) AS d2
  FROM embeddings e CROSS JOIN centres c),
best AS (SELECT vec_id, arg_min(cluster, (d2, cluster)) AS assigned, min(d2) AS d2 FROM a GROUP BY vec_id),
m AS (SELECT assigned, i, avg(x) AS c FROM (SELECT assigned, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings JOIN best USING (vec_id)) GROUP BY assigned, i)
SELECT assigned, (SELECT count(*) FROM best b WHERE b.assigned = m.assigned) AS n,
  round((SELECT sum(d2) FROM best b WHERE b.assigned = m.assigned), 6) AS inertia, round(sqrt(sum(c * c)), 6) AS centre_norm
FROM m GROUP BY assigned""")
def _(spark, sf):
    e = B.table(spark, sf, "embeddings", spread=True)
    assigned = C.assign_to_centres(e, "embedding", C.centres_of(e, "embedding", "label"), "label")
    inertia = assigned.groupBy("assigned").agg(F.round(F.sum("distance2"), 6).alias("inertia"))
    moved = C.centres_of(assigned, "embedding", "assigned")
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    return moved.join(inertia, "assigned").select("assigned", "n", "inertia", F.round(norm, 6).alias("centre_norm"))


@query("kmeans_fit", "SELECT count(*) AS n, 10::BIGINT AS n_clusters, true AS settled FROM embeddings")
def _(spark, sf):
    """What holds for any settled fit: all clusters are used, and every row is nearest to the mean of its own."""
    clustered = C.kmeans_vector_clusters(B.table(spark, sf, "embeddings", spread=True), "embedding", k=10)
    again = C.assign_to_centres(clustered, "embedding", C.centres_of(clustered, "embedding", "cluster"), "cluster")
    return again.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("n_clusters"),
                     (F.count_if(F.col("cluster") != F.col("assigned")) == 0).alias("settled"))


@query("kmeans_text")
def _(spark, sf):
    clustered = C.kmeans_text_clusters(_pairs(spark, sf), "pair_id", "cust", k=8)
    return C.cluster_report(clustered, "pair_id", "cust")


EPS, MIN_POINTS = 1.16, 5


@query("density_clusters", f"""WITH RECURSIVE {UNIT},
near AS (SELECT a.vec_id AS a, b.vec_id AS b, round(2.0 - 2.0 * list_inner_product(a.u, b.u), 9) AS gap FROM unit a CROSS JOIN unit b),
close AS MATERIALIZED (SELECT * FROM near WHERE gap <= round({EPS}::DOUBLE * {EPS}::DOUBLE, 9)),
core AS MATERIALIZED (SELECT a AS id FROM close GROUP BY a HAVING count(*) >= {MIN_POINTS}),
link AS MATERIALIZED (SELECT a, b FROM close WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id WHERE r.root < l.b),
lab AS (SELECT id, min(root) AS label FROM reach GROUP BY id),
border AS (SELECT a AS id, arg_min(b, (gap, b)) AS near_core FROM close WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core) GROUP BY a),
member AS (SELECT id, label FROM lab UNION ALL SELECT border.id, lab.label FROM border JOIN lab ON lab.id = near_core),
large AS (SELECT label FROM member GROUP BY label HAVING count(*) >= (SELECT greatest(5, count(*) // 40) FROM unit))
SELECT u.vec_id, coalesce(m.label, -1) AS cluster FROM unit u LEFT JOIN (SELECT * FROM member WHERE label IN (SELECT label FROM large)) m ON m.id = u.vec_id""")
def _(spark, sf):
    return C.density_clusters(B.table(spark, sf, "embeddings", spread=True), "vec_id", "embedding", EPS, MIN_POINTS)


def _clustered(spark, sf):
    """Documents in the clusters of their source."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return _docs(spark, sf).select("doc_id", "text", number.alias("cluster"))


CLUSTERED = "clustered AS (SELECT doc_id, text, regexp_extract(source, '[0-9]+')::INTEGER AS cluster FROM documents)"


@query("cluster_report", f"""WITH {CLUSTERED}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id)::INTEGER AS rank,
  count(*) OVER (PARTITION BY cluster) AS n FROM clustered) SELECT cluster, rank, doc_id, text, n FROM r WHERE rank <= 5""")
def _(spark, sf):
    return C.cluster_report(_clustered(spark, sf), "doc_id", "text")


@query("cluster_sizes", f"WITH {CLUSTERED} SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster")
def _(spark, sf):
    return C.cluster_sizes(_clustered(spark, sf))


_NAMES = dict(enumerate(config.LABELS))


@query("cluster_label_map", f"""WITH {CLUSTERED}, names(cluster, label) AS (VALUES {', '.join(f'({i}, {B.lit(l)})' for i, l in _NAMES.items())})
SELECT doc_id, cluster, coalesce(label, 'other_uncategorised') AS label FROM clustered LEFT JOIN names USING (cluster)""")
def _(spark, sf):
    return C.cluster_label_map(_clustered(spark, sf), _NAMES).select("doc_id", "cluster", "label")


# --- classification --------------------------------------------------------------------------------------

def _train(spark, sf):
    return E.weakly_labelled(_pairs(spark, sf), "cust")


@query("lr_fit_predict")
def _(spark, sf):
    """A learnt intent per message, with the certificate of the fit: SQL cannot fit, but the slope at the only optimum is zero."""
    train = _train(spark, sf)
    model = I.fit_intent_model(train, "pair_id", "cust", "weak_label")
    gradient = I.fit_certificate(model, train, "weak_label").first()["gradient"]
    return model.predict(_asked(spark, sf), "text").select(
        "tweet_id", "intent", F.round("confidence", 3).alias("confidence"), F.lit(gradient < 1e-4).alias("certified"))


@query("model_save_load", f"WITH {PAIRS} SELECT count(*) AS n, 0::BIGINT AS differing FROM asked")
def _(spark, sf):
    """A model read back predicts what the saved one does."""
    path, asked = scratch_dir(spark, "intent-model"), _asked(spark, sf)
    model = I.fit_intent_model(_train(spark, sf), "pair_id", "cust", "weak_label")
    model.save(path, spark)
    both = model.predict(asked, "text").join(I.IntentModel.load(path, spark).predict(asked, "text").select(
        "tweet_id", F.col("intent").alias("again"), F.col("confidence").alias("sure")), "tweet_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(
        (F.col("intent") != F.col("again")) | (F.abs(F.col("confidence") - F.col("sure")) > 1e-9)).alias("differing"))


def _baselines(spark, sf):
    golden = E.weakly_labelled(_asked(spark, sf), "text")
    raw = F.when(F.length("tweet_id") % 2 == 0, F.concat(F.lit("Label: "), F.upper("weak_label"))).otherwise(F.lit("no idea"))
    return golden, golden.select("tweet_id", raw.alias("raw"))


@query("train_eval_baselines")
def _(spark, sf):
    """The floor, the fitted model and the answers side by side, each with its report."""
    golden, answers = _baselines(spark, sf)
    out = E.train_eval_baselines(_train(spark, sf), "pair_id", "cust", "weak_label", golden, "text", "weak_label", answers, "tweet_id")[1]
    return out.select("model", F.round("accuracy", 3).alias("accuracy"), F.round("macro_f1", 3).alias("macro_f1"), "report")


@query("eval_floor_and_answers", f"""WITH {PAIRS}, golden AS (SELECT tweet_id, {B.sql_weak_label('text')} AS truth FROM asked),
top AS (SELECT {B.sql_weak_label('cust')} AS label FROM corpus GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
said AS (SELECT 'trivial' AS model, truth, (SELECT label FROM top) AS guess FROM golden UNION ALL
  SELECT 'llm', truth, CASE WHEN length(tweet_id) % 2 = 0 THEN truth ELSE {B.lit(config.DEFAULT_LABEL)} END FROM golden),
seen AS (SELECT DISTINCT model, unnest([truth, guess]) AS label FROM said),
f AS (SELECT n.model, n.label, 2 * count(*) FILTER (WHERE truth = n.label AND guess = n.label) /
  (count(*) FILTER (WHERE truth = n.label) + count(*) FILTER (WHERE guess = n.label)) AS f1 FROM seen n JOIN said s ON s.model = n.model GROUP BY 1, 2)
SELECT model, round((SELECT avg((truth = guess)::INTEGER) FROM said s WHERE s.model = f.model), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY model""")
def _(spark, sf):
    """The rows of the evaluation that SQL can tell: floor and language-model answers."""
    golden, answers = _baselines(spark, sf)
    out = E.evaluate_unfitted(_train(spark, sf), "weak_label", golden, "weak_label", answers, "tweet_id")
    return out.select("model", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


_LINEAR = ("alpha", "beta", "gamma")


@query("lr_score_fixed", f"""WITH {PAIRS}, {PAIR_HITS}, {B.terms_ctes('asked', 'tweet_id', 'text', 'qterm')}, {B.weights_cte('qterm', 'qw')},
logit AS (SELECT tweet_id, c.label, c.base + coalesce(sum(w.weight * (((length(w.term) * c.step + v.df) % 7 - 3) / 2.0::DOUBLE)), 0) AS z
  FROM asked CROSS JOIN (VALUES ('alpha', 1, 0.1::DOUBLE), ('beta', 2, 0.0::DOUBLE), ('gamma', 3, -0.1::DOUBLE)) c(label, step, base)
  LEFT JOIN qw w ON w.id = tweet_id LEFT JOIN voc v USING (term) GROUP BY tweet_id, c.label, c.base),
p AS (SELECT tweet_id, label, exp(z) / sum(exp(z)) OVER (PARTITION BY tweet_id) AS p FROM logit)
SELECT tweet_id, arg_max(label, p) AS intent, round(max(p), 6) AS confidence FROM p GROUP BY tweet_id""")
def _(spark, sf):
    asked = _asked(spark, sf)
    vocabulary = FE.fit_vocabulary(_pairs(spark, sf), "pair_id", "cust")
    weights = FE.tfidf_weights(asked, "tweet_id", "text", vocabulary)
    every = asked.select("tweet_id").join(weights, "tweet_id", "left")
    steps = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(i + 1).alias("step")) for i, l in enumerate(_LINEAR)])
    coefficients = vocabulary.frame.select("term", "df", F.inline(steps)).select(
        "term", "label", ((F.pmod(F.length("term") * F.col("step") + F.col("df"), F.lit(7)) - 3) / 2.0).alias("coefficient"))
    scored = I.score_linear(every, "tweet_id", coefficients, {"alpha": 0.1, "beta": 0.0, "gamma": -0.1})
    return scored.withColumn("confidence", F.round("confidence", 6))


# every vector three times over: copies must not change the clusters, only their sizes
_COPIED = "copied AS (SELECT vec_id * 3 + c AS vec_id, label, embedding FROM embeddings CROSS JOIN (VALUES (0), (1), (2)) t(c)),"


@query("density_clusters_copies", SQL["density_clusters"].replace("RECURSIVE ", f"RECURSIVE {_COPIED} ", 1)
       .replace("v FROM embeddings", "v FROM copied", 1).replace(f">= {MIN_POINTS})", ">= 15)", 1))
def _(spark, sf):
    e = B.table(spark, sf, "embeddings", spread=True)
    copies = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c")).withColumn(
        "vec_id", F.col("vec_id") * 3 + F.col("c"))
    return C.density_clusters(copies, "vec_id", "embedding", EPS, 15)


# four rows near every vector: groups that lie far apart against eps, so that few leaves meet
_NEAR = """near_ AS (SELECT vec_id * 4 + c AS vec_id, label, list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + 0.05::DOUBLE * (((i - 1) * (c + 1)) % 7 - 3)))
  AS embedding FROM embeddings CROSS JOIN (VALUES (0), (1), (2), (3)) t(c)),"""
TIGHT = 0.3


@query("density_clusters_tight", SQL["density_clusters"].replace("RECURSIVE ", f"RECURSIVE {_NEAR} ", 1).replace("v FROM embeddings", "v FROM near_", 1)
       .replace(str(EPS), str(TIGHT)).replace(f">= {MIN_POINTS})", ">= 3)", 1).replace("greatest(5, count(*) // 40)", "least(3, count(*))"))
def _(spark, sf):
    e = B.table(spark, sf, "embeddings", spread=True).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3))))
    near = e.select((F.col("vec_id") * 4 + F.col("c")).alias("vec_id"), F.transform(
        "embedding", lambda x, i: x.cast("double") * (1 + F.lit(0.05) * ((i * (F.col("c") + 1)) % 7 - 3))).alias("embedding"))
    return C.density_clusters(near, "vec_id", "embedding", TIGHT, 3, 3, leaf_rows=100)
