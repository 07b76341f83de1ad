"""Queries on sampling, models, ensembles and agreement.

Models, votes, stacking, selection and tuning run at their recorded sizes. Fitted results have no SQL, the steps
around the fits do.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sessionlore.catalog.base import Tables, query, rounded
from sessionlore.catalog.sql import ASSESS, BEGUN, with_
from sessionlore.functions.catalogue import KEYS, PLAYER
from sessionlore.operators import statistics as st
from sessionlore.operators.nearest import nearest
from sessionlore.operators.sampling import rebalance
from sessionlore.plans import assemble, explain, holdout
from sessionlore.plans import ensembles as e
from sessionlore.plans import features as f
from sessionlore.plans import models as m
from sessionlore.session import materialize
from sessionlore.sources import files
from sessionlore.sources.play_view import ALL_TITLES

PAIR = "installation_id, game_session"
#: Columns that tell feature rows apart.
ROW = [*KEYS, "month", "hour", "year", "dayofweek"]


class Learning:
    """Feature rows with labels: all but each player's last assessments to fit, those to predict."""

    def __init__(self, t: Tables):
        self.t = t
        table = assemble.create_features(t.log, ALL_TITLES, assemble.STACKED, t.hot)
        self.table = materialize(assemble.with_labels(table, t.labels))
        self.columns = assemble.feature_columns(self.table)
        self.predict, self.score = map(materialize, holdout.split_last(self.table))

    @cached_property
    def train(self):
        return materialize(m.assemble(self.score, self.columns))

    @cached_property
    def test(self):
        return materialize(m.assemble(self.predict, self.columns))

    def predictions(self, model):
        return model.fit(self.train).transform(self.test).select(*KEYS, m.LABEL, "prediction")


# ---- predictors without a fit: the history of outcomes ----------------------------------------

_RULES = ASSESS + f""",
hist AS (SELECT *, lag(ag, 1, 0) OVER b AS p_ag FROM assess WINDOW b AS ({BEGUN})),
rules AS (SELECT {PAIR}, ag AS label, p_ag AS last_group,
                 CAST(round(avg(p_ag) OVER ({BEGUN} ROWS UNBOUNDED PRECEDING)) AS INTEGER) AS mean_group
          FROM hist),
long AS (SELECT {PAIR}, label, 'last' AS model, last_group AS prediction FROM rules
         UNION ALL SELECT {PAIR}, label, 'mean', mean_group FROM rules
         UNION ALL SELECT {PAIR}, label, 'zero', 0 FROM rules)"""


def _rules(t):
    """Outcome of each assessment beside what its player's history suggests."""
    rows = t.along(t.assessments, lambda part, h: f.compute(
        part, h, [f.previous_accuracy()], [*KEYS, "accuracy_group"]))
    return rows.select(
        *KEYS, F.col("accuracy_group").alias("label"), F.col("Past_Assessment_ag").alias("last_group"),
        F.round("cummean_ag").cast("int").alias("mean_group"),
    )


def _long(t):
    suggested = F.array(
        F.struct(F.lit("last").alias("model"), F.col("last_group").alias("prediction")),
        F.struct(F.lit("mean").alias("model"), F.col("mean_group").alias("prediction")),
        F.struct(F.lit("zero").alias("model"), F.lit(0).alias("prediction")),
    )
    return _rules(t).select(*KEYS, "label", F.inline(suggested))


# ---- sampling and selection -------------------------------------------------------------------

@query("smp_rebalance", """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, 'down' AS mode, min(n) OVER () AS n FROM c
UNION ALL SELECT o_orderpriority, 'over', max(n) OVER () FROM c""")
def smp_rebalance(t):
    parts = [
        st.value_counts(rebalance(t["orders"], "o_orderpriority", ["o_orderkey"], mode), "o_orderpriority").select(
            "o_orderpriority", F.lit(mode).alias("mode"), F.col("count").alias("n"))
        for mode in ("down", "over")
    ]
    return parts[0].unionByName(parts[1])


@query("smp_rebalance_rows")
def smp_rebalance_rows(t):
    return rebalance(t["orders"], "o_orderpriority", ["o_orderkey"], "over")


@query("smp_bagged_vote")
def smp_bagged_vote(t):
    data = Learning(t)
    return e.bagged_vote(data.score, data.predict, KEYS, data.columns)


@query("smp_bagged_vote_chained")
def smp_bagged_vote_chained(t):
    data = Learning(t)
    return e.bagged_vote(data.score, data.predict, KEYS, data.columns, chained=True)


_CANDIDATES = ["Past_Assessment_ag", "Past_Assessment_att", "Past_Assessment_succ"]


@query("sel_corr", with_(ASSESS, f"""
, hist AS (SELECT ag, lag(ag, 1, 0) OVER b AS "Past_Assessment_ag", lag(att, 1, 0) OVER b AS "Past_Assessment_att",
                  lag(succ, 1, 0) OVER b AS "Past_Assessment_succ" FROM assess WINDOW b AS ({BEGUN})),
found AS ({" UNION ALL ".join(f'''SELECT '{c}' AS feature,
  covar_pop("{c}", ag) / nullif(stddev_pop("{c}") * stddev_pop(ag), 0) AS correlation FROM hist''' for c in _CANDIDATES)})
SELECT feature, round(correlation, 6) AS correlation, coalesce(abs(correlation) > 0.05, false) AS kept FROM found"""))
def sel_corr(t):
    rows = t.along(t.assessments, lambda part, h: f.compute(
        part, h, [f.previous_accuracy()], [*KEYS, "accuracy_group"]))
    found = st.correlations(rows, _CANDIDATES, "accuracy_group")
    kept = F.coalesce(F.abs("correlation") > 0.05, F.lit(False))
    return rounded(found.withColumn("kept", kept))


@query("sel_corr_table")
def sel_corr_table(t):
    """The feature table with the columns that correlate with the label."""
    data = Learning(t)
    return data.table.select(*KEYS, *[f"`{c}`" for c in e.correlated_columns(data.table, data.columns, "accuracy_group")])


@query("sel_rfe")
def sel_rfe(t):
    data = Learning(t)
    return e.elimination_table(data.score, data.columns, 3)


@query("sel_rfe_sweep")
def sel_rfe_sweep(t):
    data = Learning(t)
    return e.elimination_sweep(data.score, data.predict, data.columns)[0]


@query("feat_importance")
def feat_importance(t):
    data = Learning(t)
    return m.importance_table(t.spark, m.forest_of("bake_off").fit(data.train), data.columns)


@query("sort_desc")
def sort_desc(t):
    """Importances from the largest down."""
    data = Learning(t)
    return m.importance_table(t.spark, m.tree().fit(data.train), data.columns)


# ---- models -----------------------------------------------------------------------------------

_MODELS = {
    "fit_forest": lambda d: m.forest_of("tuned"),
    "fit_gbt_multi": lambda d: m.boosted_multi(),
    "fit_tree": lambda d: m.tree(),
    "fit_bagging": lambda d: m.bagging(),
    "fit_extra_trees": lambda d: m.extra_trees(),
    "fit_adaboost": lambda d: m.boosted_stumps(),
    "fit_logistic": lambda d: m.logistic(),
    "fit_mlp": lambda d: m.network(len(d.columns), 4),
    "ens_ordinal": lambda d: m.Ordinal(m.forest_of("small")),
}


def _register(name, make):
    @query(name)
    def fit(t):
        data = Learning(t)
        return data.predictions(make(data))


for _name, _make in _MODELS.items():
    _register(_name, _make)


_ONE_COLUMN = {
    "adaboost": lambda: m.boosted_stumps(), "bagging": lambda: m.bagging(), "extra_trees": lambda: m.extra_trees(),
    "forest": lambda: m.forest_of("small"), "gbt_multi": lambda: m.boosted_multi(), "logistic": lambda: m.logistic(),
    "one_vs_rest": lambda: m.one_vs_rest_logistic(), "ordinal": lambda: m.Ordinal(m.forest_of("small")),
    "tree": lambda: m.tree(),
}


@query("fit_majority", f"""
WITH d AS (SELECT quality, CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 ELSE 0 END AS label FROM labels),
n AS (SELECT quality, label, count(*) AS n FROM d GROUP BY ALL),
best AS (SELECT quality, label FROM n QUALIFY row_number() OVER (PARTITION BY quality ORDER BY n DESC, label) = 1)
SELECT m.model, quality, CAST(label AS INTEGER) AS prediction FROM best,
  (VALUES {", ".join(f"('{n}')" for n in _ONE_COLUMN)}) m(model)""")
def fit_majority(t):
    """Every trainer on one 0/1 column, where it can only say the most frequent class of each value."""
    label = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).otherwise(0)
    rows = materialize(m.assemble(t["labels"].select("quality", label.alias("accuracy_group")), ["quality"]))
    asked = rows.select("quality", m.FEATURES).dropDuplicates(["quality"])
    fitted = {name: make().fit(rows) for name, make in _ONE_COLUMN.items()}
    return e.long_predictions(fitted, asked, ["quality"]).select("model", "quality", F.col("prediction").cast("int").alias("prediction"))


@query("fit_knn", """
WITH pairs AS (
  SELECT q.vec_id, p.label, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), p.vec_id) AS r
  FROM embeddings q JOIN embeddings p ON p.vec_id <> q.vec_id),
votes AS (SELECT vec_id, label, count(*) AS n FROM pairs WHERE r <= 5 GROUP BY 1, 2)
SELECT vec_id, CAST(label AS INTEGER) AS label FROM votes
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1""")
def fit_knn(t):
    """Label of each vector from its five nearest others."""
    vectors = t["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = nearest(vectors, vectors.drop("label"), 5, skip_same_id=True)
    return st.row_mode(found, ["query"], "label").withColumnRenamed("query", "vec_id")


@query("fit_knn_features")
def fit_knn_features(t):
    data = Learning(t)
    return m.NearestVote(8, ROW).fit(data.train).transform(data.test).select(*KEYS, "prediction")


@query("ens_ordinal_shares", """
WITH p AS (SELECT l_orderkey, l_linenumber, 0.9::DOUBLE AS a, 0.5::DOUBLE + l_discount AS b, l_tax AS c FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, 1 - a AS s0, a - b AS s1, b - c AS s2, c AS s3 FROM p)
SELECT l_orderkey, l_linenumber, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3,
       CASE WHEN s0 >= greatest(s1, s2, s3) THEN 0.0::DOUBLE WHEN s1 >= greatest(s2, s3) THEN 1.0
            WHEN s2 >= s3 THEN 2.0 ELSE 3.0 END AS prediction
FROM s""")
def ens_ordinal_shares(t):
    """Class shares and choice from three threshold probabilities."""
    above = [F.lit(0.9), 0.5 + F.col("l_discount"), F.col("l_tax")]
    rows = t["lineitem"].select("l_orderkey", "l_linenumber", m.ordinal_shares(above).alias("s"))
    return rounded(rows.select(
        "l_orderkey", "l_linenumber", *[F.col("s")[i].alias(f"s{i}") for i in range(4)],
        m.first_largest(F.col("s")).alias("prediction"),
    ))


@query("ens_vote", with_(_RULES, f"""
, votes AS (SELECT {PAIR}, prediction, count(*) AS n FROM long GROUP BY {PAIR}, prediction)
SELECT {PAIR}, prediction FROM votes
QUALIFY row_number() OVER (PARTITION BY {PAIR} ORDER BY n DESC, prediction) = 1"""))
def ens_vote(t):
    return st.row_mode(_long(t), KEYS)


@query("ens_vote_weighted", with_(_RULES, f"""
, votes AS (SELECT {PAIR}, prediction, sum(CASE model WHEN 'last' THEN 1.0 WHEN 'mean' THEN 2.0 ELSE 1.5 END) AS w
  FROM long GROUP BY {PAIR}, prediction)
SELECT {PAIR}, prediction FROM votes
QUALIFY row_number() OVER (PARTITION BY {PAIR} ORDER BY w DESC, prediction) = 1"""))
def ens_vote_weighted(t):
    weight = F.when(F.col("model") == "last", 1.0).when(F.col("model") == "mean", 2.0).otherwise(1.5)
    return st.weighted_vote(_long(t).withColumn("weight", weight), KEYS)


@query("ens_vote_models")
def ens_vote_models(t):
    data = Learning(t)
    fitted = {"forest": m.forest_of("bake_off").fit(data.train), "logistic": m.logistic().fit(data.train)}
    return e.vote(fitted, data.test, KEYS)


# ---- stacking ---------------------------------------------------------------------------------

@query("stk_fold", """
SELECT vec_id, CAST(vec_id % 10 AS INTEGER) AS fold FROM embeddings""")
def stk_fold(t):
    """Ten folds over all rows, from the number of a row."""
    return t["embeddings"].select("vec_id", e.fold_of_number("vec_id", 10).alias("fold"))


@query("stk_oof")
def stk_oof(t):
    data = Learning(t)
    models = e.base_models(ROW)
    rows = e.out_of_fold(data.train, models, ROW, 4)
    width = 4 * len(models)
    return rows.select(*ROW, "fold", m.LABEL, *[F.round(F.col("meta")[i], 6).alias(f"m{i}") for i in range(width)])


@query("stk_fit_base")
def stk_fit_base(t):
    """Accuracy of each base model, fitted to all rows, on the rows to predict."""
    data = Learning(t)
    fitted = e.fit_base(data.train, e.base_models(ROW), 4)
    rows = e.long_predictions(fitted, data.test, ROW, [m.LABEL])
    return e.score_models(rows).select("model", "accuracy")


def _meta(data):
    """The out-of-fold rows, written, and the meta-model fitted to them."""
    meta = materialize(e.out_of_fold(data.train, e.base_models(ROW), ROW, 4))
    return meta, e.fit_meta(meta)


@query("stk_fit_meta")
def stk_fit_meta(t):
    """The meta-model's view of the out-of-fold rows."""
    meta, model = _meta(Learning(t))
    return model.transform(meta.withColumn(m.FEATURES, array_to_vector("meta"))).select(*ROW, m.LABEL, "prediction")


def _stacked(data):
    _, model = _meta(data)
    return e.stacked_predict(data.test, e.fit_base(data.train, e.base_models(ROW), 4), model, ROW, 4)


@query("stk_predict")
def stk_predict(t):
    return _stacked(Learning(t))


# ---- tuning -----------------------------------------------------------------------------------

@query("tune_trees")
def tune_trees(t):
    data = Learning(t)
    return e.tree_sweep(data.train, data.test, range(1, 100))


@query("tune_random_search")
def tune_random_search(t):
    data = Learning(t)
    return e.random_search(data.train, ROW)


@query("ev_permutation")
def ev_permutation(t):
    data = Learning(t)
    model = m.forest_of("bake_off").fit(data.train)
    return e.permutation_importance(model, data.predict, data.columns, KEYS)


@query("ev_explain")
def ev_explain(t):
    """What each feature adds to each class's probability, row by row."""
    data = Learning(t)
    return explain.explain(m.forest_of("bake_off").fit(data.train), data.test, ROW, data.columns)


@query("ev_explain_ranking")
def ev_explain_ranking(t):
    """Features by the mean size of what they add, over all rows and classes."""
    data = Learning(t)
    return explain.ranking(explain.explain(m.forest_of("bake_off").fit(data.train), data.test, ROW, data.columns))


# ---- agreement --------------------------------------------------------------------------------

_KAPPA_SQL = """
cells AS (SELECT {g} {a} AS a, {b} AS b, count(*) AS n FROM {src} GROUP BY ALL),
ha AS (SELECT {gc} a, sum(n) AS n FROM cells GROUP BY ALL), hb AS (SELECT {gc} b, sum(n) AS n FROM cells GROUP BY ALL),
tot AS (SELECT {gc} sum(n) AS n FROM cells GROUP BY ALL)"""


@query("ev_qwk", with_(_RULES + "," + _KAPPA_SQL.format(g="", gc="", a="label", b="last_group", src="rules"), """
SELECT round(1 - (SELECT sum(n * power(a - b, 2)) FROM cells) * (SELECT sum(n) FROM cells)
  / (SELECT sum(ha.n * hb.n * power(a - b, 2)) FROM ha, hb), 6) AS kappa"""))
def ev_qwk(t):
    return rounded(_rules(t).agg(st.quadratic_kappa("label", "last_group").alias("kappa")))


@query("ev_qwk_labels", with_(_KAPPA_SQL.format(g="", gc="", a="quality", b="toxic", src="labels"), """
SELECT round(1 - (SELECT sum(n * power(a - b, 2)) FROM cells) * (SELECT sum(n) FROM cells)
  / (SELECT sum(ha.n * hb.n * power(a - b, 2)) FROM ha, hb), 6) AS kappa"""))
def ev_qwk_labels(t):
    return rounded(t["labels"].agg(st.quadratic_kappa("quality", "toxic").alias("kappa")))


@query("ev_kappa", with_(_RULES + "," + _KAPPA_SQL.format(g="", gc="", a="label", b="last_group", src="rules"), """
SELECT round(1 - (SELECT sum(CASE WHEN a <> b THEN n ELSE 0 END) FROM cells) * (SELECT sum(n) FROM cells)
  / (SELECT sum(CASE WHEN a <> b THEN ha.n * hb.n ELSE 0 END) FROM ha, hb), 6) AS kappa"""))
def ev_kappa(t):
    return rounded(st.kappa(_rules(t), "label", "last_group"))


_ESSAYS = """
scored AS (SELECT d.lang AS g, d.doc_id, CAST(d.n_chars AS DOUBLE) AS weight, l.quality AS a, l.toxic AS b
           FROM documents d JOIN labels l USING (doc_id)),
gk AS (SELECT g, min_by(weight, doc_id) AS weight,
         1 - avg(power(a - b, 2)) / nullif(avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b), 0) AS kappa
       FROM scored GROUP BY g)"""


def _essays(t):
    scored = t["documents"].select(
        "doc_id", F.col("lang").alias("essay_set"), F.col("n_chars").cast("double").alias("essay_weight")
    ).join(t["labels"].select("doc_id", F.col("quality").alias("essay_score")), "doc_id")
    return scored, t["labels"].select("doc_id", F.col("toxic").alias("predicted_score"))


_Z = "0.5 * ln((1 + greatest(least(kappa, 0.999), -0.999)) / (1 - greatest(least(kappa, 0.999), -0.999)))"


@query("ev_mean_qwk", with_(_ESSAYS, f"SELECT round(tanh(avg({_Z})), 6) AS mean_kappa FROM gk"))
def ev_mean_qwk(t):
    solution, submission = _essays(t)
    return rounded(st.mean_kappa(st.group_kappa(solution, submission, "doc_id")))


@query("ev_group_qwk", with_(_ESSAYS, f"""
SELECT round(tanh(avg({_Z} * weight / (SELECT avg(weight) FROM gk))), 6) AS mean_kappa FROM gk"""))
def ev_group_qwk(t):
    solution, submission = _essays(t)
    return rounded(st.mean_kappa(st.group_kappa(solution, submission, "doc_id"), weight="weight"))


@query("ev_accuracy", with_(_RULES, """
SELECT round(avg(CASE WHEN label = last_group THEN 1.0 ELSE 0 END), 6) AS accuracy FROM rules"""))
def ev_accuracy(t):
    return rounded(_rules(t).agg(st.accuracy("label", "last_group").alias("accuracy")))


@query("ev_models", with_(_RULES, """
SELECT model, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END), 6) AS accuracy,
  round(1 - avg(power(label - prediction, 2)) / nullif(avg(label * label) + avg(prediction * prediction)
    - 2 * avg(label) * avg(prediction), 0), 6) AS kappa FROM long GROUP BY model"""))
def ev_models(t):
    return rounded(e.score_models(_long(t)))


@query("ev_confusion", with_(_RULES, """
SELECT g.a, h.b, count(r.label) AS n FROM range(0, 4) g(a) CROSS JOIN range(0, 4) h(b)
LEFT JOIN rules r ON r.last_group = g.a AND r.label = h.b GROUP BY g.a, h.b"""))
def ev_confusion(t):
    return st.confusion(_rules(t), "last_group", "label", 0, 3)


@query("ev_report", with_(_RULES, """
, classes AS (SELECT label AS c FROM rules UNION SELECT last_group FROM rules),
s AS (SELECT c, (SELECT count(*) FROM rules WHERE label = c AND last_group = c) AS hit,
             (SELECT count(*) FROM rules WHERE last_group = c) AS said,
             (SELECT count(*) FROM rules WHERE label = c) AS support FROM classes),
p AS (SELECT CAST(c AS VARCHAR) AS class, coalesce(hit / nullif(said, 0), 0.0) AS p,
             coalesce(hit / nullif(support, 0), 0.0) AS r,
             coalesce(2.0 * hit / nullif(said + support, 0), 0.0) AS f, support FROM s)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM p
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM p
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM p"""))
def ev_report(t):
    return rounded(st.report(_rules(t), "label", "last_group"))


@query("ev_improvement", with_(_RULES, """
, k AS (SELECT model, 1 - avg(power(label - prediction, 2)) / nullif(avg(label * label) + avg(prediction * prediction)
    - 2 * avg(label) * avg(prediction), 0) AS kappa FROM long GROUP BY model)
SELECT round(100 * (max(CASE WHEN model = 'mean' THEN kappa END) - max(CASE WHEN model = 'last' THEN kappa END))
  / max(CASE WHEN model = 'last' THEN kappa END), 4) AS improvement FROM k"""))
def ev_improvement(t):
    scores = e.score_models(_long(t))
    of = {name: F.max(F.when(F.col("model") == name, F.col("kappa"))) for name in ("last", "mean")}
    return rounded(scores.agg(st.improvement(of["last"], of["mean"]).alias("improvement")), 4)


@query("job_bagged")
def job_bagged(t):
    """Entry 2: rich features, correlated columns, bagged vote over the earlier assessments, submission file."""
    table = assemble.create_features(t.log, ALL_TITLES, assemble.RICH, t.hot)
    final = materialize(assemble.with_labels(table, t.labels))
    ids = holdout.last_assessment(t.assessments)
    last, earlier = (materialize(final.join(ids, KEYS, how)) for how in ("left_semi", "left_anti"))
    columns = e.correlated_columns(earlier, assemble.feature_columns(earlier), "accuracy_group")
    voted = e.bagged_vote(earlier, last, KEYS, columns)
    return _submitted(t, voted)


def _submitted(t, predictions):
    """The submission file of predictions, read again."""
    path = t.scratch()
    files.write_submission(predictions, path, "prediction")
    return files.read_csv(t.spark, path, "installation_id long, accuracy_group int")


@query("job_holdout")
def job_holdout(t):
    """Entry 1: the basic features of each player's earlier assessments, one forest, the last ones predicted."""
    data = Learning(t)
    return _submitted(t, data.predictions(m.forest_of("holdout")))


@query("job_stacked")
def job_stacked(t):
    """Entry 3: stacked features, six base models over ten folds, the meta-model's predictions as a submission file."""
    return _submitted(t, _stacked(Learning(t)))


@query("job_trimmed")
def job_trimmed(t):
    """Entry 4: the trimmed features, a random search over three folds, a forest of its best settings as a submission file."""
    final = materialize(assemble.create_features(t.log, ALL_TITLES, assemble.TRIMMED, t.hot))  # brings its own label
    last, earlier = map(materialize, holdout.split_last(final))
    columns = assemble.feature_columns(final)
    train, test = (materialize(m.assemble(d, columns)) for d in (earlier, last))
    best = e.best_settings(e.random_search(train, KEYS))
    return _submitted(t, m.Trees(best).fit(train).transform(test))
