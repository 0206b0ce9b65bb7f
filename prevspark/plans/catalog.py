"""The engine's named queries over the standard tables, with DuckDB SQL for each that SQL can express.

Two tasks serve them. *Languages*: a document's language (de, en, es, fr), told by its accented letters, per source.
*Quantities*: the band of a line item's quantity, unfolded from quantity times (1 - discount), trained on finished lines
(status F) and estimated for the open ones of each supplier.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prevspark.functions import expressions as E
from prevspark.functions import metrics as M
from prevspark.operators import methods as Q
from prevspark.operators import protocols as P
from prevspark.operators import solvers as S
from prevspark.operators.classifiers import MLClassifier, SqlScorer
from prevspark.operators.transformers import ENTRIES, LABEL, ClassTransformer, HistogramTransformer, tree_with_bins
from prevspark.plans import drivers as D
from prevspark.plans import evaluate as V
from prevspark.sources import tables
from prevspark.streaming import windowed as W

BINS, STEPS = 10, 100
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the language task

CLASSES = "CASE WHEN regexp_like(text, '[äöüß]') THEN 0 WHEN regexp_like(text, '[ñíó¿¡]') THEN 2 WHEN regexp_like(text, '[éèêàç]') THEN 3 ELSE 1 END"
# one lambda over an array of one, so that the patterns are tried once a row
POSTERIOR = f"element_at(transform(array({CLASSES}), k -> transform(array(0, 1, 2, 3), c -> CASE WHEN c = k THEN 0.85D ELSE 0.05D END)), 1)"
LANG = SqlScorer(POSTERIOR, 4)


def languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, label, text) of documents to train on and to estimate for, halves by the hash of the id.

    Labels are 0 to 3 in order of the language's code.
    """
    docs = table(spark, sf_dir, "documents")
    label = F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang")).cast("int") - 1
    rows = docs.select("doc_id", "source", label.alias("label"), "text")
    first = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8"
    return rows.where(first), rows.where(~first)


LANG_SQL = """WITH RECURSIVE d AS (
  SELECT source, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS label,
    CASE WHEN regexp_matches(text, '[äöüß]') THEN 0 WHEN regexp_matches(text, '[ñíó¿¡]') THEN 2
      WHEN regexp_matches(text, '[éèêàç]') THEN 3 ELSE 1 END AS said, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS train
  FROM documents
), k AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS class),
s AS (SELECT source, count(*) AS n FROM d WHERE NOT train GROUP BY source),
q AS (SELECT s.source, k.class, count(d.said) * 1.0 / any_value(s.n) AS q
  FROM s CROSS JOIN k LEFT JOIN d ON d.source = s.source AND d.said = k.class AND NOT d.train GROUP BY s.source, k.class),
m AS (SELECT a.class AS f, b.class AS c, count(d.said) * 1.0 / (SELECT count(*) FROM d WHERE label = b.class AND train) AS m
  FROM k a CROSS JOIN k b LEFT JOIN d ON d.said = a.class AND d.label = b.class AND d.train GROUP BY a.class, b.class),
t AS (SELECT label AS class, count(*) * 1.0 / (SELECT count(*) FROM d WHERE train) AS p_trn FROM d WHERE train GROUP BY label)
"""


def long(found: DataFrame, bag: str, digits: int = 6) -> DataFrame:
    """(bag, class, p) of estimates, rounded."""
    return found.select(bag, F.posexplode("p").alias("class", "p")).withColumn("p", F.round("p", digits))


@query(LANG_SQL + "SELECT source, class, round(q, 6) AS p FROM q")
def cc(spark, sf_dir):
    """Classify and count."""
    train, test = languages(spark, sf_dir)
    return long(Q.CC(LANG).fit(train).transform(test, "source"), "source")


@query(LANG_SQL + "SELECT source, class, round(0.05 + 0.8 * q, 6) AS p FROM q")
def pcc(spark, sf_dir):
    """Average posteriors."""
    train, test = languages(spark, sf_dir)
    return long(Q.PCC(LANG).fit(train).transform(test, "source"), "source")


@query(LANG_SQL + """, r AS (
  SELECT q.source, q.class, (1 - m.m * p_trn) / (1 - p_trn) AS fpr, m.m AS tpr, q.q
  FROM q JOIN m ON m.f = q.class AND m.c = q.class JOIN t ON t.class = q.class
), x AS (SELECT source, class, greatest(0.0, least(1.0, (q - fpr) / (tpr - fpr))) AS p FROM r)
SELECT source, class, round(p / sum(p) OVER (PARTITION BY source), 6) AS p FROM x""")
def acc_ovr(spark, sf_dir):
    """One-versus-rest adjustment."""
    train, test = languages(spark, sf_dir)
    return long(Q.ACC(LANG, strategy="ovr").fit(train).transform(test, "source"), "source")


@query(LANG_SQL + "SELECT CAST(f AS INTEGER) AS f, CAST(c AS INTEGER) AS c, round(m, 6) AS m FROM m WHERE m > 0")
def crisp_argmax(spark, sf_dir):
    """Transfer matrix of the crisp language predictions."""
    _, rows = ClassTransformer(LANG).fit(languages(spark, sf_dir)[0], "label")
    cells = rows.groupBy(F.col(ENTRIES)[0]["f"].alias("f"), F.col(LABEL).alias("c")).count()
    total = F.sum("count").over(window_over("c"))
    return cells.select("f", "c", F.round(F.col("count") / total, 6).alias("m"))


def window_over(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


@query(LANG_SQL + "SELECT class, round(p_trn, 6) AS p FROM t")
def p_trn(spark, sf_dir):
    """Class shares of the training rows, as a fitted method has them."""
    shares_ = Q.ACC(LANG).fit(languages(spark, sf_dir)[0]).p_trn
    return spark.createDataFrame([(c, round(float(p), 6)) for c, p in enumerate(shares_)], "class int, p double")


BINARY = SqlScorer("CASE WHEN regexp_like(text, '[äöüßñíó¿¡éèêàç]') THEN array(0.0D, 1.0D) ELSE array(1.0D, 0.0D) END", 2)


@query("""WITH d AS (
  SELECT source, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS y, CASE WHEN regexp_matches(text, '[äöüßñíó¿¡éèêàç]') THEN 1 ELSE 0 END AS said,
    substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS train FROM documents
), m AS (SELECT avg(CASE WHEN y = 0 THEN 1.0 - said END) AS a, avg(CASE WHEN y = 1 THEN 1.0 - said END) AS b FROM d WHERE train),
q AS (SELECT source, avg(1.0 - said) AS q0 FROM d WHERE NOT train GROUP BY source),
x AS (SELECT source, greatest(0.0, least(1.0, (q0 - b) / (a - b))) AS p0, greatest(0.0, least(1.0, (a - q0) / (a - b))) AS p1 FROM q, m)
SELECT source, 0 AS class, round(p0 / (p0 + p1), 6) AS p FROM x UNION ALL SELECT source, 1, round(p1 / (p0 + p1), 6) FROM x""")
def acc_inv_2x2(spark, sf_dir):
    """Adjustment by the inverse of a 2 x 2 transfer matrix: English or not."""
    train, test = [x.withColumn("label", F.when(F.col("label") == 1, 0).otherwise(1)) for x in languages(spark, sf_dir)]
    return long(Q.ACC(BINARY, strategy="inv").fit(train).transform(test, "source"), "source")


EM_STEP = """list_transform(range(1, {C} + 1), lambda c: list_sum(list_transform(range(1, {F} + 1), lambda f:
      CASE WHEN list_sum(list_transform(range(1, {C} + 1), lambda k: m[f][k] * p[k])) > 0 THEN
        m[f][c] * p[c] * q[f] / list_sum(list_transform(range(1, {C} + 1), lambda k: m[f][k] * p[k])) ELSE 0 END)))"""


@query(LANG_SQL + f""", ml AS (
  SELECT list_transform(range(1, 5), lambda f: list_transform(range(1, 5), lambda c: (CASE WHEN f = c THEN 0.85 ELSE 0.05 END) / pt[c])) AS m, pt
  FROM (SELECT list(p_trn ORDER BY class) AS pt FROM t)
), ql AS (SELECT source, list(q ORDER BY class) AS q FROM q GROUP BY source),
em AS (
  SELECT 0 AS i, source, q, m, pt AS p FROM ql, ml
  UNION ALL
  SELECT i + 1, source, q, m, {EM_STEP.format(C=4, F=4)} FROM em WHERE i < {STEPS}
) SELECT source, CAST(c - 1 AS INTEGER) AS class, round(p[c], 6) AS p FROM (SELECT source, p, unnest(range(1, 5)) AS c FROM em WHERE i = {STEPS})""")
def sld_k(spark, sf_dir):
    """EM over posteriors, all its hundred steps."""
    train, test = languages(spark, sf_dir)
    return long(Q.SLD(LANG).fit(train).transform(test, "source"), "source")


# the quantity task


def quantities(spark: SparkSession, sf_dir: str, classes: int = 5) -> DataFrame:
    """(bag, status, label, features) of line items."""
    band = F.floor((F.col("l_quantity") - 1) / (50 // classes)).cast("int")
    x = F.col("l_quantity") * (1 - F.col("l_discount"))
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_suppkey").alias("bag"), F.col("l_linestatus").alias("status"), band.alias("label"), F.array(x).alias("features"))


def halves(spark, sf_dir, classes: int = 5) -> tuple[DataFrame, DataFrame]:
    rows = quantities(spark, sf_dir, classes)
    return rows.where("status = 'F'"), rows.where("status = 'O'")


def quantity_sql(classes: int = 5, recursive: str = "") -> str:
    return f"""WITH {recursive} r AS (
  SELECT l_suppkey AS bag, l_linestatus AS status, CAST(floor((l_quantity - 1) / {50 // classes}) AS INTEGER) AS c, l_quantity * (1 - l_discount) AS x FROM lineitem
), e AS (SELECT min(x) AS lo, max(x) AS hi FROM r WHERE status = 'F'),
b AS (SELECT r.*, CAST(len(list_filter(range(1, {BINS}), lambda k: lo + k * (hi - lo) / {BINS} < x)) AS INTEGER) AS f FROM r, e),
ks AS (SELECT CAST(unnest(range({classes})) AS INTEGER) AS c), fs AS (SELECT CAST(unnest(range({BINS})) AS INTEGER) AS f),
m AS (SELECT fs.f, ks.c, count(b.x) * 1.0 / (SELECT count(*) FROM b WHERE status = 'F' AND c = ks.c) AS m
  FROM fs CROSS JOIN ks LEFT JOIN b ON b.f = fs.f AND b.c = ks.c AND b.status = 'F' GROUP BY fs.f, ks.c),
n AS (SELECT bag, count(*) AS n FROM b WHERE status = 'O' GROUP BY bag),
q AS (SELECT n.bag, fs.f, count(b.x) * 1.0 / any_value(n.n) AS q, any_value(n.n) AS n
  FROM n CROSS JOIN fs LEFT JOIN b ON b.bag = n.bag AND b.f = fs.f AND b.status = 'O' GROUP BY n.bag, fs.f)
"""


QUANT = quantity_sql()
HIST = HistogramTransformer(BINS)


def fitted_vectors(spark, sf_dir, classes: int = 5):
    """The fitted IBU over histograms, and (bag_, n, q) of every supplier's open lines."""
    train, test = halves(spark, sf_dir, classes)
    model = Q.IBU(HIST).fit(train)
    return model, model.vectors(test, "bag")


@query(QUANT + f"SELECT CAST(k AS INTEGER) AS k, round(lo + k * (hi - lo) / {BINS}, 6) AS edge FROM e, (SELECT unnest(range(1, {BINS})) AS k)")
def hist_edges(spark, sf_dir):
    """Inner edges of the feature's histogram."""
    train, _ = halves(spark, sf_dir)
    bounds = train.agg(F.min(F.col("features")[0]).alias("lo"), F.max(F.col("features")[0]).alias("hi"))
    edges = bounds.select(F.posexplode(E.inner_edges(F.col("lo"), F.col("hi"), BINS)).alias("k", "edge"))
    return edges.select((F.col("k") + 1).alias("k"), F.round("edge", 6).alias("edge"))


@query(QUANT + "SELECT status, f, count(*) AS n FROM b GROUP BY status, f")
def hist_bins(spark, sf_dir):
    """Rows of each bin."""
    train, test = halves(spark, sf_dir)
    fitted, _ = HIST.fit(train, "label")
    rows = fitted.transform(train.unionByName(test))
    return rows.groupBy("status", F.col(ENTRIES)[0]["f"].alias("f")).agg(F.count("*").alias("n"))


@query(QUANT + "SELECT f, c, round(m, 6) AS m FROM m WHERE m > 0")
def transfer_matrix(spark, sf_dir):
    """The bins' shares of each class."""
    train, _ = halves(spark, sf_dir)
    _, rows = HIST.fit(train, "label")
    cells = rows.groupBy(F.col(ENTRIES)[0]["f"].alias("f"), F.col(LABEL).alias("c")).count()
    return cells.select("f", "c", F.round(F.col("count") / F.sum("count").over(window_over("c")), 6).alias("m"))


@query(QUANT + "SELECT bag, f, n, round(q, 6) AS q FROM q")
def bag_q(spark, sf_dir):
    """Feature means of every supplier's open lines."""
    _, vectors = fitted_vectors(spark, sf_dir)
    return vectors.select(F.col("bag_").alias("bag"), "n", F.posexplode("q").alias("f", "q")).withColumn("q", F.round("q", 6))


@query(QUANT + """SELECT n.bag, fs.f, round(0.5 * count(b.x) / any_value(n.n), 6) AS b
FROM n CROSS JOIN fs LEFT JOIN b ON b.bag = n.bag AND b.f = fs.f AND b.status = 'F' GROUP BY n.bag, fs.f""")
def background_vector(spark, sf_dir):
    """Half the finished lines of every supplier as the background of its open ones."""
    train, test = halves(spark, sf_dir)
    model = Q.HDx(BINS).fit(train)
    both = train.unionByName(test).withColumn("behind", F.col("status") == "F")
    found = model.vectors(both, "bag", "behind", 0.5).where("n > 0")
    return found.select(F.col("bag_").alias("bag"), F.posexplode("b").alias("f", "b")).withColumn("b", F.round("b", 6))


@query(QUANT + f"SELECT bag, f, round(sqrt(1 + greatest(1, n - {BINS}) * q) / avg(sqrt(1 + greatest(1, n - {BINS}) * q)) OVER (PARTITION BY bag), 6) AS w FROM q")
def svd_weights(spark, sf_dir):
    """Statistical weights of the features."""
    _, vectors = fitted_vectors(spark, sf_dir)
    w = E.svd_weights(F.col("q"), F.col("n"))
    return vectors.select(F.col("bag_").alias("bag"), F.posexplode(w).alias("f", "w")).withColumn("w", F.round("w", 6))


@query(QUANT + """, x AS (SELECT bag, f, greatest(0.0, least(1.0, 3 * q - 0.1)) AS x FROM q)
SELECT bag, f, round(x / sum(x) OVER (PARTITION BY bag), 6) AS x FROM x""")
def clip_normalize(spark, sf_dir):
    """Clamping and normalising a vector."""
    _, vectors = fitted_vectors(spark, sf_dir)
    x = E.clip_and_normalize(F.transform("q", lambda v: 3 * v - 0.1))
    return vectors.select(F.col("bag_").alias("bag"), F.posexplode(x).alias("f", "x")).withColumn("x", F.round("x", 6))


@query(quantity_sql(2) + """, g AS (
  SELECT sum(a.m * a.m) AS aa, sum(a.m * b.m) AS ab, sum(b.m * b.m) AS bb FROM m a JOIN m b ON a.f = b.f WHERE a.c = 0 AND b.c = 1
), v AS (SELECT q.bag, sum(CASE WHEN m.c = 0 THEN m.m * q.q END) AS va, sum(CASE WHEN m.c = 1 THEN m.m * q.q END) AS vb FROM q JOIN m ON m.f = q.f GROUP BY q.bag),
x AS (SELECT bag, greatest(0.0, least(1.0, (bb * va - ab * vb) / (aa * bb - ab * ab))) AS p0, greatest(0.0, least(1.0, (aa * vb - ab * va) / (aa * bb - ab * ab))) AS p1 FROM v, g)
SELECT bag, 0 AS class, round(p0 / (p0 + p1), 6) AS p FROM x UNION ALL SELECT bag, 1, round(p1 / (p0 + p1), 6) FROM x""")
def acc_pinv_normal_eq(spark, sf_dir):
    """Least-squares adjustment of two classes over ten bins."""
    model, vectors = fitted_vectors(spark, sf_dir, 2)
    return long(vectors.select(F.col("bag_").alias("bag"), E.pinv(model.M, F.col("q")).alias("p")), "bag")


def em_sql(smooth: bool) -> str:
    step = EM_STEP.format(C=5, F=BINS)
    prior = "list_transform(x, lambda v: 0.1::DOUBLE * 0.2 + 0.9 * v / list_sum(x))" if smooth else "x"
    return quantity_sql(5, "RECURSIVE") + f""", ml AS (SELECT list(row ORDER BY f) AS m FROM (SELECT f, list(m ORDER BY c) AS row FROM m GROUP BY f)),
ql AS (SELECT bag, list(q ORDER BY f) AS q FROM q GROUP BY bag),
em AS (
  SELECT 0 AS i, bag, q, m, CAST([0.2, 0.2, 0.2, 0.2, 0.2] AS DOUBLE[]) AS p, CAST([0.2, 0.2, 0.2, 0.2, 0.2] AS DOUBLE[]) AS x FROM ql, ml
  UNION ALL
  SELECT i + 1, bag, q, m, {prior} AS p, x FROM (SELECT i, bag, q, m, {step} AS x FROM em WHERE i < {STEPS})
) SELECT bag, CAST(c - 1 AS INTEGER) AS class, round(x[c], 6) AS p FROM (SELECT bag, x, unnest(range(1, 6)) AS c FROM em WHERE i = {STEPS})"""


@query(em_sql(False))
def ibu_k(spark, sf_dir):
    """Iterative Bayesian unfolding, all its hundred steps."""
    train, test = halves(spark, sf_dir)
    return long(Q.IBU(HIST).fit(train).transform(test, "bag"), "bag")


@query(em_sql(True))
def ibu_smoothed_o0(spark, sf_dir):
    """The same with a tenth of a constant mixed into each prior."""
    train, test = halves(spark, sf_dir)
    return long(Q.IBU(HIST, o=0, lam=0.1).fit(train).transform(test, "bag"), "bag")


def em_linear_sql() -> str:
    step = EM_STEP.format(C=5, F=BINS)
    line = "list_transform(range(1, 6), lambda c: greatest(0.0, list_avg(x) + (c - 3) * (2 * x[5] + x[4] - x[2] - 2 * x[1]) / 10))"
    return quantity_sql(5, "RECURSIVE") + f""", ml AS (SELECT list(row ORDER BY f) AS m FROM (SELECT f, list(m ORDER BY c) AS row FROM m GROUP BY f)),
ql AS (SELECT bag, list(q ORDER BY f) AS q FROM q GROUP BY bag),
em AS (
  SELECT 0 AS i, bag, q, m, CAST([0.2, 0.2, 0.2, 0.2, 0.2] AS DOUBLE[]) AS p, CAST([0.2, 0.2, 0.2, 0.2, 0.2] AS DOUBLE[]) AS x FROM ql, ml
  UNION ALL
  SELECT i + 1, bag, q, m, list_transform(y, lambda v: v / list_sum(y)), x FROM (
    SELECT *, list_transform(range(1, 6), lambda c: 0.5 * e[c] / list_sum(e) + 0.5 * x[c]) AS y FROM (
      SELECT *, {line} AS e FROM (SELECT i, bag, q, m, {step} AS x FROM em WHERE i < {STEPS})))
) SELECT bag, CAST(c - 1 AS INTEGER) AS class, round(x[c], 6) AS p FROM (SELECT bag, x, unnest(range(1, 6)) AS c FROM em WHERE i = {STEPS})"""


@query(em_linear_sql())
def ibu_smoothed_o1(spark, sf_dir):
    """The same with half of a straight line mixed into each prior."""
    train, test = halves(spark, sf_dir)
    return long(Q.IBU(HIST, o=1, lam=0.5).fit(train).transform(test, "bag"), "bag")


# the objectives, at uniform prevalences


def objective(spark, sf_dir, loss) -> DataFrame:
    """The solver's ``loss(M, q, n)`` of every bag at p = (1/5, ..., 1/5)."""
    model, vectors = fitted_vectors(spark, sf_dir)
    matrix = model.M

    @F.pandas_udf("double")
    def value(q: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([loss(matrix, np.asarray(x, dtype=float), float(k))(np.full(5, 0.2))[0] for x, k in zip(q, n)], dtype=float)

    return vectors.select(F.col("bag_").alias("bag"), F.round(value("q", "n"), 6).alias("loss"))


MEAN_SQL = QUANT + ", u AS (SELECT f, avg(m) AS mp FROM m GROUP BY f)\n"


@query(MEAN_SQL + "SELECT bag, round(sum((q - mp) * (q - mp)), 6) AS loss FROM q JOIN u USING (f) GROUP BY bag")
def lsq_loss(spark, sf_dir):
    """Least-squares objective."""
    return objective(spark, sf_dir, lambda m, q, n: S.least_squares(m, q, np.ones(len(q))))


@query(MEAN_SQL + "SELECT bag, round(sum(n * mp - n * q * ln(n * mp)), 6) AS loss FROM q JOIN u USING (f) GROUP BY bag")
def ml_loss(spark, sf_dir):
    """Poisson likelihood objective."""
    return objective(spark, sf_dir, S.poisson)


@query(MEAN_SQL + "SELECT bag, round(sqrt(sum((sqrt(q) - sqrt(mp)) * (sqrt(q) - sqrt(mp)))), 6) AS loss FROM q JOIN u USING (f) GROUP BY bag")
def hellinger_loss(spark, sf_dir):
    """Hellinger distance."""
    return objective(spark, sf_dir, lambda m, q, n: S.hellinger(m, q, np.zeros(len(q)), np.zeros(len(q), dtype=int)))


# metrics of every supplier's band shares against those of all lines

SHARES_SQL = QUANT + """, a AS (SELECT c, count(*) * 1.0 / (SELECT count(*) FROM r) AS p FROM r GROUP BY c),
s AS (SELECT g.bag, a.c, a.p, count(r.x) * 1.0 / any_value(g.n) AS f, any_value(g.n) AS n
  FROM (SELECT bag, count(*) AS n FROM r GROUP BY bag) g CROSS JOIN a LEFT JOIN r ON r.bag = g.bag AND r.c = a.c GROUP BY g.bag, a.c, a.p)
"""


def shares(spark, sf_dir) -> DataFrame:
    """(bag, p, found, n): band shares of all lines and of each supplier's."""
    rows = quantities(spark, sf_dir)
    counts = rows.groupBy("bag").agg(F.count("*").alias("n"), *[F.sum((F.col("label") == c).cast("int")).alias(f"c{c}") for c in range(5)])
    all_rows = rows.groupBy().agg(F.array(*[F.avg((F.col("label") == c).cast("double")) for c in range(5)]).alias("p"))
    found = F.array(*[F.col(f"c{c}") / F.col("n") for c in range(5)])
    return counts.select("bag", "n", found.alias("found")).join(F.broadcast(all_rows))


def metric(spark, sf_dir, name: str, value: Column) -> DataFrame:
    return shares(spark, sf_dir).select("bag", (F.round(value, 6) if name != "is_pdf" else value).alias(name))



@query(SHARES_SQL + "SELECT bag, round(avg(abs(p - f)), 6) AS ae FROM s GROUP BY bag")
def ae(spark, sf_dir):
    """Mean absolute error."""
    return metric(spark, sf_dir, "ae", M.absolute_error(F.col("p"), F.col("found")))


@query(SHARES_SQL + "SELECT bag, round(sum(abs(p - f)), 6) AS l1 FROM s GROUP BY bag")
def l1(spark, sf_dir):
    """Sum of absolute errors."""
    return metric(spark, sf_dir, "l1", M.l1_error(F.col("p"), F.col("found")))


@query(SHARES_SQL + """, z AS (SELECT *, (p + 1 / (2.0 * n)) / (1 + 5 / (2.0 * n)) AS sp, (f + 1 / (2.0 * n)) / (1 + 5 / (2.0 * n)) AS sf FROM s)
SELECT bag, round(avg(abs(sp - sf) / sp), 6) AS rae FROM z GROUP BY bag""")
def rae(spark, sf_dir):
    """Mean relative error of smoothed prevalences."""
    return metric(spark, sf_dir, "rae", M.relative_absolute_error(F.col("p"), F.col("found"), F.col("n")))


@query(SHARES_SQL + "SELECT bag, abs(sum(f) - 1) < 1e-8 AND min(f) > -1e-8 AS is_pdf FROM s GROUP BY bag")
def is_pdf(spark, sf_dir):
    """Whether an estimate is a distribution."""
    return metric(spark, sf_dir, "is_pdf", M.is_pdf(F.col("found")))


CUMULATED = ", z AS (SELECT bag, c, p, sum(p - f) OVER (PARTITION BY bag ORDER BY c) AS gap FROM s)\n"


@query(SHARES_SQL + CUMULATED + "SELECT bag, round(sum(abs(gap)) / sum(p), 6) AS mdpa FROM z GROUP BY bag")
def mdpa(spark, sf_dir):
    """Minimum difference of pair assignments."""
    return metric(spark, sf_dir, "mdpa", M.mdpa(F.col("p"), F.col("found")))


@query(SHARES_SQL + CUMULATED + "SELECT bag, round(sum(abs(gap)) / sum(p) / 4, 6) AS nmd FROM z GROUP BY bag")
def nmd(spark, sf_dir):
    """Normalised match distance."""
    return metric(spark, sf_dir, "nmd", M.nmd(F.col("p"), F.col("found")))


BEND = ", z AS (SELECT bag, 2 * f - lag(f) OVER w - lead(f) OVER w AS d FROM s WINDOW w AS (PARTITION BY bag ORDER BY c))\n"


@query(SHARES_SQL + BEND + "SELECT bag, round(sum(d * d) / 2, 6) AS curvature FROM z GROUP BY bag")
def curvature(spark, sf_dir):
    """Half the squared second differences."""
    return metric(spark, sf_dir, "curvature", M.curvature(F.col("found")))


@query(SHARES_SQL + BEND + "SELECT bag, round(10.0 / 2 * sum(d * d), 6) AS penalty FROM z GROUP BY bag")
def tikhonov(spark, sf_dir):
    """The solvers' regulariser at strength ten."""

    @F.pandas_udf("double")
    def value(found: pd.Series) -> pd.Series:
        total = S.regularised(lambda p: (0.0, np.zeros(5), np.zeros((5, 5))), 10.0, None, 0.0, 5)
        return pd.Series([total(np.asarray(x, dtype=float))[0] for x in found], dtype=float)

    return metric(spark, sf_dir, "penalty", value("found"))


@query(SHARES_SQL + """, z AS (SELECT *, f / (c + 1) AS x FROM s), y AS (SELECT *, log10(1 + x / sum(x) OVER (PARTITION BY bag) * (n - 5)) AS y FROM z)
SELECT bag, c AS class, round(y / sum(y) OVER (PARTITION BY bag), 6) AS density FROM y""")
def log10_density(spark, sf_dir):
    """Density of the logarithmic spectrum."""
    x = M.log10_density(F.col("found"), E.vector([1, 2, 3, 4, 5]), F.col("n"))
    return shares(spark, sf_dir).select("bag", F.posexplode(x).alias("class", "density")).withColumn("density", F.round("density", 6))


@query("""WITH g AS (SELECT bag, c, p, (c + 1.0) AS a, exp(-0.7 * c) AS flux FROM (""" + SHARES_SQL + """SELECT bag, c, f AS p FROM s))
SELECT bag, c AS class, round(p * a / sum(p * a) OVER w * sum(flux) OVER w, 6) AS flux FROM g WINDOW w AS (PARTITION BY bag)""")
def corrected_flux(spark, sf_dir):
    """Acceptance-corrected prevalences scaled to a reference flux."""
    flux = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.exp(-0.7 * c))
    x = M.corrected_flux(F.col("found"), E.vector([1, 2, 3, 4, 5]), flux)
    return shares(spark, sf_dir).select("bag", F.posexplode(x).alias("class", "flux")).withColumn("flux", F.round("flux", 6))


@query("SELECT p_partkey, round(1e10 * 3.23e-10 * pow(p_retailprice / 1000, -2.47 - 0.24 * log10(p_retailprice / 1000)), 6) AS flux FROM part")
def crab_flux(spark, sf_dir):
    """The reference flux at energies taken from prices."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(1e10 * M.crab_flux(F.col("p_retailprice")), 6).alias("flux"))


@query("""SELECT o_orderpriority AS priority, round(avg(o_totalprice), 4) AS mean, CAST(i AS INTEGER) AS i, round(q[i + 1], 4) AS value FROM (
  SELECT o_orderpriority, avg(o_totalprice) AS o_totalprice, quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, unnest(range(5)) AS i FROM orders GROUP BY o_orderpriority
) GROUP BY ALL""".replace("round(avg(o_totalprice), 4) AS mean", "round(o_totalprice, 4) AS mean").replace(") GROUP BY ALL", ")"))
def percentiles(spark, sf_dir):
    """Mean and interpolated quantiles of order prices by priority."""
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("mean"), M.percentiles("o_totalprice").alias("q")
    )
    return found.select("priority", "mean", F.posexplode("q").alias("i", "value")).withColumn("value", F.round("value", 4))


# sampling, selection and tables


@query("""WITH d AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS r FROM orders)
SELECT o_orderkey, o_orderpriority FROM d WHERE r <= CASE o_orderpriority WHEN '1-URGENT' THEN 50 WHEN '2-HIGH' THEN 30 ELSE 20 END
  AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def subsample_md5(spark, sf_dir):
    """A bag of 100 orders at prevalences 0.5, 0.3, 0.2 of the first three priorities."""
    names = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")])
    rows = table(spark, sf_dir, "orders").withColumn("label", F.array_position(names, F.col("o_orderpriority")).cast("int") - 1)
    return P.subsample(rows, "label", "o_orderkey", 100, [0.5, 0.3, 0.2]).select("o_orderkey", "o_orderpriority")


@query(SHARES_SQL + BEND + """, g AS (SELECT bag, sum(d * d) / 2 AS x FROM z GROUP BY bag)
SELECT bag, round(x, 6) AS curvature FROM g ORDER BY round(x, 9), bag LIMIT 5""")
def app_oq_topk(spark, sf_dir):
    """The five smoothest suppliers."""
    found = P.smoothest(shares(spark, sf_dir), F.col("found"), 5, ["bag"])
    return found.select("bag", F.round(M.curvature(F.col("found")), 6).alias("curvature"))


RESULTS_SQL = """WITH x AS (
  SELECT l_shipdate::DATE AS day, l_suppkey AS bag, l_returnflag AS method, CASE WHEN sum(l_tax) > 0.2 THEN avg(l_discount) END AS ae FROM lineitem GROUP BY ALL
), g AS (SELECT bag, method, round(avg(ae), 6) AS ae, round(stddev_samp(ae), 6) AS sd, sum(CASE WHEN ae IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_failures FROM x GROUP BY bag, method)
"""


def settled(x: Column, digits: int) -> Column:
    """``x`` rounded, ties upwards; as they are told at D.EXACT digits, the order in which a sum came about does not decide them."""
    return F.round(F.round(x, D.EXACT), digits)


def results(spark, sf_dir) -> DataFrame:
    """(bag, method, ae, sd, n_failures): errors by group, where small groups fail."""
    lines = table(spark, sf_dir, "lineitem")
    each = lines.groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("bag"), F.col("l_returnflag").alias("method")).agg(
        F.when(F.round(F.sum("l_tax"), D.EXACT) > 0.2, F.avg("l_discount")).alias("ae")
    )
    return each.groupBy("bag", "method").agg(
        settled(F.avg("ae"), 6).alias("ae"), settled(F.stddev_samp("ae"), 6).alias("sd"),
        F.sum(F.col("ae").isNull().cast("int")).alias("n_failures"),
    )


@query(RESULTS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY ae ASC NULLS LAST, method) AS i FROM g)
SELECT bag, method, ae, sd, n_failures FROM r WHERE i = 1""")
def argmin_per_group(spark, sf_dir):
    """The best method of each bag; missing errors come last."""
    return V.best(results(spark, sf_dir), ["bag"], "ae", ["method"])


@query(RESULTS_SQL + """SELECT coalesce(a.bag, b.bag) AS bag, a.ae AS ae, b.n_failures AS n_failures
FROM (SELECT bag, ae FROM g WHERE method = 'A') a FULL JOIN (SELECT bag, n_failures FROM g WHERE method = 'N' AND n_failures > 0) b ON a.bag = b.bag""")
def failure_outer_join(spark, sf_dir):
    """Errors of one method beside the failures of another, whichever exist."""
    found = results(spark, sf_dir)
    a = found.where("method = 'A'").select("bag", "ae")
    return a.join(found.where("method = 'N' AND n_failures > 0").select("bag", "n_failures"), "bag", "full")


@query(RESULTS_SQL + """SELECT bag, max(CASE WHEN method = 'A' THEN ae END) AS "A", max(CASE WHEN method = 'N' THEN ae END) AS "N", max(CASE WHEN method = 'R' THEN ae END) AS "R" FROM g GROUP BY bag""")
def pivot_table(spark, sf_dir):
    """Errors with a column for each method."""
    return results(spark, sf_dir).groupBy("bag").pivot("method", ["A", "N", "R"]).agg(F.first("ae"))


@query("""SELECT e.event_type AS kind, count(*) AS n, sum(CASE WHEN e.value > 50 THEN 1 ELSE 0 END)::BIGINT AS n_on, round(avg(ln(1 + abs(e.value))), 6) AS log_size,
  round(avg(sqrt(e.value * e.value + c.c_acctbal * c.c_acctbal)), 4) AS radius
FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.value > 25 OR e.event_type LIKE '%c%' GROUP BY e.event_type""")
def on_off_cut(spark, sf_dir):
    """Join, cuts and derived features of events."""
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    rows = e.join(c, e["user_id"] == c["c_custkey"]).where((F.col("value") > 25) | F.col("event_type").contains("c"))
    return rows.groupBy(F.col("event_type").alias("kind")).agg(
        F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("n_on"),
        F.round(F.avg(F.log(1 + F.abs("value"))), 6).alias("log_size"),
        F.round(F.avg(F.sqrt(F.col("value") ** 2 + F.col("c_acctbal") ** 2)), 4).alias("radius"),
    )


# numeric strategies: DuckDB finds the same optimum by multiplicative steps on the simplex


def simplex_sql(base: str, bag: str, C: int, ready: str, step: str, steps: int, digits: int) -> str:
    """SQL for p of each bag after ``steps`` steps from even prevalences.

    ``ready`` selects (bag, what a step needs); ``step`` gives entry c of the next p, which is normalised.
    """
    return base + f""", ready AS ({ready}), w AS (
  SELECT 0 AS i, r.*, CAST(list_transform(range({C}), lambda c: 1.0 / {C}) AS DOUBLE[]) AS p FROM ready r
  UNION ALL
  SELECT i + 1, * EXCLUDE (i, p, x), list_transform(x, lambda v: v / list_sum(x)) FROM (SELECT *, list_transform(range(1, {C} + 1), lambda c: {step}) AS x FROM w WHERE i < {steps})
) SELECT bag AS {bag}, CAST(c - 1 AS INTEGER) AS class, round(p[c], {digits}) AS p FROM (SELECT bag, p, unnest(range(1, {C} + 1)) AS c FROM w WHERE i = {steps})"""


def rows_sql(m: str, q: str, bag: str, extra: str = "") -> str:
    """(bag, q list, mt list of M's columns, other columns) from tables m (f, c, m) and q (bag, f, q)."""
    return f"""SELECT a.*, b.mt{extra} FROM (SELECT {bag} AS bag, list(CAST({q} AS DOUBLE) ORDER BY f) AS q, any_value(n) AS n FROM qs GROUP BY {bag}) a,
  (SELECT list(col ORDER BY c) AS mt FROM (SELECT c, list(CAST({m} AS DOUBLE) ORDER BY f) AS col FROM m GROUP BY c)) b"""


LANG_Q = LANG_SQL + ", qs AS (SELECT source, class AS f, q, 0 AS n FROM q)"
QUANT_Q = quantity_sql(5, "RECURSIVE") + ", qs AS (SELECT * FROM q)"


def lsq_sql(base: str, bag: str, C: int, m: str = "m", q: str = "q", weight: str = "1.0", tau: float = 0.0, rate: float = 1.0, steps: int = 3000, digits: int = 4, latent: str = "") -> str:
    """Least squares on the simplex: p * exp(-rate * gradient). ``latent`` is that of the squared latent values, as it is for p."""
    bend = f"+ {tau} / 2 * (CASE WHEN abs(a - b) > 2 THEN 0 ELSE list_sum(list_transform(range(1, {C} - 1), lambda t: (CASE a - t WHEN 0 THEN -1 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE 0 END) * (CASE b - t WHEN 0 THEN -1 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE 0 END))) END)" if tau else ""
    ready = f"""SELECT bag, list_transform(range(1, {C} + 1), lambda a: list_transform(range(1, {C} + 1), lambda b: CAST(list_sum(list_transform(range(1, len(q) + 1), lambda f: mt[a][f] * mt[b][f] / (v[f] * v[f]))) {bend} AS DOUBLE))) AS g,
      list_transform(range(1, {C} + 1), lambda a: CAST(list_sum(list_transform(range(1, len(q) + 1), lambda f: mt[a][f] * q[f] / (v[f] * v[f]))) AS DOUBLE)) AS h
    FROM (SELECT bag, q, mt, list_transform(u, lambda x: x / list_avg(u)) AS v FROM (SELECT *, list_transform(q, lambda x: CAST({weight} AS DOUBLE)) AS u FROM ({rows_sql(m, q, bag)})))"""
    return simplex_sql(base, bag, C, ready, f"p[c] * exp(-{rate} * (list_dot_product(g[c], p) - h[c] {latent}))", steps, digits)


def likelihood_sql(steps: int = 4000, digits: int = 3) -> str:
    """Poisson likelihood on the simplex: EM, which only ever climbs."""
    rates = "list_transform(range(1, len(q) + 1), lambda f: list_sum(list_transform(range(1, 6), lambda k: mt[k][f] * p[k])))"
    base = rows_sql("m", "q", "bag")
    sql = simplex_sql(QUANT_Q, "bag", 5, base, "p[c] * list_sum(list_transform(range(1, len(q) + 1), lambda f: CASE WHEN s[f] > 0 THEN mt[c][f] * q[f] / s[f] ELSE 0 END))", steps, digits)
    return sql.replace("FROM w WHERE i < ", f"FROM (SELECT *, {rates} AS s FROM w) WHERE i < ").replace("EXCLUDE (i, p, x)", "EXCLUDE (i, p, x, s)")


def hellinger_sql(steps: int = 4000, digits: int = 3, behind: str = "") -> str:
    """Hellinger distance of one histogram on the simplex: p times the gradient of the affinity, squared."""
    rates = "list_transform(range(1, len(q) + 1), lambda f: list_sum(list_transform(range(1, 6), lambda k: mt[k][f] * p[k])))"
    sql = simplex_sql(QUANT_Q, "bag", 5, rows_sql("m", "q", "bag"), "p[c] * pow(list_sum(list_transform(range(1, len(q) + 1), lambda f: CASE WHEN s[f] > 0 THEN mt[c][f] * sqrt(q[f] / s[f]) ELSE 0 END)), 2)", steps, digits)
    return sql.replace("FROM w WHERE i < ", f"FROM (SELECT *, {rates} AS s FROM w) WHERE i < ").replace("EXCLUDE (i, p, x)", "EXCLUDE (i, p, x, s)")


def numeric(name: str, make, task: str, digits: int, sql: str | None = None) -> None:
    def run(spark, sf_dir):
        train, test = languages(spark, sf_dir) if task == "languages" else halves(spark, sf_dir)
        bag = "source" if task == "languages" else "bag"
        return long(make().fit(train).transform(test, bag), bag, digits)

    run.__name__, run.__doc__ = name, f"Prevalences by {name.replace('_', ' ')}."
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


#: Gradients of LATENT_PENALTY times the squared latent values: the last one is 0, or their mean is.
LATENT = {
    "softmax_reg": "+ 1e-6 * (CASE WHEN c < 4 THEN ln(p[c] / p[4]) ELSE -(ln(p[1] / p[4]) + ln(p[2] / p[4]) + ln(p[3] / p[4])) END) / p[c]",
    "softmax_full_reg": "+ 1e-6 * (ln(p[c]) - (ln(p[1]) + ln(p[2]) + ln(p[3]) + ln(p[4])) / 4) / p[c]",
}


def acc_sql(strategy: str, digits: int = 3) -> str:
    """A bag whose optimum is on the border without being pushed there comes to it slowly."""
    far = {} if strategy in LATENT else {"rate": 3.0, "steps": 100_000}
    return lsq_sql(LANG_Q, "source", 4, digits=digits, latent=LATENT.get(strategy, ""), **far)


def pacc_sql(strategy: str) -> str:
    far = {"rate": 1.5} if strategy in LATENT else {"rate": 4.5, "steps": 100_000}
    return lsq_sql(LANG_Q, "source", 4, "0.05 + 0.8 * m", "0.05 + 0.8 * q", digits=3, latent=LATENT.get(strategy, ""), **far)


PINV_SQL = lsq_sql(LANG_Q, "source", 4, digits=3).replace("list_transform(x, lambda v: v / list_sum(x))", "x")
PINV_SQL = PINV_SQL.replace("p[c] * exp(-1.0 * (list_dot_product(g[c], p) - h[c] ))", "p[c] - 0.8 * (list_dot_product(g[c], p) - h[c])")
PINV_SQL = PINV_SQL.replace("round(p[c], 3)", "round(greatest(0.0, least(1.0, p[c])) / list_sum(list_transform(p, lambda v: greatest(0.0, least(1.0, v)))), 3)")
SVD_SQL = lsq_sql(QUANT_Q, "bag", 5, weight=f"sqrt(1 + greatest(1, n - {BINS}) * x)", rate=3.0, digits=3)
for s in ("softmax", "softmax_reg", "softmax_full_reg", "constrained"):
    numeric(f"acc_{s}", lambda s=s: Q.ACC(LANG, strategy=s), "languages", 3, acc_sql(s))
    numeric(f"pacc_{s}", lambda s=s: Q.PACC(LANG, strategy=s), "languages", 3, pacc_sql(s))
    # where the histograms can be met exactly, by the same p; a bag on the border differs in the second digit
    numeric(f"hdy_{s}", lambda s=s: Q.HDy(3, strategy=s, classifier=LANG), "languages", 1, acc_sql("softmax", 1))
    numeric(f"hdx_{s}", lambda s=s: Q.HDx(BINS, strategy=s), "quantities", 3, hellinger_sql())
    numeric(f"svd_{s}", lambda s=s: Q.SVD(HIST, strategy=s), "quantities", 3, SVD_SQL)
for s in Q.RUN.strategies:
    climbs = s != "original"
    numeric(f"run_{s}", lambda s=s: Q.RUN(HIST, strategy=s), "quantities", 3 if climbs else 4, likelihood_sql() if climbs else None)
numeric("svd_original", lambda: Q.SVD(HIST, strategy="original", n_df=4), "quantities", 4)
numeric("acc_pinv", lambda: Q.ACC(LANG, strategy="pinv"), "languages", 3, PINV_SQL)
numeric("oacc_constrained", lambda: Q.ACC(LANG, strategy="constrained", tau=10.0), "languages", 3, lsq_sql(LANG_Q, "source", 4, tau=10.0, rate=0.05, steps=20_000, digits=3))


# transformers and classifiers of pyspark.ml: no SQL


@query()
def run_tree(spark, sf_dir):
    """Regularised unfolding over the leaves of a decision tree."""
    train, test = halves(spark, sf_dir)
    return long(Q.RUN(tree_with_bins(8), strategy="constrained").fit(train).transform(test, "bag"), "bag", 4)


@query()
def ibu_tree_held_out(spark, sf_dir):
    """Iterative unfolding over a tree that half of the training rows grew and the other half counts."""
    train, test = halves(spark, sf_dir)
    return long(Q.IBU(tree_with_bins(8, 0.5)).fit(train).transform(test, "bag"), "bag", 4)


@query()
def pacc_logistic(spark, sf_dir):
    """Adjusted posteriors of a logistic regression."""
    train, test = halves(spark, sf_dir)
    return long(Q.PACC(MLClassifier(LogisticRegression(maxIter=20)), strategy="constrained").fit(train).transform(test, "bag"), "bag", 4)


@query()
def pacc_out_of_fold(spark, sf_dir):
    """The same with a transfer matrix of scores by models that did not see the rows."""
    train, test = halves(spark, sf_dir)
    folded = MLClassifier(LogisticRegression(maxIter=20), folds=3)
    return long(Q.PACC(folded, strategy="constrained").fit(train).transform(test, "bag"), "bag", 4)


# background: a tenth of the finished lines lies under the open ones


@query(hellinger_sql().replace("any_value(n) AS n FROM qs", "list(CAST(b AS DOUBLE) ORDER BY f) AS b, any_value(n) AS n FROM qs")
       .replace("qs AS (SELECT * FROM q)", "qs AS (SELECT q.*, b FROM q JOIN (SELECT n.bag, fs.f, 0.1 * count(b.x) / any_value(n.n) AS b FROM n CROSS JOIN fs LEFT JOIN b ON b.bag = n.bag AND b.f = fs.f AND b.status = 'F' GROUP BY n.bag, fs.f) USING (bag, f))")
       .replace("list_sum(list_transform(range(1, 6), lambda k: mt[k][f] * p[k]))", "b[f] + 1 / (1 + list_sum(b)) * list_sum(list_transform(range(1, 6), lambda k: mt[k][f] * p[k]))"))
def hdx_background(spark, sf_dir):
    """Hellinger distances with a tenth of the finished lines as the background of each supplier's open ones."""
    train, test = halves(spark, sf_dir)
    both = train.unionByName(test).withColumn("behind", F.col("status") == "F")
    found = Q.HDx(BINS, strategy="constrained").fit(train).transform_with_background(both, "behind", 0.1, "bag")
    return long(found.where("status = 'ok'"), "bag", 3)


# EM with acceptance factors, and its stop


def em_acceptance_sql() -> str:
    step = EM_STEP.format(C=5, F=BINS)
    even = "list_transform(x, lambda v, c: pow(10, list_avg(list_transform(x, lambda u, k: log10(1 + u * k * (n - 5) / list_sum(list_transform(x, lambda t, j: t * j)))))) / c)"
    return quantity_sql(5, "RECURSIVE") + f""", ml AS (SELECT list(row ORDER BY f) AS m FROM (SELECT f, list(m ORDER BY c) AS row FROM m GROUP BY f)),
ql AS (SELECT bag, any_value(n) AS n, list(q ORDER BY f) AS q FROM q GROUP BY bag),
em AS (
  SELECT 0 AS i, bag, n, q, m, CAST([0.2, 0.2, 0.2, 0.2, 0.2] AS DOUBLE[]) AS p, CAST([0.2, 0.2, 0.2, 0.2, 0.2] AS DOUBLE[]) AS x FROM ql, ml
  UNION ALL
  SELECT i + 1, bag, n, q, m, list_transform(x, lambda v, c: 0.2::DOUBLE * e[c] / list_sum(e) + 0.8 * v) AS p, x FROM (
    SELECT *, {even} AS e FROM (SELECT i, bag, n, q, m, {step} AS x FROM em WHERE i < 30))
) SELECT bag, CAST(c - 1 AS INTEGER) AS class, round(x[c], 4) AS p FROM (SELECT bag, x, unnest(range(1, 6)) AS c FROM em WHERE i = 30)"""


@query(em_acceptance_sql())
def ibu_acceptance(spark, sf_dir):
    """Thirty steps whose priors are smoothed under acceptance factors 1 to 5."""
    train, test = halves(spark, sf_dir)
    return long(Q.IBU(HIST, o=0, lam=0.2, a=[1, 2, 3, 4, 5], n_iterations=30).fit(train).transform(test, "bag"), "bag", 4)


@query(QUANT + """, u AS (SELECT f, avg(m) AS mp FROM m GROUP BY f)
SELECT q.bag, m.c AS class, round(sum(CASE WHEN mp > 0 THEN m.m * 0.2 * q.q / mp ELSE 0 END), 6) AS p FROM q JOIN m USING (f) JOIN u USING (f) GROUP BY q.bag, m.c""")
def ibu_stops(spark, sf_dir):
    """EM that any distance stops: one step."""
    train, test = halves(spark, sf_dir)
    return long(Q.IBU(HIST, epsilon=float("inf")).fit(train).transform(test, "bag"), "bag")


# protocols and studies


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS r, count(*) OVER () AS n FROM orders),
p AS (SELECT o_orderkey, CASE WHEN r <= 500 THEN 'train' WHEN r <= 500 + (n - 500) // 2 THEN 'validate' ELSE 'test' END AS part FROM o)
SELECT part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, min(o_orderkey) AS first FROM p GROUP BY part""")
def split_three_ways(spark, sf_dir):
    """500 orders to train on and halves of the rest, by the hash of the key."""
    parts = P.split(table(spark, sf_dir, "orders"), "o_orderkey", 500)
    rows = [x.select("o_orderkey").withColumn("part", F.lit(n)) for n, x in zip(("train", "validate", "test"), parts)]
    each = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return each.groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.min("o_orderkey").alias("first"))


@query("""WITH c AS (SELECT o_orderpriority AS priority, count(*) * 1000.0 / (SELECT count(*) FROM orders) AS x FROM orders GROUP BY o_orderpriority),
r AS (SELECT priority, x, row_number() OVER (ORDER BY x - floor(x) DESC, priority) AS i, 1000 - sum(floor(x)) OVER () AS spare FROM c)
SELECT priority, (floor(x) + CASE WHEN i <= spare THEN 1 ELSE 0 END) / 1000 AS p FROM r""")
def npp_rounded(spark, sf_dir):
    """Natural prevalences of the order priorities, as bags of a thousand orders have them."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).count().orderBy("priority").collect()
    p = P.npp(np.array([r["count"] for r in rows]), 1000)[0]
    return spark.createDataFrame([(r.priority, float(x)) for r, x in zip(rows, p)], "priority string, p double")


@query()
def protocol_percentiles(spark, sf_dir):
    """Curvature and distance of bags of 1,000 orders by every protocol."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").count().orderBy("o_orderpriority").collect()
    natural = np.array([r["count"] for r in rows], dtype=float)
    natural /= natural.sum()
    seen = P.crab_prevalences(np.array([700.0, 1500.0, 3000.0, 6000.0, 12_000.0]), np.arange(1.0, 6))
    return D.protocol_table(spark, [1000], 200, natural, seen, np.arange(1.0, 6))


@query()
def compared_methods(spark, sf_dir):
    """Errors of four methods over thirty bags of a hundred documents."""
    train, pool = languages(spark, sf_dir)
    methods = lambda: {"cc": Q.CC(LANG), "acc_pinv": Q.ACC(LANG, strategy="pinv"), "acc_softmax": Q.ACC(LANG), "pacc_constrained": Q.PACC(LANG, strategy="constrained")}
    return D.compare({0.0: methods}, train, pool, "doc_id", 100, P.app(4, 30))


@query()
def spectrum(spark, sf_dir):
    """A flux by class from ten replicates of the training rows."""
    train, test = halves(spark, sf_dir)
    both = train.unionByName(test).withColumn("behind", F.col("status") == "F")
    flux = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.exp(-0.7 * c))
    return D.bootstrapped_spectrum(Q.HDx(BINS, strategy="constrained"), train, both, "behind", 0.1, np.arange(1.0, 6), flux, 10)


@query("""WITH c AS (SELECT CAST(p_size // 10 AS INTEGER) AS class, count(*) * 1.0 / (SELECT count(*) FROM part) AS simulated, min(p_retailprice) AS x FROM part GROUP BY 1),
f AS (SELECT *, 3.23e-10 * pow(x / 1000, -2.47 - 0.24 * log10(x / 1000)) * (class + 1) AS seen FROM c)
SELECT class, round(simulated, 6) AS simulated, round(seen / sum(seen) OVER (), 6) AS seen FROM f""")
def simulated_and_seen(spark, sf_dir):
    """Shares of part sizes beside those that a flux at their prices gives."""
    rows = table(spark, sf_dir, "part").withColumn("class", F.floor(F.col("p_size") / 10).cast("int"))
    centers = rows.groupBy("class").agg(F.min("p_retailprice").alias("x"), (F.first("class") + 1.0).alias("a_eff"))
    found = D.prevalence_histogram(rows, "class", centers)
    return found.select("class", F.round("simulated", 6).alias("simulated"), F.round("seen", 6).alias("seen"))


@query(RESULTS_SQL + "SELECT method, count(ae) AS n, round(avg(ae), 6) AS mean, CAST(row_number() OVER (ORDER BY avg(ae) NULLS LAST, method) AS INTEGER) AS rank FROM g GROUP BY method")
def inspected_results(spark, sf_dir):
    """Methods by their mean error, the best first."""
    return D.inspected(results(spark, sf_dir), ["method"], "ae").withColumn("mean", settled(F.col("mean"), 6))


@query(RESULTS_SQL + """, v AS (SELECT method, bag % 2 AS setting, avg(ae) AS ae FROM g WHERE bag <= 5 GROUP BY ALL), t AS (SELECT method, bag % 2 AS setting, avg(ae) AS ae FROM g WHERE bag > 5 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY ae NULLS LAST, setting) AS i FROM v)
SELECT b.method, CAST(b.setting AS INTEGER) AS setting, round(b.ae, 6) AS validation, round(t.ae, 6) AS test FROM b LEFT JOIN t ON t.method = b.method AND t.setting = b.setting WHERE i = 1""")
def selected_and_tested(spark, sf_dir):
    """Each method's test error at the setting that was best in validation."""
    rows = results(spark, sf_dir).withColumn("setting", (F.col("bag") % 2).cast("int"))
    side = lambda w: rows.where(w).groupBy("method", "setting").agg(F.avg("ae").alias("ae"))
    found = D.selected(side("bag <= 5"), side("bag > 5"), "ae")
    return found.select("method", "setting", F.round("validation", 6).alias("validation"), F.round("test", 6).alias("test"))


@query(RESULTS_SQL + """SELECT bag, 'ACC ' || CASE method WHEN 'A' THEN 'soft-max' WHEN 'N' THEN 'unadjusted' ELSE method END AS name,
  CASE WHEN ae IS NULL THEN '' ELSE printf('%.4f', ae) || CASE WHEN sd IS NULL THEN '' ELSE printf(' ± %.4f', sd) END END AS shown FROM g""")
def shown_scores(spark, sf_dir):
    """Results as a table shows them: names by pattern and lookup, scores with their spread."""
    named = F.concat(F.lit("acc_"), F.when(F.col("method") == "A", "softmax").when(F.col("method") == "N", "none").otherwise(F.col("method")))
    return results(spark, sf_dir).select("bag", D.labelled(named).alias("name"), D.score(F.col("ae"), F.col("sd")).alias("shown"))


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey, l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL)
SELECT * FROM a JOIN b USING (l_suppkey, l_returnflag, l_linestatus)""")
def joined_on_three_keys(spark, sf_dir):
    """Two tables of the same events, by three keys."""
    keys, lines = ["l_suppkey", "l_returnflag", "l_linestatus"], table(spark, sf_dir, "lineitem")
    a = lines.groupBy(*keys).agg(F.count("*").alias("n"))
    return a.join(lines.where("l_discount > 0.02").groupBy(*keys).agg(F.round(F.sum("l_quantity"), 2).alias("quantity")), keys)


@query("""SELECT s.s_suppkey, n.n_name AS nation, coalesce(CAST(g.n AS VARCHAR), '') AS n_rich FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) g ON g.c_nationkey = s.s_nationkey""")
def left_joined(spark, sf_dir):
    """Suppliers with their nation and, where there are any, its rich customers; missing numbers are empty."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "supplier").join(n, "s_nationkey").join(rich, "s_nationkey", "left")
    return rows.select("s_suppkey", "nation", F.coalesce(F.col("n").cast("string"), F.lit("")).alias("n_rich"))


@query("""SELECT event_type, CAST(len(list_filter([5.0, 20.0, 50.0, 90.0], lambda e: e <= value)) AS INTEGER) AS class, count(*) AS n FROM events
WHERE isfinite(value) GROUP BY ALL""")
def discretised_values(spark, sf_dir):
    """Events of each type in classes of their value, [low, high); what lies outside belongs to the outer ones."""
    rows = tables.discretised(tables.finite_rows(table(spark, sf_dir, "events")), "value", [0.0, 5.0, 20.0, 50.0, 90.0, 100.0], "class")
    return rows.groupBy("event_type", "class").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read back."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="prevspark-")
    path = f"{base.rstrip('/')}/prevspark/{uuid.uuid4().hex}/nation_csv"
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders EXCEPT SELECT '1-URGENT'")
def distinct_names(spark, sf_dir):
    """Different names of two tables, but for one."""
    a = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    b = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    return a.unionByName(b).subtract(spark.range(1).select(F.lit("1-URGENT").alias("name")))


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS x FROM events GROUP BY 1)
SELECT day, n, 0 AS class, round(1 - x, 6) AS p FROM d UNION ALL SELECT day, n, 1, round(x, 6) FROM d""")
def windowed_prevalences(spark, sf_dir):
    """Shares of small and large values in each day's event-time window."""
    rows = table(spark, sf_dir, "events").withColumn("label", (F.col("event_id") % 2).cast("int"))
    scorer = SqlScorer("CASE WHEN value > 50 THEN array(0.0D, 1.0D) ELSE array(1.0D, 0.0D) END", 2)
    found = W.window_prevalences(Q.CC(scorer).fit(rows), rows, "ts", "1 day")
    return found.select(F.col("window.start").alias("day"), "n", F.posexplode("p").alias("class", "p")).withColumn("p", F.round("p", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, class, p): language prevalences by adjusted classify-and-count."""
    return QUERIES["acc_pinv"](spark, sf_dir)
