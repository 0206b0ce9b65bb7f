"""All method configurations of the test suite's list on prior shift, and what fitted models promise."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from prevspark.operators import methods as Q
from prevspark.operators.classifiers import MLClassifier, SqlScorer
from prevspark.operators.transformers import ENTRIES, LABEL, ClassTransformer, HistogramTransformer, TreeTransformer


def generate(rng, p, M, n=1000):
    y = rng.choice(3, n, p=np.array(p) / sum(p))
    X = np.array([[rng.choice(3, p=M[c]) for _ in range(2)] for c in y]) + rng.uniform(0, 0.1, (n, 2)) + 1
    return X, y + 1


@pytest.fixture(scope="module")
def task(spark):
    rng = np.random.default_rng(42)
    M = np.diag(rng.uniform(0.1, 0.8, 3)) + 0.05 * np.eye(3, k=1) + 0.05 * np.eye(3, k=-1) + 0.01
    M /= M.sum(axis=1, keepdims=True)
    frame = lambda X, y: spark.createDataFrame([(x.tolist(), int(c), int(c) - 1) for x, c in zip(X, y)], "features array<double>, label int, zero int").repartition(2).persist()
    train, test = frame(*generate(rng, [1, 2, 3], M)), frame(*generate(rng, [3, 2, 1], M))
    truth = np.bincount([r.zero for r in test.select("zero").collect()], minlength=3) / 1000
    return train, test, truth


def C():
    return MLClassifier(LogisticRegression())


def tree(share=1.0):
    return TreeTransformer(DecisionTreeClassifier(maxDepth=4, maxBins=32, seed=1), share)


@pytest.fixture(scope="module")
def trees(task):
    return tree().fit(task[0], "label")[0], tree(0.5).fit(task[0], "label")[0]


SOFT = ["softmax", "softmax_reg", "softmax_full_reg"]
CONFIGS = (
    [("ACC", {"strategy": "constrained", "tau": 10.0})]
    + [("ACC", {"strategy": s}) for s in ["constrained", *SOFT, "pinv", "inv", "ovr"]]
    + [("CC", {})]
    + [("PACC", {"strategy": "constrained", "tau": 10.0})]
    + [("PACC", {"strategy": s}) for s in ["constrained", *SOFT, "pinv"]]
    + [("PCC", {})]
    + [("RUN1", {"strategy": s, "tau": 1e-6}) for s in ["positive", "constrained", "unconstrained", *SOFT]]
    + [("RUN2", {"strategy": s, "tau": 10.0}) for s in ["constrained", *SOFT]]
    + [("SVD1", {"strategy": s, "tau": 1e-6}) for s in ["constrained", *SOFT]]
    + [("SVD2", {"strategy": s, "tau": 10.0}) for s in ["constrained", *SOFT]]
    + [("HDx", {"n_bins": 3, "strategy": "constrained", "tau": 10.0}), ("HDx", {"n_bins": 15, "strategy": "constrained"})]
    + [("HDx", {"n_bins": 3, "strategy": s}) for s in SOFT]
    + [("HDy", {"n_bins": 3, "strategy": "constrained", "tau": 10.0}), ("HDy", {"n_bins": 3, "strategy": "constrained"})]
    + [("HDy", {"n_bins": 3, "strategy": s}) for s in SOFT]
    + [("RUN1", {"strategy": "original", "n_df": 2}), ("SVD1", {"strategy": "original", "n_df": 2})]
    + [("IBU1", {"o": 0, "lam": 0.1}), ("IBU1", {"o": 0, "lam": 0.1, "n_iterations": 1}), ("IBU1", {"o": 0, "lam": 0.1, "epsilon": np.inf}), ("IBU1", {})]
    + [("SLD", {"o": 0, "lam": 0.1, "n_iterations": 5})]
)


def make(name, given, trees):
    if name in ("ACC", "PACC", "CC", "PCC", "SLD"):
        return getattr(Q, name)(C(), **given)
    if name == "HDx":
        return Q.HDx(**given)
    if name == "HDy":
        return Q.HDy(classifier=C(), **given)
    return getattr(Q, name[:-1])(trees[int(name[-1]) - 1], **given)


#: Methods that do not correct for the shift, or that are regularised away from it.
LOOSE = {"CC", "PCC"}


@pytest.mark.parametrize("name,given", CONFIGS, ids=lambda x: str(x))
def test_prior_shift(task, trees, name, given):
    train, test, truth = task
    fitted = make(name, given, trees).fit(train, "label")
    p = fitted.predict(test)
    assert p.sum() == pytest.approx(1, abs=1e-6) and (p > -0.05).all()
    strong = given.get("tau", 0) == 10.0 or given.get("n_iterations") == 1 or given.get("epsilon") or given.get("n_df") or given.get("strategy") == "ovr"
    assert np.abs(p - truth).sum() < (0.9 if strong or name in LOOSE else 0.35)
    if name != "SLD":
        assert fitted.M.shape[1] == 3 and fitted.M.sum(axis=0) == pytest.approx([1 if name != "HDx" and name != "HDy" else 1] * 3)


def test_labels_from_zero_or_one_and_many_bags(task):
    train, test, truth = task
    one, zero = Q.PACC(C()).fit(train, "label"), Q.PACC(C()).fit(train, "zero")
    assert one.M == pytest.approx(zero.M) and one.predict(test) == pytest.approx(zero.predict(test), abs=1e-6)
    bags = test.withColumn("bag", F.when(F.col("zero") == 0, "a").when(F.col("zero") == 1, F.lit(None)).otherwise("b"))
    found = {r.bag: r for r in one.transform(bags, "bag").collect()}
    assert set(found) == {"a", None, "b"} and sum(r.n for r in found.values()) == 1000
    assert all(np.argmax(found[k].p) == c for k, c in (("a", 0), ("b", 2)))
    sld = {r.bag: r.p for r in Q.SLD(C(), n_iterations=3).fit(train, "label").transform(bags, "bag").collect()}
    assert np.argmax(sld["a"]) == 0 and np.argmax(sld["b"]) == 2


def test_transfer_matrix_equals_counts(task):
    train, _, _ = task
    for p in (True, False):
        fitted, rows = ClassTransformer(C(), is_probabilistic=p).fit(train, "label")
        M, p_trn = Q.transfer_matrix(rows, 3, 3)
        scored = fitted.probabilities(train, "s").collect()
        for c in range(3):
            own = np.array([r.s if p else np.eye(3)[int(np.argmax(r.s))] for r in scored if r.zero == c])
            assert M[:, c] == pytest.approx(own.mean(axis=0))
        assert p_trn == pytest.approx(np.bincount([r.zero for r in scored]) / len(scored))


def test_histogram_edges(spark):
    rows = [([0.0], 0), ([1.0], 1), ([2.0], 0), ([3.0], 1)]
    df = spark.createDataFrame(rows, "features array<double>, label int")
    fitted, _ = HistogramTransformer(3).fit(df, "label")
    assert fitted.edges.tolist() == [[1.0, 2.0]]
    new = spark.createDataFrame([([x],) for x in (1.0, 1.5, 2.0, 2.1, -9.0, 9.0, float("nan"))], "features array<double>")
    assert [r[ENTRIES][0].f for r in fitted.transform(new).collect()] == [0, 1, 1, 2, 0, 2, 2]


def test_ties_and_scorer(spark):
    df = spark.createDataFrame([(0.4, 0), (0.6, 1), (0.5, 1)], "x double, label int")
    _, rows = ClassTransformer(SqlScorer("array(1 - x, x)", 2)).fit(df, "label")
    assert {(r.x, r[ENTRIES][0].f) for r in rows.collect()} == {(0.4, 0), (0.6, 1), (0.5, 0)}


def test_out_of_fold_scores(task):
    train, test, truth = task
    folded = MLClassifier(LogisticRegression(), folds=3)
    fitted = Q.PACC(folded).fit(train, "label")
    assert np.abs(fitted.predict(test) - truth).sum() < 0.35
    _, rows = ClassTransformer(folded, True).fit(train, "label")
    assert rows.count() == train.count()


def test_background(spark, task):
    train, test, truth = task
    noise = train.where("label = 3").limit(200)
    bag = test.unionByName(noise)
    fitted = Q.HDx(3).fit(train, "label")
    clean, plain = fitted.predict_with_background(bag, noise, 1.0), fitted.predict(bag)
    assert np.abs(clean - truth).sum() < np.abs(plain - truth).sum()
    for method in (Q.RUN(tree()), Q.SVD(tree()), Q.CC(C())):
        with pytest.raises(NotImplementedError):
            method.fit(train, "label").predict_with_background(bag, noise)


def test_eager_errors(task):
    for make_ in (lambda: Q.ACC(C(), strategy="original"), lambda: Q.RUN(tree(), strategy="pinv"), lambda: Q.SVD(tree(), strategy="positive"),
                  lambda: Q.HDx(3, strategy="x"), lambda: Q.IBU(tree(), lam=0.5), lambda: Q.SLD(C(), lam=0.5)):
        with pytest.raises(ValueError):
            make_()
    with pytest.raises(ValueError):
        Q.CC(C()).fit(task[0].withColumn("label", F.col("label") + 5), "label")


def test_tree_is_shared_and_split(task, trees):
    one, half = trees
    assert one.fit(task[0].limit(0), "label")[1].count() == 1000 and abs(half.held.count() - 500) <= 3
    assert half.held.select(LABEL).distinct().count() == 3
    taken = TreeTransformer(one.tree, fit_tree=0).fit(task[0], "label")[0]
    assert taken.leaves == one.leaves


def test_bags_without_rows_of_their_own_and_classes_without_training_rows(spark, task):
    train, test, _ = task
    bags = test.withColumn("bag", F.lit("a")).withColumn("behind", F.lit(False))
    bags = bags.unionByName(train.limit(5).withColumn("bag", F.lit("b")).withColumn("behind", F.lit(True)))
    found = {r.bag: r for r in Q.HDx(3, strategy="constrained").fit(train).transform_with_background(bags, "behind", 1.0, "bag").collect()}
    assert found["a"].status == "ok" and (found["b"].n, found["b"].p) == (0, None) and found["b"].status.startswith(Q.EMPTY)
    two = train.where("label <> 2")
    scorer = SqlScorer("transform(array(1, 2, 3), c -> CASE WHEN c = floor(features[0]) THEN 0.9D ELSE 0.05D END)", 3)
    with pytest.warns(UserWarning, match="1 classes have no rows"):
        fitted = {s: Q.ACC(scorer, strategy=s).fit(two) for s in ("pinv", "inv", "ovr", "softmax")}
    for model in fitted.values():
        assert np.isnan(model.M[:, 1]).all()
        row = model.transform(test).first()
        assert row.p is None and row.status.startswith(Q.INVALID)
        with pytest.raises(Q.S.NonOptimalStatusError):
            model.predict(test)
        with pytest.raises(Exception, match="must be finite"):
            model.transform(test, strict=True).collect()
    assert Q.CC(scorer).fit(two).predict(test).sum() == pytest.approx(1)
    p = Q.SLD(scorer).fit(two).predict(test)
    assert p[1] == 0 and p.sum() == pytest.approx(1)
    singular = Q.ACC(SqlScorer("array(1D / 3, 1D / 3, 1D / 3)", 3), strategy="inv").fit(train).transform(test).first()
    assert singular.status.startswith(Q.SINGULAR)


def test_steps_of_large_bags_are_those_of_small_ones(task, monkeypatch):
    train, test, _ = task
    bags = test.withColumn("bag", F.when(F.col("zero") == 0, "a").when(F.col("features")[0] > 2, F.lit(None)).otherwise("b"))
    model = Q.SLD(C(), o=0, lam=0.1, n_iterations=4).fit(train, "label")
    once = {r.bag: (r.n, r.p) for r in model.transform(bags, "bag").collect()}
    monkeypatch.setattr(Q, "TOGETHER", sorted(n for n, _ in once.values())[0])
    steps = {r.bag: (r.n, r.p) for r in model.transform(bags, "bag").collect()}
    assert once.keys() == steps.keys() == {"a", "b", None}
    for bag in once:
        assert once[bag][0] == steps[bag][0] and once[bag][1] == pytest.approx(steps[bag][1])
