"""Protocols, tables, evaluation and event-time windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prevspark.operators import methods as Q
from prevspark.operators import protocols as P
from prevspark.operators.classifiers import SqlScorer
from prevspark.plans import drivers as D
from prevspark.plans import evaluate as V
from prevspark.sources import tables
from prevspark.streaming.windowed import window_prevalences


@pytest.fixture(scope="module")
def rows(spark):
    n = 3000
    noisy = F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < 8, F.col("label")).otherwise((F.col("label") + 1) % 3)
    df = spark.range(n).select("id", (F.col("id") % 3).cast("int").alias("label"))
    return df.withColumn("said", noisy).withColumn("ts", F.timestamp_seconds(F.col("id") * 10)).persist()


SCORER = "array(cast(said = 0 as double), cast(said = 1 as double), cast(said = 2 as double))"


def test_round_counts():
    assert P.round_counts(10, [0.5, 0.3, 0.2]).tolist() == [5, 3, 2]
    assert P.round_counts(10, [1.0, 0.0, 0.0]).tolist() == [8, 1, 1]
    for p in P.app(7, 50):
        c = P.round_counts(100, p)
        assert c.sum() == 100 and c.min() >= 1 and np.abs(c - 100 * p).max() <= 7
    with pytest.raises(ValueError):
        P.round_counts(2, [0.3, 0.3, 0.4])


def test_subsample(rows):
    bag = P.subsample(rows, "label", "id", 1500, np.array([0.9, 0.06, 0.04]))
    assert sorted(r["count"] for r in bag.groupBy("label").count().collect()) == [60, 90, 1350]
    assert bag.where("label = 0").select("id").distinct().count() == 1000
    assert bag.where("label = 1").select("id").distinct().count() == 90
    with pytest.raises(P.ExhaustedClassException):
        P.subsample(rows, "label", "id", 1500, np.array([0.9, 0.06, 0.04]), allow_duplicates=False)


def test_protocols():
    flat = P.app(12, 400).mean(axis=0)
    assert flat == pytest.approx(np.full(12, 1 / 12), abs=0.02)
    smooth = P.app_oq(12, 100)
    assert len(smooth) == 100 and P.roughness(smooth).max() <= np.quantile(P.roughness(P.app(12, 500)), 0.21)
    naive = [sum((2 * p[i] - p[i - 1] - p[i + 1]) ** 2 for i in range(1, 11)) / 2 for p in smooth]
    assert P.roughness(smooth, log10=False) == pytest.approx(naive)
    crab = P.crab_prevalences(np.logspace(2.8, 4.5, 12), np.linspace(1, 3, 12))
    assert crab.sum() == pytest.approx(1) and P.npp(crab, 100_000, 20).mean(axis=0) == pytest.approx(crab, abs=2e-3)


def test_split_and_bootstrap(rows):
    a, b, c = P.split(rows, "id", 1000)
    assert (a.count(), b.count(), c.count()) == (1000, 1000, 1000)
    assert a.unionByName(b).unionByName(c).select("id").distinct().count() == 3000
    assert [x.count() for x in P.split(rows, "id", 2999)] == [2999, 0, 1] and [x.count() for x in P.split(rows, "id", 0)] == [0, 1500, 1500]
    drawn = P.bootstrap(rows, 20).groupBy("replicate").count().collect()
    assert len(drawn) == 20 and all(abs(r["count"] - 3000) < 300 for r in drawn)


def test_evaluation(rows):
    scorer = SqlScorer(SCORER, 3)
    fitted = {"cc": Q.CC(scorer).fit(rows), "acc": Q.ACC(scorer, strategy="pinv").fit(rows), "soft": Q.ACC(scorer).fit(rows)}
    bags = V.bags(rows, "label", "id", 300, P.app(3, 6), seed=1)
    results = V.evaluate(fitted, bags, 300)
    assert results.count() == 18
    table = {r.method: r for r in V.summary(results, ["method"]).collect()}
    assert table["acc"].ae < 0.7 * table["cc"].ae and table["soft"].ae == pytest.approx(table["acc"].ae, abs=0.01)
    assert all(r.n_failures == 0 for r in table.values())


def test_failures_keep_their_reason(rows):
    broken = Q.ACC(SqlScorer(SCORER, 3), a=[1.0, 2.0, 1.0], tau=1.0).fit(rows)
    bag = rows.limit(3).withColumn("bag", F.lit(0)).withColumn("p_true", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    row = V.evaluate({"x": broken}, bag, 3).first()
    assert "more items than classes" in row.exception and row.ae is None


def test_selection(spark):
    table = spark.createDataFrame([("a", 1.0, 0.2), ("a", 2.0, 0.1), ("b", 1.0, None), ("b", 2.0, None), ("c", 1.0, 0.3), ("c", 2.0, 0.3)], "method string, C double, ae double")
    assert {(r.method, r.C) for r in V.best(table, ["method"], "ae", ["C"]).collect()} == {("a", 2.0), ("b", 1.0), ("c", 1.0)}
    tested = V.select_and_test(table, table.withColumn("ae", F.col("C")), ["method"], ["C"], "ae")
    assert {(r.method, r.ae) for r in tested.collect()} == {("a", 2.0), ("b", 1.0), ("c", 1.0)}


def test_tables(spark, tmp_path):
    lines = [",bin,a_eff,bin_center,bin_width,conf_lower,conf_upper,e_min,e_max", "0,0,,,,,,-inf,1.0"]
    lines += [f"{i},{i},{2.0 * i},{i + 0.5},1.0,0,0,{float(i)},{i + 1.0}" for i in range(1, 4)] + ["4,4,,,,,,4.0,inf"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    found = tables.acceptance(spark, str(tmp_path / "a.csv"))
    assert found["factors"].tolist() == [0.5, 0.25, 1 / 6] and found["edges"].tolist() == [1.0, 2.0, 3.0, 4.0]
    values = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 2.5, 9.0, float("nan"))], "x double")
    assert [r.k for r in tables.discretised(tables.finite_rows(values), "x", found["edges"], "k").collect()] == [0, 0, 1, 1, 2]
    tables.write_csv(values.limit(2), str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out"), "x double").count() == 2
    tables.latex_table(values.limit(1), str(tmp_path / "t.tex"), {"x": ".2f"})
    assert "0.00" in (tmp_path / "t.tex").read_text()
    (tmp_path / "v.csv").write_text("label,a,b\n0,1.5,2\n1,3,4\n")
    assert [(r.features, r.label) for r in tables.read_vectors(spark, str(tmp_path / "v.csv"), "label").collect()] == [([1.5, 2.0], 1), ([3.0, 4.0], 2)]


def test_windows(spark, rows, tmp_path):
    fitted = Q.ACC(SqlScorer(SCORER, 3), strategy="pinv").fit(rows)
    batch = window_prevalences(fitted, rows, "ts", "1 hour").collect()
    assert sum(r.n for r in batch) == 3000 and all(r.p == pytest.approx([1 / 3] * 3, abs=0.15) for r in batch if r.n > 200)
    rows.select("said", "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("said int, ts timestamp").parquet(str(tmp_path / "in"))
    query = window_prevalences(fitted, stream, "ts", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.window.start, r.n) for r in spark.table("windows").collect()} == {(r.window.start, r.n) for r in batch}


def test_bags_have_their_prevalences(rows):
    p = np.array([[0.9, 0.06, 0.04], [0.2, 0.3, 0.5]])
    drawn = V.bags(rows, "label", "id", 1500, p, seed=3)
    counts = {(r.bag, r.label): (r["count"], r.ids) for r in drawn.groupBy("bag", "label").agg(F.count("*").alias("count"), F.count_distinct("id").alias("ids")).collect()}
    assert counts == {(0, 0): (1350, 1000), (0, 1): (90, 90), (0, 2): (60, 60), (1, 0): (300, 300), (1, 1): (450, 450), (1, 2): (750, 750)}
    assert set(drawn.columns) == {*rows.columns, "bag", "p_true"}
    with pytest.raises(P.ExhaustedClassException):
        V.bags(rows.where("label <> 2"), "label", "id", 10, p)


def test_methods_share_what_is_equal(rows):
    scorer = SqlScorer(SCORER, 3)
    fitted = V.fit_together({"cc": Q.CC(scorer), "acc": Q.ACC(scorer, strategy="pinv"), "soft": Q.ACC(scorer), "pacc": Q.PACC(scorer), "sld": Q.SLD(scorer)}, rows)
    assert fitted["cc"].transformer is fitted["acc"].transformer is fitted["soft"].transformer is not fitted["pacc"].transformer
    assert np.isfinite(fitted["acc"].M).all() and fitted["soft"].M is fitted["acc"].M
    bags = V.bags(rows, "label", "id", 200, P.app(3, 4), seed=1)
    alone = {n: m.fit(rows) for n, m in {"cc": Q.CC(scorer), "soft": Q.ACC(scorer), "sld": Q.SLD(scorer)}.items()}
    together = {(r.bag, r.method): r.ae for r in V.evaluate(fitted, bags, 200).collect()}
    for r in V.evaluate(alone, bags, 200).collect():
        assert together[r.bag, r.method] == pytest.approx(r.ae)


def test_rounded_protocols():
    p = np.array([0.5, 0.3, 0.2])
    assert P.npp(p, 10, 3).tolist() == [[0.5, 0.3, 0.2]] * 3
    for drawn in (P.app(3, 50, n=40), P.app_oq(3, 10, 0.2, n=40), P.poisson(40, p, 50)):
        assert np.allclose(drawn * 40, np.round(drawn * 40)) and np.allclose(drawn.sum(axis=1), 1) and drawn.min() >= 1 / 40
    five = P.app_oq(5, 10, 0.2, n=40)
    assert P.roughness(five).max() <= np.sort(P.roughness(P.app(5, 50, n=40)))[9] + 1e-12


def test_studies(spark, rows, tmp_path):
    scorer = SqlScorer(SCORER, 3)
    found = D.compare({1.0: lambda: {"cc": Q.CC(scorer)}, 2.0: lambda: {"acc": Q.ACC(scorer, strategy="pinv")}}, rows, rows, "id", 100, P.app(3, 3))
    assert {(r.setting, r.method) for r in found.collect()} == {(1.0, "cc"), (2.0, "acc")}
    table = {(r.protocol, r.measure): r["mean"] for r in D.protocol_table(spark, [100], 40, np.ones(5) / 5, np.arange(1.0, 6) / 15, np.ones(5)).collect()}
    assert len(table) == 14 and table["NPP (simulation)", "nmd"] == pytest.approx(0) and table["APP-OQ (1%)", "curvature"] < table["APP", "curvature"]
    shown = spark.createDataFrame([("acc_pinv", 0.5, 0.1), ("other", None, None), ("cc_none", 1.0, None)], "m string, a double, s double")
    assert [(r[0], r[1]) for r in shown.select(D.labelled(F.col("m")), D.score(F.col("a"), F.col("s"), 2)).collect()] == [
        ("ACC pseudo-inverse", "0.50 ± 0.10"), ("other", ""), ("CC unadjusted", "1.00")]
    D.main(["protocols", "--bags", "5", "--out", str(tmp_path / "out")])
    assert "curvature" in (tmp_path / "out.tex").read_text()
