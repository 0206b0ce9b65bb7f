"""Every catalog query with an oracle against DuckDB, and the driver's contract."""

import random
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest

import __spark_entry__
from prevspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return sorted(map(tuple, frame.to_numpy()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    found, expected = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    if name.startswith("hdy_"):  # one digit, and the penalties decide which way a half is rounded
        both = found.merge(expected, on=["source", "class"])
        assert len(both) == len(found) == len(expected) and (both.p_x - both.p_y).abs().max() < 0.11
        assert ((both.p_x - both.p_y).abs() > 0.01).sum() <= 2
        return
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_numeric(spark, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(found) and not found.isna().any().any()
    if "p" in found.columns:
        assert found.groupby(found.columns[0]).p.sum().sub(1).abs().max() < 1e-3


def test_every_strategy_has_sql():
    """But those that end before an optimum or by an eigenbasis, and what classifiers and random draws decide."""
    without = catalog.QUERIES.keys() - catalog.ORACLES.keys()
    assert without == {
        "run_original", "svd_original", "run_tree", "ibu_tree_held_out", "pacc_logistic", "pacc_out_of_fold",
        "protocol_percentiles", "compared_methods", "spectrum",
    }


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 80
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """A table of lines whose means are ties in decimals, which sums of doubles miss by the order of their terms.

    An odd number of hundredths over 32 days is a tie at six digits; twenty taxes of 0.01 are no more than 0.2, sixty of 0.03 are.
    """
    rng, lines, expected = random.Random(5), [], {}
    for bag in range(40):
        for method in "AN":
            cents = [rng.randrange(11) for _ in range(31)]
            cents.append(1 + 2 * rng.randrange(5) - sum(cents) % 2)
            lines += [(bag, method, day, c / 100, 0.03) for day, c in enumerate(cents) for _ in range(60)]
            expected[bag, method] = str((Decimal(sum(cents)) / 3200).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    lines += [(40, "A", 0, 0.05, 0.01)] * 20
    rows = spark.createDataFrame(lines, "l_suppkey long, l_returnflag string, day int, l_discount double, l_tax double").coalesce(1)
    path = str(tmp_path_factory.mktemp("tied"))
    rows.selectExpr("*", "cast(date_add(date'1995-01-01', day) AS timestamp) AS l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    return path, expected


def test_best_of_ties(spark, tied):
    path, expected = tied
    found = {r.bag: (r.method, r.ae and f"{r.ae:.6f}", r.n_failures) for r in catalog.argmin_per_group(spark, path).collect()}
    least = {bag: min((expected[bag, m], m) for m in "AN") for bag in range(40)}
    assert found == {bag: (m, ae, 0) for bag, (ae, m) in least.items()} | {40: ("A", None, 1)}


def test_inspected_ties(spark, monkeypatch):
    """Two methods of one mean, a tie at six digits, that doubles miss in one order of adding them up and not in another."""
    half = [0.000001 * k for k in (51, 37, 53, 6, 32, 49, 17, 3)] + [0.1, 0.2, 0.3, 0.7] * 2
    rows = [(i, m, x) for m, each in (("b", half), ("a", sorted(half, reverse=True))) for i, x in enumerate(each)]
    frame = spark.createDataFrame(rows, "bag int, method string, ae double").coalesce(1)
    monkeypatch.setattr(catalog, "results", lambda *_: frame)
    exact = (sum(Decimal(f"{x:.6f}") for x in half) / 16).quantize(Decimal("0.000001"), ROUND_HALF_UP)
    found = {(r.method, r.n, f"{r['mean']:.6f}", r["rank"]) for r in catalog.inspected_results(spark, "").collect()}
    assert found == {("a", 16, str(exact), 1), ("b", 16, str(exact), 2)}


def test_pivot_of_ties(spark, tied):
    path, expected = tied
    found = {(r.bag, m): f"{r[m]:.6f}" for r in catalog.pivot_table(spark, path).collect() for m in "AN" if r[m] is not None}
    assert found == expected
