"""Each query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from vecdrift.operators import features, splits
from vecdrift.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    return con


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def _solver(spark, wide, columns):
    """The protocol's numbers by a plain solver, at full settings."""
    from test_operators import _plain_protocol
    from vecdrift.operators.probe import C_GRID

    folds = [splits.kfold(wide.where(f"split {which} 'test'" if n == 5 else "split = 'train'"), n, 42, "f").collect() for n, which in ((3, ""), (5, "<>"))]
    return wide.collect(), folds, lambda rows, own: _plain_protocol(rows, columns, *own, C_GRID, (3, 5))


def test_probe_queries_give_a_plain_solvers_numbers(spark, small):
    labels = registry.FX.sample_labels(spark, small)
    samples = labels.join(splits.stratified_split(labels).select("sample_id", "split"), "sample_id")
    layers = registry.FX.LAYERS
    columns = features.feature_columns(layers)
    sweep = registry.SE.full_sweep(registry._cache(spark, small), (2.0, 10.0, 30.0)).cache()
    base = registry._wide(spark, small)
    want = {"full_probe_sweep": {}, "beta_probe_sweep": {}}
    for beta in (2.0, 10.0, 30.0):
        own = features.pivot_features(sweep.where(F.col("beta") == beta), layers, features.GROUPS)
        band = registry.SE.replace_band(base, "delta_norm_entropy", sweep.where(F.col("beta") == beta), layers)
        for name, table in (("full_probe_sweep", own), ("beta_probe_sweep", band)):
            rows, folds, solve = _solver(spark, samples.join(table, "sample_id"), columns)
            want[name][beta] = solve(rows, folds)["test_auroc"]
    for name, by_beta in want.items():
        got = {r.beta: r.probe_auroc for r in registry.QUERIES[name](spark, small).collect()}
        assert list(got) == list(registry.SE.BETA_GRID)
        assert {b: got[b] for b in by_beta} == by_beta


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("rows", [186, 187, 191, 195])
@pytest.mark.parametrize("name", ["failure_isolation", "nan_placeholders", "run_report"])
def test_failures_equal_sql_where_the_table_ends_within_a_sample(spark, small, tmp_path, name, rows):
    """The last sample has only its reference, or no position 2; it is one
    of those that fail, or none of them."""
    con, path = duckdb.connect(), f"{tmp_path}/embeddings.parquet"
    con.execute(f"COPY (SELECT i AS vec_id, embedding, label FROM range({rows}) t(i) JOIN '{small}/embeddings.parquet' ON vec_id = i % 40) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS FROM '{path}'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    result = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["failure_isolation", "nan_placeholders", "run_report"])
@pytest.mark.parametrize("first", [28, 33, 34])
def test_planted_failures_where_the_table_begins_within_a_sample(spark, small, tmp_path, name, first):
    db = duckdb.connect()
    db.execute(f"COPY (FROM '{small}/embeddings.parquet' WHERE vec_id >= {first}) TO '{tmp_path}/embeddings.parquet'")
    db.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, db.execute(registry.ORACLE_SQL[name]).fetchall()))
