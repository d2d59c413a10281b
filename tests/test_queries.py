"""Every query with SQL gives DuckDB's rows on small tables made here."""

import datetime
import random

import pytest

import __spark_entry__ as spark_entry
from tallyspark.plans import registry


def test_contract_lists_agree():
    names = set(spark_entry.queries())
    assert set(spark_entry.oracle_sql()) <= names and set(registry.queries()) <= names


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(1)
    top = tmp_path_factory.mktemp("tables")
    start = datetime.datetime(2024, 1, 1)
    orders = [(k, rng.randrange(20), rng.choice("FO"), round(rng.uniform(10, 90000), 2), start + datetime.timedelta(days=rng.randrange(90)), rng.choice(["1-URGENT", "5-LOW"])) for k in range(900)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{top}/orders.parquet")
    spark.createDataFrame([(k, f"Customer#{k:05}", rng.choice(["AUTO", "BUILDING"])) for k in range(20)], "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{top}/customer.parquet")
    events = [(i, start + datetime.timedelta(hours=i), rng.choice("ab"), rng.random() * 9) for i in range(200)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{top}/events.parquet")
    con = duckdb.connect()
    for name in ("orders", "customer", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{top}/{name}.parquet/*.parquet'")
    return str(top), con


def plain(value):
    return "~" if value is None else f"{float(value):.9g}" if not isinstance(value, (str, bool, int, datetime.date)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    folder, con = tables
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    rows = con.sql("SELECT " + ", ".join(f'"{x}"' for x in columns) + f" FROM ({registry.oracle_sql()[name]})").fetchall()
    assert got == sorted(tuple(plain(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def split_rows(spark, tmp_path_factory):
    """Three orders some months apart, each one bank row against two journal rows."""
    top = tmp_path_factory.mktemp("split")
    orders = [(k, 1, "O", 9000.0 * (k + 1), datetime.datetime(2024, 1 + k // 4, 5), "5-LOW") for k in (6, 16, 26)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{top}/orders.parquet")
    spark.createDataFrame([(1, "Customer#1", "AUTO")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{top}/customer.parquet")
    return str(top)


def test_whole_run_has_subset_sums(spark, split_rows):
    found = registry._reconciled(spark, split_rows).candidates.where("ctype = 'combination_dfs'")
    assert sorted((r["b_n"], r["j_n"], r["b_min"]) for r in found.collect()) == [(1, 2, 60), (1, 2, 160), (1, 2, 260)]


@pytest.fixture(scope="module")
def near_amounts(spark, tmp_path_factory):
    """Two orders 3,000 yuan and two days apart."""
    top = tmp_path_factory.mktemp("near")
    orders = [(k, 1, "O", 10000.0 + 3000.0 * (k - 1), datetime.datetime(2024, 1, 3 + 2 * k), "5-LOW") for k in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{top}/orders.parquet")
    spark.createDataFrame([(1, "Customer#1", "AUTO")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{top}/customer.parquet")
    return str(top)


def test_whole_run_has_the_production_tolerance(spark, near_amounts):
    found = registry._reconciled(spark, near_amounts).candidates.where("ctype = 'amount_difference'")
    assert sorted((r["b_min"], r["j_min"], r["diff_li"]) for r in found.collect()) == [(10, 20, 30_000_000), (20, 10, 30_000_000)]
    assert sum(r["n"] for r in registry.side_components(spark, near_amounts).collect()) == 4
    assert registry.select_matches(spark, near_amounts).count() == 2


def test_subset_sums_of_all_rows(spark, tmp_path):
    """Of keys 6 and 506, far larger than others, each bank row is the sum of two journal rows."""
    orders = [(k, 1, "O", 40000.0 + k, datetime.datetime(2024, 1, 5), "5-LOW") for k in (1, 2, 6, 17, 506)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Customer#1", "AUTO")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = {r["rec_id"]: r["ids"] for r in registry.subset_sums(spark, str(tmp_path)).collect()}
    assert found[60] == "60+61" and found[5060] == "5060+5061"


def test_subset_sums_of_many_large_rows(spark, tmp_path):
    """Twenty large orders on days of one window: forty halves, more than the window's list has."""
    orders = [(500 * i + 6, 1, "O", 40000.0 + 7 * i * i, datetime.datetime(2024, 1, 1 + i), "5-LOW") for i in range(20)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Customer#1", "AUTO")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = {r["rec_id"]: r["ids"] for r in registry.subset_sums(spark, str(tmp_path)).collect()}
    assert found == {10 * k: f"{10 * k}+{10 * k + 1}" for k, *_ in orders}


def test_whole_run_matches_all_copies(spark, tmp_path):
    """Forty equal orders, more than max_candidates, and one without a journal row: each copy goes with one of its own."""
    orders = [(10 * i, 1, "O", 9000.0, datetime.datetime(2024, 1, 5), "5-LOW") for i in range(1, 41)] + [(7, 1, "O", 12.5, datetime.datetime(2024, 1, 5), "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Customer#1", "AUTO")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    done = registry._reconciled(spark, str(tmp_path))
    assert done.candidates.where("ctype = 'exact_1to1'").count() == 1600
    assert sorted((r["b_min"], r["j_min"]) for r in done.selected.collect()) == [(100 * i, 100 * i) for i in range(1, 41)]
