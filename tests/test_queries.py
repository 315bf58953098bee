"""Every registered query against its SQL in DuckDB, and the plans of the decisive joins."""

import collections
import math

import duckdb
import pytest

import __spark_entry__ as contract
from hostlake.plans import gold
from workload.fixtures import BASE_TABLES
from workload.oracles import oracle_texts
from workload.queries import QUERIES, Layers

@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_texts())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    frame = contract.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = collections.Counter(tuple(plain(v) for v in row) for row in frame.select(*columns).collect())
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = collections.Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    assert sum(got.values()) > 0
    assert got == expected


@pytest.mark.parametrize("salts", [1, 4])
def test_attribution_has_no_nested_loop(spark, sf_dir, salts):
    plan = Layers(spark, sf_dir).process_network(salts=salts)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_decoding_runs_without_python(spark, sf_dir):
    frame = contract.queries()["decode_dns_records"](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_presence_join_reads_ids_only(spark, sf_dir, tmp_path):
    layers = Layers(spark, sf_dir)
    layers.ip().write.parquet(str(tmp_path / "ip"))
    stored = spark.read.parquet(str(tmp_path / "ip"))
    from hostlake.operators.keyed import new_rows

    appended = new_rows(stored, layers.ip(), ["_id"], unique=True)
    scans = [line for line in appended._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and "/ip]" in line]
    assert scans and all("ReadSchema: struct<_id:bigint>" in line for line in scans)


def test_host_dimension_looks_up_no_ports(spark, sf_dir):
    """Addresses need neither services nor processes; they are those of the whole socket dimension and fact."""
    layers = Layers(spark, sf_dir)
    rows = QUERIES["gold_dim_network_host"](spark, sf_dir)
    assert "part.parquet" not in " ".join(rows.inputFiles())
    pair = ["source_address", "destination_address"]
    for less, full in (
        (gold.socket_addresses(layers.files(), layers.hosts()), layers.dim_socket()),
        (gold.packet_addresses(layers.transport(), layers.ip(), layers.packets()), layers.fact_ip()),
    ):
        assert {tuple(r) for r in less.collect()} == {tuple(r) for r in full.select(*pair).distinct().collect()}
