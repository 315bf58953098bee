"""A flush of all tables keeps one write at a time on the driver."""

import threading
import time

from hostlake.plans import lifecycle
from hostlake.schemas import TABLES, empty, tables_of
from hostlake.sources.lake import Lake


def test_a_flush_writes_one_table_after_the_other(spark, tmp_path, monkeypatch):
    lock, under_way, most, written = threading.Lock(), 0, 0, []

    def write(lake, name, *_, **__):
        nonlocal under_way, most
        with lock:
            under_way += 1
            most = max(most, under_way)
        time.sleep(0.05)
        with lock:
            under_way -= 1
        written.append(name)
        return empty(spark, name)

    lake = Lake(spark, str(tmp_path / "lake"))
    with monkeypatch.context() as patched:
        patched.setattr(Lake, "append", write)
        patched.setattr(Lake, "replace", write)
        patched.setattr(lifecycle, "_write_gold", write)
        lifecycle.run_silver(lake, "2024-01-01 00:00:00")
        lifecycle.run_gold(lake, "2024-01-01 00:00:00")
    layers = {t.name for t in TABLES.values() if t.name.startswith(("silver_", "gold_dim_", "gold_fact_", "gold_tech_"))}
    assert set(written) == layers
    assert most == 1


def test_an_export_writes_one_table_after_the_other(spark, tmp_path, monkeypatch):
    workers, real = [], lifecycle.ThreadPoolExecutor
    monkeypatch.setattr(lifecycle, "ThreadPoolExecutor", lambda n: workers.append(n) or real(n))
    tables = {t.name: empty(spark, t.name) for t in tables_of("gold")[:3]}
    paths = lifecycle.export_gold(tables, str(tmp_path))
    assert workers == [1] and len(paths) == 3
    assert all(spark.read.schema(TABLES[n].schema).parquet(f"{tmp_path}/{n}.parquet").count() == 0 for n in tables)
