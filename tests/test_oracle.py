"""Registered queries against their DuckDB twins on the smallest scale factor,
plus the driver contract (entry/queries/oracle_sql)."""

import pytest

from tests.conftest import SF_SMALL
from tools.oracle_check import rows_of

SAMPLE = ["a01_status_statistics", "a05_batches_by_age", "a10_failure_analysis", "a16_status_report",
          "j01_update_status", "j08_apply_status_snapshot", "a17_poll_summary", "p16_unsubmitted_files",
          "w01_latest_per_key", "w02_dedup_proof", "a19_duplicate_detail", "j02_upsert", "j16_change_feed",
          "j11_column_compare", "q08_silver_gate", "q11_validate_records", "m04_shard_by_budget",
          "m08_waves", "m09_validate_output", "t08_align_partitions", "i03_lookback_upsert",
          "s12_replace_where", "f13_path_parts", "l04_stride_sample", "x01_token_count_udf", "t12_source_types",
          "n07_original_view", "q12_backfill_month", "j14_reconcile_results", "m05_hash_prefix", "l03_sample_rows",
          "x03_caller_schema", "a29_partition_status"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    from tidemark.sources.tables import DRIVER_TABLES
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_contract(spark):
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 150
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "batch_status"


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF_SMALL).toPandas()
    ddf = duck.sql(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    cols = sorted(sdf.columns)
    assert rows_of(sdf.to_dict("records"), cols) == rows_of(ddf.to_dict("records"), cols)
