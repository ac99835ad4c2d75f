import pytest
from oracle import same

from tessera.plans import catalog

QUERIES, SQL = catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).toPandas().notna().any().any()


def test_entry_points_import(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["source", "item_id", "matched", "total", "pct"]


def test_claims_stream(spark, tmp_path):
    from tessera.streaming.claims import claims_stream

    spark.sql("SELECT timestamp'2024-01-01 00:00:00' ts, 1L user_id, 'a' event_type, id event_id FROM range(3)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string, event_id long").parquet(str(tmp_path / "in"))
    q = claims_stream(stream).writeStream.outputMode("complete").format("memory").queryName("claims").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[3:] for r in spark.table("claims").collect()] == [(3, 0)]
