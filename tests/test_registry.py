import pytest

from quirelake.plans import registry

from .oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def test_queries_without_oracle_run(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_and_has_the_flagship(spark):
    import __spark_entry__ as entry

    assert {"archive_summary"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["patient_uuid", "dimension", "year", "month", "value", "n"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_filter_reaches_the_scan_and_dimensions_are_broadcast(spark):
    from quirelake.operators import archive
    from quirelake.plans import driver_tables as D

    docs = D.documents(spark, SF)
    filtered = plan(archive.by_type(archive.active(docs), "1-URGENT"))
    assert "PushedFilters" in filtered and "EqualTo(o_orderpriority,1-URGENT)" in filtered
    assert "BroadcastHashJoin" in plan(archive.with_facility(docs, D.facilities(spark, SF)))
    summary = plan(archive.summary_cells(docs))
    assert summary.count("orders.parquet") <= 2 and "Python" not in summary
    # NFKC is the one Python step of the date job, on texts that aren't ASCII
    dated = plan(registry.QUERIES["date_suggested"](spark, SF))
    assert dated.count("Python") == dated.count("ArrowEvalPython") and "_nfkc" in dated and "raw_slice" not in dated
