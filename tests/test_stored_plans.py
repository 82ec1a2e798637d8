"""stored pages are read back without sorting their JSON."""

from leafmill.plans import record_catalogue


def test_stored_pages_are_not_sorted(spark):
    plan = record_catalogue.stored_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
