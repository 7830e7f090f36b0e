"""Every registered query of the library itself against its SQL, on the smallest tables."""

import pytest

from tallyspark.plans import candidates, fields, gates, ledgers, reviews, standins, statements, statuses  # noqa: F401

from .oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(standins.SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, standins.QUERIES[name], standins.SQL[name], SF)


def test_batches_keep_components_together_and_sizes_bounded(spark):
    rows = standins.QUERIES["batch_packing"](spark, SF).toPandas()
    assert rows.bank_id.is_unique
    assert rows.groupby("batch").size().max() <= 20
    assert (rows.groupby("component").filter(lambda g: len(g) <= 2).groupby("component").batch.nunique() == 1).all()


def test_no_query_plans_a_cartesian_product(spark):
    for name in ("amount_candidates", "document_total_candidates", "reference_candidates", "token_index_candidates"):
        plan = standins.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["bank_id", "item_id", "difference", "gap", "rank"]
