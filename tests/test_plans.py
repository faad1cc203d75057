import os

import pytest
from pyspark.sql import functions as F

from helpers import plan_of
from queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", [
    "sales_near_parcels", "nearest_weather_point", "three_nearest_stations", "comparable_price_in_radius", "wells_near_parcels",
    "parcels_in_triangular_zones", "ranked_parcels", "scenario_table_scores", "price_trend_by_product", "price_distribution",
    "merged_weather", "refresh_plan", "opportunity_scores", "best_fifth", "uncovered_population", "product_matrix"])
def test_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_few_columns_and_push_filters(spark):
    from glebe.operators.filters import quotes_of
    from glebe.operators.spatial import within_box
    from glebe.session import scratch_path

    path = scratch_path(spark, "places")
    spark.range(10).select(F.col("id").cast("double").alias("latitude"), F.col("id").cast("double").alias("longitude"),
                           F.lit("x").alias("other"), F.lit("RUNGIS").alias("marche")).write.parquet(path)
    plan = plan_of(within_box(spark.read.parquet(path), 5.0, 5.0, 100).select("latitude"))
    assert "GreaterThanOrEqual(latitude" in plan and "other" not in plan
    assert "other" not in plan_of(quotes_of(spark.read.parquet(path), ["rungis"]).select("marche"))


def test_windows_only_over_small_relations(spark):
    """Trend and distribution count before they rank: no window reads the raw quotes."""
    for name in ("price_trend_by_product", "price_distribution"):
        plan = plan_of(QUERIES[name](spark, SF))
        first_window = plan.index("Window")
        assert "HashAggregate" in plan[first_window:]
