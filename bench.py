"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from glebe.session import local_session
from queries import QUERIES

HEADLINE = [
    "comparable_price_in_radius", "wells_near_parcels", "nearest_weather_point", "three_nearest_stations",
    "climate_normals", "enriched_parcels", "ranked_parcels", "scenario_ranks", "criteria_rows",
    "displayed_quotes", "weekly_prices", "weekly_prices_wide", "price_distribution", "price_trend_by_product",
    "seasonality_wide", "quote_summary", "latest_quotes", "merged_weather", "refresh_plan", "water_balance",
    "stored_weather_in_range", "quotes_from_csv", "sales_from_csv", "weather_from_payloads",
    "groundwater_per_station", "timer_pairs", "uncovered_population", "producer_density", "opportunity_scores",
    "parcels_in_triangular_zones",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("glebe-bench", cores)
    # Start the JVM's code paths and the file cache, so that the first query is not charged for them.
    QUERIES["quotes_per_market"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
