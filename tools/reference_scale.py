"""Feature build at the size of the published baseline: 42 sites, 2.73 million rows.

The input is derived by Spark (no data is kept); it is written once, then read,
turned into features and written partitioned, which is what the baseline times.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from pvlake.functions.clock import from_micros  # noqa: E402
from pvlake.plans import build  # noqa: E402
from pvlake.session import build_session  # noqa: E402
from pvlake.sources.writers import write_partitioned  # noqa: E402

SITES, SLOTS = 42, 65_047


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("reference-scale", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(4 * int(cpus)),
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="pvlake-scale-")
    slot = F.floor(F.col("id") / SITES).cast("long")
    site = (F.pmod(F.col("id"), F.lit(SITES)) + 1).cast("long")
    wave = F.sin(slot * 0.0654498) * 20 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0
    rows = spark.range(SITES * SLOTS).select(
        site.alias("site_id"), (F.pmod(site, F.lit(5)) + 1).alias("campus_id"),
        from_micros(F.lit(1_577_836_800_000_000) + slot * 900_000_000).alias("timestamp"),
        F.when(wave > 0, wave).alias("power"),
        *[(F.cos(slot * k) * 10 + 15).alias(n) for k, n in (
            (0.01, "temperature"), (0.011, "apparent_temperature"), (0.012, "dew_point_temperature"), (0.013, "humidity"), (0.014, "wind_speed"))],
        F.pmod(F.col("id"), F.lit(360)).cast("double").alias("wind_direction"))
    rows.write.mode("overwrite").parquet(f"{root}/processed")
    coords = spark.createDataFrame([(c, -37.0 - c / 10, 145.0 + c / 10) for c in range(1, 6)], "campus_id long, latitude double, longitude double")
    for attempt in (1, 2):
        start = time.perf_counter()
        features = build.build_features(spark.read.parquet(f"{root}/processed"), coords)
        if len(sys.argv) > 1 and sys.argv[1] == "noop":
            features.write.format("noop").mode("overwrite").save()
        else:
            write_partitioned(features, f"{root}/features", clustered=True)
        print(f"run {attempt}: {time.perf_counter() - start:.1f} s for {SITES * SLOTS:,} rows x {len(features.columns)} columns")
    if len(sys.argv) > 2:
        features.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
