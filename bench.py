"""Times the headline queries and prints one JSON line.

Each query runs once cold and once warm; results go to the no-op sink, so the
whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from echogrid import suite
from echogrid.plans import nowcast
from echogrid.session import build_session
from echogrid.suite import motion as suite_motion

HEADLINE = (
    "palette_histogram", "composite_products", "variant_cells", "resample_composite", "frame_stats", "morph_open", "corner_score",
    "feature_selection", "block_match", "idw_grid", "idw_upscaled", "bilinear_resize", "warp_values", "extrapolate_uniform", "extrapolate_vectors", "nowcast", "nowcast_grids",
    "overlay_tiles", "ready_timestamps", "pending_jobs", "history_frames", "gap_detection", "announced_files", "asof_frontier",
    "bundle_backlog", "buffered_bounds", "discovery_union", "listed_files",
)


def large_nowcast(spark, sf_dir: str, issues: int = 2) -> float:
    """Seconds an issue of a nowcast on a country's grid, 600 x 400 cells, three frames and six leads; not part of the total.

    Scans of the test tables repeat over the grid under a slope that tells their
    copies apart, and move by whole cells.
    """
    height, width = 400, 600
    last = suite_motion.scan(spark, sf_dir).where(F.col("k") < issues).where("value > -100")
    tiles = last.withColumns({"i": F.explode(F.sequence(F.lit(0), F.lit(height // 32))), "frame": F.lit(0)}).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(width // 32))))
    frames = tiles.withColumn("ago", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    row, col = F.col("row") + F.col("i") * 32 - F.col("ago") * 2, F.col("col") + F.col("j") * 32 + F.col("ago") * 3
    value = F.col("value") / 2 + F.sin(F.col("i") * 7 + F.col("j") * 3) * 10 + 15
    cells = frames.select(F.col("k").alias("forecast"), suite_motion.frame_time(F.col("k") - F.col("ago")).alias("frame_ts"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.alias("value"))
    cells = cells.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).cache()
    history = cells.select("forecast", "frame_ts").distinct()
    history.count()
    start = time.perf_counter()
    nowcast.nowcast(cells, history, ["forecast"], height, width, (10, 20, 30, 40, 50, 60), floor=4.0).write.format("noop").mode("overwrite").save()
    return round((time.perf_counter() - start) / issues, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    suite.load_all()
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in names:
        for timings in (cold, warm):
            start = time.perf_counter()
            suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - start, 3)
    large = large_nowcast(spark, sf_dir) if names is HEADLINE else None
    print(
        json.dumps(
            {
                "metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cores": int(cpus), "spark": spark.version,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
                "nowcast_600x400_sec_per_issue": large,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
