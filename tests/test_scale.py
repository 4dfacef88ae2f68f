"""Plans keep hot keys spread, read few columns, and never pair rows without a key."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from echogrid import suite
from echogrid.operators import cells as C
from echogrid.operators.skew import attach_by_key
from echogrid.operators.tiles import with_halo
from echogrid.session import cut_lineage, shared_dir

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_equals_a_plain_join(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("int").alias("k"), F.col("id").alias("v"))
    per_key = spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 7).alias("w"))
    for how in ("inner", "left"):
        salted = attach_by_key(many, per_key, ["k"], ["v"], how)
        assert sorted(map(tuple, salted.select("k", "v", "w").collect()), key=str) == sorted(map(tuple, many.join(per_key, "k", how).select("k", "v", "w").collect()), key=str)


def test_hot_key_is_spread_over_salts(spark):
    hot = spark.range(1600).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    salts = hot.select(F.pmod(F.hash("v"), F.lit(16)).alias("s")).groupBy("s").count().collect()
    assert len(salts) == 16 and max(r["count"] for r in salts) < 200


# Queries that write and read a store or a stream, or settle an intermediate, before their result.
EAGER = {"nowcast", "nowcast_grids", "extrapolate_packed", "raster_decode", "raster_frames", "batch_isolation", "output_notices", "nowcast_persistence", "forecast_store", "stored_minutes", "overlay_tiles", "sidecar_documents", "product_registry", "extrapolate_vectors", "track_features", "block_match", "vector_outliers"}


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) - EAGER))
def test_building_a_plan_runs_no_job(spark, name):
    if name.startswith("stream_"):
        pytest.skip("runs a stream")
    spark.sparkContext.setJobGroup(f"plan-{name}", "planning")
    suite.QUERIES[name](spark, SF)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan-{name}")
    stages = [spark.sparkContext.statusTracker().getJobInfo(j) for j in jobs]
    assert all(info is None or len(info.stageIds) == 1 for info in stages), "reading a footer is the only job"


def test_halo_copies_stay_bounded(spark):
    cells = C.target_cells(spark.createDataFrame([(1, 64, 64)], "k int, height int, width int")).select("k", "row", "col")
    tiled = with_halo(cells, 16, 2, 64, 64)
    largest = tiled.groupBy("tile_r", "tile_c").count().agg(F.max("count")).first()[0]
    assert largest == (16 + 2 * 2) ** 2
    assert tiled.count() == sum(min(64, a + 18) - max(0, a - 2) for a in range(0, 64, 16)) ** 2


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_query_pairs_rows_without_a_key(spark, name):
    if name.startswith("stream_"):
        pytest.skip("runs a stream")
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(entry.queries()["composite_max"](spark, SF))
    schema = text.split("ReadSchema:")[1].splitlines()[0]
    assert "l_extendedprice" not in schema and "l_orderkey" not in schema


@pytest.mark.parametrize("name", ["largest_polygon", "buffered_bounds"])
def test_vertices_are_never_broadcast(spark, name):
    assert "Broadcast" not in plan(entry.queries()[name](spark, SF))


def test_bundle_names_are_read_once_and_not_shuffled(spark):
    text = plan(entry.queries()["bundle_backlog"](spark, SF))
    assert text.count("_ft(") == 1 and text.count("d{8}") == 2, "conditions on what was read are not moved before the reading"
    moved = [line for line in text.splitlines() if "Exchange" in line] + [line.split("functions=")[0] for line in text.splitlines() if "Aggregate(" in line]
    assert all("bundle#" not in line and "member#" not in line for line in moved), "members are told apart by their keys"


def test_ranks_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["history_frames"](spark, SF))


def test_checkpoints_go_to_the_configured_folder(spark):
    folder = shared_dir(spark)
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert spark.sparkContext.getCheckpointDir().rstrip("/").rsplit("/", 1)[0].endswith(folder.rstrip("/")) or spark.conf.get("spark.checkpoint.dir", None)


def test_task_functions_run_where_the_package_is_not_installed(tmp_path):
    import subprocess
    import sys

    import numpy as np
    from pyspark import cloudpickle

    from echogrid.operators.neighbourhood import corner_scores
    from echogrid.operators.tiles import window_of

    window = window_of(0, 0, 16, 3, 16, 16)
    level = np.arange(256.0).reshape(16, 16) % 7
    (tmp_path / "task.bin").write_bytes(cloudpickle.dumps((corner_scores, window, level)))
    script = "import pickle; f, w, a = pickle.load(open('task.bin', 'rb')); print(repr(float(f(a, w, 2).sum())))"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert float(done.stdout) == float(corner_scores(level, window, 2).sum())
