from pyspark.sql import functions as F

from echogrid.suite import projection

SF = "/root/testdata/sf0.001"


def test_ellipsoidal_query_reads_every_input(spark, monkeypatch):
    every = projection.obs
    inputs = [r[0] for r in every(spark, SF).select("input_id").distinct().collect()]
    for name in inputs:
        monkeypatch.setattr(projection, "obs", lambda s, d, name=name: every(s, d).filter(F.col("input_id") == name))
        got = {(r.k, r.row, r.col) for r in projection.resample_ellipsoidal(spark, SF).collect()}
        assert got, name
        if name == "cz_maxz":  # both grids are Mercator, so the source cell is found by a shift alone
            seen = {(r.k, r.row, r.col) for r in projection.obs(spark, SF).select("k", "row", "col").distinct().collect()}
            cell = lambda row, col: (round((6702777.85 - 7000000.0 + (row + 0.5) * 20000.0) / 15557.0 - 0.5), round((1000000.0 + (col + 0.5) * 20000.0 - 1254222.15) / 15557.0 - 0.5))
            cells = {(row, col): cell(row, col) for row in range(60) for col in range(40)}
            assert got == {(k, *at) for at, source in cells.items() for k in {s[0] for s in seen} if (k, *source) in seen}
