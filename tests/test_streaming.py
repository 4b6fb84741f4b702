import datetime as dt

from asterism.streaming.chains import follow_chain, progress, write_progress


def test_windows_are_written_once_across_restarts(spark, tmp_path):
    path, out, state = str(tmp_path / "chain"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "walker long, step int, theta0 double, log_prob double, ts timestamp"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(w, s, float(s), -float(s), at(s)) for s in range(30) for w in (1, 2)]
    spark.createDataFrame(rows + rows[:5], schema).write.parquet(path)
    for more in ([], [(1, 500, 1.0, -1.0, at(500))], [(1, 501, 1.0, -1.0, at(501))]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(path)
        write_progress(progress(follow_chain(spark, path)), out, state).awaitTermination(120)
    got = {r["start"].minute: (r["n"], r["best"]) for r in spark.read.parquet(out).collect()}
    assert {k: v for k, v in got.items() if k < 30} == {0: (20, 0.0), 10: (20, -10.0), 20: (20, -20.0)}
