from pyspark.sql import functions as F

from quillon.streaming import online as on


def energies(spark):
    rows = [(s, t, 1.0 if (t // 30 + s) % 2 == 0 else -1.0) for s in range(3) for t in range(300)]
    return spark.createDataFrame(rows, "stream_id long, t long, energy double")


def test_silence_run_closes():
    ear = on.Listener(most=2)
    acts = [ear.step(t, e) for t, e in enumerate((-1, 1, 1, -1, -1, -1, -1, 0, 2))]
    assert acts == [on.SILENCE, on.START, 0, 0, 0, on.END, on.SILENCE, on.SILENCE, on.START]


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    e = energies(spark)
    e.withColumn("part", F.floor(F.col("t") / 50)).repartitionByRange(6, "part").sortWithinPartitions("t").drop("part").write.parquet(str(tmp_path / "in"))
    import os
    import pathlib

    # File order is time order.
    for k, f in enumerate(sorted(pathlib.Path(tmp_path / "in").glob("*.parquet"))):
        os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = on.run_available(on.online_segments(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    key = lambda r: (r["stream_id"], r["first"], r["last"], r["frames"])
    want = sorted(map(key, on.batch_segments(e).collect()))
    assert sorted(map(key, out.collect())) == want and len(want) > 3


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    src, schema = str(tmp_path / "in"), "stream_id long, ts timestamp, value double"
    def put(*minutes):
        spark.createDataFrame([(1, at(m), 1.0) for m in minutes], schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = on.tumbling_means(spark.readStream.schema(schema).parquet(src), "10 minutes", late="5 minutes")
        return {(x.begin, x.frames) for x in on.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck")).collect()}

    put(1, 2)
    put(40)
    run()
    put(3, 41)   # the window of minute 3 closed when minute 40 was seen
    put(90)
    assert run() >= {(at(0), 2), (at(40), 2)} and (at(0), 3) not in run()


def test_partial_results_over_batches(spark, tmp_path):
    rows = [("s", t, k, float((t * 7 + k * 3) % 11)) for t in range(35) for k in range(3)]
    scores = spark.createDataFrame(rows, "stream_id string, t long, label long, logp double")
    for lo, hi in ((0, 12), (12, 35)):
        scores.where(f"t >= {lo} and t < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import os
    import pathlib

    files = sorted(pathlib.Path(tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)
    for k, f in enumerate(files):
        os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((x["at"], x["frames"], x["label"], x["ll"]) for x in on.run_available(on.partial_results(stream), str(tmp_path / "out"), str(tmp_path / "ck")).collect())
    sums, want = [0.0] * 3, []
    for t in range(35):
        for k in range(3):
            sums[k] += (t * 7 + k * 3) % 11
        if (t + 1) % 10 == 0:
            want.append((t, t + 1, max(range(3), key=lambda k: (sums[k], -k)), max(sums)))
    assert got == want
