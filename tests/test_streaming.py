"""Streaming results equal the batch results on the same rows."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tagloom.streaming import jobs as SJ


def _split(tmp_dir, name, key, parts=3):
    """Stage the table as ``parts`` plain parquet files (the stream source
    lists files, not Spark's output folders)."""
    import os

    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF_SMALL}/{name}.parquet")
    os.makedirs(f"{tmp_dir}/in", exist_ok=True)
    for i in range(parts):
        # key mod parts, with integer division
        mask = pc.equal(pc.subtract(t[key], pc.multiply(pc.divide(t[key], parts), parts)), i)
        pq.write_table(t.filter(mask), f"{tmp_dir}/in/{name}{i}.parquet")


def test_running_centroids_over_batches(spark, tmp_dir):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    _split(tmp_dir, "embeddings", "vec_id")
    s = SJ.file_stream(spark, f"{tmp_dir}/in", "embeddings", df.schema, max_files=1)
    q = (s.writeStream.foreachBatch(SJ.stream_centroids(s, f"{tmp_dir}/state"))
          .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(SJ._versions(spark, f"{tmp_dir}/state")) >= 3
    got = {(r["label"], r["i"]): r["mean"] for r in SJ.read_centroids(spark, f"{tmp_dir}/state").collect()}
    exp = (df.select("label", F.posexplode("embedding").alias("i", "x"))
             .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect())
    for r in exp:
        assert abs(got[(r["label"], r["i"])] - r["m"]) < 1e-9


def test_file_stream_reads_files_and_tables_written_as_folders(spark, tmp_dir):
    rows = spark.range(30).select(F.col("id"), (F.col("id") % 3).alias("x"))
    rows.filter("id < 20").repartition(3).write.parquet(f"{tmp_dir}/in/points.parquet")
    spark.range(5).write.parquet(f"{tmp_dir}/in/others.parquet")
    import pyarrow.parquet as pq
    pq.write_table(rows.filter("id >= 20").toArrow(), f"{tmp_dir}/in/points2.parquet")
    for folder in (f"{tmp_dir}/in", f"{tmp_dir}/in/"):
        out = f"{tmp_dir}/out{len(folder)}"
        q = (SJ.file_stream(spark, folder, "points", rows.schema).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", out + "-ck").trigger(availableNow=True).start())
        q.awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, rows.collect()))


def test_centroid_state_is_compacted_and_replays_count_once(spark, tmp_dir):
    rows = [(b, label, [float(b + label), float(b * label)]) for b in range(9) for label in (0, 1, b % 5)]
    df = spark.createDataFrame(rows, "b int, label int, embedding array<double>")
    merge = SJ.stream_centroids(df, f"{tmp_dir}/state", every=2)
    for b in [0, 1, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8, 8]:  # a batch may run again after its tables were written
        merge(df.filter(F.col("b") == b).drop("b"), b)
        got = {(r["label"], r["i"]): r["mean"] for r in SJ.read_centroids(spark, f"{tmp_dir}/state").collect()}
        want = {}
        for _, label, vec in [r for r in rows if r[0] <= b]:
            for i, x in enumerate(vec):
                want.setdefault((label, i), []).append(x)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - sum(v) / len(v)) < 1e-12 for k, v in want.items()), b
    assert SJ._versions(spark, f"{tmp_dir}/state", "base") == [5, 7]
    assert SJ._versions(spark, f"{tmp_dir}/state") == [6, 7, 8]


def test_centroids_of_no_batch(spark, tmp_dir):
    import pytest
    with pytest.raises(ValueError):
        SJ.read_centroids(spark, f"{tmp_dir}/none")


def test_window_counts_equal_batch(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    _split(tmp_dir, "events", "event_id")
    from tagloom.functions.time import instant
    s = SJ.file_stream(spark, f"{tmp_dir}/in", "events", ev.schema, max_files=1)
    s = s.withColumn("ts", instant(s, "ts"))
    q = (SJ.stream_counts(s, "ts", "event_type", "1 day", "3650 days").writeStream.outputMode("update")
           .format("memory").queryName("wc").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {}
    for r in spark.sql("SELECT * FROM wc").collect():  # last update per window wins
        got[(r["window_start"], r["event_type"])] = max(got.get((r["window_start"], r["event_type"]), 0), r["n"])
    b = (ev.withColumn("ts", instant(ev, "ts"))
           .groupBy(F.window("ts", "1 day").start.alias("w"), "event_type").count().collect())
    assert got == {(r["w"], r["event_type"]): r["count"] for r in b}


def test_closed_windows_drop_late_events_and_their_state(spark, tmp_dir):
    schema = "ts timestamp, topic string"
    day = "2024-03-%02d 12:00:00"
    arrivals = [[(1, "a"), (1, "a"), (2, "b")], [(3, "a"), (2, "b"), (9, "a")],
                [(1, "a"), (1, "c"), (9, "a"), (10, "b")], [(10, None), (8, "a")]]
    left, dropped, landed = [], 0, None
    go = dict(ts="ts", window="1 day", delay="1 day")

    def run(rows):
        SJ.land(rows, f"{tmp_dir}/in")
        n, d = SJ.close_windows(spark, f"{tmp_dir}/in", rows.schema, f"{tmp_dir}/out", f"{tmp_dir}/ck", key="topic", **go)
        left.append(n)
        return d
    for batch in arrivals:
        rows = spark.createDataFrame([(day % d, t) for d, t in batch], "ts string, topic string") \
            .select(F.to_timestamp("ts").alias("ts"), "topic")
        landed = rows if landed is None else landed.unionByName(rows)
        dropped += run(rows)
    dropped += run(SJ.closing_row(landed, **go))
    got = {(r["window_start"].day, r["topic"]): (r["n"], r["late"]) for r in
           SJ.late_counts(landed, spark.read.parquet(f"{tmp_dir}/out"), key="topic").collect()}
    # the watermark is noon of the 8th after the second arrival and noon of the 9th after the third
    assert got == {(1, "a"): (2, 1), (1, "c"): (0, 1), (2, "b"): (2, 0), (3, "a"): (1, 0), (8, "a"): (0, 1),
                   (9, "a"): (2, 0), (10, "b"): (1, 0), (10, None): (1, 0)}
    assert dropped == 3
    assert left[1] < left[0] + 2 and left[-1] == 1, left  # only the closing row's window is kept


def test_closing_row_of_nothing(spark):
    assert SJ.closing_row(spark.createDataFrame([], "ts timestamp, topic string")).count() == 0
