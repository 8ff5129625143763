"""Snapshots of an edge stream."""

from graphloom.streaming.snapshots import SnapshotSink


def test_snapshots(spark, tmp_path):
    rows = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "b", 3.0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "src string, dst string, weight double").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    seen = []
    sink = SnapshotSink(lambda g, epoch: seen.append((epoch, g.edge_count())))
    s = spark.readStream.schema("src string, dst string, weight double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.src, r.dst, r.weight) for r in sink.graph().edges.collect()} == {("a", "b", 4.0), ("b", "c", 2.0)}
    assert [e for e, _ in seen] == [0, 1, 2]
