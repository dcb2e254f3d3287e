from pyspark.sql import functions as F

from voxelry.operators import edits
from voxelry.streaming import edits as streaming


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(k % 3, k, (k // 3) % 4 if k % 4 else None, "set_voltage" if k % 5 else "unheard_of", k % 7, float("nan") if k == 17 else 0.5) for k in range(60)]
    schema = "circuit_id long, event_idx long, expected_revision long, operation string, target long, amount double"
    frame = spark.createDataFrame(rows, schema)
    frame.coalesce(1).write.parquet(f"{tmp_path}/edits")
    stream = streaming.applied_edits(spark.readStream.schema(schema).parquet(f"{tmp_path}/edits"), 6)
    q = stream.writeStream.format("memory").queryName("edits_out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("edits_out").collect()))
    more = frame.withColumns({c: F.lit(None).cast(t) for c, t in (("amount2", "double"), ("slope", "double"), ("max_tier", "int"), ("falloff", "double"), ("term_id", "string"), ("start_step", "int"), ("duration", "int"))})
    circuits = spark.createDataFrame([(c, 0, 6, 0, True) for c in range(3)], "circuit_id long, revision long, nodes int, edges int, has_memory boolean")
    none = spark.createDataFrame([], "circuit_id long, edge_idx long, threshold double")
    want = sorted((r.circuit_id, r.event_idx, r.accepted, r.reason, r.revision_before, r.revision_after) for r in edits.judged(more, circuits, none).collect())
    assert got == want and any(r[2] for r in got) and any(r[3] == "revision_mismatch" for r in got)
