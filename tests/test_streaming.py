"""Snapshots as a stream give the same hits as a batch."""

from fieldloom.sources import extract
from fieldloom.streaming import snapshots

SPEC = {"site": "s", "version": 1, "record_selector": [{"kind": "css", "q": "li"}], "fields": {"v": {"stack": [{"kind": "css", "q": "b"}]}}}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, f"2024-01-0{i} 00:00:00", f"<ul><li><b>{i}</b><li><b></b></ul>") for i in (1, 2, 3)], "site string, run_id long, at string, html string").selectExpr("site", "run_id", "cast(at as timestamp) AS fetched_at", "html")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = snapshots.extracted_stream(stream, SPEC).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, found.collect())) == sorted(map(str, extract.hits(rows, SPEC, ["site", "run_id", "fetched_at"]).collect()))
    daily = snapshots.fill_by_window(found.withColumnRenamed("raw", "value"), width="1 day").collect()
    assert len(daily) == 3 and {r["fill"] for r in daily} == {0.5}
