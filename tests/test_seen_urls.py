"""The stream of new URLs against all URLs stored before."""

from pagevault.streaming.tabs import seen_url_stream


def test_urls_stay_seen(spark, rows, tmp_path):
    docs = spark.createDataFrame([("stored",)], "url string")
    days = [
        [("a", 1, 0), ("a", 2, 5), ("b", 3, 1), (None, 4, 2), (None, 5, 2), ("stored", 6, 3)],
        [("a", 7, 90_000), ("c", 8, 90_001), ("", 9, 90_002), ("b", 10, 90_000)],
        [("c", 11, 900_000), ("a", 12, 900_000), ("d", 14, 900_002), ("d", 13, 900_001)],
    ]
    for n, day in enumerate(days):  # a run of the query for each day: it goes on where it ended
        df = spark.createDataFrame(day, "url string, page_id long, s long").selectExpr("url", "page_id", "timestamp_seconds(s) as seen_at")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/d={n}")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
        seen_url_stream(stream, f"{tmp_path}/new", f"{tmp_path}/checkpoint", ["seen_at", "page_id"], docs).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/new/pages")
    assert sorted(r.page_id for r in got.collect()) == [1, 3, 4, 5, 8, 9, 13]
