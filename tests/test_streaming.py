from codeloom.streaming.rescan import LatestFiles


def test_latest_rows_win(spark, tmp_path):
    kind = "path string, content string, version long"
    state = LatestFiles()
    state.merge(spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], kind))
    again = spark.createDataFrame([("a", "2", 2), ("b", None, 3), ("c", "1", 2), ("a", "0", 0)], kind)
    for _ in range(2):
        state.merge(again)
    assert {(r.path, r.content) for r in state.current().collect()} == {("a", "2"), ("c", "1")}


def test_stream(spark, tmp_path):
    kind = "path string, content string, version long"
    for k in range(3):
        spark.createDataFrame([("a", str(k), k), (f"f{k}", "x", k)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = LatestFiles()
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.follow(stream, str(tmp_path / "check"))
    query.awaitTermination(120)
    assert {(r.path, r.content) for r in state.current().collect()} == {("a", "2"), ("f0", "x"), ("f1", "x"), ("f2", "x")}
