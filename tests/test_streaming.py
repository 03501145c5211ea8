"""Continuous search: files that arrive later are searched, each exactly once."""

from trawl import Query, search
from trawl.streaming.search_stream import corpus_stream, start_search_stream


def test_stream_searches_new_files_once(spark, tmp_path):
    src, sink, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    schema = "path string, text string"
    first = spark.createDataFrame([("/a.txt", "alpha beta\nalpha"), ("/b.txt", "nothing")], schema)
    first.write.mode("append").parquet(src)
    q = Query("alpha", context_lines=1)

    def run_once():
        stream = corpus_stream(spark, src, first.schema)
        h = start_search_stream(stream, q, sink, ckpt, available_now=True)
        h.awaitTermination()
        assert h.exception() is None

    run_once()
    assert spark.read.parquet(sink).count() == 2
    second = spark.createDataFrame([("/c.txt", "ALPHA and alpha")], schema)
    second.write.mode("append").parquet(src)
    run_once()  # restarts from the checkpoint: only the new file is searched
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    want = sorted(tuple(r) for r in search(first.unionByName(second), q, ordered=False).collect())
    assert got == want
