from pyspark.sql import functions as F

from quire.streaming import pages

SCHEMA = "source string, image_name string, line_no int, text string"


def test_stream_keeps_latest(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n, text in enumerate(("old", "new")):
        (source / f"{n}.json").write_text(f'{{"source": "a", "image_name": "p", "line_no": {n}, "text": "{text}"}}\n')
        pages.keep_latest(pages.page_stream(spark, str(source), SCHEMA), target, str(tmp_path / "cp")).awaitTermination()
    assert [r.text for r in pages.latest(spark, target).collect()] == ["new"]


def test_fresh_checkpoint_on_old_table(spark, tmp_path):
    """Neither a new checkpoint nor a second run of the same batch loses or doubles records."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text('{"source": "a", "image_name": "p", "line_no": 5, "text": "late"}\n')
    stream = lambda: pages.page_stream(spark, str(source), SCHEMA)
    pages.keep_latest(stream(), target, str(tmp_path / "one")).awaitTermination()
    (source / "b.json").write_text('{"source": "a", "image_name": "p", "line_no": 1, "text": "early"}\n{"source": "a", "image_name": "q", "line_no": 2, "text": "other"}\n')
    pages.keep_latest(stream(), target, str(tmp_path / "two")).awaitTermination()
    assert sorted(r.text for r in pages.latest(spark, target).collect()) == ["late", "other"]


def test_daily_usage(spark, tmp_path):
    source, found = tmp_path / "in", []
    source.mkdir()
    (source / "a.json").write_text('{"ts": "2024-01-02T00:00:30Z", "pool": "a", "tokens": 3}\n{"ts": "2024-01-02T00:01:00Z", "pool": "a", "tokens": 4}\n')
    stream = pages.page_stream(spark, str(source), "ts timestamp, pool string, tokens long")
    pages.run_to_end(pages.daily_usage(stream), str(tmp_path / "cp"), lambda b, n: found.extend(b.select(F.col("day").cast("string"), "tokens").collect()))
    assert sorted(map(tuple, found)) == [("2024-01-01", 3), ("2024-01-02", 4)]
