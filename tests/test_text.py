import pytest
from pyspark.sql import functions as F

from quire.functions import quality, response, text
from quire.operators import assemble, batch, discover, log, reconcile, report, select, usage
from quire.sources import ebooks, schemas, transcriber, writers
from quire.sources.html import text_of


def one(spark, f, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dehyphenate(spark):
    assert one(spark, text.dehyphenate, "politi-\nche", "Jean-\nBaptiste", "Abc-\nDef-\nghi", None) == ["politiche", "Jean-\nBaptiste", "Abc-\nDef-\nghi", None]


def test_unicode_clean(spark):
    assert one(spark, text.unicode_clean, "é", "a\r\nb", "\U00010102", "a­b", "") == ["é", "a\nb", "•", "ab", ""]


def test_spacing(spark):
    assert one(spark, text.spacing, "a    b  \n\n\n\n\nc", "a\tb") == ["a  b\n\n\nc\n", "a  b\n"]


def test_spacing_by_lines(spark):
    """Blank lines at either end, tab stops, lines of other white space, other line ends."""
    rows = "\n\n\n\nx", "x\n\n\n\n", "a\u00a0\n\u00a0\nb", "ab\tc\td", "", "\n", "a\u2028b", "  kept   two"
    assert one(spark, text.spacing, *rows) == ["\n\nx\n", "x\n\n\n", "a\u00a0\n\nb\n", "ab  c  d\n", "\n", "\n", "a\nb\n", "  kept  two\n"]


def test_wrap(spark):
    note, stray = "[1] a footnote of some length that goes on", "| a stray line of some length that goes on"
    table, image = "| a table row of some length that goes on |", "[Image: a picture of some length that goes on]"
    f = lambda c: text.wrap(c, F.lit(20))
    got = one(spark, f, note, stray, table, image, "  indented words that go on and on", "x" * 45, "a.jpg: [transcription error for a page]")
    assert got[0] == "[1] a footnote of\nsome length that\ngoes on\n" and got[1].count("\n") == 3
    assert got[2:4] == [table + "\n", image + "\n"] and got[4] == "  indented words\n  that go on and on\n"
    assert got[5] == "x" * 20 + "\n" + "x" * 20 + "\n" + "x" * 5 + "\n" and got[6].count("\n") == 1


def test_postprocess_settings(spark):
    s = text.Postprocess.of({"blank_lines": 1, "unknown": 3}, wrap_width="30", merge_hyphens=None)
    assert s == text.Postprocess(blank_lines=1, wrap_lines=True, wrap_width=30)
    assert one(spark, text.Postprocess(enabled=False).apply, "a\t\n\n\n") == ["a\t\n\n\n"]


def test_cause(spark):
    got = one(spark, text.cause, "name.jpg: [transcription error]", "text with [transcription error] inside it.", " [No transcribable text] ", None)
    assert got == ["api_error", "ok", "no_text", "ok"]


def test_quality(spark):
    assert one(spark, quality.char_run, "M" * 75, "M" * 74) == [True, False]
    loop = "abcdefghij klmnopqrst uvwxyz012 " * 20
    assert one(spark, quality.substring_loop, loop, "short", None) == [True, False, False]


def test_response(spark):
    ok = '{"transcription": "x", "no_transcribable_text": false, "transcription_not_possible": false}'
    two = '{"output_text": "first {\\"a\\": 1} then {\\"transcription\\": \\"last\\"} end"}'
    fenced = '{"output_text": "```json\\n{\\"transcription\\": \\"in ```code``` it\\"}\\n```"}'
    chat = '{"choices": [{"message": {"content": "{\\"transcription\\": null, \\"no_transcribable_text\\": true}"}}]}'
    rows = spark.createDataFrame(list(enumerate([ok, '{"error": {"code": 1}}', '{"output_text": "plain"}', "nonsense", two, fenced, chat, None])), "i int, x string")
    got = [r.y for r in response.transcribed(rows, "x", "y").orderBy("i").collect()]
    assert got == ["x", "[transcription error]", "plain", "[transcription error]", "last", "in ```code``` it", "[No transcribable text]", "[transcription error]"]
    assert one(spark, response.request_index, "req-3", "req-0", "x") == [2, None, None]


@pytest.mark.parametrize(("spec", "n", "want"), [("5", 10, [0, 1, 2, 3, 4]), ("last:3", 10, [7, 8, 9]), ("3-", 5, [2, 3, 4]), ("-2", 5, [0, 1]), ("1,3,5-8", 6, [0, 2, 4, 5])])
def test_page_range(spark, spec, n, want):
    pages = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("page_index"))
    assert sorted(r.page_index for r in select.PageRange.parse(spec).apply(pages, ["doc"]).collect()) == want


@pytest.mark.parametrize("spec", ["0", "7-3", "-", "a", ""])
def test_page_range_errors(spec):
    with pytest.raises(ValueError):
        select.PageRange.parse(spec)


def test_log_last_wins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"image_name": "p1", "text_chunk": "old", "order_index": 0}\n\n{"bad\n{"image_name": "p0", "text_chunk": "y", "order_index": 1}\n{"image_name": "p1", "text_chunk": "new", "order_index": 0}\n{"image_name": "p2", "text_chunk": null}')
    raw = log.read_log(spark, str(tmp_path))
    assert sorted((r.kind, r.n) for r in log.kinds(raw).groupBy("kind").agg(F.count("*").alias("n")).collect()) == [("other", 1), ("page", 3), ("reject", 1)]
    assert assemble.rebuild(log.pages(raw)).first().text == "new\ny"


def test_dedup_prefers_success(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 4, False), ("b", 5, False), ("", 6, True), ("", 7, True)], "custom_id string, seq int, is_error boolean")
    assert sorted(r.seq for r in reconcile.one_per_id(rows, []).collect()) == [2, 5, 6, 7]


def test_pack(spark):
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate([4, 5, 3, 9, 2])], "d int, seq long, bytes long")
    assert [r.part for r in reconcile.pack(rows, ["d"], 100, 9).orderBy("seq").collect()] == [1, 1, 2, 3, 4]


def test_html():
    assert text_of("<p>a &amp; b</p>\n<script>x</script>\n\n\n<b>c</b>") == "a & b\n\nc"


def test_first_failure_in_order(spark):
    f = lambda c: quality.first_failure(c, least=5)
    assert one(spark, f, "M" * 80, "ab", "a text of some length", '"type": "object" ' + "x y", None) == ["char_run", "truncated", None, "prompt_bleed", "truncated"]


def test_loops_by_counting():
    import random

    r = random.Random(4)
    for n in range(60):
        part = "".join(r.choice("ab c") for _ in range(r.randint(25, 90)))
        t = "".join((part if r.random() < 0.8 else "zz ") for _ in range(r.randint(5, 25)))
        slow = False
        for size in range(30, min(80, len(t) // 15) + 1, 4):
            seen = {}
            for i in range(len(t) - size + 1):
                seen[t[i : i + size]] = seen.get(t[i : i + size], 0) + 1
            slow = slow or any(k >= 15 and sum(c.isalnum() for c in p) >= 15 for p, k in seen.items())
        assert quality.loops(t) == slow


def test_split_pages(spark):
    docs = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "x" * 1_000_000)], "d int, text string")
    got = assemble.split_pages(docs.where("d < 4"), ["d"], 3).orderBy("d", "page_index").collect()
    assert [(r.d, r.page_index, r.text) for r in got] == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g"), (2, 0, ""), (3, 0, None)]
    assert assemble.split_pages(docs.where("d = 4"), ["d"], 2000).count() == 500


@pytest.mark.parametrize(("spec", "words"), [("5", "first 5 pages"), ("last:2", "last 2 pages"), ("3-4,5,9-", "pages 3-5, 9-")])
def test_page_range_in_words(spec, words):
    assert select.PageRange.parse(spec).describe() == words and not select.PageRange.parse(spec).is_empty
    assert select.PageRange().is_empty


def test_indices():
    assert select.parse_indices("0,5, 12,2-4") == [0, 2, 3, 4, 5, 12]
    for bad in ("-1", "a", "1,,2"):
        with pytest.raises(ValueError):
            select.parse_indices(bad)


def test_budget_without_cap(spark):
    used, caps = spark.createDataFrame([("a", 5), ("b", 5)], "pool string, used long"), spark.createDataFrame([("a", 3)], "pool string, cap long")
    assert sorted((r.pool, r.remaining) for r in usage.budget(used, caps).collect()) == [("a", 0), ("b", None)]


def test_transcriber_never_raises(spark):
    def call(key, content):
        if key == "b":
            raise ValueError
        return content.decode()

    rows = spark.createDataFrame([("a", b"x"), ("b", b"y")], "key string, content binary")
    got = sorted((r.key, r.text, r.failed) for r in transcriber.transcribe(rows, call).collect())
    assert got == [("a", "x", False), ("b", "[transcription error: ValueError]", True)]


def test_epub(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A B</dc:creator></metadata><manifest>'
                   '<item id="n" href="nav.xhtml" media-type="application/xhtml+xml"/><item id="b" href="two%20x.xhtml" media-type="application/xhtml+xml"/><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/></manifest>'
                   '<spine><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/></spine></package>')
        for name, body in (("nav", "guide"), ("one", "<p>first</p>"), ("two x", "second<script>no</script>")):
            z.writestr(f"o/{name}.xhtml", f"<html><body>{body}</body></html>")
    files = spark.createDataFrame([("x.epub", out.getvalue()), ("bad.epub", b"no")], "path string, content binary")
    assert [tuple(r) for r in ebooks.epub_texts(files).collect()] == [("x.epub", "# Title: T\n# Author(s): A B\n\nfirst\n\nsecond\n")]
    assert [r.error for r in ebooks.epub_sections(files).where("path = 'bad.epub'").collect()] == ["BadZipFile: File is not a zip file"]


def test_schemas(tmp_path):
    import json

    bare = {"type": "object", "properties": {k: {} for k in schemas.REQUIRED}}
    (tmp_path / "b.json").write_text(json.dumps({"name": " Zed ", "schema": bare}))
    (tmp_path / "a.json").write_text(json.dumps(bare))
    (tmp_path / "c.json").write_text('{"type": "object"}')
    (tmp_path / "d.json").write_text("{cut")
    assert [n for n, _ in schemas.schemas(str(tmp_path))] == ["a", "Zed"]
    assert schemas.text_format(bare)["name"] == "TranscriptionSchema" and schemas.text_format({}) is None
    assert schemas.unwrapped({"name": "n", "schema": bare, "strict": False}) == ("n", bare, False)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    for _ in range(2):
        writers.append_records(rows, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ['{"n":1,"s":"a"}'] * 2 + ['{"n":2}'] * 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_bytes(b"a\t\xffb  \n\n\n\n\nc")
    got = writers.postprocessed_files(spark, str(tmp_path / "in"), str(tmp_path / "v1"), text.Postprocess()).collect()
    assert [(r.name, r.text) for r in got] == [("x.txt", "a  \ufffdb\n\n\nc\n")]
    assert one(spark, lambda c: writers.output_path(c, F.lit("JSON")), "/a.b/c.txt", "/a.b/c") == ["/a.b/c.json", "/a.b/c.json"]


def test_markdown_table(spark):
    rows = spark.createDataFrame([("b", 1234.567, 3), ("a", None, 2000)], "m string, x double, n int")
    assert report.markdown_table(rows, "m", ["x", "n"]) == "| m | x | n |\n| --- | --- | --- |\n| a | N/A | 2,000 |\n| b | 1,234.57 | 3 |\n"


def test_listing(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for n in ("p10.jpg", "p2.jpg", "x.pdf"):
        (tmp_path / "f" / n).write_bytes(b"x")
    got = discover.listing(spark, str(tmp_path))
    assert sorted((r.name, r.ext, r.length) for r in got.collect()) == [("p10.jpg", "jpg", 1), ("p2.jpg", "jpg", 1), ("x.pdf", "pdf", 1)]
    assert [r.path.rsplit("/", 1)[-1] for r in discover.folder_images(got).orderBy("order_index").collect()] == ["p2.jpg", "p10.jpg"]


def test_error_file_name(spark):
    assert one(spark, batch.error_file_name, "batch_0123456789abcdef") == ["errors_batch_0123456789.jsonl"]
