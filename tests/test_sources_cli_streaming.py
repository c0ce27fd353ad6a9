import json
import zlib

import pytest
from pyspark.sql import functions as F

from emendra.__main__ import main
from emendra.operators import pairs as P
from emendra.sources import pdf, text_files
from emendra.streaming import tracker

FOX = "The quick brown fox jumps over the lazy dog."
WALKS = "The quick brown fox walks past the lazy dog."


def small_pdf(pages, deflate=False):
    """A PDF of one text line a page."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for text in pages:
        content = b"BT /F1 12 Tf 72 700 Td (" + text.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET" if text else b""
        flag = b""
        if deflate:
            content, flag = zlib.compress(content), b" /Filter /FlateDecode"
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (len(objects) + 2))
        kids.append(b"%d 0 R" % len(objects))
        objects.append(b"<< /Length %d%s >>\nstream\n" % (len(content), flag) + content + b"\nendstream")
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb\rc".encode())
    (tmp_path / "b.txt").write_bytes(b"\xe9\xe8")
    (tmp_path / "c.md").write_text("no")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.txt").write_text("deep")
    rows = {r.key: r for r in text_files.read_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.txt"}
    assert rows["a.txt"].text == "é\nb\nc" and rows["b.txt"].status == "error" and rows["b.txt"].text is None and "Cause:" in rows["b.txt"].error
    assert {r.key for r in text_files.read_folder(spark, str(tmp_path), recursive=True).collect()} == {"a.txt", "b.txt", "deep/d.txt"}
    assert text_files.read_input(spark, str(tmp_path / "a.txt")) == "é\nb\nc"
    assert text_files.read_input(spark, "just text") == "just text" and text_files.read_input(spark, "x" * 10_000) == "x" * 10_000
    with pytest.raises(ValueError, match="Unable to"):
        text_files.read_input(spark, str(tmp_path / "b.txt"))


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf_files(spark, tmp_path, deflate):
    (tmp_path / "x.PDF").write_bytes(small_pdf(["One (1)", "", "Three"], deflate))
    (tmp_path / "y.pdf").write_bytes(b"no pdf")
    rows = {r.path[-5:]: r for r in pdf.read_pdfs(spark, str(tmp_path), preserve_pages=True).collect()}
    assert rows["x.PDF"].text == "[Page 1]\nOne (1)\n\n\n\n[Page 3]\nThree" and rows["x.PDF"].page_count == 3
    assert [(p.page_number, p.text) for p in rows["x.PDF"].pages] == [(1, "One (1)"), (2, ""), (3, "Three")]
    assert rows["y.pdf"].status == "error" and rows["y.pdf"].page_count is None
    assert text_files.read_input(spark, str(tmp_path / "x.PDF")) == "One (1)\n\n\n\nThree"
    own = pdf.read_pdfs(spark, str(tmp_path / "y.pdf"), extractor=lambda content: [content.decode(), None]).first()
    assert own.text == "no pdf\n\n"


@pytest.mark.parametrize("command", [[], ["compare"], ["json"], ["text"], ["simple-text"], ["markdown"], ["stats"], ["stats", "-q"], ["markdown", "-q", "-m", "GHFM"]])
def test_commands_and_exit_codes(spark, capsys, command):
    assert main([*command, "Hello world", "Hello there"]) == 0
    out = capsys.readouterr().out
    if command in ([], ["compare"], ["json"]):
        assert json.loads(out)["stats"]["replacements"] == 1
    if "GHFM" in command:
        assert out == "Hello ~~world~~**there**\n"
    if command == ["stats", "-q"]:
        assert out.startswith("Total Changes: 1\n")
    assert main([*command, "Hello world", "Hello world"]) == 1


def test_command_errors(spark, tmp_path, capsys):
    (tmp_path / "bad.txt").write_bytes(b"\xe9\xe8")
    assert main([str(tmp_path / "bad.txt"), "test"]) == 2
    assert "Cause:" in capsys.readouterr().err
    assert main(["guide"]) == 0
    with pytest.raises(SystemExit) as e:
        main(["markdown", "-m", "custom_css", "a", "b"])
    assert e.value.code == 2


def test_pdf_with_packed_objects_fonts_and_spacing():
    """A file as writers make them: objects in a stream, inherited fonts, a Unicode map of two-byte codes, and gaps for blanks."""
    import base64
    import zlib

    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<65e5> <672c0021>] endbfrange"
    one = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm <00100011> Tj <00030012> Tj 1 0 0 1 90 700 Tm <00200021> Tj 0 -14 Td [(\\000\\020) -50 (\\000\\021) -400 (\\000\\022)] TJ ET"
    two = b"BT /F2 9 Tf 72 700 Td (caf\\351 \\223q\\224) Tj 50 0 Td (right) Tj T* [(un)20(der)-300(way)] TJ (next) ' ET"
    packed = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>", b"<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>", b"<< /Type /Font /ToUnicode 7 0 R >>", b"<< /Type /Font /Encoding /WinAnsiEncoding >>"]
    offsets, data = [], b""
    for body in packed:
        offsets.append(len(data))
        data += body + b" "
    head = b" ".join(b"%d %d" % (k, at) for k, at in enumerate(offsets, 1)) + b" "
    stream = lambda k, extra, body: b"%d 0 obj << %s /Length %d >> stream\n%s\nendstream endobj\n" % (k, extra, len(body), body)
    whole = b"%PDF-1.5\n" + stream(20, b"/Type /ObjStm /N 6 /First %d /Filter /FlateDecode" % len(head), zlib.compress(head + data)) + stream(7, b"", cmap)
    whole += stream(8, b"/Filter [/FlateDecode]", zlib.compress(one)) + stream(9, b"/Filter /ASCII85Decode", base64.a85encode(two) + b"~>")
    assert pdf.extract_pages(whole) == ["AB C 日本!\nAB C", "café “q” right\nunder way\nnext"]
    with pytest.raises(ValueError, match="encrypted"):
        pdf.extract_pages(whole + b"trailer << /Encrypt 9 0 R >>")
    with pytest.raises(ValueError, match="DCTDecode"):
        pdf.extract_pages(whole.replace(b"/ASCII85Decode", b"/DCTDecode"))


def test_edit_distance_and_unreadable_inputs(spark, capsys, monkeypatch):
    import json

    assert main(["json", "-e", "kitten", "sitting"]) == 0
    assert json.loads(capsys.readouterr().out)["stats"]["levenshtein_distance"] == 3
    assert main(["stats", "-q", "--edit-distance", "kitten", "sitting"]) == 0
    assert "Levenshtein Distance: 3" in capsys.readouterr().out
    from pyspark.errors import PySparkRuntimeError

    from emendra.sources import text_files

    def broken(spark, given):
        raise PySparkRuntimeError("a block is lost")

    monkeypatch.setattr(text_files, "read_input", broken)
    assert main(["text", "a", "b"]) == 2
    assert "Cause: a block is lost" in capsys.readouterr().err


def test_pairing_and_summaries(spark):
    old = spark.createDataFrame([("a", FOX), ("b", "same"), ("c", "gone"), (None, "x")], "key string, text string")
    new = spark.createDataFrame([("a", WALKS), ("b", "same"), ("d", "new"), (None, "y")], "key string, text string")
    assert {(r.key, r.status) for r in P.snapshot_status(old, new).collect()} == {("a", "modified"), ("b", "modified"), ("c", "deleted"), ("d", "new"), (None, "deleted"), (None, "new")}
    rows = spark.createDataFrame([("a", "compared", 2), ("b", "compared", 0), ("c", "missing_in_dir2", None), ("e", "error", None)], "key string, status string, changes int")
    assert tuple(P.batch_summary(rows).first()) == (4, 2, 1, 1, 1)
    assert {r.key for r in P.missing_keys(old, new).collect()} == {"c", None}
    with pytest.raises(ValueError, match="One source"):
        P.compare_many(spark.createDataFrame([], "source string"), old)
    versions = spark.createDataFrame([("d", 2, WALKS), ("d", 1, FOX), ("d", 3, WALKS)], "doc string, version int, text string")
    assert [(r.version, r.total_changes, r.cumulative_changes) for r in P.version_stats(versions).orderBy("version").collect()] == [(1, 0, 0), (2, 1, 1), (3, 0, 1)]
    figures = "struct<total_changes: int, change_ratio: double, deletions: int, insertions: int, replacements: int>"
    rows = spark.createDataFrame([("p|q", (1, 0.5, 1, 0, 0)), ("a", (2, 0.0625, 0, 1, 1)), ("none", (0, 0.0, 0, 0, 0))], f"path string, stats {figures}")
    assert P.ci_table(rows) == P.CI_HEAD + "| 2 | 62 | 0 | 1 | 1 | a |\n| 1 | 500 | 1 | 0 | 0 | p\\|q |\n"


def test_streams(spark, tmp_path):
    rows = [("d", 1, FOX), ("d", 2, WALKS), ("e", 1, "x"), ("d", None, "y"), ("d", 3, WALKS)]
    schema = "doc string, version long, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = tracker.track_versions(stream).writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    found = {(r.doc, r.version): r for r in spark.table("tracked").collect()}
    assert {k: r.total_changes for k, r in found.items()} == {("d", 1): 0, ("d", 2): 1, ("e", 1): 0, ("d", 3): 0}
    assert found["d", 2].change_ratio == 11 / 44
    pairs = "ts timestamp, source string, test string"
    spark.createDataFrame([(FOX, WALKS)] * 3, "source string, test string").select(F.timestamp_seconds(F.lit(1_000_000)).alias("ts"), "source", "test").write.parquet(str(tmp_path / "pairs"))
    counted = tracker.changes_by_window(tracker.stream_stats(spark.readStream.schema(pairs).parquet(str(tmp_path / "pairs"))))
    query = counted.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.pairs, r.changes) for r in spark.table("windows").collect()] == [(3, 3)]


def test_html_report(spark, tmp_path):
    from emendra.functions import changes as C
    from emendra.functions import render as R
    from emendra.operators.diff import diff_pairs

    pairs = spark.createDataFrame([("b.txt", FOX, WALKS), ("a.txt", FOX, FOX)], "path string, source string, test string")
    found = C.with_changes(diff_pairs(pairs)).withColumn("stats", C.stats()).withColumn("markdown", R.markdown("none"))
    sections = found.withColumn("section", R.html_section())
    R.write_report(sections, P.report_summary(found), str(tmp_path / "report"))
    page = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</html>")
    assert page.index("a.txt") < page.index("b.txt") and "Nothing differs." in page and "<ins>walks past </ins>" in page and "total changes: 1" in page
