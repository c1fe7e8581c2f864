"""Readers and writers over small files."""

from taleweave.scratch import fresh_path
from taleweave.sources import files


def text_files(spark, rows, label):
    path = fresh_path(spark, label)
    for k, (name, body) in enumerate(rows):
        sc = spark.sparkContext
        out = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = out.getFileSystem(sc._jsc.hadoopConfiguration())
        stream = fs.create(out)
        stream.write(bytearray(body.encode() if isinstance(body, str) else body))
        stream.close()
    return path


def test_chapters_and_inventory(spark):
    path = text_files(spark, [("ch2.txt", "two\nlines"), ("010 - Ten.txt", "ten"), ("note.txt", "no number"), ("ch0.txt", "zero")], "chapters")
    assert {(r.n, r.text) for r in files.chapters(spark, path).collect()} == {(2, "two\nlines"), (10, "ten")}
    path = text_files(spark, [("1/e/a.wav", "x"), ("1/e/b.wav", "yy")], "segments")
    assert [(r.chapter, r.engine, r.name, r.bytes) for r in files.inventory(spark, path).collect()] == [("1", "e", "a.wav", 1), ("1", "e", "b.wav", 2)]


def test_registry_and_rules(spark):
    path = text_files(spark, [("pool.json", '{"door": {"tags": ["wood"], "files": ["d.wav"], "looped": false}, "rain": {"tags": [], "looped": true, "level": 0.5}}')], "pool")
    assert {(r.name, r.looped, r.level) for r in files.registry(spark, path).collect()} == {("door", False, None), ("rain", True, 0.5)}
    assert files.registry(spark, text_files(spark, [("pool.json", "not json")], "pool")).count() == 0
    path = text_files(spark, [("map.json", '{"rules": [{"match": ["cave"], "effect": ["echo"], "level": 0.4}, {"match": ["road"]}]}')], "scenes")
    assert [(r.pos, r.match, r.level) for r in files.scene_rules(spark, path).orderBy("pos").collect()] == [(0, ["cave"], 0.4), (1, ["road"], None)]


def test_charsets(spark):
    rows = [(bytearray("Đêm".encode()), "text/html"), (bytearray("café".encode("latin-1")), "text/html; charset=iso-8859-1"), (bytearray("<meta charset=utf-16le>".encode()), ""), (bytearray(b"\xe9t\xe9"), "")]
    got = [r.text for r in files.decoded(spark.createDataFrame(rows, "content binary, content_type string")).collect()]
    assert got == ["Đêm", "café", "<meta charset=utf-16le>", "été"]


def test_book_ranges_and_subtitles(spark):
    items = [("b", 1, "The road was long"), ("b", 2, "and dark."), ("b", 3, "Then it end-"), ("b", 4, "ed. New."), ("b", 5, "Next day.")]
    got = files.book_ranges(spark.createDataFrame(items, "book string, pos int, text string")).first().text
    assert got == "The road was long and dark.\n\nThen it ended. New.\n\nNext day."
    cues = spark.createDataFrame([(1, 0, 0, 1500, "a"), (1, 1, 3_661_001, 3_662_999, "b")], "chapter long, pos int, start long, end long, text string")
    assert files.subtitles(cues).first().body == "1\n00:00:00,000 --> 00:00:01,500\na\n\n2\n01:01:01,001 --> 01:01:02,999\nb\n"
    assert files.subtitles(cues, vtt=True).first().body.startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\na\n")


def test_import_check(spark):
    rows = [(1, "x" * 300), (2, "short"), (0, "x" * 300), (None, "x" * 300), (3, "x" * 300)]
    got = {(r.n, r.fault) for r in files.importable(spark.createDataFrame(rows, "n int, text string"), spark.createDataFrame([(3,)], "n int")).collect()}
    assert got == {(1, None), (2, "too short"), (0, "no number"), (None, "no number"), (3, "digested already")}
