"""Raw files, partition overwrites and databases."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from lexmill.sources import pages
from lexmill.sources.tables import read_jdbc, replace_code_articles, write_jdbc, write_partitions


def test_files_in_several_charsets_are_read_in_one_pass(spark, tmp_path):
    russian, french = "<html><p>Статья 1. «Право»</p>", "<html><p>été œuvre</p>"
    files = {
        "plain.html": russian.encode(),
        "marked.html": b"\xef\xbb\xbf" + russian.encode(),
        "sniffed.html": russian.encode("cp1251"),
        "declared.html": russian.replace("<p>", '<meta http-equiv="Content-Type" content="text/html; charset=windows-1251"><p>').encode("cp1251"),
        "koi.html": russian.replace("<p>", "<meta charset='KOI8-R'><p>").replace("«", "").replace("»", "").encode("koi8-r"),
        "cp1252.html": french.replace("<p>", "<meta charset=cp1252><p>").encode("cp1252"),
        "latin.html": french.replace("œ", "oe").replace("<p>", "<meta charset=iso-8859-1><p>").encode("latin-1"),
        "wide.html": ("﻿" + russian).encode("utf-16-le"),
        "unknown.html": russian.replace("<p>", "<meta charset=x-none><p>").encode(),
        "broken.html": b"<html><meta charset=utf-8><p>\xff\xfe ok",
        "paper.bin": b"%PDF-1.4 \xff\x00",
        "blob": bytes(range(128, 160)),
        "empty.html": b"",
        "note.txt": "заметка".encode(),
    }
    for name, data in files.items():
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / ("sub" if name < "m" else ".") / name).write_bytes(data)
    found = {r.doc_id: r for r in pages.load_raw_files(spark, str(tmp_path)).collect()}
    assert set(found) == {name.split(".")[0] for name in files if name != "empty.html"}  # Spark lists no empty files
    assert all(r.metadata["length"] == str(len(files[Path(r.url).name])) and r.metadata["modified"] for r in found.values())
    text = {k: r.text for k, r in found.items()}
    assert text["plain"] == text["marked"] == text["sniffed"] == russian and text["wide"].lstrip("﻿") == russian
    assert "Статья 1. «Право»" in text["declared"] and "Статья 1. Право" in text["koi"] and "été œuvre" in text["cp1252"] and "été oeuvre" in text["latin"]
    assert "«Право»" in text["unknown"] and "ok" in text["broken"] and "�" in text["broken"]
    assert (found["paper"].content_type, text["paper"]) == ("application/pdf", None) == (found["paper"].content_type, found["paper"].charset)
    assert (found["blob"].content_type, text["blob"], text["note"]) == ("application/octet-stream", None, "заметка")
    assert {k: found[k].charset for k in ("plain", "sniffed", "koi", "cp1252", "latin", "wide")} == {"plain": "utf-8", "sniffed": "windows-1251", "koi": "koi8-r", "cp1252": "windows-1252", "latin": "iso-8859-1", "wide": "utf-16"}
    assert pages.load_raw_files(spark, str(tmp_path), "*.txt").count() == 1
    rows = spark.createDataFrame([(1, None), (2, bytearray(b""))], "i int, content binary")
    assert [tuple(r)[2:5] for r in pages.raw_documents(rows, F.col("i"), F.lit("a.html"), "content", F.create_map()).collect()] == [("text/html", "utf-8", "")] * 2


def test_code_pages_are_those_of_the_standard():
    for name in pages.CODE_PAGES:
        latin, own = pages.code_page_letters(name)
        assert own.encode(name) == latin.encode("latin-1")


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


def test_codes_are_replaced_and_other_partitions_keep_their_files(spark, tmp_path):
    path, day = str(tmp_path / "articles"), dt.date(2024, 1, 1)
    schema = "code_id string, article_number string, version_date date, eo long, is_current boolean, is_repealed boolean, text_hash string"
    write_partitions(spark.createDataFrame([(c, n, day, 1, False, True, "old") for c in "AB" for n in "123"], schema), path, ["code_id"], ["article_number"])
    before = _files(path)
    rows = [("A", "1", day, 5), ("A", "1", day, 9), ("A", "7", day, 2), ("A", "7", dt.date(2024, 2, 2), 3), ("C", "1", day, 4), (None, "1", day, 6)]
    batch = spark.createDataFrame(rows, "code_id string, article_number string, version_date date, eo long")
    counts = replace_code_articles(batch, path, "eo")
    assert sorted(map(tuple, counts.collect())) == [("A", 2), ("C", 1)]
    stored = spark.read.parquet(path)
    assert sorted((r.code_id, r.article_number, str(r.version_date), r.eo) for r in stored.filter("code_id <> 'B'").collect()) == [("A", "1", "2024-01-01", 9), ("A", "7", "2024-01-01", 2), ("A", "7", "2024-02-02", 3), ("C", "1", "2024-01-01", 4)]
    assert {(r.is_current, r.is_repealed, r.text_hash) for r in stored.filter("code_id <> 'B'").collect()} == {(True, False, "")}
    after = _files(path)
    kept = {f: t for f, t in before.items() if f.startswith("code_id=B")}
    assert kept and kept.items() <= after.items() and not any(f in after for f in before if f.startswith("code_id=A"))
    assert replace_code_articles(batch.limit(0), path, "eo").count() == 0 and _files(path) == after


def test_database_tables_are_read_by_ranges(spark):
    url, rows = "jdbc:derby:memory:lexmill;create=true", [(i, f"text {i}", None if i % 7 == 0 else i * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, title string, size long")
    write_jdbc(df.repartition(4), url, "docs", parts=2, batch=50)
    stored = read_jdbc(spark, url, "docs", "id", parts=5)
    assert stored.rdd.getNumPartitions() == 5 and sorted(map(tuple, stored.collect())) == rows
    by_nullable = read_jdbc(spark, url, "docs", "size", parts=3)
    assert sorted(map(tuple, by_nullable.collect())) == rows  # rows with nulls are read too
    plan = stored.filter("id > 150").select("title")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ReadSchema: struct<TITLE:string>" in plan.replace("title", "TITLE") and stored.filter("id > 150").count() == 49
    write_jdbc(df.limit(0), url, "nothing")
    assert read_jdbc(spark, url, "nothing", "id").count() == 0
    write_jdbc(df.filter("id = 3"), url, "docs")
    assert read_jdbc(spark, url, "docs", "id").filter(F.col("id") == 3).count() == 2
