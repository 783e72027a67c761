"""Inference within limits, pages put together from regions, isolated comparisons, tallies, progress and silence of streams, image headers."""

import json
import struct
import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators import comparison
from pagewright.plans import inference, pipeline
from pagewright.sources import artifacts, images
from pagewright.streaming import incremental

from .test_artifacts import ask, pages


def test_window_retries_and_time_limit():
    lock, now, most, tries = threading.Lock(), [0], [0], {}

    def flaky(row):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            tries[row["page_id"]] = tries.get(row["page_id"], 0) + 1
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        n = int(row["page_id"])
        if n % 5 == 0 and tries[row["page_id"]] <= 2:
            raise ConnectionError("busy")
        if n % 7 == 3:
            raise ValueError("never")
        if n == 12:
            time.sleep(3)
        return f"said {n}", n

    rows = [{"page_id": str(k)} for k in range(40)]
    found = list(inference.answers(rows, flaky, inference.Limits(in_flight=4, retries=2, backoff=0.01, timeout=1.0)))
    got = dict(found)
    assert len(found) == len(got) == 40 and most[0] <= 5  # the one that was given up may still be at it
    assert got[20] == ("said 20", 20, None) and tries["20"] == 3
    assert got[3] == ("", None, "ValueError: never") and tries["3"] == 3
    assert got[12][2].startswith("TimeoutError") and got[13] == ("said 13", 13, None)
    with pytest.raises(ValueError):
        inference.Limits(in_flight=0)


def test_each_page_once_with_its_key(spark):
    def echo(row):
        if row["page_id"] == "p1.jpg":
            raise RuntimeError("no")
        return row["request_key"], None

    work = pages(spark).withColumn("model", F.lit("a")).withColumn("tags", F.array(F.lit("x")))
    answer = lambda: {r.page_id: (r.raw_payload, r.error, r.tags) for r in inference.answered(work, echo, ("page_id", "model"), inference.Limits(retries=0, rows=2)).collect()}
    first = answer()
    assert len(first) == 6 and first["p1.jpg"] == ("", "RuntimeError: no", ["x"])
    assert len({v[0] for v in first.values()}) == 6 and answer() == first


def test_pages_from_regions(spark):
    region = lambda c: (None, c, (0.0, 0.0, 9.0, 9.0), 0.5, None, None, None)
    rows = [("two", [region("Text"), region("Title")], None), ("none", [], None), ("null", None, None), ("broken", [region("Text")], "out of memory"), ("fine", [region("Text")], "")]
    df = spark.createDataFrame(rows, f"page_id string, regions array<{schemas.REGION}>, detect_error string")
    said = spark.createDataFrame([("two", 1, "second", 3, None), ("fine", 0, "", None, "ValueError: x"), ("gone", 0, "?", 1, None), ("two", 1, "", None, "late failure")], "page_id string, at int, raw_payload string, tokens long, error string")
    got = {r.page_id: r for r in pipeline.assembled(df, said, "m").collect()}
    two = json.loads(got["two"].raw_payload)
    assert [b["text"] for b in two] == ["", "second"] and two[0]["error"] == "no answer came for this region" and "error" not in two[1] and got["two"].tokens == 3
    assert got["none"].raw_payload == got["null"].raw_payload == "[]" and got["none"].error is None
    assert (got["broken"].raw_payload, got["broken"].error) == ("", "layout detector failed: out of memory")
    assert json.loads(got["fine"].raw_payload)[0]["error"] == "ValueError: x" and got["fine"].error is None and len(got) == 5
    asked = pipeline.recognise_regions(df, "m", lambda row: (f"{row['category']} {row['at']}", 1)).collect()
    asked = {r.page_id: r for r in asked}
    assert [b["text"] for b in json.loads(asked["two"].raw_payload)] == ["Text 0", "Title 1"] and asked["broken"].error.startswith("layout detector failed")


def test_failing_comparison_stays_in_its_row(spark):
    def lengths(pred, base):
        if pred == "bad":
            raise ZeroDivisionError("by design")
        return None if base is None else {"longer": len(pred) - len(base)}

    rows = spark.createDataFrame([(1, "good one", "good"), (2, "bad", "good"), (3, "alone", None)], "id int, text string, reference_text string")
    got = {r.id: r.comparisons for r in comparison.compare(rows, ("text",), base_doc=None, extra={"lengths": lengths}).collect()}
    assert got[1].lengths.summary == {"longer": 4.0} and got[1].lengths.error is None and got[1].text.summary.wer == 1.0
    assert got[2].lengths.summary is None and got[2].lengths.error == "ZeroDivisionError: by design" and got[2].text is not None
    assert got[3].lengths is None and got[3].text is None
    with pytest.raises(ValueError):
        comparison.compare(rows, extra={"text": lengths})


def test_run_tallies(spark, tmp_path):
    config = pipeline.Config(output=f"file://{tmp_path}/run")
    references = spark.createDataFrame([("p0.jpg", "Title body of p0.jpg by a")], "page_id string, reference_text string")
    models = [("a", "markdown"), ("b", "markdown")]

    def bad(pred, base):
        raise RuntimeError("broken comparison")

    made = pipeline.run(spark, config, pages(spark), ask, models, references, limits=inference.Limits(retries=0), extra={"bad": bad})
    assert made.tallies["pages"] == {"written": 5, "skipped": 0, "failed": 1, "by_model": {}}
    each = {"written": 4, "skipped": 0, "failed": 1}
    assert made.tallies["raw"] == {"written": 8, "skipped": 0, "failed": 2, "by_model": {"a": each, "b": each}}
    assert made.tallies["train"] == {"written": 8, "skipped": 0, "failed": 2, "by_model": {"a": each, "b": each}}
    row = artifacts.read(spark, config.output, "train").filter("page_id = 'p0.jpg' and model = 'a'").first()
    held = json.loads(row.comparisons_json)
    assert held["bad"]["error"] == "RuntimeError: broken comparison" and held["text"]["summary"]["wer"] == 0 == row.text_wer
    again = pipeline.run(spark, config, pages(spark, 7), ask, models, references, limits=inference.Limits(retries=0))
    assert again.tallies["raw"]["by_model"]["a"] == {"written": 1, "skipped": 5, "failed": 0}
    assert again.tallies["train"] == {"written": 2, "skipped": 8, "failed": 2, "by_model": dict.fromkeys("ab", {"written": 1, "skipped": 4, "failed": 1})}


def test_progress_of_streams(spark, tmp_path):
    pages(spark, 5).coalesce(1).write.parquet(f"{tmp_path}/in")
    pages(spark, 7).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = f"{tmp_path}/progress"
    listener = incremental.ProgressTable(spark, table)
    spark.streams.addListener(listener)
    try:
        stream = incremental.follow(spark, f"{tmp_path}/in", pages(spark).schema, files_at_once=1)
        query = incremental.to_folder(stream, f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        until = time.time() + 30
        while time.time() < until:
            time.sleep(0.5)
            if (tmp_path / "progress").exists() and incremental.progress(spark, table).filter("ended").count():
                break
    finally:
        spark.streams.removeListener(listener)
    rows = incremental.progress(spark, table)
    assert sorted(r.rows for r in rows.filter("not ended and rows > 0").collect()) == [5, 7]
    assert all(r.rows_per_second > 0 and r.seconds > 0 for r in rows.filter("rows > 0").collect())
    (own,) = incremental.status(rows).collect()
    assert (own.state, own.rows, own.batches >= 2) == ("ended", 12, True) and own.rows_per_second > 0 and own.last_batch is not None


def test_partial_results_can_be_read(spark, tmp_path):
    """While a stage still follows its folder, what its finished batches wrote is there to be read, each row once."""
    pages(spark, 5).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = incremental.follow(spark, f"{tmp_path}/in", pages(spark).schema)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        for n in (5, 12):
            until = time.time() + 60
            while time.time() < until and not (list((tmp_path / "out").glob("*.parquet")) and spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").count() >= n):
                time.sleep(0.5)
            assert query.isActive and spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").count() == n
            if n == 5:
                pages(spark, 7).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    finally:
        query.stop()


def test_stale_launches(spark, tmp_path):
    kind = "run string, phase string, ts timestamp"
    base = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t").first().t
    from datetime import timedelta

    at = lambda s: base + timedelta(seconds=s)
    rows = [("a", "launching", at(0)), ("b", "launching", at(0)), ("b", "ready", at(5)), ("c", "launching", at(150)), ("d", "ready", at(0)), ("d", "launching", at(1)), (None, "launching", at(0)), ("e", "launching", None), ("f", None, at(0))]
    df = spark.createDataFrame(rows, kind)
    got = incremental.stale(df, F.lit(at(1000)).cast("timestamp")).collect()
    assert sorted((r.run, r.age) for r in got) == [("a", 1000), ("d", 999)]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = incremental.follow(spark, f"{tmp_path}/in", df.schema)
    out = incremental.stale_as_they_fall_silent(stream, silent=2)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and not query.exception():
            time.sleep(1)
            if any((tmp_path / "out").glob("*.parquet")) and spark.read.schema(out.schema).parquet(f"{tmp_path}/out").count() >= 3:
                time.sleep(4)
                break
    finally:
        query.stop()
    assert sorted((r.run, r.since) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()) == [("a", at(0)), ("c", at(150)), ("d", at(1))]


def png(w, h, colour=2):
    body = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body)) + b"rest"


def jpeg(w, h, channels=3, before=70_000):
    app = b"".join(b"\xff\xe1" + struct.pack(">H", 2 + 60_000) + b"\0" * 60_000 for _ in range(before // 60_000))
    return b"\xff\xd8" + app + b"\xff\xff\xc2" + struct.pack(">HBHHB", 8 + 3 * channels, 8, h, w, channels) + b"\0" * 3 * channels + b"\xff\xda"


def tiff(w, h, order, far=9_000):
    tags = [(256, 4, w), (257, 3, h), (277, 3, 3)]
    entries = b"".join(struct.pack(f"{order}HHI", t, k, 1) + (struct.pack(f"{order}I", v) if k == 4 else struct.pack(f"{order}HH", v, 0)) for t, k, v in tags)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", far) + b"\0" * (far - 8) + struct.pack(f"{order}H", 3) + entries + b"\0" * 4


def siz(w, h, channels=3):
    return b"\xff\x4f\xff\x51" + struct.pack(">HHIIIIIIIIH", 38 + 3 * channels, 0, w + 10, h + 20, 10, 20, 64, 64, 0, 0, channels) + b"\7\1\1" * channels


def jp2(w, h, channels=3):
    box = lambda kind, data: struct.pack(">I4s", 8 + len(data), kind) + data
    return box(b"jP  ", b"\r\n\x87\n") + box(b"ftyp", b"jp2 \0\0\0\0jp2 ") + box(b"jp2h", box(b"ihdr", struct.pack(">IIHBBBB", h, w, channels, 7, 7, 0, 0)) + box(b"colr", b"\1\0\0")) + struct.pack(">I4sQ", 1, b"jp2c", 16 + 4) + siz(w, h)[:4]


def test_image_headers(spark, tmp_path):
    whole = {
        "a.png": (png(640, 480), "png", 640, 480, 3), "grey.png": (png(5, 6, 0), "png", 5, 6, 1), "b.jpg": (jpeg(3000, 2000), "jpeg", 3000, 2000, 3), "grey.jpg": (jpeg(30, 20, 1, 0), "jpeg", 30, 20, 1),
        "c.tif": (tiff(70_000, 900, "<"), "tiff", 70_000, 900, 3), "d.tif": (tiff(800, 901, ">"), "tiff", 800, 901, 3), "e.jp2": (jp2(1234, 4321), "jp2", 1234, 4321, 3), "f.j2k": (siz(77, 88, 4), "jp2", 77, 88, 4),
        "g.gif": (b"GIF89a" + struct.pack("<HH", 12, 13) + b"\0\0\0", "gif", 12, 13, 3), "h.bmp": (b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 9, -8, 1, 24), "bmp", 9, 8, 3),
        "i.webp": (b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), "webp", 100, 50, 4),
    }
    cut = {"cut.png": png(1, 1)[:20], "cut.jpg": jpeg(1, 1)[:30_000], "cut.tif": tiff(1, 1, "<")[:9_010], "cut.jp2": jp2(1, 1)[:52], "cut.gif": b"GIF89a\1", "text.jpg": b"not an image", "flat.png": png(0, 5), "noframe.jpg": b"\xff\xd8\xff\xda\0\0"}
    for name, data in {k: v[0] for k, v in whole.items()}.items() | cut.items():
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    got = {r.name: tuple(r.h) for r in files.select("name", images.headers("content").alias("h")).collect()}
    assert {k: got[k] for k in whole} == {k: (*v[1:], None) for k, v in whole.items()}
    assert all(got[k][1:4] == (None, None, None) and got[k][4] for k in cut) and got["cut.tif"][4] == "the file ends within its header"
    assert images.header(None)["error"] == "no bytes"
