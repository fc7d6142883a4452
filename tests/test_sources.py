import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import pixels
from strandline.sources import files, payloads


def parsed(spark, source, payload):
    df = spark.createDataFrame([(json.dumps(payload),), ("broken",), (None,)], "p string")
    return [r.asDict() for r in payloads.search_rows(df, "p", source).collect()]


def test_payloads(spark):
    rows = parsed(spark, "duckduckgo", {"results": [{"image": "u", "title": " t ", "url": "page", "width": 3, "height": 4}], "next": "n"})
    assert rows == [{"url": "u", "title": "t", "source": "duckduckgo", "width": 3, "height": 4, "thumbnail": "", "license": "", "author": "", "page_url": "page"}]
    pages = {"1": {"title": "File:A", "imageinfo": [{"url": "u", "mime": "image/png", "extmetadata": {"Artist": {"value": "<b>J</b>"}}}]}, "2": {"title": "x", "imageinfo": [{"url": "v", "mime": "video/mp4"}]}}
    rows = parsed(spark, "wikimedia", {"query": {"pages": pages}})
    assert [(r["url"], r["title"], r["author"]) for r in rows] == [("u", "A", "J")]
    assert parsed(spark, "openverse", {"results": [{"url": "u", "creator": "c", "license": "by"}]})[0]["license"] == "by"
    assert parsed(spark, "pexels", {"photos": [{"src": {"original": "u"}, "photographer": "p"}]})[0]["author"] == "p"
    assert parsed(spark, "pixabay", {"hits": [{"largeImageURL": "u", "imageWidth": 7}]})[0]["width"] == 7
    assert parsed(spark, "unsplash", {"results": [{"urls": {"full": "u"}, "user": {"name": "n"}}]})[0]["author"] == "n"
    assert parsed(spark, "nowhere", {"results": [{"image": "u"}]})[0]["source"] == "duckduckgo"


def test_pages_and_fallback(spark):
    html = '<img src="https://cdn.example/a.jpg" width="200" height="150"><IMG src="https://cdn.example/a.jpg"><img src="data:x"><img src="https://x/b.png" width=20><a href="/q">'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id bigint, html string")
    assert [tuple(r) for r in payloads.page_images(df, "id", "html").collect()] == [(1, 0, "https://cdn.example/a.jpg", 200, 150)]
    assert [r["url"] for r in payloads.page_links(df, "id", "html").collect()] == ["/q"]
    assert payloads.primary_or_fallback(df.limit(0), df).count() == 3
    assert payloads.primary_or_fallback(df.limit(1), df).count() == 1


def test_files(spark, tmp_path):
    for name in ("b.MP4", "a.mkv", "note.txt", "sub/c.mov"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    assert [os.path.basename(r["path"]) for r in files.find_media(spark, str(tmp_path)).collect()] == ["a.mkv", "b.MP4", "c.mov"]
    assert files.find_media(spark, str(tmp_path), recursive=False).count() == 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j/1.json").write_text('{"a": 1}')
    (tmp_path / "j/2.json").write_text("[1")
    assert sorted((r["a"] is None, r["a"]) for r in files.read_objects(spark, str(tmp_path / "j"), "a int").collect()) == [(False, 1), (True, None)]
    blobs = spark.createDataFrame([("x.jpg", bytearray(b"12")), (None, bytearray(b"1"))], "n string, c binary")
    assert files.write_blobs(blobs, "n", "c", str(tmp_path / "out")).head()["size"] == 2
    assert (tmp_path / "out/x.jpg").read_bytes() == b"12"
    rows = spark.createDataFrame([("u", "", "", None)], "url string, license string, author string, page_url string")
    assert files.write_sidecar(rows, str(tmp_path / "tsv")) is False
    assert files.write_sidecar(rows.withColumn("author", F.lit("me")), str(tmp_path / "tsv")) is True
    assert spark.range(1).select(files.signature({"b": 1, "a": 2}, ("b",)).alias("x")).head()["x"] == spark.range(1).select(files.signature({"a": 2}).alias("x")).head()["x"]
    lists = spark.createDataFrame([("[1,2]",), ("x",), (None,)], "j string")
    assert [r["element"] for r in files.read_list(lists, "j", "int").collect()] == [1, 2]


def test_pixel_kernels(spark):
    flat = np.full((80, 120), 96.0)
    assert pixels.sharpness(flat) == 0 and pixels.difference_hash(flat) == 0
    ramp = np.tile(np.arange(9.0), (8, 1))
    assert pixels.difference_hash(ramp) == -1
    assert pixels.resize_area(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    rng = np.random.default_rng(1)
    sharp = rng.integers(0, 255, (64, 64)).astype(float)
    smeared = np.apply_along_axis(lambda r: np.convolve(r, np.ones(15) / 15, "same"), 1, sharp)
    assert pixels.motion_blur(smeared) > pixels.motion_blur(sharp) and pixels.sharpness(sharp) > pixels.sharpness(smeared)
    image = np.zeros((10, 10, 3), np.uint8)
    image[..., 2] = 200
    assert len(pixels.hue_saturation_histogram(image)) == 128
    df = spark.createDataFrame(pd.DataFrame({"p": [image.tobytes(), None, b"1"], "w": [10] * 3, "h": [10] * 3}), "p binary, w int, h int")
    got = [r["m"] for r in df.select(pixels.frame_metrics(F.col("p"), F.col("w"), F.col("h"), metrics=("brightness", "hash")).alias("m")).collect()]
    assert got[0]["brightness"] == pytest.approx(200 * 0.299 / 255) and got[1]["hash"] is None and got[2]["hash"] is None
