"""Planned page scans and the two-phase sink."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.sources import page_images, page_parts


def image(k, h=20, w=30, c=1):
    return np.random.default_rng(k).integers(0, 256, (h, w, c), dtype=np.uint8)


def write(path, pages):
    with open(path, "wb") as f:
        for p in pages:
            f.write(f"P{6 if p.shape[2] == 3 else 5}\n# a note\n{p.shape[1]} {p.shape[0]}\n255\n".encode() + p.tobytes())


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write(d / "big.pgm", [image(k) for k in range(40)])
    write(d / "c.ppm", [image(100, c=3), image(101, 7, 5, 3)])
    for k in range(5):
        write(d / f"small{k}.pgm", [image(200 + k, 4, 4)])
    return d


def reader(folder, **options):
    return page_images.PageReader({"path": str(folder), "splitBytes": "6300", **options})


def test_large_files_are_cut_and_small_ones_share(folder):
    r = reader(folder)
    splits = r.partitions()
    big = [s for s in splits if s.pages]
    assert [len(s.pages) for s in big] == [10] * 4 and sum(len(s.files) for s in splits) == 6 and len(splits) - len(big) <= 2
    rows = [x for s in splits for x in r.read(s)]
    assert len(rows) == 47 and {x[0].rsplit("/", 1)[1]: x[3] for x in rows}["c.ppm"] == 5


@pytest.mark.parametrize(("spec", "pages", "splits"), [("23", [23], 1), ("3-4,39", [3, 4, 39], 1), ("5-16", list(range(5, 17)), 2), ("99", [], 0)])
def test_some_pages_read_their_range(folder, spec, pages, splits):
    big = str(folder / "big.pgm")
    r = reader(folder, pages=spec, docs=f'["{big}"]')
    found = r.partitions()
    assert [p.page_index for s in found for _, p in s.pages] == pages and len(found) == splits and not any(s.files for s in found)
    rows = [x for s in found for x in r.read(s)]
    assert [(x[0], x[1]) for x in rows] == [(big, k) for k in pages] and all(x[6] == image(x[1]).tobytes() for x in rows)


def test_scans_of_parts(spark, folder):
    big = str(folder / "big.pgm")
    parts = lambda df: df.select(F.spark_partition_id()).distinct().count()
    d, one = page_images.scan(spark, str(folder), split_bytes=6300), page_images.scan(spark, str(folder), pages="23", docs=[big], split_bytes=6300)
    assert (parts(d), parts(one)) == (5, 1) and [bytes(r["pixels"]) for r in one.collect()] == [image(23).tobytes()]
    assert sorted(r["page_index"] for r in d.where("page_index > 37 OR page_index = 1").collect()) == [1, 1, 38, 39]
    assert sorted(r["page_index"] for r in page_images.scan(spark, str(folder), pages="39,1").collect()) == [1, 1, 39]


def test_unread_files_are_named(spark, folder):
    (folder / "a.tif").write_bytes(b"II*\x00....")
    (folder / "b.pgm").write_bytes(b"P5 9 9 255\nshort")
    got = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in page_images.unread(spark.read.format("binaryFile").load(str(folder))).collect()}
    assert set(got) == {"a.tif", "b.pgm"} and got["a.tif"] == "no format that is read"


def pages(spark, n, seed):
    rows = [(f"d{k % 3}", k // 3, 6, 5, c := 1 + 2 * (k % 2), 300.0 if k % 4 else None, image(seed + k, 6, 5, c).tobytes()) for k in range(n)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, page_images.SCHEMA).repartition(5)


def stored(spark, out):
    spark.dataSource.register(page_images.PageSource)
    return [tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in spark.read.format("leaf_pages").option("path", out).load().collect()]


def test_parts_are_in_order_and_read_back(spark, tmp_path):
    out, d = f"{tmp_path}/out", pages(spark, 60, 1)
    page_parts.save(d, out)
    want = sorted((tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for r in d.collect()), key=lambda r: r[:2])
    assert stored(spark, out) == want
    page_parts.save(pages(spark, 9, 7), out)
    assert len(stored(spark, out)) == 9 and sorted(x.split("-")[0] for x in os.listdir(out)) == ["_pages.json", "v"]
    with pytest.raises(Exception, match="overwrite them"):
        page_parts.save(d, out, overwrite=False)
    assert len(stored(spark, out)) == 9


def test_a_failed_write_leaves_the_old_pages(spark, tmp_path):
    out = f"{tmp_path}/out"
    page_parts.save(pages(spark, 12, 3), out)
    before = stored(spark, out)
    broken = pages(spark, 30, 4).withColumn("pixels", F.when(F.col("page_index") == 7, F.lit(b"short")).otherwise(F.col("pixels")))
    with pytest.raises(Exception, match="reshape"):
        page_parts.save(broken, out)
    assert stored(spark, out) == before and sorted(x.split("-")[0] for x in os.listdir(out)) == ["_pages.json", "v"]
    unsorted = pages(spark, 30, 4).repartition(3)
    with pytest.raises(Exception, match="order|overlap"):
        unsorted.select(*[c.split()[0] for c in page_images.SCHEMA.split(", ")]).write.format("leaf_parts").option("path", out).mode("overwrite").save()
    assert stored(spark, out) == before
