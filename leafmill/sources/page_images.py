"""A Spark data source of page images: PNG and portable gray or colour maps, one row a page.

``spark.read.format("leaf_pages").option("path", folder_or_glob).option("pages", "0-4,9").load()`` reads them. A
portable map may hold several images, which are its pages. The scan is planned: small files share a task, a file over
SPLIT_BYTES is cut by the headers of its pages into ranges of whole pages, and the options ``pages`` and ``docs`` leave out
files and ranges before anything is read. A page is read by its place in the file, through Arrow's file systems, so
paths may be URIs of any of those; a folder that ``page_parts`` has written is read by its manifest.

``decoded`` does the same to binary files that Spark has read from any store; ``unread`` names those that give no page.
"""

from __future__ import annotations

import glob
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.operators.sequence import page_numbers

SCHEMA = "doc string, page_index int, height int, width int, channels int, dpi double, pixels binary"
EXTENSIONS = (".png", ".pgm", ".ppm", ".pnm")
OCR_DPI, OCR_SIDE = 300.0, 3000.0


def expanded(paths: list[str]) -> list[str]:
    """Files of folders and globs, sorted in each, every file once in the order of the arguments."""
    out: dict[str, str] = {}
    for p in paths:
        if os.path.isdir(p):
            found = sorted(f for f in glob.glob(os.path.join(p, "*")) if f.lower().endswith(EXTENSIONS))
        else:
            found = sorted(glob.glob(p)) if any(c in p for c in "*?[") else [p]
        for f in found:
            out.setdefault(os.path.abspath(f), f)
    return list(out.values())


def output_path(out: str, source: str, suffix: str = ".pdf") -> str:
    """``out`` itself, or the source's name in it if it is a folder: it exists as one, ends in a slash or has no extension."""
    folder = os.path.isdir(out) or out.endswith(("/", "\\")) or os.path.splitext(out)[1] == ""
    return os.path.join(out, os.path.splitext(os.path.basename(source))[0] + suffix) if folder else out


def png(data: bytes) -> tuple[np.ndarray, float | None]:
    """(image, dots an inch) of an 8-bit gray, colour or palette PNG without interlacing; alpha is left out."""
    at, body, palette, dpi = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or lace:
                raise ValueError("only 8-bit images without interlacing")
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"pHYs" and chunk[8] == 1:
            dpi = round(struct.unpack(">I", chunk[:4])[0] * 0.0254, 3)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * n + 1)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind in (1, 3, 4):
            for x in range(w * n):
                left = int(line[x - n]) if x >= n else 0
                up, corner = int(above[x]), int(above[x - n]) if x >= n else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = (int(line[x]) + guess) & 255
        out[y], above = line, line
    img = out.reshape(h, w, n)
    if colour == 3:
        img = palette[img[:, :, 0]]
    img = img[:, :, : 1 if colour in (0, 4) else 3]
    return (img[:, :, ::-1] if img.shape[2] == 3 else img), dpi


HEADER = re.compile(rb"\s*P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def portable_maps(data: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, stop, height, width, channels) of each image of a binary portable map."""
    at = 0
    while m := HEADER.match(data, at):
        n, w, h, top = 3 if m[1] == b"6" else 1, int(m[2]), int(m[3]), int(m[4])
        if top > 255:
            raise ValueError("only 8-bit images")
        yield m.end(), m.end() + h * w * n, h, w, n
        at = m.end() + h * w * n


def images(name: str, data: bytes, ranges: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, np.ndarray, float | None]]:
    """(page_index, image in blue, green, red, dots an inch) of the selected pages of a file's content."""
    wanted = lambda k: ranges is None or any(a <= k <= z for a, z in ranges)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        if wanted(0):
            yield 0, *png(data)
        return
    for k, (a, z, h, w, n) in enumerate(portable_maps(data)):
        if wanted(k):
            img = np.frombuffer(data[a:z], np.uint8).reshape(h, w, n)
            yield k, (img[:, :, ::-1] if n == 3 else img), None


def _row(doc: str, k: int, img: np.ndarray, dpi: float | None) -> tuple:
    return doc, k, img.shape[0], img.shape[1], img.shape[2], dpi, np.ascontiguousarray(img).tobytes()


#: Bytes of a task's pages, about; bytes that are read to find a header.
SPLIT_BYTES, HEADER_BYTES = 64 << 20, 512
MANIFEST = "_pages.json"


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(paths: list[str]) -> list[str]:
    """``expanded`` for local paths; of a URI the file, or the files of a folder."""
    out = []
    for p in paths:
        if "://" not in p:
            out += expanded([p])
            continue
        fs, at = store_of(p)
        if fs.get_file_info(at).type != pafs.FileType.Directory:
            out.append(p)
        else:
            out += sorted(f"{p.rstrip('/')}/{f.base_name}" for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.lower().endswith(EXTENSIONS))
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Page:
    """A page's place in a file: pixels from ``start`` to ``stop``; a PNG is the whole file."""

    doc: str
    page_index: int
    start: int
    stop: int
    height: int = 0
    width: int = 0
    channels: int = 0
    dpi: float | None = None


def places(f, size: int, doc: str) -> Iterator[Page]:
    """The pages of an open file by their headers alone."""
    if f.read(8) == b"\x89PNG\r\n\x1a\n":
        yield Page(doc, 0, 0, size)
        return
    at, k = 0, 0
    while at < size:
        m, n = None, HEADER_BYTES
        while m is None and n < 1 << 20:
            f.seek(at)
            head = f.read(n)
            m, n = HEADER.match(head), (n * 8 if len(head) == n else 1 << 20)
        if m is None:
            return
        c, w, h = 3 if m[1] == b"6" else 1, int(m[2]), int(m[3])
        if int(m[4]) > 255:
            raise ValueError("only 8-bit images")
        yield Page(doc, k, at + m.end(), at + m.end() + h * w * c, h, w, c)
        at, k = at + m.end() + h * w * c, k + 1


def read_page(f, p: Page) -> tuple:
    f.seek(p.start)
    data = f.read(p.stop - p.start)
    if not p.channels:
        return _row(p.doc, p.page_index, *png(data))
    img = np.frombuffer(data, np.uint8).reshape(p.height, p.width, p.channels)
    return _row(p.doc, p.page_index, img[:, :, ::-1] if p.channels == 3 else img, p.dpi)


@dataclass
class Wanted:
    """The pages and docs that a scan asks for; null is all."""

    ranges: list[tuple[int, int]] | None = None
    docs: set[str] | None = None

    def doc(self, doc: str) -> bool:
        return self.docs is None or doc in self.docs

    def page(self, k: int) -> bool:
        return self.ranges is None or any(a <= k <= z for a, z in self.ranges)


@dataclass
class Split(InputPartition):
    """Whole small files, or ranges of pages of large ones by their places."""

    files: list[tuple[str, str, int]] = field(default_factory=list)
    pages: list[tuple[str, Page]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.split = options["path"].split(";"), int(options.get("splitBytes", SPLIT_BYTES))
        docs = options.get("docs")
        self.wanted = Wanted(page_numbers(options.get("pages")), None if docs is None else set(json.loads(docs)))

    def partitions(self) -> list[InputPartition]:
        out, room = [], 0
        manifests = [p for p in self.paths if store_of(p)[0].get_file_info(f"{store_of(p)[1].rstrip('/')}/{MANIFEST}").is_file]
        for path in listed([p for p in self.paths if p not in manifests]):
            fs, at = store_of(path)
            size = fs.get_file_info(at).size
            if not self.wanted.doc(path):
                continue
            if size <= self.split:
                if size > room:
                    out.append(Split())
                    room = self.split
                out[-1].files.append((path, path, size))
                room -= size
                continue
            with fs.open_input_file(at) as f:
                out += self._cut((path, p) for p in places(f, size, path))
            room = 0
        for folder in manifests:
            out += self._of_manifest(folder)
        return out

    def _cut(self, pages: Iterable[tuple[str, Page]]) -> list[Split]:
        """Splits of neighbouring wanted pages."""
        out, held = [], self.split + 1
        for path, p in pages:
            if self.wanted.page(p.page_index) and self.wanted.doc(p.doc):
                if held + p.stop - p.start > self.split:
                    out.append(Split())
                    held = 0
                out[-1].pages.append((path, p))
                held += p.stop - p.start
        return out

    def _of_manifest(self, folder: str) -> list[Split]:
        fs, at = store_of(folder)
        with fs.open_input_file(f"{at.rstrip('/')}/{MANIFEST}") as f:
            parts = json.loads(f.read())["parts"]
        out = []
        for part in parts:
            if self.wanted.docs is not None and not any(part["first"][0] <= d <= part["last"][0] for d in self.wanted.docs):
                continue
            with fs.open_input_file(f"{at.rstrip('/')}/{part['index']}") as f:
                index = [Page(**json.loads(x)) for x in f.read().decode().splitlines()]
            out += self._cut((f"{folder.rstrip('/')}/{part['file']}", p) for p in index)
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        for path, doc, size in partition.files:
            fs, at = store_of(path)
            with fs.open_input_file(at) as f:
                found = [p for p in places(f, size, doc) if self.wanted.page(p.page_index)]
                for p in found:
                    yield read_page(f, p)
        now, f = None, None
        for path, p in partition.pages:
            if path != now:
                fs, at = store_of(path)
                now, f = path, fs.open_input_file(at)
            yield read_page(f, p)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leaf_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def scan(spark: SparkSession, path: str, *, pages: str | None = None, docs: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pages (SCHEMA) of files, folders or globs, separated by semicolons; only some ``pages`` and ``docs`` if they are named.

    What is wanted is given here and not by filters: Spark 4.1 keeps the filters that a Python source has
    taken over for every later use of the same DataFrame.
    """
    spark.dataSource.register(PageSource)
    options = {"path": path, "splitBytes": str(split_bytes)} | ({} if pages is None else {"pages": pages}) | ({} if docs is None else {"docs": json.dumps(docs)})
    return spark.read.format("leaf_pages").options(**options).load()


def decoded(files: DataFrame, spec: str | None = None) -> DataFrame:
    """Pages (SCHEMA) of ``spark.read.format("binaryFile")`` rows (path, content); files of another kind give no row."""
    ranges = page_numbers(spec)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, data = b.column("path")[i].as_py(), b.column("content")[i].as_py()
                for k, img, dpi in images(path, data, ranges):
                    doc, k, h, w, c, dpi, px = _row(path, k, img, dpi)
                    yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([k], pa.int32()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([c], pa.int32()), pa.array([dpi], pa.float64()), pa.array([px], pa.binary())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(read, SCHEMA)


def unread(files: DataFrame) -> DataFrame:
    """path, reason of ``binaryFile`` rows that give no page: another format, or a broken file."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    if next(images(path, data or b""), None) is None:
                        out.append((path, "no format that is read"))
                except Exception as e:  # any broken file is a row, none ends the job
                    out.append((path, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in out], pa.string()), "reason": pa.array([x[1] for x in out], pa.string())})

    return files.select("path", "content").mapInArrow(check, "path string, reason string")


def ocr_scale(dpi, height, width):
    """How far a page shrinks for recognition: to OCR_DPI if finer, else to a side of OCR_SIDE if longer, else not."""
    longest = F.greatest(height, width)
    scale = F.when(dpi > OCR_DPI, OCR_DPI / dpi).when(longest > OCR_SIDE, OCR_SIDE / longest).otherwise(1.0)
    return F.when(scale >= 0.999, 1.0).otherwise(scale)
