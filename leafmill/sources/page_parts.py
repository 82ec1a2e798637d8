"""A sink of page images in two phases: tasks write parts, the commit orders them and names them current.

``save(pages, folder)`` sorts pages (SCHEMA of ``page_images``) by doc and page over all tasks. A task writes one part, a
portable map of its pages, and an index of their places, into a folder that no reader looks at. The commit puts the
parts in order of their first page, whatever order tasks ended in, moves them into the version's folder and
then writes the manifest, a row a part; only then is the old version deleted. A failed job leaves what was there before.
``spark.read.format("leaf_pages")`` reads the folder by its manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from leafmill.sources.page_images import MANIFEST, SCHEMA, Page, store_of


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its file, its index, its first and last page."""

    file: str
    first: tuple[str, int] | None
    last: tuple[str, int] | None
    n: int


class PartWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.draft = options["path"].rstrip("/"), overwrite, f".draft-{uuid.uuid4().hex}"

    def _at(self, *names: str) -> tuple[pafs.FileSystem, str]:
        fs, at = store_of(self.folder)
        return fs, "/".join([at, *names])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        name, first, last, n, index, at = uuid.uuid4().hex, None, None, 0, [], 0
        fs, folder = self._at(self.draft)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}") as f:
            for b in iterator:
                for r in b.to_pylist():
                    key = (r["doc"], r["page_index"])
                    if last is not None and key < last:
                        raise ValueError(f"pages are not in order: {key} after {last}")
                    h, w, c = r["height"], r["width"], r["channels"]
                    img = np.frombuffer(r["pixels"], np.uint8).reshape(h, w, c)
                    head = f"P{6 if c == 3 else 5} {w} {h} 255\n".encode()
                    f.write(head)
                    f.write(np.ascontiguousarray(img[:, :, ::-1] if c == 3 else img).tobytes())
                    index.append(json.dumps(asdict(Page(*key, at + len(head), at + len(head) + h * w * c, h, w, c, r["dpi"]))))
                    at += len(head) + h * w * c
                    first, last, n = first or key, key, n + 1
        with fs.open_output_stream(f"{folder}/{name}.index") as f:
            f.write("\n".join(index).encode())
        return Part(name, first, last, n)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.n), key=lambda m: (m.first, m.last))
        for a, b in zip(parts, parts[1:], strict=False):
            if b.first < a.last:
                self.abort(messages)
                raise ValueError(f"parts overlap: {a.last} and {b.first}")
        fs, folder = self._at()
        old = fs.get_file_info(f"{folder}/{MANIFEST}")
        before = json.loads(fs.open_input_file(f"{folder}/{MANIFEST}").read()) if old.is_file else None
        if before and not self.overwrite:
            self.abort(messages)
            raise ValueError("the folder has pages; overwrite them or choose another")
        version = f"v-{uuid.uuid4().hex}"
        fs.create_dir(f"{folder}/{version}", recursive=True)
        rows = []
        for k, m in enumerate(parts):
            to = f"{version}/{k:06d}.pnm"
            fs.move(f"{folder}/{self.draft}/{m.file}", f"{folder}/{to}")
            fs.move(f"{folder}/{self.draft}/{m.file}.index", f"{folder}/{to}.index")
            rows.append({"file": to, "index": f"{to}.index", "first": m.first, "last": m.last, "n": m.n})
        with fs.open_output_stream(f"{folder}/{MANIFEST}.new") as f:
            f.write(json.dumps({"version": version, "parts": rows}).encode())
        if old.is_file and not isinstance(fs, pafs.LocalFileSystem):  # others do not move onto a file
            fs.delete_file(f"{folder}/{MANIFEST}")
        fs.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")
        self.abort(messages)
        if before:
            fs.delete_dir(f"{folder}/{before['version']}")

    def abort(self, messages: list[Part | None]) -> None:
        fs, folder = self._at(self.draft)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class PartSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leaf_parts"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options, overwrite)


def save(pages: DataFrame, folder: str, *, overwrite: bool = True) -> None:
    """``pages`` in order of doc and page as parts below ``folder``."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    pages.sparkSession.dataSource.register(PartSink)
    ordered = pages.select(*names).repartitionByRange("doc", "page_index").sortWithinPartitions("doc", "page_index")
    ordered.write.format("leaf_parts").option("path", folder).mode("overwrite" if overwrite else "append").save()
