"""Files of any store that Spark reads, for metadata: the one place that asks the JVM for its file systems."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only on one machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/") if folder else f"file://{_own()}"


@lru_cache(maxsize=1)
def _own() -> str:
    folder = tempfile.mkdtemp(prefix="leafmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Files:
    """Small texts and listings by path. Local paths go without the JVM, as its local files cannot be made only if absent."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @staticmethod
    def local(path: str) -> str | None:
        parts = urlsplit(path)
        return (unquote(parts.path) if parts.scheme else path) if parts.scheme in ("", "file") else None

    def _at(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def names(self, folder: str) -> list[str]:
        """Names in a folder, none if there is no such folder."""
        if (own := self.local(folder)) is not None:
            return sorted(os.listdir(own)) if os.path.isdir(own) else []
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def parts(self, folder: str) -> list[str]:
        """Data files below a folder, relative to it."""
        if (own := self.local(folder)) is not None:
            found = (os.path.relpath(os.path.join(d, f), own) for d, _, names in os.walk(own) for f in names)
            return sorted(f for f in found if not os.path.basename(f).startswith(("_", ".")))
        fs, p = self._at(folder)
        base, found, each = len(fs.makeQualified(p).toString()) + 1, [], fs.listFiles(p, True) if fs.exists(p) else None
        while each is not None and each.hasNext():
            at = each.next().getPath()
            if not at.getName().startswith(("_", ".")):
                found.append(at.toString()[base:])
        return sorted(found)

    def read(self, path: str) -> str | None:
        """A text, null if there is no such file."""
        if (own := self.local(path)) is not None:
            try:
                with open(own, encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """Makes the file with its whole text, or returns false if somebody else has made it."""
        if (own := self.local(path)) is not None:
            os.makedirs(os.path.dirname(own), exist_ok=True)
            draft = f"{os.path.dirname(own)}/.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, own)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(p):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, path: str) -> None:
        """A file or a whole folder, if it is there."""
        if (own := self.local(path)) is not None:
            for d, folders, names in os.walk(own, topdown=False):
                for f in names:
                    os.unlink(os.path.join(d, f))
                for f in folders:
                    os.rmdir(os.path.join(d, f))
            if os.path.isdir(own):
                os.rmdir(own)
            elif os.path.exists(own):
                os.unlink(own)
            return
        fs, p = self._at(path)
        fs.delete(p, True)
