"""Shared helpers of the training-data operators: word tokens, stable hashes, lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
WORD = re.compile(r"\w+")

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased ``\\w+`` tokens of the whole text; null is empty."""
    return WORD.findall(text.lower()) if text else []


class _WordHash(dict):
    """word -> 64-bit hash, at most ``bound`` words per Python worker."""

    bound = 1 << 17

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _WordHash()


def word_hashes(tokens: list[str]) -> np.ndarray:
    """uint64 hash per token, the same in every process."""
    return np.fromiter(map(_HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rolling (Karp-Rabin) hash of each run of ``size`` tokens, polynomial modulo 2**64."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(0x100000001B3)
    for k in range(size):
        out = out * base + hashes[k : k + n]
    return mix(out)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset (tests) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_dir()}"


@lru_cache(maxsize=1)
def _own_dir() -> str:
    """A folder of this process, which goes when it ends."""
    own = tempfile.mkdtemp(prefix="leafmill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def materialise(df: DataFrame, name: str, *, rows: int = BATCH_ROWS) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    A lost executor then costs tasks, not the stages before; the table has statistics and columns
    that later joins can use. A batch to a Python worker has at most ``rows`` rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(BATCH_CONF, str(BATCH_ROWS))
    # Rows of whole texts: smaller batches hold the memory of workers and of the buffers to them.
    spark.conf.set(BATCH_CONF, str(min(rows, int(held)) if int(held) > 0 else rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, held)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes the folders of spent ``materialise`` tables; nothing lazy may still read them."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/leafmill/" in folder:
                jvm = df.sparkSession._jvm
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
