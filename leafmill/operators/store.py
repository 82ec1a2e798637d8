"""Keyed storage on DataFrames and Parquet tables: upsert, append-only log, queue, replace by key, fold."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.commits import CommitLog, Snapshot
from leafmill.operators.features import PAGE_SCHEMA
from leafmill.sources.files import Files

#: Buckets of a table's partition column, and how often a write starts again.
BUCKETS, MOST_TRIES = 64, 50


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: what upserts of the log leave."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``base`` with the last change of each key in place of its row."""
    new = latest(changes, keys, order)
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*base.columns))


def replace_keys(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``base`` under the keys in ``rows`` go; ``rows`` come in their place."""
    return base.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*base.columns))


def fold(target: DataFrame, workers: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """``target`` after the tables of all workers were upserted into it; the last row of a key by ``order`` stays."""
    return latest(reduce(DataFrame.unionByName, [target, *workers]), keys, order)


def bucket_key(*dims: str) -> list[Column]:
    """Scope dimensions as key columns: an absent one is the empty string, so the key has no null."""
    return [F.coalesce(F.col(d), F.lit("")).alias(d) for d in dims]


BUCKET_DIMS = ("scanner", "fmt", "genre", "writing", "binding")


def bucket_lookup(asked: DataFrame, buckets: DataFrame) -> DataFrame:
    """``asked`` scopes and parameter names with median, mad and n of exactly their bucket; null if there is none."""
    held = buckets.select(*bucket_key(*BUCKET_DIMS), "param_name", "median", "mad", "n")
    return asked.select(*bucket_key(*BUCKET_DIMS), "param_name").join(held, [*BUCKET_DIMS, "param_name"], "left")


@dataclass(frozen=True)
class Table:
    """Columns, key and the column by which rows of a table of the store are dealt to buckets."""

    schema: str
    keys: tuple[str, ...]
    partition: str


TABLES = {
    "pages": Table("doc_id string, page_index int, params_json string, review_status string, flags array<string>, updated_at double", ("doc_id", "page_index"), "doc_id"),
    "decisions": Table("id string, doc_id string, page_index int, decided_by string, field string, old_value string, new_value string, features string, created_at double", ("id",), "doc_id"),
    "book": Table("book_id string, title string, scanner string, fmt string, genre string, writing string, binding string, confidence double, resolved_at double", ("book_id",), "book_id"),
    "scan_profile": Table("book_id string, scanner_sig string, front_end int, body_end int, page_count int, ocr_pages int, profile_json string, created_at double", ("book_id",), "book_id"),
    "page_feature": Table("book_id string, page_index int, is_ocr boolean, region_count int, deskew_angle double, deskew_conf double, content_w double, content_h double, nombre_value int, nombre_cx double, nombre_cy double, blank boolean", ("book_id",), "book_id"),
    "region_feature": Table("book_id string, page_index int, cls string, x0 double, y0 double, x1 double, y1 double, conf double, source string", ("book_id",), "book_id"),
    "bucket_profile": Table("scanner string, fmt string, genre string, writing string, binding string, param_name string, median double, mad double, n int, updated_at double", (*BUCKET_DIMS, "param_name"), "param_name"),
}


class Store:
    """Parquet tables under one folder, each with a log of commits; any number of writers and readers at a time.

    Rows are dealt to BUCKETS by a hash of the table's partition column. An append adds files and nothing
    else; the other writes read the files of the buckets that their rows fall in, and put new ones in their place. A
    writer that finds that another has changed one of those buckets meanwhile works out its rows again, so no
    update is lost. Readers see the files of one version. Old files stay for them until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def log(self, name: str) -> CommitLog:
        return CommitLog(self.files, f"{self.root}/{name}/log")

    def version(self, name: str) -> int:
        """The table's version, -1 if it was never written."""
        return self.log(name).snapshot().version

    def create(self) -> None:
        """Gives every table that has none its first, empty version."""
        for name in TABLES:
            if self.version(name) < 0:
                self.log(name).files.put_new(self.log(name)._name(0), '{"add": {}, "remove": [], "reads": [], "at": 0}')

    def _read(self, name: str, files: list[str]) -> DataFrame:
        t = TABLES[name]
        if not files:
            return self.spark.createDataFrame([], t.schema)
        schema = self.spark.createDataFrame([], t.schema)
        return self.spark.read.schema(schema.schema).parquet(*(f"{self.root}/{name}/data/{f}" for f in files)).select(*schema.columns)

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(TABLES[name].partition), F.lit(BUCKETS)).cast("int")

    def _buckets(self, name: str, rows: DataFrame) -> set[int]:
        """The buckets of some rows, BUCKETS at most."""
        return {r[0] for r in rows.select(self.bucket(name)).distinct().collect()}

    def read(self, name: str, *, version: int | None = None, only: list[str] | None = None) -> DataFrame:
        """The table, empty if it was never written; of ``only`` some values of its partition column, from their files."""
        t, buckets = TABLES[name], None
        if only is not None:
            buckets = self._buckets(name, self.spark.createDataFrame([(x,) for x in only], f"{t.partition} string"))
        held = self._read(name, self.log(name).snapshot(version).files(buckets))
        return held if only is None else held.where(F.col(t.partition).isin(*only))

    def _written(self, name: str, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """Rows as files of their own folder, one bucket a file, large buckets in several."""
        folder = uuid.uuid4().hex
        schema = self.spark.createDataFrame([], TABLES[name].schema)
        rows.select(*schema.columns).withColumn("__b", self.bucket(name)).hint("rebalance", "__b").write.partitionBy("__b").parquet(f"{self.root}/{name}/data/{folder}")
        return folder, {f"{folder}/{f}": int(f.split("__b=")[1].split("/")[0]) for f in self.files.parts(f"{self.root}/{name}/data/{folder}")}

    def _rewrite(self, name: str, rows: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """``change`` of what the buckets of ``rows`` hold, in its place; again for as long as others change them first."""
        reads = self._buckets(name, rows)
        for k in range(MOST_TRIES):
            base = self.log(name).snapshot()
            if not reads:
                return base.version
            old = base.files(reads)
            folder, add = self._written(name, change(self._read(name, old)))
            if (done := self.log(name).commit(base, add, old, reads)) is not None:
                return done
            self.files.delete(f"{self.root}/{name}/data/{folder}")
            time.sleep(random.random() * min(2, 0.05 * 2**k))
        raise RuntimeError(f"{name}: other writers came first {MOST_TRIES} times")

    def upsert(self, name: str, rows: DataFrame, order: list[Column]) -> int:
        """The last of ``rows`` of each key replaces the row of that key."""
        return self._rewrite(name, rows, lambda held: upsert(held, rows, list(TABLES[name].keys), order))

    def merge(self, name: str, rows: DataFrame, time_column: str) -> int:
        """Of each key the newest row stays, of equally new ones one of ``rows``; running it again changes nothing."""
        columns = self.spark.createDataFrame([], TABLES[name].schema).columns
        new = rows.select(*columns).withColumn("__new", F.lit(1))
        both = lambda held: held.withColumn("__new", F.lit(0)).unionByName(new)
        return self._rewrite(name, rows, lambda held: latest(both(held), list(TABLES[name].keys), [F.col(time_column).desc_nulls_last(), F.desc("__new")]).drop("__new"))

    def append(self, name: str, rows: DataFrame) -> int:
        """Adds ``rows`` and reads nothing; an ``id`` that is missing is made."""
        held = rows if "id" in rows.columns or "id" not in TABLES[name].schema.split()[0] else rows.withColumn("id", F.expr("uuid()"))
        empty = self.spark.createDataFrame([], TABLES[name].schema)
        base = self.log(name).snapshot()
        return self.log(name).commit(base, self._written(name, empty.unionByName(held, allowMissingColumns=True))[1], [], set())

    def replace(self, name: str, rows: DataFrame) -> int:
        """``rows`` in place of all rows of their keys."""
        return self._rewrite(name, rows, lambda held: replace_keys(held, rows, list(TABLES[name].keys)))

    def fold(self, others: list[Store], *, delete: bool = False) -> None:
        """Every table of ``others`` folded into this store's, bags and logs appended, keyed ones by their last time; then the others go if ``delete``."""
        for name, t in TABLES.items():
            theirs = reduce(DataFrame.unionByName, [o.read(name) for o in others])
            stamp = next((c for c in ("updated_at", "resolved_at", "created_at") if c in t.schema), None)
            if name in ("page_feature", "region_feature"):
                self.replace(name, theirs)
            elif name == "decisions":
                self._rewrite(name, theirs, lambda held, theirs=theirs: held.unionByName(theirs).dropDuplicates(["id"]))
            else:
                self.merge(name, theirs, stamp)
        if delete:
            for o in others:
                o.files.delete(o.root)

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame:
        """Rows that versions after ``since`` added or removed, with ``change``; an update is both. Only files of buckets that were written to are read."""
        log = self.log(name)
        now = log.snapshot(until)
        buckets = log.touched(since, now.version)
        before = log.snapshot(since) if since >= 0 else Snapshot()
        # Files that both versions have are the same rows.
        same = set(before.live) & set(now.live)
        old, new = (self._read(name, [f for f in s.files(buckets) if f not in same]) for s in (before, now))
        return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))

    def vacuum(self, name: str, *, keep: int = 1, older_s: float = 3600.0) -> int:
        """Deletes files that none of the last ``keep`` versions has and that a commit removed more than ``older_s`` ago; their number."""
        log = self.log(name)
        last = log.snapshot().version
        live = set().union(*(log.snapshot(v).live for v in range(max(0, last - keep + 1), last + 1)))
        gone = {f for v in range(last + 1) if (e := log.entry(v))["at"] < time.time() - older_s for f in e["remove"]} - live
        there = gone & set(self.files.parts(f"{self.root}/{name}/data"))
        for f in there:
            self.files.delete(f"{self.root}/{name}/data/{f}")
        return len(there)

    def pages(self, doc_id: str | None = None) -> DataFrame:
        return self.read("pages", only=None if doc_id is None else [doc_id]).orderBy("doc_id", "page_index")

    def page(self, doc_id: str, page_index: int) -> DataFrame:
        return self.read("pages", only=[doc_id]).where(F.col("page_index") == page_index)

    def documents(self) -> DataFrame:
        return self.read("pages").select("doc_id").distinct().orderBy("doc_id")

    def features(self, book_id: str) -> DataFrame:
        return self.read("page_feature", only=[book_id]).orderBy("page_index")

    def training_log(self, field: str | None = None) -> DataFrame:
        """All decisions with their field, or only features and values of one ``field``, oldest first."""
        held = self.read("decisions").orderBy("created_at", "id")
        return held.select("field", "features", "new_value") if field is None else held.where(F.col("field") == field).select("features", "new_value")


def encoded(pages: DataFrame) -> DataFrame:
    """Nested pages (PAGE_SCHEMA) as rows of the table ``pages``: status and flags in columns, the rest as JSON."""
    cols = [c for c in pages.columns if c not in ("review_status", "flags")]
    return pages.select("doc_id", "page_index", F.to_json(F.struct(*cols)).alias("params_json"), "review_status", "flags")


def decoded(rows: DataFrame) -> DataFrame:
    """The inverse of ``encoded``: missing keys become null, unknown keys are left out, broken JSON gives null columns."""
    page = F.from_json("params_json", PAGE_SCHEMA, {"mode": "PERMISSIVE"})
    inner = [c.split(" ")[0].strip() for c in ("dpi", "source", "deskew", "margin", "regions", "page_kind", "decided_by", "nombre_text", "page_number", "blank")]
    return rows.withColumn("__p", page).select("doc_id", "page_index", *(F.col(f"__p.{c}").alias(c) for c in inner), "review_status", "flags")


def quarantined(pages: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose enumeration value is known or null, and the others."""
    known = F.col(column).isNull() | F.col(column).isin(*allowed)
    return pages.where(known), pages.where(~known)
