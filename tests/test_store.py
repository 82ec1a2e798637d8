"""The store's commits: several writers, versions, change feed, rebuilding of changed books only."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import features, rebuild, store
from leafmill.operators.commits import SNAPSHOT_EVERY, CommitLog, Snapshot
from leafmill.sources import page_images
from leafmill.sources.files import Files

PAGE = "doc_id string, page_index int, params_json string, review_status string, flags array<string>, updated_at double"
DECISION = "doc_id string, page_index int, field string, new_value string, created_at double"


@pytest.fixture
def s(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/a b")


def pages(spark, rows):
    return spark.createDataFrame([(d, i, "{}", st, [], t) for d, i, st, t in rows], PAGE)


def held(s, **options):
    return sorted((r["doc_id"], r["page_index"], r["review_status"], r["updated_at"]) for r in s.read("pages", **options).collect())


def test_two_writers_lose_nothing(spark, s):
    """Both change pages of one book, and both append decisions, at the same time."""
    failed = []

    def work(k):
        try:
            own = store.Store(spark, s.root)
            for n in range(3):
                own.merge("pages", pages(spark, [("book", 10 * k + n, "auto", 1.0), (f"own{k}", n, "auto", 1.0)]), "updated_at")
                own.append("decisions", spark.createDataFrame([("book", k, "approve", str(n), float(n))], DECISION))
        except Exception as e:  # shown by the main thread
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert held(s) == sorted([("book", 10 * k + n, "auto", 1.0) for k in range(3) for n in range(3)] + [(f"own{k}", n, "auto", 1.0) for k in range(3) for n in range(3)])
    log = s.read("decisions").collect()
    assert sorted((r["page_index"], r["new_value"]) for r in log) == sorted((k, str(n)) for k in range(3) for n in range(3)) and len({r["id"] for r in log}) == 9


def test_log_decides_between_writers(spark, tmp_path):
    log = CommitLog(Files(spark), f"{tmp_path}/log")
    empty = log.snapshot()
    assert empty == Snapshot() and log.commit(empty, {"a": 1}, [], {1}) == 0
    assert log.commit(empty, {"b": 1}, [], {1}) is None and log.commit(empty, {"b": 2}, [], {2}) == 1 and log.commit(empty, {"c": 1}, [], set()) == 2
    now = log.snapshot()
    assert now.live == {"a": 1, "b": 2, "c": 1} and log.commit(now, {"d": 1}, ["a"], {1}) == 3
    assert log.commit(now, {"e": 1}, ["a", "c"], {1}) is None and log.commit(now, {"e": 2}, ["b"], {2}) == 4
    assert log.snapshot().live == {"c": 1, "d": 1, "e": 2} and log.snapshot(1).live == {"a": 1, "b": 2} and log.touched(2, 3) == {1} and log.touched(3, 4) == {2}
    for k in range(5, 2 * SNAPSHOT_EVERY + 3):
        assert log.commit(log.snapshot(), {f"n{k}": k % 3}, [f"n{k - 1}"] if k > 5 else [], {0}) == k
    assert sum(n.endswith(".whole") for n in log.files.names(log.folder)) == 2
    assert log.snapshot().live == {"c": 1, "d": 1, "e": 2, f"n{2 * SNAPSHOT_EVERY + 2}": (2 * SNAPSHOT_EVERY + 2) % 3}
    assert log.snapshot(SNAPSHOT_EVERY).live == {"c": 1, "d": 1, "e": 2, f"n{SNAPSHOT_EVERY}": SNAPSHOT_EVERY % 3}


def test_put_new_makes_a_file_once(spark, tmp_path):
    files, made = Files(spark), []
    threads = [threading.Thread(target=lambda k=k: made.append((k, files.put_new(f"{tmp_path}/x/one", str(k))))) for k in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = [k for k, ok in made if ok]
    assert len(winner) == 1 and files.read(f"{tmp_path}/x/one") == str(winner[0]) and files.names(f"{tmp_path}/x") == ["one"]
    assert files.read(f"{tmp_path}/none") is None and files.names(f"{tmp_path}/none") == []


def test_files_through_the_jvm(spark, tmp_path, monkeypatch):
    """The way of stores that are not local, on a local folder."""
    monkeypatch.setattr(Files, "local", staticmethod(lambda _: None))
    files, root = Files(spark), f"file://{tmp_path}/j v"
    assert files.names(root) == [] and files.read(f"{root}/log/1") is None and files.parts(root) == []
    assert files.put_new(f"{root}/log/1", "é one") and not files.put_new(f"{root}/log/1", "two") and files.put_new(f"{root}/a/_x", "")
    assert files.read(f"{root}/log/1") == "é one" and files.names(f"{root}/log") == ["1"] and files.parts(root) == ["log/1"]
    files.delete(f"{root}/log")
    assert files.names(root) == ["a"]
    s = store.Store(spark, f"{root}/store")
    s.merge("pages", pages(spark, [("d", 0, "auto", 1.0)]), "updated_at")
    s.merge("pages", pages(spark, [("d", 0, "approved", 2.0), ("e", 1, "auto", 1.0)]), "updated_at")
    assert held(s) == [("d", 0, "approved", 2.0), ("e", 1, "auto", 1.0)] and s.version("pages") == 1


def test_appends_add_their_rows_only(spark, s):
    for k in range(3):
        before = set(s.log("decisions").snapshot().live)
        s.append("decisions", spark.createDataFrame([(f"d{j}", k, "f", "v", 1.0) for j in range(4)], DECISION))
        after = set(s.log("decisions").snapshot().live)
        assert before < after and 1 <= len(after - before) <= 4
    assert s.read("decisions").count() == 12 and len(s.read("decisions", only=["d1"]).inputFiles()) < len(s.read("decisions").inputFiles())


def test_versions_and_changes(spark, s):
    assert s.version("pages") == -1 and held(s) == []
    s.create()
    assert s.version("pages") == 0
    s.merge("pages", pages(spark, [(f"d{k}", i, "auto", 1.0) for k in range(6) for i in range(3)]), "updated_at")
    one = s.version("pages")
    s.merge("pages", pages(spark, [("d2", 1, "approved", 2.0), ("d2", 0, "old", 0.5), ("d9", 0, "auto", 1.0)]), "updated_at")
    s.merge("pages", pages(spark, []), "updated_at")
    assert s.version("pages") == one + 1 and len(held(s)) == 19 and len(held(s, version=one)) == 18 and held(s, only=["d2"])[1] == ("d2", 1, "approved", 2.0)
    got = sorted((r["doc_id"], r["page_index"], r["review_status"], r["change"]) for r in s.changes("pages", one).collect())
    assert got == [("d2", 1, "approved", "added"), ("d2", 1, "auto", "removed"), ("d9", 0, "auto", "added")]
    assert s.changes("pages", one + 1).count() == 0 and s.changes("pages", -1).count() == 19
    files = len(s.files.parts(f"{s.root}/pages/data"))
    assert s.vacuum("pages", keep=2, older_s=-1) == 0 and s.vacuum("pages", keep=1, older_s=-1) > 0
    assert len(s.files.parts(f"{s.root}/pages/data")) < files and len(held(s)) == 19


def test_folded_stores_go(spark, s, tmp_path):
    workers = [store.Store(spark, f"file://{tmp_path}/w{k}") for k in range(2)]
    for k, w in enumerate(workers):
        w.merge("pages", pages(spark, [("d", 0, f"w{k}", float(k)), (f"only{k}", 0, "auto", 1.0)]), "updated_at")
        w.append("decisions", spark.createDataFrame([("d", k, "f", "v", 1.0)], DECISION))
    s.fold(workers)
    s.fold(workers, delete=True)
    assert held(s) == [("d", 0, "w1", 1.0), ("only0", 0, "auto", 1.0), ("only1", 0, "auto", 1.0)] and s.read("decisions").count() == 2
    assert not (tmp_path / "w0").exists() and not (tmp_path / "w1").exists()


def nested(spark, edits=()):
    """Nested pages of eight books whose content boxes vary; ``edits`` replaces boxes."""
    rows = []
    for k in range(8):
        for i in range(9):
            box = dict(edits).get((k, i), (80.0 + i % 3, 90.0, 900.0 + 5 * (i % 4) + k, 1200.0 + i))
            rows.append((f"b{k}", i, (None, i, None, 1.0), 300.0, (0.0, 3.0), (box, 0.9, (480.0, 1300.0, 520.0, 1320.0) if i % 2 else None, None, 1000.0, 1400.0, None, None), [("text", box, "x", "t", 0.9, None, None)], "auto", [], "approved" if i == 4 else "auto", "auto", None, None, False))
    return spark.createDataFrame(rows, features.PAGE_SCHEMA)


def test_rebuild_equals_a_full_one_and_reads_changed_books(spark, s):
    first = store.encoded(rebuild.with_margins(nested(spark))).withColumn("updated_at", F.lit(1.0))
    s.merge("pages", first, "updated_at")
    one = s.version("pages")
    edits = {(2, 3): (10.0, 20.0, 990.0, 1390.0), (2, 5): (300.0, 300.0, 400.0, 500.0), (5, 0): (70.0, 80.0, 930.0, 1210.0)}
    # Edits leave the crops as they were: those are stale until the rebuild.
    new = store.decoded(first).where("doc_id IN ('b2', 'b5')").alias("a").join(nested(spark, edits.items()).select("doc_id", "page_index", F.col("margin").alias("m"), F.col("regions").alias("r")), ["doc_id", "page_index"])
    new = new.withColumn("margin", F.col("margin").withField("content", F.col("m.content"))).withColumn("regions", F.col("r")).drop("m", "r")
    changed = [F.col("page_index").isin(3, 5) & (F.col("doc_id") == "b2") | (F.col("page_index") == 0) & (F.col("doc_id") == "b5")]
    s.merge("pages", store.encoded(new.where(changed[0])).withColumn("updated_at", F.lit(2.0)), "updated_at")
    rows, version = rebuild.rebuilt(s, since=one, at=3.0)
    assert {r["doc_id"] for r in rows.select("doc_id").distinct().collect()} <= {"b2", "b5"} and rows.count() > 2
    read = {f.split("/data/")[1] for f in rows.inputFiles()}
    assert read and read <= set(s.log("pages").snapshot().files(s._buckets("pages", spark.createDataFrame([("b2",), ("b5",)], "doc_id string")))) | set(s.log("pages").snapshot(one).live)
    assert len(read & set(s.log("pages").snapshot().live)) < len(s.log("pages").snapshot().live)
    assert rebuild.rebuild(s, since=one, at=3.0) == version == one + 1
    want = rebuild.with_margins(nested(spark, edits.items()))
    plain = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert plain(store.decoded(s.read("pages"))) == plain(want)
    again = s.version("pages")
    rebuild.rebuild(s, since=version, at=4.0)
    assert s.version("pages") == again


def test_a_run_persists_pages_and_features(spark, s):
    """Images of two books run into the store by two writers at a time, then one book again."""
    words = np.full((300, 200), 255, np.uint8)
    for y in range(40, 260, 20):
        words[y : y + 8, 30:170] = 20
    rows = [(b, i, 300, 200, 1, 300.0, words.tobytes()) for b in ("a", "b") for i in range(4)]
    images = spark.createDataFrame(rows, page_images.SCHEMA)
    regions = spark.createDataFrame([("a", i, "text", "line", "words", 0.9, None, 30.0, 40.0 + 20 * k, 170.0, 48.0 + 20 * k) for i in range(4) for k in range(3)], "doc string, page_index int, kind string, source string, ocr_text string, ocr_conf double, layout_label string, x0 double, y0 double, x1 double, y1 double")
    failed = []

    def work(book):
        try:
            rebuild.run(store.Store(spark, s.root), images.where(F.col("doc") == book), regions, at=1.0)
        except Exception as e:  # shown by the main thread
            failed.append(e)

    threads = [threading.Thread(target=work, args=(b,)) for b in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and [(r["doc_id"], r["page_index"]) for r in s.pages().collect()] == [(b, i) for b in ("a", "b") for i in range(4)]
    got = store.decoded(s.read("pages")).where("page_index = 1").orderBy("doc_id").collect()
    assert [len(r["regions"]) for r in got] == [3, 0] and got[0]["margin"]["content"]["x0"] == 30.0 and got[0]["margin"]["crop"] is not None and got[0]["margin"]["target_w"] > 140
    assert s.features("a").count() == 4 and s.read("region_feature").count() == 12 and s.features("a").first()["region_count"] == 3
    rebuild.run(s, images.where("doc = 'a' AND page_index < 2"), regions, at=2.0)
    assert s.features("a").count() == 2 and s.features("b").count() == 4 and s.pages("a").count() == 4
