"""Edits as keyed state equal a batch fold of the log, whatever their order of arrival, over a restart."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leafmill.operators import features, rebuild, review, store
from leafmill.streaming import review as stream
from tests.test_store import nested

START = datetime(2024, 5, 1, 9)


def log(n, seed):
    g = random.Random(seed)
    rows = []
    for k in range(n):
        kind = g.choice([None, None, "bw", "color", ""])
        rows.append((f"b{g.randrange(5)}", g.randrange(4), START + timedelta(seconds=5 * k), k, kind, g.random() < 0.3, g.random() < 0.3, g.choice(["ann", "bo"]), g.choice([None, None, None, "content"])))
    return rows


def delivered(spark, rows, source, seed, reach):
    """Rows in files of ten, each row up to ``reach`` places from its own; some twice."""
    g = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda k: k + g.uniform(0, reach))
    order += g.sample(order[-9:], 4)
    for k in range(0, len(order), 10):
        spark.createDataFrame([rows[j] for j in order[k : k + 10]], stream.EDITS).coalesce(1).write.mode("append").parquet(source)


def run(spark, source, out, initial):
    edits = spark.readStream.schema(stream.EDITS).option("maxFilesPerTrigger", 2).parquet(source)
    got = stream.states(edits, late="2 minutes", initial=initial)
    q = got.writeStream.outputMode("update").foreachBatch(lambda b, k: b.withColumn("k", F.lit(k)).write.mode("append").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_equals_batch_fold(spark, tmp_path):
    rows, source, out = log(80, 3), f"{tmp_path}/in", f"{tmp_path}/out"
    initial = spark.createDataFrame([("b0", 0, "gray", "needs_review", "auto"), ("b4", 3, "mrc", "auto", "auto"), ("b9", 1, "auto", "needs_review", "auto")], "doc_id string, page_index int, page_kind string, review_status string, decided_by string")
    delivered(spark, rows[:45], source, 1, 12)
    run(spark, source, out, initial)
    delivered(spark, rows[45:], source, 2, 12)
    last = ("zz", 0, START + timedelta(days=1), 10**6, None, False, False, None, None)
    spark.createDataFrame([last], stream.EDITS).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, initial)
    seen = spark.read.parquet(f"{out}/rows")
    pages = seen.where("NOT due").groupBy("doc_id", "page_index").agg(F.max_by(F.struct("page_kind", "review_status", "decided_by"), F.struct("at", "k")).alias("s"))
    got = {(r["doc_id"], r["page_index"]): tuple(r["s"]) for r in pages.collect()}
    edits = spark.createDataFrame(rows, stream.EDITS)
    all_ = edits.select("doc_id", "page_index").distinct().join(initial, ["doc_id", "page_index"], "left").fillna("auto")
    want = {(r["doc_id"], r["page_index"]): (r["page_kind"], r["review_status"], r["decided_by"]) for r in review.decided(all_, edits.drop("at")).collect()}
    held = {(r["doc_id"], r["page_index"]): (r["page_kind"], r["review_status"], r["decided_by"]) for r in all_.collect()}
    assert got == {k: v for k, v in want.items() if v != held[k]} and len(got) > 8
    due = {r[0] for r in seen.where("due").select("doc_id").distinct().collect()}
    assert due == {r[0] for r in rows if r[-1] == "content"}


def test_states_into_the_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    first = nested(spark)
    s.merge("pages", store.encoded(first).withColumn("updated_at", F.lit(1.0)), "updated_at")
    batch = spark.createDataFrame([("b1", 2, "color", "corrected", "ann", START, False), ("b1", 2, "bw", "corrected", "bo", START + timedelta(seconds=1), False), ("b3", None, None, None, None, START, True)], stream.STATES)
    for _ in range(2):
        stream.applied(s, batch, 5.0)
    got = store.decoded(s.read("pages")).select(*first.columns)
    edited = F.when((F.col("doc_id") == "b1") & (F.col("page_index") == 2), F.struct(F.lit("bw"), F.lit("corrected"), F.lit("bo")))
    want = first.withColumns({c: F.coalesce(edited[f"col{k}"], F.col(c)) for k, c in enumerate(("page_kind", "review_status", "decided_by"), 1)})
    want = want.where("doc_id <> 'b3'").unionByName(rebuild.with_margins(want.where("doc_id = 'b3'")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert features.PAGE_SCHEMA.startswith("doc_id") and s.read("pages").where("updated_at = 5").count() == 10
