"""The pipeline's stages, each on what the one before kept, against plain loops."""

import re

import corpus_pipeline
import pytest

from leafmill.llm import decontaminate, mixing, secrets, toxicity
from tests.llm.test_operators import brute_classes, brute_tiles  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage by name."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}")
        out[name] = before.collect(), docs.collect(), before.columns, docs.columns
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == stages[name][3]


def test_toxic_documents_go(spark, stages):
    before, after, *_ = stages["toxicity"]
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    clean = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in after} == clean and len(after) == sum(r["doc_id"] in clean for r in before)


def test_one_of_each_group_stays(stages):
    before, after, *_ = stages["near_dedup"]
    assert sorted(r["doc_id"] for r in after) == sorted(set(brute_classes([(r["doc_id"], r["text"]) for r in before]).values()))


def test_contaminated_documents_go(spark, stages):
    before, after, *_ = stages["decontamination"]
    items = [re.findall(r"\w+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def covered(text, item):
        w = re.findall(r"\w+", (text or "").lower())
        seeds = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if len(item) < 5 or not any(tuple(item[i : i + 5]) in seeds for i in range(len(item) - 4)):
            return False
        a, b = (decontaminate.word_hashes(x) for x in (w, item))
        return sum(n for *_, n in decontaminate._tiles_by_length(a, b, 5)) >= decontaminate.COVERAGE * len(item)

    want = sorted(r["doc_id"] for r in before if not any(covered(r["text"], item) for item in items))
    assert sorted(r["doc_id"] for r in after) == want and len(after) < len(before)


def test_secrets_are_cut(stages):
    before, after, *_ = stages["secrets"]
    old, new = ({r["doc_id"]: r["text"] for r in rows} for rows in (before, after))
    assert set(old) == set(new) and len(before) == len(after)
    for k, text in old.items():
        assert (new[k] == text) == (not secrets.spans(text)) or "[SECRET]" in new[k]


def test_mix_meets_targets(stages):
    before, after, *_ = stages["mixing"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    size = {r["doc_id"]: len(re.findall(mixing.SIZE_PATTERN, r["text"] or "")) for r in before}
    for s in {r["source"] for r in after}:
        rows = [r for r in after if r["source"] == s]
        assert sum(r["taken"] for r in rows) == pytest.approx(rows[0]["target"], rel=0.1)
        assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in rows)


def test_run_equals_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str) == sorted(map(tuple, stages["mixing"][1]), key=str)
