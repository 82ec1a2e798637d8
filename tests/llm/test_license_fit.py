"""The fit of licence scans: its vectors do not grow with the words of the corpus, and leave out no n-gram that has a weight."""

import random

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from leafmill.llm import license_scan as scan_of


def test_vectors_do_not_grow_with_the_words_of_the_corpus(spark, monkeypatch):
    sizes = []

    class Spy(LogisticRegression):
        def fit(self, rows, *more):
            sizes.append(rows.first()["features"].size)
            return super().fit(rows, *more)

    monkeypatch.setattr(scan_of, "LogisticRegression", Spy)
    rng = random.Random(3)
    bodies = [" ".join(f"w{rng.randrange(3000)}" for _ in range(30)) for _ in range(300)]
    d = spark.createDataFrame([(k, f"{b}\n{b} again") for k, b in enumerate(bodies)], "doc_id long, text string")
    model = scan_of.train(d)
    written = {g for body, *_ in scan_of.written_rows() for g in scan_of._grams_of(body)}
    assert sizes and max(sizes) <= len(written)
    assert len(model.weights) > 100 and set(model.weights) <= written


def test_a_left_out_ngram_that_the_fit_needs_is_taken_in(spark):
    rows = spark.createDataFrame([(0.0, ["a", "q"])] * 50 + [(1.0, ["a"])] * 50 + [(0.0, ["z", "once"])] * 1 + [(0.0, ["z"])] * 20, "label double, grams array<string>")
    names, matrix, _ = scan_of.fit(rows)
    assert "a" in names and "q" in names and "once" not in names
    assert matrix[0, names.index("q")] > matrix[1, names.index("q")]


def test_left_out_ngrams_are_held_at_zero(spark):
    """By the gradient: what rows of none leave to other classes sums to no more than the L1 term for each n-gram of theirs alone."""
    docs = spark.createDataFrame([(k, f"some plain words number {k % 40} of text {k % 7}\nand more of them {k % 11}") for k in range(300)], "doc_id long, text string")
    rows = scan_of.training_rows(docs, 200).withColumn("grams", scan_of.grams(scan_of.tokens(F.col("body")))).where("fold < 2").select("label", "grams").coalesce(1).cache()
    names, matrix, intercept = scan_of.fit(rows)
    model = scan_of.Model({g: [float(x) for x in matrix[:, j]] for j, g in enumerate(names)}, intercept)
    got = rows.select("label", "grams", model.probabilities(F.col("grams"))[0].alias("p")).collect()
    pull, count, others = {}, {}, set()
    for r in got:
        others |= set(r["grams"]) if r["label"] else set()
        for g in r["grams"]:
            pull[g], count[g] = pull.get(g, 0.0) + 1 - r["p"], count.get(g, 0) + 1
    left = [g for g in pull if count[g] >= scan_of.LEAST_ROWS and g not in others and g not in set(names)]
    assert left and max(pull[g] for g in left) <= scan_of.L1 * len(got) + 1e-6
    rows.unpersist()
