"""Catalogue operators do the whole of what their names say."""

from leafmill.operators import learn, profile, robust
from leafmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_centroids_use_every_component(spark):
    model = catalogue.QUERIES["centroid_train_all"](spark, SF)
    size = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("max(size(embedding)) AS n").first()["n"]
    assert {r["dim"] for r in model.select("dim").distinct().collect()} == set(range(size)) and size > 8
    d = spark.createDataFrame([(k, k % 2, [0.0] * 8 + [float(k % 2)]) for k in range(8)], "vec_id long, label int, embedding array<float>")
    rows = learn.long_form(d, "vec_id", "label", "embedding")
    assert all(r["predicted"] == r["vec_id"] % 2 for r in learn.predict(rows, learn.train(rows, "label"), "vec_id", "label").collect())


def test_straight_and_short_books_keep_their_flags(spark):
    rows = [(1, k, 0.0 if k < 8 else 0.6, 9.0) for k in range(10)] + [(2, 0, 0.3, 1.0), (2, 1, 0.3, 2.0), (2, 2, 0.1, 0.0), (2, 3, -0.4, None)]
    d = spark.createDataFrame(rows, "book long, page long, angle double, confidence double")
    got = robust.skew_flags(d, ["book"], "angle", "confidence").select("book", "page").collect()
    assert sorted(map(tuple, got)) == [(1, 8), (1, 9), (2, 0), (2, 3)]


def test_back_off_tries_every_subset(spark):
    rows = [("w", "s", "f", "g", 1)] + [("w", "s", f"f{k}", "g", 1) for k in range(4)] + [("w", f"s{k}", "f", f"g{k}", 1) for k in range(8)] + [("v", "s", "f", "g", 1)]
    d = spark.createDataFrame(rows, "writing string, scanner string, fmt string, genre string, metric long")
    asked = spark.createDataFrame([("w", "s", "f", "g"), ("w", "new", "f", "new"), ("v", "s", "f", "g"), ("w", None, "x", "g"), ("u", "s", "f", "g")], "writing string, scanner string, fmt string, genre string")
    soft = ["scanner", "fmt", "genre"]
    got = profile.resolve(asked, profile.scope_lattice(d, "writing", soft, "metric"), "writing", soft, least=5).collect()
    assert {(r["writing"], r["scanner"]): (r["level"], r["n"]) for r in got} == {("w", "s"): (2, 5), ("w", "new"): (5, 9), ("v", "s"): (7, 1), ("w", None): (6, 5), ("u", "s"): (None, None)}
