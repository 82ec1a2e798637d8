"""Nearest-centroid learning on standardised features, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_STD = 1e-9
#: Rows that a class needs, classes that a model needs, and the confidence from which a prediction decides.
LEAST_ROWS, LEAST_CLASSES, SURE = 3, 2, 0.15
LABELS = ("bw", "gray", "color")
#: Bytes of all centres up to which ``classify`` broadcasts them.
MOST_CENTRE_BYTES = 64 << 20


def long_form(df: DataFrame, key: str, label: str, vector: str, dims: int | None = None) -> DataFrame:
    """One row per key and dimension, from 0; all components, or the first ``dims``."""
    v = F.transform(vector if dims is None else F.slice(vector, 1, dims), lambda x: x.cast("double"))
    return df.select(key, label, F.posexplode(v).alias("dim", "x"))


def train(rows: DataFrame, label: str) -> DataFrame:
    """label, dim, centre (of standardised values), mu, sd; a deviation under LEAST_STD counts as 1."""
    scale = rows.groupBy("dim").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    scale = scale.withColumn("sd", F.when(F.col("sd") < LEAST_STD, 1.0).otherwise(F.col("sd")))
    mean = rows.groupBy(label, "dim").agg(F.avg("x").alias("m"))
    return mean.join(scale, "dim").select(label, "dim", ((F.col("m") - F.col("mu")) / F.col("sd")).alias("centre"), "mu", "sd")


def predict(rows: DataFrame, model: DataFrame, key: str, label: str) -> DataFrame:
    """key and the label of the nearest centre; ties to the smaller label. Map-side sums per key and label."""
    m = model.withColumnRenamed(label, "predicted")
    z = (F.col("x") - F.col("mu")) / F.col("sd") - F.col("centre")
    far = rows.join(m, "dim").groupBy(key, "predicted").agg(F.round(F.sum(z * z), 6).alias("distance"))
    near = Window.partitionBy(key).orderBy("distance", "predicted")
    return far.withColumn("__r", F.row_number().over(near)).where("__r = 1").drop("__r")


def qualified(df: DataFrame, label: str, *, least_rows: int = LEAST_ROWS, least_classes: int = LEAST_CLASSES) -> DataFrame:
    """The rows of classes with ``least_rows`` rows, none of them if fewer than ``least_classes`` such classes are."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__rows")).where(F.col("__rows") >= least_rows)
    enough = counts.agg((F.count("*") >= least_classes).alias("__enough"))
    return df.join(counts.crossJoin(F.broadcast(enough)).where("__enough").select(label), label, "left_semi")


def training_rows(decisions: DataFrame, schema: str = "map<string,double>") -> DataFrame:
    """label, features (a map) of the decisions on page kinds whose JSON can be read; others are skipped.

    ``new_value`` is a JSON string of a label in LABELS, ``features`` a JSON object.
    """
    label = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), F.col("new_value"), F.lit("}")), "$.v"), F.col("new_value"))
    held = decisions.where("field = 'page_kind'") if "field" in decisions.columns else decisions
    read = held.select(label.alias("label"), F.from_json("features", schema, {"mode": "PERMISSIVE"}).alias("features"))
    return read.where(F.col("label").isin(*LABELS) & F.col("features").isNotNull() & (F.size("features") > 0))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centre, mu, sd as arrays of the qualified classes' vectors; empty without enough of them."""
    rows = qualified(df, label).select(label, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("dim", "x"))
    m = train(rows, label)
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("dim", c))), lambda s: s[c]).alias(c)
    return m.groupBy(label).agg(ordered("centre"), ordered("mu"), ordered("sd"))


def classify(df: DataFrame, model: DataFrame, label: str, vector: str) -> DataFrame:
    """``df`` with predicted and confidence by ``centroids``: (d2 - d1) / (d1 + d2), 1 with one class.

    Distances run inside each row over one array of all centres: one row a class, broadcast as its measured
    size is at most MOST_CENTRE_BYTES, else joined as it comes. Without a model both columns are null.
    """
    size = model.agg(F.coalesce(F.sum(F.size("centre") * 24), F.lit(0)).alias("b")).first()["b"]
    one = model.agg(F.collect_list(F.struct(F.col(label).alias("label"), "centre", "mu", "sd")).alias("__model"))
    one = F.broadcast(one) if size <= MOST_CENTRE_BYTES else one

    def distance(c: Column) -> Column:
        x = F.transform(vector, lambda v: v.cast("double"))
        z = F.transform(F.arrays_zip(x.alias("x"), c["centre"].alias("c"), c["mu"].alias("m"), c["sd"].alias("s")), lambda v: (v["x"] - v["m"]) / v["s"] - v["c"])
        return F.sqrt(F.aggregate(z, F.lit(0.0), lambda a, v: a + v * v))

    near = F.sort_array(F.transform("__model", lambda c: F.struct(F.round(distance(c), 9).alias("d"), c["label"].alias("label"))))
    out = df.crossJoin(one).withColumn("__near", near)
    d1, d2 = F.get("__near", F.lit(0))["d"], F.get("__near", F.lit(1))["d"]
    confidence = F.when(F.size("__near") == 0, None).when(F.size("__near") == 1, 1.0).when(d1 + d2 > 0, (d2 - d1) / F.nullif(d1 + d2, F.lit(0.0))).otherwise(0.0)
    return out.withColumns({"predicted": F.get("__near", F.lit(0))["label"], "confidence": confidence}).drop("__model", "__near")


def applied(page_kind: Column, flags: Column, predicted: Column, confidence: Column) -> Column:
    """struct(page_kind, flags): a sure prediction is taken, an unsure one flags the page as borderline once."""
    sure = F.coalesce(confidence >= SURE, F.lit(False))
    held = F.coalesce(flags, F.array().cast("array<string>"))
    marked = F.when(sure | predicted.isNull(), held).otherwise(F.array_union(held, F.array(F.lit("page_kind_borderline"))))
    return F.struct(F.when(sure, predicted).otherwise(page_kind).alias("page_kind"), marked.alias("flags"))


def save(model: DataFrame, path: str) -> None:
    """Writes the centroids as JSON, in place of what is at ``path``."""
    model.coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, label_type: str = "string") -> DataFrame | None:
    """The centroids at ``path``; None if there are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return None
    return spark.read.schema(f"label {label_type}, centre array<double>, mu array<double>, sd array<double>").json(path)
