"""The review loop as folds of an edit log: decisions, region, content and number edits.

``edits`` has doc_id, page_index, seq (their order) and the columns that each fold names. Edits of a page
are folded in order inside one array, so a page of any book is one row; pages without edits are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.features import BOX_SCHEMA, REGION_SCHEMA

KEY = ["doc_id", "page_index"]


def gathered(edits: DataFrame) -> DataFrame:
    """doc_id, page_index, edits: an array in order of ``seq``."""
    rest = [c for c in edits.columns if c not in (*KEY, "seq")]
    return edits.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("seq", *rest))).alias("edits"))


def decided(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """``pages`` after decisions (page_kind, approve, finish, decided_by): of one edit a kind goes before approval before finish.

    A kind or ``finish`` makes the page corrected, ``approve`` approved; an edit without any changes nothing.
    """
    state = F.struct(*(F.col(c) for c in ("page_kind", "review_status", "decided_by")))

    def step(s: Column, e: Column) -> Column:
        kind = F.coalesce(e["page_kind"], F.lit("")) != ""
        yes = lambda c: F.coalesce(e[c], F.lit(False))
        status = F.when(kind, "corrected").when(yes("approve"), "approved").when(yes("finish"), "corrected").otherwise(s["review_status"])
        by = F.when(kind | yes("approve") | yes("finish"), e["decided_by"]).otherwise(s["decided_by"])
        return F.struct(F.when(kind, e["page_kind"]).otherwise(s["page_kind"]).alias("page_kind"), status.alias("review_status"), by.alias("decided_by"))

    out = pages.join(gathered(edits), KEY, "left").withColumn("__s", F.when(F.col("edits").isNull(), state).otherwise(F.aggregate("edits", state, step)))
    return out.select(*(F.col(f"__s.{c}").alias(c) if c in ("page_kind", "review_status", "decided_by") else F.col(c) for c in pages.columns))


def decision_log(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """One log row for each effective decision: field, old and new value as JSON, who decided."""
    kind = F.coalesce("e.page_kind", F.lit("")) != ""
    field = F.when(kind, "page_kind").when(F.col("e.approve"), "approve").when(F.col("e.finish"), "finish")
    each = pages.select(*KEY, "page_kind").join(gathered(edits), KEY).select(*KEY, "page_kind", "edits", F.posexplode("edits").alias("at", "e"))
    earlier = F.filter(F.slice("edits", F.lit(1), F.col("at")), lambda x: F.coalesce(x["page_kind"], F.lit("")) != "")
    old = F.coalesce(F.try_element_at(earlier, F.lit(-1))["page_kind"], F.col("page_kind"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return each.select(
        *KEY, F.col("e.seq").alias("seq"), F.col("e.decided_by").alias("decided_by"), field.alias("field"),
        F.when(kind, quoted(old)).alias("old_value"), F.when(kind, quoted(F.col("e.page_kind"))).otherwise("true").alias("new_value"),
    ).where("field is not null")


def region_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """``pages`` after region edits (kind, box, tone to add; index to delete, from 0): the page stays in its queue.

    Added regions are manual and keep a tone only as photos; an index that is out of range changes nothing.
    """
    start = F.coalesce("regions", F.array().cast(f"array<{REGION_SCHEMA}>"))

    def step(held: Column, e: Column) -> Column:
        new = F.struct(
            e["kind"].alias("kind"), e["box"].cast(BOX_SCHEMA).alias("box"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("ocr_text"),
            F.lit(None).cast("double").alias("ocr_conf"), F.when(e["kind"] == "photo", e["tone"]).alias("tone"), F.lit(None).cast("string").alias("layout_label"),
        )
        rest = F.filter(held, lambda _, i: i != e["index"])
        return F.when(e["index"].isNotNull(), rest).otherwise(F.concat(held, F.array(new.cast(REGION_SCHEMA))))

    out = pages.join(gathered(edits), KEY, "left").withColumn("__r", F.when(F.col("edits").isNull(), F.col("regions")).otherwise(F.aggregate("edits", start, step)))
    return out.select(*(F.col("__r").alias(c) if c == "regions" else F.col(c) for c in pages.columns))


def box_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """``pages`` (content, confidence, nombre) after box edits (field ``content`` or ``nombre``, box; null deletes a number).

    The last edit of a field holds; a content box set by hand has confidence 1. The book's margins are to be
    normalised again, with ``margins.normalise``.
    """
    last = edits.groupBy(*KEY, "field").agg(F.max_by("box", "seq").alias("box"))
    at = lambda f: F.max(F.when(F.col("field") == f, F.struct(F.lit(True).alias("set"), F.col("box").alias("box")))).alias(f"__{f}")
    both = last.groupBy(*KEY).agg(at("content"), at("nombre"))
    out = pages.join(both, KEY, "left")
    new = {
        "content": F.coalesce("__content.box", "content"), "confidence": F.when(F.col("__content.box").isNotNull(), 1.0).otherwise(F.col("confidence")),
        "nombre": F.when(F.col("__nombre.set"), F.col("__nombre.box")).otherwise(F.col("nombre")),
    }
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in pages.columns))


def books_to_renormalise(edits: DataFrame) -> DataFrame:
    """doc_id of every book of which a content or number box was edited."""
    return edits.where(F.col("field").isin("content", "nombre", "content_delete", "nombre_delete")).select("doc_id").distinct()
