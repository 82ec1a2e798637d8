"""Names and labels of recognition engines, and their results as rows of one shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.numerals import let

#: Other names of engines.
ALIASES = {
    "paddleocr-v6": "ppocr-v6",
    "paddleocr-vl": "paddle-vl",
    "paddle-vl-1.6": "paddle-vl",
    "paddleocr-vl-1.6": "paddle-vl",
    "pp-structure": "pp-structurev3",
    "ppstructurev3": "pp-structurev3",
    "off": "none",
    "false": "none",
}
#: Fixed values: (layout, text) of engines that do one part only; all others do both under their name.
PARTS = {"auto": ("hybrid", "hybrid"), "ppocr-v6": ("none", "ppocr-v6"), "pp-structurev3": ("pp-structurev3", "none")}
#: Labels of layout models in the canonical vocabulary.
DOCUMENT_LABELS = {
    "text": "text",
    "vertical_text": "text",
    "paragraph": "text",
    "title": "title",
    "doc_title": "title",
    "section_title": "title",
    "section_heading": "title",
    "caption": "caption",
    "figure_title": "caption",
    "table_title": "caption",
    "header": "running_head",
    "page_header": "running_head",
    "footer": "note",
    "page_footer": "note",
    "footnote": "note",
    "aside_text": "note",
    "number": "page_number",
    "page_number": "page_number",
    "image": "figure",
    "header_image": "figure",
    "footer_image": "figure",
    "figure": "figure",
    "chart": "chart",
    "table": "table",
    "formula": "equation",
    "algorithm": "figure",
    "seal": "figure",
}
#: Class numbers of the library scanner's layout model.
CLASS_LABELS = {
    2: "caption",
    3: "advertisement",
    4: "note",
    5: "note",
    6: "figure",
    7: "advertisement",
    8: "running_head",
    9: "page_number",
    10: "rubi",
    11: "chart",
    12: "equation",
    13: "colophon",
    15: "table",
    16: "title",
}
#: Block and line names of the worker's layout model.
BLOCK_LABELS = {
    "text_block": "text",
    "line_main": "text",
    "line_caption": "caption",
    "line_ad": "advertisement",
    "line_note": "note",
    "line_note_tochu": "note",
    "block_fig": "figure",
    "block_ad": "advertisement",
    "block_pillar": "running_head",
    "block_folio": "page_number",
    "block_rubi": "rubi",
    "block_chart": "chart",
    "block_eqn": "equation",
    "block_cfm": "colophon",
    "block_eng": "text",
    "block_table": "table",
    "line_title": "title",
}


def looked_up(value: Column, table: dict, default: Column | None = None) -> Column:
    """The entry of a literal table; ``default``, or null, where there is none."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(m, value)
    return found if default is None else F.coalesce(found, default)


def engine_name(name: Column) -> Column:
    """Lower case, hyphens, one name an engine; null is ``none``."""
    plain = F.replace(F.lower(F.when(F.coalesce(name, F.lit("")) == "", "none").otherwise(name)), F.lit("_"), F.lit("-"))
    return looked_up(plain, ALIASES, plain)


def engine_parts(legacy: Column, layout: Column, text: Column) -> Column:
    """struct(layout, text): the engines of the two parts; a name of their own goes before the one for both."""
    whole = engine_name(F.when(F.coalesce(legacy, F.lit("")) == "", "hybrid").otherwise(legacy))
    part = lambda own, k: F.when(F.coalesce(own, F.lit("")) != "", engine_name(own)).otherwise(looked_up(whole, {n: p[k] for n, p in PARTS.items()}, whole))
    return F.struct(part(layout, 0).alias("layout"), part(text, 1).alias("text"))


def document_label(label: Column) -> Column:
    """Canonical label of a document layout model; unknown ones as they are, in lower case."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return looked_up(low, DOCUMENT_LABELS, low)


def class_label(class_id: Column) -> Column:
    """Canonical label of a class number; null, to be dropped, for unknown ones."""
    return looked_up(class_id.cast("int"), CLASS_LABELS)


def block_label(name: Column) -> Column:
    return looked_up(F.lower(name), BLOCK_LABELS, F.lit("figure"))


def polygon_box(points: Column) -> Column:
    """The hull of array<array<double>> points."""
    xs, ys = F.transform(points, lambda p: p[0].cast("double")), F.transform(points, lambda p: p[1].cast("double"))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def box_polygon(b: Column) -> Column:
    return F.array(*(F.array(b[x], b[y]) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))


RESULT_SCHEMA = (
    "struct<rec_polys:array<array<array<double>>>,dt_polys:array<array<array<double>>>,rec_boxes:array<array<double>>,rec_texts:array<string>,"
    "rec_scores:array<double>,dt_scores:array<double>,layout_det_res:struct<boxes:array<struct<label:string,coordinate:array<double>,score:double>>>,"
    "parsing_res_list:array<struct<block_bbox:array<double>,block_label:string,block_content:string,block_score:double>>,"
    "lines:array<struct<box:array<double>,text:string,score:double,source:string>>>"
)


def _four(v: Column) -> Column:
    return F.struct(*(F.get(v, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def recognised_lines(result: Column, source: str) -> Column:
    """array<struct<box, text, det_score, source>> of a result (RESULT_SCHEMA): by place, boxes before polygons.

    Places without either are left out; an empty text is null; results that list whole lines are taken as such. The result
    is bound once: a filter that Spark derives and moves below would else parse it for every element.
    """
    return let(result, lambda r: _lines(r, source))


def _lines(result: Column, source: str) -> Column:
    polys = F.coalesce(result["rec_polys"], result["dt_polys"])
    scores = F.coalesce(result["rec_scores"], result["dt_scores"])
    n = F.greatest(*(F.coalesce(F.size(x), F.lit(0)) for x in (polys, result["rec_boxes"], result["rec_texts"], scores)))
    at = lambda a, i: F.when(a.isNotNull(), F.get(a, i))

    def line(i: Column) -> Column:
        box = F.when(at(result["rec_boxes"], i).isNotNull(), _four(at(result["rec_boxes"], i))).when(at(polys, i).isNotNull(), polygon_box(at(polys, i)))
        return F.struct(box.alias("box"), F.nullif(at(result["rec_texts"], i), F.lit("")).alias("text"), at(scores, i).alias("det_score"), F.lit(source).alias("source"))

    by_place = F.filter(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), line), lambda x: x["box"].isNotNull())
    whole = F.transform(F.filter(result["lines"], lambda x: F.size(x["box"]) == 4), lambda x: F.struct(_four(x["box"]).alias("box"), F.nullif(x["text"], F.lit("")).alias("text"), x["score"].alias("det_score"), F.coalesce(x["source"], F.lit(source)).alias("source")))
    return let(by_place, lambda placed: F.when(F.size(placed) > 0, placed).otherwise(F.coalesce(whole, placed)))


def layout_boxes(result: Column, source: str) -> Column:
    """array<struct<box, label, raw_label, score, source>> of detected boxes and parsed blocks with four coordinates."""
    return let(result, lambda r: _layout(r, source))


def _layout(result: Column, source: str) -> Column:
    found = F.transform(F.filter(result["layout_det_res"]["boxes"], lambda b: F.size(b["coordinate"]) >= 4), lambda b: F.struct(_four(b["coordinate"]).alias("box"), document_label(b["label"]).alias("label"), F.lower(b["label"]).alias("raw_label"), b["score"].alias("score"), F.lit(source).alias("source")))
    parsed = F.transform(F.filter(result["parsing_res_list"], lambda b: F.size(b["block_bbox"]) >= 4), lambda b: F.struct(_four(b["block_bbox"]).alias("box"), document_label(b["block_label"]).alias("label"), F.lower(b["block_label"]).alias("raw_label"), b["block_score"].alias("score"), F.lit(source).alias("source")))
    none = F.array().cast("array<struct<box:struct<x0:double,y0:double,x1:double,y1:double>,label:string,raw_label:string,score:double,source:string>>")
    return F.concat(F.coalesce(found, none), F.coalesce(parsed, none))


def composite(lines: Column, layout: Column) -> Column:
    """struct(lines, layout) of a text and a layout engine; a failed (null) layout is an empty one."""
    none = F.array().cast("array<struct<box:struct<x0:double,y0:double,x1:double,y1:double>,label:string,raw_label:string,score:double,source:string>>")
    return F.struct(lines.alias("lines"), F.coalesce(layout, none).alias("layout"))
