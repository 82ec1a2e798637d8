"""Pixel operators on page images, one page a row: Arrow batches in, boxes and numbers out.

``pages`` has doc, page_index, height, width, channels and pixels (binary, rows of bytes). Images take part in
one pass only; all that later steps need are narrow columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import pixels
from leafmill.operators.sequence import dark_bands

KEY = ("doc", "page_index")
#: Pages of one Arrow batch of images.
BATCH = 8


def gray_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The page in gray; colour is blue, green, red."""
    img = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return img[:, :, 0] if channels == 1 else np.rint(img[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def mapped(pages: DataFrame, kernel: Callable[[np.ndarray], tuple], columns: str, *, keep: tuple[str, ...] = KEY) -> DataFrame:
    """``keep`` and ``columns``: what ``kernel`` makes of each page's gray image; null for a page that cannot be read."""
    names = [c.split()[0] for c in columns.split(",")]
    schema = ", ".join([*(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep), columns])
    types = pages.sparkSession.createDataFrame([], columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                rows = []
                for h, w, c, data in zip(*(part.column(x).to_pylist() for x in ("height", "width", "channels", "pixels")), strict=True):
                    readable = data is not None and h and w and c and len(data) == h * w * c
                    rows.append(kernel(gray_of(h, w, c, data)) if readable else (None,) * len(names))
                found = [pa.array([r[k] for r in rows], to_arrow_type(types[n].dataType)) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in keep), *found], names=[*keep, *names])

    return pages.select(*keep, "height", "width", "channels", "pixels").mapInArrow(run, schema)


def deskewed(pages: DataFrame) -> DataFrame:
    """doc, page_index, angle, confidence."""
    return mapped(pages, pixels.skew, "angle double, confidence double")


def ink(pages: DataFrame) -> DataFrame:
    """doc, page_index, threshold (Otsu's), ink (the share of ink pixels)."""
    return mapped(pages, lambda g: (pixels.otsu(g), float((g <= pixels.ink_threshold(g)).mean())), "threshold long, ink double")


BOX = ("x0", "y0", "x1", "y1")


def contents(pages: DataFrame) -> DataFrame:
    """doc, page_index, content, confidence, nombre: boxes of each page as it lies."""

    def kernel(g: np.ndarray) -> tuple:
        box, sure, number = pixels.content_box(g)
        return (*box, sure, *(number or (None,) * 4))

    found = mapped(pages, kernel, ", ".join(f"{c} double" for c in (*BOX, "confidence", *(f"n{c}" for c in BOX))))
    number = F.struct(*(F.col(f"n{c}").alias(c) for c in BOX))
    return found.select(*KEY, F.struct(*BOX).alias("content"), "confidence", F.when(F.col("nx0").isNotNull(), number).alias("nombre"))


def components(pages: DataFrame) -> DataFrame:
    """doc, page_index, x, y, w, h, area of every connected part of ink."""
    found = mapped(pages, lambda g: (pixels.components(g <= pixels.ink_threshold(g))[1].ravel().tolist(),), "flat array<long>")
    each = found.select(*KEY, F.explode(F.filter(F.sequence(F.lit(0), F.floor(F.size("flat") / 5).cast("int")), lambda k: k * 5 < F.size("flat"))).alias("k"), "flat")
    return each.select(*KEY, *(F.get("flat", (F.col("k") * 5 + i).cast("int")).alias(c) for i, c in enumerate(("x", "y", "w", "h", "area"))))


def cleaned(pages: DataFrame) -> DataFrame:
    """doc, page_index, out_height, out_width, out_pixels: bilevel pages without edge shadows and specks, by their own threshold."""

    def kernel(g: np.ndarray) -> tuple:
        out = pixels.despeckled(pixels.binarised(pixels.without_edge_shadows(g)))
        return out.shape[0], out.shape[1], out.tobytes()

    return mapped(pages, kernel, "out_height int, out_width int, out_pixels binary")


def shadow_bands(pages: DataFrame, *, bins: int = 1000, share: float = 0.5) -> DataFrame:
    """doc, lo, hi: upright dark bands that stand at the same place on ``share`` of a book's pages."""

    def kernel(g: np.ndarray) -> tuple:
        dark = pixels.dark_columns(g)
        at = np.interp(np.linspace(0, 1, bins), np.linspace(0, 1, len(dark)), dark.astype(float)) >= 0.5
        return (np.flatnonzero(at).tolist(),)

    profile = mapped(pages, kernel, "dark array<long>").select(*KEY, F.explode_outer("dark").alias("bin"))
    return dark_bands(profile, ["doc"], "page_index", "bin", bins=bins, share=share)


def patch_kinds(patches: DataFrame) -> DataFrame:
    """doc, page_index, kind of each patch image."""
    return mapped(patches, lambda g: (pixels.patch_kind(pixels.patch_measures(g)),), "kind string")
