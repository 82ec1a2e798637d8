"""Pixel kernels of a page image on numpy arrays: thresholds, components, deskew, shadows, content box, patches."""

from __future__ import annotations

import numpy as np

INK_HIGH, INK_FLOOR, INK_LEAST, SHOW_THROUGH = 225, 110, 0.001, 25
MOST_ANGLE, COARSE, FINE, WORK_SIDE, LEAST_INK = 7.0, 0.5, 0.05, 1500, 50
#: Of an edge shadow: how near the side it lies, how much of the side it runs along, how thin it is; then of one at the very edge.
EDGE, SIDE, THIN = 0.15, 0.5, 0.15
VERY_EDGE, VERY_SIDE, VERY_THIN = 0.03, 0.12, 0.01
SPECK, NUMBER_BAND, NUMBER_HEIGHT, NUMBER_WIDTH, NUMBER_AREA = 1e-5, 0.08, 0.04, 0.25, 10
LEAST_SPECK, BAND_EDGE, BAND_HEIGHT, BAND_HALO = 8, 0.07, 0.10, 0.004
#: A stroke beside the text: least height, least height a width, and what is whitened around it.
STROKE_HEIGHT, STROKE_SHAPE, STROKE_HALO = 15, 6, 8
GRAYISH = 16.0


def otsu(gray: np.ndarray) -> int:
    """First threshold with the largest variance between the pixels at or under it and the others."""
    n = np.bincount(gray.ravel().astype(np.int64), minlength=256)[:256].astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - s1 / w1) ** 2, 0.0)
    return int(np.argmax(np.round(score, 6)))


def ink_threshold(gray: np.ndarray, valley: int | None = None) -> int:
    """Gray up to which a pixel is ink: Otsu's, the book's valley where that lies far above it, a floor on blank pages."""
    t = otsu(gray)
    if valley is not None:
        return valley if t > valley + SHOW_THROUGH else t
    return INK_FLOOR if t > INK_HIGH and float((gray <= INK_FLOOR).mean()) < INK_LEAST else t


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, boxes) of the 8-connected parts of a mask; boxes rows are x, y, width, height, area of label k + 1.

    Runs of each row are joined to the runs of the row above that they touch, by union and find.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    _, stops = np.nonzero(edge == -1)
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        a, b = int(first[y - 1]), int(first[y])
        for k in range(b, int(first[y + 1])):
            while a < b and stops[a] < starts[k]:
                a += 1
            j = a
            while j < b and starts[j] <= stops[k]:
                x, z = root(j), root(k)
                parent[max(x, z)] = min(x, z)
                j += 1
    roots = np.array([root(k) for k in range(len(rows))], np.int64)
    kinds, number = np.unique(roots, return_inverse=True)
    labels = np.zeros((h, w), np.int32)
    for y, s, e, k in zip(rows.tolist(), starts.tolist(), stops.tolist(), number.tolist(), strict=True):
        labels[y, s:e] = k + 1
    boxes = np.zeros((len(kinds), 5), np.int64)
    if len(kinds):
        x0, y0 = np.full(len(kinds), w), np.full(len(kinds), h)
        x1, y1 = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        np.minimum.at(x0, number, starts)
        np.maximum.at(x1, number, stops)
        np.minimum.at(y0, number, rows)
        np.maximum.at(y1, number, rows + 1)
        boxes = np.stack([x0, y0, x1 - x0, y1 - y0, np.bincount(number, stops - starts).astype(np.int64)], axis=1)
    return labels, boxes


def shrunk(gray: np.ndarray, most: int) -> np.ndarray:
    """Means of whole blocks, so that no side is longer than ``most``."""
    k = -(-max(gray.shape) // most)
    if k <= 1:
        return gray
    h, w = gray.shape[0] // k * k, gray.shape[1] // k * k
    return gray[:h, :w].reshape(h // k, k, w // k, k).mean(axis=(1, 3)).astype(gray.dtype)


def rotated(img: np.ndarray, degrees: float, fill: int) -> np.ndarray:
    """The image turned about its centre, positive counter-clockwise, nearest pixels, ``fill`` outside."""
    h, w = img.shape[:2]
    t = np.deg2rad(degrees)
    c, s = np.cos(t), np.sin(t)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - w / 2, y - h / 2
    sx, sy = np.rint(c * dx - s * dy + w / 2).astype(int), np.rint(s * dx + c * dy + h / 2).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(img, fill)
    out[ok] = img[sy[ok], sx[ok]]
    return out


def _sharpness(ys: np.ndarray, xs: np.ndarray, shape: tuple[int, int], degrees: float) -> float:
    """Largest energy of the steps of the ink's row or column profile, the page turned by ``degrees``."""
    t = np.deg2rad(degrees)
    h, w = shape
    dx, dy = xs - w / 2, ys - h / 2
    best = 0.0
    for at, n in ((np.rint(-np.sin(t) * dx + np.cos(t) * dy + h / 2), h), (np.rint(np.cos(t) * dx + np.sin(t) * dy + w / 2), w)):
        profile = np.bincount(at[(at >= 0) & (at < n)].astype(np.int64), minlength=n)
        step = np.diff(profile.astype(float))
        best = max(best, float(step @ step))
    return best


def skew(gray: np.ndarray) -> tuple[float, float]:
    """(degrees, confidence): the turn that makes lines of ink sharpest, and how far it stands out.

    All angles up to MOST_ANGLE are tried in steps of COARSE, then around the best in steps of FINE; confidence is
    the best score's distance from the median over the median's from the least. Next to no ink gives 0, 0.
    """
    small = without_edge_shadows(shrunk(gray, WORK_SIDE))
    ink = small <= otsu(small)
    if ink.sum() < LEAST_INK or ink.all():
        return 0.0, 0.0
    ys, xs = np.nonzero(ink)
    scores = {round(float(a), 4): _sharpness(ys, xs, ink.shape, a) for a in np.arange(-MOST_ANGLE, MOST_ANGLE + 1e-9, COARSE)}
    at = max(scores, key=scores.get)
    scores |= {round(float(a), 4): _sharpness(ys, xs, ink.shape, a) for a in np.arange(at - COARSE, at + COARSE + 1e-9, FINE)}
    at = max(scores, key=scores.get)
    values = np.array(list(scores.values()))
    middle = float(np.median(values))
    reach = middle - float(values.min())
    return round(at, 3), round((scores[at] - middle) / reach, 3) if reach > 0 else 0.0


def without_edge_shadows(gray: np.ndarray) -> np.ndarray:
    """White in place of single dark parts near a side that run along at least half of it and stay thin, or shorter and thinner ones at the very edge."""
    h, w = gray.shape
    labels, boxes = components(gray <= ink_threshold(gray))
    x, y, bw, bh, _ = boxes.T
    shadow = np.zeros(len(boxes), bool)
    for edge, side, thin in ((EDGE, SIDE, THIN), (VERY_EDGE, VERY_SIDE, VERY_THIN)):
        shadow |= (bh >= side * h) & (bw <= thin * w) & ((x <= edge * w) | (x + bw >= w - edge * w))
        shadow |= (bw >= side * w) & (bh <= thin * h) & ((y <= edge * h) | (y + bh >= h - edge * h))
    out = gray.copy()
    out[np.isin(labels, np.flatnonzero(shadow) + 1)] = 255
    return out


def without_strokes(gray: np.ndarray, text: tuple[float, float, float, float], kept: list[tuple[float, float, float, float]] = ()) -> np.ndarray:
    """White in place of tall thin strokes left and right of the ``text`` box, ``kept`` boxes (figures) spared."""
    h, w = gray.shape
    beside = gray <= ink_threshold(gray)
    beside[:, max(0, int(text[0])) : min(w, int(np.ceil(text[2])))] = False
    _, boxes = components(beside)
    white = np.zeros((h, w), bool)
    for x, y, bw, bh, _ in boxes[(boxes[:, 3] >= STROKE_HEIGHT) & (boxes[:, 3] >= STROKE_SHAPE * boxes[:, 2])].tolist():
        white[y : y + bh, max(0, x - STROKE_HALO) : x + bw + STROKE_HALO] = True
    white[:, max(0, int(text[0])) : min(w, int(np.ceil(text[2])))] = False
    for x0, y0, x1, y1 in kept:
        white[max(0, int(y0)) : int(np.ceil(y1)), max(0, int(x0)) : int(np.ceil(x1))] = False
    return np.where(white, np.uint8(255), gray)


def content_box(gray: np.ndarray, degrees: float = 0.0) -> tuple[tuple[float, float, float, float], float, tuple[float, float, float, float] | None]:
    """(box, confidence, number box or None) of a page turned by ``degrees``.

    Parts that are specks or touch the border do not count; confidence is one and a half times the box's share of
    the page, at most 1, and 0 with the whole page if nothing is left. The number is the part in the top or
    bottom band that is small and nearest to the middle.
    """
    clean = without_edge_shadows(gray)
    if abs(degrees) > 1e-3:
        clean = rotated(clean, degrees, 255)
    h, w = clean.shape
    _, boxes = components(clean <= ink_threshold(clean))
    x, y, bw, bh, area = boxes.T
    small = (bh <= int(h * NUMBER_HEIGHT)) & (bw <= w * NUMBER_WIDTH) & (area >= NUMBER_AREA) & ((y < int(h * NUMBER_BAND)) | (y + bh > h - int(h * NUMBER_BAND)))
    number = None
    if small.any():
        k = np.flatnonzero(small)[np.argmin(np.abs(x[small] + bw[small] / 2 - w / 2))]
        number = tuple(float(v) for v in (x[k], y[k], x[k] + bw[k], y[k] + bh[k]))
    held = (area >= SPECK * h * w) & (x > 0) & (y > 0) & (x + bw < w) & (y + bh < h)
    if not held.any():
        return (0.0, 0.0, float(w), float(h)), 0.0, None
    box = (float(x[held].min()), float(y[held].min()), float((x + bw)[held].max()), float((y + bh)[held].max()))
    return box, float(np.clip((box[2] - box[0]) * (box[3] - box[1]) / (w * h) * 1.5, 0, 1)), number


def despeckled(bilevel: np.ndarray, least: int = LEAST_SPECK) -> np.ndarray:
    """A page of 0 and 255 without parts of fewer than ``least`` ink pixels."""
    labels, boxes = components(bilevel == 0)
    out = bilevel.copy()
    out[np.isin(labels, np.flatnonzero(boxes[:, 4] < least) + 1)] = 255
    return out


def dark_columns(gray: np.ndarray) -> np.ndarray:
    """Which columns near the left and right edge are ink over BAND_HEIGHT of their height."""
    ink = (gray <= ink_threshold(gray)).sum(axis=0)
    dark = ink >= BAND_HEIGHT * gray.shape[0]
    edge = int(len(dark) * BAND_EDGE)
    out = np.zeros(len(dark), bool)
    if edge:
        out[:edge], out[-edge:] = dark[:edge], dark[-edge:]
    return out


def whitened(img: np.ndarray, bands: list[tuple[float, float]], halo: float = BAND_HALO) -> np.ndarray:
    """White in place of upright bands, given as shares of the width, and a small halo."""
    out, w = img.copy(), img.shape[1]
    for lo, hi in bands:
        room = max(2, int(w * halo))
        out[:, max(0, int(lo * w) - room) : min(w, int(hi * w) + room)] = 255
    return out


def is_grayish(bgr: np.ndarray) -> bool:
    """Whether the channels of a colour image hardly differ."""
    v = bgr.astype(float)
    return float(np.std(v - v.mean(axis=2, keepdims=True))) <= GRAYISH


def binarised(gray: np.ndarray, valley: int | None = None) -> np.ndarray:
    return np.where(gray <= ink_threshold(gray, valley), 0, 255).astype(np.uint8)


def posterised(gray: np.ndarray, k: int = 4, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(centres, labels): Lloyd's clusters of gray values on their histogram, from even quantiles, the first of equals."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    share = np.cumsum(n) / n.sum()
    centres = np.searchsorted(share, (np.arange(k) + 0.5) / k).astype(float)
    values = np.arange(256.0)
    for _ in range(rounds):
        near = np.argmin(np.abs(values[:, None] - centres[None, :]), axis=1)
        weight = np.bincount(near, n, k)
        moved = np.where(weight > 0, np.bincount(near, n * values, k) / np.maximum(weight, 1), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres, near[gray]


def tint_panels(gray: np.ndarray, low: int = 60, high: int = 235, share: float = 0.6, gap: int = 10, least: int = 24) -> list[tuple[int, int, int, int, float]]:
    """(x0, y0, x1, y1, tone) of even gray panels: long runs of rows and of columns in them that are mostly mid-gray."""
    mid = (gray >= low) & (gray <= high)

    def spans(flags: np.ndarray) -> list[tuple[int, int]]:
        at = np.flatnonzero(flags)
        if not len(at):
            return []
        cuts = np.flatnonzero(np.diff(at) > gap + 1)
        return [(int(at[a]), int(at[z]) + 1) for a, z in zip(np.r_[0, cuts + 1], np.r_[cuts, len(at) - 1], strict=True)]

    out = []
    for y0, y1 in spans(mid.mean(axis=1) >= share / 3):
        for x0, x1 in spans(mid[y0:y1].mean(axis=0) >= share):
            patch = gray[y0:y1, x0:x1][mid[y0:y1, x0:x1]]
            if x1 - x0 >= least and y1 - y0 >= least and patch.std() <= 20:
                out.append((x0, y0, x1, y1, float(np.median(patch)) / 255))
    return out


#: A patch needs so many pixels; edges are steps of so much gray.
LEAST_PATCH, STEP = 64, 50
BLANK_MEAN, BLANK_STD = 248.0, 4.0
EVEN_STD, EVEN_BINS, SOLID_FILL, SOLID_EDGES = 10.0, 3, 0.50, 0.08
TONE_BINS, TONE_STD, TONE_EXTREME = 8, 22.0, 0.92
LINE_FILL, LINE_EDGES, LINE_PARTS, LINE_SPREAD, LINE_REACH = 0.45, 0.015, 8, 0.60, 0.65


def patch_measures(gray: np.ndarray) -> dict[str, float]:
    """What ``patch_kind`` decides by: size, mean, std, occupied of 32 bins, share of extremes, of ink and of edges, and whether a line of letters stands in it."""
    if not gray.size:
        return dict.fromkeys(("size", "mean", "std", "bins", "extreme", "fill", "edges", "line"), 0.0)
    g = gray.astype(float)
    ink = gray <= (otsu(gray) if gray.min() < gray.max() else int(gray.max()))
    step = np.zeros(gray.shape, bool)
    step[:, 1:] |= np.abs(np.diff(g, axis=1)) >= STEP
    step[1:] |= np.abs(np.diff(g, axis=0)) >= STEP
    bins = np.bincount(gray.ravel() >> 3, minlength=32)
    return {
        "size": float(gray.size), "mean": float(g.mean()), "std": float(g.std()), "bins": float((bins > 0.005 * gray.size).sum()),
        "extreme": float(((gray <= 8) | (gray >= 247)).mean()), "fill": float(ink.mean()), "edges": float(step.mean()), "line": float(has_line(ink)),
    }


def has_line(ink: np.ndarray) -> bool:
    """Whether LINE_PARTS parts of like height stand side by side."""
    _, boxes = components(ink)
    letters = boxes[(boxes[:, 4] >= 2) & (boxes[:, 4] <= 0.03 * ink.size) & (boxes[:, 3] >= 3)]
    if len(letters) < LINE_PARTS:
        return False
    height, middle = letters[:, 3].astype(float), letters[:, 1] + letters[:, 3] / 2
    if height.std() > LINE_SPREAD * height.mean():
        return False
    order = np.sort(middle)
    reach = max(2.0, LINE_REACH * height.mean())
    return bool((np.searchsorted(order, order + reach, "right") - np.searchsorted(order, order - reach, "left") >= LINE_PARTS).any())


def patch_kind(m: dict[str, float]) -> str:
    """photo, solid_fill, line_art, text or other, the first that fits the measures of a patch."""
    even = m["std"] <= EVEN_STD or m["bins"] <= EVEN_BINS
    if m["size"] < LEAST_PATCH or m["mean"] >= BLANK_MEAN and m["std"] <= BLANK_STD:
        return "other"
    if (m["bins"] >= TONE_BINS or m["std"] >= TONE_STD) and m["extreme"] <= TONE_EXTREME and not even:
        return "photo"
    if m["fill"] >= SOLID_FILL and m["edges"] < SOLID_EDGES and even:
        return "solid_fill"
    if m["fill"] <= LINE_FILL and m["edges"] >= LINE_EDGES:
        return "line_art"
    return "text" if m["line"] else "other"
