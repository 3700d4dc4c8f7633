"""Shapes in pictures: edges, connected components, boxes, lines and colour shares, in Arrow batches.

A picture is a row of Spark's image source: height, width, nChannels and data, the bytes of its rows (grey, or blue, green, red).
Components are found over runs of set pixels: runs of neighbouring rows that touch are united, so the work grows with
the runs and not with the pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as C

#: pictures that are worked on at once
SLICE = 64
#: edge pixels: those over `LOW` that hang together with one over `HIGH`; the shortest line and the widest gap in one
LOW, HIGH, LINE, GAP, SLANT = 50, 150, 50, 10, 5


def decoded(height, width, channels, data) -> np.ndarray | None:
    """The picture as rows of grey values or of (blue, green, red); None without pixels or of a wrong size."""
    if not height or not width or data is None or len(data) != height * width * (channels or 1):
        return None
    pixels = np.frombuffer(data, np.uint8)
    return pixels.reshape(height, width) if channels in (None, 1) else pixels.reshape(height, width, channels)[:, :, :3]


def grey(picture: np.ndarray) -> np.ndarray:
    if picture.ndim == 2:
        return picture.astype(np.int32)
    blue, green, red = (picture[:, :, i].astype(np.float64) for i in range(3))
    return np.floor(0.114 * blue + 0.587 * green + 0.299 * red + 0.5).astype(np.int32)


# ---- components ----


def runs(bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each run of set pixels, row by row."""
    wide = np.zeros((bitmap.shape[0], bitmap.shape[1] + 2), np.int8)
    wide[:, 1:-1] = bitmap
    change = np.diff(wide, axis=1)
    row, start = np.nonzero(change == 1)
    return row, start, np.nonzero(change == -1)[1]


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n members' group, given the links a - b: hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, diagonal: bool = True) -> np.ndarray:
    """The number of each run's component, in order of their first run."""
    if not len(row):
        return row
    span = width + 2
    more = int(diagonal)
    first = np.searchsorted(row * span + end, (row + 1) * span + start + 1 - more)
    last = np.searchsorted(row * span + start, (row + 1) * span + end - 1 + more, side="right")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(united(len(row), a, b), return_inverse=True)[1]


def components(bitmap: np.ndarray, diagonal: bool = True) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The runs of a bitmap and the number of each one's component."""
    found = runs(bitmap)
    return found, linked(*found, bitmap.shape[1], diagonal)


def painted(shape: tuple[int, int], row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bitmap, of numbers 0 and 1, whose runs are given."""
    change = np.zeros((shape[0], shape[1] + 1), np.int32)
    change[row, start] = 1
    change[row, end] = -1  # runs of a row do not touch
    return np.cumsum(change, axis=1, dtype=np.int32)[:, :-1]


def outermost(bitmap: np.ndarray, found: tuple | None = None) -> np.ndarray:
    """Which components of a bitmap (`found`, if they are known) stand in no hole of another: those next to the background that reaches
    the border."""
    (row, start, end), own = found or components(bitmap)
    (r, s, e), back = components(~np.pad(bitmap, 1), diagonal=False)
    free = back == 0  # the first run is that of the border
    outside = painted((bitmap.shape[0] + 2, bitmap.shape[1] + 2), r[free], s[free], e[free])
    cover = np.cumsum(np.pad(outside, ((0, 0), (1, 0))), axis=1)
    beside = sum(cover[row + d, end + 1 + w] - cover[row + d, start + 1 - w] for d, w in ((0, 0), (1, 1), (2, 0)))
    out = np.zeros(int(own.max()) + 1 if len(own) else 0, bool)
    np.logical_or.at(out, own, beside > 0)
    return out


def boxes(bitmap: np.ndarray, outer: bool = True) -> np.ndarray:
    """Left, top, width, height, pixels and corners of each component (of the outermost alone), in order of their first pixel."""
    found = (row, start, end), own = components(bitmap)
    n = int(own.max()) + 1 if len(own) else 0
    left, top, right, bottom, size = (np.full(n, x) for x in (2**31, 2**31, 0, 0, 0))
    for into, what, values in ((left, np.minimum, start), (top, np.minimum, row), (right, np.maximum, end), (bottom, np.maximum, row + 1), (size, np.add, end - start)):
        what.at(into, own, values)
    if not n:
        return np.zeros((0, 6), np.int64)
    kept = outermost(bitmap, found) if outer else np.ones(n, bool)
    whose, points = turns(row, start, end, own)
    parts = np.split(points, np.searchsorted(whose, np.arange(1, n)))
    corners = np.array([corners_of(p) if k else 0 for p, k in zip(parts, kept)], np.int64)
    return np.stack([left, top, right - left, bottom - top, size, corners], 1)[kept]


def turns(row: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component, point) of those pixels that may be corners of a component's convex outline, by component: the ends of its first and last
    row, and of the rows between that stand out from the line between the ends of the rows beside. A component has no empty row."""
    order = np.argsort(own, kind="stable")
    row, start, end, own = row[order], start[order], end[order], own[order]
    new = np.ones(len(row), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    own, row, left, right = own[first], row[first], start[first], end[np.append(first[1:], len(end)) - 1] - 1
    edge = np.ones(len(own) + 1, bool)
    edge[1:-1] = own[1:] != own[:-1]
    edge = edge[:-1] | edge[1:]
    out = []
    for side, sign in ((left, 1), (right, -1)):
        stands = edge.copy()
        stands[1:-1] |= sign * (2 * side[1:-1] - side[:-2] - side[2:]) < 0
        out.append((own[stands], np.stack([side[stands], row[stands]], 1)))
    whose, points = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(whose, kind="stable")
    return whose[order], points[order]


def corners_of(points: np.ndarray, tolerance: float = 0.02) -> int:
    """Corners of the convex outline of points, without those nearer than `tolerance` of its length to the line between their
    neighbours."""
    points = sorted(set(map(tuple, np.asarray(points).tolist())))  # by x, then y

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(points) + half(points[::-1]) if len(points) > 2 else points
    length = sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(hull, hull[1:] + hull[:1]))
    while len(hull) > 2:
        around = [(hull[i - 1], hull[i], hull[(i + 1) % len(hull)]) for i in range(len(hull))]
        off = [abs((c[0] - a[0]) * (b[1] - a[1]) - (c[1] - a[1]) * (b[0] - a[0])) / max(np.hypot(c[0] - a[0], c[1] - a[1]), 1e-9) for a, b, c in around]
        least = int(np.argmin(off))
        if off[least] > tolerance * length:
            break
        hull.pop(least)
    return len(hull)


# ---- edges and lines ----


def edges(gray: np.ndarray, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Edge pixels: where the gradient (3 by 3, sum of both parts) is greatest across the edge, over `low`, and joined to a place
    over `high`. Of two equal neighbours the left or upper one counts."""
    g = np.pad(gray.astype(np.int32), 1, mode="edge")
    column = g[:-2] + 2 * g[1:-1] + g[2:]
    line = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    dx, dy = column[:, 2:] - column[:, :-2], line[2:] - line[:-2]
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    at = lambda i, j: m[1 + i : m.shape[0] - 1 + i, 1 + j : m.shape[1] - 1 + j]
    flat, steep = np.abs(dy) * 10_000 < np.abs(dx) * 4_142, np.abs(dx) * 10_000 < np.abs(dy) * 4_142  # within 22.5 degrees
    falling = (dx ^ dy) >= 0
    greatest = np.where(
        flat, (size > at(0, -1)) & (size >= at(0, 1)),
        np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(falling, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))),
    )
    weak = greatest & (size > low)
    (row, start, end), own = components(weak)
    strong = np.cumsum(np.pad((weak & (size > high)).astype(np.int32), ((0, 0), (1, 0))), axis=1)
    has = np.bincount(own, weights=strong[row, end] - strong[row, start]) > 0 if len(own) else np.zeros(0, bool)
    kept = has[own] if len(own) else np.zeros(0, bool)
    return painted(gray.shape, row[kept], start[kept], end[kept]).astype(bool)


def lines(bitmap: np.ndarray, least: int = LINE, gap: int = GAP, slant: int = SLANT) -> int:
    """Horizontal lines of a bitmap: pieces of a row, gaps of up to `gap` closed and `slant` pixels long or more, that touch make a
    line if they are `least` pixels wide or more together and less than `slant` high."""
    row, start, end = runs(bitmap)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] - end[:-1] > gap)
    first = np.flatnonzero(new)
    row, start, end = row[first], start[first], end[np.append(first[1:], len(row)) - 1] if len(first) else end
    kept = end - start >= slant
    row, start, end = row[kept], start[kept], end[kept]
    own = linked(row, start, end, bitmap.shape[1])
    n = int(own.max()) + 1 if len(own) else 0
    left, top, right, bottom = np.full(n, 2**31), np.full(n, 2**31), np.zeros(n, int), np.zeros(n, int)
    for into, what, values in ((left, np.minimum, start), (top, np.minimum, row), (right, np.maximum, end), (bottom, np.maximum, row + 1)):
        what.at(into, own, values)
    return int(((right - left >= least) & (bottom - top < slant)).sum())


# ---- colours ----


def hue(picture: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0 to 179), saturation and value (0 to 255) of each pixel."""
    blue, green, red = (picture[:, :, i].astype(np.float64) for i in range(3))
    value, least = picture.max(2).astype(np.float64), picture.min(2).astype(np.float64)
    spread = np.where(value > least, value - least, 1)
    turn = np.where(value == red, (green - blue) / spread, np.where(value == green, 2 + (blue - red) / spread, 4 + (red - green) / spread))
    turn = np.where(value > least, turn, 0.0)
    return np.floor(30 * np.where(turn < 0, turn + 6, turn) + 0.5) % 180, np.floor(255 * (value - least) / np.maximum(value, 1) + 0.5), value


def colour_share(picture: np.ndarray, low: tuple[int, int, int], high: tuple[int, int, int]) -> float:
    """Share of pixels whose hue, saturation and value lie between low and high, both included."""
    return _share(hue(picture), low, high)


def _share(parts: tuple[np.ndarray, ...], low: tuple[int, int, int], high: tuple[int, int, int]) -> float:
    return float(np.logical_and.reduce([(x >= a) & (x <= b) for x, a, b in zip(parts, low, high)]).mean())


# ---- columns ----


def each_picture(pictures: DataFrame, new: str, make: Callable[[np.ndarray], tuple], image: str = "image") -> DataFrame:
    """pictures without their image, plus the columns of the DDL text `new` that `make` computes; null for an image without
    pixels or of a wrong size. Columns named like a new one are replaced."""
    added = StructType.fromDDL(new)
    lost = {c.lower() for c in (image, *added.names)}
    keep = [c for c in pictures.columns if c.lower() not in lost]
    parts = [F.col(f"`{image}`.{c}").alias(f"__{c}") for c in ("height", "width", "nChannels", "data")]
    schema = StructType([*pictures.select(*(f"`{c}`" for c in keep)).schema.fields, *added.fields])
    names, none = added.names, (None,) * len(added.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (b.iloc[i : i + SLICE] for b in batches for i in range(0, len(b), SLICE)):
            found = [decoded(*row) for row in part.iloc[:, len(keep) :].itertuples(index=False, name=None)]
            made = pd.DataFrame([none if p is None else make(p) for p in found], columns=names, dtype=object)
            yield pd.concat([part.iloc[:, : len(keep)].reset_index(drop=True), made], axis=1)

    return pictures.select(*(f"`{c}`" for c in keep), *parts).mapInPandas(run, schema)


BOX = "array<struct<left:int,top:int,width:int,height:int,pixels:int,corners:int>>"
_BOX = ("left", "top", "width", "height", "pixels", "corners")


def picture_boxes(pictures: DataFrame, image: str = "image") -> DataFrame:
    """pictures plus boxes: the outermost connected edges of each picture."""
    return each_picture(pictures, f"boxes {BOX}", lambda p: ([dict(zip(_BOX, b)) for b in boxes(edges(grey(p))).tolist()],), image)


def is_form(box: Column) -> Column:
    """Whether a box has the size and shape of a form field."""
    aspect = box["width"] / box["height"]
    return (aspect > 1.5) & (aspect < 5) & (box["width"] > 100) & (box["height"] > 30)


def forms(boxes: Column) -> dict[str, Column]:
    """Number of boxes like form fields, whether there is one, and the number of four-cornered boxes."""
    n = F.size(F.filter(boxes, is_form))
    return {"form_count": n, "forms_detected": n > 0, "rectangles": F.size(F.filter(boxes, lambda b: b["corners"] == 4))}


def element_flags(pictures: DataFrame, brand: str, image: str = "image") -> DataFrame:
    """pictures plus shares of each brand colour, edge density, horizontal and vertical lines, and the flags that follow: a colour of
    the brand on over 5 %, many edges for a logo, two lines each way for a layout. A form is not told by these."""
    names = {n for colours in C.BRAND_COLOURS.values() for n in colours}
    ranges = {n: colours[n] for colours in C.BRAND_COLOURS.values() for n in colours}
    schema = ", ".join([*(f"{n}_share double" for n in sorted(names)), "edge_density double, horizontal_lines int, vertical_lines int"])

    def make(p: np.ndarray) -> tuple:
        found = edges(grey(p))
        parts = hue(p) if p.ndim == 3 else None
        shares = [0.0 if parts is None else _share(parts, *ranges[n]) for n in sorted(names)]
        return (*shares, float(found.mean()), lines(found), lines(found.T))

    out = each_picture(pictures, schema, make, image)
    match = F.lit(False)
    for name, colours in C.BRAND_COLOURS.items():
        hit = F.lit(False)
        for n in colours:
            hit = hit | (F.col(f"{n}_share") > 0.05)
        match = match | ((F.col(f"`{brand}`") == name) & hit)
    flag = lambda c: F.coalesce(c, F.lit(False))
    layout = (F.col("horizontal_lines") >= 2) & (F.col("vertical_lines") >= 2)
    return out.withColumns({"login_form": F.lit(False), "brand_logo": flag(F.col("edge_density") > 0.1), "color_scheme_match": flag(match), "layout_structure_match": flag(layout)})


def template_features(pictures: DataFrame, image: str = "image") -> DataFrame:
    """pictures plus the number of outermost shapes, edge density, mean and deviation of brightness, and the number of distinct colours."""

    def make(p: np.ndarray) -> tuple:
        gray = grey(p)
        found = edges(gray)
        return int(outermost(found).sum()), float(found.mean()), float(gray.mean()), float(gray.std()), colours(p)

    return each_picture(pictures, "contour_count int, edge_density double, brightness_mean double, brightness_std double, color_diversity int", make, image)


def colours(picture: np.ndarray) -> int:
    """The number of distinct colours."""
    wide = picture[:, :, None] if picture.ndim == 2 else picture
    code = sum(wide[:, :, i].astype(np.int32) << 8 * i for i in range(wide.shape[2]))
    first = np.ones(code.shape, bool)
    first[:, 1:] = code[:, 1:] != code[:, :-1]  # neighbours are often alike
    return len(np.unique(code[first]))


def colour_count(pictures: DataFrame, image: str = "image") -> DataFrame:
    """pictures plus the number of distinct colours."""
    return each_picture(pictures, "color_diversity int", lambda p: (colours(p),), image)
