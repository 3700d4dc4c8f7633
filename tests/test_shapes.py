"""Shapes in pictures, against flood fills and pixel loops."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.operators import shapes

own = np.random.default_rng(8)
rng = random.Random(4)


def drawn():
    """A picture of lines, filled and empty rectangles, discs and noise."""
    h, w = rng.randrange(1, 70), rng.randrange(1, 90)
    gray = np.full((h, w), rng.choice([0, 128, 255]), np.uint8)
    for _ in range(rng.randrange(6)):
        a, b, c, d = rng.randrange(h), rng.randrange(w), rng.randrange(1, 40), rng.randrange(1, 60)
        tone = rng.randrange(256)
        if rng.random() < 0.4:
            gray[a : a + c, b : b + d] = tone
        elif rng.random() < 0.5:
            part = gray[a : a + c, b : b + d].copy()
            gray[a : a + c, b : b + d] = tone
            gray[a + 1 : a + part.shape[0] - 1, b + 1 : b + part.shape[1] - 1] = part[1:-1, 1:-1]
        else:
            y, x = np.ogrid[:h, :w]
            gray[(y - a) ** 2 + (x - b) ** 2 < c * c] = tone
    if rng.random() < 0.3:
        gray = np.where(own.random(gray.shape) < 0.1, own.integers(0, 256, gray.shape), gray).astype(np.uint8)
    return gray


def flood(bitmap, diagonal=True):
    """Label of each set pixel, by flood fill; 0 elsewhere."""
    h, w = bitmap.shape
    label, n = np.zeros((h, w), int), 0
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    for r in range(h):
        for c in range(w):
            if bitmap[r, c] and not label[r, c]:
                n += 1
                label[r, c] = n
                todo = [(r, c)]
                while todo:
                    y, x = todo.pop()
                    for i, j in steps:
                        if 0 <= y + i < h and 0 <= x + j < w and bitmap[y + i, x + j] and not label[y + i, x + j]:
                            label[y + i, x + j] = n
                            todo.append((y + i, x + j))
    return label, n


def brute_edges(gray, low=50, high=150):
    h, w = gray.shape
    at = lambda r, c: int(gray[min(max(r, 0), h - 1), min(max(c, 0), w - 1)])
    dx, dy = np.zeros((h, w), int), np.zeros((h, w), int)
    for r in range(h):
        for c in range(w):
            for k, f in ((-1, 1), (0, 2), (1, 1)):
                dx[r, c] += f * (at(r + k, c + 1) - at(r + k, c - 1))
                dy[r, c] += f * (at(r + 1, c + k) - at(r - 1, c + k))
    size = abs(dx) + abs(dy)
    m = lambda r, c: size[r, c] if 0 <= r < h and 0 <= c < w else 0
    weak = np.zeros((h, w), bool)
    for r in range(h):
        for c in range(w):
            x, y, s = dx[r, c], dy[r, c], size[r, c]
            if s <= low:
                continue
            if abs(y) < 0.4142 * abs(x):
                weak[r, c] = s > m(r, c - 1) and s >= m(r, c + 1)
            elif abs(x) < 0.4142 * abs(y):
                weak[r, c] = s > m(r - 1, c) and s >= m(r + 1, c)
            else:
                d = -1 if (x < 0) != (y < 0) else 1
                weak[r, c] = s > m(r - 1, c - d) and s > m(r + 1, c + d)
    label, n = flood(weak)
    keep = {int(label[r, c]) for r in range(h) for c in range(w) if weak[r, c] and size[r, c] > high}
    return np.isin(label, list(keep)) & weak


def test_components_boxes_and_outer_shapes_are_those_of_flood_fills():
    for k in range(200):
        gray = drawn()
        bitmap = shapes.edges(gray) if k % 2 else own.random(gray.shape) < rng.choice([0.05, 0.3, 0.5, 0.8])
        label, n = flood(bitmap)
        (row, start, end), mine = shapes.components(bitmap)
        assert len(set(mine.tolist())) == n
        for r, a, b, i in zip(row, start, end, mine):
            assert (label[r, a:b] == i + 1).all()
        want = [(c.min(), r.min(), c.max() - c.min() + 1, r.max() - r.min() + 1, len(r)) for r, c in (np.nonzero(label == i + 1) for i in range(n))]
        assert [tuple(b[:5]) for b in shapes.boxes(bitmap, outer=False).tolist()] == want
        back, _ = flood(~np.pad(bitmap, 1), diagonal=False)
        outside = back == back[0, 0]
        near = outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:]
        near |= outside[:-2, :-2] | outside[:-2, 2:] | outside[2:, :-2] | outside[2:, 2:]
        assert shapes.outermost(bitmap).tolist() == [bool(near[label == i + 1].any()) for i in range(n)]


def test_edges_are_those_of_a_pixel_loop():
    for _ in range(40):
        gray = drawn()[:40, :50]
        assert (shapes.edges(gray) == brute_edges(gray)).all()


def test_lines_and_colours_are_those_of_pixel_loops():
    for _ in range(120):
        bitmap = own.random((rng.randrange(1, 40), rng.randrange(1, 120))) < 0.02
        for _ in range(rng.randrange(5)):
            r, c, n = rng.randrange(bitmap.shape[0]), rng.randrange(bitmap.shape[1]), rng.randrange(1, 100)
            for i in range(min(n, bitmap.shape[1] - c)):
                bitmap[min(r + i // 30, bitmap.shape[0] - 1), c + i] = rng.random() < 0.9
        closed = np.zeros_like(bitmap)
        for r, line in enumerate(bitmap):
            at = np.flatnonzero(line).tolist()
            groups = []
            for x in at:
                if groups and x - groups[-1][-1] - 1 <= 10:
                    groups[-1].append(x)
                else:
                    groups.append([x])
            for g in groups:
                if g[-1] - g[0] + 1 >= 5:
                    closed[r, g[0] : g[-1] + 1] = True
        label, n = flood(closed)
        spans = [(np.ptp(c) + 1, np.ptp(r) + 1) for r, c in (np.nonzero(label == i + 1) for i in range(n))]
        assert shapes.lines(bitmap) == sum(w >= 50 and h < 5 for w, h in spans)
    import colorsys

    picture = own.integers(0, 256, (30, 40, 3)).astype(np.uint8)
    share = 0
    for b, g, r in picture.reshape(-1, 3).tolist():
        h, s, v = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        share += 100 <= int(h * 180 + 0.5) % 180 <= 140 and 150 <= int(s * 255 + 0.5) and 50 <= round(v * 255)
    assert abs(shapes.colour_share(picture, (100, 150, 50), (140, 255, 255)) - share / 1200) < 2 / 1200


def test_corners():
    y, x = np.mgrid[:80, :80]
    assert shapes.corners_of(np.array([[0, 0], [9, 0], [9, 5], [0, 5], [4, 0], [9, 2]])) == 4
    assert shapes.corners_of(np.argwhere(x + y < 60)) == 3 and shapes.corners_of(np.argwhere((x - 40) ** 2 + (y - 40) ** 2 < 900)) > 6
    assert shapes.corners_of(np.array([[3, 3]])) == 1 and shapes.corners_of(np.array([[3, 3], [3, 9], [3, 4]])) == 2


def test_pictures_without_pixels_and_other_columns(spark):
    image = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    gray = np.full((60, 160), 255, np.uint8)
    gray[10:50, 20:140] = 0
    rows = [(1, ("a", 60, 160, 1, 0, gray.tobytes()), 5, "x"), (2, None, 6, "y"), (3, ("b", 9, 9, 3, 16, b"abc"), None, "z"), (4, ("c", 0, 0, 1, 0, b""), 1, None), (5, ("d", 1, 1, 3, 16, b"\1\2\3"), 1, "w")]
    pictures = spark.createDataFrame(rows, f"k int, {image}, Boxes int, brand string")
    got = {r.k: r for r in shapes.picture_boxes(pictures).withColumns(shapes.forms(F.col("boxes"))).collect()}
    assert [tuple(b) for b in got[1].boxes] == [(19, 9, 121, 41, 316, 4)] and (got[1].form_count, got[1].rectangles) == (1, 1)
    assert got[2].boxes is got[3].boxes is got[4].boxes is None and got[5].boxes == []
    flags = {r.k: r for r in shapes.element_flags(pictures, "brand").collect()}
    assert (flags[1].horizontal_lines, flags[1].vertical_lines, flags[1].layout_structure_match) == (2, 0, False) and flags[2].brand_logo is False
    assert collections.Counter(r.contour_count for r in shapes.template_features(pictures).collect()) == {1: 1, None: 3, 0: 1}
    assert {r.k: r.color_diversity for r in shapes.colour_count(pictures).collect()} == {1: 2, 2: None, 3: None, 4: None, 5: 1}
    assert shapes.picture_boxes(pictures.limit(0)).collect() == []


def test_outlines_see_few_points(monkeypatch):
    """Corners are those of all pixels of a component; straight sides give their ends alone, however long they are."""
    rng = np.random.default_rng(8)
    bitmaps = [np.kron(rng.random((14, 11)) < share, np.ones((1, wide), bool)) > 0 for share in (0.1, 0.4, 0.6, 0.9) for wide in (1, 2, 3) for _ in range(8)]
    bars = np.tile(np.arange(96) % 4 == 1, (300, 1))
    whole = shapes.corners_of
    for bitmap in [*bitmaps, bars]:
        (row, start, end), own = shapes.components(bitmap)
        pixels = [np.array([(x, r) for r, a, b in zip(row[own == i], start[own == i], end[own == i]) for x in range(a, b)]) for i in range(own.max() + 1)]
        assert shapes.boxes(bitmap, outer=False)[:, 5].tolist() == [whole(p) for p in pixels]
    seen = []
    monkeypatch.setattr(shapes, "corners_of", lambda p: seen.append(len(p)) or whole(p))
    assert len(shapes.boxes(bars)) == 24 and max(seen) <= 4
