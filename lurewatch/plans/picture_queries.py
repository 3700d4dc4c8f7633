"""Queries over pictures: shapes, lines and colours are found in pixels, and checked by the geometry that was drawn."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import shapes as P
from ..operators import visual as VI
from ..sources.fixtures import pictures
from . import sqltext as S
from .registry import query

SCREENS = S.fixture("screens")
#: an edge stands on the last pixel before a filled rectangle and on its last one; its four corners are rounded off
_DRAWN = " UNION ALL ".join(f"SELECT k, x{i} - 1 AS l, y{i} - 1 AS t, w{i} + 1 AS w, h{i} + 1 AS h, 2 * (w{i} + h{i} - 2) AS n, 4 AS corners FROM {SCREENS} s WHERE look <> 'striped'" for i in (1, 2))
_DRAWN += f" UNION ALL SELECT k, 4 * j - 1, 0, 1, 200, 200, 2 FROM {SCREENS} s, (SELECT unnest(range(1, 75)) AS j) j WHERE look = 'striped'"
_FORM = "w / CAST(h AS DOUBLE) > 1.5 AND w / CAST(h AS DOUBLE) < 5 AND w > 100 AND h > 30"


@query("picture_boxes", "SELECT k, " + ", ".join(f"CAST({a} AS INT) AS {b}" for a, b in zip(("l", "t", "w", "h", "n", "corners"), ("x", "y", "width", "height", "pixels", "corners"))) + f" FROM ({_DRAWN}) d")
def picture_boxes(spark, sf):
    found = P.picture_boxes(pictures(spark, sf)).select("k", F.explode("boxes").alias("b"))
    return found.select("k", F.col("b.left").alias("x"), F.col("b.top").alias("y"), *(f"b.{c}" for c in ("width", "height", "pixels", "corners")))


@query("form_rectangles", f"SELECT k, CAST(count(*) FILTER ({_FORM}) AS INT) AS form_count, count(*) FILTER ({_FORM}) > 0 AS forms_detected, CAST(count(*) FILTER (corners = 4) AS INT) AS rectangles FROM ({_DRAWN}) d GROUP BY k")
def form_rectangles(spark, sf):
    return P.picture_boxes(pictures(spark, sf)).select("k", *(c.alias(n) for n, c in P.forms(F.col("boxes")).items()))


_EDGES = f"(SELECT k AS j, sum(n) / 60000.0 AS density, count(*) AS shapes FROM ({_DRAWN}) d GROUP BY k)"
_SHARE = lambda c: f"CASE WHEN look = '{c}' THEN w1 * h1 / 60000.0 ELSE 0 END"
_LONG = lambda n: " + ".join(f"CAST({n}{i} - {d} >= 50 AS INT)" for i in (1, 2) for d in (0, 2))  # noqa: E731  the left and upper sides are two pixels shorter
_ACROSS, _DOWN = (f"CASE WHEN look = 'striped' THEN {striped} ELSE {_LONG(n)} END" for striped, n in ((0, "w"), (74, "h")))
_MATCH = " OR ".join(f"brand = {S.q(b)} AND {_SHARE(c)} > 0.05" for b, cs in C.BRAND_COLOURS.items() for c in cs)


@query(
    "element_flags",
    f"SELECT k, brand, {S.r6(_SHARE('blue'))} AS blue_share, {S.r6(_SHARE('orange'))} AS orange_share, {S.r6('density')} AS edge_density, CAST({_ACROSS} AS INT) AS horizontal_lines, CAST({_DOWN} AS INT) AS vertical_lines, "
    f"false AS login_form, density > 0.1 AS brand_logo, {_MATCH} AS color_scheme_match, {_ACROSS} >= 2 AND {_DOWN} >= 2 AS layout_structure_match FROM {SCREENS} s JOIN {_EDGES} e ON k = j",
)
def element_flags(spark, sf):
    found = P.element_flags(pictures(spark, sf).drop("look"), "brand")
    return found.withColumns({c: F.round(c, 6) for c in ("blue_share", "orange_share", "edge_density")})


_GREY = {"blue": 64, "orange": 156, "grey": 120}
_MEAN = f"CASE WHEN look = 'striped' THEN 255.0 * 148 / 300 ELSE (255.0 * (60000 - w1 * h1 - w2 * h2) + w1 * h1 * CASE look {' '.join(f'WHEN {S.q(c)} THEN {v}' for c, v in _GREY.items())} END + 50 * w2 * h2) / 60000 END"


@query("template_features", f"SELECT k, CAST(shapes AS INT) AS contour_count, {S.r6('density')} AS edge_density, {S.r6(_MEAN)} AS brightness_mean, CASE WHEN look = 'striped' THEN 2 ELSE 3 END AS color_diversity FROM {SCREENS} s JOIN {_EDGES} e ON k = j")
def template_features(spark, sf):
    found = P.template_features(pictures(spark, sf).select("k", "image"))
    return found.select("k", "contour_count", F.round("edge_density", 6).alias("edge_density"), F.round("brightness_mean", 6).alias("brightness_mean"), "color_diversity")


_TEXTS = "split_part('Sign In Email Continue|Welcome|Your PASSWORD is secure||Enter passcode', '|', CAST(k % 5 + 1 AS INT))"


@query("ui_elements", f"SELECT k, {', '.join((S.any_of('lower(x)', ws) + (' OR two' if n == 'login_form' else '')) + ' AS ' + n for n, ws in VI._UI.items())} FROM (SELECT k, {_TEXTS} AS x, look <> 'striped' AS two FROM {SCREENS} d) t")
def ui_elements(spark, sf):
    """Elements by the texts of a screenshot and by the rectangles found in it."""
    found = P.picture_boxes(pictures(spark, sf)).withColumn("rectangles", P.forms(F.col("boxes"))["rectangles"])
    return found.select("k", *(x.alias(n) for n, x in VI.ui_elements(F.split(F.expr(_TEXTS), " "), F.col("rectangles")).items()))
