"""Internationalised names as they are looked up: preparation and the Bootstring coder, in Column functions alone.

A label's letters beyond ASCII are put in by code point, then by place. Each step is the distance, in a count over code points and
places, from the step before, written in digits whose thresholds follow the steps so far: a fold over the sorted letters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fuzzy import let

#: fixed values of the coder: digits, thresholds, damping, skew, first bias, first code point
BASE, LEAST, MOST, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: scripts written from right to left
_RIGHT = "֐-ࣿיִ-﷿ﹰ-ﻼ"


def _prepared(c: str) -> str | None:
    """What preparation makes of one character; None if no name may hold it."""
    import stringprep as P

    if P.in_table_b1(c):
        return ""
    out = unicodedata.ucd_3_2_0.normalize("NFKC", P.map_table_b2(c))
    bad = (P.in_table_c12, P.in_table_c22, P.in_table_c3, P.in_table_c4, P.in_table_c5, P.in_table_c6, P.in_table_c7, P.in_table_c8, P.in_table_c9)
    return None if any(t(x) for x in out for t in bad) else out


@lru_cache(1)
def _tables() -> tuple[str, str, str, dict[str, str], str]:
    """Characters that become one other, what they become, those that go, those that become several, those that no name may hold."""
    one, to, gone, several, bad = [], [], [], {}, []
    for n in range(0x80, 0x10000):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        p = _prepared(c)
        if p is None:
            bad.append(c)
        elif p == "":
            gone.append(c)
        elif len(p) > 1:
            several[c] = p
        elif p != c:
            one.append(c)
            to.append(p)
    return "".join(one), "".join(to), "".join(gone), several, "".join(bad)


def _ranges(characters: list[str]) -> str:
    """Characters as the ranges of a pattern's class."""
    out: list[list[int]] = []
    for n in sorted(map(ord, characters)):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in out)


def prepared(label: Column) -> Column:
    """Lower-cased and normalised label; null if it holds a character that no name may hold, a combining mark (which may merge with
    the letter before), a sign beyond Armenian that stands for several letters, or a character beyond the first 65,536."""
    one, to, gone, several, bad = _tables()
    low = F.translate(label, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + one + gone, "abcdefghijklmnopqrstuvwxyz" + to)
    near = [c for c in several if ord(c) < 0x590 or 0xFB00 <= ord(c) < 0xFB18]
    for c in near:
        low = F.replace(low, F.lit(c), F.lit(several[c]))
    unfit = _ranges([*bad, *(c for c in several if c not in near)])
    unfit = label.rlike(f"[{unfit}\\p{{M}}\\x{{10000}}-\\x{{10FFFF}}]")
    right = lambda x: x.rlike(f"[{_RIGHT}]") & (x.rlike(f"[\\p{{L}}&&[^{_RIGHT}]]") | ~x.rlike(f"^[{_RIGHT}]") | ~x.rlike(f"[{_RIGHT}]$"))
    moved = _ranges([*one, *gone, *several, *bad])
    odd = F.regexp_replace(label, "[\\x00-@\\[-\\x7f]+", "")  # a pattern of many ranges is slow, and few letters are not plain
    stays = ~odd.rlike(f"[A-Z{moved}\\p{{M}}{_RIGHT}\\x{{10000}}-\\x{{10FFFF}}]")  # most labels, at the price of one pattern
    return F.when(stays, label).otherwise(let(F.when(~unfit, low), lambda x: F.when(~right(x), x)))


def _long(x) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def _written(delta: Column, bias: Column) -> Column:
    """A step as digits."""

    def digit(s: Column, k: Column) -> Column:
        t = F.least(F.greatest(k * BASE - bias, _long(LEAST)), _long(MOST))
        last = s["q"] < t
        value = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (BASE - t))
        more = F.concat(s["out"], F.substr(F.lit(_DIGITS), (value + 1).cast("int"), F.lit(1)))
        return F.when(s["done"], s).otherwise(F.struct(_long(F.floor((s["q"] - t) / (BASE - t))).alias("q"), last.alias("done"), more.alias("out")))

    start = F.struct(_long(delta).alias("q"), F.lit(False).alias("done"), F.lit("").alias("out"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(9)), _long), start, digit, lambda s: s["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a step."""
    d = _long(F.floor(delta / F.when(first, DAMP).otherwise(2)))
    start = F.struct(_long(d + F.floor(d / points)).alias("d"), _long(0).alias("k"))
    limit = (BASE - LEAST) * MOST // 2
    shrunk = lambda s, _: F.when(s["d"] > limit, F.struct(_long(F.floor(s["d"] / (BASE - LEAST))).alias("d"), _long(s["k"] + BASE).alias("k"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, shrunk, lambda s: _long(s["k"] + F.floor((BASE - LEAST + 1) * s["d"] / (s["d"] + SKEW))))


def bootstring(label: Column) -> Column:
    """A label's ASCII letters, a hyphen if there are any, and the steps that put in the others."""
    letters = F.filter(F.split(label, ""), lambda c: c != "")
    return let(F.transform(letters, lambda c, i: F.struct(_long(F.ascii(c)).alias("c"), _long(i).alias("at"), c.alias("text"))), _steps)


def _steps(placed: Column) -> Column:
    basic = F.array_join(F.transform(F.filter(placed, lambda x: x["c"] < FIRST), lambda x: x["text"]), "")
    put_in = F.array_sort(F.filter(placed, lambda x: x["c"] >= FIRST))

    def step(s: Column, x: Column) -> Column:
        place = _long(F.size(F.filter(placed, lambda y: (y["at"] < x["at"]) & (y["c"] <= x["c"]))))
        moved = let(F.struct(place.alias("place"), ((x["c"] - s["n"]) * (s["h"] + 1) + place - s["i"]).alias("delta")), lambda m: F.struct(
            x["c"].alias("n"), _long(m["place"] + 1).alias("i"), _long(s["h"] + 1).alias("h"), _adapted(m["delta"], s["h"] + 1, s["first"]).alias("bias"),
            F.lit(False).alias("first"), F.concat(s["out"], _written(m["delta"], s["bias"])).alias("out"),
        ))
        return moved

    start = F.struct(_long(FIRST).alias("n"), _long(0).alias("i"), _long(F.length(basic)).alias("h"), _long(BIAS).alias("bias"), F.lit(True).alias("first"), F.when(F.length(basic) > 0, F.concat(basic, F.lit("-"))).otherwise("").alias("out"))
    return F.aggregate(put_in, start, step, lambda s: s["out"])


def to_ascii(name: Column) -> Column:
    """The name that is looked up: an ASCII name as it is, else label by label; null where a label is empty (but for the last), longer than
    63 letters, or cannot be encoded, and for a null name."""
    labels = F.split(name, "[.\\u3002\\uFF0E\\uFF61]")
    last = F.size(labels) - 1

    plain = "^[\\x00-\\x7f]*$"

    def one(label: Column, i: Column) -> Column:
        ready = F.when(label.rlike(plain), label).otherwise(prepared(label))
        coded = let(ready, lambda x: F.when(x.rlike(plain), x).when(~F.startswith(x, F.lit("xn--")), F.concat(F.lit("xn--"), bootstring(x))))
        return let(coded, lambda x: F.when(F.length(x).between(F.when((i == last) & (label == ""), 0).otherwise(1), 63), x))

    whole = let(F.transform(labels, one), lambda ls: F.when(~F.exists(ls, lambda c: c.isNull()), F.array_join(ls, ".")))
    return F.when(name.rlike(plain), name).otherwise(whole)
