"""Similar names as a join: an index of tokens and letter pairs gives the candidates, matching blocks their ratio.

The ratio of two texts is twice the letters in their matching blocks over all their letters. The token-set ratio of two names is the
best of three: of the shared tokens and either name (shared tokens first, then its others), and of both names so ordered. A
pair of a ratio of r or more has one of two signs, and each is found by an equi-join, whatever the size of both sides:

* Its shared tokens make up r / (2 - r) of the letters of one name. Then the names share one of that name's first tokens in one order
  of all tokens, those taken until what is left is too little.
* The texts differ by at most (1 - r) of their letters. Each letter put in takes away one pair of neighbouring letters, each taken
  out two, and the pairs of a name padded by blanks do not depend on the order of its tokens. So both hold a number of equal pairs
  that follows from their lengths, and share one of their first pairs in one order of all pairs.

Both orders put the most common elements last. Any order gives the same result.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import spread

#: elements that are put last; rows up to which the counted side of a join is broadcast
COMMON, BROADCAST_ROWS = 128, 200_000


def matched(a: str, b: str) -> int:
    """Letters in the matching blocks of two texts: the longest common part (the first in a, then in b), and so on left and right of it."""
    return sum(block.size for block in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def at_most(a: str, b: str) -> float:
    """A bound of the ratio: all letters that both texts hold."""
    if len(a) > len(b):
        a, b = b, a
    return 2 * sum(min(a.count(c), b.count(c)) for c in set(a)) / (len(a) + len(b)) if a or b else 1.0


def ratio(a: str, b: str) -> float:
    """2 m / n for m matching of n letters; 1 of two empty texts."""
    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: list[str], b: list[str], least: float = 0) -> int:
    """Token-set ratio of two sorted lists of distinct tokens, as a whole percentage; one below `least` may come out as 0."""
    both = " ".join(t for t in a if t in b)
    one, two = (" ".join(filter(None, [both, " ".join(t for t in x if t not in y)])) for x, y in ((a, b), (b, a)))
    pairs = [(both, one), (both, two), (one, two)] if both else [(one, two)]
    return max((round(100 * ratio(p, q)) for p, q in pairs if p and q and round(100 * at_most(p, q)) >= least), default=0) if one and two else 0


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(name: Column) -> Column:
    """Sorted distinct words of letters, digits and underscores, lower-cased."""
    parts = F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != "")))


def letter_pairs(words: Column) -> Column:
    """The pairs of neighbouring letters of words padded by blanks, the n-th equal pair marked by n."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(2)))
    marked = lambda pairs: F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == p)).cast("string")))
    return let(F.flatten(F.transform(words, of)), marked)


def _common(of: DataFrame, column: str) -> list[str]:
    """The most common elements of a list column, at most COMMON."""
    found = of.select(F.explode_outer(column).alias("e")).filter("e is not null").groupBy("e").count().orderBy(F.desc("count"), "e").limit(COMMON).collect()
    return [r["e"] for r in found]


def _in_order(elements: Column, common: list[str]) -> Column:
    place = F.array(*[F.lit(c) for c in reversed(common)]) if common else F.array().cast("array<string>")
    keyed = F.transform(elements, lambda e: F.struct(F.array_position(place, e).alias("p"), F.xxhash64(e).alias("h"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def _until(words: Column, left: Column) -> Column:
    """The first words, until the others with their blanks are shorter than `left`."""
    weight = lambda ws: F.aggregate(ws, F.lit(0), lambda s, w: s + F.length(w) + 1)
    return let(words, lambda ws: F.filter(ws, lambda w, i: weight(F.slice(ws, i + 1, F.greatest(F.size(ws) - i, F.lit(0)))) >= left))


def _met(left: DataFrame, right: DataFrame, on: tuple[str, str], within: Column | None = None, size: int = 0) -> DataFrame:
    """(l, r): pairs of keys with an equal element. An outer explode: of a plain one Spark tests the list's size before rows are dealt."""
    a = left.select("l", "lw", F.explode_outer(on[0]).alias("le"))
    b = right.select("r", "rw", F.explode_outer(on[1]).alias("re"))
    b = F.broadcast(b) if size <= BROADCAST_ROWS else b
    same = F.col("le") == F.col("re")
    return a.join(b, same if within is None else same & within).select("l", "r")


def candidates(left: DataFrame, right: DataFrame, least: float, words) -> DataFrame:
    """(l, r): pairs of the distinct texts l of left and r of right that hold all of a ratio of `least` or more, over the tokens that
    `words` makes of a text."""
    share = least / (2 - least)
    a, b = (spread(df.select(k), k).distinct().withColumn(f"{k}t", words(F.col(k))).withColumns({f"{k}p": letter_pairs(F.col(f"{k}t"))}).withColumn(f"{k}w", F.greatest(F.size(f"{k}p"), F.lit(0))) for df, k in ((left, "l"), (right, "r")))
    size = b.agg(F.sum("rw")).first()[0] or 0  # letter pairs: what the broadcast side holds at most
    often, words_often = _common(b, "rp"), _common(b, "rt")
    # equal pairs of two texts that differ enough: (w + v - 3 d) / 2 for d = (1 - least) (w + v - 2) letters, and v at least share * (w - 1) + 1
    need = lambda w: F.greatest(F.ceil((w + share * (w - 1) + 1) * (1 - 3 * (1 - least)) / 2 + 3 * (1 - least) - 1e-6), F.lit(1))
    both = []
    for df, k in ((a, "l"), (b, "r")):
        w = F.col(f"{k}w")
        df = df.withColumns({f"{k}p": _in_order(F.col(f"{k}p"), often), f"{k}t": _in_order(F.col(f"{k}t"), words_often)})
        both.append(df.withColumns({f"{k}f": F.slice(f"{k}p", F.lit(1), F.greatest(w - need(w) + 1, F.lit(0)).cast("int")), f"{k}u": _until(F.col(f"{k}t"), share * (w - 1) + 1 - 1e-6)}))
    x, y = both
    near = (F.col("lw") - 1 >= share * (F.col("rw") - 1) - 1e-6) & (F.col("rw") - 1 >= share * (F.col("lw") - 1) - 1e-6)
    found = [_met(x, y, ("lf", "rf"), near, size), _met(x, y, ("lu", "rt"), None, size), _met(x, y, ("lt", "ru"), None, size)]
    return spread(found[0].unionByName(found[1]).unionByName(found[2]), "l", "r").distinct()


def token_set_pairs(left: DataFrame, right: DataFrame, threshold: float = 80) -> DataFrame:
    """(l, r, ratio): pairs of distinct names of left (l) and right (r) whose token-set ratio, a whole percentage, reaches threshold (over
    50). Null names and names without a word have no pairs."""

    @F.pandas_udf("int")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(sorted(x), sorted(y), threshold) for x, y in zip(a, b)], dtype="int32")

    found = candidates(left, right, (threshold - 0.5) / 100, tokens)
    return found.withColumn("ratio", scored(tokens(F.col("l")), tokens(F.col("r")))).filter(F.col("ratio") >= threshold)


def text_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(l, r, ratio): pairs of distinct texts whose ratio, upper and lower case alike, reaches threshold (over 0.5). Null and empty texts have
    no pairs."""

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) if at_most(x, y) >= threshold - 1e-12 else 0.0 for x, y in zip(a, b)], dtype="float64")

    whole = lambda t: F.filter(F.array(F.lower(t)), lambda w: F.length(w) > 0)
    return candidates(left, right, threshold, whole).withColumn("ratio", scored(F.lower("r"), F.lower("l"))).filter(F.col("ratio") >= threshold - 1e-12)


def best_reference(names: DataFrame, reference: DataFrame, threshold: float = 80) -> DataFrame:
    """(domain, brand, ratio) for each distinct name: the reference (domain, name, ord) of the best token-set ratio that reaches threshold,
    the first of equals; null and 0 without one."""
    listed = reference.select(F.col("domain").alias("r"), F.col("name").alias("brand"), "ord")
    pairs = token_set_pairs(names.select(F.col("domain").alias("l")), listed.select("r"), threshold)
    best = pairs.join(listed, "r").groupBy("l").agg(F.max_by(F.struct("brand", "ratio"), F.struct("ratio", -F.col("ord"))).alias("x")).select(F.col("l").alias("_l"), "x.*")
    found = names.select("domain").distinct().join(best, F.col("domain").eqNullSafe(F.col("_l")), "left")
    return found.select("domain", "brand", F.coalesce("ratio", F.lit(0)).cast("double").alias("ratio"))
