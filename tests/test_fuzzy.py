"""Similar names by a join, against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import fuzzy

rng = random.Random(3)
BASE = ["onlinesbi", "hdfcbank", "icici", "irctc", "railway", "gov", "portal", "secure", "login", "pnb", "kyc", "a", "bb", "co", "in", "com", "net", "é", "नाम"]


def name():
    out = [rng.choice(BASE) for _ in range(rng.randrange(1, 5))]
    text = "".join(x + rng.choice([".", "-", "_", " ", "--"]) for x in out).rstrip(".- ")
    for _ in range(rng.choice([0, 0, 1, 2, 3])):
        at = rng.randrange(len(text) + 1)
        text = text[:at] + rng.choice(["", "x", "i", "1", "-"]) + text[at + rng.randrange(2) :]
    return text.upper() if rng.random() < 0.1 else text


def test_matching_blocks_are_those_of_the_library():
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc.é") for _ in range(rng.randrange(14))) for _ in range(2))
        assert fuzzy.ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio()


def split(text):
    import re

    return sorted(set(re.sub(r"\W+", " ", text.lower()).split()))


def test_token_set_pairs_are_those_of_all_pairs(spark):
    left, right = ([*{name() for _ in range(1100)}][:1000] for _ in range(2))
    left += ["", "--", "a", "sbi.co.in"]
    right += ["", "a", "sbi.co.in portal of a long name"]
    words = {t: split(t) for t in [*left, *right]}
    want = {}
    cache = {}
    for a in left:
        for b in right:
            x, y = words[a], words[b]
            key = (tuple(x), tuple(y))
            if key not in cache:
                cache[key] = 0
                if x and y:
                    both = " ".join(t for t in x if t in y)
                    one, two = (" ".join(filter(None, [both, " ".join(t for t in p if t not in q)])) for p, q in ((x, y), (y, x)))
                    for p, q in ([(both, one), (both, two)] if both else []) + [(one, two)]:
                        m = SequenceMatcher(None, p, q, autojunk=False)
                        if m.real_quick_ratio() >= 0.79 and m.quick_ratio() >= 0.79:
                            cache[key] = max(cache[key], round(100 * m.ratio()))
            if cache[key] >= 80:
                want[a, b] = cache[key]
    frames = [spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], f"{k} string") for texts, k in ((left, "l"), (right, "r"))]
    got = fuzzy.token_set_pairs(*frames)
    rows = got.collect()
    assert {(r.l, r.r): r.ratio for r in rows} == want and len(rows) == len(want) > 500
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_text_pairs_are_those_of_all_pairs(spark, threshold):
    left, right = [*{name() for _ in range(250)}], [*{name() for _ in range(250)}, "", "x"]
    want = {(a, b): r for a in left for b in right if a and b and (r := SequenceMatcher(None, b.lower(), a.lower(), autojunk=False).ratio()) >= threshold}
    got = fuzzy.text_pairs(spark.createDataFrame([(t,) for t in left], "l string"), spark.createDataFrame([(t,) for t in [*right, None]], "r string"), threshold).collect()
    assert {(r.l, r.r): r.ratio for r in got} == want and len(got) == len(want) > 0


def test_joins_without_broadcast_and_empty_sides(spark, monkeypatch):
    names = spark.createDataFrame([(name(),) for _ in range(200)], "l string")
    others = names.select(F.col("l").alias("r"))
    want = sorted(map(tuple, fuzzy.token_set_pairs(names, others).collect()))
    monkeypatch.setattr(fuzzy, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(fuzzy, "COMMON", 3)  # another order of all elements
    assert sorted(map(tuple, fuzzy.token_set_pairs(names, others).collect())) == want
    assert fuzzy.token_set_pairs(names.limit(0), others).collect() == fuzzy.token_set_pairs(names, others.limit(0)).collect() == []


def test_the_first_of_the_best_references(spark):
    reference = spark.createDataFrame([("state bank", "A", 0), ("bank state", "B", 1), ("rail", "C", 2), ("state.bank", "D", 3)], "domain string, name string, ord int").withColumn("ratio", F.lit("x"))
    names = ["bank-state", "state.bank.login", "rial", "rails", "", None]
    got = {r.domain: (r.brand, r.ratio) for r in fuzzy.best_reference(spark.createDataFrame([(n,) for n in [*names, "rial"]], "domain string"), reference).collect()}
    assert got == {"bank-state": ("A", 100.0), "state.bank.login": ("A", 100.0), "rial": (None, 0.0), "rails": ("C", 89.0), "": (None, 0.0), None: (None, 0.0)}


def test_long_work_comes_after_rows_are_dealt(spark):
    """Lists of letters are made in the tasks that names are dealt to, not in the one that reads a small table."""
    from lurewatch.operators import rules

    names = spark.createDataFrame([("sbi.co.in",), ("login-sbi.in",), (None,)], "domain string").coalesce(1)
    left, right = (names.select(F.col("domain").alias(k)) for k in "lr")
    found = [rules.homoglyphs(names), fuzzy.candidates(left, right, 0.8, fuzzy.tokens)]
    for df in found:
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        below = 0  # indent of the last repartition above a line
        for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n"):
            depth = len(line) - len(line.lstrip(" :+-"))
            if below and depth > below:
                assert "lambda" not in line, line
            else:
                below = depth if "RepartitionByExpression [domain" in line or "RepartitionByExpression [l#" in line and ", r#" not in line else 0
    assert {r.variant for r in found[0].filter("domain is null").collect()} == {None}
    assert fuzzy.token_set_ratio(["abc"], ["xyz"], 80) == 0 and fuzzy.at_most("abca", "aab") == 2 * 3 / 7
