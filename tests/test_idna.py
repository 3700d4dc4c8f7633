"""Names as they are looked up, against the codec."""

import random

from pyspark.sql import functions as F

from lurewatch import constants as C
from lurewatch.operators import idna

rng = random.Random(12)


def codec(name):
    try:
        return name if name.isascii() else name.encode("idna").decode()
    except UnicodeError:
        return None


def test_as_the_codec(spark):
    letters = "abcxyz0189-" + "".join(C.CONFUSABLES.values()) + "ÄÖÜßøłŁıİΣςéÉ漢字かなカﬁ２Ａ한글אבع­"
    names = {"", ".", "a", "ü", "ü.", "a..ü", ".ü", "xn--ü.de", "bücher.de", "аpple.com", "x" * 60 + "ü.in", "x" * 56 + "ü.in", "ü。de", " ü", "π" * 50}
    while len(names) < 10_000:
        few = rng.sample(letters, 6) + list("abc")
        names.add(".".join("".join(rng.choice(rng.choice([few, letters])) for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 4))))
    df = spark.createDataFrame([(n,) for n in sorted(names)] + [(None,)], "name string").repartition(8)
    made = df.select("name", idna.to_ascii(F.col("name")).alias("ascii"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    wrong = [(r.name, r.ascii, codec(r.name)) for r in made.collect() if r.name is not None and r.ascii != codec(r.name)]
    assert wrong == []
    assert [r.ascii for r in made.filter("name is null").collect()] == [None]
    some = [codec(n) for n in names]
    assert sum(x is not None for x in some) > 3000


def test_values(spark):
    want = {"bücher.de": "xn--bcher-kva.de", "аpple.com": "xn--pple-43d.com", "plain.in": "plain.in", "MÜNCHEN.de": "xn--mnchen-3ya.de", "straße.de": "strasse.de", "中国.cn": "xn--fiqs8s.cn", "a..ü": None, "é.de": None}
    got = spark.createDataFrame([(n,) for n in want], "name string").select("name", idna.to_ascii(F.col("name")).alias("x")).collect()
    assert {r.name: r.x for r in got} == want
