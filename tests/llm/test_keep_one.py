"""keep_one compares the documents with the rows that go, not with those that stay."""

import random

from pyspark.sql import functions as F

from lurewatch.llm import simhash


def test_keep_one_looks_up_what_goes(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, texts[3]), (101, texts[3]), (102, texts[7] + " tail"), (9, texts[9]), (9, texts[9]), (9, texts[11]), (None, texts[12]), (None, None), (None, ""), (103, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    looked_up = []
    sized = simhash.sized
    monkeypatch.setattr(simhash, "sized", lambda df, n: looked_up.append((df.columns, n)) or sized(df, n))
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    stay = [(9 if i == 11 else i, t) for i, t in enumerate(texts)]  # the text of doc 11 is that of a doc 9 too
    assert kept == sorted([*stay, (103, " ")], key=str)
    by_key = [n for columns, n in looked_up if columns == ["__k", "__h"] or columns == ["__k", "__h", "n"]]
    # two exact copies, a near one, doc 11, three null ids, and the row of doc 9 that repeats, which is looked up again
    assert by_key == [8, 1]


def test_keep_one_when_nothing_goes(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(5)], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 5
    assert simhash.keep_one(docs.filter(F.lit(False))).count() == 0
