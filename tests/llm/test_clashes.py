"""Filters of the pipeline leave columns of any name alone."""

import random

from pyspark.sql import functions as F

from lurewatch.llm import decontaminate, simhash

rng = random.Random(2)
NAMES = ("__h", "__k", "__d", "__D", "n", "x", "root", "node", "text_hash", "component_id", "__t", "fp", "___h")


def test_columns_with_the_names_of_helpers(spark):
    words = [f"w{i}" for i in range(200)]
    base = " ".join(rng.choice(words) for _ in range(100))
    texts = [base, base, base + " tail", " ".join(rng.choice(words) for _ in range(80)), None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    wide = docs
    for n in NAMES:
        if n.lower() not in [c.lower() for c in wide.columns]:
            wide = wide.withColumn(n, F.col("doc_id") * 7)
    items = spark.createDataFrame([(1, " ".join(texts[3].split()[10:40]))], "item_id long, text string")
    for f in (simhash.keep_one, lambda d: decontaminate.keep_clean(d, items)):
        plain, rich = f(docs), f(wide)
        assert rich.columns == wide.columns
        got = sorted((r.doc_id, r["__k"], r["n"]) for r in rich.collect())
        assert [i for i, *_ in got] == sorted(r.doc_id for r in plain.collect()) and all(a == b == 7 * i for i, a, b in got)
        assert len(got) < len(texts)
