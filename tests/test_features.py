"""Hand-derived values and properties of the features and helpers."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pytest import approx
from pyspark.sql import functions as F

from lurewatch.operators import evaluate, lexical, network, normalize, rules, store


def test_golden(spark):
    df = spark.createDataFrame([("sbi-login-secure.xyz",), ("sbi.co.in",), ("localhost",), (None,)], "domain string")
    a, b, c, d = lexical.features(df).collect()
    assert (a.domain_length, a.num_hyphens, a.subdomain_count, a.brand_keyword_position, a.registered_domain_length, a.is_malicious_gtld, a.has_login, a.has_secure) == (20, 2, 0, 1, 20, 1, 1, 1)
    assert a.brand_to_reg_length_ratio == 0.15
    assert (b.registered_domain_length, b.subdomain_count, b.brand_keyword_position, b.has_cse_keyword_in_subdomain, b.brand_to_reg_length_ratio) == (5, 1, 2, 1, 0.6)
    assert (b.suspicious_trigram_count, b.unique_trigram_ratio, b.max_repeated_trigram) == (0, 0, 0)
    assert (c.registered_domain_length, c.tld_length, c.brand_to_reg_length_ratio) == (9, 0, 0.0)
    assert d.domain_length == 0 and d.min_brand_levenshtein == 99.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(st.text(alphabet="abcxyz019.-_/é", max_size=40), min_size=1, max_size=20))
def test_ranges(spark, names):
    for r in lexical.features(spark.createDataFrame([(n,) for n in names], "domain string")).collect():
        assert all(0 <= r[c] <= 1 for c in lexical.FEATURES if c.endswith("_ratio") and c != "brand_to_reg_length_ratio")
        assert -1e-6 <= r.entropy <= math.log2(max(r.domain_length, 1)) + 1e-6


def test_normalise(spark):
    df = spark.createDataFrame([("HTTP://User@Ex.com:80/a",), (" www.a-b.in. ",), ("1.2.3.4",), ("",), (None,)], "x string")
    got = [tuple(r) for r in df.select(normalize.host_or_null(F.col("x")), normalize.clean_domain(F.col("x"))).collect()]
    assert got[0][0] == "user@ex.com" and got[1][1] == "a-b.in" and got[2][1] is None and got[3] == (None, None) and got[4] == (None, None)


def test_elapsed_days_are_whole(spark):
    row = spark.range(1).select(network.elapsed_days(F.lit("2024-01-01 23:00:00").cast("timestamp"), F.lit("2024-01-02 01:00:00").cast("timestamp"))).first()
    assert row[0] == 0


def test_metrics_without_positives(spark):
    rows = evaluate.sweep(spark.createDataFrame([(False, 0.1)], "y boolean, s double"), "y", "s", (0.5,)).collect()
    assert (rows[0].precision, rows[0].recall, rows[0].f1) == (0.0, 0.0, 0.0)


def test_upsert(spark):
    table = spark.createDataFrame([("a", 1), ("b", 1)], "k string, t int")
    got = store.upsert(table, spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, t int"), "k", "t")
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 3), ("c", 1)]


def test_homoglyphs(spark):
    got = {r.variant for r in rules.homoglyphs(spark.createDataFrame([("z.in",)], "domain string")).collect()}
    assert got == {"z.in", "ž.in"}


def test_pictures(spark):
    import numpy as np

    from lurewatch.operators import visual

    own = np.random.default_rng(2)
    picture = own.integers(0, 256, (90, 120))
    assert visual.gradient_hash(np.repeat(np.arange(64)[:, None], 70, 1)) == 2**63 - 1 and visual.gradient_hash(np.full((20, 20), 7)) == 0
    assert abs(visual.structural_similarity(picture, picture) - 1) < 1e-9 and visual.structural_similarity(picture, own.integers(0, 256, (90, 120))) < 0.6
    assert np.allclose(visual._resized(picture.astype(float), 9, 12), picture.reshape(9, 10, 12, 10).mean((1, 3)), atol=1e-6)
    rows = [(1, 120, picture.ravel().tolist()), (2, 120, np.clip(picture + 3, 0, 255).ravel().tolist()), (3, 7, [1, 2, 3]), (4, None, None)]
    got = {r.id: r for r in visual.image_features(spark.createDataFrame(rows, "id int, width int, pixels array<int>")).collect()}
    assert got[3].gradient == 0 and got[4].cosine is None and abs(got[1].brightness - picture.mean()) < 1e-9 and got[1].tones == len(np.unique(picture))
    far = spark.createDataFrame([(got[1].cosine, got[2].cosine, got[3].cosine)], "a string, b string, c string").select(visual.cosine_distance(F.col("a"), F.col("b")), visual.cosine_distance(F.col("a"), F.col("c"))).first()
    assert far[0] < 40 and far[1] == 256


def test_models_are_kept_and_leak_nothing(spark, tmp_path):
    from lurewatch.operators import model

    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(1.0).alias("tranco_rank"), ((F.col("id") % 7) > 3).cast("int").alias("y"))
    sizes = model.Sizes(trees=5, depth=4, rounds=3, boost_depth=3, step=0.1)
    models = model.fit(rows, features=("a", "b", "tranco_rank"), sizes=sizes)
    assert models[0].stages[0].getInputCols() == ["a", "b"] and model.importances(models, ("a", "b", "tranco_rank"))[0][1] > 0.9
    model.save(models, str(tmp_path / "m"), 0.65, sizes)
    again, about = model.load(spark, str(tmp_path / "m"))
    assert about["threshold"] == 0.65 and about["trees"] == 5
    score = lambda m: [r.score for r in model.score(rows, m).orderBy("id").collect()]
    assert score(models) == score(again)
    assert (model.Sizes().trees, model.Sizes().depth, model.Sizes().rounds, model.Sizes().boost_depth) == (500, 12, 1000, 7)


def test_batch_predictor_by_hand(spark):
    from lurewatch.operators import predict

    names = spark.createDataFrame([("sbi-a.xyz",), ("hdfc-b.top",), ("sbi-find.com",), ("garden.org",), ("gov-x.xyz",), (None,), ("icici-low.in",)], "Name string")
    score = {"sbi-a.xyz": 0.9, "hdfc-b.top": 0.8, "sbi-find.com": 0.9, "gov-x.xyz": 0.95, "icici-low.in": 0.2}
    table = spark.createDataFrame(list(score.items()), "domain string, score double")
    facts = spark.createDataFrame([("sbi-a.xyz", True, True, True, True), ("hdfc-b.top", True, False, True, True)], "domain string, live boolean, shot boolean, match boolean, ui boolean")
    run = lambda **how: [(r.domain, r.confidence, r.final_confidence) for r in predict.batch_predict([names, names], lambda df: df.join(table, "domain"), facts, **how).collect()]
    assert run() == [("sbi-a.xyz", 0.9, 1.0)]  # the other has no picture and ends as Suspected
    assert run(stage=1) == [("sbi-a.xyz", 0.9, 1.0), ("hdfc-b.top", 0.8, 0.8)]  # and keeps its label beyond the second stage's rows
    assert run(stage=1, top=1) == [("sbi-a.xyz", 0.9, 1.0)]


def test_values_of_the_library_functions(spark):
    """Ratios and page texts, against values worked out by hand."""
    from lurewatch.operators import content, rules

    names = {"sbi-login.xyz": 1.0, "irctx": 0.8, "zzzz": 0.0, "onlinesbj": 16 / 18, "sbj": 0.0, "a digital b": 0.9}
    got = {r.domain: r.fuzzy_score for r in rules.fuzzy_scores(spark.createDataFrame([(n,) for n in names], "domain string")).collect()}
    assert got == {n: approx(v) for n, v in names.items()}
    pages = {"<p>a<b>b</b></p><script>x</script>&amp;c": "ab&amp;c", "<style>p{}</style>t<!-- no -->": "t", None: None, "1 < 2": "1 < 2"}
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert {r.html: r.b for r in df.select("html", content.plain_text(F.col("html")).alias("b")).collect()} == pages
