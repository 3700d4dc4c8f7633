"""Dataset building: union, keep-first dedup, balance, split, sample and forward fill.

Orders come from an arithmetic hash of the key, so that samples and splits repeat on any engine and any layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import last_known


def key_hash(key: Column, seed: int = 0) -> Column:
    return ((key + seed) * 2654435761) % 4294967296


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first by order. An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(first.alias("x")).select(key, "x.*")


def balanced(df: DataFrame, label: str, key: Column, size_of: str, shrink: str) -> DataFrame:
    """df with the rows of label `shrink` cut to as many as label `size_of` has, by least hash; others stay."""
    n = df.agg(F.count_if(F.col(label) == size_of)).first()[0]
    cut = df.filter(F.col(label) == shrink).orderBy(key_hash(key), key).limit(n)
    return df.filter(F.col(label) != shrink).unionByName(cut)


def split(df: DataFrame, label: str, key: Column, shares: tuple[float, ...] = (0.7, 0.15, 0.15)) -> DataFrame:
    """df plus fold 0, 1, ...: within each label, rows by hash fall into the shares."""
    return _dealt(df, label, key, lambda rank, n: F.when(n > 1, (rank - 1) / (n - 1)).otherwise(0.0), shares)


def folds(df: DataFrame, label: str, key: Column, k: int = 5) -> DataFrame:
    """df plus fold 0..k-1: within each label, rows by hash are dealt out in turn (stratified cross-validation)."""
    ranked = _ranked(df, label, key)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


#: hash ranges in which rows are ranked
RANGES = 4096


def _ranked(df: DataFrame, label: str, key: Column) -> DataFrame:
    """df plus _rank, its place within its label by hash, and _n, the label's rows. Ranges of hashes are counted first and
    ranked one by one, so a label is not one task."""
    rows = df.withColumns({"_h": key_hash(key), "_key": key}).withColumn("_range", F.floor(F.col("_h") / (4294967296 // RANGES)))
    sizes = rows.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_m"))
    along = Window.partitionBy(label)  # RANGES rows a label
    before = sizes.select(F.col(label).alias("_label"), F.col("_range").alias("_r"), (F.sum("_m").over(along.orderBy("_range")) - F.col("_m")).alias("_before"), F.sum("_m").over(along).alias("_n"))
    within = F.rank().over(Window.partitionBy(label, "_range").orderBy("_h", "_key"))
    ranked = rows.withColumn("_w", within).join(before, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    return ranked.withColumn("_rank", F.col("_before") + F.col("_w")).drop("_h", "_key", "_range", "_label", "_r", "_w", "_before")


def _dealt(df: DataFrame, label: str, key: Column, placed, shares: tuple[float, ...]) -> DataFrame:
    ranked = _ranked(df, label, key)
    place = placed(F.col("_rank"), F.col("_n"))
    fold, total = F.lit(len(shares) - 1), 0.0
    cases = []
    for i, s in enumerate(shares[:-1]):
        total += s
        cases.append((place < total, i))
    for c, i in reversed(cases):
        fold = F.when(c, i).otherwise(fold)
    return ranked.withColumn("fold", fold).drop("_rank", "_n")


def sample(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), by least hash."""
    return df.orderBy(key_hash(key, seed), key).limit(n)


def forward_fill(df: DataFrame, column: str, order: str, group: str) -> DataFrame:
    """df with the nulls of a column filled by the last value before them in their group, in order of a number, date or time."""
    return last_known(df, column, order, group)


def shuffled(df: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    return df.orderBy(key_hash(key, seed), key)


def aligned(df: DataFrame, columns, fill: float = 0) -> DataFrame:
    """The columns a model expects, in its order; one that df lacks is filled."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns))


def without(df: DataFrame, excluded) -> DataFrame:
    return df.drop(*excluded)


def rename_first(df: DataFrame, name: str = "domain") -> DataFrame:
    """df whose first column has the name; another column of that name goes."""
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").alias(name), *(F.col(f"`{c}`") for c in rest if c != name))


def first_n(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def version_5(older: DataFrame, ranked: DataFrame) -> DataFrame:
    """The older set with ranked names added; of repeated names the older row stays."""
    both = older.select("domain", "label", "source", F.lit(0).alias("_p")).unionByName(ranked.select("domain", "label", "source", F.lit(1).alias("_p")))
    return keep_first(both, "domain", "_p", "label", "source").drop("_p")


def version_7(sources: list[DataFrame], clean) -> DataFrame:
    """Sources (domain, label, source) in order of trust: names cleaned, unusable ones left out, the first source of a name
    kept."""
    rows = [s.select(clean(F.col("domain")).alias("domain"), "label", "source", F.lit(i).alias("_p")) for i, s in enumerate(sources)]
    return keep_first(union_all(rows).filter("domain is not null"), "domain", "_p", "label", "source").drop("_p")


def version_8(rows: DataFrame, key: Column) -> DataFrame:
    """As many legitimate as phishing names, by least hash; Suspected ones stay; in hash order."""
    return shuffled(balanced(rows, "label", key, "Phishing", "Legitimate"), key)


def version_9(rows: DataFrame, fresh: list[DataFrame]) -> DataFrame:
    """rows with the names of fresh lists that it lacks, labelled Phishing."""
    names = union_all([f.select(F.lower("domain").alias("domain")) for f in fresh]).filter("domain is not null").distinct()
    new = names.join(rows.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_anti")
    return rows.select("domain", "label", "source").unionByName(new.select("domain", F.lit("Phishing").alias("label"), F.lit("Fresh-Feed").alias("source")))


def isolated(df: DataFrame, features: dict[str, Column], valid: Column) -> DataFrame:
    """df with features and `error`: a row that is not valid has null features and a message, and stops no other."""
    made = {n: F.when(valid, c) for n, c in features.items()}
    return df.withColumns({**made, "error": F.when(~F.coalesce(valid, F.lit(False)), "unusable input")})
