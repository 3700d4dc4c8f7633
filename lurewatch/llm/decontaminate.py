"""Benchmark decontamination with DataFrame functions alone.

A document leaks an item when a window of the item's size has a weighted-shingle similarity of `least` or more with
it: the sum of the smaller over the sum of the larger counts of their shingles (five normalised words; a shorter
item is one shingle).

1. Shared shingles. A window that is similar to an item lacks at most n - ceil(least * n) of the item's n shingles, so
   it holds one of the rarest that count one more in sum: only documents with one of these probes meet the item, and a
   phrase that many items and documents share makes no pairs. Windows around the shared shingles of such pairs
   are looked at; the counts bound the similarity from above, and windows that cannot reach `least` are dropped.
   This loses nothing.
2. SimHash. Each remaining window and each item get a 64-bit fingerprint. Fingerprints are cut into radius + 1
   blocks; within the radius at least one block agrees, so an equi-join on blocks (multi-index) finds every pair
   within it. The radius is 24 bits: at a similarity of 0.8 the expected distance is under 10 bits with a deviation
   of 3, so the chance to miss a window is about one in ten million.
3. The exact similarity of each candidate decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, looked_up, table, written
from .rows import unused

WIDTH = 5


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if `rows`, its counted size, allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _words(text: str) -> str:
    return f"array_remove(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), '')"


def _runs(width: int, each: str = "{}") -> str:
    """SQL: `each` of the hashes of the runs of `width` words of an array w, in order; i is the run's place."""
    rest = "".join(f", w[i + {k}]" for k in range(1, width))
    return f"transform(slice(w, 1, greatest(size(w) - {width - 1}, 0)), (x, i) -> {each.format(f'xxhash64(x{rest})')})"


def _shingles(text: str, width: int) -> F.Column:
    """Hashes of the runs of `width` normalised words of a text column, in order."""
    # the outer transform binds the word array once
    return F.expr(f"transform(array({_words(text)}), w -> {_runs(width)})[0]")


def _all_shingles(text: str, widths: list[int]) -> F.Column:
    """(width, total, p, hash) of all runs of each of the widths, from one splitting of the text."""
    each = [_runs(k, f"named_struct('width', {k}, 'total', size(w) - {k - 1}, 'p', i, 'hash', {{}})") for k in widths]
    return F.expr(f"transform(array({_words(text)}), w -> flatten(array({', '.join(each)})))[0]")


def _fingerprint(hashes: str) -> F.Column:
    """SimHash of an array of hashes: each bit by majority."""
    votes = f"aggregate({hashes}, array_repeat(0, 64), (s, h) -> transform(s, (v, b) -> v + cast(shiftright(h, b) & 1L as int)))"
    return F.expr(f"aggregate(transform({votes}, (v, b) -> if(v * 2 > size({hashes}), shiftleft(1L, b), 0L)), 0L, (s, x) -> s | x)")


def _similarity(a: str, b: str) -> F.Column:
    """Weighted Jaccard similarity of two arrays of hashes with repeats. Where one side has none, the smaller of two counts
    is 1 for every shared hash, and nothing needs to be counted."""
    once = lambda x: f"size(array_distinct({x})) = size({x})"
    both = f"aggregate(transform(array_intersect({a}, {b}), x -> least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))), 0, (s, v) -> s + v)"
    return F.expr(f"transform(array(if({once(a)} or {once(b)}, size(array_intersect({a}, {b})), {both})), m -> m / (size({a}) + size({b}) - m))[0]")


def items(benchmark: DataFrame, id_col: str, text: str) -> DataFrame:
    """(item_id, width, hashes, n) of the items that have words."""
    size = F.size(_shingles("__t", 1))
    base = benchmark.select(F.col(id_col).alias("item_id"), F.col(text).alias("__t")).withColumn("width", F.least(size, F.lit(WIDTH))).filter("width > 0")
    hashes = F.coalesce(*[F.when(F.col("width") == k, _shingles("__t", k)) for k in range(1, WIDTH + 1)])
    return base.select("item_id", "width", hashes.alias("hashes")).withColumn("n", F.size("hashes")).distinct()


def candidates(known: DataFrame, wanted: DataFrame, least: float, size: int) -> DataFrame:
    """(doc, text_hash, item_id), distinct: documents that hold one of an item's probes, its rarest shingles in known (doc,
    text_hash, width, hash, a row a place), as many as a similar window cannot all lack. size: the items' shingles."""
    seen = known.groupBy(F.col("width").alias("w"), F.col("hash").alias("h")).agg(F.count(F.lit(1)).alias("seen"))
    each = wanted.select("item_id", "width", "n", F.xxhash64("hashes").alias("of"), F.explode("hashes").alias("hash"))
    each = each.groupBy("item_id", "width", "n", "of", "hash").agg(F.count(F.lit(1)).alias("times"))
    each = each.join(seen, (F.col("width") == F.col("w")) & (F.col("hash") == F.col("h")), "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    rarest = Window.partitionBy("item_id", "width", "n", "of").orderBy("seen", "hash").rowsBetween(Window.unboundedPreceding, -1)  # of one item
    lacked = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9)
    probes = each.withColumn("before", F.coalesce(F.sum("times").over(rarest), F.lit(0))).filter((F.col("before") <= lacked) & (F.col("seen") > 0))
    return known.join(sized(probes.select("item_id", "width", "hash"), size), ["width", "hash"]).select("doc", "text_hash", "item_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 24, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text_hash, item_id, similarity, position) for every document and item that leaks into it: the best
    window's similarity and its first word.

    Null and blank texts leak nothing and items without words match nothing. Rows with a null id are found like any
    other; rows that repeat id and text give one result; repeated items give one. Other columns are ignored. Either
    table empty gives an empty result. A document shorter than an item is one window.
    """
    keyed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("__t"))
    wanted = written(items(benchmark, item_col, item_text), "items")
    n_items = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    widths = [r[0] for r in wanted.select("width").distinct().orderBy("width").collect()]  # five values at most
    if not widths:
        kind = wanted.schema["item_id"].dataType
        return docs.select(F.col(id_col), F.xxhash64(text).alias("text_hash"), F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("position")).limit(0)
    runs = keyed.select("doc", "text_hash", F.explode(_all_shingles("__t", widths)).alias("s")).select("doc", "text_hash", "s.*")
    said = wanted.select("width", F.explode("hashes").alias("hash")).distinct().select(F.struct("width", "hash").alias("said"))
    known = written(looked_up(runs, said, n_items[1], F.struct("width", "hash"), "said", "left_semi"), "known")
    same = lambda names, mark="_": [F.col(c).eqNullSafe(F.col(mark + c)) for c in names]
    parts = wanted.select("item_id", "width", "n", F.explode(F.array_distinct("hashes")).alias("hash"))
    asked = candidates(known, wanted, least, n_items[1]).select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_text_hash"), F.col("item_id").alias("_item"))
    asked = asked.join(sized(parts, n_items[1]), F.col("_item").eqNullSafe(F.col("item_id"))).withColumnsRenamed({"width": "_width", "hash": "_hash"})
    hits = written(known.join(asked, same(["doc", "text_hash", "width", "hash"])).select("doc", "text_hash", "item_id", "width", "n", "total", "p"), "hits")
    # the most shingles a window and an item can share must reach `least` of their union
    held = F.least("n", "total")
    need = F.ceil(F.lit(least / (1 + least)) * (held + F.col("n")) - 1e-9)
    pair = ["doc", "text_hash", "item_id"]
    likely = hits.groupBy(*pair).agg(F.count_distinct("p").alias("c"), F.first("n").alias("n"), F.first("total").alias("total")).filter(F.col("c") >= need).select(*(F.col(c).alias(f"_{c}") for c in pair))
    near = hits.join(likely, same(pair), "left_semi")
    # a hit is in the windows that start at first..last; running sums over these ends count the hits of all windows
    first, last = F.greatest(F.lit(0), F.col("p") - F.col("n") + 1), F.greatest(F.lit(0), F.least(F.col("p"), F.col("total") - F.col("n")))
    step = lambda at, by: F.struct(at.alias("at"), F.lit(by).alias("by"))
    edges = near.dropDuplicates([*pair, "p"]).select(*pair, "width", "n", "total", F.explode(F.array(step(first, 1), step(last + 1, -1))).alias("e"))
    edges = edges.groupBy(*pair, "width", "n", "total", "e.at").agg(F.sum("e.by").alias("by"))
    along = Window.partitionBy(*pair).orderBy("at")  # of one document and item
    spans = edges.withColumns({"c": F.sum("by").over(along), "until": F.lead("at").over(along) - 1}).filter(F.col("c") >= need)
    windows = spans.select(*pair, "width", "n", F.explode(F.sequence("at", "until")).alias("start"))
    windows = written(windows.select("doc", "text_hash", "width", "n", "start").distinct(), "windows")
    by_doc = windows.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("width", "n", "start")).alias("ws"))  # bounded by the document's length
    few = sized(by_doc.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_text_hash"), "ws"), windows.count())
    found = keyed.dropDuplicates(["doc", "text_hash"]) if n_items[1] > BROADCAST_ROWS else keyed
    cut = found.join(few, same(["doc", "text_hash"])).select("doc", "text_hash", "__t", F.explode("ws").alias("w"))
    pieces = F.coalesce(*[F.when(F.col("w.width") == k, _shingles("__t", k)) for k in range(1, WIDTH + 1)])
    cut = cut.select("doc", "text_hash", "w.*", F.slice(pieces, F.col("w.start") + 1, F.col("w.n")).alias("hs"))
    cut = written(cut.dropDuplicates(["doc", "text_hash", "width", "n", "start"]).withColumn("fp", _fingerprint("hs")), "cut")
    bits = [64 * k // (radius + 1) for k in range(radius + 2)]
    block = lambda: F.posexplode(F.array(*[F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(bits, bits[1:])])).alias("k", "block")
    index = wanted.withColumn("fp", _fingerprint("hashes")).select("item_id", "width", "n", "hashes", F.col("fp").alias("item_fp"), block())
    pairs = cut.select("*", block()).join(sized(index, n_items[0] * (radius + 1)), ["width", "n", "k", "block"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = pairs.dropDuplicates(["doc", "text_hash", "width", "n", "start", "item_id"]).withColumn("similarity", _similarity("hs", "hashes")).filter(F.col("similarity") >= least - 1e-12)
    best = pairs.groupBy(*pair).agg(F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("position"))
    return best.select(F.col("doc").alias(id_col), "text_hash", "item_id", "similarity", "position")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs into which no benchmark item leaks, with their own columns, whatever their names."""
    d, h = (unused(docs.columns) + x for x in ("d", "h"))
    dirty = written(leaks(docs, benchmark, id_col=id_col, text=text, **how).select(F.col(id_col).alias(d), F.col("text_hash").alias(h)).distinct(), "leaks")
    return docs.join(sized(dirty, dirty.count()), docs[id_col].eqNullSafe(F.col(d)) & (F.xxhash64(docs[text]) == F.col(h)), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "position")
