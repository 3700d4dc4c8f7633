"""Fill-in-middle transformation by succinct rank and select.

The texts of a slice lie end to end as UTF-8. A packed bit vector marks the bytes where a code point starts, and a directory
holds the number of marks before each block of 512 bits. The marks of a text are the difference of two ranks, and the byte
where unit k starts is one select, so a text is cut at code points without being decoded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes
from .rows import with_columns

SENTINELS = ("<P>", "<S>", "<M>")
_WORD, _BLOCK = 64, 512


class Marks:
    """A packed bit vector with a directory of the marks before each block."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // _BLOCK) * _BLOCK, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").reshape(-1, _BLOCK // _WORD)
        self.counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.counts.sum(1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each place."""
        block, word, bit = at // _BLOCK, at % _BLOCK // _WORD, (at % _WORD).astype(np.uint64)
        inside = np.where(np.arange(_BLOCK // _WORD) < word[:, None], self.counts[block], 0).sum(1)
        low = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + inside + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of mark number k (from 0); k is less than the number of marks."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        upto = np.cumsum(self.counts[block], axis=1)
        word = (upto <= left[:, None]).sum(1)
        rows = np.arange(len(k))
        left = left - (upto[rows, word] - self.counts[block, word])
        bits = np.unpackbits(self.words[block, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int16) == (left + 1)[:, None]).argmax(1)
        return block * _BLOCK + word * _WORD + bit


def _draws(key: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(key.encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sentinels: tuple[str, str, str] = SENTINELS, plain: int = 10, spm: int = 20, salt: int = 1) -> DataFrame:
    """docs without `text`, plus n (code points), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and
    output, the rearranged text. The draws come from SHA-256 of salt and id, so they repeat; `plain` of 100 texts stay as they
    are, `spm` of 100 others put the suffix first. A null text is empty; empty texts and those that hold a sentinel are plain;
    a null id draws as the empty one; rows that repeat are cut alike; other columns stay, unless named like an output."""
    p, s, m = (x.encode() for x in sentinels)

    def cut(texts: pa.Array, ids: pa.Array) -> list[pa.Array]:
        raw, offsets = text_bytes(texts)
        marks = Marks((raw & 0xC0) != 0x80)
        first = marks.rank(offsets)
        n = np.diff(first)
        draws = np.array([_draws(f"{salt}:{i or ''}") for i in ids.to_pylist()], np.int64).reshape(-1, 4)
        units = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
        ends = np.repeat(offsets[1:, None], 2, axis=1)
        inner = units < n[:, None]
        ends[inner] = marks.select((first[:-1, None] + units)[inner])
        form, output = [], []
        for i in range(len(n)):
            whole = raw[offsets[i] : offsets[i + 1]].tobytes()
            if not whole or draws[i, 2] % 100 >= 100 - plain or any(x in whole for x in (p, s, m)):
                form.append("plain")
                output.append(whole)
                continue
            a, b = (ends[i] - offsets[i]).tolist()
            form.append("spm" if draws[i, 3] % 100 < spm else "psm")
            output.append(b"".join((s, whole[b:], p, whole[:a], m, whole[a:b]) if form[-1] == "spm" else (p, whole[:a], s, whole[b:], m, whole[a:b])))
        mask = np.array([f == "plain" for f in form])
        chars = [pa.array(x, pa.int64(), mask=mask) for x in (units[:, 0], units[:, 1] - units[:, 0])]
        return [pa.array(n, pa.int64()), pa.array(form, pa.string()), *chars, pa.array(output, pa.binary()).cast(pa.string())]

    inputs = [F.col(f"`{text}`"), F.col(f"`{id_col}`").cast("string")]
    return with_columns(docs, inputs, "n long, form string, prefix_chars long, middle_chars long, output string", cut, (text,))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output and its form were made from: the parts stand between the first sentinels."""
    p, s, m = sentinels

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        at = F.position(F.lit(two), output, F.lit(len(one) + 1))
        last = F.position(F.lit(m), output, at + len(two))
        end = last + len(m)
        return F.substr(output, F.lit(len(one) + 1), at - len(one) - 1), F.substr(output, at + len(two), last - at - len(two)), F.substr(output, end)

    prefix, suffix, middle = parts(p, s)
    suffix_, prefix_, middle_ = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_HELD = " OR ".join(f"contains(t, '{x}')" for x in SENTINELS)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
e AS (SELECT doc_id, t, length(t) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2,
  CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR {_HELD} OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM g"""
