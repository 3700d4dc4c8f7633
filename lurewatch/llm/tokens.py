"""BPE as a tokenization automaton.

The automaton reads tokens. At first it has one state with a loop for every symbol. Merge k = (x, y) -> z adds a
gadget: where an x arc leads to a state with a y arc, x now leads to a copy of that state without the y arc, and a
z arc goes where y went. All x arcs lead to the same state, so a state is known by the last token read, and a copy
without one arc is one recorded exclusion. The compiled tables are: `cut[(x, y)] = k` for every gadget, and the
left part, right part and birth of each token. `allows(a, z)` is the transition test that follows from them.

A word has exactly one accepted path whose labels spell it; that path is its encoding. Decoding emits the labels
of the arcs. As every state accepts, each beginning of a word has one path too, so one arc leads to each of its places:
the distinct words of a slice of rows are read together, place by place, without search (`paths`). A trie of the labels
gives the arcs from a place, a table of pairs whether they may follow the arc that led there.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: White space of the vocabulary's splitter (Unicode White_Space), fixed values.
_BLANK = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+")
#: What `str.split` takes for white space and the splitter does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Marks that often end a piece; below this letter every version of Unicode has the same letters.
_MARKS, _LATIN = frozenset(".,;:!?"), "\u0250"
_NEVER = 1 << 60
#: Letters of the longest word that is read together with others.
_LONG = 128


def _byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Table:
    """Whole numbers by keys below 2**32 - 1, in arrays with open addressing."""

    _FREE = np.uint32(2**32 - 1)

    def __init__(self, bits: int):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, self._FREE), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        self.used += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == self._FREE
            self.keys[slots[free]] = keys[free]  # of several keys that want a slot, one stays
            mine = self.keys[slots] == keys
            self.values[slots[mine]] = values[mine]
            keys, values, slots = keys[~mine], values[~mine], (slots[~mine] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where there is none."""
        slots = self._slots(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.values[slots], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen != self._FREE))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (seen != self._FREE)]
        return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)


def _gathered(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `which` of those that values and offsets hold, end to end, and their offsets."""
    n = np.diff(offsets)[which]
    out = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(offsets[which] - out[:-1], n) + np.arange(out[-1])], out


class Automaton:
    """Compiled merges of a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*self.ids.values(), *self.special.values()]) + 1
        self.label = [""] * n
        for word, i in [*self.ids.items(), *self.special.items()]:
            self.label[i] = word
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.cut: dict[tuple[int, int], int] = {}
        for k, (x, y) in enumerate(model["merges"]):
            a, b, z = self.ids[x], self.ids[y], self.ids[x + y]
            if self.allows(a, b):
                self.cut[a, b] = k
                if self.born[z] < 0:
                    self.left[z], self.right[z], self.born[z] = a, b, k
        if n > 1 << 16:
            raise ValueError("pairs are packed for ids of 16 bits")
        self.letters = _byte_letters()
        self.labels = pa.array([w.encode() + b" " for w in self.label], pa.large_binary())
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.steps: dict[tuple[int, int], bool] = {}
        self._compile()

    def _compile(self) -> None:
        """The trie of the labels of usable arcs by bytes, and the tables of cuts and pairs, as arrays."""
        byte = {c: b for b, c in enumerate(self.letters)}
        arcs = {b: b + 1 for b in range(256)}  # node and byte to node; the root is 0, its children are 1 to 256
        inner, final = {}, {}
        self.letters_of = np.zeros(len(self.label), np.int32)
        for w, z in self.ids.items():
            spelt = w.removesuffix(self.end)
            if len(spelt) == 1 or self.born[z] >= 0:
                node = 0
                for c in spelt:
                    node = arcs.setdefault(node << 8 | byte[c], len(arcs) + 1)
                (final if w.endswith(self.end) else inner)[node] = z
                self.letters_of[z] = len(spelt)
        self.inner, self.final = (np.full(len(arcs) + 1, -1, np.int32) for _ in range(2))
        for found, of in ((inner, self.inner), (final, self.final)):
            of[list(found)] = list(found.values())
        self.arcs, self.cuts = _Table(len(arcs).bit_length() + 2), _Table(len(self.cut).bit_length() + 2)
        self.arcs.put(np.array(list(arcs), np.uint32), np.array(list(arcs.values()), np.int32))
        self.cuts.put(_pair(*np.array(list(self.cut)).reshape(-1, 2).T), np.array(list(self.cut.values()), np.int32))
        self.lefts, self.rights, self.births = (np.array(x, np.int64) for x in (self.left, self.right, self.born))
        self.longest = max(map(int, self.letters_of))
        self.whole = {bytes([byte[c] for c in w.removesuffix(self.end)]): z for w, z in self.ids.items() if w.endswith(self.end) and self.letters_of[z]}
        self.whole |= {f" {w}".encode(): z for w, z in self.special.items()}  # no word begins with a blank
        self.pairs = _Table(20)

    def allows(self, a: int, z: int) -> bool:
        """Whether the state after token a has a z arc."""
        cut, left, right, born = self.cut, self.left, self.right, self.born
        before = _NEVER
        while a >= 0:
            w, until = z, _NEVER
            while w >= 0:
                k = cut.get((a, w))
                if k is not None and k < before and k <= until:
                    return False
                until = born[w]
                w = left[w]
            before = born[a]
            a = right[a]
        return True

    def _tested(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """`allows` of many pairs."""
        a, ok, live = a.astype(np.int64), np.ones(len(a), bool), np.arange(len(a))
        before = np.full(len(a), _NEVER)
        while len(live):
            rest, w, until = live, z[live].astype(np.int64), np.full(len(live), _NEVER)
            while len(rest):
                k = self.cuts.get(_pair(a[rest], w))
                bad = (k >= 0) & (k < before[rest]) & (k <= until)
                ok[rest[bad]] = False
                up = self.lefts[w]
                on = ~bad & (up >= 0)
                rest, w, until = rest[on], up[on], self.births[w[on]]
            live = live[ok[live]]
            before[live], a[live] = self.births[a[live]], self.rights[a[live]]
            live = live[a[live] >= 0]
        return ok

    def _allowed(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The same from the table of pairs, which is filled as pairs are met."""
        keys = _pair(a, z)
        found = self.pairs.get(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            if self.pairs.used + len(new) > 600_000:
                self.pairs = _Table(20)
            tested = self._tested(new >> np.uint32(16), new & np.uint32(0xFFFF))
            if len(new) <= 600_000:
                self.pairs.put(new, tested.astype(np.int32))
            found[found < 0] = tested[np.searchsorted(new, keys[found < 0])]
        return found > 0

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The accepted paths of distinct words end to end, and the len(words) + 1 offsets."""
        whole = np.fromiter((self.whole.get(w, -1) for w in words), np.int32, len(words))
        size = np.where(whole < 0, np.fromiter(map(len, words), np.int64, len(words)), 0)
        order = np.argsort(-size, kind="stable")
        one, two = int((size > _LONG).sum()), int((size > 0).sum())
        apart = [self._searched("".join([self.letters[b] for b in words[i]])) for i in order[:one].tolist()]
        n = size[order[one:two]]
        raw = np.frombuffer(b"".join([words[i] for i in order[one:two].tolist()]), np.uint8)
        byte = np.cumsum(n) - n
        place = byte + np.arange(len(n))  # a word has a place before each byte and one at its end
        last = np.full(len(raw) + len(n), -1, np.int32)  # the arc that leads to a place
        longer = np.searchsorted(-n, -np.arange(_LONG + 1), side="left").tolist()  # the words longer than so many bytes, which come first
        for s in range(_LONG):
            if not longer[s]:
                break
            rows, at = np.arange(longer[s]), byte[: longer[s]] + s
            node, met = raw[at].astype(np.int64) + 1, []
            for depth in range(1, self.longest + 1):
                k = int(np.searchsorted(rows, longer[s + depth]))  # from here on words end
                z = np.concatenate([self.inner[node[:k]], self.final[node[k:]]])
                c = np.flatnonzero(z >= 0)
                met.append((rows[c], z[c], np.full(len(c), s + depth)))
                at = at[:k] + 1
                node = self.arcs.get(node[:k].astype(np.uint32) << np.uint32(8) | raw[at])
                on = np.flatnonzero(node >= 0)
                if not len(on):
                    break
                rows, at, node = rows[on], at[on], node[on]
            rows, z, to = (np.concatenate(x) for x in zip(*met))
            start = place[rows]
            ok = np.flatnonzero(self._allowed(last[start + s], z)) if s else slice(None)
            last[(start + to)[ok]] = z[ok]
        on = np.zeros(len(last), bool)
        at, home = place + n, place
        while len(at):
            on[at] = True
            at = at - self.letters_of[last[at]]
            at, home = at[at > home], home[at > home]
        rest = whole[order[two:]]
        counts = [np.array([len(x) for x in apart], np.int64), np.add.reduceat(on, place, dtype=np.int64) if len(n) else n, (rest >= 0).astype(np.int64)]
        flat = np.concatenate([np.array([z for x in apart for z in x], np.int32), last[on], rest[rest >= 0]])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _gathered(flat, np.concatenate([[0], np.cumsum(np.concatenate(counts))]), back)

    def _searched(self, word: str) -> list[int]:
        """The path by search, with the dead states remembered."""
        n, ids, most = len(word), self.ids, self.longest
        steps = self.steps

        def arcs(i: int, last: int) -> Iterator[tuple[int, int]]:
            for j in range(min(n, i + most), i, -1):
                z = ids.get(word[i:j] + self.end if j == n else word[i:j])
                if z is not None and (j - i == 1 or self.born[z] >= 0):
                    if last < 0:
                        yield j, z
                    else:
                        ok = steps.get((last, z))
                        if ok is None:
                            if len(steps) > 500_000:
                                steps.clear()
                            ok = steps[last, z] = self.allows(last, z)
                        if ok:
                            yield j, z

        dead: set[tuple[int, int]] = set()
        trail: list[int] = []
        stack = [(0, -1, arcs(0, -1))]
        while stack:
            i, last, turn = stack[-1]
            if i == n:
                return trail
            for j, z in turn:
                if (j, z) not in dead:
                    stack.append((j, z, arcs(j, z)))
                    trail.append(z)
                    break
            else:
                dead.add((i, last))
                stack.pop()
                if trail:
                    trail.pop()
        raise ValueError(f"no path spells {word!r}")

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts end to end (int32), and the len(texts) + 1 offsets."""
        known: dict[str, int] = defaultdict(count().__next__)  # numbers of what stands between white space, and of special tokens
        number, pieces, ends = known.__getitem__, [], [0]
        for text in texts:
            for part in self.split.split(text) if text and any(x in text for x in self.special) else [text or ""]:
                if part in self.special:
                    pieces.append(number(" " + part))
                elif part:
                    plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                    pieces.extend(map(number, _WORD.findall(plain) if any(x in plain for x in _SEPARATORS) else plain.split()))
            ends.append(len(pieces))
        index: dict[str, int] = defaultdict(count().__next__)
        number, found, size = index.__getitem__, [], [0]
        for piece in known:
            body = piece[:-1] if piece[-1] in _MARKS else piece
            if body.isalpha() and (body.isascii() or max(body) < _LATIN):  # the splitter's one word, and a mark
                found.append(number(body))
                if body is not piece:
                    found.append(number(piece[-1]))
            elif piece[0] == " ":
                found.append(number(piece))
            else:
                found.extend(map(number, _WORD.findall(piece)))
            size.append(len(found))
        ids, offsets = self.paths([x.encode() for x in index])
        ids, offsets = _gathered(ids, offsets, np.array(found, np.int64))
        ids, offsets = _gathered(ids, offsets[size], np.array(pieces, np.int64))
        return ids, offsets[ends]

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].astype("<u4").tobytes()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[memoryview]:
        """For each list of ids the arc labels, joined by spaces (the vocabulary file names no decoder), as UTF-8."""
        labels = pc.take(self.labels, pa.array(ids))
        at = np.frombuffer(labels.buffers()[1], np.int64, len(labels) + 1)[offsets].tolist()
        data = memoryview(labels.buffers()[2] or b"")
        return (data[a : max(a, b - 1)] for a, b in zip(at, at[1:]))

@lru_cache(2)
def automaton(path: str) -> Automaton:
    """Compiled once in each worker process."""
    return Automaton(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ids(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs without `text`, plus `ids` (array<int>) and `n_tokens` (long). Null and empty texts have no ids; rows
    and other columns stay as they are; a column named like an output is replaced."""

    def made(a: Automaton, texts: list[str | None]) -> list[pa.Array]:
        ids, offsets = a.encode_all(texts)
        return [_ids(ids, offsets), pa.array(np.diff(offsets))]

    return _run(docs, text, path or default_path(), "ids array<int>, n_tokens long", made)


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs without `ids`, plus `decoded` (string). Null ids decode to an empty string."""

    def made(a: Automaton, lists: list[list[int] | None]) -> list[pa.Array]:
        offsets = np.cumsum([0, *(len(x or ()) for x in lists)])
        return [pa.array([bytes(x).decode() for x in a.decode_all(np.array([i for x in lists for i in x or ()], np.int32), offsets)], pa.string())]

    return _run(docs, ids, path or default_path(), "decoded string", made)


def digests(docs: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: docs without `text`, plus n_tokens, the SHA-256 of ids and of the decoded text,
    and the ids themselves if asked for."""

    def made(a: Automaton, texts: list[str | None]) -> list[pa.Array]:
        ids, offsets = a.encode_all(texts)
        packed, at = memoryview(ids.astype("<u4").tobytes()), (4 * offsets).tolist()
        of_ids = [hashlib.sha256(packed[x:y]).hexdigest() for x, y in zip(at, at[1:])]
        of_text = [hashlib.sha256(x).hexdigest() for x in a.decode_all(ids, offsets)]
        return [pa.array(np.diff(offsets)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), *([_ids(ids, offsets)] if with_ids else [])]

    return _run(docs, text, path or default_path(), "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, made)


def _run(docs: DataFrame, column: str, path: str, new: str, f: Callable[[Automaton, list], list[pa.Array]]) -> DataFrame:
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    keep = [c for c in docs.columns if c != column and c not in added.names]
    schema = StructType([*docs.select(*keep).schema.fields, *added.fields])
    packed = dict(docs.dtypes)[column] == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for part in slices(batches, "__t") if packed else batches:
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *f(a, part.column("__t").to_pylist())], names=schema.names)

    return docs.select(*keep, F.col(column).alias("__t")).mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
