"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked ids.

Both tokenizers end a token before every run of spaces and line feeds, so a text is aligned word by
word and each worker aligns a distinct word once. A first pass adds up how often each id pair is
linked in its partition. The distinct pairs get a minimal perfect hash; dense vectors of counts,
indexed by it, are added up in a tree. A second pass aligns the documents again and looks their
links up, each hit verified by the pair that is stored in its slot.
"""

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatelens.llm.common import REPORT, report, summed, written
from gatelens.llm.token_ids import byte_signs, sliced

#: Distinct pairs whose hash and counts are broadcast, at most (about 17 bytes each); more are
#: counted and looked up by grouping and joining.
HASHED_PAIRS = 4_000_000
#: Pairs of a shard of the hash on average, and slots a level has for each pair it gets.
SHARD = 16_384
ROOM = 2
#: Words that a worker keeps aligned, and ids of them, before it starts anew; words encoded at a time.
KEPT = 500_000
KEPT_IDS = 8_000_000
CHUNK = 1024
#: Pairs that a partition of the first pass holds before it adds them up.
HELD = 2_000_000

#: White space other than space and line feed, and the sign that a piece model takes for a space.
_ODD = r"[\t\x0b-\r\x1c-\x1f\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}▁]"
_RUN = r"[ \n][ \n]|\A[ \n]|[ \n]\z"
# How a byte-level layout cuts pre-tokens: a fixed value of the public tokenizer.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNIT = re.compile(r"[ \n]+[^ \n]+|[ \n]+$")

_WORKER: dict[tuple[str, str], "Aligner"] = {}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass(frozen=True)
class Units:
    """Aligned strings. Each has the linked ``keys`` of its groups and ``parts``, which name the
    ids of its groups in written order, with what follows them. Without ``ok`` it has no tokens."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    keys: np.ndarray
    parts: np.ndarray

    @staticmethod
    def none(n: int) -> "Units":
        zero = np.zeros(n, np.int64)
        return Units(np.zeros(n, bool), zero, zero, zero, zero[:0], np.zeros(0, np.int32))

    def plus(self, other: "Units") -> "Units":
        names = self.__dataclass_fields__
        return Units(*[np.concatenate([getattr(self, f), getattr(other, f)]) for f in names])

    def take(self, at: np.ndarray) -> "Units":
        n_parts = self.n_a + self.n_b
        keys = _ranges((np.cumsum(self.n_groups) - self.n_groups)[at], self.n_groups[at])
        parts = _ranges((np.cumsum(n_parts) - n_parts)[at], n_parts[at])
        numbers = [x[at] for x in (self.ok, self.n_a, self.n_b, self.n_groups)]
        return Units(*numbers, self.keys[keys], self.parts[parts])


class Aligner:
    """Alignment of ``" " + text`` by a byte-level tokenizer with ``text`` by a piece model."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        signs = byte_signs()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [
            bytes([signs[c] for c in t]) if all(c in signs for c in t) else t.encode() for t in tokens
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_sizes = np.array([len(t) for t in self.a_bytes])
        self.b_sizes = np.array([len(t) for t in self.b_bytes])
        ids_a, ids_b = map(str, range(len(tokens))), map(str, range(len(pieces)))
        #: What a part stands for: an id and what follows it.
        self.written = pa.array(
            [i + sign for ids, last in ((ids_a, "|"), (ids_b, ";")) for i in ids for sign in (",", last)],
            pa.large_string(),
        )
        self.space = self.b.piece_to_id("▁")
        with open(a_path, encoding="utf-8") as file:
            layout = json.load(file)
        before = layout.get("pre_tokenizer") or {}
        #: False where tokens may span words; whole texts are aligned then.
        self.splits = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not layout.get("normalizer")
            and not layout["model"].get("dropout")
            and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        )
        self.ranks = self._ranked(layout) if self.splits else None
        self.index: dict[str, int] = {}
        self.store = Units.none(0)

    def _ranked(self, layout: dict) -> tiktoken.Encoding | None:
        """The same vocabulary for the library that merges by rank; ids must follow the merges."""
        vocabulary, merges = layout["model"]["vocab"], layout["model"]["merges"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        if [vocabulary.get(t) for t in made] != [*range(256, 256 + len(made))]:
            return None
        ranks = {self.a_bytes[i]: i for i in vocabulary.values() if i < 256 + len(made)}
        if len(ranks) != 256 + len(made):
            return None
        return tiktoken.Encoding("a", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that start with a space or a line feed."""
        if self.ranks:
            a = [self.ranks.encode_ordinary(t) for t in texts]
        else:
            a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        # the model puts a space before a line feed
        return a, [
            ids if t[0] == " " else ids[1:] if ids[:1] == [self.space] else []
            for t, ids in zip(texts, b, strict=True)
        ]

    def _fits(self, data: bytes, a: list[int], b: list[int]) -> bool:
        one, other = self.a_bytes, self.b_bytes
        return b"".join([one[i] for i in a]) == data == b"".join([other[i] for i in b])

    def encoded(self, units: list[str]) -> Units:
        """The alignments of words, each with the white space before it.

        Words are encoded many at a time; white space at the end of a text, and words of a run whose
        bytes do not come back, alone.
        """
        lone = [i for i, u in enumerate(units) if u[-1] in " \n"]
        rest = [i for i, u in enumerate(units) if u[-1] not in " \n"]
        runs = [[i] for i in lone] + [rest[at : at + CHUNK] for at in range(0, len(rest), CHUNK)]
        order: list[int] = []
        all_a: list[int] = []
        all_b: list[int] = []
        while runs:
            texts = ["".join([units[i] for i in run]) for run in runs]
            again = []
            for run, text, a, b in zip(runs, texts, *self._ids(texts), strict=True):
                if self._fits(text.encode(), a, b):
                    order += run
                    all_a += a
                    all_b += b
                elif len(run) > 1:
                    again += [[i] for i in run]
            runs = again
        made = self._grouped(np.array(all_a, np.int64), np.array(all_b, np.int64), [units[i].encode() for i in order])
        if len(order) == len(units) and order == sorted(order):
            return made
        place = np.full(len(units), len(order))
        place[order] = np.arange(len(order))
        return made.plus(Units.none(1)).take(place)

    def _grouped(self, a: np.ndarray, b: np.ndarray, units: list[bytes]) -> Units:
        """Ids of both over the joined units, cut where tokens of both end, and dealt to the units."""
        n = len(units)
        if not n:
            return Units.none(0)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([len(u) for u in units])
        total = int(ends[-1]) + 1
        mark_a, mark_b = np.zeros(total, bool), np.zeros(total, bool)
        mark_a[ends_a] = True
        mark_b[ends_b] = True
        last_a, last_b = mark_b[ends_a], mark_a[ends_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        many = int(last_a.sum())
        unit = np.searchsorted(ends, ends_a[last_a])
        per_a, per_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
        parts = np.empty(len(a) + len(b), np.int32)
        parts[np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]] = 2 * a + last_a
        parts[np.arange(len(b)) + np.cumsum(per_a)[group_b]] = 2 * (len(self.a_bytes) + b) + last_b
        n_a = np.zeros(n, np.int64)
        n_b = np.zeros(n, np.int64)
        np.add.at(n_a, unit, per_a)
        np.add.at(n_b, unit, per_b)
        keys = (a[last_a] << 32) | b[last_b]
        return Units(np.ones(n, bool), n_a, n_b, np.bincount(unit, minlength=n), keys, parts)

    def whole(self, texts: list[str]) -> Units:
        """Texts by the libraries alone."""
        out = Units.none(0)
        for text in texts:
            data = (" " + text).encode()
            a = self.a.encode(" " + text, add_special_tokens=False).ids if text else []
            b = self.b.encode(text) if text else []
            fits = bool(text) and self._fits(data, a, b)
            made = self._grouped(np.array(a, np.int64), np.array(b, np.int64), [data]) if fits else Units.none(1)
            out = out.plus(made)
        return out

    def of_units(self, units: list[str]) -> Units:
        """The alignments of distinct words, kept by this worker."""
        if len(self.index) > KEPT or len(self.store.parts) > KEPT_IDS:
            self.index, self.store = {}, Units.none(0)
        index = self.index
        new = [u for u in units if u not in index]
        if new:
            at = len(index)
            index.update(zip(new, range(at, at + len(new)), strict=True))
            self.store = self.store.plus(self.encoded(new))
        return self.store.take(np.array([index[u] for u in units]))

    def slices(self, texts: pa.Array) -> Iterator["Slice"]:
        """The texts in up to three groups: cut by single spaces, by runs, and not cut at all."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD)
        run = pc.match_substring_regex(texts, _RUN)
        empty = pc.equal(texts, "")
        kinds = pc.if_else(pc.or_(odd, empty), 2, pc.if_else(run, 1, 0)).to_numpy(zero_copy_only=False)
        if not self.splits:
            kinds = np.full(len(texts), 2)
        rows = np.flatnonzero(kinds == 0)
        if len(rows):
            usual = pc.replace_substring(texts.take(pa.array(rows)), "\n", " \n")
            lists = pc.split_pattern(usual, " ")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield from self._slice(rows, lists.flatten(), offsets.astype(np.int64), True, texts)
        rows = np.flatnonzero(kinds == 1)
        if len(rows):
            cut = [_UNIT.findall(" " + t) for t in texts.take(pa.array(rows)).to_pylist()]
            words = pa.array([u for units in cut for u in units], pa.large_string())
            offsets = np.concatenate([[0], np.cumsum([len(u) for u in cut])])
            yield from self._slice(rows, words, offsets, False, texts)
        rows = np.flatnonzero(kinds == 2)
        if len(rows):
            yield self._whole(rows, texts)

    def _whole(self, rows: np.ndarray, texts: pa.Array) -> "Slice":
        found = self.whole(texts.take(pa.array(rows)).to_pylist())
        return Slice(rows, found, np.arange(len(rows)), np.arange(len(rows) + 1), self.written)

    def _slice(
        self, rows: np.ndarray, words: pa.Array, offsets: np.ndarray, bare: bool, texts: pa.Array
    ) -> Iterator["Slice"]:
        """Texts from their words; texts with a word that is not certain go whole."""
        coded = pc.dictionary_encode(words)
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if bare:
            units = [u if u[0] == "\n" else " " + u for u in units]
        found = self.of_units(units)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not found.ok.all():
            bad = np.add.reduceat(~found.ok[codes], offsets[:-1]) > 0
            yield self._whole(rows[bad], texts)
            sizes = np.diff(offsets)
            codes = codes[np.repeat(~bad, sizes)]
            offsets = np.concatenate([[0], np.cumsum(sizes[~bad])])
            rows = rows[~bad]
        if len(rows):
            yield Slice(rows, found, codes, offsets, self.written)


@dataclass(frozen=True)
class Slice:
    """Texts ``rows`` of a batch, each a run of ``codes`` of distinct aligned words."""

    rows: np.ndarray
    words: Units
    codes: np.ndarray
    offsets: np.ndarray
    written: pa.Array

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text; every text has a word."""
        return np.add.reduceat(values[self.codes], self.offsets[:-1])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of all distinct words, and the word of each."""
        n = self.words.n_groups
        return self.words.keys, np.repeat(np.arange(len(n)), n)

    def groups(self) -> pa.Array:
        """The groups of each text as a string."""
        n_parts = self.words.n_a + self.words.n_b
        known = _joined_strings(self.written.take(pa.array(self.words.parts)), np.append(0, np.cumsum(n_parts)))
        whole = _joined_strings(known.take(pa.array(self.codes)), self.offsets)
        return pc.ascii_rtrim(whole, characters=";")


def _joined_strings(values: pa.Array, cuts: np.ndarray) -> pa.Array:
    """The strings between cuts as one each; strings of an array lie behind each other already."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset :][cuts] if len(values) else np.zeros(len(cuts), np.int64)
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(at)), data or pa.py_buffer(b""))


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker, kept from task to task."""
    key = (a_path, b_path)
    if key not in _WORKER:
        _WORKER[key] = Aligner(a_path, b_path)
    return _WORKER[key]


# ---- the minimal perfect hash of distinct pairs


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_hash(keys, 0) % np.uint64(shards)).astype(np.int64)


def built(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """``sizes, bits, ordered``: levels of a shard, their bits, and the keys by slot.

    A key that is alone at its place of a level takes it; the others go on to the next level, which
    has room for them. The slot of a key is the count of places taken before its own.
    """
    sizes: list[int] = []
    levels, owners = [], []
    while len(keys):
        size = -(-ROOM * len(keys) // 64) * 64
        at = (_hash(keys, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        taken = np.zeros(size, bool)
        taken[at[alone]] = True
        levels.append(taken)
        owners.append(keys[alone][np.argsort(at[alone])])
        sizes.append(size)
        keys = keys[~alone]
    bits = np.packbits(np.concatenate(levels), bitorder="little") if levels else np.zeros(0, np.uint8)
    return sizes, bits, np.concatenate(owners) if owners else keys


class PairHash:
    """Slots 0 to n - 1 of n distinct pairs, from shards in order."""

    def __init__(self, shards: list[tuple[list[int], bytes, bytes]]) -> None:
        deep = max((len(sizes) for sizes, _, _ in shards), default=0)
        self.sizes = np.zeros((len(shards), deep), np.int64)
        for i, (sizes, _, _) in enumerate(shards):
            self.sizes[i, : len(sizes)] = sizes
        ends = np.cumsum(self.sizes.ravel()).reshape(self.sizes.shape)
        self.starts = ends - self.sizes
        self.bits = np.frombuffer(b"".join([bits for _, bits, _ in shards]), "<u8")
        taken = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(taken) - taken
        self.keys = np.frombuffer(b"".join([keys for _, _, keys in shards]), "<i8")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key that is not among the pairs."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        shard = shard_of(keys, len(self.sizes))
        live = np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            live = live[self.sizes[shard[live], level] > 0]
            if not len(live):
                break
            size = self.sizes[shard[live], level]
            at = (_hash(keys[live], level + 1) % size.astype(np.uint64)).astype(np.int64)
            at += self.starts[shard[live], level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[live[hit]] = (self.before[at >> 6] + below)[hit]
            live = live[~hit]
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out


def perfect_hash(distinct: DataFrame, n: int) -> PairHash:
    """The hash of the distinct ``key`` rows; each shard is built by a task of its own."""
    shards = max(1, -(-n // SHARD))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard_of(keys, shards)), batch.column(0)], names=["shard", "key"]
            )

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, keys = built(rows["key"].to_numpy())
        return pd.DataFrame(
            {
                "shard": [int(rows["shard"].iloc[0])],
                "sizes": [sizes],
                "bits": [bits.tobytes()],
                "keys": [keys.astype("<i8").tobytes()],
            }
        )

    placed = distinct.select("key").mapInArrow(place, "shard long, key long")
    made = placed.groupBy("shard").applyInPandas(
        build, "shard long, sizes array<long>, bits binary, keys binary"
    )
    by_shard = {r.shard: (list(r.sizes), bytes(r.bits), bytes(r.keys)) for r in made.collect()}
    return PairHash([by_shard.get(i, ([], b"", b"")) for i in range(shards)])


@dataclass(frozen=True)
class PairCounts:
    """Counts by slot, and whether a pair's count is the highest of its second id."""

    hash: PairHash
    counts: np.ndarray
    best: np.ndarray

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.hash.slots(keys)
        if (at < 0).any():
            raise ValueError("a linked pair was not counted: the documents changed between the passes")
        return self.counts[at], self.best[at]


def partial_counts(docs: DataFrame, a_path: str, b_path: str, text: str) -> DataFrame:
    """``key, n``: how often each partition links each pair, a pair once or a few times each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        more_keys: list[np.ndarray] = []
        more_counts: list[np.ndarray] = []

        def added() -> None:
            nonlocal keys, counts
            every = np.concatenate([keys, *more_keys])
            weights = np.concatenate([counts, *more_counts])
            keys, place = np.unique(every, return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, place, weights)
            more_keys.clear()
            more_counts.clear()

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": keys, "n": counts})

        for batch in sliced(batches, 0):
            for part in aligner.slices(batch.column(0)):
                found, word = part.keys()
                times = np.bincount(part.codes, minlength=len(part.words.ok))
                more_keys.append(found)
                more_counts.append(times[word])
            if sum(map(len, more_keys)) > HELD:
                added()
                if len(keys) > HELD:
                    yield taken()
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        added()
        yield taken()

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "key long, n long")
    return found.where("n > 0")


def pair_counts(docs: DataFrame, a_path: str, b_path: str, *, text: str = "text") -> DataFrame:
    """``a, b, n, best``: all linked id pairs of the corpus, and whether no pair of ``b`` has more."""
    partial = partial_counts(docs, a_path, b_path, text)
    return _best_of(partial.groupBy("key").agg(F.sum("n").alias("n"))).select(
        F.shiftright("key", 32).cast("int").alias("a"), "b", "n", "best"
    )


def _best_of(counts: DataFrame) -> DataFrame:
    """``key, b, n, best`` of summed counts; there are no more ``b`` than the vocabulary has ids."""
    keyed = counts.withColumn("b", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    highest = keyed.groupBy("b").agg(F.max("n").alias("highest"))
    return keyed.join(highest, "b").select("key", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def hashed_counts(partial: DataFrame, distinct: DataFrame, n: int) -> PairCounts:
    """Dense vectors of counts, one a task, indexed by the hash and added up in a tree.

    Tasks are so few that each reads at least as many partial counts as its vector is long.
    """
    hash_ = perfect_hash(distinct, n)
    sent = partial.sparkSession.sparkContext.broadcast(hash_)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, np.int64)
        for batch in batches:
            at = sent.value.slots(batch.column(0).to_numpy())
            np.add.at(counts, at, batch.column(1).to_numpy())
        yield from report("counts", TaskContext.get().partitionId(), counts)

    tasks = max(1, partial.count() // max(1, n))
    dense = partial.select("key", "n").coalesce(tasks).mapInArrow(add, REPORT)
    counts = summed(dense, n).get("counts", np.zeros(n, np.int64))
    b = hash_.keys & 0xFFFFFFFF
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    return PairCounts(hash_, counts, counts == highest[b])


_ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups string"


def _second_pass(docs: DataFrame, a_path: str, b_path: str, counts, schema: str) -> DataFrame:
    """The alignment of ``id, text`` rows; with ``n_best, count_sum`` from broadcast counts, else with
    the distinct ``links`` of each text."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        for batch in sliced(batches, 1):
            for part in aligner.slices(batch.column(1)):
                n_groups = part.per_text(part.words.n_groups)
                columns = [
                    batch.column(0).take(pa.array(part.rows)),
                    pa.array(part.per_text(part.words.n_a)),
                    pa.array(part.per_text(part.words.n_b)),
                    pa.array(n_groups),
                    pa.array(n_groups),
                    part.groups(),
                ]
                names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]
                keys, word = part.keys()
                if counts is not None:
                    n, best = counts.value.of(keys)
                    for name, values in (("n_best", best.astype(np.int64)), ("count_sum", n)):
                        by_word = np.zeros(len(part.words.ok), np.int64)
                        np.add.at(by_word, word, values)
                        columns.append(pa.array(part.per_text(by_word)))
                        names.append(name)
                else:
                    columns.append(_links(part, keys, word))
                    names.append("links")
                columns[5] = columns[5].cast(pa.string()) if columns[5].nbytes < 1 << 31 else columns[5]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(align, schema)


def _links(part: Slice, keys: np.ndarray, word: np.ndarray) -> pa.Array:
    """Distinct pairs of each text with how often it has them."""
    begin = np.searchsorted(word, np.arange(len(part.words.ok) + 1))
    lists = []
    for i in range(len(part.rows)):
        some, times = np.unique(part.codes[part.offsets[i] : part.offsets[i + 1]], return_counts=True)
        totals: dict[int, int] = {}
        for w, t in zip(some.tolist(), times.tolist(), strict=True):
            for key in keys[begin[w] : begin[w + 1]].tolist():
                totals[key] = totals.get(key, 0) + t
        lists.append(list(totals.items()))
    return pa.array(
        [[{"key": k, "times": t} for k, t in x] for x in lists],
        pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())])),
    )


def _joined(docs: DataFrame, a_path: str, b_path: str, partial: DataFrame) -> DataFrame:
    """The second pass for more pairs than are broadcast: links are joined with their counts."""
    rows = written(
        _second_pass(docs, a_path, b_path, None, f"{_ALIGNED}, links array<struct<key: long, times: long>>")
        .withColumn("row", F.monotonically_increasing_id()),
        "aligned",
    )
    counts = _best_of(partial.groupBy("key").agg(F.sum("n").alias("n")))
    links = rows.select("row", F.explode("links").alias("l")).select("row", "l.*")
    found = (
        links.join(counts, "key")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        )
    )
    none = F.lit(0).cast("long")
    return (
        rows.drop("links")
        .join(found, "row", "left")
        .withColumns({c: F.coalesce(c, none) for c in ("n_best", "count_sum")})
        .drop("row")
    )


def align(
    docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, groups, n_best, count_sum`` of every row.

    Tokens of A (a byte-level tokenizer, over a space and the text) and of B (a piece model, which
    adds the space itself) are cut into groups where tokens of both end. ``groups`` lists their ids as
    ``a1,a2|b1;a3|b2,b3``. The tokens that end together, the last of each group, are linked; an id
    pair's count is how many links of the whole corpus have it. ``count_sum`` adds the counts over the
    links of a text, ``n_best`` says for how many no other A id has a higher count with their B id.

    A text that is null or empty, or whose tokens do not give its bytes back, has no tokens: zeros and
    an empty string. Special strings are plain text. Texts are aligned whole, their groups string is
    two gigabytes at most. Rows that repeat count each, ids may be null, an empty table gives no rows,
    and other columns are left aside whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    partial = written(partial_counts(rows, a_path, b_path, "text"), "pairs")
    distinct = written(partial.select("key").distinct(), "distinct-pairs")
    n = distinct.count()
    if n > HASHED_PAIRS:
        out = _joined(rows, a_path, b_path, partial)
    else:
        counts = docs.sparkSession.sparkContext.broadcast(hashed_counts(partial, distinct, n))
        out = _second_pass(rows, a_path, b_path, counts, f"{_ALIGNED}, n_best long, count_sum long")
    return out.withColumnRenamed("id", id_col)
