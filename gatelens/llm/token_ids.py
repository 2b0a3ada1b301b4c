"""Token ids of whole texts from the ids of their words, kept in each Python worker.

A tokenizer that drops white space and cuts a text into runs of letters, single digits and runs of
other signs merges only inside those runs. So each distinct run is encoded once and the ids of a
text are joined from them. Texts with signs for which the runs are not certain go, word by word,
through the library.
"""

import json
import os
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Runs in one of the two generations of a worker's cache.
GENERATION = 150_000
#: Bytes of text that are cut into words at a time; a longer text is a slice of its own.
SLICE = 4_000_000

# The layout for which runs may be cut here: fixed values of the public tokenizer file.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: Signs whose class and lower case are the same for every regular expression library.
_CERTAIN = r"^[\x20-\x7e\n\r\tÀ-ÖØ-öø-ÿ]*$"
_RUN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"
#: What follows the cut into runs: bytes are written as signs.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
_SPACES = re.compile(r"[ \n\r\t]+")

_WORKER: dict[str, "WordIds"] = {}


def byte_signs() -> dict[str, int]:
    """The bytes that the signs of a byte-level vocabulary stand for: printable Latin-1 signs for
    themselves, all other bytes, in order, for the signs from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers in one byte string each."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self.cuts = _cuts_into_runs(layout)
        self.signs = {b: sign for sign, b in byte_signs().items()}
        self.specials = [token["content"] for token in layout["added_tokens"]]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def of_texts(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text as one binary value, with the id ``end`` behind them if given.

        No special tokens are put around a text, and a null text has no ids.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        certain = self._certain(texts)
        out = self._from_words(pc.if_else(certain, texts, ""))
        if not pc.all(certain).as_py():
            pairs = zip(certain.to_pylist(), texts.to_pylist(), strict=True)
            rest = [None if known else self._from_library(text) for known, text in pairs]
            out = pc.if_else(certain, out, pa.array(rest, pa.large_binary()))
        if end is None:
            return out
        last = pa.scalar(packed([end]), pa.large_binary())
        return pc.binary_join_element_wise(out, last, pa.scalar(b"", pa.large_binary()))

    def _certain(self, texts: pa.Array) -> pa.Array:
        """Whether the words of a text can be cut here."""
        if not self.cuts:
            return pa.array(np.zeros(len(texts), dtype=bool))
        certain = pc.match_substring_regex(texts, _CERTAIN)
        for special in self.specials:
            certain = pc.and_not(certain, pc.match_substring(texts, special))
        return certain

    def _from_words(self, texts: pa.Array) -> pa.Array:
        """Ids of texts that are certain: each distinct word is cut, and each distinct run looked up, once."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        words = pc.dictionary_encode(lists.flatten())
        cut = pc.replace_substring_regex(words.dictionary, _RUN, r"\0 ")
        run_lists = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(cut))
        runs = pc.dictionary_encode(run_lists.flatten())
        known = self._of_runs(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        width = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        table = np.frombuffer(b"".join(known), "<u4")
        # ids of words from those of their runs, and of texts from those of their words
        for coded, lengths in ((runs, run_lists), (words, lists)):
            codes = coded.indices.to_numpy(zero_copy_only=False)
            sizes = width[codes]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            first = (np.cumsum(width) - width)[codes]
            table = table[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
            offsets = ends[lengths.offsets.to_numpy() - lengths.offsets[0].as_py()]
            width = np.diff(offsets)
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(),
            len(texts),
            [None, pa.py_buffer((offsets * 4).astype(np.int64)), pa.py_buffer(table)],
        )

    def _of_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs in lower case; an empty one has none."""
        young, old = self.young, self.old
        young[""] = b""
        missing = [run for run in runs if run not in young]
        new = []
        for run in missing:
            if run in old:
                young[run] = old[run]
            else:
                new.append(run)
        self._encode(new)
        found = [young[run] for run in runs]
        if len(young) > GENERATION:
            self.old, self.young = young, {}
        return found

    def _from_library(self, text: str) -> bytes:
        if not self.cuts or self._has_special(text):
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        keys = [word for word in _SPACES.split(text) if word]
        for key in keys:
            if key not in self.odd:
                if len(self.odd) > GENERATION // 4:
                    self.odd = {}
                self.odd[key] = packed(self.library.encode(key, add_special_tokens=False).ids)
        return b"".join([self.odd[key] for key in keys])

    def _has_special(self, text: str) -> bool:
        return any(special in text for special in self.specials)

    def _encode(self, runs: list[str]) -> None:
        """Ids of runs from the merges alone: they are normal and cut already."""
        tokenize, signs = self.library.model.tokenize, self.signs
        for run in runs:
            known = run if run.isascii() else "".join([signs[b] for b in run.encode()])
            ids = [token.id for token in tokenize(known)]
            self.young[run] = struct.pack(f"<{len(ids)}I", *ids)


def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches with at most ``SLICE`` bytes of text, so that few ids are held at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
        pa.default_memory_pool().release_unused()


def _cuts_into_runs(layout: dict) -> bool:
    steps = layout.get("normalizer") or {}
    parts = (layout.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        [n.get("type") for n in steps.get("normalizers", [])] == _NORMALIZERS
        and parts[0].get("pattern") == {"Regex": _PATTERN}
        and parts[0].get("behavior") == "Removed"
        and bool(parts[0].get("invert"))
        and len(parts) == 2
        and {name: parts[1].get(name) for name in _BYTES} == _BYTES
        and layout["model"].get("end_of_word_suffix") == "</w>"
        and not layout["model"].get("dropout")
    )


def packed(ids: Sequence[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def ids_of(path: str) -> WordIds:
    """The ids kept by this worker, from task to task."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    return _WORKER[path]
