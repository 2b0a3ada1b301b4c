"""N best segmentations of whole texts over the pieces of a sentence-piece model, and decoding.

Forward Viterbi gives the best score of every prefix; a backward A-star search with those scores as
exact heuristics then yields segmentations best first. No piece spans a pair of signs that no piece
contains, so the lattice of a text is a chain of small ones: distinct words are cut there, and each
distinct part gets its best score and its gap to the second, kept by the Python worker. Only the few
words with the smallest gaps can be off their best among the best of a text, and those alone are
searched for more.
"""

import heapq
import math
import re
import sys
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.llm.token_ids import packed, sliced

#: Segmentations of a text.
BEST = 4
#: Parts of words in one of the two generations of a worker's cache.
GENERATION = 240_000
#: Words whose best segmentations a worker keeps.
LISTS = 30_000
#: What a sign without a piece costs below the worst piece; it is written as its bytes.
UNKNOWN = 10.0
SPACE = "▁"

_WORDS = re.compile(r"\n[^▁\n]*|▁+[^▁\n]*|[^▁\n]+")
_WORKER: dict[tuple[str, int], "Lattices"] = {}

#: Score, ids (little-endian unsigned 32 bits) of one segmentation.
Cut = tuple[float, bytes]


class Lattices:
    """The best segmentation of parts of words and how far behind the second is.

    Words come without the space sign before them; one that starts with a line feed has none. A part
    has ``score, gap, ids``; the gap is infinite where there is one segmentation.
    """

    def __init__(self, model: str, best: int) -> None:
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.best = best
        self.pieces: dict[str, tuple[float, bytes]] = {}
        self.bytes: dict[int, bytes] = {}
        table: list[bytes] = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = packed([i])
                table.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                table.append(b"")
            else:
                self.pieces[piece] = (library.get_score(i), packed([i]))
                table.append(piece.replace(SPACE, " ").encode())
        #: Bytes by id.
        self.table = pa.array(table, pa.large_binary())
        self.unknown_id = packed([library.unk_id()])
        #: Pieces, and None for what only begins one.
        self.begins = {p[:i]: None for p in self.pieces for i in range(1, len(p))} | self.pieces
        pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        #: Rows and columns of signs in the table of pairs that some piece contains; 0 for all others.
        self.row, firsts = numbered({two[0] for two in pairs})
        self.column, seconds = numbered({two[1] for two in pairs})
        self.paired = np.zeros((firsts + 1, seconds + 1), bool)
        for one, other in pairs:
            self.paired[self.row[ord(one)], self.column[ord(other)]] = True
        #: Finds all pieces that end at each place, longest first.
        self.finder = ahocorasick.Automaton()
        for piece, (score, ids) in self.pieces.items():
            self.finder.add_word(piece, (len(piece), score, ids))
        if self.pieces:
            self.finder.make_automaton()
        self.signs = {p for p in self.pieces if len(p) == 1}
        lowest = min((s for s, _ in self.pieces.values() if s > -1e8), default=0.0)
        self.unknown = lowest - UNKNOWN
        self.parts: dict[str, tuple[float, float, bytes]] = {}
        self.old_parts: dict[str, tuple[float, float, bytes]] = {}
        self.lists: dict[str, list[Cut]] = {}

    def of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Scores, gaps and ids of distinct parts."""
        found = list(map(self.parts.get, parts))
        old = self.old_parts
        for i, value in enumerate(found):
            if value is None:
                part = parts[i]
                found[i] = self.parts[part] = old.get(part) or self.viterbi(part)
        if len(self.parts) > GENERATION:
            self.old_parts, self.parts = self.parts, {}
        scores, gaps, ids = zip(*found, strict=True)
        return np.array(scores), np.array(gaps), pa.array(ids, pa.large_binary())

    def best_of(self, parts: list[str]) -> list[Cut]:
        """The best segmentations of the word of these parts, best first."""
        word = "".join(parts)
        found = self.lists.get(word)
        if found is None:
            found = [(0.0, b"")]
            for part in parts:
                found = merged(found, self.search(part), self.best)
            if len(self.lists) > LISTS:
                self.lists = {}
            self.lists[word] = found
        return found

    def cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of the words, with their space signs, between which no piece can lie.

        The second is where the parts of each word begin, and where those of the last one end.
        """
        none, space = pa.scalar("", words.type), pa.scalar(SPACE, words.type)
        before = pc.if_else(pc.starts_with(words, "\n"), none, space)
        raw, places = joined(pc.binary_join_element_wise(before, words, none))
        signs = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), "<u4")
        size = 1 + (signs > 0x7F).astype(np.int64) + (signs > 0x7FF) + (signs > 0xFFFF)
        ends = np.concatenate([[0], np.cumsum(size)])
        begins = np.ones(len(ends), bool)
        begins[1:-1] = ~self.paired[self.row[signs[:-1]], self.column[signs[1:]]]
        begins[np.searchsorted(ends, places)] = True
        cuts = ends[begins]
        return spliced(raw, cuts, pa.large_string()), np.searchsorted(cuts, places)

    def of_sign(self, sign: str) -> tuple[float, bytes]:
        """Score and ids of a sign that is no piece."""
        raw = sign.encode("utf-8", "surrogatepass")
        return self.unknown, b"".join([self.bytes.get(b, self.unknown_id) for b in raw])

    def viterbi(self, text: str) -> tuple[float, float, bytes]:
        """Score and ids of the best segmentation of one part, and the gap to the second.

        The second leaves the best at one node by the second way into it. Of ways of one total the
        one with the shortest last piece is taken, as in ``search``.
        """
        n = len(text)
        ahead = [-math.inf] * (n + 1)
        second = [-math.inf] * (n + 1)
        way: list[tuple[int, bytes]] = [(0, b"")] * (n + 1)
        ahead[0] = 0.0
        begins = self.begins
        known = self.signs.issuperset(text)
        if known:
            for last, (size, score, ids) in self.finder.iter(text):
                end = last + 1
                total = ahead[end - size] + score
                if total >= ahead[end]:
                    second[end] = ahead[end]
                    ahead[end] = total
                    way[end] = (end - size, ids)
                elif total > second[end]:
                    second[end] = total
        for start in () if known else range(n):
            base = ahead[start]
            end = start + 1
            piece = begins.get(text[start:end]) or self.of_sign(text[start])
            while True:
                if piece:
                    total = base + piece[0]
                    if total >= ahead[end]:
                        second[end] = ahead[end]
                        ahead[end] = total
                        way[end] = (start, piece[1])
                    elif total > second[end]:
                        second[end] = total
                end += 1
                if end > n:
                    break
                piece = begins.get(text[start:end], 0)
                if piece == 0:
                    break
        gap = math.inf
        ids = []
        at = n
        while at:
            if ahead[at] - second[at] < gap:
                gap = ahead[at] - second[at]
            at, last = way[at]
            ids.append(last)
        ids.reverse()
        return ahead[n], gap, b"".join(ids)

    def search(self, text: str) -> list[Cut]:
        """The best segmentations of one part by A-star from its end.

        The agenda holds the next-best way into a node for a given rest of the text; from there the
        search follows the best way to the start, whose total the heuristic already gives.
        """
        n = len(text)
        into: list[list[tuple[float, int, tuple[float, bytes]]]] = [[] for _ in range(n + 1)]
        ahead = [-math.inf] * (n + 1)
        ahead[0] = 0.0
        begins = self.begins
        for start in range(n):
            base = ahead[start]
            alone = text[start]
            if not begins.get(alone):
                sign = self.of_sign(alone)
                into[start + 1].append((base + sign[0], start, sign))
                ahead[start + 1] = max(ahead[start + 1], base + sign[0])
            for end in range(start + 1, n + 1):
                piece = begins.get(text[start:end], 0)
                if piece == 0:
                    break
                if piece:
                    total = base + piece[0]
                    into[end].append((total, start, piece))
                    if total > ahead[end]:
                        ahead[end] = total
        found: list[Cut] = []
        ordered = [False] * (n + 1)
        agenda: list[tuple] = [(-ahead[n], 0, n, 0, 0.0, ())]
        made = 0
        while agenda and len(found) < self.best:
            _, _, at, which, behind, path = heapq.heappop(agenda)
            while at:
                ways = into[at]
                if not ordered[at]:
                    ways.sort(reverse=True)
                    ordered[at] = True
                if which + 1 < len(ways):
                    made += 1
                    other = -(ways[which + 1][0] + behind)
                    heapq.heappush(agenda, (other, made, at, which + 1, behind, path))
                _, at, (score, ids) = ways[which]
                behind += score
                path = (ids, path)
                which = 0
            parts = []
            while path:
                ids, path = path
                parts.append(ids)
            found.append((behind, b"".join(parts)))
        return found

    def keys_of(self, texts: pa.Array) -> pa.ListArray:
        """Keys of the words of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, "^$|^ | $|  | \n|" + SPACE)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        if not pc.any(odd).as_py():
            return lists
        rest = [
            keys_of_spaced(text) if is_odd else None
            for text, is_odd in zip(texts.to_pylist(), odd.to_pylist(), strict=True)
        ]
        return pc.if_else(odd, pa.array(rest, lists.type), lists)

    def of_texts(self, texts: pa.Array) -> list[list[Cut]]:
        """The best segmentations of each text; an empty or null text has one, without pieces.

        Of equal scores the one with fewer words off their best comes first, then the one whose
        first such word is earlier.
        """
        lists = self.keys_of(texts)
        words = pc.dictionary_encode(lists.flatten())
        if not len(words):
            return [[(0.0, b"")] for _ in range(len(texts))]
        parts, first = self.cut(words.dictionary)
        parts = pc.dictionary_encode(parts)
        names = parts.dictionary.to_pylist()
        scores, gaps, ids = self.of_parts(names)
        codes = words.indices.to_numpy(zero_copy_only=False)
        part = parts.indices.to_numpy(zero_copy_only=False)
        scores = scores[part]
        each = scores[first[:-1]]
        several = np.flatnonzero(np.diff(first) > 1)
        ends = zip(first[several].tolist(), first[several + 1].tolist(), strict=True)
        scores = scores.tolist()
        each[several] = [sum(scores[a:b]) for a, b in ends]
        score = each[codes]
        gap = np.minimum.reduceat(gaps[part], first[:-1])[codes]
        ids, places = joined(ids.take(parts.indices))
        ids, places = joined(spliced(ids, places[first], pa.large_binary()).take(words.indices))
        cuts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        out = []
        for a, b in pairwise(cuts):
            start, end = int(places[a]), int(places[b])
            whole = ids[start:end].tobytes()
            total = float(score[a:b].sum())
            near = np.argsort(gap[a:b], kind="stable")[: self.best - 1].tolist()
            choices = {}
            for i in sorted(near):
                if gap[a + i] < math.inf:
                    word = codes[a + i]
                    choices[i] = self.best_of([names[p] for p in part[first[word] : first[word + 1]]])
            found = [(total, whole)]
            for loss, changes in deviations(choices, self.best - 1):
                other, done = [], 0
                for place, which in changes:
                    other += whole[done : places[a + place] - start], choices[place][which][1]
                    done = places[a + place + 1] - start
                found.append((total - loss, b"".join([*other, whole[done:]])))
            out.append(found)
        return out

    def decoded(self, ids: bytes) -> str:
        """The text of ids; the space sign before the first word is left off."""
        return self.all_decoded([ids])[0]

    def all_decoded(self, ids: list[bytes]) -> list[str]:
        """The texts of lists of ids; the space sign before a first word is left off."""
        numbers = np.frombuffer(b"".join(ids), "<u4")
        raw, places = joined(self.table.take(pa.array(numbers)))
        out = []
        for a, b in pairwise(places[np.cumsum([0, *map(len, ids)]) // 4].tolist()):
            text = str(raw[a:b], "utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
        return out


def numbered(signs: set[str]) -> tuple[np.ndarray, int]:
    """A number from 1 by code point for each of the signs, 0 for all others, and how many there are."""
    numbers = np.zeros(sys.maxunicode + 1, np.uint32)
    numbers[[ord(sign) for sign in signs]] = np.arange(1, len(signs) + 1)
    return numbers, len(signs)


def joined(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of large values one after the other, and where each begins and the last ends."""
    _, places, raw = values.buffers()
    if not len(values):
        return memoryview(b""), np.zeros(1, np.int64)
    places = np.frombuffer(places, np.int64)[values.offset : values.offset + len(values) + 1]
    return memoryview(raw or b"")[places[0] : places[-1]], places - places[0]


def spliced(raw: memoryview, places: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values that ``joined`` takes apart."""
    places = np.ascontiguousarray(places, np.int64)
    buffers = [None, pa.py_buffer(places), pa.py_buffer(raw)]
    return pa.Array.from_buffers(kind, len(places) - 1, buffers)


def keys_of_spaced(text: str) -> list[str]:
    """Keys of a text that has runs of spaces or space signs of its own."""
    if not text:
        return []
    words = _WORDS.findall(SPACE + text.replace(" ", SPACE))
    return [word[1:] if word[0] == SPACE else word for word in words]


def merged(left: list[Cut], right: list[Cut], best: int) -> list[Cut]:
    """The best of all ways to follow one of ``left`` by one of ``right``."""
    if len(right) == 1:
        return [(score + right[0][0], ids + right[0][1]) for score, ids in left]
    ways = [
        (-(a + b), i + j, i, first + second)
        for i, (a, first) in enumerate(left)
        for j, (b, second) in enumerate(right)
    ]
    return [(-loss, ids) for loss, _, _, ids in sorted(ways)[:best]]


def deviations(
    words: dict[int, list[Cut]], best: int
) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The cheapest sets of words that are off their best, as loss and (place, which) pairs.

    Only the ``best`` words with the smallest gaps can take part; they come by ascending place.
    """
    ways: list[tuple[float, int, tuple[tuple[int, int], ...]]] = [(0.0, 0, ())]
    for place, cuts in words.items():
        more = [
            (loss + cuts[0][0] - cuts[which][0], n + 1, (*changes, (place, which)))
            for loss, n, changes in ways
            for which in range(1, len(cuts))
        ]
        ways = sorted(ways + more)[: best + 1]
    return [(loss, changes) for loss, n, changes in ways if n][:best]


def lattices_of(model: str, best: int) -> Lattices:
    """The words kept by this worker, from task to task."""
    if (model, best) not in _WORKER:
        _WORKER[model, best] = Lattices(model, best)
    return _WORKER[model, best]


def encode_nbest(
    docs: DataFrame, model: str, *, best: int = BEST, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_col, nbest, decoded``: scores and ids of the best segmentations, best first.

    ``nbest`` is an array of ``score, ids`` (little-endian unsigned 32-bit integers); ``decoded`` is
    the text that the first one stands for. A null or empty text has one segmentation without
    pieces. Signs without a piece are written as their bytes. A text of any length is taken whole,
    repeated rows are encoded each, other columns are left aside.
    """
    cut = pa.struct([("score", pa.float64()), ("ids", pa.large_binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lattices_of(model, best)
        for batch in sliced(batches, 1):
            found = words.of_texts(batch.column(1))
            rows = [[{"score": s, "ids": ids} for s, ids in cuts] for cuts in found]
            decoded = words.all_decoded([cuts[0][1] for cuts in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(cut)), pa.array(decoded, pa.string())],
                names=["id", "nbest", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    kind = "id long, nbest array<struct<score: double, ids: binary>>, decoded string"
    return rows.mapInArrow(encode, kind).withColumnRenamed("id", id_col)


def decoder(model: str, ids: str) -> Column:
    """A column with the text of a binary column of ids; null for null."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = lattices_of(model, BEST)
        for values in batches:
            texts = words.all_decoded(pc.fill_null(values, b"").to_pylist())
            yield pa.array(texts, pa.string(), mask=~values.is_valid().to_numpy(False))

    return decode(F.col(ids))
