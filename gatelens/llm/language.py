"""Language of whole texts by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled texts into a fixed number of buckets, partition by
partition; the sums become one matrix of log probabilities (buckets by languages) that is broadcast.
A text scores the sum of the rows of its n-grams.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import REPORT, clear_of, report, summed
from gatelens.llm.token_ids import sliced

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages that a model may have; the matrix and what a task counts are bounded by it.
MOST_LANGUAGES = 256
#: Code points whose n-grams are made at a time; longer texts are cut with an overlap.
WINDOW = 1_000_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    #: ``BUCKETS`` rows of one log probability a language.
    matrix: np.ndarray


def windows(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
    """Neighbouring texts in one string: text numbers, string, lengths, first positions to use.

    Of a text over ``WINDOW`` code points each part but the last leaves its last positions, which
    the next part repeats, to that one.
    """
    rows: list[int] = []
    parts: list[str] = []
    uses: list[int] = []
    size = 0

    def pack() -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in parts])
        return np.array(rows), "".join(parts), lengths, np.array(uses)

    overlap = max(ORDERS) - 1
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), WINDOW):
            part = text[at : at + WINDOW + overlap]
            rows.append(row)
            parts.append(part)
            uses.append(WINDOW if at + WINDOW < len(text) else len(part))
            size += len(part)
            if size >= WINDOW:
                yield pack()
                rows, parts, uses, size = [], [], [], 0
    if rows:
        yield pack()


def grams(
    texts: Sequence[str | None],
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of n-grams, with the numbers of the texts and how many buckets each has, in order."""
    for rows, joined, lengths, uses in windows(texts):
        codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        if len(codes) != len(joined):  # a letter whose lower case is several code points
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum(lengths) - lengths
        for order in ORDERS:
            n = np.clip(np.minimum(uses, lengths - order + 1), 0, None)
            if not n.any():
                continue
            code = np.full(len(codes) - order + 1, order, np.uint32)
            for i in range(order):
                code *= np.uint32(0x01000193)
                code ^= codes[i : len(codes) - order + 1 + i]
            code *= np.uint32(0x9E3779B1)
            code >>= np.uint32(16)
            if n.sum() != len(code):
                inside = np.zeros(len(codes) + 1, np.int8)
                np.add.at(inside, first, (n > 0).astype(np.int8))
                np.add.at(inside, first + n, -(n > 0).astype(np.int8))
                code = code[np.cumsum(inside[: len(code)]) > 0]
            yield code, rows[n > 0], n[n > 0]


def train(docs: DataFrame, text: str, lang: str) -> LanguageModel:
    """A model of all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in sliced(batches, 0):
            texts, langs = batch.column(0), batch.column(1)
            for name in pc.unique(langs).to_pylist():
                some = texts.filter(pc.equal(langs, name)).to_pylist()
                if len(totals) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                total = totals.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += len(some)
                for codes, _, _ in grams(some):
                    total[:BUCKETS] += np.bincount(codes, minlength=BUCKETS)
        for name, total in totals.items():
            yield from report(name, TaskContext.get().partitionId(), total)

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = summed(rows.mapInArrow(count, REPORT), BUCKETS + 1)
    names = sorted(counts)
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.array([counts[name] for name in names], float).reshape(len(names), BUCKETS + 1).T
    rate = (table[:BUCKETS] + SMOOTHING) / (table[:BUCKETS].sum(0) + SMOOTHING * BUCKETS)
    prior = np.log(table[BUCKETS] / max(1.0, table[BUCKETS].sum()))
    return LanguageModel(names, prior, np.log(rate).astype(np.float32))


def scores(model: LanguageModel, texts: Sequence[str | None]) -> np.ndarray:
    """Log probabilities of text and language, by text and language."""
    total = np.tile(model.prior, (len(texts), 1))
    for codes, rows, n in grams(texts):
        sums = np.add.reduceat(model.matrix[codes], np.cumsum(n) - n, axis=0, dtype=np.float64)
        np.add.at(total, rows, sums)
    return total


def predictor(docs: DataFrame, model: LanguageModel, text: str) -> Column:
    """A column ``lang_pred, score`` for ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        names = pa.array([*known.languages, UNKNOWN])
        for whole in batches:
            found = []
            for part in sliced(iter([pa.record_batch([whole], names=["text"])]), 0):
                texts = part.column(0)
                letters = pc.match_substring_regex(texts, r"\p{L}").fill_null(False)
                some = letters.to_numpy(zero_copy_only=False) & bool(known.languages)
                best = np.full(len(texts), len(known.languages))
                score = np.zeros(len(texts))
                if some.any():
                    total = scores(known, texts.filter(pa.array(some)).to_pylist())
                    chance = np.exp(total - total.max(1, keepdims=True))
                    best[some] = total.argmax(1)
                    score[some] = (chance / chance.sum(1, keepdims=True)).max(1)
                found.append(
                    pa.StructArray.from_arrays(
                        [names.take(pa.array(best)), pa.array(score)], names=["lang_pred", "score"]
                    )
                )
            kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
            yield pa.concat_arrays(found) if found else pa.array([], kind)

    return predict(F.col(text))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language.

    Texts that are null, empty or without a letter, and all texts under a model without languages,
    get ``und`` and 0. Of equally likely languages the first by name is taken. Whole texts count,
    equal texts get equal results, and columns of those names in ``docs`` are replaced.
    """
    rows = clear_of(docs, ["lang_pred", "score"])
    found = rows.withColumn("_found", predictor(docs, model, text))
    return found.withColumns(
        {"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}
    ).drop("_found")


def held_out(id_col: str) -> Column:
    """Rows that training leaves out: crc32 of the id as text, modulo 4, is 2; never a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
