"""Token counts of whole texts from cached counts of their pre-tokens.

A piece model never merges over the start of a word, so the count of a text is the sum of the
counts of its pre-tokens. Two tiers give those: a broadcast table with the counts of the most
frequent pre-tokens of the corpus, and a cache of each Python worker for all others, filled by the
library. Pre-tokens are never shuffled; only a bounded summary of each partition is.
"""

import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in the broadcast table, at most; a longer pre-token than WIDEST never enters it.
FREQUENT = 16_384
WIDEST = 64
#: Pre-tokens that one partition reports for that table, at most.
SUMMARY = 8_192
#: Pre-tokens in one of the two generations of a worker's cache.
GENERATION = 150_000

_WORKER: dict[str, "PieceCounts"] = {}


class PieceCounts(dict):
    """Tokens by pre-token; unknown ones are encoded when asked for.

    A key is a word without the space before it, and may start with further spaces. A key that
    starts with a line feed stands for a word right after that line feed, without a space.
    """

    def __init__(self, model: str) -> None:
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.old: dict[str, int] = {}
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        #: False for a model whose pieces span words or line feeds: whole texts are encoded then.
        self.splits = not any(
            "▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in pieces
        ) and len(self.library.encode("\na")) == 1 + len(self.library.encode("a\n"))

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = len(self.library.encode(word))
            if not word:
                n = 1  # a lone space at the end of a text
            elif word[0] == "\n":
                n -= 1
        self[word] = n
        if len(self) > GENERATION:
            self.old = dict(self)
            self.clear()
        return n

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.library.encode(text))
        if "  " in text or " \n" in text or "▁" in text or text[0] == " " or text[-1] == " ":
            return self.of_spaced(text)
        return sum(map(self.__getitem__, pre_tokens(text)))

    def of_spaced(self, text: str) -> int:
        """Texts with runs of spaces: a run belongs to the word behind it."""
        total = 0
        spaces = 0
        for word in text.replace("▁", " ").split(" "):
            if word:
                key = " " * spaces + word
                total += self[key] + (key[0] == "\n")
                spaces = 0
            else:
                spaces += 1
        if spaces:
            total += self[" " * (spaces - 1)]
        return total


def pre_tokens(text: str) -> list[str]:
    """Words of a text without runs of spaces, split before line feeds as well."""
    return text.replace("\n", " \n").split(" ")


def counts_of(model: str) -> PieceCounts:
    """The cache of this worker, kept from task to task."""
    if model not in _WORKER:
        _WORKER[model] = PieceCounts(model)
    return _WORKER[model]


def frequent_pre_tokens(docs: DataFrame, text: str, limit: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts, ``limit`` at most.

    Each partition counts its own and reports its ``SUMMARY`` most frequent; the reports are added
    up. While a partition counts, rare words are dropped whenever there are too many, so memory is
    bounded and counts may be a little low; the table only saves time and never changes a count.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    seen.update(pre_tokens(value))
                if len(seen) > 16 * SUMMARY:
                    seen = Counter(dict(seen.most_common(4 * SUMMARY)))
        top = heapq.nlargest(
            SUMMARY, ((n, w) for w, n in seen.items() if 0 < len(w) <= WIDEST)
        )
        yield pa.RecordBatch.from_pydict(
            {"word": [w for _, w in top], "n": [n for n, _ in top]},
            schema=pa.schema([("word", pa.string()), ("n", pa.int64())]),
        )

    found = docs.select(F.col(text).alias("text")).mapInArrow(summarise, "word string, n long")
    ranked = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word")
    return [row.word for row in ranked.limit(limit).collect()]


def token_counter(docs: DataFrame, text: str, model: str, *, frequent: int = FREQUENT) -> Column:
    """A column with the tokens of ``text``; the frequent tier is taken from ``docs`` first."""
    counts = counts_of(model)
    words = frequent_pre_tokens(docs, text, frequent) if counts.splits and frequent else []
    tier = docs.sparkSession.sparkContext.broadcast({word: counts[word] for word in words})

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mine = counts_of(model)
        mine.update(tier.value)
        for texts in batches:
            yield pd.Series([mine.of_text(value) for value in texts], dtype="int64")

    return tokens(F.col(text))


def count_tokens(
    docs: DataFrame,
    model: str,
    *,
    text: str = "text",
    limit: int = 4096,
    frequent: int = FREQUENT,
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each, an empty table
    gives an empty result, and columns of those names that ``docs`` has are replaced. Texts of any
    length are counted whole.
    """
    n = token_counter(docs, text, model, frequent=frequent)
    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"),
            "n_tokens": n,
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
