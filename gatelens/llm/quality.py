"""Quality by importance weights: how much likelier a text is under the target than under the corpus.

Two generative models over hashed words and pairs of words: one of documents labelled good, one of
all documents. The mean log ratio of a text's features is its score. A threshold accepts or rejects;
it is fitted on labelled documents, each scored by a target model that has not seen its text. And a Gumbel top-k draw resamples documents by their weights.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import REPORT, clear_of, report, summed
from gatelens.llm.token_ids import sliced

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Labelled documents that the target model and the threshold are fitted on, at most.
LABELLED = 20_000
#: Neutral features added to each text, so that a few words alone decide little.
NEUTRAL = 20.0
#: Parts of the labelled documents; each is scored by a target model of the other parts.
FOLDS = 10
#: Share of good labelled documents, scored out of their fold, that the threshold must accept.
KEEP_GOOD = 0.995


@dataclass
class QualityModel:
    #: Log ratio of target and corpus by bucket.
    ratio: np.ndarray
    threshold: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and neighbouring pairs of all texts, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    signs = pc.replace_substring_regex(texts, r"([!-/:-@\[-`{-~]+)", r" \1 ")
    signs = pc.ascii_trim_whitespace(signs)
    lists = pc.ascii_split_whitespace(signs)
    words = pc.dictionary_encode(lists.flatten())
    hashes = np.array(
        [xxhash.xxh32_intdigest(w) if w else 0 for w in words.dictionary.to_pylist()], np.uint32
    )
    word = hashes[words.indices.to_numpy(zero_copy_only=False)]
    cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    n = np.diff(cuts)
    pair = np.empty(2 * len(word), np.uint32)
    pair[::2] = word
    follows = np.append(word[1:], np.uint32(0)) * np.uint32(0x85EBCA6B)
    pair[1::2] = (word * np.uint32(0xC2B2AE35)) ^ follows
    pair *= np.uint32(0x9E3779B1)
    pair >>= np.uint32(16)
    used = np.ones(len(pair), bool)
    used[2 * cuts[1:][n > 0] - 1] = False  # the last word of a text has no follower
    blank = (n == 1) & (pc.binary_length(signs).to_numpy(zero_copy_only=False) == 0)
    used[2 * cuts[:-1][blank]] = False
    return pair[used], np.where(blank, 0, np.maximum(2 * n - 1, 0))


def labelled_sample(labels: DataFrame, id_col: str, rows: int = LABELLED) -> DataFrame:
    """``id, good`` of at most ``rows`` labelled ids, those whose ids hash lowest.

    An id that is labelled several times is good if all its labels say so; a toxic document is
    never a target.
    """
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    each = known.groupBy(F.col(id_col).alias("id")).agg(
        F.min("quality").alias("quality"), F.max(toxic).alias("toxic")
    )
    lowest = each.orderBy(F.xxhash64("id"), "id").limit(rows)
    return lowest.select("id", F.col("quality").cast("int").alias("quality"), "toxic")


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text"
) -> QualityModel:
    """Count all documents for the corpus, the good ones of the labelled sample for the target.

    The threshold is fitted on scores of labelled documents under target counts without their fold,
    as documents without a label are not in the counts either. Equal texts are in one fold.
    """
    spark = docs.sparkSession
    sample = labelled_sample(labels, id_col).toPandas()
    good = sample[(sample["quality"] == 1) & (sample["toxic"] == 0)]["id"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(np.sort(good))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = np.zeros(BUCKETS, np.int64)
        target = np.zeros((FOLDS, BUCKETS), np.int64)
        for batch in sliced(batches, 1):
            ids = batch.column(0).fill_null(-1).to_numpy()
            wanted = np.isin(ids, shared.value) & batch.column(0).is_valid().to_numpy(False)
            codes, sizes = features(batch.column(1))
            corpus += np.bincount(codes, minlength=BUCKETS)
            fold = batch.column(2).to_numpy()
            for k in np.unique(fold[wanted]):
                own = codes[np.repeat(wanted & (fold == k), sizes)]
                target[k] += np.bincount(own, minlength=BUCKETS)
        part = TaskContext.get().partitionId()
        yield from report("corpus", part, corpus)
        for k in range(FOLDS):
            yield from report(f"target {k}", part, target[k])

    fold = F.pmod(F.xxhash64(F.col(text)), F.lit(FOLDS)).alias("fold")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), fold)
    counts = summed(rows.mapInArrow(count, REPORT), BUCKETS)
    none = np.zeros(BUCKETS, np.int64)
    corpus = counts.get("corpus", none)
    targets = np.array([counts.get(f"target {k}", none) for k in range(FOLDS)])
    target = targets.sum(0)
    if not target.sum():
        return QualityModel(np.zeros(BUCKETS), -np.inf)
    model = QualityModel(log_ratio(corpus, target), -np.inf)
    ratios = spark.sparkContext.broadcast(log_ratio(corpus, target - targets))

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            codes, sizes = features(batch.column(1))
            fold = np.repeat(batch.column(2).to_numpy(), sizes)
            score = sums(ratios.value[fold, codes], sizes) / (sizes + NEUTRAL)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score)], names=["quality", "score"]
            )

    known = spark.createDataFrame(sample[["id", "quality"]], "id long, quality int")
    seen = rows.join(F.broadcast(known), "id").select("quality", "text", "fold")
    scored = seen.mapInArrow(held_out, "quality int, score double").toPandas()
    model.threshold = threshold(
        scored["score"].to_numpy(float), scored["quality"].to_numpy(int) == 1
    )
    return model


def log_ratio(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio by bucket of each row of target counts and the corpus.

    The corpus is the prior of the target, so that unseen features say little.
    """
    rate = (corpus + SMOOTHING) / (corpus.sum() + SMOOTHING * BUCKETS)
    total = target.sum(-1, keepdims=True) + SMOOTHING * BUCKETS
    return np.log((target + SMOOTHING * BUCKETS * rate) / total / rate)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 for a text without any."""
    total = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        total[some] = np.add.reduceat(values, np.cumsum(sizes[some]) - sizes[some])
    return total


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The lowest score to accept: best balanced accuracy that still keeps ``KEEP_GOOD``.

    Of equally good thresholds the middle one is taken. Without good or without bad documents
    everything is accepted.
    """
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(score, kind="stable")
    score, good = score[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    caught = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    edges = np.concatenate([[-np.inf], (score[1:] + score[:-1]) / 2, [np.inf]])
    gain = np.where(lost <= 1 - KEEP_GOOD, caught - lost, -1)
    gain[1:-1][score[1:] == score[:-1]] = -1
    best = np.flatnonzero(gain == gain.max())
    return float(edges[best[len(best) // 2]])


def scorer(docs: DataFrame, model: QualityModel, text: str) -> Column:
    """A column ``n_features, score`` for ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)

    @F.arrow_udf("n_features long, score double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            scored = []
            for part in sliced(iter([pa.record_batch([whole], names=["text"])]), 0):
                codes, sizes = features(part.column(0))
                total = sums(shared.value[codes], sizes)
                columns = [sizes.astype(np.int64), total / (sizes + NEUTRAL)]
                scored.append(
                    pa.StructArray.from_arrays(
                        [pa.array(c) for c in columns], names=["n_features", "score"]
                    )
                )
            kind = pa.struct([("n_features", pa.int64()), ("score", pa.float64())])
            yield pa.concat_arrays(scored) if scored else pa.array([], kind)

    return score(F.col(text))


ADDED = ["n_features", "score", "kept", "log_weight"]


def classify(docs: DataFrame, model: QualityModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_features``, ``score``, ``kept`` and ``log_weight``.

    ``log_weight`` is the log ratio of target and corpus summed over the features of the whole text,
    ``score`` its mean with the neutral features;
    ``kept`` is false below the model's threshold. Null and empty texts have no features and
    score 0, which says neither good nor bad. Equal texts get equal results, and columns of those
    names in ``docs`` are replaced.
    """
    rows = clear_of(docs, ADDED).withColumn("_found", scorer(docs, model, text))
    found = rows.withColumns(
        {"n_features": F.col("_found.n_features"), "score": F.col("_found.score")}
    ).drop("_found")
    weight = F.col("score") * (F.col("n_features") + F.lit(NEUTRAL))
    return found.withColumns({"kept": F.col("score") >= model.threshold, "log_weight": weight})


#: Gumbel keys are compared as integers of this many parts of one.
KEY_PARTS = 1 << 20
#: Bins in which keys are counted at once while the k-th is searched.
BINS = 4096


def gumbel_key(log_weight: str, id_col: str, seed: int) -> Column:
    """Weight plus Gumbel noise that follows from id and seed, as an integer."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11)
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    key = F.col(log_weight) - F.log(-F.log(uniform))
    return F.floor(key * KEY_PARTS).cast("long")


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of an integer column, from counts in ever narrower bins."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or not n:
        return None
    left = min(k, n)
    while low < high:
        width = -(-(high - low + 1) // BINS)
        bin_of = F.floor((F.col(key) - low) / width)
        inside = df.where(F.col(key).between(low, high))
        counts = sorted(inside.groupBy(bin_of.alias("bin")).count().collect(), reverse=True)
        for row in counts:
            if left <= row["count"]:
                low, high = low + row.bin * width, min(high, low + (row.bin + 1) * width - 1)
                break
            left -= row["count"]
    return low


def resample(scored: DataFrame, k: int, *, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """``scored`` with ``gumbel_key`` and ``sampled``: a draw of ``k`` rows without replacement.

    It is drawn from all rows, accepted or not. The chance of a row follows its weight (Gumbel
    top-k). Rows that tie with the k-th key, as
    repeated rows do, are all drawn. ``scored`` should be a stored table: it is read several times.
    """
    keyed = clear_of(scored, ["gumbel_key", "sampled"]).withColumn(
        "gumbel_key", gumbel_key("log_weight", id_col, seed)
    )
    edge = kth_largest(keyed, "gumbel_key", k)
    drawn = F.lit(False) if edge is None else F.coalesce(F.col("gumbel_key") >= edge, F.lit(False))
    return keyed.withColumn("sampled", drawn)
