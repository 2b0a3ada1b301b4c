import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gatelens.llm import language, quality

SYLLABLES = {
    "en": "the and ing er on th wh st ly ck".split(),
    "es": "ción que los ar as ño el la rr ez".split(),
    "de": "sch ung ein ich ß der keit zu pf ö".split(),
}


def words(draw, lang, n):
    return ["".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    rows = []
    for i in range(120):
        lang = draw.choice(list(SYLLABLES))
        text = words(draw, lang, draw.randint(60, 120))
        bad = i % 4 == 0
        if bad:
            text = [draw.choice(["click", "buy", "!!!", "free", "$$$"]) if draw.random() < 0.7 else w for w in text]
        rows.append([i, " ".join(text), lang if i % 5 else None, bad])
    good = [r for r in rows if not r[3]]
    for k, source in enumerate(good[:12]):
        copy = source[1].split()
        if k % 2:
            copy[3] = "edited"
        rows.append([1000 + k, " ".join(copy), source[2], False])
    rows += [[2000, None, None, False], [2001, "", "en", False], [2001, "", "en", False], [2002, "123 456", None, False]]
    rows += [[good[0][0], good[0][1], good[0][2], False], [None, good[1][1], None, False], [good[2][0], " ".join(words(draw, "de", 80)), "de", False]]
    return rows


COLUMNS = "doc_id long, text string, lang string, score string, Kept int, _row string, _quality int, _language int"


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, lang, f"s{i}", 7, f"r{i}", 8, 9) for i, t, lang, _ in corpus]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], int(not r[3]), 0) for r in corpus if r[0] is not None and r[0] < 1000 and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def near(one, other):
    def shingled(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    a, b = shingled(one), shingled(other)
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def test_pipeline_end_to_end(spark, corpus, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    codes, sizes = quality.features(pa.array([r[1] for r in corpus], pa.string()))
    score = quality.sums(model.ratio[codes], sizes) / (sizes + quality.NEUTRAL)
    kept = [r for r, s in zip(corpus, score, strict=True) if s >= model.threshold]
    first = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert first.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in first.collect()) == sorted((r[0] or -1, r[1] or "") for r in kept)
    assert all(r.score == f"s{r.doc_id}" and (r.Kept, r._quality, r._language) == (7, 8, 9) for r in first.collect())
    assert sum(r[3] for r in kept) < 5 and sum(not r[3] for r in kept) >= sum(not r[3] for r in corpus) - 2
    tongue = language.train(first, "text", "lang")
    chance = language.scores(tongue, [r[1] for r in kept])
    sure = np.exp(chance - chance.max(1, keepdims=True))
    sure = (sure / sure.sum(1, keepdims=True)).max(1) > corpus_pipeline.SURE
    kept = [r for r, s in zip(kept, sure, strict=True) if s and any(c.isalpha() for c in r[1] or "")]
    second = corpus_pipeline.language_id(spark, first, folder)
    assert second.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in second.collect()) == sorted((r[0] or -1, r[1]) for r in kept)
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if near(kept[i][1], kept[j][1]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for r, g in zip(kept, group, strict=True):
        key = (r[0] is None, r[0] or 0)
        least[g] = min(least.get(g, (key, "")), (key, r[1]))
    third = corpus_pipeline.near_dedup(spark, second, folder)
    assert third.columns == docs.columns
    got = sorted((r.doc_id or -1, r.text) for r in third.collect())
    assert [i for i, _ in got] == sorted(i if not none else -1 for (none, i), _ in least.values())
    assert len(got) < len(kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter()
    for i, text in got:
        tokens[i] += len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    pieces = corpus_pipeline.run(spark, folder).collect()
    packed = Counter()
    for r in pieces:
        packed[r.doc_id if r.doc_id is not None else -1] += r.length
    assert packed == tokens
    by_sequence = Counter()
    for r in pieces:
        by_sequence[r.sequence_id] += r.length
    assert all(n == 2048 for s, n in by_sequence.items() if s < max(by_sequence))


def test_language_against_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(words(draw, lang, draw.randint(1, 12))), lang) for i, lang in enumerate(list(SYLLABLES) * 9)]
    rows += [(90, None, "en"), (91, "", "de"), (92, "?!", None), (93, "the und", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, "text", "lang")
    grams = {i: [c for codes, _, _ in language.grams([t]) for c in codes.tolist()] if t else [] for i, t, _ in rows}
    # what the buckets are made of: all runs of one to three code points
    assert len(grams[93]) == sum(len("the und") - k for k in range(3))
    seen, texts = {}, Counter()
    for i, t, lang in rows:
        if t is not None and lang is not None:
            seen.setdefault(lang, Counter()).update(grams[i])
            texts[lang] += 1
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    for i, t, _ in rows:
        logs = {}
        for lang, counts in seen.items():
            total = sum(counts.values()) + language.SMOOTHING * language.BUCKETS
            logs[lang] = math.log(texts[lang] / sum(texts.values()))
            logs[lang] += sum(math.log((counts[g] + language.SMOOTHING) / total) for g in grams[i])
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        best = max(sorted(logs), key=logs.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-3)


def test_quality_against_brute_force(spark, corpus):
    labels = {r[0]: int(not r[3]) for r in corpus[:120] if r[0] % 2 == 0}
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in corpus], "doc_id long, text string, score string")
    known = spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int")
    model = quality.train(docs, known)
    own = []
    for r in corpus:
        codes, _ = quality.features(pa.array([r[1]], pa.string()))
        own.append(codes.tolist())
    crowd, target = Counter(), Counter()
    for r, codes in zip(corpus, own, strict=True):
        crowd.update(codes)
        if labels.get(r[0]) == 1:
            target.update(codes)
    spread = quality.SMOOTHING * quality.BUCKETS

    def ratio(code):
        rate = (crowd[code] + quality.SMOOTHING) / (sum(crowd.values()) + spread)
        return math.log((target[code] + spread * rate) / (sum(target.values()) + spread) / rate)

    scored = quality.classify(docs, model)
    got = sorted(scored.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    rows = sorted(zip(corpus, own, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] or ""))
    keys = []
    for row, (_, codes) in zip(got, rows, strict=True):
        weight = sum(map(ratio, codes))
        assert row.n_features == len(codes)
        assert row.log_weight == pytest.approx(weight, abs=1e-6)
        assert row.score == pytest.approx(weight / (len(codes) + quality.NEUTRAL), abs=1e-9)
        assert row.kept == (row.score >= model.threshold)
    drawn = quality.resample(scored, 20).collect()
    keys = sorted((r.gumbel_key for r in drawn), reverse=True)
    assert {r.sampled for r in drawn if r.gumbel_key >= keys[19]} == {True}
    assert {r.sampled for r in drawn if r.gumbel_key < keys[19]} == {False}
    # the noise follows from the id alone and is Gumbel: mean 0.577, variance 1.645
    plain = spark.range(20_000).withColumn("w", F.lit(0.0)).select(quality.gumbel_key("w", "id", 17).alias("k"))
    mean, spread = plain.select(F.avg(F.col("k") / quality.KEY_PARTS), F.var_pop(F.col("k") / quality.KEY_PARTS)).first()
    assert mean == pytest.approx(0.5772, abs=0.03) and spread == pytest.approx(math.pi**2 / 6, abs=0.08)
