import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gatelens.llm import fingerprints, language, neardup, quality, warc
from gatelens.llm.components import components
from gatelens.llm.fingerprints import K, S, SLOTS

SYLLABLES = ["ton", "ri", "ma", "sel", "ku", "va", "ne", "dor", "il", "pas"]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(n))


# ---- fingerprints


def _hash(data):
    value = xxhash.xxh64_intdigest(data, 42)
    return value - (1 << 64) if value >> 63 else value


def _slots(text):
    data = text.encode()
    found = {_hash(data)} if 0 < len(data) < K else set()
    inner = [_hash(data[i : i + S]) for i in range(len(data) - S + 1)]
    for i in range(len(data) - K + 1):
        some = inner[i : i + K - S + 1]
        if min(some) in (some[0], some[-1]):
            found.add(_hash(data[i : i + K]))
    least = {}
    for value in found:
        least[value % SLOTS] = min(least.get(value % SLOTS, value), value)
    return sorted((s << 32) | (((v % (1 << 64)) >> 6) & 0xFFFFFFFF) for s, v in least.items())


def _alike(one, other):
    filled = {e >> 32 for e in one} | {e >> 32 for e in other}
    return len(set(one) & set(other)) / len(filled) if filled else 1.0


def test_fingerprints_against_brute_force(spark):
    texts = [prose(i, 60) for i in range(5)] + [None, "", "kurz", "aaaa" * 30, "日本語" * 40]
    texts += [prose(2, 60), prose(7, 30_000)]
    rows = [(10 * i, t, "x") for i, t in enumerate(texts)] + [(30, prose(3, 60), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = fingerprints.compare_with_edits(docs.repartition(3)).collect()
    rows = sorted(((i, t or "") for i, t, _ in rows))
    got = sorted(got, key=lambda r: (r.doc_id, r.edited_sha256))
    want = []
    for at, (i, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, after = _slots(text), _slots(edited), _slots(following)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        words = ["".join(f"{e:010x}" for e in x) for x in (own, changed)]
        want.append((i, len(text), sha, *words, _alike(own, changed), _alike(own, after)))
    want.sort(key=lambda r: (r[0], r[2]))
    for row, expected in zip(got, want, strict=True):
        assert tuple(row)[:5] == expected[:5]
        assert tuple(row)[5:] == pytest.approx(expected[5:])
    assert fingerprints.compare_with_edits(docs.limit(0)).count() == 0
    one = fingerprints.compare_with_edits(docs.where("doc_id = 0")).first()
    assert one.near_next == 1.0


def test_aligned_passages(spark):
    shared = prose(1, 40)
    rows = [(1, prose(5, 10) + " " + shared), (2, prose(6, 25) + " " + shared)]
    found = fingerprints.anchors(spark.createDataFrame(rows, "id long, text string"), ["id"], "text")
    pairs = spark.createDataFrame([(1, 2), (1, 2)], "one long, other long")
    best = fingerprints.aligned(pairs, found).orderBy(F.desc("anchors")).first()
    assert best["shift"] == len(rows[1][1]) - len(rows[0][1])
    assert best.anchors > 20 and best.end == len(rows[0][1])


def test_fingerprints_stay_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = fingerprints.compare_with_edits(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


# ---- near duplicates


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _roots(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            same = len(sets[i] & sets[j])
            if j < i and same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def _copies():
    draw = random.Random(5)
    rows = [(500 + i, prose(100 + i, 80)) for i in range(5)]
    base = prose(1, 120).split()
    for i in range(60):  # near copies with few to many edits
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 6, 12])):
            words[draw.randrange(len(words))] = prose(draw.random(), 1)
        rows.append((i * 3, " ".join(words)))
    rows += [(700, prose(100, 80).upper()), (701, "a b"), (702, " A\tb "), (703, "a b c")]
    rows += [(704, None), (705, ""), (706, " \n"), (707, "\x85"), (708, "a\xa0b c d e f")]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, percent, monkeypatch):
    rows = _copies()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    if percent == 85:  # families in blocks, as large ones are
        monkeypatch.setattr(neardup, "FAMILY_DOCS", 10)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, percent=percent).collect()}
    sets = {i: _set(t) for i, t in rows}
    want = _roots(sets, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_pipeline_keeps_one_row_of_each_real_group(spark):
    import corpus_pipeline

    a, b, c, d = (prose(i, 60) for i in (1, 2, 3, 4))
    rows = [(1, a), (5, b), (5, a.upper()), (5, c), (7, None), (7, None), (8, "")]
    rows += [(None, d), (None, d.upper()), (None, c), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs.repartition(3), "").collect()
    plain = sorted((str(r.doc_id), (r.text or "").lower()) for r in got)
    want = [(1, a), (5, b), (5, c), (7, ""), (8, ""), (None, d), (None, "")]
    assert plain == sorted((str(i), t) for i, t in want)
    single = docs.where("doc_id IN (1, 8)").unionByName(
        spark.createDataFrame([(9, a.upper())], docs.schema)
    )
    left = corpus_pipeline.near_dedup(spark, single, "").collect()
    assert sorted(r.doc_id for r in left) == [1, 8]


def test_shingles_of_slices():
    texts = pa.array([t for _, t in _copies()] * 2)
    whole, count = neardup.shingles(texts)
    at = int(count[:50].sum())
    part, some = neardup.shingles(texts.slice(50))
    assert (some == count[50:]).all() and (part == whole[at:]).all()


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "A B")], "doc_id long, text string")
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_links_inside_a_family():
    draw = random.Random(3)
    for _ in range(150):
        sets = []
        for _ in range(draw.randint(2, 14)):
            some = set(range(40))
            for _ in range(draw.randint(0, 6)):
                some.discard(draw.randrange(40))
                some.add(draw.randrange(40, 60))
            sets.append(some)
        want = _roots(dict(enumerate(sets)), 85)
        got = neardup.linked([np.array(sorted(s), np.uint64) for s in sets], 85)
        assert got.tolist() == [want[i] for i in range(len(sets))]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (200, 200)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- language and quality


def test_language(spark):
    kinds = {"aa": ["ton", "ri", "ma"], "bb": ["xul", "qo", "zep"], "cc": ["été", "ça", "où"]}
    draw = random.Random(2)
    rows = []
    for i in range(90):
        lang = draw.choice(sorted(kinds))
        text = " ".join("".join(draw.choices(kinds[lang], k=2)) for _ in range(12))
        rows.append((i, text, lang, 0.5))
    odd = [(900, None), (901, ""), (902, "12 !!"), (903, "tonri " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.train(docs.where(~language.held_out("doc_id")), "text", "lang")
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang, _ in rows)
    other = spark.createDataFrame(odd, "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(other, model).collect()}
    assert found[900] == found[901] == found[902] == ("und", 0.0)
    assert found[903][0] == "aa"
    nothing = language.train(docs.limit(0), "text", "lang")
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_grams_of_long_texts_are_those_of_whole_texts(monkeypatch):
    text = prose(3, 500)
    want = Counter()
    for codes, _, _ in language.grams([text]):
        want.update(codes.tolist())
    monkeypatch.setattr(language, "WINDOW", 100)
    got = Counter()
    for codes, _, n in language.grams([text]):
        got.update(codes.tolist())
        assert n.sum() == len(codes)
    assert got == want and sum(want.values()) == 3 * len(text) - 3


def test_quality(spark):
    good = [(i, prose(i, 60)) for i in range(120)]
    junk = [(200 + i, prose(i, 40).upper().replace(" ", "!! ")) for i in range(60)]
    odd = [(300, None), (301, ""), (302, "  ")]
    docs = spark.createDataFrame(
        [(*r, True) for r in good + junk + odd], "doc_id long, text string, kept boolean"
    )
    labels = [(i, 1, 0) for i, _ in good[:60]] + [(i, 0, 0) for i, _ in junk[:30]] + [(5, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, known)
    scored = quality.classify(docs, model).cache()
    got = {r.doc_id: r for r in scored.collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in junk)
    assert all(got[i].n_features == 0 and got[i].score == 0.0 for i, _ in odd)
    drawn = {r.doc_id for r in quality.resample(scored, 100).where("sampled").collect()}
    assert len(drawn) == 100 and sum(i < 200 for i in drawn) > 80
    assert quality.resample(scored, 0).where("sampled").count() == 0
    none = quality.train(docs, known.limit(0))
    assert quality.classify(docs, none).where("kept").count() == docs.count()
    assert quality.classify(docs.limit(0), model).count() == 0


def test_threshold_keeps_good_documents_without_a_label(spark):
    # words of their own in every good document; the bad ones repeat a few common ones
    common = [prose(10_000 + i, 1) for i in range(40)]
    draw = random.Random(8)

    def text(i, own):
        words = [prose(1000 * i + j + 50_000, 1) + str(i) for j in range(own)]
        return " ".join(words + draw.choices(common, k=30 - own))

    good = [(i, text(i, 20)) for i in range(400)]
    bad = [(1000 + i, text(1000 + i, draw.randrange(12, 20))) for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = [(i, 1, 0) for i, _ in good[:200]] + [(i, 0, 0) for i, _ in bad[:100]]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.train(docs, known)).where("kept").collect()
    assert sum(200 <= r.doc_id < 400 for r in got) >= 190


def test_weights_are_summed_over_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "ton ri"), (2, prose(4, 900))], "doc_id long, text string")
    draw = np.random.default_rng(3)
    model = quality.QualityModel(draw.normal(size=quality.BUCKETS), -np.inf)
    got = {r.doc_id: r.log_weight for r in quality.classify(docs, model).collect()}
    for i, text in docs.collect():
        codes, _ = quality.features(pa.array([text]))
        assert got[i] == pytest.approx(model.ratio[codes].sum())


def test_kth_largest(spark):
    values = [random.Random(9).randrange(-(10**12), 10**12) for _ in range(300)] + [7] * 20
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 77, 320, 999):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, 320) - 1]


# ---- archives


@pytest.mark.parametrize("least", [0, 10])
def test_archives(spark, tmp_path, least, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1500)
    rows = [(i, f"http://x/{i}", prose(i % 40, 50)) for i in range(60)]
    rows += [(70, None, None), (71, "http://x/ a\r\nX: y", ""), (72, "u", "kurz"), (73, "u", "kurz")]
    rows += [(74, "u", "l" * 200_000), (75, "u", "é\r\n\r\nb"), (None, "u", "kurz")]
    pages = spark.createDataFrame(
        [(*r, "z") for r in rows], "page_id long, url string, html string, payload string"
    )
    path = str(tmp_path / "warc")
    warc.write_bundles(pages.repartition(2), path, least_bytes=least)
    got = warc.read_bundles(spark, path, payloads=True).collect()
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        last = max(x for x in groups[data] if x is not None)
        first = len(data) < least or i == last
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind = "response" if first else "revisit"
        want.append((i, len(data), digest, kind, None if first else last, data if first else None))
    key = lambda r: (r[0] is None, r[0])
    found = [(*tuple(r)[:5], None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    some = warc.read_bundles(spark, path, [3, 74, 999]).collect()
    assert sorted(r.page_id for r in some) == [3, 74]
    empty = str(tmp_path / "empty")
    warc.write_bundles(pages.limit(0), empty)
    assert warc.read_bundles(spark, empty).count() == 0
