import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gatelens.llm import simhash
from gatelens.llm.components import components

WORDS = "ton ri ma sel ku va ne dor il pas Tor MA x 日本 é".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(n))


def plain(text):
    """A fingerprint, bit by bit."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    some = [words] if 0 < len(words) < 4 else [words[i : i + 4] for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps, limit=4):
    """The least position that each can reach, by all pairs."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


TEXTS = [None, "", " \t\n", "One", "one two", "ONE two  three", "a b c d", "a\tb\nc\x0b\x0cd\re", "a\x1cb\xa0c d e"]
TEXTS += ["日本 語 " * 5, "same " * 600, prose(1, 3), prose(2, 400), " " + prose(3, 50) + " "]


def test_fingerprints_of_texts(monkeypatch):
    want = [plain(t) for t in TEXTS]
    assert simhash.fingerprints_of(pa.array(TEXTS)).tolist() == want
    assert simhash.fingerprints_of(pa.array(TEXTS, pa.string())[3:9]).tolist() == want[3:9]
    assert simhash.fingerprints_of(pa.array([], pa.string())).tolist() == []
    monkeypatch.setattr(simhash, "PIECE", 16)  # every text in pieces
    monkeypatch.setattr(simhash, "HASHED", 7)
    assert simhash.fingerprints_of(pa.array(TEXTS)).tolist() == want


def test_spark_has_the_same_hash(spark):
    row = spark.createDataFrame([("ton ri ma sel",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] % (1 << 64) == xxhash.xxh64_intdigest(b"ton ri ma sel", 42)


def test_documents_against_brute_force(spark):
    draw = random.Random(5)
    texts = [*TEXTS]
    for seed in range(6):
        words = prose(seed, 300).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(300)] = "edit"
            texts.append(" ".join(copy))
    rows = [(3 * i + 7, "x", t, 0) for i, t in enumerate(texts)]
    rows += [(rows[20][0], "y", texts[20], 0), (None, None, texts[21], None), (None, "z", "nothing like the others here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string, text string, component_id int").select(
        "doc_id", "fingerprint", "text", "component_id"
    )
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps = [plain(t) for _, t in rows]
    root = grouped(fps)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f"{fp:016x}", least.get(r)) for (i, _), fp, r in zip(rows, fps, root, strict=True)), key=str)
    got = sorted(map(tuple, simhash.near_duplicates(df.repartition(4)).collect()), key=str)
    assert got == want
    assert len(set(root)) < len(set(fps))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def made(seed, n):
    """Fingerprints with a dense crowd, chains and bits that go together."""
    draw = random.Random(seed)
    base = draw.getrandbits(64)
    out = {base}
    while len(out) < n // 2:
        out.add(base ^ sum(1 << b for b in draw.sample(range(40), draw.randint(1, 6))))
    at = draw.getrandbits(64)
    for _ in range(20):
        at ^= sum(1 << b for b in draw.sample(range(64), 4))
        out.add(at)
    while len(out) < n:
        low = draw.getrandbits(30)
        out.add(low | (low << 30))
    return sorted(out)


@pytest.mark.parametrize(("n", "crowded"), [(400, None), (400, 20), (3, None)])
def test_links_against_all_pairs(spark, n, crowded):
    fps = made(n, n) if n > 3 else [0, 15, (1 << 64) - 1]
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = components(simhash.links(df, crowded=crowded)).collect()
    root = {r.node: r.root for r in found}
    mine = [root.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    want = grouped(fps)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_thresholds_are_the_cheapest_and_complete():
    draw = np.random.default_rng(2)
    fps = draw.integers(0, 1 << 63, 50, dtype=np.uint64)
    parts = simhash.grouped_bits(np.abs(np.corrcoef(draw.normal(size=(64, 90)))), 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    counts = {
        f"{i}.{j}": np.bincount(simhash._values(fps, s), minlength=1 << len(s))
        for i, p in enumerate(parts)
        for j, s in enumerate(simhash.sub_parts(p))
    }
    plan = simhash.Plan(parts, counts, 50, 4)
    chosen = plan.thresholds(fps)
    assert ((chosen + 1).sum(axis=1) == 5).all()
    costs = [plan.costs(fps, i) for i in range(3)]
    ways = [(a, b, 5 - a - b) for a in range(6) for b in range(6 - a)]
    cheapest = np.min([sum(c[:, t] for c, t in zip(costs, w, strict=True)) for w in ways], axis=0)
    mine = sum(c[np.arange(50), chosen[:, i] + 1] for i, c in enumerate(costs))
    assert mine == pytest.approx(cheapest)


def test_counts_at_a_distance():
    counts = np.random.default_rng(1).integers(0, 9, 64).astype(float)
    near = simhash._at_distance(counts, 4)
    for t in range(5):
        want = [sum(counts[u] for u in range(64) if (u ^ v).bit_count() == t) for v in range(64)]
        assert near[t].tolist() == want


def test_bits_that_go_together_share_a_part():
    correlation = np.zeros((64, 64))
    for a in range(0, 64, 2):
        correlation[a, a + 1] = correlation[a + 1, a] = 0.9
    for part in simhash.grouped_bits(correlation, 4):
        assert {b ^ 1 for b in part} == set(part)


def test_parts_follow_from_the_count():
    found = [simhash.parts_for(10**k) for k in range(1, 12)]
    assert found == sorted(found, reverse=True) and found[0] == 5 and found[-1] == 2
