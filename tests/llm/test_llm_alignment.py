import public_tokenizers
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from collections import Counter
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gatelens.llm import alignment
from gatelens.llm.alignment import Aligner, PairHash, built, shard_of

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "the", "The", " ", "  ", "\n", "\n\n", "é", "é", "'s", "'", "<s>", "</s>", "▁", "<unk>", "<0x0A>"]
SIGNS += ["<|endoftext|>", "\t", "日本", "🙂", "\x00", "\r", "!!", "ﬁ", "7", "12", "\xa0", "　", "\x1f", "_", "ing", "Ġ"]
TEXT = st.lists(st.sampled_from(SIGNS), max_size=9).map("".join)

ROWS = [
    (4, "Some words, and some more words.\nA line.", "x", 1),
    (1, None, "x", 1),
    (2, "", "x", None),
    (3, " two  spaces  <|endoftext|> <s> and\n\n lines \n", "x", 1),
    (5, "a ▁ sign", "x", 1),
    (9, "long " * 30_000 + "end", "x", 1),
    (4, "Some words, and some more words.\nA line.", "x", 1),
    (None, "日本 é 🙂 unusual\ttabs", None, 1),
    (8, "x" * 3000 + " " + "y" * 300, "x", 1),
]
SCHEMA = "doc_id long, text string, groups string, n_best int"

tokenizer = Tokenizer.from_file(A)
tokenizer.encode_special_tokens = True
model = sentencepiece.SentencePieceProcessor(model_file=B)


def plain(text):
    """Groups and links of a text, byte by byte."""
    if not text:
        return 0, 0, [], []
    signs = alignment.byte_signs()
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    mine = [bytes(signs[c] for c in tokenizer.id_to_token(i)) for i in a]
    other = []
    for i in b:
        p = model.id_to_piece(i)
        other.append(bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode())
    data = (" " + text).encode()
    if b"".join(mine) != data or b"".join(other) != data:
        return 0, 0, [], []
    groups, links = [], []
    at_a = at_b = i = j = from_i = from_j = 0
    while i < len(a):
        if at_a <= at_b:
            at_a += len(mine[i])
            i += 1
        else:
            at_b += len(other[j])
            j += 1
        while at_b < at_a:
            at_b += len(other[j])
            j += 1
        if at_a == at_b:
            groups.append((a[from_i:i], b[from_j:j]))
            links.append((a[i - 1], b[j - 1]))
            from_i, from_j = i, j
    return len(a), len(b), groups, links


def brute(texts):
    found = [plain(t) for t in texts]
    counts = Counter(link for f in found for link in f[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for n_a, n_b, groups, links in found:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((n_a, n_b, len(groups), len(links), written, best, sum(counts[x] for x in links)))
    return out, counts, highest


@pytest.fixture(scope="module")
def aligner():
    return Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_words_give_what_the_libraries_give(texts):
    aligner = alignment.aligner_of(A, B)
    assert aligner.splits
    got = [None] * len(texts)
    for part in aligner.slices(pa.array(texts, pa.string())):
        groups = part.groups().to_pylist()
        n_a = part.per_text(part.words.n_a).tolist()
        for at, i in enumerate(part.rows.tolist()):
            assert got[i] is None
            got[i] = (n_a[at], groups[at])
    want = [(w[0], w[4]) for w in brute(texts)[0]]
    assert got == want


def test_merging_by_rank_is_what_the_tokenizer_does():
    aligner = alignment.aligner_of(A, B)
    assert aligner.ranks
    words = [p.decode("utf-8", "ignore") for p in aligner.a_bytes[300::7]]
    text = "".join(" " + w + x for w, x in zip(words, words[::-1], strict=True))
    assert aligner.ranks.encode_ordinary(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 3)
    monkeypatch.setattr(alignment, "CHUNK", 2)
    aligner = Aligner(A, B)
    for text in ("one two three four five", "two six", "seven\neight nine ten", "one two"):
        part = next(aligner.slices(pa.array([text])))
        assert part.groups().to_pylist() == [brute([text])[0][0][4]]


def test_byte_signs_are_those_of_the_vocabulary():
    signs = alignment.byte_signs()
    assert sorted(signs.values()) == list(range(256))
    assert {c for t in tokenizer.get_vocab() for c in t if t != "<|endoftext|>"} <= set(signs)


@pytest.mark.parametrize("hashed", [10**6, 3])
def test_documents_against_brute_force(spark, monkeypatch, hashed):
    monkeypatch.setattr(alignment, "HASHED_PAIRS", hashed)
    monkeypatch.setattr(alignment, "SHARD", 16)
    want, counts, highest = brute([t for _, t, _, _ in ROWS])
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = alignment.align(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    rows = [(i, *w) for (i, _, _, _), w in zip(ROWS, want, strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert any(w[5] < w[3] for w in want)
    pairs = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(df, A, B).collect()}
    assert pairs == {k: (n, n == highest[k[1]]) for k, n in counts.items()}
    assert alignment.align(df.limit(0), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(df.where("doc_id < 3"), A, B).collect()] == [(0, 0, 0, 0, "", 0, 0)] * 2


def test_a_partition_gives_its_counts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 4)
    monkeypatch.setattr("gatelens.llm.token_ids.SLICE", 20)
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    _, counts, _ = brute([t for _, t, _, _ in ROWS])
    found = alignment.partial_counts(df, A, B, "text").groupBy("key").sum("n").collect()
    assert {(r[0] >> 32, r[0] & 0xFFFFFFFF): r[1] for r in found} == counts


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_hash_is_minimal_and_verified(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 1 << 47, n))
    shards = max(1, len(keys) // 50)
    of = shard_of(keys, shards)
    parts = []
    for i in range(shards):
        sizes, bits, ordered = built(keys[of == i])
        parts.append((sizes, bits.tobytes(), ordered.astype("<i8").tobytes()))
    found = PairHash(parts)
    slots = found.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (found.keys[slots] == keys).all()
    others = np.setdiff1d(draw.integers(0, 1 << 47, 1000), keys)
    assert (found.slots(others) == -1).all()
