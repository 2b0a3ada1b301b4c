import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatelens.llm import nbest, packing, token_counts, token_files
from gatelens.llm.token_ids import WordIds

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SIGNS = ["a", "b", "the", "The", " ", "  ", "\n", "é", "É", "é", "'s", "'", "<s>", "</s>", "▁"]
SIGNS += ["<|endoftext|>", "\t", "日本", "🙂", "\x00", "\r", "!!", "ﬁ", "7", "12", "ß", "İ", "Σ", "_"]
TEXT = st.lists(st.sampled_from(SIGNS), max_size=9).map("".join)

ROWS = [
    (4, "Some words, and some more words.\nA line.", "x"),
    (1, None, "x"),
    (2, "", "x"),
    (3, " two  spaces  <|endoftext|> <s> ▁ ", "x"),
    (9, "long " * 30_000 + "end", "x"),
    (4, "Some words, and some more words.\nA line.", "x"),
    (7, "日本 é 🙂", None),
]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def words():
    return WordIds(WORDS)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_piece_counts_are_the_library_s(text):
    counts = token_counts.counts_of(PIECES)
    assert counts.splits
    assert counts.of_text(text) == len(counts.library.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_word_ids_are_the_library_s(texts):
    words = WordIds(WORDS)
    assert words.cuts
    found = words.of_texts(pa.array(texts, pa.string())).to_pylist()
    want = [words.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "\n", "é", "▁", "in", "日", "ed"]), max_size=5))
def test_nbest_is_the_best_of_all_segmentations(signs):
    text = "".join(signs)
    lattice = nbest.lattices_of(PIECES, 4)
    whole = "▁" + text.replace(" ", "▁") if text else ""
    every = []

    def go(at, score, ids):
        if at == len(whole):
            every.append((score, ids))
            return
        for end in range(at + 1, min(len(whole), at + 16) + 1):
            if whole[at:end] in lattice.pieces:
                value, piece = lattice.pieces[whole[at:end]]
                go(end, score + value, ids + piece)
        if whole[at] not in lattice.pieces:
            value, piece = lattice.of_sign(whole[at])
            go(at + 1, score + value, ids + piece)

    go(0, 0.0, b"")
    found = lattice.of_texts(pa.array([text]))[0]
    assert [s for s, _ in found] == sorted((s for s, _ in every), reverse=True)[:4]
    assert set(found) <= set(every) and len(set(found)) == len(found)
    assert lattice.decoded(found[0][1]) == text.replace("▁", " ")


def test_nbest_work_grows_with_distinct_parts_of_words():
    lattice = nbest.Lattices(PIECES, 4)
    some = ["the", "and", "in", "of", "on", "new", "old", "one", "two", "word"]
    some += [a + b for a in some for b in some]
    words = [a + "日" + b for a in some for b in some]
    texts = pa.array([" ".join(words), None, "", "a\nb", "  ▁", " ".join(words[:50])])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        found = lattice.of_texts(texts)
        back = lattice.all_decoded([cuts[0][1] for cuts in found])
    finally:
        sys.setprofile(None)
    assert calls < len(words) / 4
    assert back == [(t or "").replace("▁", " ") for t in texts.to_pylist()]
    alone = [lattice.of_texts(texts.slice(i, 1))[0] for i in range(len(texts))]
    assert found == alone


def test_nbest_keeps_its_results_when_the_cache_turns_over(monkeypatch):
    monkeypatch.setattr(nbest, "GENERATION", 3)
    monkeypatch.setattr(nbest, "LISTS", 2)
    texts = pa.array([f"some words {i} and x日y{i} of text" for i in range(40)])
    small = nbest.Lattices(PIECES, 4)
    found = [cuts for i in range(0, 40, 8) for cuts in small.of_texts(texts.slice(i, 8))]
    monkeypatch.undo()
    assert found == nbest.Lattices(PIECES, 4).of_texts(texts)


def test_token_counts(spark, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = token_counts.count_tokens(docs, PIECES, limit=100).collect()
    assert len(got) == len(ROWS)
    for row in got:
        text = row.text or ""
        n = len(library.encode(text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 100)
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_packing(spark, words):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3, "doc_id")
    got = packing.pack(docs, WORDS, length=64).toPandas()
    want = {}
    for i, text, _ in ROWS:
        ids = words.library.encode(text or "", add_special_tokens=False).ids
        want[i] = np.array([*ids, 1], "<u4")
    assert sorted(set(got.doc_id)) == sorted(want)
    for row in got.itertuples():
        part = want[row.doc_id][row.start : row.start + row.length]
        assert bytes(row.ids) == part.tobytes() and row.doc_tokens == len(want[row.doc_id])
    # every id lies in one piece, and sequences are full and gapless
    assert got.length.sum() == sum(len(want[i]) for i, _, _ in ROWS)
    got = got.sort_values(["sequence_id", "offset"])
    for sequence, some in got.groupby("sequence_id"):
        assert (some.offset.to_numpy() == np.cumsum(some.length) - some.length).all()
        assert some.length.sum() == 64 or sequence == got.sequence_id.max()
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_token_files(spark, words, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, WORDS)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    rows = sorted(ROWS, key=lambda r: r[0])
    start = 0
    for row, (i, text, _) in zip(got, rows, strict=True):
        ids = [*words.library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens) == (i, start, len(ids))
        assert zlib.crc32(bytes(row.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = token_files.read_token_files(spark, path, [7, 100]).collect()
    assert [r.doc_id for r in one] == [7]
    empty = str(tmp_path / "empty")
    token_files.write_token_files(docs.limit(0), empty, WORDS)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_ranges_of_uneven_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_DOCS", 50)
    ids = [*range(1000), *range(10**12, 10**12 + 900), 1 << 62, -(1 << 62)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)
    bounds = token_files.id_bounds(docs, len(ids), "doc_id", 50)
    sizes = np.bincount(np.searchsorted(bounds, ids, side="right"))
    assert len(sizes) > 20 and sizes.max() < 150
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, WORDS)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(ids)
    assert [r.start for r in got] == (np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]).tolist()
    assert spark.read.format("binaryFile").load(f"{path}/files").where("length > 0").count() == len(sizes)


def test_documents_without_an_id_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (None, "more")], "doc_id long, text string")
    with pytest.raises(ValueError, match="1 documents have no doc_id"):
        token_files.write_token_files(docs, str(tmp_path / "files"), WORDS)
    assert not (tmp_path / "files").exists()


def test_cut_token_files_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, WORDS)
    content = bytes(
        spark.read.format("binaryFile").load(f"{path}/files").where("length > 0").first().content
    )
    assert token_files.index_of(content)[4].tolist() == [1]
    with pytest.raises(ValueError):
        token_files.index_of(content[:-1])


def segmentations(text, most):
    """How many ways pieces and single signs make up a text, ``most`` at most."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = set()
    for i in range(library.get_piece_size()):
        if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
            pieces.add(library.id_to_piece(i))
    longest = max(map(len, pieces))
    signs = "▁" + text.replace(" ", "▁") if text else ""
    ways = [1] + [0] * len(signs)
    for end in range(1, len(signs) + 1):
        for start in range(max(0, end - longest), end):
            if end - start == 1 or signs[start:end] in pieces:
                ways[end] = min(most, ways[end] + ways[start])
    return ways[-1]


def test_nbest_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = nbest.encode_nbest(docs, PIECES).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in ROWS)
    texts = {i: t or "" for i, t, _ in ROWS}
    for row in got:
        assert row.decoded == texts[row.doc_id].replace("▁", " ")
        scores = [x.score for x in row.nbest]
        assert scores == sorted(scores, reverse=True) and len(scores) == segmentations(texts[row.doc_id], 4)
    first = nbest.encode_nbest(docs, PIECES).select(F.col("nbest")[0]["ids"].alias("ids"))
    back = first.select(nbest.decoder(PIECES, "ids").alias("text")).collect()
    assert sorted(r.text for r in back) == sorted(r.decoded for r in got)
    assert nbest.encode_nbest(docs.limit(0), PIECES).count() == 0
