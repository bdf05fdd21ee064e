import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, pieces, token_files
from tessera.llm._tokens import memo

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
library = Tokenizer.from_file(BPE)
odd = list("abTé. ,!?\n\t\r'1中😀  \x85×÷<|>") + ["the", " the", "  ", "\n\n", "<|endoftext|>", "'s"]
texts = st.lists(st.lists(st.sampled_from(odd), max_size=40).map("".join), max_size=6)


def ids_of(text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts)
def test_chunked_encoding_is_the_library_s(batch):
    ids, bounds = memo(BPE).encode(pa.array(batch, pa.string()), 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [ids_of(t) + [2] for t in batch]


def digests(docs):
    return [(r["doc_id"], ids_of(r["text"]) + [2]) for r in docs.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["hostile", "corpus", "empty"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    got = packing.pack_documents(docs, BPE, capacity=64).toPandas()
    want = []
    for doc, ids in digests(docs):
        head = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(head, len(ids) + 1, 64)]
        want += [(repr(doc), k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    have = [(repr(None if d != d else int(d)), *map(int, r)) for d, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have) == sorted(want)
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == (bin_["length"].cumsum() - bin_["length"]).tolist() and bin_["length"].sum() <= 64


def test_plan_uses_every_piece_once_and_few_bins():
    rng = np.random.default_rng(0)
    lengths = np.minimum(1024, rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    bins = packing.plan(histogram, 1024)
    used = {}
    for n, chosen in bins:
        assert sum(k * c for k, c in chosen.items()) <= 1024
        for k, c in chosen.items():
            used[k] = used.get(k, 0) + n * c
    assert used == histogram
    assert sum(n for n, _ in bins) <= -(-int(lengths.sum()) // 1024) + 2


def test_fullest_is_the_best_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        available = [(int(n), int(c)) for n, c in zip(rng.choice(np.arange(1, 30), 4, replace=False), rng.integers(1, 4, 4), strict=True)]
        room = int(rng.integers(0, 60))
        sums = {0}
        for n, c in available:
            sums = {s + n * k for s in sums for k in range(c + 1)}
        chosen = packing.fullest(room, available)
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= room)
        assert all(c <= dict(available)[n] for n, c in chosen.items())


@pytest.mark.parametrize("which", ["hostile", "corpus", "empty"])
def test_token_files(spark, request, which):
    docs = request.getfixturevalue(which)
    path, _ = token_files.encode_corpus(docs, BPE, file_bytes=4096)
    got = sorted(map(tuple, token_files.read_digest(spark, path).collect()), key=lambda r: r[1])
    rows = digests(docs)
    assert sorted((repr(r[0]), r[2], r[3]) for r in got) == sorted((repr(d), len(i), crc(i)) for d, i in rows)
    order = [(r[0] is not None, r[0] or 0) for r in got]
    assert order == sorted(order)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].astype(int).tolist()


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    counts = (rng.pareto(1.0, 300) * 10).astype(int)
    free, tight = token_files.code_lengths(counts, 30), token_files.code_lengths(counts, 9)
    for lengths in (free, tight):
        assert sum(2.0 ** -int(n) for n in lengths if n) == 1
    import heapq

    heap = [(int(c), k) for k, c in enumerate(counts) if c]
    cost, heap = 0, [c for c, _ in heap]
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert (counts * free).sum() == cost and tight.max() <= 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700))
def test_bits_round_trip(values):
    ids = np.array(values, dtype=np.uint16)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=41) if len(ids) else np.zeros(41, int))
    payload, starts = token_files.encode_bits(ids, token_files.canonical(lengths), lengths)
    assert token_files.Decoder(lengths).decode(payload, starts, len(ids)).tolist() == values


def test_damaged_files_are_noticed():
    with pytest.raises(ValueError):
        list(token_files.read_file(b"something else entirely"))


@pytest.fixture(scope="module")
def sentencepiece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("abcdehinorst ETAé.,\n\t中😀▁01\x00") + ["the", "ing", " and", "  ", "    "]), max_size=40).map("".join), max_size=5))
def test_pieces_are_the_library_s(sentencepiece_model, batch):
    own = pieces.coder(MODEL)
    ids, bounds = own.encode(batch)
    for text, a, b in zip(batch, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == sentencepiece_model.encode(text)
        assert own.decode(ids[a:b]) == sentencepiece_model.decode(ids[a:b].tolist())
        if "▁" not in text:
            assert own.decode(ids[a:b]) == text


def test_unigram_mode_finds_the_best_sum():
    own = pieces.Coder(MODEL, pieces.UNIGRAM)
    for word in ["▁the", "▁hello", "▁international", "▁abcabc"]:
        ranks = own.segment([word])[0]
        assert (ranks >= 0).all()
        best = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - own.longest), j):
                if word[i:j] in own.rank:
                    best[j] = max(best[j], best[i] + own.score[own.rank[word[i:j]]])
        assert "".join(own.text[r] for r in ranks) == word
        assert own.score[ranks].sum() == pytest.approx(best[-1])


@pytest.mark.parametrize("which", ["hostile", "corpus", "empty"])
def test_piece_documents(request, which, sentencepiece_model):
    docs = request.getfixturevalue(which)
    want = sorted((repr(r["doc_id"]), repr(sentencepiece_model.encode(r["text"] or ""))) for r in docs.select("doc_id", "text").collect())
    coded = pieces.encode_documents(docs, MODEL)
    assert sorted((repr(r["doc_id"]), repr(list(r["ids"]))) for r in coded.collect()) == want
    texts_ = sorted((repr(r["doc_id"]), r["text"]) for r in pieces.decode_documents(coded, MODEL).collect())
    assert texts_ == sorted((repr(r["doc_id"]), r["text"] or "") for r in docs.select("doc_id", "text").collect())
    rows = docs.select("doc_id", "text").collect()
    digest = [(repr(r["doc_id"]), len(ids), crc(ids), hashlib.sha256(sentencepiece_model.decode(ids).encode()).hexdigest()) for r in rows for ids in [sentencepiece_model.encode(r["text"] or "")]]
    assert sorted((repr(r["doc_id"]), r["n_ids"], r["ids_crc32"], r["decoded_sha256"]) for r in pieces.digests(docs, MODEL).collect()) == sorted(digest)


def test_words_of_any_length_go_through_the_pass(sentencepiece_model, monkeypatch):
    """Text without spaces, encoded blobs, one letter over and over, long runs of spaces: no word is merged one by one."""
    rng = random.Random(0)
    own = pieces.Coder(MODEL)
    merge = own.merge_one_by_one
    monkeypatch.setattr(own, "merge_one_by_one", lambda word: merge(word) if not word.strip(pieces.SPACE) else pytest.fail(word[:20]))
    texts_ = [
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "".join(rng.choice("ABab01+/xyz") for _ in range(3000)), "a" * 2000, "the" * 700, "ab" * 900,
        "中文没有空格" * 100, "ไทย" * 200, "antidis" * 60 + "é" * 300, " " * 700 + "x", "x" + " " * 333, "  the   cat\n    sat    ", "supercalifragilistic" * 20,
    ]
    ids, bounds = own.encode(texts_)
    for text, a, b in zip(texts_, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == sentencepiece_model.encode(text)


def test_windows_and_repeated_pairs_do_not_change_pieces(monkeypatch):
    words = ["▁international", "▁misunderstood", "▁" + "abcde" * 30]
    want = [pieces.Coder(MODEL).segment([w]).tolist() for w in words]
    monkeypatch.setattr(pieces, "POSITIONS", 5)
    monkeypatch.setattr(pieces, "PAIRS", 1 << 21)
    assert [pieces.Coder(MODEL).segment([w]).tolist() for w in words] == want


def test_keys_are_confirmed_by_characters():
    """A substring with the key of a piece but other characters isn't that piece."""
    own = pieces.Coder(MODEL)
    chars = np.array([[ord(c) for c in "zq"]], dtype=np.uint32)
    other = own._keys(own._prefix_hashes(np.array([[ord(c) for c in "th"]], dtype=np.uint64)), 2)
    assert own._probe(other, chars, 2).tolist() == [[-1]]
    assert own.text[own._probe(other, np.array([[ord(c) for c in "th"]], dtype=np.uint32), 2)[0, 0]] == "th"


def test_packing_leaves_other_columns_alone(spark):
    rows = [(k, 0, k % 9 + 1, "mine", "dot", "old") for k in range(50)] + [(None, 0, 3, "mine", "dot", "old")] * 2
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, _rank string, `a.b` string, offset string")
    for name in ("__rank", "_bucket", "__place", "_place"):
        df = df.withColumn(name, F.lit("mine"))
    got = packing.pack(df, capacity=10)
    assert got.count() == 52 and set(got.columns) == {*df.columns, "sequence_id"}
    for r in got.collect():
        assert (r["_rank"], r["a.b"], r["__rank"], r["_bucket"], r["__place"], r["_place"]) == ("mine", "dot", "mine", "mine", "mine", "mine")
    for _, bin_ in got.toPandas().sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == (bin_["length"].cumsum() - bin_["length"]).tolist() and bin_["length"].sum() <= 10


def test_a_length_has_a_bounded_number_of_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", 3)
    df = spark.range(4000).selectExpr("id as doc_id", "0 as piece", "if(id % 10 = 0, 3L, 7L) as length")
    got = packing.pack(df, capacity=10, bucket_rows=2).toPandas()
    assert (got.groupby("sequence_id")["length"].sum() <= 10).all() and got["sequence_id"].nunique() == 3600
    assert not got.duplicated(["sequence_id", "offset"]).any()


def test_starts_of_files(spark):
    rows = [(f"file:/x/part-{k:05d}-abc-c000.txt", n) for k in range(0, 60, 3) for n in (k, 1)]
    got = {r["file"]: r["base"] for r in token_files.file_starts(spark.createDataFrame(rows, "file string, n_tokens long"), run=7).collect()}
    total = 0
    for k in range(0, 60, 3):
        assert got[f"file:/x/part-{k:05d}-abc-c000.txt"] == total
        total += k + 1
