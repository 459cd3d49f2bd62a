import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from brokerlens.llm import bpe, planes, pretokens
from tests.llm.conftest import TEXTS

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SPACES = " \n\t\r\x0b\x1c\x85\xa0 　abcXYZ'stre09é漢字🙂.,!-_\x00​́ʼ "


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def library(merges):
    held = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    return held.encode_ordinary


@pytest.fixture(scope="module")
def tokenizer():
    held = Tokenizer.from_file(VOCABULARY)
    held.encode_special_tokens = True
    return lambda text: held.encode(text, add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(SPACES) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    return made + ["", " ", "  ", "a ", " a", "a  ", "a \n b", "a" * 5000, "ab" * 300 + " " + "z" * 129, "<|endoftext|>", "x " * 50]


def test_matrices_and_cache_equal_the_library(merges, library):
    cache = pretokens.PretokenCache(public_tokenizers.PATTERN, merges.encode)
    texts = odd_texts()
    for text, ids in zip(texts, cache.texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text)
        assert merges.decode(ids) == text.encode()


def test_memo_may_run_full(merges, library, monkeypatch):
    monkeypatch.setattr(pretokens, "MEMO_ENTRIES", 20)
    monkeypatch.setattr(pretokens, "PART_CHARS", 200)
    cache = pretokens.PretokenCache(public_tokenizers.PATTERN, merges.encode)
    texts = odd_texts()[:300] + ["y" * 90 + " " + "y" * 90] * 3
    assert [np.frombuffer(i, "<u4").tolist() for i in cache.texts(texts)] == [library(t) for t in texts]


def test_bpe_query_rows(spark, crowded, nothing, library):
    rows = bpe.encode_decode(crowded, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((len(i := library(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for _, t, *_ in TEXTS)
    assert sorted(tuple(r)[1:] for r in rows) == want
    assert bpe.encode_decode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        for top in (2, 300, 50_257, 1 << 32):
            ids = rng.integers(0, top, n).astype(np.uint32)
            assert (planes.from_planes(planes.to_planes(ids, bits), n, bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_files_give_back_every_document_in_order(spark, bits, tokenizer, crowded):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for docs in (small, crowded.select("doc_id", "text", "score")):
        folder, manifest = planes.write(docs, VOCABULARY, public_tokenizers.PATTERN, chunk_ids=1000, bits=bits)
        rows = planes.read(spark, folder, manifest, docs.schema["doc_id"]).collect()
        held = [(r["doc_id"], tokenizer(r["text"] or "") + [planes.END_ID]) for r in docs.collect()]
        crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((k or 0, len(i), crc(i)) for k, i in held)
        at = 0
        for row in sorted(rows, key=lambda r: r["start"]):
            assert row["start"] == at
            at += row["n_tokens"]
        order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
        assert order == sorted(order, key=lambda k: (k is not None, k or 0))


def test_an_empty_table_has_no_files(spark, nothing):
    folder, manifest = planes.write(nothing, VOCABULARY, public_tokenizers.PATTERN)
    assert manifest.count() == 0 and planes.read(spark, folder, manifest, nothing.schema["doc_id"]).count() == 0


def test_added_tokens_in_texts_as_the_library_has_them(spark):
    library = Tokenizer.from_file(VOCABULARY)
    texts = [*odd_texts()[-40:], "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n y", "<|endoftext", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder, manifest = planes.write(docs, VOCABULARY, public_tokenizers.PATTERN)
    rows = planes.read(spark, folder, manifest, docs.schema["doc_id"]).orderBy("start").collect()
    at = 0
    for row in rows:
        ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids + [planes.END_ID]
        assert (row["start"], row["n_tokens"]) == (at, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(rows) == len(texts)
    sized = planes.counted(docs, VOCABULARY, public_tokenizers.PATTERN, "text", "n").collect()
    assert {r["doc_id"]: r["n"] for r in sized} == {r["doc_id"]: r["n_tokens"] for r in rows}
