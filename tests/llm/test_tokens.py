"""Token counts, BPE encoding and token shards against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertloom.llm import bpe, token_counts, wavelet
from alertloom.llm.pretokens import WordCache, blocks, row_sums, splitter, word_ids

from .conftest import BYTES, WORDS

ALPHABET = list("\x00ab'strevlmd  \n\t1 2!?-_ßéÉİΣσǅ①٣́  ÅÅ한글ﬁ\U0001f600ᾈͅ") + ["<|endoftext|>", "<|startoftext|>", "'re", "'ll", "'s", " '"]


def _fuzz(n=4_000, most=40):
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_split_words_encode_as_the_library_does(path):
    split = splitter(path)
    cache, texts, got = WordCache(split, most=500), _fuzz(), []
    for part, some in blocks(pa.array(texts), 2_000):
        words = split.split(some)
        ids, sizes = cache.encode(words)
        got += np.split(ids, np.cumsum(row_sums(words.rows, sizes, len(some)))[:-1])
    want = split.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_every_prefix_of_a_word_counts_as_the_library_says(word_tokenizer):
    split = splitter(WORDS)
    counter, rng = token_counts.PrefixCounter(split), random.Random(3)
    for _ in range(1_500):
        word = "".join(rng.choice("aab!!?'st-_ßéelloingthe你好한😀½") for _ in range(rng.randint(1, 20)))
        for w in split.split([word]).distinct()[0]:
            assert counter.word(w) == [len(word_tokenizer.encode(w[: k + 1], add_special_tokens=False).ids) for k in range(len(w))]


def test_token_counts_of_odd_documents(odd_documents, word_tokenizer):
    rows = odd_documents.select("doc_id", F.col("text").alias("t"), "text").transform(lambda d: token_counts.prefix_counts(d, WORDS, ("doc_id", "t")))
    found = rows.select("t", "n_bytes", token_counts.tokens_in(F.col("counts")).alias("n"), "counts").collect()
    assert len(found) == odd_documents.count()
    for row in found:
        text = row.t or ""
        assert (row.n_bytes, row.n) == (len(text.encode()), len(word_tokenizer.encode(text, add_special_tokens=False).ids))


def test_prefixes_and_budgets_are_read_from_the_counts(spark, word_tokenizer):
    texts = ["Hello there, they're going to the harbour", "a !<|startoftext|>x b", "", "zzzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = token_counts.prefix_counts(docs, WORDS)
    c = F.col("counts")
    for row in stored.select("doc_id", "counts", token_counts.longest_prefix(c, 4).alias("cut"), token_counts.tokens_in(c, F.lit(7)).alias("seven")).collect():
        text = texts[row.doc_id]
        counts = [len(word_tokenizer.encode(text[: k + 1], add_special_tokens=False).ids) for k in range(len(text))]
        assert row.counts == counts
        assert row.cut == max([k + 1 for k, n in enumerate(counts) if n <= 4], default=0)
        assert row.seven == (counts[min(7, len(counts)) - 1] if counts else 0)


def test_bpe_round_trip_of_odd_documents(odd_documents, byte_tokenizer):
    encoded = bpe.encode(odd_documents, BYTES, ("doc_id", "group", "text"), group_chars=2_000)
    rows = bpe.decode(encoded, BYTES).collect()
    assert len(rows) == odd_documents.count()
    for row in rows:
        ids = byte_tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.decoded == byte_tokenizer.decode(ids, skip_special_tokens=False)
    digests = bpe.decode(bpe.encode(odd_documents, BYTES, ("text",)), BYTES, digest=True).collect()
    for row in digests:
        ids = byte_tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_decoding_any_ids(spark, byte_tokenizer):
    rng = random.Random(5)
    lists = [[rng.randrange(50_257) for _ in range(rng.randrange(30))] for _ in range(200)] + [None, []]
    rows = bpe.decode(spark.createDataFrame(list(enumerate(lists)), "k long, ids array<int>"), BYTES).collect()
    assert {r.k: r.decoded for r in rows} == {k: byte_tokenizer.decode(i, skip_special_tokens=False) if i else "" for k, i in enumerate(lists)}


def test_nothing_gives_nothing(no_documents):
    assert bpe.encode(no_documents, BYTES).count() == 0
    assert token_counts.prefix_counts(no_documents, WORDS).count() == 0


@pytest.mark.parametrize("n, ids", [(0, 1), (1, 1), (511, 3), (512, 70_000), (5_000, 50_257), (3_000, 2)])
def test_wavelet_matrix(n, ids):
    values = np.random.default_rng(n).integers(0, ids, n)
    matrix = wavelet.WaveletMatrix.of(values)
    again = wavelet.WaveletMatrix.from_row(matrix.n, matrix.planes())
    assert again.all().tolist() == values.tolist()
    for at in range(0, n, 97):
        assert again.access(at) == values[at]
        token = int(values[at])
        assert again.rank(token, at) == (values[:at] == token).sum()
        assert [again.select(token, k) for k in range(min(again.rank(token), 5))] == np.flatnonzero(values == token)[:5].tolist()
    assert again.rank(ids + 7) == 0 and again.select(ids, 0) == -1 and again.select(0, n + 1) == -1


def test_token_shards_of_odd_documents(spark, odd_documents, byte_tokenizer):
    shards = wavelet.read(spark, wavelet.write(odd_documents, BYTES, shard_tokens=500))
    assert shards.count() > 2
    rows = sorted(wavelet.document_rows(shards).collect(), key=lambda r: r.start)
    docs = sorted(odd_documents.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at, whole = 0, []
    for row, doc in zip(rows, docs, strict=True):
        ids = byte_tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [wavelet.END_ID]
        assert tuple(row) == (doc.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        whole += ids
    assert sorted(r.place for r in wavelet.occurrences(shards, wavelet.END_ID).collect()) == [k for k, i in enumerate(whole) if i == wavelet.END_ID]


def test_no_documents_give_no_shards(spark, no_documents):
    assert wavelet.document_rows(wavelet.read(spark, wavelet.write(no_documents, BYTES))).count() == 0


def test_shard_writers_take_texts_in_small_parts(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(3 * wavelet.BATCH_ROWS, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    with wavelet.small_batches(spark):
        sizes = docs.mapInArrow(lambda batches: (b.slice(0, 1).select([0]).set_column(0, "n", pa.array([b.num_rows], pa.int64())) for b in batches), "n long").collect()
    assert [r.n for r in sizes] == [wavelet.BATCH_ROWS] * 3
    folder = wavelet.write(docs, BYTES, str(tmp_path / "shards"), shard_tokens=300)
    assert spark.conf.get(name) == before and wavelet.document_rows(wavelet.read(spark, folder)).count() == 3 * wavelet.BATCH_ROWS


def test_words_met_before_are_not_encoded_again():
    split, cache = splitter(BYTES), word_ids(BYTES)
    words = split.split(["some words that a later task meets again"])
    first, asked = cache.encode(words), []
    make, again = cache.make, word_ids(BYTES)
    again.make = lambda new: asked.append(new) or make(new)
    try:
        second = again.encode(words)
    finally:
        again.make = make
    assert not asked and [a.tolist() for a in first] == [a.tolist() for a in second]
