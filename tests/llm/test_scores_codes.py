"""Quality scores, alignment and vector codes against brute force, the libraries and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from alertloom.llm import alignment, quality_scores as scores, vector_codes as codes
from alertloom.llm.bpe import pieces

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- vector codes


def _brute_codes(vectors, parts=16, entries=64, rounds=2):
    """(codes, error) of integer vectors in order of their keys, and the codebooks, with plain integers."""
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(entry, part)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            members = {}
            for c in cut:
                members.setdefault(nearest(book, c[p])[1], []).append(c[p])
            new.append([[sum(x) // len(x) for x in zip(*members[e])] if e in members else entry for e, entry in enumerate(book)])
        books = new
    found = [[nearest(books[p], c[p]) for p in range(parts)] for c in cut]
    return [([e for _, e in row], sum(d for d, _ in row)) for row in found], books


@pytest.mark.parametrize("spread, n", [(0.02, 300), (3.0, 300), (1.0, 20)])
def test_codes_equal_brute_force(spark, spread, n):
    rng = np.random.default_rng(n)
    made = (rng.standard_normal((n, 32)) * spread).round(3).tolist()
    made[5], made[7] = made[4], [0.0] * 32  # ties and a zero vector
    rows = [(k, v, k % 3 if k % 5 else None, "x") for k, v in enumerate(made)]
    rows += [(n, None, 1, "x"), (n + 1, [None] + made[0][1:], 1, "x"), (n + 2, [float("nan")] + made[0][1:], 1, "x"), (n + 3, [float("inf")] * 32, 1, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, codes string").repartition(5)
    coded, books = codes.encoded(table, carry=("label",))
    got = {r.vec_id: r for r in codes.summed_by(coded, "label", "error", "label_error").collect()}
    want, want_books = _brute_codes([[int(np.floor(256 * x)) for x in v] for v in made])
    assert books[32].books.tolist() == want_books and books[32].digest() == next(iter(got.values())).codebooks
    assert {k: (r.codes, r.error) for k, r in got.items()} == dict(enumerate(want))
    by_label = Counter()
    for k, (_, error) in enumerate(want):
        by_label[rows[k][2]] += error
    assert all(r.label_error == by_label[r.label] for r in got.values())
    ints = np.array([[int(np.floor(256 * x)) for x in v] for v in made])
    apart = (books[32].decoded(np.array([got[k].codes for k in range(n)])) - ints) ** 2
    assert apart.sum(axis=1).tolist() == [got[k].error for k in range(n)]


@pytest.mark.parametrize("width, degree", [(1, 2), (4, 8), (4, 3), (7, 64)])
def test_tree_finds_the_lowest_of_the_nearest(width, degree):
    rng = np.random.default_rng(width)
    entries = rng.integers(-6, 7, (64, width)).astype(np.int64)  # many entries are equal
    entries[40:44] = 10**7
    queries = rng.integers(-9, 10, (3_000, width)).astype(np.int64)
    squares = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    index, square = codes.Gnat(entries, degree).nearest(queries)
    assert index.tolist() == np.argmin(squares, axis=1).tolist() and square.tolist() == squares.min(axis=1).tolist()


def test_tree_leaves_out_subtrees():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10**6, 10**6, (8, 4))
    entries = (centres[:, None] + rng.integers(-9, 10, (8, 8, 4))).reshape(64, 4).astype(np.int64)
    tree, asked = codes.Gnat(entries), []
    search = tree._search

    def counted(node, queries, rows, *rest):
        asked.append(len(rows) * (len(node.splits) if node else 0))
        search(node, queries, rows, *rest)

    tree._search = counted
    tree.nearest(entries[rng.integers(64, size=1_000)] + rng.integers(-2, 3, (1_000, 4)))
    assert sum(asked) < 0.5 * 64 * 1_000


def test_codes_of_odd_tables(spark):
    assert codes.encoded(spark.createDataFrame([], "vec_id long, embedding array<float>"))[0].count() == 0
    rows = [(1, [0.5] * 16), (1, [0.5] * 16), (None, [0.25] * 16), (2, [1.0, 2.0, 3.0]), (3, []), (4, [3e38] * 16), (5, [-3e38] * 16)]
    coded, books = codes.encoded(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = coded.collect()
    assert len(got) == len(rows) and sorted(books) == [0, 3, 16]
    assert all(r.error == 0 and len(r.codes) == 16 for r in got)
    assert [r.codes for r in got if r.vec_id == 1] == [[0] * 16] * 2
    # Each length has books of its own, filled up to whole parts.
    assert books[3].books.shape == (16, 1, 1) and books[16].books[0, :, 0].tolist() == [128, 128, 2**28, -(2**28), 64]


def test_sums_stop_at_the_largest_long(spark):
    rows = spark.createDataFrame([(None, 2**62), (None, 2**62), (1, 5), (1, 6)], "label int, error long")
    got = {(r.label, r.total) for r in codes.summed_by(rows, "label", "error", "total").collect()}
    assert got == {(None, 2**63 - 1), (1, 11)}


# ---- alignment


class _Plain:
    """Both libraries on whole texts."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.bytes_a = pieces(A)

    def byte(self, k):
        name = self.b.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(k) else name.replace("▁", " ").encode()

    def tokens(self, text):
        a, b = self.a.encode(" " + (text or ""), add_special_tokens=False).ids, self.b.encode(text or "")
        spelt = [b"".join(self.bytes_a[i] for i in a), b"".join(map(self.byte, b))]
        return (a, b) if text and spelt == [(" " + text).encode()] * 2 else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        ends_a, ends_b = np.cumsum([len(self.bytes_a[i]) for i in a]), np.cumsum([len(self.byte(i)) for i in b])
        found, i, j = [], 0, 0
        for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            u, w = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
            found.append((a[i:u], b[j:w]))
            i, j = u, w
        return found


def _odd_alignment_texts(odd_texts):
    return [*odd_texts, "a▁b", "x\u0085y z　", "﻿q  ", "<s> </s> <unk>", "née—ça va?  ok\tend ", "naïve " * 3_000, "𝔘𝔫𝔦 " * 20, "the same the same"]


def test_alignment_equals_the_libraries(spark, odd_texts):
    plain, texts = _Plain(), _odd_alignment_texts(odd_texts)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, links string, n_a int").repartition(4)
    groups = {k: plain.groups(t) for k, t in enumerate(texts)}
    for r in alignment.aligned(docs, A, B).collect():
        at_a, at_b = [0, *r.a_ends], [0, *r.b_ends]
        got = [(r.a_ids[at_a[k] : at_a[k + 1]], r.b_ids[at_b[k] : at_b[k + 1]]) for k in range(r.n_groups)]
        assert got == groups[r.doc_id], repr(texts[r.doc_id][:40])
    counts = Counter((g[0][-1], g[1][-1]) for found in groups.values() for g in found)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    found = alignment.aligned(docs, A, B, digest=True)
    table = alignment.link_counts(found, B)
    assert {(r.a, r.b): r.n for r in table.collect()} == counts
    for r in alignment.scored(found, table, A, B).collect():
        links = [(g[0][-1], g[1][-1]) for g in groups[r.doc_id]]
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups[r.doc_id])
        assert r.groups_sha256 == (hashlib.sha256(listed.encode()).hexdigest() if links else "")
        assert (r.n_a, r.n_b) == (sum(len(a) for a, _ in groups[r.doc_id]), sum(len(b) for _, b in groups[r.doc_id]))
        assert (r.n_groups, r.n_links, r.n_best) == (len(links), len(links), sum(counts[x] == best[x[1]] for x in links))
        assert r.count_sum == sum(counts[x] for x in links)


@pytest.mark.parametrize("seed", range(4))
def test_cuts_of_random_ends(seed):
    rng = random.Random(seed)
    ends_a, ends_b, heads, base, want = [], [], [0], 0, []
    for _ in range(30):
        size = rng.choice([0, 1, 2, 40, 700])
        inner = range(1, max(size, 1))
        share = rng.random()
        a = {x for x in inner if rng.random() < share} | ({size} if size else set())
        b = {x for x in inner if x not in a or rng.random() < 0.05} | ({size} if size else set())
        want += sorted(base + x for x in a & b)
        ends_a += sorted(base + x for x in a)
        ends_b += sorted(base + x for x in b)
        heads.append(len(ends_a))
        base += size
    got = alignment.shared_cuts(np.array(ends_a), np.array(ends_b), np.array(heads))
    assert np.array(ends_a)[got].tolist() == want


def test_alignment_of_nothing(spark, no_documents):
    found = alignment.aligned(no_documents, A, B, digest=True)
    assert alignment.scored(found, alignment.link_counts(found, B), A, B).count() == 0
    assert alignment.aligned(no_documents, A, B).count() == 0


def test_pairs_are_bounded_by_the_vocabularies():
    assert alignment.most_pairs(A, B) < 1_000_000


# ---- quality scores


def _measured(text):
    return dict(zip(scores.STATISTICS, scores.measured([text], scores._Characters())[0]))


def test_statistics_of_a_text():
    got = _measured("One one two, THREE!\n\none one two\nOne one two, THREE!\n## 42")
    words, visible = 13, 45
    assert got["log_words"] == pytest.approx(np.log1p(words))
    assert got["log_word_chars"] == pytest.approx(np.log1p(visible / words))
    assert got["capitals"] == pytest.approx(12 / 37) and got["digits"] == pytest.approx(2 / visible)
    assert got["symbols_per_word"] == pytest.approx(np.log1p(2 / words)) and got["shouts_per_word"] == pytest.approx(np.log1p(2 / words))
    assert got["distinct_words"] == pytest.approx(7 / words) and got["doubled_words"] == pytest.approx(1 / words)
    assert got["repeated_lines"] == pytest.approx(1 / 4) and got["bare_words"] == pytest.approx(1 / words)
    assert set(_measured("").values()) == {0.0, 1.0} and _measured("")["distinct_words"] == 1.0


def test_statistics_do_not_depend_on_the_block(odd_texts):
    texts = [t or "" for t in odd_texts]
    together = scores.measured(texts, scores._Characters())
    apart = np.concatenate([scores.measured([t], scores._Characters()) for t in texts])
    assert np.allclose(together, apart, rtol=1e-12)


def test_pooled_scores_rise():
    rng = np.random.default_rng(5)
    bins = np.arange(50)
    counts = rng.integers(1, 9, 50)
    ones = rng.binomial(counts, np.linspace(0.1, 0.9, 50))
    got = scores.Calibration.pooled(bins, counts, ones).of(bins)
    assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() <= 1
    # Pooling keeps the number of ones, and no rising scores are closer in squares (a few random ones tried).
    assert (got * counts).sum() == pytest.approx(ones.sum())
    loss = lambda s: (counts * (s - ones / counts) ** 2).sum()
    assert all(loss(got) <= loss(np.sort(np.clip(got + rng.normal(0, 0.05, 50), 0, 1))) + 1e-12 for _ in range(200))


def _junk(rng, text):
    return rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "*** "), text.replace(" ", " | ")])


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgéö") for _ in range(rng.randint(2, 9)))
    rows = []
    for k in range(600):
        text = " ".join(word() + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(5, 200)))
        good = rng.random() < 0.8
        rows.append((k, text if good else _junk(rng, text), int(good)))
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(9_000, None, "x"), (9_001, "", "x"), (None, "no id", "x")], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(k, g) for k, _, g in rows], "doc_id long, quality int")


def test_held_out_labels_are_told(marked):
    docs, labels = marked
    got = scores.quality_scores(docs, labels).join(labels, "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.quality is not None]
    assert len(got) == 603 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_never_read(marked):
    docs, labels = marked
    turned = labels.withColumn("quality", F.when(scores.fold_of("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in scores.quality_scores(docs, given.repartition(n)).collect()} for given, n in ((labels, 3), (turned, 7)))
    assert one == two


def test_scores_without_labels_or_rows(spark, marked, no_documents):
    docs, labels = marked
    got = scores.quality_scores(docs, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    assert scores.quality_scores(no_documents, labels).count() == 0
    one_kind = scores.quality_scores(docs, labels.withColumn("quality", F.lit(1)).unionByName(labels.withColumn("quality", F.lit(None).cast("int"))))
    assert {r.predicted for r in one_kind.collect()} == {1}


def test_given_documents_are_told(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = scores.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
