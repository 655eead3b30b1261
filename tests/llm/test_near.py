"""Repeats, near-duplicates and vectors against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from alertloom.llm import embeddings, repeats, simhash
from alertloom.llm.components import components


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(200 + k, 201 + k) for k in range(30)] + [(5, 5), (3, 4), (4, 3)]
    links += [(900, 900 + k) for k in range(1, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == _roots({n for link in links for n in link}, links)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- repeats


def _brute_repeats(texts, size):
    counts = Counter(t[p : p + size] for t in texts for p in range(len(t) - size + 1))
    found = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if counts[t[p : p + size]] > 1:
                gone[p : p + size] = b"\x01" * size
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(t, gone) if not g)
        found.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return found


@pytest.mark.parametrize("batches, group_contexts", [(1, 1_024), (3, 1_024), (2, 2)])
def test_repeats_equal_brute_force(spark, batches, group_contexts):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(25)]
    texts += [" ".join(word() for _ in range(30)) + passage[rng.randint(0, 120) :] + word() for _ in range(12)]
    texts += [passage, passage, None, "", "x" * 199, "y" * 200, "z" * 200, "z" * 200, "q" * 1_500, "ab" * 400]
    near = list(texts[0] + passage + texts[1])
    near[len(near) // 2] = "#"
    texts += ["".join(near), texts[3] + texts[4], "é" * 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    rows = repeats.deduplicated(docs, batches=batches, group_contexts=group_contexts, with_text=True).collect()
    want = _brute_repeats([(t or "").encode() for t in texts], 200)
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == dict(enumerate(want))


def test_repeats_in_texts_over_a_block(spark):
    rng = np.random.default_rng(2)
    long = rng.integers(97, 123, 1_200_000, dtype=np.uint8).tobytes().decode()
    inside = long[1_048_300:1_048_900]  # across the cut between two stretches of the long text
    docs = spark.createDataFrame([(1, long), (2, "-" * 10 + inside + "+" * 10), (None, inside[:150])], "doc_id long, text string")
    rows = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.deduplicated(docs).collect()}
    assert rows == {1: (600, 1), 2: (600, 1), None: (0, 0)}


def test_a_hot_passage_at_the_defaults(spark):
    """One passage in 9,000 texts, each with other words around it, so that its edge grams have as many contexts."""
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(60))
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(12))
    texts = [" ".join([*(word() for _ in range(16)), passage, *(word() for _ in range(16))]) for _ in range(9_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = repeats.deduplicated(docs, with_text=True).collect()
    assert len(rows) == 9_000 and all(r.n_spans == 1 and r.n_removed >= len(passage) + 2 for r in rows)
    # Of the letters next to the passage only those that other texts have there too can go with it.
    assert max(r.n_removed for r in rows) < len(passage) + 20


def test_more_bytes_than_the_hash_tables_reach():
    from alertloom.llm.anchors import BLOCK, Hashes

    rng = np.random.default_rng(3)
    datas = [rng.integers(97, 101, 300, dtype=np.uint8).tobytes() for _ in range(9_000)]
    row, offset, hashes = repeats._strings(datas, np.full(9_000, 150), 200)
    assert len(row) == 9_000 * 101 and row[-1] == 8_999 and offset[-1] == 100
    _, _, alone = repeats._strings(datas[8_000:8_001], np.full(1, 150), 200)
    assert (hashes[row == 8_000] == alone).all()
    with pytest.raises(ValueError):
        Hashes(np.zeros(2 * BLOCK + 1, np.uint8))


def test_levels_merge_geometrically(spark):
    index = repeats.Index()
    for k in range(4):
        texts = spark.createDataFrame([(k * 100 + j, f"{k} {j} " * 60) for j in range(8)], "doc_id long, text string")
        index.add(repeats.named(texts))
    assert len(index.levels) < 4
    sizes = [n for n, _ in index.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_no_documents_have_no_repeats(no_documents):
    assert repeats.deduplicated(no_documents).count() == 0


# ---- simhash


def _print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_of_odd_documents(odd_documents):
    rows = simhash.fingerprints(odd_documents, ("doc_id", "text")).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.fingerprint % (1 << 64) == _print(r.text) for r in rows)


@pytest.mark.parametrize("limit", [4_096, 3])
def test_links_connect_what_is_within_three_bits(spark, limit):
    rng = random.Random(limit)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for base in list(prints)[:12]:
        for _ in range(25):
            changed = base
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                changed ^= 1 << bit
            prints.add(changed)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(table, limit).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in found)
    want = [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3]
    assert _roots(prints, found) == _roots(prints, want)


def _within(prints, bits=3):
    return [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= bits]


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    texts = [None, "", "something else entirely " * 5]
    for _ in range(25):
        base = [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(99)) for _ in range(600)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join(["new", *base]), " ".join(base).upper(), " ".join(base[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept_key", F.lit(1))
    prints = [_print(t) for t in texts]
    want = _roots(range(len(texts)), _within(prints))
    assert {r.doc_id: r.component_id for r in simhash.print_components(docs).collect()} == want
    assert 30 < len(set(want.values())) < 70
    rows = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(set(want.values())) and rows[0].asDict().keys() == {"doc_id", "text", "kept_key"}


def test_rows_that_repeat_a_key(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "A b c d"), (7, "w x y z"), (7, "other words in it"), (None, None), (9, ""), (None, "e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(simhash.keep_one(docs).collect(), key=str) == sorted([(5, "a b c d"), (7, "w x y z"), (7, "other words in it"), (9, ""), (None, None), (None, "e f g h")], key=str)


def test_no_documents_have_no_duplicates(no_documents):
    assert simhash.print_components(no_documents).count() == 0
    assert simhash.keep_one(no_documents).columns == no_documents.columns


# ---- vectors


@pytest.mark.parametrize("cell", [50, 100_000])
def test_vectors_equal_brute_force(spark, cell):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    vectors = [c + rng.normal(scale=0.25, size=16) for c in centres for _ in range(50)]
    vectors += [v * 3 for v in vectors[:5]] + [vectors[9]] * 20
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, [1.0, 2.0], []]
    rows += [(1_000 + k, v) for k, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))
    got = {r.vec_id: tuple(r)[1:] for r in embeddings.near_duplicates(table, vectors_per_cell=cell, block_rows=32).collect()}
    unit = np.array([v for _, v in rows[: len(vectors)]], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    roots = _roots(range(len(vectors)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    want = {k: (int(near[k].sum()) - 1, roots[k], roots[k] == k) for k in range(len(vectors))} | {1_000 + k: (0, 1_000 + k, True) for k in range(len(odd))}
    assert got == want


def _brute_vectors(rows):
    """(links, smallest reachable) by key, lengths apart."""
    links = []
    for width in {len(v) for _, v in rows}:
        keys = [k for k, v in rows if len(v) == width]
        unit = np.array([v for _, v in rows if len(v) == width], np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        links += [(keys[a], keys[b]) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.95)) if a != b]
    roots, counts = _roots([k for k, _ in rows], links), Counter(a for a, _ in links)
    return {k: (counts[k], roots[k]) for k, _ in rows}


def test_each_length_is_compared_within_itself(spark):
    rng = np.random.default_rng(5)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.1]), (6, [-3.0])]
    for width, groups in ((3, 4), (8, 10), (16, 5)):
        rows += [(width * 100 + k, (c + rng.normal(scale=0.2, size=width)).tolist()) for k, c in enumerate(np.repeat(rng.normal(size=(groups, width)), 8, axis=0))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table, vectors_per_cell=20, probes=100).collect()}
    assert got == _brute_vectors(rows) and got[6] == (0, 6)


@pytest.mark.parametrize("probes", [1_000, embeddings.PROBES])
def test_large_cells_are_split(spark, probes, monkeypatch):
    """With all cells visited nothing is lost; with the default few a share under a tenth."""
    monkeypatch.setattr(embeddings, "MAX_CELLS", 4)
    monkeypatch.setattr(embeddings, "SPLIT_ROWS", 100)
    rng = np.random.default_rng(6)
    near = np.repeat(rng.normal(size=(60, 24)), 10, axis=0)
    hot = np.repeat(rng.normal(size=(1, 24)), 300, axis=0)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([near + rng.normal(scale=0.14, size=near.shape), hot + rng.normal(scale=0.1, size=hot.shape)]))]
    parts = []
    whole = embeddings._split
    monkeypatch.setattr(embeddings, "_split", lambda *a: parts.append(whole(*a)) or parts[-1])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table, vectors_per_cell=10, block_rows=64, probes=probes).collect()}
    want = _brute_vectors(rows)
    assert parts[0].where("part > 0").count() > 0
    if probes > 100:
        assert got == want
    found, true = (sum(n for n, _ in r.values()) for r in (got, want))
    assert 0.9 * true <= found <= true and true > 50_000


def test_no_vectors_and_only_bad_ones(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(4, [0.0])], schema)).collect()] == [(4, 0, 4, True)]


def test_a_full_block_of_copies_holds_one_strip_of_links():
    import tracemalloc

    import pyarrow as pa

    n = 2_500
    vectors = np.ones((n, 2)) / 2**0.5
    one = pa.table({"side": np.repeat([0, 1], n), "node": np.tile(np.arange(n), 2), "n": np.ones(2 * n, np.int64), "vector": pa.array(np.tile(vectors, (2, 1)).tolist())})
    tracemalloc.start()
    rows = embeddings._products(0.95)(one).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    links = rows[~rows.is_count]
    assert set(rows[rows.is_count].links) == {n - 1} and len(links) == n - 1
    assert set(_roots(range(n), zip(links.node, links.other)).values()) == {0} and peak < 60e6
