"""Whitening, stream deduplication and spelling variants, each against a brute-force version."""

import collections
import hashlib
import os
import random
import re
import tempfile
import zlib

import numpy as np
import pytest

from dossier.llm import spelling, stream_dedup, whitening

# --- spelling -------------------------------------------------------------


def brute_counts(docs, least_length, least_count, slips):
    total = collections.Counter()
    for number, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if number is None else number}:{word}".encode())
            if slips and h % slips == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, ratio):
    out = {}
    form = {}
    for w, n in counts.items():
        near = [o for o in counts if one_edit(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
        out[w] = [len(near)]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], out[w][0], counts[form[w]] if form[w] else None)
    return out


def random_words(seed, size):
    draw = random.Random(seed)
    counts = {}
    for _ in range(size):
        word = "".join(draw.choice("abñÉ") for _ in range(draw.randrange(6, 13)))
        counts[word] = draw.choice([5, 5, 7, 30, 200, 900])
        for _ in range(draw.randrange(0, 5)):
            at, kind = draw.randrange(len(word)), draw.randrange(3)
            word = word[:at] + draw.choice(["", "x", "b"])[: 1 if kind else 0] + word[at + (kind != 1) :]
            if len(word) >= 6:
                counts[word] = draw.choice([5, 6, 26, 31, 5000])
    return counts


@pytest.mark.parametrize("block", [2, 2048])
def test_near_pairs_are_all_pairs_one_edit_apart(spark, block):
    counts = random_words(3, 90)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(words, block).collect()]
    want = {tuple(sorted((a, b))) for a in counts for b in counts if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_variants(spark):
    counts = random_words(8, 80)
    chain = {"aaaaaaz": 5, "aaaaaaa": 25, "aaaaaab": 130, "aaaaabb": 700}
    counts |= chain
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words).collect()}
    assert got == brute_variants(counts, 5)
    assert got["aaaaaaz"][1] == "aaaaabb"


def test_counted_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 40)
    draw = random.Random(5)
    vocabulary = ["Straße", "ÉLÈVE", "running", "Runners", "×÷×÷×÷", "don't", "naïveté", "abc", "x" * 70]
    docs = [(i % 40, draw.choice([" ", ", ", "\n", "7", "_"]).join(draw.choice(vocabulary) for _ in range(60))) for i in range(60)]
    docs += [(None, "running running"), (7, None), (8, ""), (9, "abcdef" * 3000)] + docs[:2]
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, word int, n string")
    for slips in (None, 3):
        got = {r.word: r.n for r in spelling.counted_words(frame, slips=slips).collect()}
        assert got == brute_counts(docs, 6, 5, slips)


def test_no_words(spark):
    none = spelling.counted_words(spark.createDataFrame([], "doc_id long, text string"))
    assert none.collect() == [] and spelling.variants(none).collect() == []
    alone = spark.createDataFrame([("single", 9)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(alone).collect()] == [("single", None, "single", 9, 0, None)]
    with pytest.raises(ValueError):
        spelling.variants(alone, ratio=1)


# --- whitening ------------------------------------------------------------


def brute_whitened(vectors, keep):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return centred @ vectors[:, :keep] / np.sqrt(values[:keep]), values[:keep] / values.sum(), deviation


@pytest.mark.parametrize("seed,d", [(1, 3), (2, 12), (3, 33)])
def test_whitened(spark, seed, d):
    draw = np.random.default_rng(seed)
    data = (draw.normal(size=(300, d)) @ draw.normal(size=(d, d))).astype(np.float32) * np.logspace(0, -1, d, dtype=np.float32)
    rows = [(i, [float(c) for c in v], "e", 0.0) for i, v in enumerate(data)]
    odd = [(900, None), (901, [float("nan")] * d), (902, [None] * d), (903, [float("inf")] * d), (904, []), (905, [1.0] * (d + 1)), (906, [1e30] * d)]
    frame = spark.createDataFrame([*rows, *[(i, v, "e", 0.0) for i, v in odd]], "vec_id long, embedding array<float>, explained string, n double")
    got = whitening.whitened(frame).collect()
    white, share, deviation = brute_whitened(data, min(8, d))
    assert {r.vec_id for r in got} == set(range(300)) and len(got) == 300 * min(8, d)
    table = np.zeros((300, min(8, d)))
    for r in got:
        assert r.n == 300 and int(r.deviation) == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained - share[r.component - 1]) < 1e-9
        table[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((table * white).sum(0))
    assert np.abs(table * signs - white).max() < 1e-7


def test_jacobi_keeps_small_eigenvalues():
    draw = np.random.default_rng(0)
    basis, _ = np.linalg.qr(draw.normal(size=(20, 20)))
    wanted = np.logspace(6, -4, 20)
    factor = whitening.pivoted_cholesky((basis * wanted) @ basis.T, 0)
    values, vectors = whitening.jacobi(factor)
    assert np.allclose(values[:12], wanted[:12], rtol=1e-7)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10


def test_rank_is_found():
    draw = np.random.default_rng(4)
    wide = draw.normal(size=(9, 3))
    factor = whitening.pivoted_cholesky(wide @ wide.T)
    assert factor.shape == (9, 3) and np.allclose(factor @ factor.T, wide @ wide.T)
    assert whitening.pivoted_cholesky(np.zeros((4, 4))).shape == (4, 0)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 4, schema)).collect() == []
    got = whitening.whitened(spark.createDataFrame([(1, [1.0, 0.0]), (None, [3.0, 0.0]), (1, [1.0, 0.0])], schema)).collect()
    assert sorted(r.component for r in got) == [1, 1, 1]
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "None"]


def test_deviation_is_exact_beyond_64_bits(spark):
    schema = "vec_id long, embedding array<double>"
    values = [3.0e11, -2.5e11, 7.0, 1.5e11]
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened(spark.createDataFrame([(i, [v, 1.0]) for i, v in enumerate(values)], schema)).collect()}
    x = [int(v * 1024) + 100_000 for v in values]
    assert got == {i: (4 * a - sum(x)) ** 2 for i, a in enumerate(x)} and max(got.values()) > 1 << 64


# --- stream deduplication -------------------------------------------------


def brute_classes(rows):
    groups = collections.defaultdict(list)
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    for number, text in rows:
        groups[lower(text)].append(number)
    out = []
    for number, text in rows:
        same = groups[lower(text)]
        keep = max((i for i in same if i is not None), default=None)
        out.append((number, keep, len(same), hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(map(str, out)), len(groups)


def told(frame):
    rows = frame.collect()
    assert all(r.kept is False or r.doc_id == r.keep_id for r in rows)
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows), sum(r.kept for r in rows)


SCHEMA = "doc_id long, text string, digest int, key string, keep string"


def write(spark, folder, rows, files=3):
    frame = spark.createDataFrame([(i, t, 1, "k", "s") for i, t in rows], SCHEMA)
    frame.repartition(files).write.mode("append").parquet(folder)


def random_rows(seed, size):
    draw = random.Random(seed)
    texts = ["", None, "É a", "é A", "x" * 100_000, *("".join(draw.choice("abAB é") for _ in range(draw.randrange(1, 6))) for _ in range(40))]
    return [(draw.choice([None, draw.randrange(1000), draw.randrange(1000)]), draw.choice(texts)) for _ in range(size)]


@pytest.mark.parametrize("digest_bytes", [1, 32])
def test_stream_goes_on_with_new_files(spark, monkeypatch, digest_bytes):
    """With keys of one byte most classes share a key; full texts tell them apart, read here in several parts."""
    monkeypatch.setattr(stream_dedup, "HITS", 60)
    source, work = (os.path.join(tempfile.mkdtemp(prefix="dedup-"), "t") for _ in range(2))
    rows = random_rows(1, 150)
    write(spark, source, rows)
    dedup = stream_dedup.StreamDedup(spark, source, work, digest_bytes=digest_bytes, batches=3)
    dedup.advance()
    assert told(dedup.result()) == brute_classes(rows)
    more = random_rows(2, 100) + [(5000, rows[0][1])]
    write(spark, source, more, 2)
    # Another object goes on from what the work folder holds.
    again = stream_dedup.StreamDedup(spark, source, work, digest_bytes=digest_bytes)
    again.advance()
    assert told(again.result()) == brute_classes(rows + more)
    again.advance()
    assert told(again.result()) == brute_classes(rows + more)
    assert again._last_batch() >= 2


def test_settings_come_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    source, work = (os.path.join(tempfile.mkdtemp(prefix="dedup-"), "t") for _ in range(2))
    write(spark, source, [(1, "a"), (1, "A"), (1, "a")], 1)
    got = stream_dedup.deduplicated(spark, source, work).collect()
    assert [r.kept for r in got].count(True) == 1 and {r.group_size for r in got} == {3}
    assert spark.conf.get(name) == before


def test_empty_source(spark):
    source, work = (os.path.join(tempfile.mkdtemp(prefix="dedup-"), "t") for _ in range(2))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert stream_dedup.deduplicated(spark, source, work).collect() == []
