import collections
import random
import re

import numpy as np
import pytest

from dossier.llm import components, embeddings, minhash


def least_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    path = [(i, i + 1) for i in range(100, 130)]
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)] + path + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()))
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: c for n, c in least_of(linked, [p for p in pairs if p[0] != p[1]]).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text):
    words = [re.sub(r"[\W_]+", "", w.lower()) or w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def similarity(one, two):
    return sum((one & two).values()) / max(1, sum((one | two).values()))


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9)))
    common = [word() for _ in range(60)]
    out = []
    for _ in range(30):
        words = [word() for _ in range(draw.randrange(60, 300))]
        if draw.random() < 0.5:
            words[10:10] = common
        out.append(" ".join(words))
        for _ in range(draw.randrange(0, 4)):
            copy = list(words)
            for _ in range(max(1, len(copy) // 150)):
                copy[draw.randrange(len(copy))] = word()
            out.append(draw.choice([" ", "\n"]).join(copy))
            out.append(out[-1].upper() + "!")
    return out + ["short text", "short text", "Short text.", "other", "", None, " \n", out[0], "z " * 40_000]


def test_near_duplicates_against_all_pairs(spark):
    given = list(enumerate(corpus()))
    frame = spark.createDataFrame([*given, (3, given[3][1])], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS node")
    rows = minhash.near_duplicates(frame).collect()
    assert len(rows) == len(given) + 1
    got = {r.doc_id: r.class_id for r in rows}
    bags = {d: shingles(t) for d, t in given}
    pairs = [(a, b) for a in bags for b in bags if a < b and bags[a] and bags[b]]
    at = lambda cut: least_of(bags, [p for p in pairs if similarity(bags[p[0]], bags[p[1]]) >= cut])
    # Weights move a similarity a little; no pair of this corpus lies that near.
    assert at(0.77) == at(0.83)
    assert got == at(0.8)


def test_near_duplicates_with_null_ids_and_nothing(spark):
    text = "one two three four five six seven eight"
    frame = spark.createDataFrame([(None, text), (9, text), (4, text.upper()), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (r.class_id for r in minhash.near_duplicates(frame).collect()))) == ["4", "4", "4", "None"]
    assert minhash.near_duplicates(frame.limit(0)).collect() == []


def test_one_of_each_class_stays(spark):
    given = list(enumerate(corpus()))
    frame = spark.createDataFrame([*given, (0, given[0][1])], "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS node", "text AS row")
    kept = minhash.one_per_class(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    bags = {d: shingles(t) for d, t in given}
    pairs = [(a, b) for a in bags for b in bags if a < b and bags[a] and bags[b] and similarity(bags[a], bags[b]) >= 0.8]
    assert sorted(r.doc_id for r in rows) == sorted({*least_of(bags, pairs).values()})
    assert all(r.text == r.row == dict(given)[r.doc_id] for r in rows)


def test_samples_agree_as_often_as_texts_are_alike():
    draw = np.random.default_rng(4)
    shared = np.sort(draw.integers(0, 1 << 63, 400, np.uint64))
    weights = draw.random(400) + 0.5
    other = weights * np.where(draw.random(400) < 0.3, 0.4, 1)
    sampler, hits = minhash.Sampler(), 0
    for turn in range(40):
        keys = np.sort(minhash.mixed(shared + np.uint64(turn)))
        a = sampler.sample(keys, weights, np.array([0, 400]))
        b = sampler.sample(keys, other, np.array([0, 400]))
        hits += (a == b).sum()
    want = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
    assert abs(hits / (40 * minhash.SAMPLES) - want) < 0.03


@pytest.mark.parametrize("block,chars", [(1000, 10**9), (7, 10**9), (1000, 3000)])
def test_blocks_of_a_bucket(spark, block, chars):
    """Trees over blocks link just what all pairs of different components link."""
    draw = random.Random(3)
    base = [draw.choice("abcdefgh") * draw.randrange(1, 4) for _ in range(80)]
    given = []
    for node in range(60):
        words = list(base)
        for _ in range(draw.randrange(0, 8)):
            words[draw.randrange(80)] = "x%d" % draw.randrange(99)
        if node % 5 == 0:
            words += ["same words over and over"] * draw.randrange(4)
        given.append((1, node, node // 3, " ".join(words), 60, 20_000))
    members = spark.createDataFrame(given, "bucket long, node long, component long, text string, size long, chars long")
    ones = spark.sparkContext.broadcast(np.ones(1 << minhash.TABLE_BITS))
    got = [(r.a, r.b) for r in minhash.block_links(members, ones, 0.8, block, chars).collect()]
    bags = [shingles(t) for _, _, _, t, _, _ in given]
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60) if a // 3 != b // 3 and similarity(bags[a], bags[b]) >= 0.8]
    assert pairs and least_of(range(60), got) == least_of(range(60), pairs)


def vectors():
    draw = np.random.default_rng(8)
    out = []
    for label in (1, 2):
        for _ in range(12):
            base = draw.normal(size=16)
            for _ in range(draw.integers(1, 5)):
                # Noise that puts many cosines next to the threshold.
                out.append((label, (base + draw.normal(size=16) * draw.choice([0.0, 0.2, 0.28, 0.3])) * draw.choice([1e-3, 1, 50])))
    return [(i, label, [float(np.float32(x)) for x in v]) for i, (label, v) in enumerate(out)]


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    given = vectors()
    given += [(100, 1, given[0][2]), (101, 1, [2 * x for x in given[0][2]]), (102, 2, given[0][2])]
    odd = [(200, None, [1.0] * 16), (201, 1, None), (202, 1, [0.0] * 16), (203, 1, [float("nan")] * 16), (204, 1, [None] * 16), (205, 1, []), (None, 1, given[3][2])]
    frame = spark.createDataFrame([*given, *odd], "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS node", "2 AS copies")
    monkeypatch.setattr(embeddings.tile_links, "__defaults__", (10,))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame).collect()}
    sound = [*given, odd[-1]]
    cosine = lambda x, y: np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))
    pairs = [
        (i, j) for i in range(len(sound)) for j in range(i + 1, len(sound))
        if sound[i][1] == sound[j][1] and cosine(np.array(sound[i][2]), np.array(sound[j][2])) >= 0.93
    ]
    degree = collections.Counter(i for p in pairs for i in p)
    root = least_of(range(len(sound)), pairs)
    want = {v[0]: (degree[i], sound[root[i]][0], v[0] is not None and v[0] == sound[root[i]][0]) for i, v in enumerate(sound)}
    want |= {v: (0, v, True) for v in range(200, 206)}
    assert got == want
    assert embeddings.near_vectors(frame.limit(0)).collect() == []


def test_bounds_hold():
    draw = np.random.default_rng(9)
    one, two = draw.normal(size=(60, 32)), draw.normal(size=(50, 32))
    exact = (one / np.linalg.norm(one, axis=1)[:, None]) @ (two / np.linalg.norm(two, axis=1)[:, None]).T
    for cut in np.quantile(exact, [0.01, 0.5, 0.9, 0.999]):
        assert ((exact >= cut) == embeddings.linked_pairs(one, two, cut)).mean() > 0.9999
