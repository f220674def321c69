"""Near-duplicates beside a plain version on the full sets, and the index beside all pairs of signatures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.llm import minhash


def brute(rows, n=3, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    head = list(range(len(rows)))

    def top(k):
        while head[k] != k:
            k = head[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            linked = a and b and 100 * len(a & b) >= percent * len(a | b)
            if None not in (rows[x][0], rows[y][0]) and (linked or rows[x][0] == rows[y][0]):
                head[top(x)] = top(y)
    out = []
    for k, (i, _) in enumerate(rows):
        component = None if i is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and top(j) == top(k))
        out.append((i, len(sets[k]), component, i is None or i == component))
    return sorted(out, key=repr)


def plain(found):
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def families(seed):
    """A chain-like family around the threshold, small families, exact copies, and strangers with a passage in common."""
    rng = random.Random(seed)
    fresh = lambda k: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(k))
    base, passage = fresh(150), fresh(60)
    texts = [edited(rng, base, rng.randrange(0, 7)) for _ in range(60)]
    for _ in range(8):
        own = fresh(rng.randrange(5, 90))
        texts += [own, own.upper(), edited(rng, own, 1), edited(rng, own, 2)]
    texts += [passage + " " + fresh(60) for _ in range(25)] + [fresh(k) for k in (1, 2, 3, 4)]
    rng.shuffle(texts)
    return list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))


def test_classes_against_brute_force(spark, docs):
    rows = families(1)
    assert plain(minhash.near_duplicates(docs([(i, t, "s") for i, t in rows]))) == brute(rows)


@pytest.mark.parametrize("tile, pivots", [(8, 2), (4, 0)])
def test_large_groups_in_tiles(spark, docs, monkeypatch, tile, pivots):
    """Groups of many tiles, with and without pivots: what these leave open is compared tile by tile."""
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    rows = families(2)
    assert plain(minhash.near_duplicates(docs([(i, t, "s") for i, t in rows]))) == brute(rows)


def test_odd_rows(spark, docs):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(2000)}" for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (7, "a b c d e"), (8, "a b c d e"), (8, "x y z u v"),
            (9, "x y z u v"), (None, "a b c d e"), (None, None), (10, long), (11, edited(rng, long, 5)), (12, "é ü ß 漢"), (13, "É ü ß 漢")]
    frame = docs([(i, t, "s") for i, t in rows], extra=("rep", "grp", "n", "signature", "mark"))
    assert plain(minhash.near_duplicates(frame)) == brute(rows)
    assert minhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("chunks", [2, 5])
def test_index_meets_all_close_signatures(spark, chunks):
    """Every pair under the distance shares a key."""
    rng = np.random.default_rng(chunks)
    lanes = rng.integers(0, 3, (150, 4 * chunks)).astype(np.uint16)
    rows = [(i, [int(v) for v in x.view(np.int64)]) for i, x in enumerate(lanes)]
    keys = spark.createDataFrame(rows, "id long, signature array<long>").select("id", minhash.index_keys(chunks).alias("k"))
    assert keys.select(F.size("k")).first()[0] == 4 * chunks
    keys = {r["id"]: set(r["k"]) for r in keys.collect()}
    far = (lanes[:, None] != lanes[None]).sum(2)
    close = [(a, b) for a in range(150) for b in range(a) if far[a, b] < 2 * chunks]
    assert close and all(keys[a] & keys[b] for a, b in close)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    common, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (17_000, 1500, 1500))
    x, y = (minhash.signature(np.unique(np.concatenate([common, s])), 200).view(np.uint16) for s in (a, b))
    assert abs((x == y).mean() - 0.85) < 0.06
