"""Importance resampling beside a plain version, and the position table beside zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from geoledger.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))


def runs(text, n):
    w = words(text)
    return [" ".join(w[k:k + n]) for k in range(len(w) - n + 1)]


def test_checksums_of_overlapping_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    lengths = np.concatenate([np.arange(1, 200), rng.integers(1, 1000, 101)])
    got = resampling.checksums(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]


@pytest.mark.parametrize("block", [16, 64, 1000, 1 << 20])
@pytest.mark.parametrize("longest", [1, 3])
def test_features_do_not_depend_on_blocks(monkeypatch, block, longest):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = random.Random(block)
    texts = ["".join(rng.choice("aB1 -é漢\n.") for _ in range(rng.choice([0, 3, 50, 400]))) for _ in range(30)]
    texts += [None, "", "x" * 1000, "ab" * 900 + " c", "é" * 300, " ", "last"]
    got = {}
    for n, rows, sums in resampling._features(pa.array(texts).slice(1), longest):
        for row, value in zip(rows.tolist(), sums.tolist(), strict=True):
            got.setdefault((row, n), []).append(value)
    for row, text in enumerate(texts[1:]):
        for n in range(1, longest + 1):
            assert got.get((row, n), []) == [zlib.crc32(r.encode()) for r in runs(text, n)]


def brute(docs, target, longest=1, buckets=50, percent=50, min_words=3, seed=2024):
    def count(texts):
        return Counter(zlib.crc32(r.encode()) % buckets for t in texts for n in range(1, longest + 1) for r in runs(t, n))

    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for i, x in docs:
        found = [zlib.crc32(r.encode()) % buckets for n in range(1, longest + 1) for r in runs(x, n)]
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(words(x)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[3]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < len(able) * percent // 100 else None)
    return sorted((tuple(r) + (None,) * (6 - len(r)) for r in out), key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_draw_against_brute_force(spark, docs, longest):
    rng = random.Random(7)
    stock = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(stock, k=rng.randrange(0, 30)))) for i in range(120)]
    # repeated rows, one id with two texts, no id, no text, one very long text, one very long word
    rows += [rows[5], rows[5], (6, "another text of six words"), (None, "no id but words"), (None, "x y z w"), (200, None), (201, ""), (202, "…! -"),
             (203, " ".join(rng.choices(stock, k=50_000))), (204, "Q" * 100_000 + " and more words")]
    target = ["w1 w2 w3 w1", None, "W2 w5, w5"]
    frame = docs([(i, t, "s") for i, t in rows], extra=("weight", "rank", "tie"))
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(frame, aim, longest=longest, buckets=50, percent=50, min_words=3)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, target, longest)


def test_ties_and_empty_tables(spark, docs):
    aim = spark.createDataFrame([], "text string")
    same = docs([(4, "one two three", "s")] * 10)
    got = resampling.resampled(same, aim, percent=50, min_words=3).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len(got) == 10
    assert {r["weight"] for r in got} == {brute([(4, "one two three")] * 10, [], buckets=10_000)[0][3]}
    assert resampling.resampled(docs([]), aim).count() == 0
