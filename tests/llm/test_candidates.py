"""What the n-gram join compares: strangers that share a phrase stay apart, and texts are moved only where they are wanted."""

import random

import pytest
from pyspark.sql import functions as F

from geoledger.llm import jaccard
from geoledger.llm.common import parted
from tests.llm.test_documents import TestJaccard as Join


def strangers(rng, rows=40):
    """Texts without a link, all with one phrase, whose n-gram is in the prefix of each."""
    phrase = next(p for k in range(1000) if jaccard.gram_set(p := f"all of them have {k}", 5)[0] < 2**64 // 20)
    words = iter(rng.sample(range(10**6), rows * 90))
    return [(i, " ".join([*[f"u{next(words)}" for _ in range(90)], phrase]), "s") for i in range(rows)]


@pytest.fixture
def seen(monkeypatch):
    """Numbers of edges that the rounds of components were given."""
    found, whole = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda edges: (found.append(edges.count()), whole(edges))[1])
    monkeypatch.setattr(jaccard._frequent, "__defaults__", (1, 10**6))
    return found


def test_strangers_with_a_common_phrase_are_not_compared(docs, seen):
    rows = strangers(random.Random(1))
    assert {r.n_links for r in jaccard.classes(docs(rows)).collect()} == {0}
    assert seen[0] == 0


@pytest.mark.parametrize("light", [2, 4])
def test_families_among_them_are_found(docs, seen, monkeypatch, light):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    rng = random.Random(light)
    join, rows = Join(), strangers(rng, 12)
    # near copies of three of them, also much shorter ones that consist of common phrases for the most part
    for k in range(3):
        for n in range(8):
            words = rows[k][1].split()[rng.choice([0, 0, 2, 60]):]
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            rows.append((100 + 10 * k + n, " ".join(words), "s"))
    got = join.got(docs(rows))
    assert got == join.brute(rows) and max(links for *_, links in got) > 3


def test_copies_that_begin_alike_list_no_pairs(docs, seen):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(i, f"{base} x{i}", "s") for i in range(30)]
    assert {(r.component_id, r.n_links) for r in jaccard.classes(docs(rows)).collect()} == {(0, 29)}
    assert seen[0] < 30


def test_rows_apart_from_ids(spark):
    rows = spark.range(20000).select(F.when(F.col("id") != 7, F.col("id") * 12345678901 - 10**14).alias("key"), F.lit("x").alias("bucket"))
    ids = rows.filter("pmod(key, 10) = 3").select(F.col("key").alias("_id"))
    apart, near = parted(rows, F.col("key"), ids)
    assert apart.columns == near.columns == rows.columns
    assert apart.join(ids, F.col("key") == F.col("_id")).count() == 0
    assert near.join(ids, F.col("key") == F.col("_id")).count() == ids.count() > 1000
    assert apart.count() + near.count() == 20000 and near.count() - ids.count() < 20000 / 8
    assert parted(rows, F.col("key"), ids.limit(0))[0].count() == 20000
