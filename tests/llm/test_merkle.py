"""The manifest beside a plain version that hashes lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from geoledger.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    out = []
    for nodes in tree[:-1]:
        run = at // 8 * 8
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])))
        at //= 8
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        leaves = sorted((r[0] is not None, r[0] or 0, digest(r)) for r in rows if r[2] == lang)
        trees[lang] = ([x[2] for x in leaves], [x[1] if x[0] else None for x in leaves])
    subs = {lang: levels(x[0]) for lang, x in trees.items()}
    top = levels([subs[lang][-1][0] for lang in langs])
    return sorted((
        (lang, i, leaf, subs[lang][-1][0], top[-1][0], path(subs[lang], k) + path(top, langs.index(lang)))
        for lang in langs for k, (leaf, i) in enumerate(zip(*trees[lang], strict=True))), key=repr)


def manifest(spark, rows, extra=()):
    schema = "doc_id long, source string, lang string, n_chars long, text string" + "".join(f", `{c}` string" for c in extra)
    frame = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)
    return merkle.manifest(frame, "doc_id", "lang", FIELDS)


def plain(found):
    return sorted(((r["g"], r["id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in found.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8], [9, 1, 7], [64, 65, 2], [513, 1], [520, 512, 3, 1, 1, 1, 1, 1, 1, 64]])
def test_manifest_against_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    ids = rng.sample(range(10_000), sum(sizes))
    rows = [(ids.pop(), "s", f"l{k}" if k else None, 3, f"Text é {k} {j}") for k, size in enumerate(sizes) for j in range(size)]
    rng.shuffle(rows)
    assert plain(manifest(spark, rows)) == brute(rows)


def test_several_rounds_of_blocks(spark, monkeypatch):
    """Groups of several rounds beside small ones; a block of 8 has one level."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, "s", "a", None, "t") for i in range(700)] + [(i, "s", "b", None, "t") for i in range(9)] + [(1, "s", "é", 1, "t")]
    assert plain(manifest(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, "", "", 0, ""), (3, "", "", 0, ""), (3, "", "", 0, "other"),
            (4, "s", "Z", 1, "x" * 500_000), (5, "s", "a", 1, "line\nline"), (6, "s", "é", 1, "-"), (7, "s", "z", 1, None)]
    assert plain(manifest(spark, rows, extra=("g", "place", "digest", "own", "tie", "part"))) == brute(rows)
    assert manifest(spark, []).count() == 0


def test_fold_finds_tampering(spark):
    rows = [(i, "s", f"l{i % 3}", 1, f"Text {i}") for i in range(200)]
    found = manifest(spark, rows)
    changed = F.when(F.col("id") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("leaf"))
    got = found.select("id", (merkle.fold(changed, F.col("path")) == F.col("root")).alias("ok")).collect()
    assert all(r["ok"] == (r["id"] % 5 != 0) for r in got) and len(got) == 200
