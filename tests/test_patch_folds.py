"""Folded merge patches and streamed patches beside patches applied one by one."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoledger.functions.patching import PatchError, as_change, changed, composed, json_patch, merge_patch
from geoledger.operators import patch
from geoledger.sources import store

SCALARS = st.none() | st.integers(0, 3) | st.text("ab", max_size=2) | st.lists(st.integers(0, 2), max_size=2)
VALUES = st.recursive(SCALARS, lambda inner: st.dictionaries(st.sampled_from("abc"), inner, max_size=3), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(VALUES, st.lists(VALUES, min_size=1, max_size=5), st.data())
def test_folds_equal_patches_in_turn(document, patches, data):
    want = document
    for p in patches:
        want = merge_patch(want, p)
    changes = [as_change(p) for p in patches]
    # in any grouping
    while len(changes) > 1:
        k = data.draw(st.integers(0, len(changes) - 2))
        changes[k:k + 2] = [composed(changes[k], changes[k + 1])]
    assert changed(document, json.loads(json.dumps(changes[0]))) == want


def test_what_a_merge_patch_cannot_say():
    delete_then_merge = composed(as_change({"a": None}), as_change({"a": {"x": 1}}))
    assert changed({"a": {"y": 2}}, delete_then_merge) == {"a": {"x": 1}}
    replace_then_merge = composed(as_change({"a": 5}), as_change({"a": {"x": 1}}))
    assert changed({"a": {"y": 2}}, replace_then_merge) == {"a": {"x": 1}}


def one_by_one(text, changes):
    try:
        document = json.loads(text)
    except ValueError:
        return text, 0
    failed = 0
    for kind, p in changes:
        try:
            document = (merge_patch if kind == "merge" else json_patch)(document, json.loads(p))
        except (PatchError, KeyError, TypeError, ValueError):
            failed += 1
    return document, failed


ITEMS = "collection string, id string, document string"
PATCHES = "collection string, id string, seq int, kind string, patch string"


def random_patch(rng):
    kind = rng.choice(["merge", "merge", "json"])
    if kind == "merge":
        texts = ['{"p": {"n": %d}}' % rng.randrange(9), '{"p": null}', '{"p": {"m": {"k%d": 1}}}' % rng.randrange(4), "{broken", '{"q": [1, 2]}']
    else:
        texts = ['[{"op": "add", "path": "q/-", "value": %d}]' % rng.randrange(9), '[{"op": "remove", "path": "p/n"}]', "[", '[{"op": "test", "path": "p/n", "value": 1}]', None]
    return kind, rng.choice(texts)


def test_a_table_with_a_hot_item(spark):
    """One item has most patches, in the ranges of several tasks; others have none, some, or a malformed document."""
    rng = random.Random(4)
    items = [("c", f"i{k}", '{"p": {"n": 1}, "q": []}' if k != 7 else '{"p": ') for k in range(20)]
    rows, turns = [], {}
    for k in range(900):
        item = f"i{rng.randrange(15)}" if k % 3 else "i3"
        kind, text = random_patch(rng)
        rows.append(("c", item, k, kind, text))
        turns.setdefault(item, []).append((kind, text))
    rows.append(("c", "missing", 1, "merge", "{}"))
    shuffled = random.Random(5).sample(rows, len(rows))
    stored, wanted = spark.createDataFrame(items, ITEMS), spark.createDataFrame(shuffled, PATCHES)
    got = {r["id"]: r for r in patch.patch_items(stored, wanted, order="seq").collect()}
    assert len(got) == 20
    failures = 0
    for _, item, text in items:
        document, failed = one_by_one(text, turns.get(item, []))
        failures += failed
        assert got[item]["failed"] == failed and (got[item]["error"] is not None) == (failed > 0 or item == "i7")
        assert (got[item]["document"] if item == "i7" else json.loads(got[item]["document"])) == document
    assert "malformed" in got["i7"]["error"]
    found = patch.patch_failures(stored, wanted, "seq")
    assert found.columns == ["collection", "id", "kind", "patch", "error"] and found.count() == failures + 1 > 100
    assert found.filter("error IS NULL").count() == 0


def test_good_patches_hold_beside_a_failed_one(spark, tmp_path):
    items = spark.createDataFrame([("c", "a", '{"id":"a","collection":"c","n":1}'), ("c", "b", '{"id":"b","collection":"c","n":1}')], ITEMS)
    patches = spark.createDataFrame([
        ("c", "a", 1, "merge", '{"n": 2}'), ("c", "a", 2, "json", '[{"op": "remove", "path": "nope"}]'), ("c", "a", 3, "merge", '{"m": 3}'),
        ("c", "b", 1, "merge", '{"n": 2}'), ("c", "b", 2, "merge", '{"collection": "nowhere"}')], PATCHES)
    known = spark.createDataFrame([("c",)], "id string")
    got = {r["id"]: r for r in patch.patch_items(items, patches, known, order="seq").collect()}
    assert json.loads(got["a"]["document"]) == {"id": "a", "collection": "c", "n": 2, "m": 3}
    assert (got["a"]["failed"], got["a"]["error"]) == (1, "nope does not exist") or got["a"]["failed"] == 1
    # a refused move takes all patches of the item back
    assert json.loads(got["b"]["document"])["n"] == 1 and "nowhere" in got["b"]["error"]
    path = str(tmp_path / "items")
    store.write_items(items, path)
    report = {r["id"]: r["error"] for r in store.patch_store(spark, path, patches, known, order="seq").collect()}
    assert set(report) == {"a", "b"} and all(report.values())
    kept = {r["id"]: json.loads(r["document"]) for r in store.read_items(spark, path).collect()}
    assert kept["a"]["m"] == 3 and kept["b"]["n"] == 1


@pytest.mark.parametrize("text", [None, "", "7", "[]"])
def test_odd_documents(spark, text):
    items = spark.createDataFrame([("c", "a", text)], ITEMS)
    patches = spark.createDataFrame([("c", "a", 1, "merge", '{"n": 2}'), ("c", "a", 2, None, "[]")], PATCHES)
    row = patch.patch_items(items, patches, order="seq").first()
    if text is None:
        assert (row["document"], row["error"], row["failed"]) == (None, None, 0)
    elif text == "":
        assert row["document"] == "" and "malformed" in row["error"]
    else:
        assert json.loads(row["document"]) == {"n": 2} and row["failed"] == 0


def test_no_patches(spark):
    items = spark.createDataFrame([("c", "a", "{}")], ITEMS)
    assert [r["document"] for r in patch.patch_items(items, spark.createDataFrame([], PATCHES)).collect()] == ["{}"]
