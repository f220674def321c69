"""Patches of one JSON document. Small row helpers of the patch operator."""

from __future__ import annotations

import copy
from typing import Any


class PatchError(ValueError):
    """A path that is not there, or a failed test."""


def merge_patch(document: Any, patch: Any) -> Any:
    """Nested merge: null deletes, objects merge, everything else replaces. Missing parents are made."""
    if not isinstance(patch, dict):
        return patch
    out = dict(document) if isinstance(document, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merge_patch(out.get(key), value)
    return out


# Merge patches in a form that composes: what a member becomes. A merge patch alone can't say "this object, whatever
# was there", which a deletion followed by a merge amounts to.
MERGE, REPLACE, DELETE = "merge", "replace", "delete"


def as_change(patch: Any) -> list[Any]:
    """The change that a merge patch makes."""
    if isinstance(patch, dict):
        return [MERGE, {k: [DELETE] if v is None else as_change(v) for k, v in patch.items()}]
    return [REPLACE, patch]


def composed(first: list[Any], then: list[Any]) -> list[Any]:
    """One change that does what two do in turn. It is associative, so runs of patches may be folded in any grouping."""
    if then[0] != MERGE:
        return then
    if first[0] != MERGE:
        return [REPLACE, changed(first[1] if first[0] == REPLACE else None, then)]
    members = dict(first[1])
    for key, change in then[1].items():
        members[key] = composed(members[key], change) if key in members else change
    return [MERGE, members]


def changed(value: Any, change: list[Any]) -> Any:
    """A value after a change that is no deletion."""
    if change[0] == REPLACE:
        return change[1]
    out = dict(value) if isinstance(value, dict) else {}
    for key, inner in change[1].items():
        if inner[0] == DELETE:
            out.pop(key, None)
        else:
            out[key] = changed(out.get(key), inner)
    return out


def _steps(path: str) -> list[str]:
    return [part.replace("~1", "/").replace("~0", "~") for part in path.lstrip("/").split("/")]


def _index(holder: list, key: str, path: str, length: int) -> int:
    """Place in a list; `-` is the end, negative numbers count from it."""
    if key == "-":
        return length
    try:
        place = int(key)
    except ValueError:
        raise PatchError(f"{key} is no index in {path}") from None
    place = place + len(holder) if place < 0 else place
    if not 0 <= place <= length:
        raise PatchError(f"{key} does not exist in {path}")
    return place


def _holder(document: Any, path: str) -> tuple[Any, str]:
    """The object or list that holds the last step of a path."""
    *parents, last = _steps(path)
    here = document
    for step in parents:
        if isinstance(here, list):
            here = here[_index(here, step, path, len(here) - 1)]
        elif isinstance(here, dict) and step in here:
            here = here[step]
        else:
            raise PatchError(f"{step} in {path} does not exist")
    if not isinstance(here, (dict, list)):
        raise PatchError(f"{path} does not exist")
    return here, last


def _read(document: Any, path: str) -> Any:
    holder, key = _holder(document, path)
    if isinstance(holder, list):
        if not holder:
            raise PatchError(f"{path} does not exist")
        return holder[len(holder) - 1 if key == "-" else _index(holder, key, path, len(holder) - 1)]
    if key not in holder:
        raise PatchError(f"{path} does not exist")
    return holder[key]


def _take(document: Any, path: str) -> Any:
    value = _read(document, path)
    holder, key = _holder(document, path)
    if isinstance(holder, list):
        del holder[len(holder) - 1 if key == "-" else _index(holder, key, path, len(holder) - 1)]
    else:
        del holder[key]
    return value


def _put(document: Any, path: str, value: Any, insert: bool) -> None:
    holder, key = _holder(document, path)
    if isinstance(holder, dict):
        holder[key] = value
    elif insert:
        holder.insert(_index(holder, key, path, len(holder)), value)
    else:
        if not holder:
            raise PatchError(f"{path} does not exist")
        holder[len(holder) - 1 if key == "-" else _index(holder, key, path, len(holder) - 1)] = value


def _same(a: Any, b: Any) -> bool:
    """Equal as JSON: true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def json_patch(document: Any, operations: list[dict[str, Any]]) -> Any:
    """Operations in order: add, replace, remove, move, copy, test. The input is left as it was.

    On a list, add and move insert while replace and copy overwrite the place.
    """
    out = copy.deepcopy(document)
    for op in operations:
        kind, path = op["op"], op["path"]
        if kind == "add":
            _put(out, path, op["value"], insert=True)
        elif kind == "replace":
            _read(out, path)
            _put(out, path, op["value"], insert=False)
        elif kind == "remove":
            _take(out, path)
        elif kind == "move":
            _put(out, path, _take(out, op["from"]), insert=True)
        elif kind == "copy":
            _put(out, path, copy.deepcopy(_read(out, op["from"])), insert=False)
        elif kind == "test":
            if not _same(_read(out, path), op["value"]):
                raise PatchError(f"test failed at {path}")
        else:
            raise PatchError(f"unknown operation {kind}")
    return out
