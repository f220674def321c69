"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The index is over the test items, the queries are passages of the training documents: every document is cut into
overlapping windows, and each window retrieves all items whose BM25 score reaches a share of the score that the item
itself would get. Windows come in lengths of powers of two, so that for every item some window holds an occurrence
whole. Postings carry scores already divided by that threshold, with their maximum per block of postings. The weakest
terms of an item, as long as they add up to less than `WEAK`, can't retrieve it alone: a window is a query only if its
other terms reach 1 - `WEAK` for some item. These windows go through WAND with block maxima. Retrieved items are
then verified: their question's word 5-grams must occur in the document, and their answer's words in the windows that
retrieved them. Items cut from prose have no true question and answer; with their whole text given, half of its 5-grams
in the document suffices too, whichever part of the item they are from.

The index is built on Spark; it is told to the tasks in parts of at most `PART_ITEMS` items, a pass over the documents
for each part, so what a task holds is bounded however many items there are.

Defined cases. Items and documents without words match nothing; null is as empty. Equal items are reported under
each of their ids, repeated documents each for itself; of rows with one item_id the smallest text counts. An item without an answer is verified by its question alone.
An empty table on either side gives an empty result. Only key and text are read of both.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.llm.common import free_name
from geoledger.session import broadcast_if_small, materialised

K1, B = 1.2, 0.75
# Share of an item's own score from which a passage retrieves it.
SHARE = 0.5
# Shares of question 5-grams and answer words that the document must hold, or else of the 5-grams of the whole item.
QUESTION, ANSWER, WHOLE = 0.5, 0.5, 0.5
GRAM = 5
# Part of the threshold that an item's weakest terms may hold together.
WEAK = 0.5
POSTING_BLOCK = 16
PART_ITEMS = 4000
# Windows are of 2, 4, ... times this many words.
LEAST_STRIDE = 32

# Bytes that part terms: ASCII but letters, digits and the underscore.
_BETWEEN = bytes(32 if b < 128 and not (chr(b).isalnum() or b == 95) else b for b in range(256))
SENTENCE_END = r"[.!?]+\s+"


def split_item(text: Column) -> tuple[Column, Column]:
    """Question and answer of an item given as one text: the answer is what follows the last end of a sentence."""
    text = F.trim(F.coalesce(text, F.lit("")))
    parts = F.split(text, SENTENCE_END)
    answer = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")
    return F.substring(text, F.lit(1), F.length(text) - F.length(answer)), answer


class Posting(NamedTuple):
    """Items of a term in ascending order, their scores over their thresholds, and the best score of each block."""

    items: list[int]
    scores: list[float]
    best: list[float]
    top: float


class Essential(NamedTuple):
    """Postings without the weakest terms of each item, as arrays: those of term t are start[t] to start[t + 1]."""

    start: np.ndarray
    items: np.ndarray
    scores: np.ndarray


class Part(NamedTuple):
    """Items of one part: postings and essential postings by stride."""

    vocabulary: dict[bytes, int]
    strides: list[int]
    essential: list[Essential]
    postings: list[dict[int, Posting]]
    ids: list[int]
    questions: list[frozenset]
    answers: list[frozenset]
    wholes: list[frozenset]


def terms(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation parts them."""
    return (text or "").lower().encode().translate(_BETWEEN).split()


def grams(found: list[bytes], n: int = GRAM) -> set[tuple]:
    n = min(n, len(found))
    return {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} if n else set()


def _lengths_and_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, question, answer in zip(*(batch.column(c).to_pylist() for c in ("item_id", "question", "answer")), strict=True):
            found = terms(f"{question or ''} {answer or ''}")
            counts = Counter(found)
            rows.extend((item, len(found), t, n) for t, n in counts.items())
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
            names=["item_id", "length", "term", "n"])


def index(items: DataFrame) -> DataFrame:
    """Inverted index of `items` (item_id, question, answer): (item_id, length, term, score)."""
    found = materialised(items.mapInArrow(_lengths_and_terms, "item_id long, length long, term binary, n long"))
    lengths = found.select("item_id", "length").distinct()
    whole = lengths.agg(F.count(F.lit(1)).alias("items"), F.avg("length").alias("mean")).first()
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(whole["items"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(float(whole["mean"] or 1)))
    return found.join(df, "term").select("item_id", "length", "term", (idf * F.col("n") * (K1 + 1) / (F.col("n") + norm)).alias("score"))


def _stride(length: int) -> int:
    stride = LEAST_STRIDE
    while stride < length:
        stride *= 2
    return stride


def _part(texts: list[tuple], rows: list[tuple]) -> Part:
    """Lay out one part of the index. `texts` (item_id, question, answer, and the whole or none), `rows` (item_id, length, term, score)."""
    ids = [t[0] for t in texts]
    at = {item: i for i, item in enumerate(ids)}
    by_item: dict[int, list] = defaultdict(list)
    lengths: dict[int, int] = {}
    vocabulary: dict[bytes, int] = {}
    for item, length, term, score in rows:
        by_item[at[item]].append((score, vocabulary.setdefault(bytes(term), len(vocabulary))))
        lengths[at[item]] = _stride(length)
    strides = sorted(set(lengths.values()))
    lists: list[dict[int, list]] = [defaultdict(list) for _ in strides]
    strong: list[dict[int, list]] = [defaultdict(list) for _ in strides]
    for i in sorted(by_item):
        k, found = strides.index(lengths[i]), sorted(by_item[i])
        threshold, weak = SHARE * sum(score for score, _ in found), 0.0
        for score, term in found:
            part = score / threshold
            lists[k][term].append((i, part))
            weak += part
            if weak >= WEAK:
                strong[k][term].append((i, part))
    postings: list[dict[int, Posting]] = [{} for _ in strides]
    essential = []
    for k in range(len(strides)):
        for term, found in lists[k].items():
            scores = [s for _, s in found]
            best = [max(scores[i:i + POSTING_BLOCK]) for i in range(0, len(scores), POSTING_BLOCK)]
            postings[k][term] = Posting([i for i, _ in found], scores, best, max(best))
        start = np.cumsum([0, *(len(strong[k].get(t, ())) for t in range(len(vocabulary)))])
        flat = [pair for t in range(len(vocabulary)) for pair in strong[k].get(t, ())]
        essential.append(Essential(start, np.array([i for i, _ in flat], np.int64), np.array([v for _, v in flat])))
    return Part(vocabulary, strides, essential, postings, ids,
                [frozenset(grams(terms(t[1]))) for t in texts], [frozenset(terms(t[2])) for t in texts],
                [frozenset(grams(terms(t[3]))) if len(t) > 3 else frozenset() for t in texts])


def wand(lists: list[Posting], threshold: float = 1.0) -> dict[int, float]:
    """All items whose scores over the given posting lists add up to the threshold, by block-max WAND."""
    slack = threshold - 1e-9
    cursors = [[p.items[0], 0, p] for p in lists]
    out: dict[int, float] = {}
    while cursors:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c[2].top
            if total >= slack:
                pivot = i
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        # the block of each list up to the pivot in which the item would lie
        ceiling, last = 0.0, None
        for c in cursors[:pivot + 1]:
            p = c[2]
            block = c[1] // POSTING_BLOCK
            while block + 1 < len(p.best) and p.items[min((block + 1) * POSTING_BLOCK, len(p.items)) - 1] < item:
                block += 1
            ceiling += p.best[block]
            end = p.items[min((block + 1) * POSTING_BLOCK, len(p.items)) - 1]
            last = end if last is None else min(last, end)
        if ceiling >= slack:
            if cursors[0][0] == item:
                score = sum(c[2].scores[c[1]] for c in cursors if c[0] == item)
                if score >= slack:
                    out[item] = score
            target = item + 1 if cursors[0][0] == item else item
        else:
            # nothing up to the nearest end of a block, or up to the next list, can reach the threshold
            target = max(last, item) + 1
            if pivot + 1 < len(cursors):
                target = min(target, cursors[pivot + 1][0])
        for c in cursors[:pivot + 1]:
            p, i = c[2], c[1]
            while i < len(p.items) and p.items[i] < target:
                # whole blocks at once
                end = (i // POSTING_BLOCK + 1) * POSTING_BLOCK
                i = end if end <= len(p.items) and p.items[end - 1] < target else i + 1
            c[1] = i
            c[0] = p.items[i] if i < len(p.items) else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return out


def _queries(part: Part, k: int, cells: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Half windows at which a window starts whose strong terms reach what they must for some item.

    `cells` are the distinct (half window, term) numbers, sorted; `first` and `last` flag the outer halves of texts.
    """
    terms_, items = len(part.vocabulary), len(part.ids)
    start, item, score = part.essential[k]
    halves, found = cells // terms_, cells % terms_
    many = start[found + 1] - start[found]
    at = np.repeat(start[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    keys, place = np.unique(np.repeat(halves, many) * items + item[at], return_inverse=True)
    if not len(keys):
        return keys
    value, half = np.bincount(place, score[at]), keys // items

    def of(wanted: np.ndarray) -> np.ndarray:
        spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[spot] == wanted, value[spot], 0.0)

    need = 1 - WEAK - 1e-9
    after = value + np.where(last[half], 0.0, of(keys + items))
    before = value + np.where(first[half], 0.0, of(keys - items))
    starts = half[(after >= need) & (~last[half] | first[half])]
    return np.unique(np.concatenate([starts, half[(before >= need) & ~first[half]] - 1]))


def _retrieve(part: Part, texts: list[np.ndarray], windows: dict[tuple[int, int], list] | None = None) -> dict[tuple[int, int], tuple[float, int]]:
    """(text, item) -> best score over the windows of the text, and how many retrieve the item. Texts are term numbers.

    `windows`, where given, takes (text, item) -> [first word, end] of those that retrieve it, ascending, overlaps merged.
    """
    out: dict[tuple[int, int], tuple[float, int]] = {}
    sizes = np.array([len(t) for t in texts])
    numbers = np.concatenate([*texts, np.empty(0, np.int64)])
    if not sizes.sum() or not part.ids:
        return out
    words = np.flatnonzero(numbers >= 0)
    for k, stride in enumerate(part.strides):
        halves = np.maximum(1, -(-sizes // stride))
        base = np.concatenate([[0], np.cumsum(halves)])
        owner = np.repeat(np.arange(len(texts)), sizes)
        spot = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first, last = (np.zeros(base[-1], bool) for _ in range(2))
        first[base[:-1]] = last[base[1:] - 1] = True
        # each term once per half window
        cells = np.unique((base[owner[words]] + spot[words] // stride) * len(part.vocabulary) + numbers[words])
        for h in _queries(part, k, cells, first, last).tolist():
            end = h + 1 if last[h] else h + 2
            lo, hi = np.searchsorted(cells, [h * len(part.vocabulary), end * len(part.vocabulary)])
            lists = [part.postings[k][t] for t in set((cells[lo:hi] % len(part.vocabulary)).tolist()) if t in part.postings[k]]
            text = int(np.searchsorted(base, h, "right")) - 1
            for item, score in wand(lists).items():
                best, count = out.get((text, item), (0.0, 0))
                out[text, item] = (max(best, score), count + 1)
                if windows is not None:
                    spans = windows.setdefault((text, item), [])
                    lo, hi = (int(x - base[text]) * stride for x in (h, end))
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = hi
                    else:
                        spans.append([lo, hi])
    return out


# Words of the texts that are looked at together.
_TOGETHER = 200_000


def _matches(part: Part):
    number = part.vocabulary.get

    def verified(docs: list[int], texts: list[list[bytes]]) -> Iterator[tuple]:
        numbers = [np.fromiter((number(t, -1) for t in found), np.int64, len(found)) for found in texts]
        own: dict[tuple[int, int], set] = {}
        windows: dict[tuple[int, int], list] = {}

        def share(d: int, wanted: frozenset) -> float:
            n = len(next(iter(wanted), ()))
            if (d, n) not in own:
                own[d, n] = grams(texts[d], n)
            return len(wanted & own[d, n]) / len(wanted) if wanted else 0.0

        for (d, i), (score, count) in sorted(_retrieve(part, numbers, windows).items()):
            answer = part.answers[i]
            q = share(d, part.questions[i])
            near = {t for lo, hi in windows[d, i] for t in answer.intersection(texts[d][lo:hi])} if answer else ()
            a = len(near) / len(answer) if answer else None
            if q >= QUESTION and (a is None or a >= ANSWER) or share(d, part.wholes[i]) >= WHOLE:
                yield docs[d], part.ids[i], score * SHARE, count, q, a

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs, texts, size = [], [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs.append(doc)
                texts.append(terms(text))
                size += len(texts[-1])
                if size >= _TOGETHER:
                    rows.extend(verified(docs, texts))
                    docs, texts, size = [], [], 0
            rows.extend(verified(docs, texts))
            columns = zip(*rows, strict=True) if rows else ([],) * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "score", "n_passages", "question_overlap", "answer_overlap"])

    return kernel


MATCH = "doc_id long, item_id long, score double, n_passages long, question_overlap double, answer_overlap double"


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified leaks (doc_id, item_id, score, n_passages, question_overlap, answer_overlap).

    `items` has (item_id, question, answer), and `text` where these were cut from prose. `score` is the best BM25 score of a passage as a share of the item's own.
    """
    whole = F.col("text") if "text" in items.columns else F.lit(None).cast("string").alias("text")
    items = items.filter("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(
        F.min(F.struct("question", "answer", whole)).alias("t"))
    items = materialised(items.select("item_id", "t.question", "t.answer", "t.text"))
    count = items.count()
    parts = -(-count // PART_ITEMS)
    postings = materialised(index(items)) if parts else None
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.limit(0).mapInArrow(_matches(Part({}, [], [], [], [], [], [], [])), MATCH)
    for i in range(parts):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i
        # bounded: one part of the items
        texts = [tuple(r) for r in items.filter(mine).orderBy("item_id").collect()]
        own = [tuple(r) for r in postings.filter(mine).select("item_id", "length", "term", "score").collect()]
        found = rows.mapInArrow(_matches(_part(texts, own)), MATCH)
        out = found if i == 0 else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their own columns, those with a verified leak left out. Rows without an id stay."""
    bad = free_name(docs.columns, "bad")
    leaks = broadcast_if_small(materialised(matches(docs, items, key, text).select(F.col("doc_id").alias(bad)).distinct()))
    return docs.join(leaks, docs[key].cast("long") == leaks[bad], "left_anti")
