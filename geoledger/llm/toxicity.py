"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

Learning reads at most `MOST_LABELLED` labelled documents of the training folds, dealt by the hash of their id. From
these come a lexicon, words and beginnings of words that toxic documents hold more often than others, with their log
odds, and then the trees. So that the trees see lexicon densities as they will be on unknown texts, each training
document is scored with a lexicon learned without its own fold. Trees learn from all training folds but one, on which
their raw scores are then calibrated.

Features: density, number and weight of lexicon hits, raw and after undoing common disguises (digits and signs for
letters, stretched letters, signs inside words); their distance to the second person; shares of capitals, digits,
punctuation, non-ASCII and disguised words; length. Nothing else of a document is read for its score.

Scoring is one pass of Arrow batches for the features and the trees on the JVM; nothing is shuffled. The lexicon is
bounded by `MOST_TERMS` and told to all tasks.

Defined cases. Null and empty texts have features of 0 and get a score as others do. Without a labelled document of
either kind every score is the share of toxic labels, 0 without labels. Null labels are left out; of repeated labels of
one id the largest counts. Repeated documents get equal scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.session import materialised

# Bounds of what is learned from.
MOST_LABELLED = 20_000
MOST_TERMS = 4_000
# Documents a term must be found in, and its least log odds.
LEAST_DOCS = 3
LEAST_ODDS = 1.5
FOLDS = 5
CALIBRATION_FOLD = 4
TREES, DEPTH, STEP = 30, 4, 0.2
# Words whose weights a task remembers.
MOST_REMEMBERED = 500_000

# Pronouns of the second person in the languages of the corpus, and letters behind disguises.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti tus vous votre vos toi ton ta tes du dich dir dein deine ihr euch euer sie usted ustedes vosotros".split())
DISGUISES = str.maketrans("@0134579$!|", "aoieastgsii")
WORD = re.compile(r"[^\W_]+(?:[^\w\s][^\W_]+)*")
SIGN, LETTER = re.compile(r"[\d@$*|]"), re.compile(r"[^\W\d_]")
STRETCHED = re.compile(r"(.)\1{2,}")
NEAR = 5

FEATURES = [
    "hits", "density", "weight", "mean_weight", "most_weight", "distinct", "clear_hits", "clear_density", "near_person",
    "person_density", "capitals", "shouted", "digits", "marks", "punctuation", "disguised", "non_ascii", "log_words", "mean_length"]


def clear(word: str) -> str:
    """The word without disguises: signs for letters, signs inside, stretched letters."""
    return STRETCHED.sub(r"\1", re.sub(r"[\W_]", "", word.translate(DISGUISES)))


def word_terms(word: str) -> list[str]:
    """What a word is looked up by: itself, and its beginnings, marked as such."""
    return [word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)]


def tokens(text: str) -> tuple[list[str], list[str]]:
    """Lower-cased words, and pieces between spaces as they stand."""
    return WORD.findall(text.lower()), text.split()


class Weights(dict):
    """Weight of a word by the lexicon, 0 for others and `PERSON` for the second person; remembers words, not too many."""

    PERSON = -1.0

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= MOST_REMEMBERED:
            self.clear()
        weight = max((self.lexicon.get(t, 0.0) for t in word_terms(word)), default=0.0)
        weight = self[word] = weight or (self.PERSON if word in SECOND_PERSON else 0.0)
        return weight


def features(text: str | None, weights: Weights) -> list[float]:
    text = text or ""
    found, pieces = tokens(text)
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    of_words = np.fromiter(map(weights.__getitem__, found), np.float64, n)
    places, persons = np.flatnonzero(of_words > 0), np.flatnonzero(of_words == Weights.PERSON)
    hits = of_words[places]
    disguised = hidden = 0
    if SIGN.search(text):
        own = set(found)
        for piece in set(pieces):
            if SIGN.search(piece) and LETTER.search(piece):
                disguised += 1
                plain = clear(piece.lower())
                hidden += plain not in own and weights[plain] > 0
    near = 0
    if len(places) and len(persons):
        spots = np.searchsorted(persons, places)
        left = np.abs(places - persons[np.maximum(spots - 1, 0)])
        right = np.abs(persons[np.minimum(spots, len(persons) - 1)] - places)
        near = int((np.minimum(left, right) <= NEAR).sum())
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    letters = int(counts[65:91].sum() + counts[97:123].sum())
    size = len(raw)
    marks = int(counts[33] + counts[63])
    punctuation = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    shouted = sum(map(str.isupper, pieces))
    total = float(hits.sum())
    return [
        len(hits), len(hits) / n, total, total / n, float(hits.max(initial=0.0)), len({found[i] for i in places.tolist()}), hidden, hidden / n,
        near / n, len(persons) / n, int(counts[65:91].sum()) / max(letters, 1), shouted / max(len(pieces), 1), int(counts[48:58].sum()) / size,
        marks / n, punctuation / size, disguised / max(len(pieces), 1), int(counts[128:].sum()) / size, math.log1p(n), len(text) / n]


def fold_of(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms per fold and label of the documents of a batch: (term, fold, toxic, n)."""
    for batch in batches:
        counts: dict[tuple, int] = {}
        columns = (batch.column(c).to_pylist() for c in ("text", "fold", "toxic"))
        for text, fold, toxic in zip(*columns, strict=True):
            found, _ = tokens(text or "")
            for term in {t for w in set(found) for t in word_terms(w)}:
                counts[term, fold, toxic] = counts.get((term, fold, toxic), 0) + 1
        rows = [(*k, v) for k, v in counts.items()]
        columns = zip(*rows, strict=True) if rows else ([],) * 4
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["term", "fold", "toxic", "n"])


def lexicons(train: DataFrame) -> list[dict[str, float]]:
    """Log odds of toxic terms: of all training folds under 0, and under f of all but fold f."""
    sums = train.mapInArrow(_terms, "term string, fold int, toxic int, n long").groupBy("term").agg(
        *[F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n"))), F.lit(0)).alias(f"n{f}_{t}")
          for f in range(1, FOLDS) for t in (0, 1)])
    docs = {(r["fold"], r["toxic"]): r["count"] for r in train.groupBy("fold", "toxic").count().collect()}
    toxic_docs = sum((F.col(f"n{f}_1") for f in range(1, FOLDS)), F.lit(0))
    other_docs = sum((F.col(f"n{f}_0") for f in range(1, FOLDS)), F.lit(0))
    all_toxic, all_other = (sum(docs.get((f, t), 0) for f in range(1, FOLDS)) for t in (1, 0))
    odds = F.log((toxic_docs + 0.5) / (all_toxic + 1.0)) - F.log((other_docs + 0.5) / (all_other + 1.0))
    top = sums.filter((toxic_docs >= LEAST_DOCS) & (odds >= LEAST_ODDS)).withColumn("odds", odds)
    rows = top.orderBy(F.desc(odds * F.sqrt(toxic_docs.cast("double"))), "term").limit(MOST_TERMS).collect()
    out: list[dict[str, float]] = [{r["term"]: r["odds"] for r in rows}]
    for left_out in range(1, FOLDS):
        folds = [f for f in range(1, FOLDS) if f != left_out]
        positive, negative = (sum(docs.get((f, t), 0) for f in folds) for t in (1, 0))
        part = {}
        for r in rows:
            a, b = (sum(r[f"n{f}_{t}"] for f in folds) for t in (1, 0))
            value = math.log((a + 0.5) / (positive + 1)) - math.log((b + 0.5) / (negative + 1))
            if a >= LEAST_DOCS and value >= LEAST_ODDS:
                part[r["term"]] = value
        out.append(part)
    return out


def _featured(lexicon_of: list[dict[str, float]]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [Weights(lexicon) for lexicon in lexicon_of]
        for batch in batches:
            columns = batch.column("text").to_pylist(), batch.column("lexicon").to_pylist()
            rows = [features(text, weights[i]) for text, i in zip(*columns, strict=True)]
            table = np.array(rows, np.float64).reshape(-1, len(FEATURES))
            kept = [name for name in batch.schema.names if name not in ("text", "lexicon")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(table[:, i]) for i in range(len(FEATURES)))], names=[*kept, *FEATURES])

    return kernel


FEATURE_SCHEMA = ", ".join(f"{f} double" for f in FEATURES)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          seed: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, learned from labels outside the held-out fold."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("toxic")).dropna()
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).filter(fold_of(F.col("id")) != 0)
    buckets = max(1, -(-known.count() // MOST_LABELLED))
    # the bound holds for the sample whatever the hash deals out
    sample = F.broadcast(known.filter(F.pmod(F.xxhash64("id"), F.lit(buckets)) == 0).limit(MOST_LABELLED))
    train = materialised(rows.join(sample, F.col("doc_id") == F.col("id")).select(
        "text", fold_of(F.col("id")).cast("int").alias("fold"), "toxic"))

    kinds = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    out = rows.select("doc_id", "text", F.lit(0).alias("lexicon"))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    if len(kinds) < 2:
        share = float(sum(k * n for k, n in kinds.items()) / max(1, sum(kinds.values())))
        return out.select("doc_id", held_out, F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))

    lexicon_of = lexicons(train)
    schema = f"fold int, toxic int, {FEATURE_SCHEMA}"
    learned = materialised(train.select("text", "fold", "toxic", F.col("fold").alias("lexicon")).mapInArrow(_featured(lexicon_of), schema))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=seed, maxBins=64, minInstancesPerNode=3)
    points = gather.transform(learned).select("features", F.col("toxic").cast("double").alias("toxic"), "fold")
    fitting, calibrating = points.filter(F.col("fold") != CALIBRATION_FOLD), points.filter(F.col("fold") == CALIBRATION_FOLD)
    if len(fitting.select("toxic").distinct().take(2)) < 2 or not calibrating.take(1):
        fitting = calibrating = points
    model = trees.fit(fitting.coalesce(4))
    raw = vector_to_array("rawPrediction")[1].alias("raw")
    curve = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(model.transform(calibrating).select(raw, "toxic"))

    scored = model.transform(gather.transform(out.mapInArrow(_featured(lexicon_of), f"doc_id long, {FEATURE_SCHEMA}"))).select("doc_id", raw)
    scored = curve.transform(scored).withColumn("score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
