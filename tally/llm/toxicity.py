"""Toxicity: gradient-boosted trees over a few dense features, calibrated by isotonic regression.

The lexicon (words and word beginnings that toxic documents hold far more often) comes from the labelled documents that
may be learnt from. These are dealt into folds, and each fold is measured with the lexicon of the others, so that no
document vouches for its own words; the last fold calibrates trees that the others grew.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import is_held_out, materialize

#: Labelled rows that all fits together use at most, those with the least hash of their id.
FIT_ROWS = 12_000
#: Terms in the lexicon at most, those with the highest log-odds.
LEXICON = 5_000
FOLDS = 4
#: Letters of the word beginnings that the lexicon may hold.
STEMS = (4, 5, 6, 7)
LEAST_ODDS, LEAST_DOCS, LEAST_Z = 1.5, 3, 4.5
NEAR = 10  # words between a term and a second-person pronoun
WORDS_KEPT = 500_000
# fixed values: second-person pronouns of the four languages
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deinem ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestra vuestro".split())
# fixed values: characters written for letters
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"\b[^\W\d_]+(?:[0-9@$!*._-]+[^\W\d_]+)+")
NAMES = ("word_density", "stem_density", "distinct_share", "most_repeated", "near_you", "you_density", "capitals", "capital_words", "exclamations", "punctuation", "symbols", "disguised", "disguised_hits", "log_words")


def terms(text: str) -> set[str]:
    """The distinct words of a text, and their beginnings marked with a hyphen."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:k]}-" for w in words for k in STEMS if len(w) > k}


def learn_lexicons(labelled: DataFrame) -> dict[int | None, dict[str, float]]:
    """Term -> smoothed log-odds of toxic over other documents, from all rows (None) and without each fold.

    Each lexicon is chosen and weighed by its own folds only. ``labelled``: (text, toxic, fold).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, int, int]] = Counter()
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                counts.update((t, fold, label) for t in terms(text or ""))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["term", "fold", "toxic", "n"])

    label, fold = F.col("toxic") == 1, F.col("fold")
    sizes = labelled.groupBy().agg(*(F.count_if((fold == f) & (label if t else ~label)).alias(f"{t}_{f}") for f in range(FOLDS) for t in (0, 1))).first()
    counts = labelled.select("text", "toxic", "fold").mapInArrow(run, "term string, fold int, toxic int, n long")
    cells = [F.coalesce(F.sum(F.when((fold == f) & (F.col("toxic") == t), F.col("n"))), F.lit(0)).alias(f"{t}_{f}") for f in range(FOLDS) for t in (0, 1)]
    found = materialize(counts.groupBy("term").agg(*cells), "terms")
    out: dict[int | None, dict[str, float]] = {}
    for left_out in (None, *range(FOLDS)):
        used = [f for f in range(FOLDS) if f != left_out]
        others, toxic = (sum(sizes[f"{t}_{f}"] for f in used) for t in (0, 1))
        c0, c1 = (sum(F.col(f"{t}_{f}") for f in used) for t in (0, 1))
        expected = (c0 + c1) * (toxic / max(2, others + toxic))
        odds = F.log((c1 + 0.5) / (toxic + 1)) - F.log((c0 + 0.5) / (others + 1))
        chosen = found.filter((c1 >= least_docs(others, toxic)) & (c1 - expected >= LEAST_Z * F.sqrt(expected))).select("term", odds.alias("odds")).filter(F.col("odds") >= LEAST_ODDS)
        out[left_out] = {r["term"]: r["odds"] for r in chosen.orderBy(F.desc("odds"), "term").limit(LEXICON).collect()}
    return out


def least_docs(others: int, toxic: int) -> int:
    """How many toxic documents must hold a term: more where many documents make chance finds likely."""
    n = max(2, others + toxic)
    return max(LEAST_DOCS, math.ceil(math.log(10 * n) / -math.log(min(0.5, max(toxic, 1) / n))))


class Scanner:
    """Features of texts; remembers for each word how it stands to the lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.kept = lexicon, {}

    def kind(self, word: str) -> tuple[float, float, bool]:
        """Log-odds of the word, of its best known beginning (0: none), and whether it is a second-person pronoun."""
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) > WORDS_KEPT:
                self.kept.clear()
            stem = max((self.lexicon.get(f"{word[:k]}-", 0.0) for k in STEMS if len(word) > k), default=0.0)
            found = self.kept[word] = (self.lexicon.get(word, 0.0), stem, word in SECOND_PERSON)
        return found

    def __call__(self, text: str) -> list[float]:
        lower = text.lower()
        words = WORD.findall(lower)
        n = max(1, len(words))
        counts = Counter(words)
        hits, weighed, stems, you = {}, 0.0, 0.0, 0
        for word, count in counts.items():
            odds, stem, second = self.kind(word)
            if odds or stem:
                hits[word] = count
                weighed += odds * count
                stems += stem * count
            you += second * count
        near = 0
        if hits and you:
            places = np.array([i for i, w in enumerate(words) if self.kind(w)[2]])
            at = np.array([i for i, w in enumerate(words) if w in hits])
            after = np.searchsorted(places, at)
            gap = np.minimum(np.abs(places[np.minimum(after, len(places) - 1)] - at), np.abs(at - places[np.maximum(after - 1, 0)]))
            near = int((gap <= NEAR).sum())
        raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        size = max(1, int(raw.sum()))
        capitals = int(raw[65:91].sum())
        shouted = sum(1 for w in WORD.findall(text) if len(w) > 2 and w.isupper()) if capitals > 3 else 0
        odd = DISGUISED.findall(lower)
        revealed = sum(1 for w in odd if any(self.kind(w.translate(DISGUISE))[:2]))
        return [
            weighed / n,
            stems / n,
            len(hits) / max(1, len(counts)),
            float(max(hits.values(), default=0)),
            near / n,
            you / n,
            capitals / size,
            shouted / n,
            int(raw[33]) / size,
            int(raw[[34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()) / size,
            int(raw[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 124, 126]].sum()) / size,
            len(odd) / n,
            revealed / n,
            math.log1p(len(words)),
        ]


def measured(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` (text and others) with the features in place of the text."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(lexicon)
        for batch in batches:
            rows = np.array([scan(x.as_py() if x.is_valid else "") for x in batch.column("text")], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array(rows[:, i]) for i in range(len(NAMES)))], [*others, *NAMES])

    kinds = dict(docs.dtypes)
    return docs.select(*others, "text").mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in others] + [f"{x} double" for x in NAMES]))


def fit_trees(rows: DataFrame, seed: int = 1):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    put = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    trees = GBTClassifier(labelCol="toxic", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=2, seed=seed, cacheNodeIds=False)
    return put, trees.fit(put.transform(rows).select("features", F.col("toxic").cast("double").alias("toxic")))


def raw_score(put, model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(put.transform(rows)).withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def calibrated(raw: F.Column, boundaries: list[float], predictions: list[float]) -> F.Column:
    """Linear between the points of an isotonic fit, constant beyond."""
    knots = list(zip(boundaries, predictions, strict=True))
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        line = F.lit(float(y0)) if x1 == x0 else F.lit(float(y0)) + (raw - x0) * float((y1 - y0) / (x1 - x0))
        out = F.when(raw < x1, line).otherwise(out)
    return F.when(raw <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document, over whole texts.

    Null texts are scored as empty ones. Rows that repeat an id are scored each by itself. Labels that are null or belong to
    no document are ignored; where the labels that may be learnt from hold one class only, every score is 0 or 1
    accordingly, and without any it is 0. An empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "sample")
    fold = (F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % FOLDS).cast("int")
    rows = materialize(plain.join(sample, "doc_id").withColumn("fold", fold), "labelled")
    sizes = {(r["last"], r["toxic"]): r["n"] for r in rows.groupBy((F.col("fold") == FOLDS - 1).alias("last"), "toxic").agg(F.count("*").alias("n")).collect()}
    classes = {toxic for _, toxic in sizes}
    held = is_held_out("doc_id")
    if len(classes) < 2:
        constant = float(max(classes, default=0))
        return plain.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.lit(constant).alias("score"), F.lit(int(constant >= threshold)).alias("predicted"))
    lexicons = learn_lexicons(rows)
    seen = reduce(DataFrame.unionByName, (measured(rows.filter(F.col("fold") == f), lexicons[f]) for f in range(FOLDS)))
    seen = materialize(seen, "features")
    split = all(sizes.get((last, c), 0) >= 5 for last in (True, False) for c in (0, 1))
    put, model = fit_trees(seen.filter(F.col("fold") < FOLDS - 1) if split else seen)
    for_curve = seen.filter(F.col("fold") == FOLDS - 1) if split else seen
    from pyspark.ml.regression import IsotonicRegression

    curve = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(raw_score(put, model, for_curve).select(F.col("toxic").cast("double").alias("toxic"), "raw"))
    boundaries, predictions = list(curve.boundaries), list(curve.predictions)
    scored = raw_score(put, model, measured(plain, lexicons[None]))
    score = F.least(F.greatest(calibrated(F.col("raw"), boundaries, predictions), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
