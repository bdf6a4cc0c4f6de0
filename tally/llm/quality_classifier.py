"""Quality classifier: ordinal regression with a cumulative link.

One weight vector over hashed text features gives a score; ordered thresholds cut it into grades:
P(grade <= j) = sigmoid(threshold_j - score). Expected grade and tail probability come from the same few numbers.
Grades of the labels: 0 poor, 1 good but toxic, 2 good.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import fresh, is_held_out

BUCKETS = 1 << 18
#: The highest grade, which every document has where there are no labels.
BEST = 2
#: Labelled rows that the fit uses at most, one for an id: those with the least hash of their id.
FIT_ROWS = 6_000
WORDS_KEPT = 500_000
SHAPES = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "0")]


def slots(token: str) -> tuple[int, int]:
    """The buckets of a token's lower-case form and of its shape."""
    shape = token
    for pattern, sign in SHAPES:
        shape = pattern.sub(sign, shape)
    return zlib.crc32(token.lower().encode()) % BUCKETS, zlib.crc32(b"shape " + shape.encode()) % BUCKETS


def whole_slots(tokens: list[str]) -> tuple[int, int]:
    """The buckets of a text's length and of how often a token repeats the one before it."""
    stutter = 10 * sum(map(eq, tokens, tokens[1:])) // max(1, len(tokens))
    return zlib.crc32(b"length %d" % min(len(tokens).bit_length(), 8)) % BUCKETS, zlib.crc32(b"stutter %d" % stutter) % BUCKETS


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shares of the text's tokens, and two buckets for the whole."""
    tokens = text.split()
    found: Counter[int] = Counter()
    for token, n in Counter(tokens).items():
        for slot in slots(token):
            found[slot] += n / len(tokens)
    for slot in whole_slots(tokens):
        found[slot] += 1.0
    return np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found))


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray
    low: int

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > low + j) for each score and cut j."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))

    def above(self, score: np.ndarray, grade: int) -> np.ndarray:
        """P(grade > ``grade``): certain outside the grades of the labels."""
        at = grade - self.low
        if at < 0 or at >= len(self.cuts):
            return np.full(len(score), float(at < 0))
        return self.tails(score)[:, at]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.3, ridge: float = 1e-5) -> Model:
    """Maximum likelihood of (grade, buckets, values), full gradients with Adam steps; cuts stay ordered by construction."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), np.empty(0), BEST)
    grade = np.array([r[0] for r in rows])
    low, levels = int(grade.min()), int(grade.max() - grade.min())
    if not levels:  # one grade only: nothing to tell apart
        return Model(np.zeros(BUCKETS, np.float32), np.empty(0), low)
    grade = grade - low
    used, column = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    value = np.concatenate([r[2] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    theta = np.zeros(len(used) + levels)  # weights, first cut, logs of the gaps
    first, second, n = np.zeros_like(theta), np.zeros_like(theta), len(rows)
    for step in range(1, steps + 1):
        w, gaps = theta[: len(used)], np.exp(theta[len(used) + 1 :])
        cuts = theta[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, value * w[column], n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            upper, lower = (1 / (1 + np.exp(score - edge[grade + k])) for k in (1, 0))
        mass = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        slope = np.zeros_like(theta)
        slope[: len(used)] = np.bincount(column, value * ((d_upper - d_lower)[row]), len(used)) / n + ridge * w
        by_cut = np.array([(d_lower[grade == j + 1].sum() - d_upper[grade == j].sum()) / n for j in range(levels)])
        slope[len(used)] = by_cut.sum()
        slope[len(used) + 1 :] = [by_cut[j:].sum() * gaps[j - 1] for j in range(1, levels)]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = theta[: len(used)]
    return Model(weights, theta[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(theta[len(used) + 1 :]))]), low)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on at most ``fit_rows`` labelled documents that are not held out; of rows that share an id, on the one with the least hash."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    graded = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id")).groupBy("doc_id").agg(F.min(grade).alias("grade"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(sample, "doc_id")
    joined = joined.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.float32()))], ["doc_id", "grade", "slot", "value"])

    found = joined.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, slot array<int>, value array<float>").toArrow()
    rows = sorted(zip(found.column("doc_id").to_pylist(), found.column("grade").to_pylist(), range(found.num_rows), strict=True))
    slot, value = found.column("slot").combine_chunks(), found.column("value").combine_chunks()
    return fit([(grade, slot[i].values.to_numpy(), value[i].values.to_numpy()) for _, grade, i in rows])


def score(docs: DataFrame, model: Model, text_col: str = "text", cut: int = 0, least: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of a grade above ``cut``) and accepted (it reaches ``least``).

    Null and empty texts are scored as texts without tokens. Clashing column names get underscores before ours.
    """
    names = [fresh(docs, x) for x in ("expected_grade", "tail_probability")]

    @F.pandas_udf("expected double, tail double")
    def judged(texts):
        import pandas as pd

        kept: dict[str, float] = {}
        scores = []
        for text in texts:
            tokens = text.split() if isinstance(text, str) else []
            if len(kept) > WORDS_KEPT:
                kept.clear()
            for token in set(tokens).difference(kept):
                one, two = slots(token)
                kept[token] = float(model.weights[one] + model.weights[two])
            of_tokens = sum(map(kept.__getitem__, tokens)) / len(tokens) if tokens else 0.0
            scores.append(of_tokens + sum(float(model.weights[slot]) for slot in whole_slots(tokens)))
        tails = model.tails(np.array(scores, float))
        return pd.DataFrame({"expected": model.low + tails.sum(axis=1), "tail": model.above(np.array(scores, float), cut)})

    held = fresh(docs, "judged")
    out = docs.withColumn(held, judged(F.col(text_col).cast("string")))
    out = out.withColumn(names[0], F.col(held)["expected"]).withColumn(names[1], F.col(held)["tail"]).drop(held)
    return out.withColumn(fresh(docs, "accepted"), F.col(names[1]) >= least)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, accepted), one row per document.

    Trains on labelled documents that are not held out and scores all. Null and empty texts are scored as texts without
    tokens; repeated rows are scored each by itself; a null id is not held out. Labels of one grade give every document that
    grade, and no usable labels the highest; an empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = score(plain, train(docs, labels, id_col, text_col))
    return scored.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", "accepted")


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns, whatever these are called; see classify()."""
    model = train(docs, labels, id_col, text_col)
    scored = score(docs, model, text_col)
    return scored.filter(F.col(fresh(docs, "accepted"))).select(*docs.columns)
