"""Quality rules with thresholds learnt from the data: quantiles per language and source, from mergeable sketches.

One narrow pass measures each text. KLL sketches of the measures, built map-side and merged per (language, source), then
per language and over all documents, give the thresholds; a join brings them back to the measures, and the rules compare.

A group's quantiles are pulled toward those of its language, and these toward all documents', the more so the smaller it is.
A count (symbols, repeated lines, repeated passages) is taken on a logarithmic scale, for a text of typical length or for the
text itself if that is shorter. Its limit lies in the middle of the widest gap of the group's upper quantiles, if that gap is
GAP-fold or more: what most documents have stays on one side, whatever that is in the group, and junk on the other. A group
without such a gap has no limit. The mean length of a word, which no group has at zero, has the outer fence by quartiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import materialize

SYMBOLS = b"#*$%&|<>"
#: Bytes of UTF-8 that begin no code point.
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 8

#: Measure -> (its count, how many of the count come at once).
COUNTS = {"symbols": ("n_symbols", 1), "dup_lines": ("n_dup_lines", 1), "repeats": ("n_repeat_words", 2 * WINDOW)}
#: Ranks of the upper quantiles between which a gap is looked for; junk is never the larger half of a group.
RANKS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 0.995, 1.0)
#: How many times as much the far side of a gap has, counted from one.
GAP = 8.0
#: The fence of a word's mean length, in interquartile ranges, and in deviations of a count of its letters.
SPREAD = 3.0
#: A group of so many documents weighs as much as the level above it.
PULL = 10.0


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    rank = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    width = 1
    while width < window:  # windows of twice the width are pairs of ranks
        step = min(width, window - width)
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        width += step
    twice = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()  # bytes.split() cuts at the six ASCII white spaces only
    joined = sum(map(len, words)) - (len(raw) - len(raw.translate(None, CONTINUATION)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), joined, symbols, len(lines) - len(set(lines)), repeated_words(words)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, group columns, five counts): one narrow pass over the texts."""
    names = [f"key{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            got = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + i) for i in range(len(names))), *(pa.array(got[:, i]) for i in range(5))], ["doc_id", *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(n) for k, n in zip(keys, names, strict=True)))
    return picked.mapInArrow(run, "doc_id long, " + "".join(f"{n} string, " for n in names) + "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def scaled(m: str, typical: float) -> F.Column:
    """The count of measure ``m`` in events, for ``typical`` words or for the text's own if these are fewer, as log(1 + x)."""
    count, unit = COUNTS[m]
    return F.log1p(F.col(count) / unit * F.least(F.lit(1.0), typical / F.greatest(F.col("n_words"), F.lit(1))))


def widest_gap(quantiles: F.Column) -> F.Column:
    """The middle of the widest step between neighbouring quantiles (on the logarithmic scale), null if it isn't GAP-fold."""
    steps = F.transform(F.sequence(F.lit(1), F.size(quantiles) - 1), lambda i: F.struct((F.get(quantiles, i) - F.get(quantiles, i - 1)).alias("step"), ((F.get(quantiles, i) + F.get(quantiles, i - 1)) / 2).alias("middle")))
    widest = F.array_max(steps)
    return F.when(widest["step"] >= math.log(GAP), widest["middle"])


def thresholds(measured: DataFrame, names: list[str], k: int = 200) -> DataFrame:
    """Per group, the limits from KLL sketches of the documents that pass the base rules."""
    kinds = {m: RANKS for m in COUNTS} | {"mean_word": (0.25, 0.5, 0.75)}
    groups = materialize(measured.filter(~F.col("base_failed")).groupBy(*names).agg(*(F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in kinds)), "sketches")

    def level(merged: DataFrame, keys: list[str], stem: str) -> DataFrame:
        quantiles = [F.array(*(F.kll_sketch_get_quantile_double(F.col(m), F.lit(q)) for q in ranks)).alias(f"{stem}_{m}") for m, ranks in kinds.items()]
        held = merged.filter(F.kll_sketch_get_n_double(F.col("mean_word")) > 0)  # the merge of no sketches has no quantiles
        return held.select(*keys, F.kll_sketch_get_n_double(F.col("mean_word")).cast("double").alias(f"{stem}_n"), *quantiles)

    merged = [F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in kinds]
    parents = level(groups.groupBy(names[0]).agg(*merged), names[:1], "parent")
    whole = level(groups.agg(*merged), [], "whole")
    levels = level(groups, names, "own").join(parents, names[0]).crossJoin(F.broadcast(whole))  # a single row
    pull = lambda own, n, above: F.zip_with(own, above, lambda x, y: (F.col(n) * x + PULL * y) / (F.col(n) + PULL))
    for m in kinds:
        levels = levels.withColumn(f"parent_{m}", pull(F.col(f"parent_{m}"), "parent_n", F.col(f"whole_{m}")))
        levels = levels.withColumn(f"own_{m}", pull(F.col(f"own_{m}"), "own_n", F.col(f"parent_{m}")))

    def fence(sign: int) -> F.Column:
        """The limit of the mean length of a word: the upper one for ``sign`` 1, the lower one for -1.

        It is the outer fence by the middle one of the three levels, so that junk in a quarter of a group doesn't carry the
        limit off, or what the group's other half reaches if that is more.
        """
        at = lambda stem, i: F.col(f"{stem}_mean_word")[1 + sign * i]
        reach = lambda stem: sign * (at(stem, 1) - at(stem, 0)) + SPREAD * sign * (at(stem, 1) - at(stem, -1))
        middle = F.array_sort(F.array(*map(reach, ("own", "parent", "whole"))))[1]
        other = (1 + 2 * SPREAD) * sign * (at("own", 0) - at("own", -1))  # the fence, were the halves alike
        return at("own", 0) + sign * F.greatest(middle, other)

    return levels.select(*names, *(widest_gap(F.col(f"own_{m}")).alias(f"limit_{m}") for m in COUNTS), fence(1).alias("longest_word"), fence(-1).alias("shortest_word"))


def odd_words(limit: str, sign: int) -> F.Column:
    """Whether the letters of a text lie beyond ``limit`` a word, by more than SPREAD deviations of such a count."""
    expected = F.greatest(F.col(limit), F.lit(0.0)) * F.col("n_words")
    return sign * (F.col("word_chars") - expected) > SPREAD * F.sqrt(F.greatest(expected, F.lit(1.0)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept``.

    Null texts count as empty and fail the base rules, null group values are a group of their own, rows that share an id
    are judged each by itself, an empty table gives no rows, other columns are ignored. A group without a document that
    passes the base rules has no limits and nothing left to judge.
    """
    names = [f"key{i}" for i in range(len(keys))]
    measured = materialize(measures(docs, id_col, text_col, keys).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))), "measures")
    # a single number: half of the documents that pass the base rules have fewer words
    typical = measured.filter(~F.col("base_failed")).agg(F.percentile_approx("n_words", 0.5).cast("double")).first()[0]
    scales = measured.withColumns({m: scaled(m, typical or 1.0) for m in COUNTS}).withColumn("mean_word", F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)))
    # as many rows as there are groups; Spark broadcasts the written table only where its size allows
    limits = materialize(thresholds(scales, names), "limits")
    joined = scales.join(limits, names, "left")
    fails = [F.col(m) > F.col(f"limit_{m}") for m in COUNTS] + [odd_words("longest_word", 1), odd_words("shortest_word", -1)]
    verdict = ~F.greatest(*(F.coalesce(x, F.lit(False)) for x in fails))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"))
