"""Periodic runs of words: stretches in which a short sequence of words follows itself four times or more.

By a dictionary of basic factors. For each power of two L, the factors of L words get ranks, equal ones the same; where a
factor's next two occurrences lie at equal gaps of at most 2 L, they are an arithmetic progression and propose the gap as a
period. A run of period q and at least 4 q words holds such a progression at the level with q <= L < 2 q, where equal factors
lie exactly q apart. Proposals are extended to both sides by the same dictionary (largest factors first), and doubles go.

The texts of a batch are searched together: a word's first rank carries its text, so factors of two texts are never equal.
Only factors that occur twice go on to the next level, so a level costs what still repeats there. One narrow pass, no shuffle;
a task holds some megabytes of text, or one text, and four bytes a word for each level that something repeats at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import string_chunks

#: What makes a run: so many periods, and so many words. The search relies on four periods or more.
PERIODS, LEAST_WORDS = 4, 6

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def proposals(at: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, gap) where the next two occurrences of a factor are equally far, one for a row of neighbours of one gap.

    ``at`` are positions ordered by their ``rank``, then ascending.
    """
    gap = np.diff(at)
    near = (rank[1:] == rank[:-1]) & (gap <= 2 * width)
    even = np.flatnonzero(near[:-1] & near[1:] & (gap[:-1] == gap[1:]))
    i, q = at[even], gap[even]
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    head = np.ones(len(i), bool)
    head[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)
    return i[head], q[head]


def dictionary(first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ranks of the factors of 1, 2, 4 ... words at each position (0: occurs once), and the proposed (position, period)."""
    n, levels, found, width = len(first), [], [], 1
    at, key = np.arange(n), first
    while len(at):
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank = np.cumsum(new)
        twice = ~(new & np.append(new[1:], True))
        at, rank = at[twice], rank[twice]
        ranks = np.zeros(n + 1, np.int32)
        ranks[at] = rank
        levels.append(ranks)
        found.append(proposals(at, rank, width))
        at = np.sort(at)
        at = at[at + width < n]
        at = at[ranks[at + width] > 0]
        key = ranks[at].astype(np.int64) * (n + 1) + ranks[at + width]
        width *= 2
    if not found:
        return levels, at, at
    return levels, np.concatenate([i for i, _ in found]), np.concatenate([q for _, q in found])


def runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run in a sequence of numbers, by start, then period."""
    levels, i, q = dictionary(first)
    ahead, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ranks = levels[k]
        one = ranks[i + ahead]
        ahead += ((one == ranks[i + q + ahead]) & (one > 0)).astype(np.int64) << k
        left = i - back - (1 << k)
        one = np.where(left >= 0, ranks[np.maximum(left, 0)], 0)
        back += ((one == ranks[np.maximum(left, 0) + q]) & (one > 0)).astype(np.int64) << k
    start, length = i - back, back + ahead + q
    long = length >= np.maximum(LEAST_WORDS, PERIODS * q)
    if not long.any():
        return (np.zeros(0, np.int64),) * 3
    found = np.unique(np.stack([start[long], q[long], length[long]], 1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def search(texts: list[list[bytes]]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """For several texts as words: (offsets of the texts, runs by word number of all texts, words that a run repeats)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for text in texts for w in text), np.int64, int(sizes.sum()))
    start, length, period = runs(np.repeat(np.arange(len(texts)), sizes) * max(1, len(number)) + words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return ends - sizes, (start, length, period), np.cumsum(edge)[:-1] > 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per input row.

    ``runs`` is an array of (start, length, period) in words (numbered from 0), by start, then period; ``collapsed`` the
    words joined by one space without those that a run holds after its first period. Words are cut at ASCII white space;
    ``prepare`` may change a text's words (given its id) before the search.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Null and repeated ids are rows of their
    own, an empty table gives no rows, other columns are ignored. Texts are taken whole, each by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in string_chunks(batch.column(1)):
                texts = [raw.split() for _, raw in chunk]  # bytes.split() cuts at the six ASCII white spaces only
                if prepare:
                    texts = [prepare(ids[row].as_py(), words) for (row, _), words in zip(chunk, texts, strict=True)]
                offsets, (start, length, period), repeated = search(texts)
                owner = np.searchsorted(offsets, start, "right") - 1 if len(start) else start
                at = np.searchsorted(owner, np.arange(len(texts) + 1))
                collapsed = []
                for text, offset in zip(texts, offsets.tolist(), strict=True):
                    gone = repeated[offset : offset + len(text)]
                    collapsed.append(b" ".join([w for w, r in zip(text, gone.tolist(), strict=True) if not r] if gone.any() else text))
                spans = pa.StructArray.from_arrays([pa.array(start - offsets[owner]), pa.array(length), pa.array(period)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(chunk[0][0], len(chunk)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The rows of :func:`find_runs` with the longest run (ties: first start, then period) and hashes in place of the lists."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumn("longest", longest)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
