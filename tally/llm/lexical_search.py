"""Ranked lexical search: the best documents for each item, by the Best Position Algorithm over impact lists.

One narrow pass counts the items' terms in each text; the written postings give the corpus statistics (a grouped count) and
are then searched where they lie. A task takes blocks of documents and builds, for each term, the list of the block's
documents by falling impact, and a table for direct accesses. For an item it reads on in all its lists at once from their
best positions (up to which every document has been seen, in whatever list), looks new documents up in the other lists, and
moves the best positions on. It stops when the scores at the best positions add up to strictly less than the k-th score found
so far by the task, so that no document is lost, ties included. A task sends k rows for each item on; the rest is a window.

Items are searched in groups whose distinct (item, term) pairs are bounded; each group is a pass over the documents. What a
task holds is one group's terms and a block of documents, whose size falls as the terms grow.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import NULL_ID, materialize

#: Pairs of item and term that one pass serves, about; more items go in further passes.
PAIRS = 100_000
#: Cells (documents x terms) of a block's table.
CELLS = 16_000_000

#: Letters and digits stay (A-Z in lower case), as do the bytes of other characters than ASCII; the rest separates.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(LETTERS).split()


def _raw(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


@dataclass
class Items:
    """A group of items: the numbers of their terms and how often each occurs."""

    ids: list[int | None]
    number: dict[bytes, int]
    columns: list[np.ndarray]
    repeats: list[np.ndarray]


def asked_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, repeats); rows that share an id are one item with the terms of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(terms(_raw(text)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item_id", "term", "repeats"])

    picked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "item_id long, term binary, repeats long").groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def load_items(asked: DataFrame) -> Items:
    """One group of items; its size is what :func:`search` bounds."""
    found: dict = {}
    for item, term, repeats in zip(*(column.to_pylist() for column in asked.toArrow().columns), strict=True):
        found.setdefault(item, {})[bytes(term)] = repeats
    number = {t: i for i, t in enumerate(sorted({t for own in found.values() for t in own}))}
    return Items(list(found), number, [np.array([number[t] for t in own], np.int64) for own in found.values()], [np.array(list(own.values()), np.int64) for own in found.values()])


def postings(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every text with a term: how many it has, and the asked ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, found, counts, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column(1)):
                words = terms(_raw(text))
                if not words:
                    continue
                own = [(number[t], n) for t, n in Counter(words).items() if t in number]
                rows.append(row)
                sizes.append(len(words))
                found.extend(i for i, _ in own)
                counts.extend(n for _, n in own)
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Block:
    """Impact lists and direct accesses of some documents."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        self.table = np.zeros((n_docs, n_terms), np.int32)
        self.table[owner, term] = impact
        order = np.lexsort((-impact, term))
        self.docs, self.impact = owner[order], impact[order]
        self.edges = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.read = 0

    def best(self, columns: np.ndarray, factor: np.ndarray, k: int, held: np.ndarray, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that can be among the k best, beside the scores ``held`` already."""
        here = (self.edges[columns] < self.edges[columns + 1]) & (factor > 0)
        columns, factor = columns[here], factor[here]
        at, end = self.edges[columns], self.edges[columns + 1]  # the first position of each list that isn't known to be seen
        seen = np.zeros(len(self.table), bool)
        top, docs, scores = np.sort(held)[-k:], [], []
        # float64 is exact below 2^53, and has the faster product
        weigh = factor.astype(np.float64) if float(factor.sum()) * self.impact.max(initial=0) < 2**53 else factor
        while (at < end).any():
            reach = at[:, None] + np.arange(width)
            next_docs = self.docs[reach[reach < end[:, None]]]
            new = np.unique(next_docs[~seen[next_docs]])
            seen[new] = True
            self.read += len(new)
            score = (self.table[new[:, None], columns] @ weigh).astype(np.int64)
            docs.append(new)
            scores.append(score)
            top = np.sort(np.concatenate([top, score[score > 0]]))[-k:]
            moving = np.flatnonzero(at < end)
            while len(moving):  # best positions pass all that has been seen
                ahead = at[moving][:, None] + np.arange(width)
                open_ = (ahead >= end[moving][:, None]) | ~seen[self.docs[np.minimum(ahead, len(self.docs) - 1)]]
                step = np.where(open_.any(axis=1), open_.argmax(axis=1), width)
                at[moving] += step
                moving = moving[step == width]
            left = at < end
            if len(top) == k and int((factor[left] * self.impact[at[left] - 1]).sum()) < top[0]:
                break
            width = min(2 * width, 1024)
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = scores >= (max(1, top[0]) if len(top) == k else 1)
        return docs[good], scores[good]


def length_share(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m: 25, and 75 for each average length."""
    return np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)


def rank_blocks(found: DataFrame, items: Items, n_docs: int, n_terms: int, weights: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best ``k`` of each task."""
    columns, factors, ids, n_columns = items.columns, [weights[c] * r for c, r in zip(items.columns, items.repeats, strict=True)], items.ids, len(items.number)
    most_docs = max(64, CELLS // max(1, n_columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]  # ids and scores
        for whole in batches:
            for first in range(0, whole.num_rows, most_docs):
                batch = whole.slice(first, most_docs)
                doc_ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                share = length_share(batch.column("n").to_numpy(zero_copy_only=False), n_docs, n_terms)
                sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(doc_ids)), sizes)
                term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts"))
                block = Block(owner, term, 1_000_000_000 * tf // (1000 * tf + 8 * share[owner]), len(doc_ids), n_columns)
                for i, (c, f) in enumerate(zip(columns, factors, strict=True)):
                    docs, scores = block.best(c, f, k, best[i][1])
                    if len(docs):
                        docs, scores = np.concatenate([best[i][0], doc_ids[docs]]), np.concatenate([best[i][1], scores])
                        order = np.lexsort((docs, docs == NULL_ID, -scores))[:k]
                        best[i] = docs[order], scores[order]
        item = [x for x, (docs, _) in zip(ids, best, strict=True) for _ in docs]
        docs, scores = (np.concatenate([b[j] for b in best] or [np.zeros(0, np.int64)]) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(docs, pa.int64(), mask=docs == NULL_ID), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    return found.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of highest score above 0, equal ones by ascending id.

    Scores are sums over the item's terms, repeats included, of whole numbers: a term's weight floor(1000 ln((2 N + 2) /
    (2 df + 1))) times 10^9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L; N counts documents with a term, L all their terms.

    Null and empty texts have no terms: as documents they count nowhere, as items they get no rows. Items that share an id
    (a null one too) are one item with all their terms. Documents that share an id are ranked each by itself; those with a
    null id come after others of their score. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = materialize(asked_terms(items, item_id, item_text), "asked")
    groups = max(1, math.ceil(asked.count() / PAIRS))
    parts = []
    for group in range(groups):
        own = load_items(asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group))
        if not own.ids:
            continue
        found = materialize(postings(docs, own.number, doc_id, doc_text), "postings")
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holders = np.zeros(len(own.number), np.int64)
        counted = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row for a term of the group
        holders[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)
        parts.append(materialize(rank_blocks(found, own, n_docs, n_terms, weights, k), "ranked"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
