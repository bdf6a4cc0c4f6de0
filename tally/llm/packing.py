"""Concatenate and cut: documents as token ids, laid end to end and cut into windows of fixed length.

Pass 1 tokenizes once: each task writes its documents' ids with their start inside the task and the task's number. Pass 2
adds the prefix sums of the tasks' token totals, so that each document knows its global offset without any task seeing
more than its own rows, and cuts at window borders. A document that crosses a border leaves one record in each window.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.llm.common import materialize

#: Words whose ids a worker keeps at hand, also from task to task; the memory starts anew when it is full.
WORDS_KEPT = 800_000
#: Offsets (of 16 bytes) that are broadcast at most; with more tasks than these, Spark joins by shuffle.
MOST_BROADCAST = 1_000_000
#: A space that more white space or the end follows: no border between chunks.
AMBIGUOUS = re.compile(r" (?:\s|\Z)")
# fixed value: how byte-level BPE cuts a text into pieces
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked(path: str):
    """The tokenizer of a byte-level BPE file as an encoder by ranks, which takes short words several times faster.

    None unless the file is of that kind and its ids rise with its merges, so that both give the same ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or min(ids) < 256:
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, "ChunkEncoder"] = {}


def encoder_for(path: str) -> "ChunkEncoder":
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def id_kind(largest: int) -> str:
    """Ids travel as two bytes where all fit, else as four."""
    return "<u2" if largest < 1 << 16 else "<u4"


class ChunkEncoder:
    """Ids of whole texts by a byte-level BPE file, each word with its leading space encoded once per task.

    Such a tokenizer never merges across the border before a space that is followed by something else than white space,
    so a text is the concatenation of its chunks. Texts with runs of white space or with the special token's string go
    to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        self.ranked = ranked(path)
        self.kind = id_kind(max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    @staticmethod
    def chunks(text: str) -> list[str] | None:
        """None where the text can't be cut at its single spaces."""
        if AMBIGUOUS.search(text):
            return None
        head, *rest = text.split(" ")
        return [head] * bool(head) + [" " + x for x in rest]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of ``kind``."""
        kept = self.kept
        cut = [None if any(s in t for s in self.special) else self.chunks(t) for t in texts]
        if len(kept) > WORDS_KEPT:
            kept.clear()
        new = list({c for parts in cut if parts for c in parts if c not in kept})
        if self.ranked:
            one = self.ranked.encode_ordinary
            kept.update((c, np.array(one(c), dtype=self.kind).tobytes()) for c in new)
        else:
            for at in range(0, len(new), 50_000):
                some = new[at : at + 50_000]
                kept.update(zip(some, self._whole(some), strict=True))
        return [self._whole([t])[0] if parts is None else b"".join(map(kept.__getitem__, parts)) for t, parts in zip(texts, cut, strict=True)]


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """(doc_id, part, start_in_part, n_tokens, ids): the ids of each document with ``end_id`` after them, little-endian, of two
    or four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, encoder = TaskContext.get().partitionId(), 0, encoder_for(tokenizer)
        kind = max(encoder.kind, id_kind(end_id))
        end, width = np.array([end_id], dtype=kind).tobytes(), np.dtype(kind).itemsize
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for low in range(0, batch.num_rows, 500):
                some = [t or "" for t in texts.slice(low, 500).to_pylist()]
                ids = encoder.encode(some)
                if kind != encoder.kind:
                    ids = [np.frombuffer(x, encoder.kind).astype(kind).tobytes() for x in ids]
                ids = [x + end for x in ids]
                counts = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [ids_col.slice(low, 500), pa.array([part] * len(ids), pa.int64()), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, part long, start_in_part long, n_tokens long, ids binary")


def cut(tokens: DataFrame, window: int) -> DataFrame:
    """Pieces of ``tokens`` (with their global ``at``): one row for each window that a document touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            first, last = at // window, (at + n - 1) // window
            row = np.repeat(np.arange(len(n)), last - first + 1)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
            low, high = np.maximum(seq * window, at[row]), np.minimum((seq + 1) * window, (at + n)[row])
            start, length = low - at[row], high - low
            raw = batch.column("ids").to_pylist()
            wide = [len(x) // k for x, k in zip(raw, n.tolist(), strict=True)]  # bytes of an id
            crc = [zlib.crc32(np.frombuffer(raw[r], f"<u{wide[r]}", int(k), wide[r] * int(s)).astype("<u4").tobytes()) for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(low - seq * window)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return tokens.select("doc_id", "at", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Pack all documents into windows of ``window`` ids; only the last window needs padding.

    The order is that of the input's partitions. Null and empty texts hold the end id alone; repeated ids and rows are
    separate documents (a null id stays null); a long text gives a piece for each window that it touches; an empty table
    gives no rows; other columns are ignored.
    """
    tokens = materialize(tokenize(docs, tokenizer, id_col, text_col, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    offsets = materialize(totals.withColumn("before", F.sum("total").over(W.orderBy("part")) - F.col("total")).select("part", "before"), "offsets")
    if offsets.count() <= MOST_BROADCAST:  # one row for each task of pass 1, so the ids stay where they are
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, "part").withColumn("at", F.col("before") + F.col("start_in_part"))
    return cut(placed, window)
