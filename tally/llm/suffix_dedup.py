"""Remove byte strings of a given length that occur more than once, by a depth-limited radix sort of suffixes.

Suffixes are ordered only as deep as the threshold, in passes from the most significant digit on, and a group of one leaves
the sort at once. The order of the digits is fixed by an anchor, the leftmost position of a window whose hash is the least:
equal windows have their anchor at the same place, so about one position in eighty stands for the windows around it.

1. The first digit is the anchor's gram, ``ANCHOR`` bytes. Grams that occur once leave.
2. A reach that occurs again as a whole (all bytes of the windows that the anchor stands for) is repeated throughout and is
   done; one member of it stays for the comparison with others.
3. The other reaches of a gram go on. A window has some of its remaining bytes before the gram and some behind it. The range
   of that number is cut into parts, and each part's next digit holds the bytes that all its windows share; parts are cut on
   until one window is left, whose groups of two or more are exactly the repeated windows. Spark does these passes for grams
   of very many reaches; groups of at most ``GROUP`` (some 7 MB) are sorted inside a task.

Grams and whole reaches are told apart by 64-bit hashes (both must agree), all later digits by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import NULL_ID, fresh, materialize, mix64

ANCHOR = 40
#: Bytes that a task sorts through at once; longer texts go in overlapping segments.
SEGMENT = 500_000
#: Members of a group that a task sorts by itself; Spark passes on the larger ones.
GROUP = 20_000
#: Parts into which one pass of Spark cuts a range of windows.
PARTS = 4
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Prefix:
    """Hashes of any substring of a buffer, from one prefix sum."""

    powers = _powers(1)

    def __init__(self, data: np.ndarray):
        if len(Prefix.powers[0]) <= len(data):
            Prefix.powers = _powers(2 * len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * Prefix.powers[0][: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * Prefix.powers[1][start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mix64((self.sums[length:] - self.sums[:n]) * Prefix.powers[1][:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n, pad = len(x), -len(x) % width
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """Of texts laid end to end (``ends``: where each ends): the anchors' positions, their hashes, and the stretch from the
    first to the end of the last window that each stands for.

    A window's anchor is the leftmost of its least grams, so each window has one, and the windows of one lie together.
    """
    prefix = Prefix(data)
    width = length - ANCHOR + 1
    grams = prefix.every(ANCHOR)
    if len(grams) < width:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none, prefix
    place = np.uint64(2**32 - 1)
    anchor = (sliding_least((grams & ~place) | np.arange(len(grams), dtype=np.uint64), width) & place).astype(np.int64)
    inside = np.ones(len(anchor), bool)
    starts = np.concatenate([[0], ends[:-1]])
    for at in range(1, len(starts)):  # a window that crosses into the next text counts for nothing
        inside[max(starts[at - 1], starts[at] - length + 1) : starts[at]] = False
    window = np.flatnonzero(inside)
    if not len(window):
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none, prefix
    anchor = anchor[window]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(window)) - 1
    at = anchor[first]
    return at, grams[at], window[first], window[last] + length, prefix


def segments(raw: bytes, length: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(base, bytes, first, last): anchors at base+first .. base+last-1 are this segment's; the rest is overlap."""
    if len(raw) <= SEGMENT:
        yield 0, raw, 0, len(raw)
        return
    for at in range(0, len(raw), SEGMENT):
        base = max(0, at - 2 * length)
        yield base, raw[base : at + SEGMENT + 2 * length], at - base, min(at + SEGMENT, len(raw)) - base


def find_anchors(rows: DataFrame, length: int) -> DataFrame:
    """(gram, reach, doc, tag, before, after, pos) of the anchors of ``rows`` (doc, tag, text); equal reaches of one text lie
    in one row, with all their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False)
            pending, size = [], 0
            for row, text in enumerate(batch.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) < length:
                    continue
                for piece in segments(raw, length):
                    pending.append((row, *piece))
                    size += len(piece[1])
                    if size >= SEGMENT:
                        yield flush(pending, docs, tags)
                        pending, size = [], 0
            if pending:
                yield flush(pending, docs, tags)

    def flush(pending, docs, tags) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(x[2] for x in pending), np.uint8)
        ends = np.cumsum([len(x[2]) for x in pending])
        at, gram, low, high, prefix = anchors(data, ends, length)
        piece = np.searchsorted(ends, at, "right")
        start = np.concatenate([[0], ends[:-1]])[piece]
        row, base, first, last = (np.array([x[i] for x in pending], np.int64)[piece] for i in (0, 1, 3, 4))
        own = (at - start >= first) & (at - start < last)
        at, gram, low, high, start, row, base = (x[own] for x in (at, gram, low, high, start, row, base))
        reach = mix64(prefix.hashes(low, high) + (at - low).astype(np.uint64))
        order = np.lexsort((at, reach, gram, row))
        at, gram, low, high, start, row, base, reach = (x[order] for x in (at, gram, low, high, start, row, base, reach))
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (reach[1:] != reach[:-1])
        one = np.flatnonzero(new)
        places = pa.ListArray.from_arrays(pa.array(np.append(one, len(at)).astype(np.int32)), pa.array((at - start + base).astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.array(gram[one].view(np.int64)), pa.array(reach[one].view(np.int64)), pa.array(docs[row[one]]), pa.array(tags[row[one]]), pa.array((at - low)[one].astype(np.int32)), pa.array((high - at)[one].astype(np.int32)), places],
            ["gram", "reach", "doc", "tag", "before", "after", "pos"],
        )

    return rows.select("doc", "tag", "text").mapInArrow(run, "gram long, reach long, doc long, tag long, before int, after int, pos array<long>")


MEMBER = ["gram", "n", "size", "doc", "tag", "pos", "before"]


def fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of MEMBER and ``bytes``: those of each reach, cut from the text that ``wanted`` names."""
    lists = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("gram", "n", "size", "pos", "before", "after")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            flat, counts = batch.column("at").flatten(), pa.compute.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False)
            field = {x.name: flat.field(i) for i, x in enumerate(flat.type)}
            for x in ("doc", "tag"):
                field[x] = batch.column(x).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            pos, before, after = (field[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "before", "after"))
            cuts, at, done = [], 0, 0
            for row, n in enumerate(counts.tolist()):
                raw = expand.decompress(batch.column("z")[row].as_buffer())
                cuts += [raw[pos[i] - before[i] : pos[i] + after[i]] for i in range(at, at + n)]
                at += n
                if len(cuts) >= 5_000 or row == len(counts) - 1:
                    part = slice(done, at)
                    yield pa.RecordBatch.from_arrays([*(field[x][part] for x in MEMBER), pa.array(cuts, pa.binary())], [*MEMBER, "bytes"])
                    cuts, done = [], at

    return texts.join(lists, ["doc", "tag"]).select("doc", "tag", "z", "at").mapInArrow(run, "gram long, n long, size long, doc long, tag long, pos long, before int, bytes binary")


def refined(group: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Group numbers after one more digit: ``digit`` has a row of bytes for each member."""
    keys = np.concatenate([group.astype(">i8")[:, None].view(np.uint8), digit], axis=1)
    return np.unique(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), return_inverse=True)[1].ravel()


def repeated_windows(reaches: list[bytes], before: np.ndarray, group: np.ndarray, low: int, high: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, offset) of the windows that another member of the group has as well.

    ``offset`` counts a window's bytes before the gram, from ``low`` to ``high``; members of a group agree in the ``low`` bytes
    before the gram and in those behind it that all these windows share.
    """
    width = length - ANCHOR
    left, right = (np.zeros((len(reaches), width), np.uint8) for _ in range(2))
    for i, (raw, b) in enumerate(zip(reaches, before.tolist(), strict=True)):
        left[i, :b] = np.frombuffer(raw, np.uint8, b)[::-1]
        right[i, : len(raw) - b - ANCHOR] = np.frombuffer(raw, np.uint8, offset=b + ANCHOR)
    behind = np.array([len(x) for x in reaches]) - before - ANCHOR
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    stack = [(np.arange(len(reaches)), group, low, high)]
    while stack:
        member, group, low, high = stack.pop()
        there = np.maximum(low, width - behind[member]) <= np.minimum(high, before[member])
        member, group = member[there], np.unique(group[there], return_inverse=True)[1].ravel()
        more = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.empty(0, bool)
        member, group = member[more], group[more]
        if not len(member):
            continue
        if low == high:
            found.append((member, np.full(len(member), low)))
            continue
        middle = (low + high) // 2
        for first, last, side, digit in ((low, middle, right, slice(width - high, width - middle)), (middle + 1, high, left, slice(low, middle + 1))):
            fits = np.maximum(first, width - behind[member]) <= np.minimum(last, before[member])
            if fits.any():
                stack.append((member[fits], refined(group[fits], side[member[fits], digit]), first, last))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs(member: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows sorted by (member, start) -> (member, start, end) of the stretches that they cover."""
    if not len(member):
        return member, start, start
    new = np.concatenate([[True], (np.diff(member) != 0) | (np.diff(start) > 1)])
    ends = np.append(np.flatnonzero(new)[1:], len(member)) - 1
    return member[new], start[new], start[ends] + length


SPAN = "doc long, tag long, start long, end long"


def sort_groups(groups: DataFrame, length: int) -> DataFrame:
    """(doc, tag, start, end): stretches of members that stand for themselves (n = 1) whose windows another member of the
    group has; each group (gram, low, high, key) is sorted inside one task."""
    by = ["gram", "low", "high", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        size = 0
        for batch in batches:  # sorted: a group is whole once the next one begins
            for row in zip(*(batch.column(c).to_pylist() for c in (*by, "before", "bytes", "n", "doc", "tag", "pos")), strict=True):
                if kept and size >= 1_000_000 and row[:4] != kept[-1][:4]:
                    yield flush(kept)
                    kept, size = [], 0
                kept.append(row)
                size += len(row[5])
        if kept:
            yield flush(kept)

    def flush(kept: list) -> pa.RecordBatch:
        low, high, before, n, doc, tag, pos = (np.array([x[i] for x in kept], np.int64) for i in (1, 2, 4, 6, 7, 8, 9))
        numbers: dict[tuple, int] = {}
        group = np.array([numbers.setdefault(x[:4], len(numbers)) for x in kept], np.int64)
        who, offset = [], []
        for a, b in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):
            some = np.flatnonzero((low == a) & (high == b))
            member, at = repeated_windows([kept[i][5] for i in some.tolist()], before[some], group[some], a, b, length)
            who.append(some[member])
            offset.append(at)
        who, offset = np.concatenate(who), np.concatenate(offset)
        who, offset = who[n[who] == 1], offset[n[who] == 1]
        order = np.lexsort((-offset, who))
        who, start, end = runs(who[order], -offset[order], length)
        return pa.RecordBatch.from_arrays([pa.array(doc[who]), pa.array(tag[who]), pa.array(pos[who] + start), pa.array(pos[who] + end)], ["doc", "tag", "start", "end"])

    picked = groups.select(*by, "before", "bytes", "n", "doc", "tag", "pos")
    return picked.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, SPAN)


def cut_ranges(groups: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """One pass of Spark over groups (gram, low, high): (groups of the next pass, repeated stretches).

    Each member enters each part of its group's range that it has windows in, cut down to the bytes of these windows.
    Members that are equal there are repeated throughout, and one of them goes on. The bytes that all windows of the part
    share are the digit (``key``) of the next groups; groups of one leave.
    """
    width = length - ANCHOR
    step = F.ceil((F.col("high") - F.col("low") + 1) / PARTS).cast("int")
    parts = F.transform(F.sequence(F.col("low"), F.col("high"), step), lambda x: F.struct(x.alias("low"), F.least(x + step - 1, F.col("high")).alias("high")))
    behind = F.octet_length("bytes") - F.col("before") - ANCHOR
    each = groups.drop("key", "size").withColumn("part", F.explode(parts)).withColumn("low", F.col("part.low")).withColumn("high", F.col("part.high")).drop("part")
    each = each.filter(F.greatest("low", width - behind) <= F.least("high", "before"))
    before = F.least("before", "high")
    clipped = F.substring(F.col("bytes"), F.col("before") - before + 1, before + ANCHOR + F.least(behind, width - F.col("low")))
    each = materialize(each.select("gram", "low", "high", before.alias("before"), clipped.alias("bytes"), "n", "doc", "tag", "pos"), "digits")
    same = ["gram", "low", "high", "before", "bytes"]
    classes = materialize(each.groupBy(*same).agg(F.count("*").alias("c"), F.min(F.struct("n", "doc", "tag", "pos")).alias("x")), "classes")
    start = F.col("pos") - F.col("before")
    repeated = each.filter("n = 1").join(classes.filter("c > 1").select(*same), same).select("doc", "tag", start.alias("start"), (start + F.octet_length("bytes")).alias("end"))
    key = F.substring(F.col("bytes"), F.col("before") - F.col("low") + 1, F.col("low") + ANCHOR + width - F.col("high"))
    rest = classes.filter("low < high").select(*same, key.alias("key"), F.greatest("c", "x.n").alias("n"), "x.doc", "x.tag", "x.pos")
    by = ["gram", "low", "high", "key"]
    return materialize(rest.join(rest.groupBy(*by).agg(F.count("*").alias("size")).filter("size > 1"), by), "groups"), repeated


def sort_all(reaches: DataFrame, length: int) -> DataFrame:
    """(doc, tag, start, end) as sort_groups, for groups of any size: Spark passes on those beyond GROUP until they are small."""
    groups = reaches.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - ANCHOR)).withColumn("key", F.lit(b""))
    found = sort_groups(groups.filter(F.col("size") <= GROUP), length)
    wide = groups.filter(F.col("size") > GROUP)
    while not wide.isEmpty():
        groups, repeated = cut_ranges(wide, length)
        found = found.unionByName(repeated).unionByName(sort_groups(groups.filter(F.col("size") <= GROUP), length))
        wide = groups.filter(F.col("size") > GROUP)
    return found


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, tag, text): (doc, tag) names id and text also where ids are null or repeat."""
    ids, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(ids.alias("id"), F.coalesce(ids, F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def compressed(rows: DataFrame) -> DataFrame:
    """(id, doc, tag, z): texts as zstd, which halves what the joins by document move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                some = batch.slice(low, 1_000)
                z = [squeeze.compress(x.as_buffer() if x.is_valid else b"") for x in some.column("text")]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("doc"), some.column("tag"), pa.array(z, pa.binary())], ["id", "doc", "tag", "z"])

    return rows.select("id", "doc", "tag", "text").mapInArrow(run, "id long, doc long, tag long, z binary")


def repeated_spans(rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(doc, tag, spans): for the ``rows`` of keyed() that hold repeated windows, the stretches that these cover, unmerged.

    ``texts`` are the rows compressed, read from a written table, so that no task runs two Python workers.
    """
    found = materialize(find_anchors(rows, length), "anchors")
    grams = found.groupBy("gram").agg(F.sum(F.size("pos")).alias("c")).filter("c > 1").select("gram")
    hot = materialize(found.join(grams, "gram"), "hot")
    place = F.struct("doc", "tag", F.col("pos")[0].alias("pos"), "before", "after")
    classes = materialize(hot.groupBy("gram", "reach").agg(F.sum(F.size("pos")).alias("n"), F.min(place).alias("x")).select("gram", "reach", "n", "x.*"), "reaches")
    around = F.transform("pos", lambda p: F.struct((p - F.col("before")).alias("start"), (p + F.col("after")).alias("end")))
    whole = hot.join(classes.filter("n > 1").select("gram", "reach"), ["gram", "reach"]).select("doc", "tag", around.alias("spans"))
    sizes = classes.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1")
    reaches = materialize(fetch(texts, classes.join(sizes, "gram")), "bytes")
    parts = sort_all(reaches, length).select("doc", "tag", F.array(F.struct("start", "end")).alias("spans"))
    return whole.unionByName(parts).groupBy("doc", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _apply(schema: str, names: list[str], make):
    """A mapInArrow function over (id, z, spans): ``make(raw, merged spans)`` gives the columns after the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            lists, out = batch.column("spans"), []
            for row, z in enumerate(batch.column("z")):
                spans = [(x["start"], x["end"]) for x in lists[row].as_py()] if lists[row].is_valid else []
                out.append(make(expand.decompress(z.as_buffer()), merged(spans)))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), kinds[k]) for c, k in zip(columns, schema.split(), strict=True))], ["id", *names])

    return run


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]])


def digest_row(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    left = cut_out(raw, spans)
    return len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()


def text_row(raw: bytes, spans: list[tuple[int, int]]) -> tuple[str]:
    """The text without its spans, which shrink to whole characters."""
    whole = []
    for start, end in spans:
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        whole.append((start, end))
    return (cut_out(raw, whole).decode(),)


def dedup_digest(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) after removing each byte that a repeated string covers.

    A string of ``length`` bytes is repeated if it starts anywhere else as well, in the same or another document; judged on
    the input. Null and short texts lose nothing; rows that repeat an id or a text are documents of their own; a null id
    stays null; an empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    texts = materialize(compressed(rows), "texts")
    joined = texts.join(repeated_spans(rows, texts, length), ["doc", "tag"], "left").select("id", "z", "spans")
    return joined.mapInArrow(_apply("long long long string", ["n_bytes", "n_removed", "n_spans", "kept_sha256"], digest_row), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", "doc_id")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text_col`` and ``size_col`` brought up to date; no row is dropped.

    Cuts keep characters whole. Rows that share id and text share the result; null texts stay null.
    """
    rows = keyed(docs, id_col, text_col)
    doc, tag, found = (fresh(docs, x) for x in ("doc", "tag", "spans"))
    spans = repeated_spans(rows, materialize(compressed(rows), "texts"), length).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("spans").alias(found))
    named = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(tag, F.xxhash64(F.col(text_col).cast("string")))
    joined = named.join(spans, [doc, tag], "left")

    @F.pandas_udf("string")
    def without(text, spans):
        import pandas as pd

        return pd.Series([t if t is None or s is None else text_row(t.encode(), merged([(x["start"], x["end"]) for x in s]))[0] for t, s in zip(text, spans, strict=True)], dtype=object)

    touched = F.col(found).isNotNull()
    out = joined.withColumn(text_col, F.when(touched, without(F.col(text_col), F.col(found))).otherwise(F.col(text_col)))
    if size_col and size_col in docs.columns:
        out = out.withColumn(size_col, F.when(touched, F.length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return out.select(*docs.columns)
