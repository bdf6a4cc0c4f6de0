"""Near-duplicate documents: MinHash bands for candidates, odd sketches to check them, full shingle sets to confirm.

An odd sketch folds a document's MinHash samples into a bitmap, flipping one bit per sample; the XOR of two sketches has as
many bits as samples differ (up to collisions), which estimates high similarities closely in a few machine words.

Documents with equal shingle sets are one class. Candidates are taken in two turns, so that a bucket of near copies never
yields its pairs: first each class against the least class of its buckets; then, between classes that these links have not
joined yet, the pairs that share a bucket and whose wide sketches agree. A wide sketch is an odd sketch of the shingle
hashes below a bound (all of them in most texts), whose XOR bits bound the number of shingles that differ. Both turns are
confirmed on the full sets. Ids come in at the end only: classes, links and texts go by the number of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import fresh, materialize, mix64, string_chunks
from tally.llm.components import connected_components

ROWS, BANDS, SKETCH_WORDS = 5, 28, 8
SAMPLES = ROWS * BANDS
#: Standard deviations of the estimate that a candidate may fall short of the threshold.
SLACK = 5.0
#: Words of a wide sketch, and the shingles that one folds at most (about).
WIDE_WORDS, WIDE_SHINGLES = 32, 4096
BLOCK = 512
WORDS_KEPT = 1_000_000


class WordHashes(dict):
    """64-bit hashes of words, computed once per task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_hashes(raw: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; with fewer words, of all its words as one."""
    found = raw.lower().split()  # ASCII only, both of them
    if not found:
        return np.empty(0, np.uint64)
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    mixed = np.full(len(each) - width + 1, np.uint64(width), np.uint64)
    for at in range(width):
        mixed = mix64(mixed + each[at : at + len(mixed)])
    return np.unique(mixed)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(5)
    return draw.integers(0, 2**63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, SAMPLES, np.uint64)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One sample per coefficient pair: the least of mixed, shifted products."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * a + b).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of (position, sample) pairs."""
    bits = mix64(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def wide_sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """(halvings, parity bitmap) of the shingles whose hash is below 2^64 / 2^halvings."""
    halvings = max(0, (len(shingles) // WIDE_SHINGLES).bit_length())
    some = shingles[: np.searchsorted(shingles, np.uint64(2**64 - 1 >> halvings), "right")]
    odd = np.bincount((mix64(some) % np.uint64(64 * WIDE_WORDS)).astype(np.int64), minlength=64 * WIDE_WORDS) & 1
    return halvings, np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def most_wide_bits(sizes: np.ndarray, halvings: np.ndarray, threshold: float) -> np.ndarray:
    """XOR bits that two wide sketches at ``threshold`` have at most, given the sum of their set sizes.

    Bits never outnumber the shingles that differ, so for whole sets that number itself is a bound without exception; large
    sets collide, and SLACK standard deviations above the expected bits are the tighter bound.
    """
    n, step = 64 * WIDE_WORDS, 0.5**halvings
    apart = sizes * (1 - threshold) / (1 + threshold) + 1e-6
    sampled = apart * step
    sampled = sampled + SLACK * np.sqrt(sampled * (1 - step))
    even, even2 = (1 - 2 / n) ** sampled, (1 - 4 / n) ** sampled
    spread = np.sqrt(np.maximum(0, n * (1 - even**2) + n * (n - 1) * (even2 - even**2))) / 2
    expected = n / 2 * (1 - even) + SLACK * spread + 4
    return np.where(halvings > 0, expected, np.minimum(apart, expected))


def most_bits(threshold: float) -> int:
    """XOR bits that two sketches at ``threshold`` have at most, SLACK standard deviations included."""
    n = 64 * SKETCH_WORDS
    low = threshold - SLACK * (threshold * (1 - threshold) / SAMPLES) ** 0.5
    return int(n / 2 * (1 - (1 - 2 / n) ** (2 * SAMPLES * (1 - low)))) + 8  # 8: collisions of bits


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, tag, n_shingles, digest, bands, sketch, wide) of each row of ``docs`` (doc_id, text, tag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, (a, b) = WordHashes(), _coefficients()
        for batch in batches:
            sizes, digests, bands, odd, wide = [], [], [], [], []
            for chunk in string_chunks(batch.column(1)):
                for _, raw in chunk:
                    shingles = shingle_hashes(raw, words, hashes)
                    sizes.append(len(shingles))
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    if not len(shingles):
                        bands.append([])
                        odd.append([])
                        wide.append([])
                        continue
                    samples = minhash(shingles, a, b)
                    key = np.arange(BANDS, dtype=np.uint64)
                    for column in mix64(samples).reshape(BANDS, ROWS).T:
                        key = mix64(key + column)
                    bands.append(key.view(np.int64))
                    odd.append(odd_sketch(samples).view(np.int64))
                    halvings, bitmap = wide_sketch(shingles)
                    wide.append(np.append(bitmap.view(np.int64), halvings))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(odd, longs), pa.array(wide, longs)], ["doc_id", "tag", "n_shingles", "digest", "bands", "sketch", "wide"])

    return docs.select("doc_id", "text", "tag").mapInArrow(run, "doc_id long, tag long, n_shingles long, digest binary, bands array<long>, sketch array<long>, wide array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets have a similarity of ``threshold`` or more.

    Pairs lie sorted by (a, part): one set of a in memory at a time, and a document with very many partners is split into
    parts of about 64, so that no task holds all of them.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    parted = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / 64)).cast("int")).select("a", "b", "part")
    heads = parted.select("a", "part").distinct().join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rest = parted.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "part", "b", "text")
    whole = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, head, own = WordHashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text"), strict=True):
                shingles = shingle_hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", words, hashes)
                if b is None:
                    head, own = a, shingles
                elif head == a:
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    if 100 * both >= whole * (len(own) + len(shingles) - both):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return heads.unionByName(rest).repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long").distinct()


def pairs_of_block(rows: dict[str, np.ndarray], threshold: float) -> np.ndarray:
    """Of one block pair of one bucket: the pairs of different labels whose sizes and wide sketches agree."""
    whole, reps, label, size, own = round(100 * threshold), rows["rep"], rows["label"], rows["n"], rows["own"]
    lower, upper, head = rows["low"][0], rows["high"][0], rows["head"][0]
    names, counts = np.unique(label, return_counts=True)
    most = names[counts.argmax()]
    bands = rows["bands"]
    bits, halvings = rows["wide"][:, :-1].view(np.uint64), rows["wide"][:, -1]
    out = [np.empty((0, 2), np.int64)]
    for i in np.flatnonzero(label != most):  # a pair of two of the largest label has nothing to find
        other = label != label[i]
        other[:i] &= label[:i] == most  # else the pair had its turn
        if lower != upper:
            other &= own != own[i]
        other &= (100 * np.minimum(size[i], size) >= whole * np.maximum(size[i], size)) & ((reps != head) & (reps[i] != head))  # pairs with the head came first
        two = np.flatnonzero(other)
        if len(two):
            apart = np.bitwise_count(bits[i] ^ bits[two]).sum(axis=1)
            near = apart <= most_wide_bits(size[i] + size[two], halvings[two], threshold)
            two = two[near | (halvings[two] != halvings[i])]
            # of the buckets that both are in, the first one yields the pair
            two = reps[two[bands[i][(bands[i] == bands[two]).argmax(axis=1)] == rows["key"][0]]]
            out.append(np.stack([np.minimum(reps[i], two), np.maximum(reps[i], two)], axis=1))
    return np.concatenate(out)


def mixed_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs_of_block over the block pairs of ``rows``, which lie sorted and pass one at a time."""
    names, wide = ["key", "low", "high", "own", "head", "rep", "label", "n"], {"wide": WIDE_WORDS + 1, "bands": BANDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names} | {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c, width in wide.items()}
            rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            starts = np.flatnonzero(np.concatenate([[True], np.any([rows[c][1:] != rows[c][:-1] for c in names[:3]], axis=0)]))
            found = [pairs_of_block({c: x[low:high] for c, x in rows.items()}, threshold) for low, high in zip(starts, starts[1:], strict=False)]
            held = {c: x[starts[-1] :].copy() for c, x in rows.items()}
            if found:
                yield out(np.concatenate(found))
        if held is not None:
            yield out(pairs_of_block(held, threshold))

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return rows.select(*names, *wide).repartition(*names[:3]).sortWithinPartitions(*names[:3]).mapInArrow(run, "a long, b long").distinct()


def same_id_links(usable: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(src, dst): the classes of ids that stand for several different sets, each tied to the first; None if there are none."""
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first <> last").select("doc_id", "first")
    several = materialize(several, "several")
    if several.isEmpty():
        return None
    pairs = usable.select("doc_id", "digest").join(several, "doc_id").filter("digest <> first").select("digest", "first").distinct()
    number = classes.select("digest", "rep")
    return pairs.join(number.select("digest", F.col("rep").alias("src")), "digest").join(number.select(F.col("digest").alias("first"), F.col("rep").alias("dst")), "first").select("src", "dst")


def verdicts(docs: DataFrame, words: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, digest, n_shingles, component_id, kept) of each row; tag: a hash of the text, digest: null without a set."""
    text = F.col(text_col).cast("string")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    drawn = materialize(sketches(plain, words), "sketches")
    usable = drawn.filter("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "tag", "n_shingles", "bands", "sketch", "wide")).alias("x"))
    # the number of a class holds for this run only; the written table fixes it
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "digest", F.col("x.doc_id").alias("least_id"), F.col("x.tag").alias("tag"), F.col("x.n_shingles").alias("n"), "x.bands", "x.sketch", "x.wide"), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    member_keys = keys.join(shared, "key")
    members = materialize(member_keys.join(classes.select("rep", "n", "sketch"), "rep"), "members")
    similar = F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * round(100 * threshold)
    apart = F.aggregate(F.zip_with("sketch", "head_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    heads = members.groupBy("key").agg(F.min(F.struct("rep", "n", "sketch")).alias("h")).select("key", F.col("h.rep").alias("head"), F.col("h.n").alias("head_n"), F.col("h.sketch").alias("head_sketch"))
    first = members.join(heads, "key").filter((F.col("rep") != F.col("head")) & similar & (apart <= most_bits(threshold))).select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    # texts of the classes that share a bucket with another, one for each: one shuffle of the whole table, not one per turn
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("least_id").alias("doc_id"), "tag")
    texts = materialize(plain.join(wanted, ["doc_id", "tag"]).groupBy("doc_id", "tag").agg(F.first("rep").alias("id"), F.first("text").alias("text")).select("id", "text"), "texts")
    first = materialize(confirm(materialize(first, "pairs"), texts, words, threshold), "confirmed")
    labels = connected_components(first.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labelled = members.drop("sketch").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    labelled = materialize(labelled, "labelled")
    # a bucket of two has had its only pair compared
    open_keys = labelled.filter("size > 2").groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("rep").alias("head")).filter("least <> most").select("key", "head")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = labelled.join(open_keys, "key").join(classes.select("rep", "wide", "bands"), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    second = confirm(materialize(mixed_pairs(rest, threshold), "pairs"), texts, words, threshold)
    links = first.unionByName(second).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    same = same_id_links(usable, classes)
    component = connected_components(links if same is None else links.unionByName(same))
    numbered = classes.select("rep", "digest", "least_id").join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = numbered.groupBy("component").agg(F.min("least_id").alias("found"))
    by_class = numbered.join(least, "component").select("digest", "found")
    digest = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest"))
    out = drawn.select("doc_id", "tag", "n_shingles", digest.alias("digest")).join(by_class, "digest", "left")
    component_id = F.coalesce("found", "doc_id")
    return out.select("doc_id", "tag", "digest", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    A set holds the distinct shingles of ``words`` words (A-Z lower-cased, cut at ASCII white space); with fewer words, the
    whole sequence. Null and empty texts have no set and link with nothing; a null id links with nothing, has a null
    component and is kept; rows that share an id are one document for the links, which has the links of all its texts, and
    each gets its own row; an empty table gives no rows; other columns are ignored. A pair at the threshold is missed with a
    probability of about (1 - threshold^5)^28, which is 1.5e-5 at 0.8.
    """
    return verdicts(docs, words, threshold, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; rows with a null id all stay.

    Of rows that share an id, each different set stays, in the row whose text has the least hash; texts without a set count
    as sets by their text. Of rows that repeat id and text, one stays.
    """
    tag = fresh(docs, "tag")
    verdict = verdicts(docs, words, threshold, id_col, text_col).filter("kept and doc_id is not null")
    kept = verdict.groupBy("doc_id", F.coalesce("digest", F.col("tag").cast("string").cast("binary"))).agg(F.min("tag").alias(tag)).select(F.col("doc_id").alias(id_col), tag)
    named = docs.filter(F.col(id_col).isNotNull()).withColumn(tag, F.xxhash64(F.col(text_col).cast("string"))).join(kept, [id_col, tag], "left_semi")
    return named.dropDuplicates([id_col, tag]).select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
