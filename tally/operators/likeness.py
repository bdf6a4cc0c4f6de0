"""Joins on likeness: names that begin alike, names a few letters apart, words inside texts, and connected groups.

Each join compares distinct names inside a key, finds its candidates by equality of parts, and loses none: whatever the
predicate takes for alike shares a part by construction. The months come in afterwards, by windows (`known_before`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.functions import identity
from tally.functions.text import account_key, norm_text
from tally.operators.rules import HISTORY
from tally.sources.stored import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: used twice or more, it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _starts(name: Column, whole_from: int, spaced_from: int | None) -> Column:
    """The beginnings by which another name may be the shorter form of ``name``; the name itself is one."""
    n = F.length(name)
    cut = F.transform(F.sequence(F.lit(whole_from), n - 1), lambda i: F.substring(name, F.lit(1), i))
    found = F.when(n > whole_from, cut).otherwise(F.array().cast("array<string>"))
    if spaced_from is not None:  # that long it must end before a space
        short = F.array(*(F.when((n > i) & (F.substring(name, i + 1, 1) == " "), F.substring(name, 1, i)) for i in range(spaced_from, whole_from)))
        found = F.concat(found, F.filter(short, lambda x: x.isNotNull()))
    return F.array_append(found, name)


def same_by_start(names: DataFrame, keys: list[str], name: str, kind: str) -> DataFrame:
    """(keys, name, other): distinct names of a key that F13 (``kind`` "account") or F14 ("category") takes for one, both ways
    round, each with itself. The shorter of two such names is one of the longer's beginnings, so an equi-join finds all."""
    if kind == "account":
        plain, starts = account_key(F.col(name)), lambda x: _starts(x, 8, None)
    else:
        plain, starts = norm_text(F.col(name)), lambda x: _starts(x, 8, 7)
    rows = names.select(*keys, name).distinct().withColumn("plain", plain)
    rows = rows.filter("plain <> ''") if kind == "account" else rows
    short = rows.select(*keys, F.col(name).alias("short"), F.col("plain").alias("start"))
    long = rows.select(*keys, F.col(name).alias("long"), F.explode(F.array_distinct(starts(F.col("plain")))).alias("start"))
    pairs = long.join(short, [*keys, "start"])
    one, two = pairs.select(*keys, F.col("long").alias(name), F.col("short").alias("other")), pairs.select(*keys, F.col("short").alias(name), F.col("long").alias("other"))
    return one.unionByName(two).distinct()


#: F15's share of edits: 12 % of the longer name, as a fraction, and how far apart the lengths may be.
NEAR, APART = (3, 25), 2


def tolerance(n: str, share: tuple[int, int]) -> str:
    """How many edits the share allows between names, the longer of which has ``n`` letters."""
    return f"cast(({n}) * {share[0]} div {share[1]} as int)"


#: Up to so many edits names meet by what is left when letters go, above that by pieces that stay whole.
FEW = 2


def _cuts() -> str:
    """A name without any of its letters, as hashes: what is left when up to ``d`` letters go."""
    one = "transform(sequence(1, n), i -> xxhash64(concat(substring(plain, 1, i - 1), substring(plain, i + 1))))"
    two = "flatten(transform(sequence(1, n - 1), i -> transform(sequence(i + 1, n), j -> xxhash64(concat(substring(plain, 1, i - 1), substring(plain, i + 1, j - i - 1), substring(plain, j + 1))))))"
    return f"array_distinct(concat(array(xxhash64(plain)), if(d >= 1, {one}, array()), if(d = 2, {two}, array())))"


def _pieces(share: tuple[int, int]) -> str:
    """A name of n letters in one piece more than the edits ``d`` that any longer name allows: piece i begins after n i / (d + 1) letters."""
    most = f"cast({share[1]} * n div ({share[1]} - {share[0]}) as int)"  # no name is farther away than the tolerance of this length
    cut = "concat_ws('|', n, d, i, substring(plain, cast(n * i div (d + 1) as int) + 1, cast(n * (i + 1) div (d + 1) - n * i div (d + 1) as int)))"
    edits = f"filter(sequence({tolerance('n', share)}, {tolerance(most, share)}), d -> d > {FEW})"
    return f"flatten(transform({edits}, d -> transform(sequence(0, d), i -> {cut})))"


def _places(share: tuple[int, int], apart: int | None) -> str:
    """Where such a piece of a name of l letters can stand in this one of n: at d edits one piece stays whole, moved by no more than
    the edits before it (i) and behind it (d - i) explain."""
    d = tolerance("greatest(n, l)", share)
    near = f"l -> {d} > {FEW} and abs(n - l) <= {d}"
    lengths = f"filter(sequence(greatest(1, n - {apart}), n + {apart}), {near})" if apart is not None else f"filter(sequence(1, 2 * n), {near})"
    cut = "concat_ws('|', x.l, x.d, i, substring(plain, cast(x.l * i div (x.d + 1) as int) + s + 1, cast(x.l * (i + 1) div (x.d + 1) - x.l * i div (x.d + 1) as int)))"
    moves = f"transform(filter(sequence(-i, i), s -> abs(s - (n - x.l)) <= x.d - i), s -> {cut})"
    return f"array_distinct(flatten(transform(transform({lengths}, l -> named_struct('l', l, 'd', {d})), x -> flatten(transform(sequence(0, x.d), i -> {moves})))))"


def near_names(wanted: DataFrame, names: DataFrame, keys: list[str], name: str, share: tuple[int, int] = NEAR, apart: int | None = APART) -> DataFrame:
    """(keys, name, other): which names of ``names`` F15 takes for one of ``wanted``, equal ones too; or all within another share.

    Names at most two edits apart are equal once each has lost at most two letters, and meet by what is left. Where the longer one allows
    more edits, the names of ``names`` are cut into one piece more than these; a name within them has one piece unchanged.
    """
    sized = lambda df: df.select(*keys, F.col(name).alias("plain")).filter("plain <> ''").distinct().withColumn("n", F.length("plain")).withColumn("d", F.expr(tolerance("n", share)))
    # neither of two names loses more letters than its own length allows edits, as a letter more in the longer one is an edit, too
    cuts = lambda df, c: sized(df).filter(f"d <= {FEW}").select(*keys, F.col("plain").alias(c), F.explode(F.expr(_cuts())).alias("cut"))
    few = cuts(wanted, name).join(cuts(names, "other"), [*keys, "cut"]).select(*keys, name, "other")
    pieces = sized(names).drop("d").select(*keys, F.col("plain").alias("other"), F.explode(F.expr(_pieces(share))).alias("piece"))
    places = sized(wanted).drop("d").select(*keys, F.col("plain").alias(name), F.explode(F.expr(_places(share, apart))).alias("piece"))
    found = few.unionByName(places.join(pieces, [*keys, "piece"]).select(*keys, name, "other"))
    edits, longer = F.levenshtein(name, "other"), F.greatest(F.length(name), F.length("other"))
    return found.filter(edits * share[1] <= longer * share[0] if apart is None else identity.near_name(F.col(name), F.col("other"), 1 - share[0] / share[1])).distinct()


#: So many letters of a word must stand in a token before the two are compared.
HEAD = 8


def words_in_tokens(wanted: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, token): in which tokens a word of three letters or more stands, be it inside.

    A word meets the tokens that hold its first ``HEAD`` letters: all of a shorter one. A token has few such parts, however many words there are.
    """
    parts = "array_distinct(flatten(transform(sequence(1, length(token) - 2), i -> transform(sequence(3, least({h}, length(token) - i + 1)), n -> substring(token, i, n)))))".format(h=HEAD)
    heads = tokens.select(*keys, "token").distinct().filter("length(token) >= 3").withColumn("head", F.explode(F.expr(parts)))
    words = wanted.select(*keys, "word").distinct().withColumn("head", F.substring("word", 1, HEAD))
    return words.join(heads, [*keys, "head"]).filter(F.contains("token", "word")).select(*keys, "word", "token")


def words_within(wanted: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, text): in which texts (upper case, plain) a word of three letters or more stands, be it inside a longer one: a word
    without spaces lies inside one token of the text."""
    tokens = texts.select(*keys, "text", F.explode(F.array_distinct(F.split("text", " "))).alias("token")).filter("token rlike '[A-Z]'")
    return tokens.join(words_in_tokens(wanted, tokens, keys), [*keys, "token"]).select(*keys, "word", "text").distinct()


def known_before(asked: DataFrame, seen: DataFrame, keys: list[str], months: int = HISTORY) -> DataFrame:
    """(keys, no) of ``asked`` for which ``seen`` has the keys in one of the ``months`` months before: one window, no copies."""
    both = asked.select(*keys, "no", F.lit(1).alias("asked")).unionByName(seen.select(*keys, "no", F.lit(0).alias("asked")))
    both = both.repartition(*keys).distinct()  # equal rows go where the window wants them: shuffled once
    past = F.min("asked").over(W.partitionBy(*keys).orderBy("no").rangeBetween(-months, -1))
    return both.withColumn("past", past).filter("asked = 1 and past = 0").select(*keys, "no")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component): the least node that each node of ``edges`` (keys, a, b) reaches inside its keys.

    In each round a node takes the least label among its own and its neighbours', then that label's own label; each round is
    written to the shared folder. Nodes without an edge aren't there.
    """
    back = edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    both = written(edges.select(*keys, "a", "b").unionByName(back).distinct(), "links")
    labels = written(both.groupBy(*keys, F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("further"))
        new = low.join(jump, [*keys, "label"], "left").select(*keys, "node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = written(new, "labels")
        if new.filter("label <> old").isEmpty():
            return new.select(*keys, "node", F.col("label").alias("component"))
        labels = new.select(*keys, "node", "label")
