"""Whether a file is the building's own, by the names that its beginning says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.text import norm_text

# fixed values: words that a readable balance has two of
BALANCE_WORDS = "CONDOMINIO PRESTACAO SALDO DESPESAS RECEITAS FINANCEIRO PERIODO COMPETENCIA DEMONSTRATIVO".split()
SUFFIX = r"\s+(I|II|III|IV|V)$"
SEEN = r"(?:COND[A-Z]*|EDIFICIO)\s+[A-Z0-9 ]{4,60}"
LEAST_OWN, LEAST_OTHER, MOST_NAMED = 3, 7, 3


def phrases(buildings: DataFrame, aliases: DataFrame) -> DataFrame:
    """(condo_id, phrase, own, other): what stands for a building in a file of its own (its name, also without a numeral at the end,
    and its aliases) and in another's (its whole name, if that is long enough)."""
    name = norm_text(F.col("name"))
    whole = buildings.select("condo_id", name.alias("phrase"), (F.length(name) >= LEAST_OWN).alias("own"), (F.length(name) >= LEAST_OTHER).alias("other"))
    short = F.regexp_replace(name, SUFFIX, "")
    extra = buildings.select("condo_id", short.alias("phrase")).unionByName(aliases.select("condo_id", norm_text(F.col("alias")).alias("phrase"))).filter(F.length("phrase") >= LEAST_OWN)
    both = whole.unionByName(extra.select("condo_id", "phrase", F.lit(True).alias("own"), F.lit(False).alias("other")))
    return both.groupBy("condo_id", "phrase").agg(F.max("own").alias("own"), F.max("other").alias("other")).filter("phrase <> ''")


def phrase_hits(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(file, phrase): which phrases stand in a text (plain upper case) as whole words.

    A phrase is looked up by its word that the fewest texts have, wherever that stands, and then compared with the words there.
    """
    words = texts.select("file", F.split("text", " ").alias("words")).select("file", "words", F.posexplode("words").alias("at", "word"))
    sizes = words.groupBy("word").agg(F.count("*").alias("size"))
    parts = names.select("phrase").distinct().withColumn("own_words", F.split("phrase", " ")).select("phrase", "own_words", F.posexplode("own_words").alias("place", "word"))
    # a word that no text has rules its phrase out
    rare = parts.join(sizes, "word", "left").groupBy("phrase", "own_words").agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "place", "word")).alias("rare"))
    rare = rare.filter("rare.size > 0").select("phrase", "own_words", "rare.place", "rare.word")
    met = words.join(rare, "word").filter(F.col("at") >= F.col("place"))
    return met.filter(F.slice("words", F.col("at") - F.col("place") + 1, F.size("own_words")) == F.col("own_words")).select("file", "phrase").distinct()


def file_identity(headers: DataFrame, buildings: DataFrame, aliases: DataFrame) -> DataFrame:
    """S6 for headers (file, condo_id, text) and buildings (condo_id, name, nameless): ``state`` ok, warn or refuse, and why.

    A text with fewer than two words of a balance can't be read (warn); the building's own name or alias settles it (ok);
    buildings whose files never have a name pass with a warning unless another's name stands there; else the file is refused,
    with the others' names (three at most) or with what the text says instead.
    """
    texts = headers.select("file", "condo_id", norm_text(F.coalesce("text", F.lit(""))).alias("text"))
    names = phrases(buildings, aliases)
    hits = phrase_hits(texts, names).join(names, "phrase").withColumnRenamed("condo_id", "named")
    marked = hits.join(texts.select("file", "condo_id"), "file")
    found = marked.groupBy("file").agg(
        F.max((F.col("named") == F.col("condo_id")) & F.col("own")).alias("is_own"),
        F.array_sort(F.collect_set(F.when((F.col("named") != F.col("condo_id")) & F.col("other"), F.struct("named", "phrase")))).alias("others"),
    )
    rows = texts.join(found, "file", "left").join(buildings.select("condo_id", "nameless"), "condo_id", "left")
    balance = sum((F.contains("text", F.lit(w)).cast("int") for w in BALANCE_WORDS), F.lit(0))
    foreign = F.coalesce(F.size("others"), F.lit(0)) > 0
    reason = F.when(balance < 2, "unreadable").when(F.coalesce("is_own", F.lit(False)), "own").when(F.coalesce("nameless", F.lit(False)) & ~foreign, "nameless").when(foreign, "other").otherwise("unnamed")
    seen = F.coalesce(F.nullif(F.trim(F.regexp_extract("text", SEEN, 0)), F.lit("")), F.substring("text", 1, 80))
    says = F.when(reason == "other", F.array_join(F.transform(F.slice("others", 1, MOST_NAMED), lambda x: x["phrase"]), ", ")).when(reason == "unnamed", seen)
    state = F.when(reason == "own", "ok").when(reason.isin("unreadable", "nameless"), "warn").otherwise("refuse")
    return rows.select("file", "condo_id", state.alias("state"), reason.alias("reason"), says.alias("says"))
