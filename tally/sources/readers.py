"""Readers of file names, statement lines and dashboards as tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.functions.text import norm_text, parse_brl

# fixed values: month names of file names
MONTH_NAMES = "JANEIRO FEVEREIRO MARCO ABRIL MAIO JUNHO JULHO AGOSTO SETEMBRO OUTUBRO NOVEMBRO DEZEMBRO".split()


def month_from_filename(path: Column) -> Column:
    """S3: the month that a file's name tells, by the first pattern that gives a real one; null without any."""
    name = norm_text(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", ""))
    of = lambda p, y, m: F.struct(F.regexp_extract(name, p, y).try_cast("int").alias("y"), F.regexp_extract(name, p, m).try_cast("int").alias("m"))
    named = F.regexp_extract(name, r"\b(" + "|".join(MONTH_NAMES) + r") ([0-9]{4})\b", 1)
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTH_NAMES)), named), F.lit(0)).cast("int")
    year = F.regexp_extract(name, r"\b(?:" + "|".join(MONTH_NAMES) + r") ([0-9]{4})\b", 1).try_cast("int")
    found = [of(r"\b([0-9]{1,2}) ([0-9]{4})\b", 2, 1), of(r"\b([0-9]{4}) ([0-9]{1,2})\b", 1, 2), F.struct(year.alias("y"), month.alias("m")), of(r"\b([0-9]{2})([0-9]{4})\b", 2, 1)]
    valid = lambda x: F.when(x["m"].between(1, 12) & x["y"].between(2000, 2100), F.make_date(x["y"], x["m"], F.lit(1)))
    return F.coalesce(*map(valid, found))


def format_of(path: Column) -> Column:
    """F39."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(suffix.isin("xlsx", "xls", "pdf"), suffix)


def pick_month_file(files: DataFrame) -> DataFrame:
    """Of the readable files of a building and month the one nearest the root, of the asked suffix, and newest."""
    rows = files.withColumn("month", month_from_filename(F.col("path"))).withColumn("format", format_of(F.col("path"))).filter("format is not null and month is not null and not path like '%relatorio%'")
    order = W.partitionBy("condo_id", "month").orderBy(F.size(F.split("path", "/")), F.when(F.col("format") == F.col("prefer"), 0).otherwise(1), F.desc("modified"), "path")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("condo_id", "month", "path", "format")


def printed_period_check(lines: DataFrame) -> DataFrame:
    """Statements whose printed period, in their first four pages, ends in another month than theirs."""
    end = F.try_to_timestamp(F.regexp_extract("text", r"(?i)^\s*Per[ií]odo: *[0-9/]+ a ([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), F.lit("dd/MM/yyyy")).cast("date")
    printed = lines.filter("page <= 4").withColumn("end", end).filter("end is not null").groupBy("condo_id", "month").agg(F.min_by("end", F.struct("page", "line")).alias("printed_end"))
    return printed.filter(F.trunc("printed_end", "month") != F.col("month"))


def section_lines(lines: DataFrame) -> DataFrame:
    """Sections of a statement: the sum of their items against the total that they declare.

    A header opens a section and the same header on the next page goes on with it; items have a label and an amount; TOTAL states
    the section's total, and items may follow it.
    """
    order = W.partitionBy("condo_id", "month").orderBy("page", "line")
    header = F.nullif(F.regexp_extract("text", r"^## (.+)$", 1), F.lit(""))
    rows = lines.withColumn("header", F.last(header, True).over(order)).filter("header is not null")
    amount = parse_brl(F.regexp_extract("text", r"^(.*\S)\s+(-?[0-9.]+,[0-9]{2})$", 2))
    label = F.regexp_extract("text", r"^(.*\S)\s+(-?[0-9.]+,[0-9]{2})$", 1)
    change = F.coalesce((F.col("header") != F.lag("header").over(order)).cast("int"), F.lit(1))
    runs = rows.withColumn("run", F.sum(change).over(order)).withColumn("amount", amount).withColumn("label", label).filter("amount is not null")
    sums = runs.groupBy("condo_id", "month", "run", "header").agg(F.sum(F.when(F.col("label") != "TOTAL", F.col("amount"))).alias("items"), F.max(F.when(F.col("label") == "TOTAL", F.col("amount"))).alias("declared"))
    return sums.select("condo_id", "month", F.col("header").alias("section"), "items", "declared", (F.abs(F.col("items") - F.col("declared")) <= 0.02).alias("closes"))


def block_rows(cells: DataFrame, title: str = "DESPESAS") -> DataFrame:
    """Rows of a sheet's blocks with ``title`` in theirs, with the account and sub-account that are open there.

    "Condomínio:" starts a block; its title is the first text of the three rows that follow, up to "Período". A text without an amount opens
    an account or, inside one, a sub-account; "TOTAL DA CONTA" closes the innermost. A sheet is one file's.
    """
    sheet = W.partitionBy("condo_id", "month").orderBy("row")
    text = F.trim(F.coalesce("text", F.lit("")))
    mark = F.lower(text).startswith("condomínio:")
    after = F.coalesce(*(F.nullif(F.lead(text, k).over(sheet), F.lit("")) for k in (1, 2, 3)))
    rows = cells.withColumn("text", text).withColumn("mark", mark).withColumn("own", F.when(mark, F.trim(F.split(after, r"\s+Per[ií]odo\b")[0])))
    rows = rows.withColumn("block", F.sum(F.col("mark").cast("int")).over(sheet.rowsBetween(W.unboundedPreceding, 0))).withColumn("title", F.last("own", True).over(sheet))
    # the title's own row is no node
    titled = (F.col("own").isNull()) & (F.lag("seen", 1, 0).over(W.partitionBy("condo_id", "month", "block").orderBy("row")) == 1)
    inside = W.partitionBy("condo_id", "month", "block").orderBy("row")
    rows = rows.withColumn("seen", F.max(((F.col("text") != "") & ~F.col("mark")).cast("int")).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.filter(F.upper("title").contains(title)).withColumn("titled", titled).filter("titled and text <> ''")
    total, opens = F.col("text").startswith("TOTAL DA CONTA "), F.col("amount").isNull()
    depth = F.coalesce(F.sum(F.when(opens, 1).when(total, -1).otherwise(0)).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("depth", depth)
    at = lambda d: F.last(F.when(opens & (F.col("depth") == d), F.col("text")), True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("account", at(0)).withColumn("sub", F.when(F.col("depth") >= 2, at(1))).filter(~opens)
    return rows.select("condo_id", "month", "block", "row", "account", "sub", total.alias("is_total"), F.col("text").alias("description"), "amount")


def block_entries(cells: DataFrame) -> DataFrame:
    """The entries of a sheet under their account and sub-account."""
    return block_rows(cells).filter("not is_total").drop("is_total", "row")


def block_totals(cells: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Declared totals of accounts (``sub`` null) and sub-accounts against the sum of their entries."""
    rows = block_rows(cells)
    key = ["condo_id", "month", "block", "account", "sub"]
    # an entry counts for its sub-account and for its account: the sheets are read once
    null, is_entry = F.lit(None).cast("string"), ~F.col("is_total")
    each = rows.withColumn("sub", F.explode(F.when(is_entry & F.col("sub").isNotNull(), F.array("sub", null)).otherwise(F.array(F.when(F.col("is_total"), F.col("sub"))))))
    sums = each.groupBy(*key).agg(F.coalesce(F.sum(F.when(is_entry, F.col("amount"))), F.lit(0).cast("decimal(28,2)")).alias("items"), F.sum(F.when(F.col("is_total"), F.col("amount"))).alias("declared"))
    return sums.filter("declared is not null").withColumn("closes", F.abs(F.col("items") - F.col("declared")) <= tolerance)


def drop_repeated_blocks(rows: DataFrame) -> DataFrame:
    """Statements whose block is there several times over: how many equal copies; null where the blocks differ."""
    blocks = rows.groupBy("condo_id", "month", "block").agg(F.sum(F.xxhash64("line", "text").cast("decimal(38,0)")).alias("hash"), F.count("*").alias("lines"))
    return blocks.groupBy("condo_id", "month").agg(F.count("*").alias("blocks"), F.count_distinct("hash", "lines").alias("kinds")).select("condo_id", "month", "blocks", F.when(F.col("kinds") == 1, F.col("blocks")).alias("copies"))


def dashboard_balances(pages: DataFrame) -> DataFrame:
    """Month balances out of the ``var BAL = {...}`` of a dashboard's page; keys without quotes and single quotes are allowed."""
    text = F.regexp_extract("html", r"(?s)var BAL *= *(\{.*?\});", 1)
    json = F.regexp_replace(F.replace(text, F.lit("'"), F.lit('"')), r'([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:', '$1"$2":')
    months = F.from_json(json, "map<string, struct<tAnt: decimal(28,2), tCred: decimal(28,2), tDeb: decimal(28,2), tAtual: decimal(28,2)>>")
    return pages.select("condo_id", F.explode(months).alias("key", "x")).select("condo_id", "key", "x.tAnt", "x.tCred", "x.tDeb", "x.tAtual")


def declared_indicators(lines: DataFrame) -> DataFrame:
    """Budget and collected from the two money lines before "COTAS EM ATRASO", and the delinquency that follows; none stated is
    null, not zero."""
    order = W.partitionBy("condo_id", "month").orderBy("page", "line")
    money = parse_brl(F.regexp_extract("text", r"(-?[0-9.]+,[0-9]{2})$", 1))
    rows = lines.withColumn("amount", money).withColumn("one", F.lag("amount", 2).over(order)).withColumn("two", F.lag("amount", 1).over(order))
    return rows.filter(F.col("text").rlike("^COTAS EM ATRASO")).groupBy("condo_id", "month").agg(F.min_by("one", "line").alias("budget"), F.min_by("two", "line").alias("collected"), F.max("amount").alias("delinquent"))


def match_building(files: DataFrame, buildings: DataFrame) -> DataFrame:
    """the building that a file's name fits best: 100 if the whole name is in it, else 80 times the share of its words of more
    than three letters; 40 at least. ``buildings`` holds one row for each building."""
    name = norm_text(F.col("path"))
    words = F.filter(F.split(norm_text(F.col("name")), " "), lambda w: F.length(w) > 3)
    hits = F.size(F.filter("words", lambda w: F.contains(F.col("file_name"), w)))
    # files meet buildings by a shared word
    asked = files.withColumn("file_name", name).withColumn("word", F.explode(F.array_distinct(F.split(name, " "))))
    named = buildings.withColumn("words", words).withColumn("word", F.explode(F.array_distinct(F.split(norm_text(F.col("name")), " "))))
    pairs = asked.join(named, "word").select("path", "file_name", "condo_id", "name", "words").distinct()
    score = F.when(F.contains("file_name", norm_text(F.col("name"))), 100).otherwise(F.floor(80 * hits / F.greatest(F.size("words"), F.lit(1)))).cast("long")
    best = pairs.withColumn("score", score).filter("score >= 40")
    return best.groupBy("path").agg(F.max_by(F.struct("condo_id", "score"), F.struct("score", -F.col("condo_id"))).alias("x")).select("path", "x.*")
