"""Rules over entries whose names, accounts and categories change: applicability, renamed accounts, vendor keys.

History is read by windows over the month number inside a building's key, so that a table is never multiplied by the months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.functions import identity
from tally.functions.text import installment, invoice_no, norm_text
from tally.operators import likeness
from tally.operators.rules import CENT, HISTORY, KEYS, before, earlier, previous
from tally.sources.ledger import month_no


def middle_of_cents(sorted_cents: Column) -> Column:
    """The median of an ascending list of cents, in money."""
    n = F.size(sorted_cents)
    return (F.get(sorted_cents, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_cents, F.floor(n / 2).cast("int"))) / 200


def cents(amount: Column) -> Column:
    return (amount * 100).cast("long")


def load_config(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """A building's parameters, those of the overlay over those of the base."""
    key = ["condo_id", "rule", "param"]
    both = base.join(overlay.withColumnRenamed("value", "own"), key, "full")
    return both.select(*key, F.coalesce("own", "value").alias("value"))


def rule_status(statements: DataFrame, config: DataFrame) -> DataFrame:
    """For each statement and rule whether it applies, and why not: what the file covers, then what the building asks for."""
    # rule -> (what it needs, parameter that must be true, whether it is on without one)
    rules = [("R1", "has_income", None, True), ("R11", "has_yield", None, True), ("R14", "has_entries", None, True), ("R15", "has_entries", None, True), ("R4", "has_entries", "R4.min", False), ("R7", None, "R7.months", False), ("R8", None, "R8.active", True), ("R9", None, "R9.active", True), ("R10", None, "R10.active", False), ("G", "has_entries", "G.active", False)]
    settings = config.groupBy("condo_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "rule", "param"), "value"))).alias("settings"))
    rows = statements.join(settings, "condo_id", "left")
    # the rule list is fixed: one array per statement, not a join
    each = []
    for rule, needs, param, default in rules:
        covered = F.col(needs) if needs else F.lit(True)
        value = F.try_element_at(F.col("settings"), F.lit(param)) if param else F.lit("true")
        asked = F.when(value.isNull(), F.lit(default)).otherwise(value != "false")
        reason = F.when(~covered, F.coalesce(F.when(F.lit(needs == "has_income"), F.col("income_reason")), F.lit("not in the file"))).when(~asked, "not configured")
        each.append(F.struct(F.lit(rule).alias("rule"), (covered & asked).alias("applied"), reason.alias("reason")))
    return rows.select(*KEYS, F.inline(F.array(*each)))


def history_set(statements: DataFrame, months: int = HISTORY) -> DataFrame:
    """The earlier statements that a statement compares with: by ``ago``, of any format (balances) and of the same variant
    and suffix (categories)."""
    past = earlier(statements.select(*KEYS, F.col("variant").alias("past_variant"), F.col("suffix").alias("past_suffix")), months)
    same = (F.col("variant") == F.col("past_variant")) & (F.col("suffix") == F.col("past_suffix"))
    return statements.join(past, KEYS).groupBy(*KEYS).agg(F.count("*").alias("any_format"), F.count_if(same).alias("same_format"), F.max((F.col("ago") == 1).cast("int")).cast("boolean").alias("has_previous"))


def offset_group(statements: DataFrame, income: DataFrame, pattern: str, tolerance: float = 1.0) -> DataFrame:
    """R2: inflow and outflow of a group of income lines that should cancel; what is missing is reported as well."""
    lines = income.filter(F.col("description").rlike(pattern)).groupBy(*KEYS).agg(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).alias("inflow"), F.sum(F.when(F.col("amount") < 0, F.col("amount")).otherwise(0)).alias("outflow"), F.count("*").alias("n"))
    rows = statements.select(*KEYS).join(lines, KEYS, "left")
    inflow, outflow = F.coalesce("inflow", F.lit(0).cast("decimal(28,2)")), F.coalesce("outflow", F.lit(0).cast("decimal(28,2)"))
    state = F.when((inflow > 0) & (outflow < 0), "net").when(inflow > 0, "no_outflow").when(outflow < 0, "no_inflow").otherwise("nothing")
    return rows.select(*KEYS, inflow.alias("inflow"), outflow.alias("outflow"), (inflow + outflow).alias("net"), state.alias("state"), F.coalesce("n", F.lit(0)).alias("n")).filter((F.col("state") != "net") | (F.abs("net") > tolerance))


def unlocated_yield(statements: DataFrame, account_month: DataFrame) -> DataFrame:
    """Formats that tell the month's yield only as a whole."""
    total = account_month.groupBy(*KEYS).agg(F.sum("yield_amt").alias("total"))
    return statements.filter(~F.col("has_yield")).join(total, KEYS).filter("total <> 0").select(*KEYS, "total")


def unidentified(entries: DataFrame) -> DataFrame:
    """Entries without description and vendor, or marked as unidentified."""
    text = F.concat_ws(" ", "description", "vendor", "category")
    blank = (F.trim(F.coalesce("description", F.lit(""))) == "") & (F.trim(F.coalesce("vendor", F.lit(""))) == "")
    marked = identity.is_kind(text, "unidentified")
    return entries.filter(blank | marked).select(*KEYS, "ord", "code", "amount", F.when(blank, "blank").otherwise("marked").alias("reason"))


def renamed_accounts(account_month: DataFrame) -> DataFrame:
    """Each account-month with the first account of the month before that F13 takes for the same."""
    past = previous(account_month.select(*KEYS, F.col("account").alias("past_account"), F.col("closing").alias("past_closing")))
    # a building has a few accounts a month: the residual compares those only
    paired = account_month.join(past, KEYS).filter(identity.same_account(F.col("account"), F.col("past_account")))
    first = paired.groupBy(*KEYS, "account").agg(F.min_by("past_closing", "past_account").alias("past_closing"))
    return account_month.join(first, [*KEYS, "account"], "left")


def continuity_of_renamed(account_month: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """R9 with F13; consolidated accounts are left out."""
    rows = renamed_accounts(account_month.filter(~norm_text(F.col("account")).startswith("CONSOLIDADO")))
    gap = F.col("opening") - F.col("past_closing")
    return rows.filter(F.abs(gap) > tolerance).select(*KEYS, "account", "opening", "past_closing", gap.alias("gap"))


def streak_of_renamed(account_month: DataFrame, months: int = 3) -> DataFrame:
    """R7 with F13: an account below zero in this and the statements before, up to HISTORY months back; a statement that has no
    such account (the first by name) or has it above zero ends the row, a month without any statement doesn't."""
    rows = account_month.withColumn("no", month_no(F.col("month")))
    statements = rows.select("condo_id", "no").distinct().withColumn("at", F.row_number().over(W.partitionBy("condo_id").orderBy("no")))
    rows = rows.join(statements, ["condo_id", "no"])
    same = likeness.same_by_start(rows, ["condo_id"], "account", "account")
    other = rows.select("condo_id", "no", "at", F.col("account").alias("other"), F.col("closing").alias("other_closing"))
    found = same.join(other, ["condo_id", "other"]).groupBy("condo_id", "account", "no", "at").agg(F.min_by("other_closing", "other").alias("past"))
    ahead = found.filter(F.col("past") < -CENT).select("condo_id", "account", F.col("no").alias("past_no"), "at", F.explode(F.sequence(F.lit(1), F.lit(HISTORY))).alias("ago")).withColumn("at", F.col("at") + F.col("ago"))
    below = rows.filter((F.col("closing") < -CENT) & ~F.upper("account").startswith("CONSOLIDADO"))
    past = below.join(ahead, ["condo_id", "account", "at"]).filter(F.col("past_no") >= F.col("no") - HISTORY).groupBy(*KEYS, "account").agg(F.collect_set("ago").alias("agos"))
    run = F.array_min(F.array_append(F.array_except(F.sequence(F.lit(1), F.lit(HISTORY)), F.coalesce("agos", F.array().cast("array<int>"))), F.lit(HISTORY + 1)))
    return below.join(past, [*KEYS, "account"], "left").withColumn("streak", run).filter(F.col("streak") >= months).select(*KEYS, "account", "closing", "streak")


def switched_category(entries: DataFrame, mass: int = 8) -> DataFrame:
    """R16 with F10 and F14: a vendor known from the history, never under a category that F14 takes for this one; withholdings
    are left out; more than ``mass`` in a month are one reclassification."""
    now = entries.filter("not is_withholding and key <> ''").groupBy(*KEYS, "no", "key", "category").agg(F.sum("amount").alias("total"))
    after = W.partitionBy("condo_id", "key").orderBy("no").rangeBetween(1, HISTORY)
    now = now.withColumn("past", F.count("*").over(before("condo_id", "key"))).withColumn("later", F.count("*").over(after))
    # a vendor's entry that no other month has near has nothing to compare
    now = likeness.written(now.filter("past > 0 or later > 0"), "switches")
    same = likeness.same_by_start(now, ["condo_id"], "category", "category")
    asked = now.filter("past > 0").drop("past", "later")
    seen = now.filter("later > 0").select("condo_id", "no", "key", F.col("category").alias("other")).join(same, ["condo_id", "other"])
    moved = asked.join(likeness.known_before(asked, seen, ["condo_id", "key", "category"]), ["condo_id", "no", "key", "category"], "left_anti")
    n = F.count("*").over(W.partitionBy(*KEYS))
    return moved.withColumn("n", n).select(*KEYS, "key", "category", "total", F.when(F.col("n") > mass, "mass").otherwise("single").alias("kind"))


def new_category_of_renamed(entries: DataFrame, mass: int = 8) -> DataFrame:
    """R17 with F14: a category that no history month has under this or a longer or shorter name; transfers are left out."""
    now = entries.groupBy(*KEYS, "no", "category").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    now = likeness.written(now.withColumn("moves", norm_text(F.col("category")).startswith("TRANSFERENCIA")), "categories")
    same = likeness.same_by_start(now.filter("not moves"), ["condo_id"], "category", "category")
    seen = now.filter("not moves").select("condo_id", "no", F.col("category").alias("other")).join(same, ["condo_id", "other"])
    asked = now.filter("not moves")
    history = now.select("condo_id", "no").distinct().withColumn("months", F.count("*").over(before("condo_id"))).filter("months > 0").drop("months")
    new = asked.join(likeness.known_before(asked, seen, ["condo_id", "category"]), ["condo_id", "no", "category"], "left_anti").join(history, ["condo_id", "no"], "left_semi")
    many = new.groupBy(*KEYS).agg(F.count("*").alias("many"))
    return new.join(many, KEYS).select(*KEYS, "category", "total", "n", F.when(F.col("many") > mass, "reorganised").otherwise("new").alias("kind"))


def keyed(entries: DataFrame) -> DataFrame:
    """Valid entries with their vendor key: above zero, neither transfers nor withholdings."""
    return entries.filter((F.col("amount") > CENT) & ~F.col("is_structural"))


def with_identity(entries: DataFrame) -> DataFrame:
    """Entries with what the rules ask of each: vendor key (F10), telling words (F16), what was paid for (F17), whether it is structural, a
    withholding, eventual or payroll (F19); a query that reads them several times takes them written."""
    v, d = F.col("vendor"), F.col("description")
    return entries.select(
        "*", identity.vendor_key2(v, d).alias("key"), identity.presence_words(v, d).alias("words"),
        identity.structural(F.col("category"), d).alias("is_structural"), identity.is_kind(d, "withholding").alias("is_withholding"), identity.is_kind(d, "eventual").alias("is_eventual"), identity.is_kind(d, "payroll").alias("is_payroll"),
        installment(d).isNotNull().alias("has_installment"), invoice_no(d).alias("invoice_text"), norm_text(d).alias("norm_description"),
    ).withColumn("object", F.array_except(identity.terms(d), F.split("key", " ")))


def stable_months(entries: DataFrame, least: float = 0.5) -> DataFrame:
    """(condo_id, month) whose previous months name vendors in a way that lasts: of the newest history month's keys at least
    ``least`` occur in the one before it."""
    keys = likeness.written(keyed(entries).select(*KEYS, "no", "key").distinct(), "keys")
    months = keys.select("condo_id", "month", "no").distinct().withColumn("last", F.max("no").over(before("condo_id"))).withColumn("n", F.count("*").over(before("condo_id"))).filter("n >= 2")
    again = keys.withColumn("past_no", F.max("no").over(W.partitionBy("condo_id", "key").orderBy("no").rangeBetween(-HISTORY, -1)))
    order = keys.select("condo_id", "no").distinct().withColumn("prior", F.lag("no").over(W.partitionBy("condo_id").orderBy("no")))
    share = again.join(order, ["condo_id", "no"]).groupBy("condo_id", "no").agg(F.round(F.avg(F.coalesce((F.col("past_no") == F.col("prior")).cast("int"), F.lit(0))), 6).alias("share"))
    return months.join(share.select("condo_id", F.col("no").alias("last"), "share"), ["condo_id", "last"]).filter(F.col("share") >= least).select(*KEYS, "share")


def months_looked_at(asked: DataFrame, here: bool) -> DataFrame:
    """(condo_id, no) of the history months of ``asked``, or of its own with ``here``: the only entries that can tell it anything."""
    months = asked.select("condo_id", "no").distinct()
    past = months if here else months.select("condo_id", F.explode(F.sequence(F.col("no") - HISTORY, F.col("no") - 1)).alias("no")).distinct()
    return likeness.written(past, "months")


def present_by_words(wanted: DataFrame, entries: DataFrame, here: bool) -> DataFrame:
    """F16: the (condo_id, month, code, key) of ``wanted`` whose telling words, at least half of them, stand in one entry of the history
    months (or of the month itself with ``here``), be it as parts of words.

    Of one or two words any suffices; of three any pair. A text says itself which words and pairs stand in it, so that a word of many
    texts meets none of them more than once.
    """
    words = F.array_sort("words")
    pair = lambda i, j: F.struct(words[i].alias("one"), words[j].alias("two"))
    block = F.when(F.size("words") <= 2, F.transform("words", lambda w: F.struct(w.alias("one"), F.lit("").alias("two")))).otherwise(F.array(pair(0, 1), pair(0, 2), pair(1, 2)))
    asked = wanted.filter(F.size("words") > 0).select(*KEYS, month_no(F.col("month")).alias("no"), "code", "key", F.inline(block))
    asked = likeness.written(asked, "asked")
    vocabulary = asked.select("condo_id", F.explode(F.array("one", "two")).alias("word")).filter("word <> ''").distinct()
    plain = F.array_sort(F.array_distinct(F.filter(F.split(norm_text(F.concat_ws(" ", "description", "vendor")), " "), lambda t: t.rlike("[A-Z]") & (F.length(t) >= 3))))
    entries = entries.join(months_looked_at(asked, here), ["condo_id", "no"], "left_semi")
    texts = likeness.written(entries.select("condo_id", "no", plain.alias("tokens")).distinct().groupBy("condo_id", "tokens").agg(F.collect_set("no").alias("nos")), "texts")
    tokens = texts.select("condo_id", "nos", F.explode("tokens").alias("token"))
    inside = likeness.written(likeness.words_in_tokens(vocabulary, tokens, ["condo_id"]), "inside")
    months = tokens.select("condo_id", "token", F.explode("nos").alias("no")).distinct()
    single = months.join(inside, ["condo_id", "token"]).select("condo_id", F.col("word").alias("one"), F.lit("").alias("two"), "no")
    single = single.join(asked.filter("two = ''").select("condo_id", "one").distinct(), ["condo_id", "one"], "left_semi")
    pairs = asked.filter("two <> ''").select("condo_id", "one", "two").distinct()
    paired = pairs.select("condo_id", F.explode(F.array("one", "two")).alias("word")).distinct()
    # a text with its words in pairs: what is asked of is looked up for each
    held = texts.select("condo_id", "nos", "tokens", F.explode("tokens").alias("token")).join(inside.join(paired, ["condo_id", "word"], "left_semi"), ["condo_id", "token"])
    held = held.groupBy("condo_id", "tokens").agg(F.array_sort(F.collect_set("word")).alias("found"), F.first("nos").alias("nos")).filter(F.size("found") >= 2)
    both = F.expr("flatten(transform(found, (x, i) -> transform(slice(found, i + 2, size(found)), y -> struct(x as one, y as two))))")
    double = held.select("condo_id", "nos", F.inline(both)).join(pairs, ["condo_id", "one", "two"], "left_semi").select("condo_id", "one", "two", F.explode("nos").alias("no"))
    there = single.select("condo_id", "one", "two", "no").unionByName(double)
    known = there if here else likeness.known_before(asked, there, ["condo_id", "one", "two"])
    return asked.join(known, ["condo_id", "no", "one", "two"], "left_semi").select(*KEYS, "code", "key").distinct()


def new_among(wanted: DataFrame, entries: DataFrame, months: int) -> DataFrame:
    """G1's test: the entries of ``wanted`` whose vendor the history lacks, by key (F10), words (F16) and near name (F15): what costs
    most is asked only of those that are left."""
    keys = keyed(entries).select("condo_id", "no", "key").distinct()
    wanted = wanted.join(likeness.known_before(wanted, keys, ["condo_id", "key"]), ["condo_id", "no", "key"], "left_anti")
    # asked of what is left only
    enough = keys.select("condo_id", "no").distinct().withColumn("n", F.count("*").over(before("condo_id"))).filter(F.col("n") >= months).drop("n")
    wanted = likeness.written(wanted, "wanted")
    wanted = wanted.join(enough, ["condo_id", "no"], "left_semi")
    keys = keys.join(months_looked_at(wanted, False), ["condo_id", "no"], "left_semi")
    wanted = likeness.written(wanted.join(present_by_words(wanted, entries, False), [*KEYS, "code", "key"], "left_anti"), "unknown")
    near = likeness.near_names(wanted, keys, ["condo_id"], "key")
    seen = keys.withColumnRenamed("key", "other").join(near, ["condo_id", "other"]).select("condo_id", "no", "key")
    return wanted.join(likeness.known_before(wanted, seen, ["condo_id", "key"]), ["condo_id", "no", "key"], "left_anti")


def of_new_vendor(entries: DataFrame, least: float) -> DataFrame:
    """Entries that G1 asks about: of ``least`` or more, neither vacations and the like nor payroll."""
    rows = keyed(entries).filter((F.col("amount") >= least) & ~F.col("is_eventual") & ~F.col("is_payroll"))
    return rows.select(*KEYS, "no", "ord", "code", "key", "words", "amount")  # they are shuffled and written: nothing else is asked of them


def new_vendors(entries: DataFrame, least: float = 3000, months: int = 2) -> DataFrame:
    """G1: entries of ``least`` or more of vendors that the history lacks; vacations, payroll and the like are left out."""
    return new_among(of_new_vendor(entries, least), entries, months).select(*KEYS, "ord", "code", "key", "amount")


def round_amounts(entries: DataFrame, least: float = 2000, multiple: int = 100, new_least: float = 3000, months: int = 2) -> DataFrame:
    """Round amounts that no history month has, without installment, invoice number, and not among the new vendors; only
    where there is history."""
    rows = keyed(entries)
    amounts = rows.select("condo_id", "no", "amount").distinct().withColumn("seen", F.count("*").over(before("condo_id", "amount"))).filter("seen = 0").select("condo_id", "no", "amount")
    history = entries.select("condo_id", "no").distinct().withColumn("n", F.count("*").over(before("condo_id"))).filter("n > 0").drop("n")
    wanted = rows.filter((F.col("amount") >= least) & (F.pmod(cents(F.col("amount")), F.lit(multiple * 100)) == 0) & ~F.col("has_installment") & F.col("invoice_text").isNull())
    wanted = likeness.written(wanted.join(amounts, ["condo_id", "no", "amount"], "left_semi").join(history, ["condo_id", "no"], "left_semi"), "round")
    new = new_among(of_new_vendor(wanted, new_least), entries, months).select(*KEYS, "code").distinct()
    return wanted.join(new, [*KEYS, "code"], "left_anti").select(*KEYS, "ord", "code", "amount")


def missing_vendors(entries: DataFrame, months: int = 3, least: float = 500) -> DataFrame:
    """Vendor keys of each of the last ``months`` months that have no entry, near name or telling words now; series of
    installments that have ended are left out."""
    rows = keyed(entries)
    sample = F.min(F.struct("ord", "description", "words", "code"))
    ended = F.max(F.coalesce((F.col("inst_n") >= 7).cast("int"), F.lit(0)))
    sums = rows.groupBy("condo_id", "month", "no", "key").agg(ended.alias("ended"), sample.alias("sample"), F.array_agg(cents(F.col("amount"))).alias("amounts"))
    by_key = W.partitionBy("condo_id", "key").orderBy("no")
    frame = by_key.rangeBetween(1 - months, 0)
    last = sums.withColumn("n", F.count("*").over(frame)).withColumn("all", F.array_sort(F.flatten(F.collect_list("amounts").over(frame)))).withColumn("after", F.lead("no").over(by_key))
    open_now = last.filter((F.col("n") == months) & (F.coalesce(F.col("after"), F.lit(0)) != F.col("no") + 1) & (F.col("ended") == 0)).withColumn("usual", middle_of_cents(F.col("all"))).filter(F.col("usual") >= least)
    wanted = previous(open_now.select(*KEYS, (F.col("no") + 1).alias("no"), "key", "usual", "sample.code", "sample.words")).join(entries.select(*KEYS).distinct(), KEYS, "left_semi")
    wanted = likeness.written(wanted, "missing")
    wanted = likeness.written(wanted.join(present_by_words(wanted, entries, True), [*KEYS, "code", "key"], "left_anti"), "unseen")
    keys = rows.select("condo_id", "no", "key").distinct()
    near = likeness.near_names(wanted, keys, ["condo_id"], "key")
    here = keys.withColumnRenamed("key", "other").join(near, ["condo_id", "other"]).select("condo_id", "no", "key").distinct()
    return wanted.join(here, ["condo_id", "no", "key"], "left_anti").select(*KEYS, "key", "code", "usual")


def missing_expected(entries: DataFrame, pattern: str, months: int = 3, least: float = 500) -> DataFrame:
    """An expense that a building expects: found in each of the last ``months`` months and not now."""
    hits = entries.filter(identity.plain_upper(F.col("description")).rlike(pattern)).groupBy("condo_id", "month", "no").agg(cents(F.sum("amount")).alias("total"))
    frame = W.partitionBy("condo_id").orderBy("no").rangeBetween(1 - months, 0)
    last = hits.withColumn("totals", F.array_sort(F.collect_list("total").over(frame))).withColumn("after", F.lead("no").over(W.partitionBy("condo_id").orderBy("no")))
    usual = middle_of_cents(F.col("totals"))
    gone = last.filter((F.size("totals") == months) & (F.coalesce("after", F.lit(0)) != F.col("no") + 1)).withColumn("usual", usual).filter(F.col("usual") >= least)
    return previous(gone.select(*KEYS, "usual")).join(entries.select(*KEYS).distinct(), KEYS, "left_semi")


def alike_works(objects: DataFrame) -> DataFrame:
    """(condo_id, key, a, b): F17 over the distinct ``works`` (natures, stems) of a vendor key, both ways round, each with itself.

    Two works without a stem in common are alike only if one has no stem at all; these few are joined by the key.
    """
    a, b = (objects.select("condo_id", "key", F.col("work").alias(x)) for x in ("a", "b"))
    stem = lambda rows, x: rows.select("*", F.explode(f"{x}.stems").alias("stem"))
    bare = a.filter(F.size("a.stems") == 0).join(b, ["condo_id", "key"])
    pairs = stem(a, "a").join(stem(b, "b"), ["condo_id", "key", "stem"]).drop("stem").unionByName(bare).unionByName(bare.select("condo_id", "key", F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.filter(identity.same_work(F.col("a.natures"), F.col("a.stems"), F.col("b.natures"), F.col("b.stems"))).distinct()


def work_groups(entries: DataFrame, alike: DataFrame) -> DataFrame:
    """G5's groups: the entries (condo_id, month, key, work, ord) of a vendor in a month joined by chains of works that F17 takes for
    one; ``group`` is the least ord of the chain, ``lead`` the work of that entry."""
    keys = [*KEYS, "key"]
    nodes = likeness.written(entries.groupBy(*keys, "work").agg(F.min("ord").alias("node")), "works")
    one, two = nodes.select(*keys, F.col("work").alias("a"), F.col("node").alias("from")), nodes.select(*keys, F.col("work").alias("b"), F.col("node").alias("to"))
    edges = one.join(alike, ["condo_id", "key", "a"]).join(two, [*keys, "b"]).filter(F.col("from") < F.col("to")).select(*keys, F.col("from").alias("a"), F.col("to").alias("b"))
    grouped = nodes.join(likeness.components(edges, keys), [*keys, "node"], "left").withColumn("group", F.coalesce("component", "node"))
    leads = nodes.select(*keys, F.col("node").alias("group"), F.col("work").alias("lead"))
    return grouped.join(leads, [*keys, "group"]).select(*keys, "work", "group", "lead")


def atypical_amounts(entries: DataFrame, factor: float = 2.5, variable: float = 1.1, least: float = 1000) -> DataFrame:
    """A vendor's entries of one chain of works against the median of what the works like its first entry's cost in the
    history months, two at least; utilities have the lower factor.

    ``kind``: accumulated (two entries or more of alike amounts and two competences), earlier (two competences before this
    month), above, or uncompared (accumulated without two months to compare, two competences before this month).
    """
    rows = keyed(entries).withColumn("work", F.struct(identity.natures(F.col("object")).alias("natures"), identity.stems(F.col("object")).alias("stems")))
    rows = likeness.written(rows.select(*KEYS, "no", "ord", "key", "work", "amount", "description", "vendor", "inst_n", "is_eventual"), "valid")
    alike = likeness.written(alike_works(rows.select("condo_id", "key", "work").distinct()), "alike")
    now = rows.filter(F.col("inst_n").isNull() & ~F.col("is_eventual")).withColumn("competence", identity.competence(F.col("description")))
    groups = likeness.written(work_groups(now, alike), "groups")
    amount = F.col("amount").cast("double")
    utility = identity.is_kind(F.concat_ws(" ", "description", "vendor"), "variable_utility")
    sums = now.join(groups, [*KEYS, "key", "work"]).groupBy(*KEYS, "no", "key", "group", "lead").agg(
        cents(F.sum("amount")).alias("total"), F.count("*").alias("n"), F.bool_or(utility).alias("variable"), F.count_distinct("competence").alias("competences"),
        F.count_distinct(F.when(F.col("competence") < F.col("month"), F.col("competence"))).alias("earlier"), (F.max(amount) - F.min(amount) <= 0.15 * F.avg(amount)).alias("alike"),
    )
    monthly = rows.groupBy("condo_id", "no", "key", F.col("work").alias("b")).agg(cents(F.sum("amount")).alias("cost"))
    costs = groups.select("condo_id", "key", F.col("lead").alias("a")).distinct().join(alike, ["condo_id", "key", "a"]).join(monthly, ["condo_id", "key", "b"])
    costs = costs.groupBy("condo_id", "no", "key", F.col("a").alias("lead")).agg(F.sum("cost").alias("cost"))
    past = costs.withColumn("past", F.array_sort(F.collect_list(F.when(F.col("cost") > 1, F.col("cost"))).over(before("condo_id", "key", "lead")))).drop("cost")
    marked = sums.join(past, ["condo_id", "no", "key", "lead"]).withColumn("total", F.col("total") / 100).withColumn("usual", F.when(F.size("past") >= 2, middle_of_cents(F.col("past"))))
    limit = F.when(F.col("variable"), variable).otherwise(factor)
    above = (F.col("usual") > CENT) & (F.col("total") >= limit * F.col("usual")) & (F.col("total") - F.col("usual") >= least)
    many = (F.col("n") >= 2) & (F.col("competences") >= 2) & F.col("alike")
    kind = F.when(above & many, "accumulated").when(above & (F.col("earlier") >= 2), "earlier").when(above, "above").when(F.col("usual").isNull() & many & (F.col("earlier") >= 2), "uncompared")
    return marked.withColumn("kind", kind).filter("kind is not null").select(*KEYS, "key", F.col("group").alias("ord"), "total", "n", "usual", "variable", "kind")


def reversals(entries: DataFrame, least: float = 500) -> DataFrame:
    """Entries of opposite amounts of one vendor and invoice, the i-th negative with the i-th positive; and APROP entries."""
    rows = entries.withColumn("nf", F.col("invoice"))
    sides = rows.filter(F.abs("amount") >= least).withColumn("size", F.abs("amount")).withColumn("negative", F.col("amount") < 0)
    numbered = sides.withColumn("i", F.row_number().over(W.partitionBy(*KEYS, "key", "nf", "size", "negative").orderBy("ord")))
    both = numbered.withColumn("sides", F.count("*").over(W.partitionBy(*KEYS, "key", "nf", "size", "i"))).filter("sides = 2")
    pairs = both.select(*KEYS, "ord", "code", "amount", F.lit("reversal").alias("kind"))
    appropriated = rows.filter(identity.plain_upper(F.col("description")).rlike(r"\bAPROP\b")).select(*KEYS, "ord", "code", "amount", F.lit("appropriation").alias("kind"))
    return pairs.unionByName(appropriated).groupBy(*KEYS, "ord", "code").agg(F.max("amount").alias("amount"), F.max("kind").alias("kind"))


def duplicates_with_invoice(entries: DataFrame, least: float = 100) -> DataFrame:
    """The same description and amount twice or more in a month, with an invoice number and without installment."""
    # few entries name an invoice: what costs more is asked of these only
    rows = keyed(entries.filter(F.col("invoice_text").isNotNull() & (F.col("amount") >= least)).filter(~F.col("has_installment")))
    return rows.groupBy(*KEYS, F.col("norm_description").alias("description"), "amount").agg(F.count("*").alias("n")).filter("n >= 2")


def deficit_without_transfers(account_month: DataFrame, entries: DataFrame, income: DataFrame, least: float = 1000, share: float = 0.05) -> DataFrame:
    """Ordinary accounts (neither extraordinary nor consolidated) that spent more than they took, transfers between accounts
    left out; net transfers out of an account below zero are a finding of their own."""
    name = norm_text(F.col("account"))
    ordinary = account_month.filter(name.rlike("ORDINARIA|ORDINARIO|CONDOMINIO") & ~name.rlike("EXTRAORDINAR|^CONSOLIDADO"))
    moved_out = entries.filter(identity.plain_upper(F.concat_ws(" ", "category", "description")).contains("TRANSF")).groupBy(*KEYS, "account").agg(F.sum("amount").alias("moved_out"))
    moved_in = income.filter("kind = 'transfer' and amount > 0").groupBy(*KEYS, "account").agg(F.sum("amount").alias("moved_in"))
    zero = F.lit(0).cast("decimal(28,2)")
    rows = ordinary.join(moved_out, [*KEYS, "account"], "left").join(moved_in, [*KEYS, "account"], "left").withColumn("moved_out", F.coalesce("moved_out", zero)).withColumn("moved_in", F.coalesce("moved_in", zero))
    debits, credits = F.col("debits") - F.col("moved_out"), F.col("credits") - F.col("moved_in")
    deficit = (debits - credits >= least) & (debits > credits * (1 + share))
    out = (F.col("moved_out") - F.col("moved_in") >= least) & (F.col("closing") < -CENT)
    return rows.filter(deficit | out).select(*KEYS, "account", (debits - credits).alias("deficit"), (F.col("moved_out") - F.col("moved_in")).alias("net_out"), deficit.alias("is_deficit"), out.alias("is_net_out"))


def ordinary_questions(entries: DataFrame, account_month: DataFrame, least: float = 20000) -> DataFrame:
    """Entries of ``least`` or more on the ordinary account, with the account's balance."""
    rows = entries.filter((F.col("amount") >= least) & norm_text(F.col("account")).startswith("ORDINARIA"))
    return rows.join(account_month.select(*KEYS, "account", "closing"), [*KEYS, "account"], "left").select(*KEYS, "ord", "code", "amount", "closing")


def marketplace_purchases(entries: DataFrame) -> DataFrame:
    """G14, which buildings leave switched off."""
    return entries.filter(identity.is_kind(F.concat_ws(" ", "description", "vendor"), "marketplace")).select(*KEYS, "ord", "code", "amount")


def new_category_six_months(entries: DataFrame) -> DataFrame:
    """Categories of a month that none of the six months before has, where there is history; informative."""
    now = entries.groupBy(*KEYS, "no", "category").agg(F.sum("amount").alias("total"))
    history = entries.select("condo_id", "month", "no").distinct().withColumn("months", F.count("*").over(before("condo_id"))).filter("months > 0").select(*KEYS)
    return now.withColumn("seen", F.count("*").over(before("condo_id", "category"))).filter("seen = 0").join(history, KEYS, "left_semi").select(*KEYS, "category", "total", F.lit(0.5).alias("confidence"))
