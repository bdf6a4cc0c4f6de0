"""Reconciliation of expenses with payments, tax slips, reports and attached documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.functions import documents, identity
from tally.functions.text import account_key, norm_text
from tally.operators import likeness
from tally.operators.identified import cents
from tally.operators.rules import KEYS

TOL = 0.01


def consolidated_by_list(payments: DataFrame, expenses: DataFrame, tolerance: float = TOL) -> DataFrame:
    """A payment that lists two codes or more, all known, whose amounts sum to its total; of several, a code's first payment."""
    listed = payments.filter(F.size("listed") >= 2).select(*KEYS, "payment", "total", F.size("listed").alias("n"), F.explode("listed").alias("code"))
    joined = listed.join(expenses.select(*KEYS, "code", "amount"), [*KEYS, "code"], "left")
    sums = joined.groupBy(*KEYS, "payment").agg(F.max("n").alias("n"), F.count("amount").alias("known"), F.sum("amount").alias("sum"), F.max("total").alias("total"))
    whole = sums.filter((F.col("n") == F.col("known")) & (F.abs(F.col("sum") - F.col("total")) <= tolerance)).select(*KEYS, "payment")
    return joined.join(whole, [*KEYS, "payment"], "left_semi").groupBy(*KEYS, "code").agg(F.min("payment").alias("payment"), F.max("amount").alias("amount"))


def consolidated_by_pool(payments: DataFrame, withholdings: DataFrame, tolerance: float = TOL) -> DataFrame:
    """A payment whose list is cut short: all withholdings of the first listed code's tax, vendor and due date, or without the
    due date, sum to its total and are more than the list."""
    first = payments.select(*KEYS, "payment", "total", F.size("listed").alias("n"), F.col("listed")[0].alias("code"))
    head = first.join(withholdings.select(*KEYS, "code", "tax", "vendor", "due"), [*KEYS, "code"]).drop("code")
    by_due = withholdings.groupBy(*KEYS, "tax", "vendor", "due").agg(F.sum("amount").alias("due_sum"), F.count("*").alias("due_n"))
    by_tax = withholdings.groupBy(*KEYS, "tax", "vendor").agg(F.sum("amount").alias("tax_sum"), F.count("*").alias("tax_n"))
    pools = head.join(by_due, [*KEYS, "tax", "vendor", "due"]).join(by_tax, [*KEYS, "tax", "vendor"])
    fits = lambda s, n: (F.col(n) > F.col("n")) & (F.abs(F.col(s) - F.col("total")) <= tolerance)
    settled = pools.withColumn("pool", F.when(fits("due_sum", "due_n"), "due").when(fits("tax_sum", "tax_n"), "tax")).filter("pool is not null")
    members = withholdings.select(*KEYS, "tax", "vendor", F.col("due").alias("own_due"), "code", "amount")
    out = settled.select(*KEYS, "payment", "tax", "vendor", "due", "pool").join(members, [*KEYS, "tax", "vendor"]).filter((F.col("pool") == "tax") | (F.col("due") == F.col("own_due")))
    return out.groupBy(*KEYS, "code").agg(F.min("payment").alias("payment"), F.max("amount").alias("amount"), F.max("pool").alias("pool"))


def many_to_one(expenses: DataFrame, payments: DataFrame, tolerance: float = TOL) -> DataFrame:
    """Open expenses, two or more, of an orphan payment's date and account that sum to it: a judgement is pending. Each expense is
    consumed once, by the first payment of its date and account that fits."""
    groups = expenses.groupBy(*KEYS, "paid", "account").agg(F.count("*").alias("expenses"), F.sum("amount").alias("sum")).filter("expenses >= 2")
    fits = payments.join(groups, [*KEYS, "paid", "account"]).filter(F.abs(F.col("total") - F.col("sum")) <= tolerance)
    return fits.groupBy(*KEYS, "paid", "account").agg(F.min("payment").alias("payment"), F.max("sum").alias("total"), F.max("expenses").alias("expenses"), F.lit(0.6).alias("confidence"))


def fiscal_amounts(expenses: DataFrame, reports: DataFrame) -> DataFrame:
    """Open expenses whose amount a fiscal report lists."""
    listed = reports.select(*KEYS, "report", F.explode("amounts").alias("amount")).groupBy(*KEYS, "amount").agg(F.min("report").alias("report"))
    return expenses.join(listed, [*KEYS, "amount"]).select(*KEYS, "code", "amount", "report", F.lit(0.8).alias("confidence"))


def orphan_payments(payments: DataFrame, expenses: DataFrame) -> DataFrame:
    """Payments that J4 doesn't settle, one finding for each."""
    used = many_to_one(expenses, payments).select(*KEYS, "payment")
    return payments.join(used, [*KEYS, "payment"], "left_anti").select(*KEYS, "payment", "total")


def unpaired(entries: DataFrame, settled: DataFrame, covers: DataFrame) -> DataFrame:
    """Expenses that no payment settles: exempt by nature (F20), not readable where a document is there, else without evidence."""
    once = entries.groupBy(*KEYS, "code").agg(F.min(F.struct("ord", "description", "category", "amount")).alias("x"), F.count("*").alias("n")).filter("n = 1").select(*KEYS, "code", "x.*")
    rows = once.join(settled.select(*KEYS, "code").distinct(), [*KEYS, "code"], "left_anti").join(covers.select(*KEYS, "code").distinct().withColumn("covered", F.lit(True)), [*KEYS, "code"], "left")
    exempt = identity.exempt_reason(F.col("description"), F.col("category"))
    kind = F.when(exempt.isNotNull(), "verified").when(F.col("covered"), "unverifiable").otherwise("missing_evidence")
    return rows.select(*KEYS, "code", "amount", kind.alias("type"), exempt.alias("reason"))


def listing_vs_attachment(entries: DataFrame, attachments: DataFrame, tolerance: float = TOL) -> DataFrame:
    """Each listed expense against its document; months without any document are left out."""
    month = attachments.select(*KEYS).distinct()
    once = entries.groupBy(*KEYS, "code").agg(F.min(F.struct("ord", "description", "category", "amount")).alias("x")).select(*KEYS, "code", "x.*")
    exempt = identity.exempt_reason(F.col("description"), F.col("category")).isNotNull()
    once = once.select(*KEYS, "code", "amount", exempt.alias("exempt"), identity.tax_of(F.col("description")).isNotNull().alias("taxed"))
    rows = once.join(attachments, [*KEYS, "code"], "left").join(month, KEYS, "left_semi")
    gap = F.col("read_amount") - F.col("amount")
    shown = documents.amount_in_text(F.col("raw_text"), F.col("amount")) & (F.length("raw_text") >= 60)
    kind = (
        F.when(F.col("exempt"), "exempt").when(F.col("raw_text").isNull(), "missing_evidence").when(F.col("raw_text") == "", "unreadable")
        .when(F.abs(gap) <= tolerance, "verified").when(F.col("is_slip") & (gap > 0) & F.col("taxed"), "slip_larger_than_withholding")
        .when(shown, "amount_in_text").otherwise("divergent_amount")
    )
    confidence = F.when(kind == "slip_larger_than_withholding", 0.5).when(kind == "divergent_amount", 0.9).otherwise(1.0)
    return rows.select(*KEYS, "code", "amount", "read_amount", kind.alias("type"), confidence.alias("confidence"))


def invoice_missing(entries: DataFrame, attachments: DataFrame) -> DataFrame:
    """A listed invoice whose document has no invoice's words outside payment and slip pages, unless a document of another
    code in that month holds an invoice page with the number."""
    listed = entries.filter(F.col("invoice_text").isNotNull() & ~F.col("is_withholding")).groupBy(*KEYS, "code", F.col("invoice_text").alias("number")).agg(F.min("amount").alias("amount"))
    pages = documents.pages_of(attachments.select(*KEYS, "code", "raw_text"))
    state = pages.groupBy(*KEYS, "code").agg(F.bool_or(documents.has_invoice_marker(F.col("page_text"))).alias("invoice"), F.bool_or(~documents.is_payment_page(F.col("page_text")) & ~documents.is_bank_slip(F.col("page_text"))).alias("other_page"))
    bare = listed.join(state, [*KEYS, "code"]).filter("not invoice")
    # numbers of invoice pages, to meet the listed numbers by equality
    numbers = pages.filter(documents.has_invoice_marker(F.col("page_text")) & ~documents.is_payment_page(F.col("page_text"))).select(*KEYS, F.col("code").alias("holder"), F.explode(F.array_distinct(F.regexp_extract_all("page_text", F.lit("([0-9]{2,})"), F.lit(1)))).alias("number"))
    elsewhere = bare.join(numbers, [*KEYS, "number"]).filter("holder <> code").select(*KEYS, "code", "number").distinct()
    return bare.join(elsewhere, [*KEYS, "code", "number"], "left_anti").select(*KEYS, "code", "number", "amount")


def document_facts(attachments: DataFrame) -> DataFrame:
    """Pages of the attached documents and what each says."""
    pages = documents.pages_of(attachments.select(*KEYS, "code", "raw_text", "read_amount"))
    text = F.col("page_text")
    return pages.select(
        *KEYS, "code", documents.record_key(F.col("page").cast("string"), F.col("code")).alias("record"), documents.amount_in_text(text, F.col("read_amount")).alias("shows_amount"), documents.has_invoice_marker(text).alias("invoice"),
        documents.is_payment_page(text).alias("payment"), documents.is_bank_slip(text).alias("slip"), documents.slip_id(text).alias("slip_id"), documents.total_paid(text).alias("total"),
    )


def pages_shared(entries: DataFrame, attachments: DataFrame) -> DataFrame:
    """Withholdings by the agency's slip, and expenses whose amount the page shows, count as verified."""
    rows = entries.groupBy(*KEYS, "code").agg(F.min(F.struct("ord", "amount", "is_withholding")).alias("x")).select(*KEYS, "code", "x.*").join(attachments, [*KEYS, "code"])
    how = F.when(F.col("is_withholding") & F.col("is_slip"), "withholding_slip").when(documents.amount_in_text(F.col("raw_text"), F.col("amount")), "amount_visible")
    return rows.select(*KEYS, "code", "amount", how.alias("how")).filter("how is not null")


def sum_vs_declared(entries: DataFrame, declared: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """A2, A3: entries per account against the account's declared total; accounts without entries count as zero."""
    sums = entries.groupBy(*KEYS, "account").agg(F.sum("amount").alias("entries"))
    rows = declared.join(sums, [*KEYS, "account"], "left").withColumn("entries", F.coalesce("entries", F.lit(0).cast("decimal(28,2)")))
    gap = F.col("entries") - F.col("declared")
    return rows.filter(F.abs(gap) > tolerance).select(*KEYS, "account", "entries", "declared", gap.alias("gap"))


def category_vs_balance(evidence: DataFrame, balance: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """A4: what the evidence of a category sums to against the balance's total; none counts as zero."""
    sums = evidence.groupBy(*KEYS, "category").agg(F.sum("paid_amount").alias("evidence"))
    rows = balance.join(sums, [*KEYS, "category"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(0).cast("decimal(28,2)")))
    gap = F.col("evidence") - F.col("declared")
    return rows.filter(F.abs(gap) > tolerance).select(*KEYS, "category", "declared", "evidence", gap.alias("gap"))


def repeated_documents(entries: DataFrame) -> DataFrame:
    """One vendor's document (or due date) and amount twice or more."""
    document = F.coalesce("invoice_text", F.col("due").cast("string"))
    return entries.filter("amount > 0").groupBy(*KEYS, "key", document.alias("document"), "amount").agg(F.count("*").alias("n"), F.lit(0.8).alias("confidence")).filter("n >= 2")


def slip_groups(slips: DataFrame, pool: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Expenses that point at one slip close with its amount by themselves, with the unread withholdings of the month, or
    not at all."""
    groups = slips.groupBy(*KEYS, "auth_id").agg(F.count("*").alias("n"), F.sum("amount").alias("sum"), F.mode("document_amount", deterministic=True).alias("document_amount")).filter("n >= 2")
    spare = pool.groupBy(*KEYS, "account").agg(F.sum("amount").alias("spare"))
    keyed = groups.join(slips.select(*KEYS, "auth_id", "account").distinct(), [*KEYS, "auth_id"]).join(spare, [*KEYS, "account"], "left")
    rest = F.col("document_amount") - F.col("sum")
    state = F.when(F.abs(rest) <= tolerance, "closes").when(F.abs(rest - F.coalesce("spare", F.lit(0).cast("decimal(28,2)"))) <= tolerance, "closes_with_unread").otherwise("open")
    return keyed.select(*KEYS, "auth_id", "n", "sum", "document_amount", state.alias("state"))


def sum_limits(values: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, low, high): the least and the largest sum of no, one, ... and ``most`` of a key's items, by their numbered values."""
    ends = values.withColumn("of", F.max("v").over(W.partitionBy(*keys))).filter((F.col("v") <= most) | (F.col("v") > F.col("of") - most))
    value = F.struct("cents", "n")
    listed = ends.groupBy(*keys).agg(F.collect_list(F.when(F.col("v") <= most, value)).alias("low"), F.collect_list(F.when(F.col("v") > F.col("of") - most, value)).alias("high"))

    def summed(name: str, ascending: bool) -> Column:
        each = F.flatten(F.transform(F.sort_array(name, ascending), lambda x: F.array_repeat(x["cents"], x["n"])))
        return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda j: F.aggregate(F.slice(each, F.lit(1), j), F.lit(0).cast("long"), lambda total, x: total + x)).alias(name)

    return listed.select(*keys, summed("low", True), summed("high", False))


def half_sums(values: DataFrame, limits: DataFrame, keys: list[str], size: int, members: int, upper: bool) -> DataFrame:
    """What the ``members`` least (the largest with ``upper``) of a subset of ``size`` items can be, each value as often as it is there
    (``n``): (keys, members, sum, first, last, spare), members ascending; ``spare`` is how often the last one could be taken on.

    A beginning is left where no subset that goes on with it reaches the sums ``lo`` to ``hi`` that a key seeks: what follows is no less
    than its last member, what a half leaves to the other one is no larger (no less) than its first (last), and ``low`` and ``high``
    hold for everything.
    """
    other, nothing = size - members, F.lit(None).cast("long")
    rows = limits.select(*keys, "lo", "hi", "low", "high", F.array().cast("array<int>").alias("members"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("first"), nothing.alias("least"), F.lit(0).alias("last"), F.lit(0).alias("spare"))
    for taken in range(1, members + 1):
        same = F.col("v") == F.col("last")
        total, first = F.col("sum") + F.col("cents"), F.coalesce("least", "cents")
        after = (members if upper else size) - taken
        fewest = total + F.col("cents") * after + (F.col("low")[other] if upper else 0)
        most = total + F.col("high")[after] + (first * other if upper else 0)
        follows = (F.col("v") > F.col("last")) | (same & (F.col("spare") > 0))
        grown = rows.join(values.select(*keys, "v", "cents", "n"), keys).filter(follows & (fewest <= F.col("hi")) & (most >= F.col("lo")))
        spare = F.when(same, F.col("spare")).otherwise(F.col("n")) - 1
        rows = grown.select(*keys, "lo", "hi", "low", "high", F.array_append("members", F.col("v")).alias("members"), total.alias("sum"), F.coalesce("first", "v").alias("first"), first.alias("least"), F.col("v").alias("last"), spare.alias("spare"))
    return rows.drop("lo", "hi", "low", "high", "least")


def subset_sums(items: DataFrame, targets: DataFrame, max_n: int = 4, off: int = 1, keys: tuple[str, ...] = (*KEYS, "account")) -> DataFrame:
    """Per key, the smallest subset of its items (ord, code, amount), of at most ``max_n``, that sums to the target within ``off`` cents.

    Of equal sizes the first counts, items ordered by ord and code. Items of one amount stand for each other, and the first of them
    are taken first: a subset is chosen by amounts. It is its lower half and its upper half, which meet by equality of what the one
    lacks and the other sums to; sizes are tried in turn, for the targets still open. All amounts count: ``max_n`` bounds the subset,
    and halves that can't reach a target are left. A target in the middle of what n different amounts sum to still has about n to the
    (max_n / 2) half sums, which Spark shuffles by key and sum. (keys, target, items, used, codes), ``used`` null where no subset fits.
    """
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("ord", "code")
    listed = likeness.written(items.select(*keys, "code", cents(F.col("amount")).alias("cents"), F.row_number().over(order).alias("at")), "items")
    copies = listed.select(*keys, "cents", "at").withColumn("copy", F.row_number().over(W.partitionBy(*keys, "cents").orderBy("at"))).filter(F.col("copy") <= max_n)
    values = copies.groupBy(*keys, "cents").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list("at")).alias("ats"))
    values = likeness.written(values.withColumn("v", F.row_number().over(W.partitionBy(*keys).orderBy("cents"))), "values")
    ends = likeness.written(sum_limits(values, keys, max_n), "limits")
    wanted = likeness.written(targets.select(*keys, "target", cents(F.col("target")).alias("want")).distinct(), "targets")
    found, left = None, wanted
    # one item and two cost little: they are sought together
    for sizes in [tuple(range(1, min(max_n, 2) + 1)), *((size,) for size in range(3, max_n + 1))]:
        limits = ends.join(left.groupBy(*keys).agg((F.min("want") - off).alias("lo"), (F.max("want") + off).alias("hi")), keys)
        every = []
        for size in sizes:
            lower = left.withColumn("sought", F.explode(F.sequence(F.col("want") - off, F.col("want") + off))).join(half_sums(values, limits, keys, size, size - size // 2, False).drop("first"), keys)
            lower = lower.select(*keys, "target", "members", "last", "spare", (F.col("sought") - F.col("sum")).alias("rest"))
            upper = half_sums(values, limits, keys, size, size // 2, True).select(*keys, F.col("members").alias("others"), F.col("sum").alias("rest"), "first")
            again = F.size(F.filter("others", lambda v: v == F.col("last")))
            fits = F.col("first").isNull() | (F.col("first") > F.col("last")) | ((F.col("first") == F.col("last")) & (again <= F.col("spare")))
            every.append(lower.join(upper, [*keys, "rest"]).filter(fits).select(*keys, "target", F.concat("members", "others").alias("taken")))
        met = likeness.written(reduce(DataFrame.unionByName, every), "met")
        least = met.groupBy(*keys, "target").agg(F.min(F.size("taken")).alias("used"))
        short = met.join(least, [*keys, "target"]).filter(F.size("taken") == F.col("used")).distinct()
        each = short.select(*keys, "target", "taken", "used", F.explode(F.array_distinct("taken")).alias("v")).join(values.select(*keys, "v", "ats"), [*keys, "v"])
        ats = each.withColumn("ats", F.slice("ats", F.lit(1), F.size(F.filter("taken", lambda v: v == F.col("v")))))
        members = ats.groupBy(*keys, "target", "taken", "used").agg(F.array_sort(F.flatten(F.collect_list("ats"))).alias("members"))
        best = likeness.written(members.groupBy(*keys, "target", "used").agg(F.min("members").alias("members")), "subsets")
        found = best if found is None else found.unionByName(best)
        left = likeness.written(left.join(best, [*keys, "target"], "left_anti"), "open")
        if left.isEmpty():
            break
    sizes = listed.groupBy(*keys).agg(F.count("*").alias("items"))
    codes = found.select(*keys, "target", F.explode("members").alias("at")).join(listed, [*keys, "at"]).groupBy(*keys, "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), ",").alias("codes"))
    rows = wanted.join(sizes, keys, "left").join(found.drop("members"), [*keys, "target"], "left").join(codes, [*keys, "target"], "left")
    return rows.select(*keys, "target", F.coalesce("items", F.lit(0)).alias("items"), "used", "codes")


def merged_balance(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second source's opening and delinquency where they aren't zero; the closing follows."""
    rows = first.join(second, KEYS, "full")
    opening = F.coalesce(F.nullif("second_opening", F.lit(0).cast("decimal(28,2)")), "opening")
    return rows.select(*KEYS, opening.alias("opening"), (opening + F.col("credits") - F.col("debits")).alias("closing"), F.coalesce(F.nullif("delinquent", F.lit(0).cast("decimal(28,2)")), F.lit(0).cast("decimal(28,2)")).alias("delinquent"))


def debit_net_of_transfers(account_month: DataFrame, entries: DataFrame) -> DataFrame:
    """An account's debits less its transfers to other accounts."""
    moved = entries.filter("description like 'TRANSF%'").groupBy(*KEYS, "account").agg(F.sum("amount").alias("moved"))
    net = F.col("debits") - F.coalesce("moved", F.lit(0).cast("decimal(28,2)"))
    return account_month.join(moved, [*KEYS, "account"], "left").select(*KEYS, "account", net.alias("net_debits"), "yield_amt")


def income_source(account_month: DataFrame, income: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """Which income lines explain an account's credits: the details, the details without negatives, or only the position."""
    detail = income.groupBy(*KEYS, "account").agg(F.sum("amount").alias("detail"), F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("positive"))
    rows = account_month.join(detail, [*KEYS, "account"], "left")
    source = F.when(F.abs(F.col("detail") - F.col("credits")) <= tolerance, "detail").when(F.abs(F.col("positive") - F.col("credits")) <= tolerance, "positive").otherwise("position")
    return rows.select(*KEYS, "account", "credits", source.alias("source"))


def missing_tax_ids(attachments: DataFrame, entries: DataFrame) -> DataFrame:
    """Automatic payments whose text names no payee of the entry; one finding for each code."""
    payee = F.substring(F.col("key"), 1, 4)
    rows = attachments.filter(documents.is_payment_page(F.col("raw_text"))).join(entries.select(*KEYS, "code", "key", "vendor").distinct(), [*KEYS, "code"])
    known = (F.length(payee) == 4) & F.upper("raw_text").contains(payee)
    return rows.groupBy(*KEYS, "code").agg(F.bool_or(known | F.col("vendor").isNotNull()).alias("known"), F.max("read_amount").alias("amount")).filter("not known").select(*KEYS, "code", "amount")


def typed_evidence(attachments: DataFrame) -> DataFrame:
    """Documents without a listing: each type has a fixed verdict and confidence."""
    # fixed values: type of document, verdict, confidence
    verdicts = [("invoice", "verified", 0.85), ("payment", "verified", 1.0), ("slip", "unverifiable", 0.8), ("blank", "unverifiable", 0.4)]
    text = F.col("raw_text")
    kind = F.when(text == "", "blank").when(documents.is_payment_page(text), "payment").when(documents.has_invoice_marker(text), "invoice").otherwise("slip")
    table = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("verdict"), F.lit(c).alias("confidence")) for k, v, c in verdicts))
    found = F.get(F.filter(table, lambda x: x["kind"] == F.col("kind")), F.lit(0))
    return attachments.withColumn("kind", kind).select(*KEYS, "code", "kind", found["verdict"].alias("verdict"), found["confidence"].alias("confidence"))


def signs_reconciled(report: DataFrame, extracted: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Amounts of two readings: equal, equal but for the sign (the reading from the file counts), or different."""
    rows = report.join(extracted, [*KEYS, "account"])
    state = F.when(F.abs(F.col("reported") - F.col("read")) <= tolerance, "equal").when(F.abs(F.abs("reported") - F.abs("read")) <= tolerance, "sign").otherwise("different")
    return rows.select(*KEYS, "account", F.when(state == "sign", F.col("read")).otherwise(F.col("reported")).alias("amount"), state.alias("state"))


# fixed values: words that two account names may differ in
ACCOUNT_STOP = "DE DA DO E P S A O C COM PARA".split()
LIKE, MARGIN = 0.82, 0.05


def resolved_names(now: DataFrame, known: DataFrame) -> DataFrame:
    """For each ``name`` of a building's month the one of ``known`` that it stands for, and by which level: 1 equal, 2 equal letters
    and digits (the first by name), 3 the only one that begins with it or that it begins with (six letters or more), 4 the only
    one whose words hold its words or the other way round, 5 the likest (edits, as F15), 0.82 or more and 0.05 ahead of the next.
    A name that no level settles stays as it is, without a level.
    """
    key = lambda c: account_key(F.col(c))
    rows = likeness.written(now.select(*KEYS, "name").distinct().select(*KEYS, "name", norm_text(F.col("name")).alias("norm"), key("name").alias("key")), "names")
    others = likeness.written(known.select(*KEYS, "known").distinct().select(*KEYS, "known", norm_text(F.col("known")).alias("norm"), key("known").alias("key")), "known")
    first = lambda level, on: rows.select(*KEYS, "name", on).join(others.select(*KEYS, "known", on), [*KEYS, on]).select(*KEYS, "name", "known", F.lit(level).alias("level"), F.lit(1.0).alias("like"))
    # the shorter of two keys is one of the longer's beginnings
    starts = lambda df, c: df.filter("length(key) >= 6").select(*KEYS, c, F.explode(F.transform(F.sequence(F.lit(6), F.length("key")), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("key"))
    begins = rows.filter("length(key) >= 6").select(*KEYS, "name", "key").join(starts(others, "known"), [*KEYS, "key"]).unionByName(starts(rows, "name").join(others.select(*KEYS, "known", "key"), [*KEYS, "key"]))
    third = begins.select(*KEYS, "name", "known").distinct().withColumn("level", F.lit(3)).withColumn("like", F.lit(1.0))
    words = lambda df, c: df.select(*KEYS, c, F.array_distinct(F.filter(F.split("norm", " "), lambda t: (t != "") & ~t.isin(*ACCOUNT_STOP))).alias(f"{c}_words")).filter(F.size(f"{c}_words") > 0)
    mine, theirs = words(rows, "name"), words(others, "known")
    shared = mine.withColumn("word", F.explode("name_words")).join(theirs.withColumn("word", F.explode("known_words")), [*KEYS, "word"])
    sizes = shared.groupBy(*KEYS, "name", "known").agg(F.count("*").alias("both"), F.max(F.size("name_words")).alias("n"), F.max(F.size("known_words")).alias("m"))
    fourth = sizes.filter(F.col("both") == F.least("n", "m")).select(*KEYS, "name", "known", F.lit(4).alias("level"), F.lit(1.0).alias("like"))
    # whoever matters as best or second best is at most 0.23 away
    near = likeness.near_names(rows.select(*KEYS, "norm"), others.select(*KEYS, "norm"), KEYS, "norm", (23, 100), None)
    like = 1 - F.levenshtein("norm", "other") / F.greatest(F.length("norm"), F.length("other"))
    fifth = near.withColumn("like", like).join(rows, [*KEYS, "norm"]).join(others.select(*KEYS, "known", F.col("norm").alias("other")), [*KEYS, "other"]).select(*KEYS, "name", "known", F.lit(5).alias("level"), "like")
    every = first(1, "norm").unionByName(first(2, "key")).unionByName(third).unionByName(fourth).unionByName(fifth)
    # per level: how many, the first by name, and the two likest
    tops = every.groupBy(*KEYS, "name", "level").agg(F.count("*").alias("n"), F.min("known").alias("least"), F.max(F.struct("like", "known")).alias("best"), F.slice(F.sort_array(F.collect_list("like"), asc=False), 1, 2).alias("likes"))
    ahead = (F.size("likes") == 1) | (F.get("likes", F.lit(0)) - F.get("likes", F.lit(1)) >= MARGIN)
    fits = F.when(F.col("level") <= 2, True).when(F.col("level") <= 4, F.col("n") == 1).otherwise((F.col("best.like") >= LIKE) & ahead)
    chosen = tops.filter(fits).groupBy(*KEYS, "name").agg(F.min(F.struct("level", F.when(F.col("level") == 5, F.col("best.known")).otherwise(F.col("least")).alias("known"))).alias("x"))
    return rows.join(chosen, [*KEYS, "name"], "left").select(*KEYS, "name", F.coalesce("x.known", "name").alias("canonical"), "x.level")


def canonical_names(now: DataFrame, past: DataFrame) -> DataFrame:
    """A name as the month before wrote it."""
    return resolved_names(now, past.select("condo_id", F.add_months("month", 1).alias("month"), F.col("name").alias("known")))


def paired_by_value(credits: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each position credit consumes one receipt of its amount, the i-th the i-th; credits left over become income lines."""
    by = [*KEYS, "account", "amount"]
    number = lambda rows: rows.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("ord")))
    joined = number(credits).join(number(receipts).select(*by, "i", F.col("ord").alias("receipt")), [*by, "i"], "left")
    return joined.select(*by, "ord", "receipt", F.when(F.col("receipt").isNull(), "position_only").otherwise("paired").alias("state"))


def inferred_transfers(residuals: DataFrame, tolerance: int = 1) -> DataFrame:
    """What a sender's entries leave unexplained equals, to the cent, the unexplained credit of exactly one other account, else the
    sum of exactly one pair: (from_account, to_account, amount, kind, description, net_debits), a row for each receiver.

    The rows are income lines of the receivers; ``net_debits`` are the sender's debits without the transfer. A credit that
    several senders would take goes to the first of them by name, and the others stay unexplained.
    """
    out = residuals.filter("debit_rest > 0.011").select(*KEYS, F.col("account").alias("from_account"), "debits", F.col("debit_rest").alias("sent"), cents(F.col("debit_rest")).alias("rest"))
    into = likeness.written(residuals.filter("credit_rest > 0.011").select(*KEYS, "account", F.col("credit_rest").alias("amount"), cents(F.col("credit_rest")).alias("cents")), "credits")
    sought = out.withColumn("sought", F.explode(F.sequence(F.col("rest") - tolerance, F.col("rest") + tolerance)))
    line = F.struct("account", "amount")
    singles = sought.join(into.withColumnRenamed("cents", "sought"), [*KEYS, "sought"]).filter("account <> from_account").withColumn("to", F.array(line))
    one, two = into.select(*KEYS, line.alias("one"), F.col("cents").alias("c1")), into.select(*KEYS, line.alias("two"), F.col("cents").alias("c2"))
    # a building's month has a few accounts; the pairs meet the senders by their sum
    pairs = one.join(two, KEYS).filter("one.account < two.account").withColumn("sought", F.col("c1") + F.col("c2"))
    doubles = sought.join(pairs, [*KEYS, "sought"]).filter("one.account <> from_account and two.account <> from_account").withColumn("to", F.array("one", "two"))
    each = [x.select(*KEYS, "from_account", "debits", "sent", F.lit(kind).alias("kind"), "to") for kind, x in (("single", singles), ("pair", doubles))]
    sure = each[0].unionByName(each[1]).groupBy(*KEYS, "from_account", "debits", "sent", "kind").agg(F.count("*").alias("n"), F.first("to").alias("to")).filter("n = 1")
    best = sure.groupBy(*KEYS, "from_account", "debits", "sent").agg(F.max_by(F.struct("kind", "to"), "kind").alias("x")).select(*KEYS, "from_account", "debits", "sent", "x.kind", "x.to")
    legs = best.select(*KEYS, "from_account", "debits", "sent", "kind", F.size("to").alias("legs"), F.inline("to"))
    held = legs.withColumn("turn", F.min("from_account").over(W.partitionBy(*KEYS, "account"))).filter("turn = from_account")
    whole = held.withColumn("left", F.count("*").over(W.partitionBy(*KEYS, "from_account"))).filter("left = legs")
    return whole.select(*KEYS, "from_account", F.col("account").alias("to_account"), "amount", "kind", F.concat(F.lit("transferência recebida de "), "from_account").alias("description"), (F.col("debits") - F.col("sent")).alias("net_debits"))


def reclassified_vendors(entries: DataFrame) -> DataFrame:
    """A vendor in a category that the month before lacks, with the category it had there."""
    now = entries.filter("key <> ''").groupBy(*KEYS, "key", "category").agg(F.sum("amount").alias("total"))
    past = now.select("condo_id", F.add_months("month", 1).alias("month"), "key", F.col("category").alias("past_category"))
    had = past.select(*KEYS, F.col("past_category").alias("category")).distinct()
    new = now.join(had, [*KEYS, "category"], "left_anti").join(past.select(*KEYS).distinct(), KEYS, "left_semi")
    return new.join(past, [*KEYS, "key"]).groupBy(*KEYS, "key", "category").agg(F.max("total").alias("total"), F.max_by("past_category", F.struct(F.length("past_category"), "past_category")).alias("past_category"))
