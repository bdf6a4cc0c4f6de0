"""From findings to reviewed findings, and audits of what is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.functions.text import account_key, format_brl
from tally.operators import likeness
from tally.operators.matching import subset_sums
from tally.operators.rules import KEYS

ID = [*KEYS, "type", "subject"]
# fixed values: severities of a review
SEVERITIES = ["informative", "attention", "high", "critical"]
# fixed values: types that stay visible in months of narrowed scope
SCOPED = ["missing_evidence", "duplicate", "unverifiable"]


def narrate(findings: DataFrame) -> DataFrame:
    """Title, body and question of a finding from its type's template."""
    money = format_brl(F.col("amount"))
    title = F.when(F.col("type") == "negative_income", "Receita negativa").when(F.col("type") == "balance_continuity", "Saldo anterior diverge").otherwise("Lançamento em duplicidade")
    body = F.concat(title, F.lit(": "), "subject", F.lit(", "), money)
    question = F.when(F.col("type") == "negative_income", F.concat(F.lit("A que se refere "), money, F.lit("?"))).when(F.col("type") == "balance_continuity", "Por que o saldo mudou?")
    return findings.select(*ID, "amount", title.alias("title"), body.alias("body"), question.alias("question"))


def invalid_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """What is wrong with the reviews: no finding, no review, unknown severity, changed without a reason, confidence out of
    range, empty text. A sound set gives no rows."""
    both = findings.select(*ID, F.lit(True).alias("is_found")).join(reviews.withColumn("is_reviewed", F.lit(True)), ID, "full")
    faults = F.array_compact(
        F.array(
            F.when(F.col("is_found").isNull(), "unknown_finding"), F.when(F.col("is_reviewed").isNull(), "not_reviewed"), F.when(F.col("is_reviewed") & ~F.col("severity").isin(*SEVERITIES), "severity"),
            F.when(F.col("is_reviewed") & (F.col("severity") != F.col("proposed")) & F.col("reason").isNull(), "no_reason"), F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence"), F.when(F.trim("body") == "", "no_text"),
        )
    )
    return both.select(*ID, F.explode(faults).alias("fault"))


def apply_visual_checks(findings: DataFrame, checks: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """A check of the same type, subject and amount makes a finding informative, once for each check; a real divergence keeps it
    open."""
    order = W.partitionBy(*ID).orderBy("amount", "rule")
    numbered = findings.withColumn("i", F.row_number().over(order))
    counted = checks.withColumn("i", F.row_number().over(W.partitionBy(*ID).orderBy("checked_amount", F.col("real_divergence").cast("int"))))
    rows = numbered.join(counted.select(*ID, "i", "checked_amount", "real_divergence"), [*ID, "i"], "left")
    hit = F.coalesce(F.abs(F.col("amount") - F.col("checked_amount")) <= tolerance, F.lit(False))
    state = F.when(hit & ~F.col("real_divergence"), "informative").otherwise("open")
    return rows.select(*ID, "rule", "amount", state.alias("state"))


def apply_rewrites(narrated: DataFrame, rewrites: DataFrame) -> DataFrame:
    """P5: title, body and question of a rewrite stand in for the finding's own."""
    return narrated.join(rewrites, ID, "left").select(*ID, "amount", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("title", "body", "question")))


def scope_filter(findings: DataFrame, months: DataFrame) -> DataFrame:
    """In months of narrowed scope only findings of missing or faulty evidence stay."""
    rows = findings.join(months.select(*KEYS).distinct().withColumn("narrow", F.lit(True)), KEYS, "left")
    return rows.filter(F.col("narrow").isNull() | F.col("type").isin(*SCOPED)).drop("narrow")


def add_manual(findings: DataFrame, manual: DataFrame) -> DataFrame:
    """Configured findings take the place of their own earlier copies, so that adding them twice changes nothing."""
    return findings.join(manual.select(*ID).distinct(), ID, "left_anti").select(*ID, "rule", "amount").unionByName(manual.select(*ID, "rule", "amount").distinct())


def scope_notices(expense: DataFrame, evidence: DataFrame) -> DataFrame:
    """Months with a listing and no attachment at all."""
    listed = expense.groupBy(*KEYS).agg(F.count("*").alias("listed"))
    return listed.join(evidence.select(*KEYS).distinct(), KEYS, "left_anti")


def repeated_values(attachments: DataFrame, least: int = 2) -> DataFrame:
    """Documents in whose text the value read occurs ``least`` times or more."""
    value = F.translate(F.format_number(F.abs("read_amount"), 2), ",.", ".,")
    n = F.size(F.split(F.col("raw_text"), F.concat(F.lit("\\Q"), value, F.lit("\\E")))) - 1
    return attachments.select(*KEYS, "code", n.alias("times")).filter(F.col("times") >= least)


def summary_vs_cashbook(expense: DataFrame, account_month: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The categories' total against the cash book's."""
    categories = expense.groupBy(*KEYS).agg(F.sum("amount").alias("categories"))
    book = account_month.groupBy(*KEYS).agg(F.sum("debits").alias("cashbook"))
    return categories.join(book, KEYS).filter(F.abs(F.col("categories") - F.col("cashbook")) > tolerance)


def withdrawn_findings(reviewed: DataFrame, names: DataFrame) -> DataFrame:
    """The waived findings with the building's name."""
    return reviewed.filter("state = 'informative'").join(names, "condo_id").select(*KEYS, "name", "type", "subject", "amount")


def fronted(findings: DataFrame, kind: str = "duplicate") -> DataFrame:
    """K5: findings in order, those of one type in front."""
    order = W.partitionBy(*KEYS).orderBy(F.when(F.col("type") == kind, 0).otherwise(1), "rule", "subject", "amount")
    return findings.select(*ID, "rule", "amount").withColumn("place", F.row_number().over(order))


def source_vs_published(source: DataFrame, published: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Q1: fields of the source against those published, per building and over all (null): ok, warn (secondary fields), diff
    (critical ones), missing; secondary fields count where the published one isn't zero."""
    fields = {"opening": True, "credits": True, "debits": True, "closing": True, "yield_amt": False}
    a = source.select(*KEYS, *(F.col(c).alias(f"a_{c}") for c in fields))
    b = published.select(*KEYS, *(F.col(c).alias(f"b_{c}") for c in fields))
    each = [F.struct(F.lit(c).alias("field"), F.lit(critical).alias("critical"), F.col(f"a_{c}").cast("decimal(28,2)").alias("x"), F.col(f"b_{c}").cast("decimal(28,2)").alias("y")) for c, critical in fields.items()]
    rows = a.join(b, KEYS, "full").select(*KEYS, F.inline(F.array(*each)))
    state = F.when(F.col("x").isNull() | F.col("y").isNull(), "missing").when(~F.col("critical") & (F.col("y") == 0), "skip").when(F.abs(F.col("x") - F.col("y")) <= tolerance, "ok").when(F.col("critical"), "diff").otherwise("warn")
    return rows.withColumn("state", state).rollup("condo_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("ok", "warn", "diff", "skip", "missing")))


def untraced_facts(findings: DataFrame, expense: DataFrame, account_month: DataFrame) -> DataFrame:
    """Q3: amounts of findings that stand in no entry and no account balance of their month."""
    numbers = expense.select(*KEYS, F.abs("amount").alias("value")).unionByName(account_month.select(*KEYS, F.explode(F.array(F.abs("opening"), F.abs("closing"), F.abs("credits"), F.abs("debits"))).alias("value"))).distinct()
    return findings.withColumn("value", F.abs("amount").cast("decimal(18,2)")).join(numbers.withColumn("value", F.col("value").cast("decimal(18,2)")), [*KEYS, "value"], "left_anti").select(*ID, "amount")


#: Letters and digits of a description that a fact is traced by, at least and at most, and the length of a text's segments.
LEAST_PREFIX, PREFIX, SEGMENT = 8, 25, 64


def text_segments(lines: DataFrame) -> DataFrame:
    """(condo_id, month, segment, own): the letters and digits of a month's lines (ord, line), cut into segments that go on with what
    follows their ``own`` letters, so that a description that goes over the end of a line is found.

    A line takes what follows from the lines behind it, each of which has a letter at least: no row holds a month's text.
    """
    rows = lines.select(*KEYS, "ord", account_key(F.col("line")).alias("key")).filter("key <> ''")
    order, told = W.partitionBy(*KEYS).orderBy("ord", "key"), PREFIX - 1
    rows, reach = rows.withColumn("begun", F.substring("key", 1, told)), 1
    while reach < told:  # what is told from a line on, by twice as many lines in each turn
        rows = rows.withColumn("begun", F.substring(F.concat("begun", F.lead("begun", reach, "").over(order)), 1, told))
        reach *= 2
    text = rows.withColumn("text", F.concat("key", F.lead("begun", 1, "").over(order)))
    cut = lambda i: F.struct(F.substring(F.col("text"), i, F.lit(SEGMENT + PREFIX - 1)).alias("segment"), F.least(F.lit(SEGMENT), F.length("key") - i + 1).alias("own"))
    return text.select(*KEYS, F.inline(F.transform(F.sequence(F.lit(1), F.length("key"), F.lit(SEGMENT)), cut)))


def untraced_descriptions(cited: DataFrame, lines: DataFrame) -> DataFrame:
    """Q3: the items (code, description) of findings whose description's beginning (its first 25 characters, eight letters or digits at
    least) stands nowhere in the month's text.

    Only the places of a text where the first eight characters of some beginning stand are looked at, and compared by equality with the
    beginnings of the lengths that go with these eight: common words meet no list of segments.
    """
    wanted = cited.withColumn("prefix", account_key(F.substring("description", 1, PREFIX))).filter(F.length("prefix") >= LEAST_PREFIX)
    asked = likeness.written(wanted.select(*KEYS, "prefix").distinct(), "beginnings")
    heads = asked.select(F.substring("prefix", 1, LEAST_PREFIX).alias("gram"), F.length("prefix").alias("n")).distinct()
    heads = likeness.written(heads.groupBy("gram").agg(F.collect_set("n").alias("lengths")), "heads")
    windows = F.transform(F.sequence(F.lit(1), F.least("own", F.length("segment") - LEAST_PREFIX + 1)), lambda i: F.substring(F.col("segment"), i, F.lit(PREFIX)))
    there = text_segments(lines).filter(F.length("segment") >= LEAST_PREFIX).select(*KEYS, F.explode(windows).alias("window"))
    there = there.withColumn("gram", F.substring("window", 1, LEAST_PREFIX)).join(heads, "gram").select(*KEYS, "window", F.explode("lengths").alias("n"))
    traced = there.filter(F.length("window") >= F.col("n")).select(*KEYS, F.expr("substring(window, 1, n)").alias("prefix")).distinct()
    return wanted.join(asked.join(traced, [*KEYS, "prefix"], "left_semi"), [*KEYS, "prefix"], "left_anti").select(*KEYS, "code", "description")


def report_closure(account_month: DataFrame, expense: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """Q5: reports whose accounts don't close, or whose categories sum neither to the debits nor to those of some of the accounts (A17,
    six at most, within two cents)."""
    gap = F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing")
    accounts = account_month.groupBy(*KEYS).agg(F.count_if(F.abs(gap) > tolerance).alias("open_accounts"), F.sum("debits").alias("debits"))
    categories = expense.groupBy(*KEYS).agg(F.sum("amount").alias("categories"))
    debits = account_month.filter(F.abs("debits") > 0.005).select(*KEYS, F.col("account").alias("ord"), F.col("account").alias("code"), F.col("debits").alias("amount"))
    some = subset_sums(debits, categories.select(*KEYS, F.col("categories").alias("target")), 6, 2, tuple(KEYS)).select(*KEYS, F.col("used").alias("accounts_in_total"))
    rows = accounts.join(categories, KEYS, "left").join(some, KEYS, "left").withColumn("categories_close", F.coalesce(F.abs(F.col("categories") - F.col("debits")) <= 0.02, F.lit(False)))
    return rows.filter("open_accounts > 0 or not categories_close").select(*KEYS, "open_accounts", "categories_close", "accounts_in_total")


def missing_reports(statements: DataFrame, reports: DataFrame) -> DataFrame:
    """Q7: statements without a report that is newer."""
    newest = reports.groupBy(*KEYS).agg(F.max("ts").alias("reported"))
    return statements.join(newest, KEYS, "left").filter(F.col("reported").isNull()).select(*KEYS)


def month_exists(balance: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whether a building has a month, with its values."""
    return wanted.join(balance.select(*KEYS, "closing").withColumn("present", F.lit(True)), KEYS, "left").select(*KEYS, F.coalesce("present", F.lit(False)).alias("present"), "closing")
