"""Queries of the review layer, of audits over what is published, and of the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.operators import checks, reviews, rules
from tally.operators import review_layer as op
from tally.plans.catalog_matching import attachments
from tally.sources import ledger, named, readers
from tally.sources.ledger import month_no
from tally.sources.stored import at_hand, stored

KEYS, ID = ["condo_id", "month"], ["condo_id", "month", "type", "subject"]


def every():
    """A number that building and month give: fixtures deal out their cases by it."""
    return F.col("condo_id") + month_no(F.col("month"))


account_month = stored(ledger.account_month)


@stored
def amounts(spark, sf_dir):
    """What the findings ask of expenses, so that these are joined once for all of them."""
    return at_hand(ledger.expense, spark, sf_dir).select(*KEYS, "account", "code", "amount")


@stored
def book(spark, sf_dir):
    return ledger.balances(ledger.income(spark, sf_dir), amounts(spark, sf_dir))


@stored
def findings(spark, sf_dir):
    """Findings on income, continuity and duplicates, one for each subject."""
    parts = [
        rules.finding(rules.negative_income(ledger.income(spark, sf_dir)), "negative_income", "R1", F.col("description"), F.col("total")),
        rules.finding(rules.balance_continuity(book(spark, sf_dir)), "balance_continuity", "R9", F.col("account"), F.col("gap")),
        rules.finding(checks.duplicate_codes(amounts(spark, sf_dir)), "duplicate", "A7", F.col("code"), F.col("amount")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def review_rows(spark, sf_dir):
    """Reviews of the findings, some wrong in one way or another, and some of findings that don't exist."""
    rows = findings(spark, sf_dir).filter(every() % 11 != 0)
    subject = F.when(every() % 13 == 0, F.concat("subject", F.lit("?"))).otherwise(F.col("subject"))
    return rows.select("condo_id", "month", "type", subject.alias("subject"), F.when(every() % 7 == 0, "urgent").when(every() % 5 == 0, "high").otherwise("attention").alias("severity"), F.lit("attention").alias("proposed"), F.when(every() % 10 == 0, "checked").alias("reason"), F.when(every() % 17 == 0, 1.5).otherwise(0.5).alias("confidence"), F.when(every() % 19 == 0, " ").otherwise("text").alias("body"))


def visual_checks(spark, sf_dir):
    rows = findings(spark, sf_dir).filter(every() % 3 == 0)
    return rows.select(*ID, (F.col("amount") + F.when(every() % 2 == 0, F.lit("0.01").cast("decimal(4,2)")).otherwise(0)).alias("checked_amount"), (F.col("condo_id") % 4 == 0).alias("real_divergence"))


def waivers(spark, sf_dir):
    """Waivers with the finding's total, a cent beside it or a whole unit off."""
    off = F.when(every() % 4 == 0, 1).when(every() % 4 == 1, F.lit("0.01").cast("decimal(4,2)")).otherwise(0)
    return findings(spark, sf_dir).filter(F.col("rule").isin("R1", "R9") & (every() % 2 == 0)).select(*ID, (F.col("amount") + off).cast("decimal(18,2)").alias("amount"))


def rewrites(spark, sf_dir):
    return findings(spark, sf_dir).filter(every() % 9 == 0).select(*ID, F.concat(F.lit("Ver "), "subject").alias("new_title"), F.lit(None).cast("string").alias("new_body"), F.lit("Qual o motivo?").alias("new_question")).distinct()


def narrow_months(spark, sf_dir):
    return findings(spark, sf_dir).filter(every() % 6 == 0).select(*KEYS).distinct()


def manual(spark, sf_dir):
    rows = findings(spark, sf_dir)
    again = rows.filter((every() % 8 == 0) & (F.col("rule") == "R9")).select(*ID, "rule", (F.col("amount") * 2).cast("decimal(18,2)").alias("amount"))
    return again.unionByName(rows.filter(every() % 15 == 0).select(*KEYS, F.lit("manual").alias("type"), F.lit("note").alias("subject"), F.lit("M").alias("rule"), F.lit(0).cast("decimal(18,2)").alias("amount")).distinct())


def published(spark, sf_dir):
    """The balance as a dashboard shows it: some months missing, some values off."""
    rows = checks.month_balance(account_month(spark, sf_dir)).filter(every() % 14 != 0)
    return rows.withColumn("closing", F.col("closing") + F.when(every() % 5 == 0, 2).otherwise(0)).withColumn("yield_amt", F.when(every() % 6 == 0, F.lit(0)).when(every() % 4 == 0, F.col("yield_amt") + 5).otherwise(F.col("yield_amt")))


def wanted_months(spark, sf_dir):
    return named.statements(spark, sf_dir).select("condo_id", F.add_months("month", 2).alias("month"))


def reports(spark, sf_dir):
    return ledger.imports(spark, sf_dir).filter("status = 'success' and condo_id % 3 <> 0").select("condo_id", F.trunc("ts", "month").alias("month"), "ts")


def event_months(spark, sf_dir):
    return ledger.imports(spark, sf_dir).select("condo_id", F.trunc("ts", "month").alias("month")).distinct()


def files(spark, sf_dir):
    """Names of statement files in several styles, with generated reports among them."""
    rows = named.statements(spark, sf_dir)
    y, m = F.year("month"), F.lpad(F.month("month").cast("string"), 2, "0")
    year = (y + 20).cast("string")  # the months of file names lie after 2000
    style = F.when(every() % 4 == 0, F.concat(F.lit("Prestacao "), m, F.lit("."), year)).when(every() % 4 == 1, F.concat(F.lit("balancete "), year, F.lit("_"), m)).when(every() % 4 == 2, F.concat(F.element_at(F.array(*map(F.lit, readers.MONTH_NAMES)), F.month("month")), F.lit(" "), year)).otherwise(F.concat(F.lit("conta "), m, year))
    path = F.concat(F.lit("/c"), "condo_id", F.when(F.col("copy") == 2, "/old").otherwise(""), F.lit("/"), style, F.when(F.col("copy") == 3, " relatorio").otherwise(""), F.when(every() % 5 == 0, ".txt").when(F.col("copy") == 2, ".xlsx").otherwise(".pdf"))
    return rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("condo_id", path.alias("path"), F.lit("xlsx").alias("prefer"), F.col("copy").alias("modified"))


def lines(spark, sf_dir):
    """Statement lines: a section for each account, an item for each category, totals of which some are off, a printed period."""
    sums = ledger.expense(spark, sf_dir).groupBy(*KEYS, "account", "category").agg(F.sum("amount").alias("amount"))
    brl = lambda c: F.concat(F.when(c < 0, "-").otherwise(""), F.translate(F.format_number(F.abs(c), 2), ",.", ".,"))
    page = F.when(F.col("account") == "ORDINARIA", 1).otherwise(2)
    items = sums.select(*KEYS, page.alias("page"), F.concat("account", F.lit("2"), "category").alias("place"), F.concat("category", F.lit("  "), brl(F.col("amount"))).alias("text"))
    total = sums.groupBy(*KEYS, "account").agg(F.sum("amount").alias("t"))
    heads = total.select(*KEYS, page.alias("page"), F.concat("account", F.lit("1")).alias("place"), F.concat(F.lit("## "), "account").alias("text"))
    off = F.col("t") + F.when(F.col("condo_id") % 8 == 0, 1).otherwise(0)
    tails = total.select(*KEYS, page.alias("page"), F.concat("account", F.lit("3")).alias("place"), F.concat(F.lit("TOTAL "), brl(off)).alias("text"))
    end = F.date_format(F.when(F.col("condo_id") % 9 == 0, F.add_months(F.last_day("month"), 1)).otherwise(F.last_day("month")), "dd/MM/yyyy")
    period = total.select(*KEYS).distinct().select(*KEYS, F.lit(1).alias("page"), F.lit("").alias("place"), F.concat(F.lit("Periodo: "), F.date_format("month", "dd/MM/yyyy"), F.lit(" a "), end).alias("text"))
    return items.unionByName(heads).unionByName(tails).unionByName(period).withColumnRenamed("place", "line")


def blocks(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("block", F.explode(F.when(F.col("condo_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.withColumn("text", F.when((F.col("block") == 2) & (F.col("condo_id") % 8 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))


def dashboards(spark, sf_dir):
    """A page for each building with its balances as a script's object."""
    rows = checks.month_balance(account_month(spark, sf_dir))
    item = F.concat(F.lit("'"), F.date_format("month", "yyyy-MM"), F.lit("': {tAnt: "), F.col("opening").cast("string"), F.lit(", tCred: "), F.col("credits").cast("string"), F.lit(", tDeb: "), F.col("debits").cast("string"), F.lit(", tAtual: "), F.col("closing").cast("string"), F.lit("}"))
    return rows.groupBy("condo_id").agg(F.concat(F.lit("<script>var BAL = {"), F.array_join(F.collect_list(item), ", "), F.lit("};</script>")).alias("html"))


def indicator_lines(spark, sf_dir):
    rows = ledger.issuance(spark, sf_dir).groupBy(*KEYS).agg(F.sum("budget").alias("budget"), F.sum("collected").alias("collected")).join(ledger.indicator(spark, sf_dir).select(*KEYS, "delinquent"), KEYS)
    brl = lambda c: F.concat(F.when(F.col(c) < 0, "-").otherwise(""), F.translate(F.format_number(F.abs(F.col(c)), 2), ",.", ".,"))
    texts = F.array(F.concat(F.lit("PREVISTO "), brl("budget")), F.concat(F.lit("REALIZADO "), brl("collected")), F.coalesce(F.concat(F.lit("COTAS EM ATRASO "), brl("delinquent")), F.lit("COTAS EM ATRASO")))
    return rows.select(*KEYS, F.lit(3).alias("page"), F.posexplode(texts).alias("line", "text"))


def queries(on, plain) -> dict:
    f = findings
    narrated = lambda spark, sf_dir: op.narrate(f(spark, sf_dir))
    reviewed = lambda spark, sf_dir: reviews.apply_waivers(f(spark, sf_dir), waivers(spark, sf_dir))
    names = lambda spark, sf_dir: named.statements(spark, sf_dir).select("condo_id", F.concat(F.lit("Building "), "condo_id").alias("name")).distinct()
    balance = lambda spark, sf_dir: checks.month_balance(account_month(spark, sf_dir))
    return {
        "p1_narrated": lambda spark, sf_dir: plain(narrated(spark, sf_dir)),
        "p2_invalid_reviews": on(op.invalid_reviews, f, review_rows),
        "p3_visual_checks": on(op.apply_visual_checks, f, visual_checks),
        "p4_waivers": lambda spark, sf_dir: plain(reviewed(spark, sf_dir)),
        "p5_rewrites": on(op.apply_rewrites, narrated, rewrites),
        "p6_scope": on(op.scope_filter, f, narrow_months),
        "p9_manual": on(op.add_manual, f, manual),
        "p11_scope_notices": on(op.scope_notices, ledger.expense, attachments),
        "p12_repeated_values": lambda spark, sf_dir: plain(op.repeated_values(attachments(spark, sf_dir), 1)),
        "p13_summary_vs_cashbook": lambda spark, sf_dir: plain(op.summary_vs_cashbook(ledger.expense(spark, sf_dir).filter("ord % 111 <> 0"), account_month(spark, sf_dir))),
        "p14_withdrawn": on(op.withdrawn_findings, reviewed, names),
        "k5_fronted": on(op.fronted, f),
        "q1_source_vs_published": on(op.source_vs_published, balance, published),
        "q3_untraced_facts": on(op.untraced_facts, f, ledger.expense, account_month),
        "q5_report_closure": on(op.report_closure, account_month, ledger.expense),
        "q7_missing_reports": on(op.missing_reports, event_months, reports),
        "d12_month_exists": on(op.month_exists, balance, wanted_months),
        "s4_month_files": on(readers.pick_month_file, files),
        "s5_printed_period": on(readers.printed_period_check, lines),
        "s7_section_lines": on(readers.section_lines, lines),
        "s9_repeated_blocks": on(readers.drop_repeated_blocks, blocks),
        "s11_dashboard_balances": on(readers.dashboard_balances, dashboards),
        "s14_declared_indicators": on(readers.declared_indicators, indicator_lines),
    }
