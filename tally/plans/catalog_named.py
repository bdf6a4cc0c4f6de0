"""Queries over entries whose names, accounts and categories change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tally.functions import identity
from tally.operators import identified as op
from tally.sources import ledger, named
from tally.sources.stored import at_hand, stored


def entries(spark, sf_dir):
    """Named entries with their identity; a query that reads them once works out the columns that it asks for, and no others."""
    return op.with_identity(named.entries(spark, sf_dir))


@stored
def written_entries(spark, sf_dir):
    """The same, but for ``object``, for queries that read them several times: written once, not before their identity, too."""
    return op.with_identity(at_hand(named.entries, spark, sf_dir)).drop("object")


@stored
def works(spark, sf_dir):
    """Workshops' entries with their identity, which is worked out once for each distinct vendor and description."""
    rows, said = named.works(spark, sf_dir), ["vendor", "description"]
    once = op.with_identity(rows.select(*said).distinct().withColumn("category", F.lit(None).cast("string"))).select(*said, "key", "object", "is_eventual")
    return rows.join(once, said).withColumn("is_structural", identity.structural(F.col("category"), F.col("description")))


accounts, split_accounts = stored(named.accounts), stored(named.split_accounts)


def identity_functions(spark, sf_dir):
    """F10, F12, F16, F17, F19, F20, F28 over distinct entries."""
    rows = named.entries(spark, sf_dir).select("vendor", "description", "category").distinct()
    v, d = F.col("vendor"), F.col("description")
    flags = {k: identity.is_kind(F.concat_ws(" ", d, v, "category") if k == "unidentified" else d, k) for k in ("unidentified", "withholding", "marketplace", "variable_utility", "payroll", "eventual")}
    return rows.select(
        "vendor", "description", identity.vendor_key2(v, d).alias("key"), F.array_join(identity.presence_words(v, d), " ").alias("words"), *(x.alias(k) for k, x in flags.items()),
        F.date_format(identity.competence(d), "yyyy-MM").alias("competence"), identity.exempt_reason(d, F.col("category")).alias("exempt"), identity.tax_of(d).alias("tax"),
        F.array_join(identity.natures(identity.terms(d)), " ").alias("natures"),
    ).distinct()


def queries(on, plain) -> dict:
    e, w, a, s, i = entries, written_entries, accounts, named.statements, ledger.income
    return {
        "s2_config": on(op.load_config, named.base_config, named.overlay_config),
        "r0_rule_status": lambda spark, sf_dir: plain(op.rule_status(s(spark, sf_dir), op.load_config(named.base_config(spark, sf_dir), named.overlay_config(spark, sf_dir)))),
        "r0b_history_set": on(op.history_set, s),
        "f10_identity": identity_functions,
        "r2_offset_group": lambda spark, sf_dir: plain(op.offset_group(s(spark, sf_dir), i(spark, sf_dir), "^COTA")),
        "r13_unlocated_yield": on(op.unlocated_yield, s, ledger.account_month),
        "r14_unidentified": on(op.unidentified, e),
        "r9_renamed_accounts": on(op.continuity_of_renamed, a),
        "r7_renamed_accounts": on(op.streak_of_renamed, split_accounts),
        "r16_renamed_categories": on(op.switched_category, e),
        "r17_renamed_categories": on(op.new_category_of_renamed, e),
        "r19_new_category": on(op.new_category_six_months, e),
        "g0_stable_months": lambda spark, sf_dir: plain(op.stable_months(e(spark, sf_dir), 0.05)),
        "g1_new_vendors": on(op.new_vendors, w),
        "g2_round_amounts": on(op.round_amounts, w),
        "g3_missing_vendors": on(op.missing_vendors, w),
        "g4_missing_expected": lambda spark, sf_dir: plain(op.missing_expected(e(spark, sf_dir), "^SALARIO")),
        "g5_atypical_amounts": on(op.atypical_amounts, works),
        "g7_reversals": on(op.reversals, e),
        "g8_duplicates_with_invoice": on(op.duplicates_with_invoice, e),
        "g10_deficit_without_transfers": on(op.deficit_without_transfers, a, e, i),
        "g13_ordinary_questions": on(op.ordinary_questions, e, a),
        "g14_marketplace": on(op.marketplace_purchases, e),
    }
