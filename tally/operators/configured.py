"""Rules that obey each building's own configuration, in one plan for all buildings.

A configuration is a tree (JSON). Its leaves are rows, so that a building's overlay is merged with the base by joins; the merged
tree goes back to each building as a map from path to value, which is joined to the rules' rows: limits differ per building
inside one plan, and what a rule asks for decides whether it applies.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.operators.rules import KEYS

SEP, EMPTY = "/", "{}"


def leaves(trees: DataFrame) -> DataFrame:
    """(condo_id, path, value) of JSON objects (condo_id, tree): scalars and lists as text, an object without members as "{}"."""
    rows, out = trees.select("condo_id", F.lit("").alias("path"), F.col("tree").alias("value")), []
    inner = F.from_json("value", "map<string,string>")
    branch = F.coalesce(F.col("value").startswith("{") & (F.size(inner) > 0), F.lit(False))
    while True:
        out.append(rows.filter(~branch))
        rows = rows.filter(branch)
        if rows.isEmpty():
            break
        grown = rows.select("condo_id", F.col("path").alias("above"), F.explode(inner).alias("name", "value"))
        rows = grown.select("condo_id", F.when(F.col("above") == "", F.col("name")).otherwise(F.concat_ws(SEP, "above", "name")).alias("path"), "value")
    return reduce(DataFrame.unionByName, out).filter("path <> ''")


def _above(rows: DataFrame, own: bool) -> DataFrame:
    """Each row once for every path above its own, and for its own with ``own``."""
    parts = F.split("path", SEP)
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), SEP))
    return rows.withColumn("at", F.explode(upto)).filter(F.lit(own) | (F.col("at") != F.col("path")))


def merged(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The leaves of ``overlay`` over those of ``base``: objects are merged, anything else replaces what lies at and below its
    path, and a building without an overlay keeps its base."""
    key = ["condo_id", "path"]
    is_empty = F.coalesce(F.col("value") == EMPTY, F.lit(False))
    set_, bare = overlay.filter(~is_empty), overlay.filter(is_empty)
    under = _above(base, True).select("condo_id", "path", "value", "at")
    on = lambda rows: rows.select("condo_id", F.col("path").alias("at"))
    replaced = under.join(on(set_), ["condo_id", "at"], "left_semi").select(*key)
    now_objects = base.select(*key).join(_above(overlay, False).select("condo_id", F.col("at").alias("path")), key, "left_semi")
    emptied = base.filter(~is_empty).select(*key).join(bare.select(*key), key, "left_semi")
    gone = replaced.unionByName(now_objects).unionByName(emptied).distinct()
    held = under.filter((F.col("at") != F.col("path")) | is_empty).select("condo_id", F.col("at").alias("path")).distinct()
    return base.join(gone, key, "left_anti").unionByName(set_).unionByName(bare.join(held, key, "left_anti"))


def settings_of(tree: DataFrame) -> DataFrame:
    """(condo_id, settings): a map of every leaf and of every object ("{}") above one."""
    inner = _above(tree, False).select("condo_id", F.col("at").alias("path"), F.lit(EMPTY).alias("value"))
    entries = tree.unionByName(inner).groupBy("condo_id", "path").agg(F.max("value").alias("value"))
    return entries.groupBy("condo_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("settings"))


def setting(path: str, default: float) -> Column:
    """A number that a building may set."""
    return F.coalesce(F.try_element_at(F.col("settings"), F.lit(path)).try_cast("double"), F.lit(float(default)))


def has(path: str) -> Column:
    return F.try_element_at(F.col("settings"), F.lit(path)).isNotNull()


def unless_false(path: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("settings"), F.lit(path)), F.lit("")) != "false"


def listed(path: str, word: str) -> Column:
    """Whether a list that a building may set has the word."""
    return F.coalesce(F.array_contains(F.from_json(F.try_element_at(F.col("settings"), F.lit(path)), "array<string>"), word), F.lit(False))


INCOME, YIELD, ENTRIES, ANY = "has_income", "has_yield", "has_entries", None


def always() -> Column:
    return F.lit(True)


#: Rule -> (what the file must cover, what the building must ask for, rows of its findings that the building's limits keep).
RULES: dict[str, tuple[str | None, Callable[[], Column], Callable[[], Column]]] = {
    "R1": (INCOME, always, always),
    "R2": (INCOME, always, always),
    "R4": (ENTRIES, lambda: has("category_variation"), lambda: (F.col("moved") >= setting("category_variation/min", 1000)) & (F.col("moved") > setting("category_variation/percent", 1.0) * F.col("previous"))),
    "R5": (ENTRIES, lambda: has("repeated_invoice"), always),
    "R6": (ANY, lambda: has("collection"), lambda: (F.col("rate") < setting("collection/least", 0.9)) | (F.col("rate") > setting("collection/most", 1.0))),
    "R7": (ANY, lambda: has("negative_balance"), lambda: F.col("streak") >= setting("negative_balance/months", 3)),
    "R8": (ANY, lambda: ~has("negative_balance") & unless_false("negative_alert"), always),
    "R9": (ANY, lambda: unless_false("continuity"), lambda: F.abs("amount") > setting("continuity/tolerance", 0.02)),
    "R10": (ANY, lambda: has("movement"), lambda: F.abs("amount") >= setting("movement/min", 1000)),
    "R11": (YIELD, always, lambda: F.abs(F.col("rate") / F.col("median_rate") - 1) > setting("yield/tolerance", 0.25)),
    "R13": (ANY, always, always),
    "R14": (ENTRIES, always, always),
    "R15": (ENTRIES, always, always),
    "R16": (ENTRIES, always, always),
    "R17": (ENTRIES, always, always),
    "R20": (ENTRIES, always, lambda: F.col("days") <= setting("late/days", 120)),
    "G1": (ENTRIES, lambda: has("manager") & ~listed("manager/off", "G1") & F.col("stable"), lambda: F.col("amount") >= setting("manager/new_vendor", 3000)),
    "G7": (ENTRIES, lambda: has("manager") & ~listed("manager/off", "G7"), always),
    "G8": (ENTRIES, lambda: has("manager") & ~listed("manager/off", "G8"), lambda: F.col("amount") >= setting("manager/duplicate", 100)),
    "G10": (ANY, lambda: has("manager") & ~listed("manager/off", "G10"), lambda: F.col("amount") >= setting("manager/deficit", 1000)),
    "G13": (ENTRIES, lambda: has("manager") & ~listed("manager/off", "G13"), lambda: F.col("amount") >= setting("manager/ordinary", 20000)),
    "A7": (ENTRIES, always, always),
}


def status(statements: DataFrame, settings: DataFrame, stable: DataFrame) -> DataFrame:
    """(condo_id, month, rule, applied, reason) for each statement and rule: not where the file doesn't cover it (with the file's
    own reason for income), nor where the building doesn't ask for it; G1 not where vendors' names don't last."""
    rows = statements.join(settings, "condo_id", "left").join(stable.select(*KEYS, F.lit(True).alias("stable")), KEYS, "left").withColumn("stable", F.coalesce("stable", F.lit(False)))
    each = []
    for rule, (needs, asks, _) in RULES.items():
        covered, asked = F.col(needs) if needs else F.lit(True), F.coalesce(asks(), F.lit(False))
        why = F.coalesce(F.when(F.lit(needs == INCOME), F.col("income_reason")), F.lit("not in the file"))
        each.append(F.struct(F.lit(rule).alias("rule"), (covered & asked).alias("applied"), F.when(~covered, why).when(~asked, "not configured").alias("reason")))
    return rows.select(*KEYS, F.inline(F.array(*each)))


def in_force(rows: DataFrame, rule: str, applied: DataFrame, settings: DataFrame) -> DataFrame:
    """The rows within the building's limits of a rule, of the statements where it applies."""
    kept = rows.join(settings, "condo_id", "left").filter(F.coalesce(RULES[rule][2](), F.lit(False))).drop("settings")
    return kept.join(applied.filter(F.col("applied") & (F.col("rule") == rule)).select(*KEYS), KEYS, "left_semi")


def configured_findings(found: dict[str, DataFrame], applied: DataFrame, settings: DataFrame) -> DataFrame:
    """The findings of all rules (``found``: rule -> rows with condo_id, month, type, subject, amount and what its limits ask for) of
    the statements where the rule applies, within the building's limits, numbered per building and month by rule, subject, amount."""
    parts = []
    for rule, rows in found.items():
        kept = rows.join(settings, "condo_id", "left").filter(F.coalesce(RULES[rule][2](), F.lit(False)))
        parts.append(kept.select(*KEYS, F.lit(rule).alias("rule"), "type", F.col("subject").cast("string").alias("subject"), F.col("amount").cast("decimal(28,2)").alias("amount")))
    union = reduce(DataFrame.unionByName, parts).join(applied.filter("applied").select(*KEYS, "rule"), [*KEYS, "rule"], "left_semi")
    order = W.partitionBy(*KEYS).orderBy("rule", "subject", "amount")
    return union.withColumn("finding_id", F.format_string("RG-%04d", F.row_number().over(order)))
