"""Integrity and constraint reports: small frames of (rule, violations)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from platter.functions.expressions import line_amount, money_sum, valid_email, valid_phone
from platter.plans.views import count_where
from platter.schema import (
    ORDER_STATUSES,
    PAYMENT_METHODS,
    PAYMENT_STATUSES,
    SCHEMAS,
    USER_TYPES,
    Tables,
)
from platter.session import fresh_path

# The labels. Label, child table, parent table, key.
REFERENCES = (
    ("Orders without valid user", "orders", "users", "user_id"),
    ("Order_Items without valid order", "order_items", "orders", "order_id"),
    ("Order_Items without valid menu item", "order_items", "menu_items", "item_id"),
    ("Menu_Items without valid category", "menu_items", "categories", "category_id"),
)

UNIQUE_KEYS = (
    ("users", ("user_id",)),
    ("users", ("srn",)),
    ("users", ("email",)),
    ("categories", ("category_id",)),
    ("categories", ("category_name",)),
    ("menu_items", ("item_id",)),
    ("orders", ("order_id",)),
    ("order_items", ("order_item_id",)),
    ("order_items", ("order_id", "item_id")),
)

ENUMS = (
    ("users", "user_type", USER_TYPES),
    ("orders", "order_status", ORDER_STATUSES),
    ("orders", "payment_method", PAYMENT_METHODS),
    ("orders", "payment_status", PAYMENT_STATUSES),
)


#: The column that a CHECK rule looks at.
CHECKED = {
    "wallet_balance_not_negative": "wallet_balance",
    "email_format": "email",
    "phone_format": "phone",
    "price_positive": "price",
    "preparation_time_positive": "preparation_time_minutes",
    "total_amount_positive": "total_amount",
    "quantity_positive": "quantity",
    "unit_price_positive": "unit_price",
}


def check_rules() -> dict[str, dict[str, Column]]:
    """Row rules per table; a rule that evaluates to null is kept."""
    return {
        "users": {
            "wallet_balance_not_negative": F.col("wallet_balance") >= 0,
            "email_format": valid_email(),
            "phone_format": valid_phone(),
        },
        "menu_items": {
            "price_positive": F.col("price") > 0,
            "preparation_time_positive": F.col("preparation_time_minutes") > 0,
        },
        "orders": {"total_amount_positive": F.col("total_amount") > 0},
        "order_items": {
            "quantity_positive": F.col("quantity") > 0,
            "unit_price_positive": F.col("unit_price") > 0,
        },
    }


@dataclass(frozen=True)
class Rule:
    """One rule of a table: where it is broken, and the value that breaks it."""

    kind: str
    name: str
    broken: Column
    value: Column


KINDS = ("reference", "check", "enum", "not_null")


def _fails(rule: Column) -> Column:
    return ~F.coalesce(rule, F.lit(True))


def _lost(key: str, parent: str) -> str:
    return f"_lost_{key}_{parent}"


def rules_of(table: str, kinds: Sequence[str] = KINDS) -> list[Rule]:
    """The row rules of a table; those on references look at the columns that ``with_references`` adds."""
    checks = check_rules().get(table, {})
    found = [
        *(Rule("reference", label, F.col(_lost(key, parent)), F.col(key)) for label, child, parent, key in REFERENCES if child == table),
        *(Rule("check", name, _fails(rule), F.col(CHECKED[name])) for name, rule in checks.items()),
        *(Rule("enum", f"{table}.{column}", _fails(F.col(column).isin(*domain)), F.col(column)) for owner, column, domain in ENUMS if owner == table),
        *(Rule("not_null", f"{table}.{f.name}", F.col(f.name).isNull(), F.col(f.name)) for f in SCHEMAS[table].fields if not f.nullable),
    ]
    return [rule for rule in found if rule.kind in kinds]


def with_references(t: Tables, table: str) -> DataFrame:
    """The rows of a table, marked where a reference of theirs leads nowhere; a null key leads nowhere."""
    frame = getattr(t, table)
    for _, child, parent, key in REFERENCES:
        if child == table:
            known = getattr(t, parent).select(key).distinct().withColumn("_known", F.lit(True))
            frame = frame.join(known, key, "left").withColumn(_lost(key, parent), F.col("_known").isNull()).drop("_known")
    return frame


def _ruled(t: Tables, table: str, kinds: Sequence[str]) -> tuple[DataFrame, list[Rule]]:
    rules = rules_of(table, kinds)
    marked = with_references(t, table) if any(r.kind == "reference" for r in rules) else getattr(t, table)
    return marked, rules


def _verdicts(frame: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Each row's broken rules as one array, evaluated once."""
    hits = [
        F.when(r.broken, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.name).alias("rule"), r.value.cast("string").alias("value")))
        for r in rules
    ]
    return frame.withColumn("_broken", F.array_compact(F.array(*hits)))


def _breaks(rule: Rule) -> Column:
    return F.exists("_broken", lambda hit: (hit["kind"] == rule.kind) & (hit["rule"] == rule.name))


def _details(table: str, judged: DataFrame) -> DataFrame:
    key = SCHEMAS[table].fields[0].name
    rows = judged.where(F.size("_broken") > 0)
    return rows.select(F.lit(table).alias("table_name"), F.col(key).alias("row_id"), F.inline("_broken"))


def _tables_with(kinds: Sequence[str]) -> list[str]:
    return [table for table in SCHEMAS if rules_of(table, kinds)]


def violations(t: Tables, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Every broken rule of every row: ``table_name``, ``row_id`` (its primary key), ``kind``, ``rule``, ``value``.

    All rules of a table are evaluated in one scan of it.
    """
    return reduce(DataFrame.unionByName, [_details(table, _verdicts(*_ruled(t, table, kinds))) for table in _tables_with(kinds)])


def rule_counts(t: Tables, kinds: Sequence[str] = KINDS) -> DataFrame:
    """How many rows break each rule: ``kind``, ``rule``, ``violations``, a row per rule; one scan per table."""
    reports = []
    for table in _tables_with(kinds):
        frame, rules = _ruled(t, table, kinds)
        counted = frame.agg(*(count_where(r.broken).alias(f"{r.kind}:{r.name}") for r in rules))
        tall = counted.unpivot([], [f"`{r.kind}:{r.name}`" for r in rules], "_rule", "violations")
        reports.append(tall.select(F.split_part("_rule", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("_rule", F.lit(":"), F.lit(2)).alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, reports)


@dataclass(frozen=True)
class Audit:
    """The violations of a snapshot, written, and their number per rule."""

    counts: DataFrame
    details: DataFrame


def audit(t: Tables, path: str | None = None, kinds: Sequence[str] = KINDS) -> Audit:
    """Write all violations to ``path`` and count them on the way: details and report from the same scan.

    The counts are observed where the rows are written. Those are the tasks
    of the job's last stage, of which Spark counts each once, also when an
    executor is lost and a task runs again. Without a ``path`` the table goes to
    the shared folder.
    """
    spark = t.orders.sparkSession
    parts, watched = [], []
    for table in _tables_with(kinds):
        frame, rules = _ruled(t, table, kinds)
        watch = Observation()
        counts = [F.count_if(_breaks(r)).alias(f"n{i}") for i, r in enumerate(rules)]
        parts.append(_details(table, _verdicts(frame, rules).observe(watch, *counts)))
        watched.append((watch, rules))
    path = path or fresh_path(spark, "violations")
    whole = reduce(DataFrame.unionByName, parts)
    whole.write.mode("errorifexists").parquet(path)
    rows = [(r.kind, r.name, watch.get[f"n{i}"]) for watch, rules in watched for i, r in enumerate(rules)]
    counts = spark.createDataFrame(rows, "kind string, rule string, violations bigint")
    return Audit(counts, spark.read.schema(whole.schema).parquet(path))


def integrity_report(t: Tables) -> DataFrame:
    """Rows that point at nothing, per reference.

    Child rows are counted per key before the anti join, so a key with very
    many rows crosses the network once per task.  Null keys count as well.
    """
    reports = []
    for label, child, parent, key in REFERENCES:
        per_key = getattr(t, child).groupBy(key).agg(F.count("*").alias("n"))
        lost = per_key.join(getattr(t, parent).select(key), key, "left_anti")
        reports.append(
            lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")).select(
                F.lit(label).alias("test"), "violations"
            )
        )
    return reduce(DataFrame.unionByName, reports)


def orphans(t: Tables, label: str) -> DataFrame:
    """The rows behind one line of the integrity report."""
    child, parent, key = next((c, p, k) for name, c, p, k in REFERENCES if name == label)
    return getattr(t, child).join(getattr(t, parent).select(key), key, "left_anti")


def _unique_name(table: str, keys: tuple[str, ...]) -> str:
    return f"{table}({', '.join(keys)})"


def repeated_keys(t: Tables, table: str, keys: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once; text compares whatever its case."""
    frame = getattr(t, table)
    types = dict(frame.dtypes)
    columns = [F.lower(k).alias(k) if types[k] == "string" else F.col(k) for k in keys]
    complete = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return frame.where(complete).groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def uniqueness_report(t: Tables) -> DataFrame:
    """Repeated values per unique key, and the rows beyond the first of each.

    All unique keys of a table are grouped together: one scan, whose rows are
    expanded to one per key, and one shuffle.
    """
    reports = []
    for table in dict.fromkeys(table for table, _ in UNIQUE_KEYS):
        sets = [keys for owner, keys in UNIQUE_KEYS if owner == table]
        columns = list(dict.fromkeys(k for keys in sets for k in keys))
        types = dict(getattr(t, table).dtypes)
        frame = getattr(t, table).select(*(F.lower(c).alias(c) if types[c] == "string" else F.col(c) for c in columns))
        grouped = frame.groupingSets([[F.col(k) for k in keys] for keys in sets], *columns)
        counted = grouped.agg(F.grouping_id().alias("_set"), F.count("*").alias("n")).where(F.col("n") > 1)
        figures = []
        for i, keys in enumerate(sets):
            place = sum(1 << (len(columns) - 1 - j) for j, c in enumerate(columns) if c not in keys)
            complete = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
            own = (F.col("_set") == place) & complete
            figures.append(F.struct(
                F.lit(_unique_name(table, keys)).alias("rule"),
                count_where(own).alias("repeated_values"),
                F.coalesce(F.sum(F.when(own, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("violations"),
            ).alias(f"_{i}"))
        reports.append(counted.agg(*figures).select(F.inline(F.array(*(f"_{i}" for i in range(len(sets)))))))
    return reduce(DataFrame.unionByName, reports)


def _report(t: Tables, kind: str) -> DataFrame:
    return rule_counts(t, (kind,)).select("rule", "violations")


def check_report(t: Tables) -> DataFrame:
    """Rows that break a CHECK rule."""
    return _report(t, "check")


def check_violations(t: Tables, table: str) -> DataFrame:
    """The offending rows of a table with the names of the CHECK rules they break."""
    judged = _verdicts(getattr(t, table), rules_of(table, ("check",)))
    return judged.withColumn("broken_rules", F.col("_broken")["rule"]).drop("_broken").where(F.size("broken_rules") > 0)


def enum_report(t: Tables) -> DataFrame:
    """Values outside their domain."""
    return _report(t, "enum")


def not_null_report(t: Tables) -> DataFrame:
    """Nulls in columns that must hold a value."""
    return _report(t, "not_null")


def reconcile_order_totals(t: Tables, only_drift: bool = True) -> DataFrame:
    """Order totals beside the sum of their lines; reported, never corrected."""
    sums = t.order_items.groupBy("order_id").agg(money_sum("subtotal").alias("line_total"))
    compared = (
        t.orders.select("order_id", "total_amount")
        .join(sums, "order_id", "left")
        .withColumn("line_total", F.coalesce("line_total", F.lit(0)).cast("decimal(20,2)"))
        .withColumn("difference", (F.col("total_amount") - F.col("line_total")).cast("decimal(20,2)"))
    )
    return compared.where(F.col("difference") != 0) if only_drift else compared


def subtotal_drift(t: Tables) -> DataFrame:
    """Lines whose subtotal is not unit price x quantity."""
    expected = line_amount()
    return (
        t.order_items.select("order_item_id", "order_id", "item_id", "quantity", "unit_price", "subtotal")
        .withColumn("expected", expected)
        .where(F.col("subtotal") != F.col("expected"))
    )
