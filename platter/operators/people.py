"""Adding and deleting users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.functions.expressions import message, valid_email, valid_phone
from platter.operators.base import Outcome, fit_to, judge, next_id, owns_scratch, refused
from platter.operators.clashes import first_come
from platter.operators.sequence import with_position
from platter.schema import DEFAULTS, USER_TYPES, Tables
from platter.session import stored


@owns_scratch
def delete_users(t: Tables, user_ids: DataFrame) -> Outcome:
    """Delete users without orders; the others are refused."""
    wanted = user_ids.select("user_id").distinct()
    buyers = t.orders.select("user_id").join(wanted, "user_id", "left_semi").distinct()
    free = wanted.join(buyers, "user_id", "left_anti")
    users = t.users.join(free, "user_id", "left_anti")
    known = t.users.select("user_id")
    # Fixed value: the message of a delete.
    done = free.join(known, "user_id", "left_semi").select(
        "user_id", message("User ", F.col("user_id"), " deleted successfully").alias("message")
    )
    # Fixed value: the message of a refused delete.
    rejects = refused(
        wanted.join(buyers, "user_id", "left_semi"),
        "Cannot delete user with existing orders. Cancel orders first.",
    ).unionByName(refused(free.join(known, "user_id", "left_anti"), "user_not_found"))
    return Outcome(t.with_(users=users), rejects, done)


@owns_scratch
def insert_users(
    t: Tables, new: DataFrame, as_of: object | None = None, order: Sequence[str] = ("request_id",)
) -> Outcome:
    """Add users: srn, name and email required, srn and email unique whatever their case.

    Within the batch the earlier request wins, as if the rows came one by one.
    ``phone`` and ``wallet_balance`` may be left out.
    """
    columns = new.columns
    for column, kind in (("phone", "string"), ("wallet_balance", "decimal(10,2)")):
        if column not in columns:
            new = new.withColumn(column, F.lit(None).cast(kind))
    phone = F.when(F.trim("phone") == "", F.lit(None)).otherwise(F.col("phone")).cast("string")
    balance = F.coalesce("wallet_balance", F.lit(DEFAULTS["users"]["wallet_balance"]))
    cleaned = new.withColumns({"phone": phone, "wallet_balance": balance}).withColumns(
        {"_srn": F.lower("srn"), "_email": F.lower("email")}
    )

    def taken(column: str) -> DataFrame:
        key = f"_{column}"
        held = t.users.select(F.lower(column).alias(key)).join(cleaned.select(key), key, "left_semi").distinct()
        return held.withColumn(f"{key}_taken", F.lit(True))

    looked_up = cleaned.join(taken("srn"), "_srn", "left").join(taken("email"), "_email", "left")

    def blank(column):
        return F.coalesce(F.trim(column) == "", F.lit(True))

    fine, rejected = judge(
        looked_up,
        {
            "missing_field": blank("srn") | blank("name") | blank("email"),
            "invalid_phone": ~valid_phone(),
            "invalid_email": ~valid_email(),
            "invalid_user_type": F.col("user_type").isNull() | ~F.col("user_type").isin(*USER_TYPES),
            "negative_balance": F.col("wallet_balance") < 0,
            "duplicate_srn": F.col("_srn_taken"),
            "duplicate_email": F.col("_email_taken"),
        },
    )
    placed = stored(with_position(fine.drop("_srn_taken", "_email_taken"), *order), "new-users")
    winners, losers = first_come(placed.select("position", "_srn", "_email"), ("_srn", "_email"))
    admitted = placed.join(winners, "position", "left_semi").drop("position", "chunk")
    numbered = with_position(admitted, *order).withColumn(
        "user_id", F.col("position") + next_id(t, "users")
    )
    rows = numbered.withColumn("created_at", F.lit(as_of)).withColumn("updated_at", F.lit(as_of))
    users = t.users.unionByName(fit_to(t.users, rows))
    late = placed.join(losers, "position").withColumn("reason", F.concat(F.lit("duplicate"), F.col("key")))
    rejects = rejected.select(*columns, "reason").unionByName(late.select(*columns, "reason"))
    return Outcome(t.with_(users=users), rejects, numbered.select(*order, "user_id"))
