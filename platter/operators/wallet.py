"""Top-ups, and status changes that draw on wallets in order."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.operators.base import Outcome, changed, judge, owns_scratch, refused, stamp
from platter.operators.sequence import CHUNK_ROWS, crowded, look_up, running, with_position
from platter.schema import MONEY_MOST, ORDER_STATUSES, PAYMENT_STATUSES, Tables
from platter.session import stored

# Groups up to this many debits are settled by one fold; longer ones in phases.
FOLD_ROWS = 500

_MONEY = "decimal(20,2)"


@owns_scratch
def apply_topups(
    t: Tables, requests: DataFrame, as_of: object | None = None, limit: Decimal | None = None
) -> Outcome:
    """Add amounts to wallets: requests (user_id, amount).

    The amount must be positive (and at most ``limit`` if one is set).  If
    all amounts of a user together take the balance past what the column
    holds, all of them are refused, since their order would decide otherwise.
    """
    amount = F.col("amount")
    # Fixed value: the message of the first rule.
    rules = {"Amount must be positive": amount.isNull() | (amount <= 0), "amount_out_of_range": amount > F.lit(MONEY_MOST)}
    if limit is not None:
        rules["amount_above_limit"] = amount > F.lit(limit)
    valid, rejected = judge(requests, rules)
    per_user = valid.groupBy("user_id").agg(F.sum("amount").alias("_added"))
    users = changed(
        t.users.join(per_user, "user_id", "left"),
        F.col("_added").isNotNull() & ~_too_much(F.col("wallet_balance") + F.col("_added")),
        wallet_balance=F.col("wallet_balance") + F.col("_added"),
        updated_at=stamp(as_of),
    ).select(*t.users.columns)
    wallets = t.users.select("user_id", F.col("wallet_balance").alias("_balance"), F.lit(True).alias("_known"))
    _, turned_away = judge(
        per_user.join(wallets, "user_id", "left"),
        {
            "user_not_found": F.col("_known").isNull(),
            "amount_out_of_range": _too_much(F.col("_balance") + F.col("_added")),
        },
    )
    late = valid.join(turned_away.select("user_id", "reason"), "user_id").select(*requests.columns, "reason")
    nobody = refused(valid.where(F.col("user_id").isNull()), "user_not_found")
    return Outcome(t.with_(users=users), rejected.unionByName(late).unionByName(nobody))


def _too_much(balance: Column) -> Column:
    return F.coalesce(balance > F.lit(MONEY_MOST), F.lit(False))


def _fold(debits: DataFrame) -> DataFrame:
    """Settle short groups: walk each user's debits in order, skip what does not fit."""
    step = F.struct("position", "amount")

    def settle(state, debit):
        fits = debit["amount"] <= state["funds"]
        return F.struct(
            F.when(fits, (state["funds"] - debit["amount"]).cast(_MONEY)).otherwise(state["funds"]).alias("funds"),
            F.concat(
                state["settled"],
                F.array(F.struct(debit["position"].alias("position"), fits.alias("granted"))),
            ).alias("settled"),
        )

    start = F.struct(
        F.col("funds"), F.array().cast("array<struct<position:bigint,granted:boolean>>").alias("settled")
    )
    walked = (
        debits.groupBy("user_id")
        .agg(F.array_sort(F.collect_list(step)).alias("steps"), F.max("funds").alias("funds"))
        .select(F.inline(F.aggregate("steps", start, settle, lambda state: state["settled"])))
    )
    return walked.select("position", "granted")


def _phase(debits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settle long groups up to the point where less than half their funds are left.

    ``debits`` also carries the ``largest`` open debit of the user.  While
    that is at most half the funds, every debit fits until the funds drop
    below it.  Otherwise call a debit large if it exceeds half the funds:
    until the funds drop below half, every small debit fits, and they drop at
    the first small debit whose running sum passes half, or at the first
    large debit that fits on top of the small ones before it; the large
    debits before that point do not fit.  Returns what is settled, and the
    debits behind that point with the funds left there.
    """
    amount, funds, spent, largest = F.col("amount"), F.col("funds"), F.col("spent"), F.col("largest")
    roomy = largest * 2 <= funds
    small = roomy | (amount * 2 <= funds)
    summed = stored(
        running(debits, "user_id", "sum", F.when(small, amount), "spent", split=True), "phase"
    )
    low = F.when(roomy, spent + largest > funds).otherwise(spent * 2 > funds)
    turning = F.when(small, low).otherwise(amount + spent <= funds)
    left = (funds - spent - F.when(small, F.lit(0)).otherwise(amount)).cast(_MONEY)
    turns = (
        summed.where(turning)
        .groupBy("user_id")
        .agg(F.min(F.struct(F.col("position").alias("at"), left.alias("left"))).alias("turn"))
        .select("user_id", "turn.*")
    )
    placed = look_up(summed, "user_id", turns, split=True)
    at = F.col("at")
    settled = placed.where(at.isNull() | (F.col("position") <= at)).select(
        "position", (small | F.coalesce(F.col("position") == at, F.lit(False))).alias("granted")
    )
    rest = placed.where(F.col("position") > at).select(
        "user_id", "position", "chunk", "amount", F.col("left").alias("funds")
    )
    return settled, rest


def settle_debits(debits: DataFrame, fold_rows: int = FOLD_ROWS, split: bool = True) -> DataFrame:
    """Which debits fit, taken in order of position: (position, granted).

    ``debits`` is (user_id, position, chunk, amount, funds) with the funds of
    the user on each row and positive amounts.  A debit that exceeds what is
    left is skipped, later smaller ones may still fit.

    Users who can pay everything are settled by their sum, users with few
    debits by a fold over that bounded group.  The debits of the others stay
    spread over (user, chunk) groups; each phase at least halves the funds
    of such a user, so the number of rounds grows with the logarithm of the
    balance and not with the number of debits.
    """
    settled = []
    amount, funds = F.col("amount"), F.col("funds")
    while True:
        settled.append(debits.where(amount > funds).select("position", F.lit(False).alias("granted")))
        payable = debits.where(amount <= funds)
        per_user = payable.groupBy("user_id").agg(
            F.count("*").alias("_debits"), F.sum("amount").alias("_due"), F.max("amount").alias("largest")
        )
        sized = stored(look_up(payable, "user_id", per_user, split), "debits")
        affordable = F.col("_due") <= funds
        settled.append(sized.where(affordable).select("position", F.lit(True).alias("granted")))
        settled.append(_fold(sized.where(~affordable & (F.col("_debits") <= fold_rows))))
        many = sized.where(~affordable & (F.col("_debits") > fold_rows)).drop("_debits", "_due")
        if many.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        done, debits = _phase(many)
        settled.append(done)


@owns_scratch
def apply_status_updates(
    t: Tables,
    requests: DataFrame,
    as_of: object | None = None,
    chunk_rows: int = CHUNK_ROWS,
    fold_rows: int = FOLD_ROWS,
) -> Outcome:
    """Set order and payment status in sequence: requests (request_id, seq, order_id, order_status, payment_status).

    A wallet order that goes into ``completed`` from another payment status
    draws its total from the wallet.  A draw the wallet cannot cover refuses
    the whole change, and the order keeps what it had.

    Draws only ever lower a balance, so once a draw of an order is refused,
    asking again for the same order is refused too.  It is therefore known
    from the requests alone which of them try to draw: those that ask for
    ``completed`` while the request before them, or the snapshot, does not.
    """
    valid, malformed = judge(
        requests,
        {
            "invalid_order_status": F.col("order_status").isNull() | ~F.col("order_status").isin(*ORDER_STATUSES),
            "invalid_payment_status": F.col("payment_status").isNull()
            | ~F.col("payment_status").isin(*PAYMENT_STATUSES),
            "order_not_found": F.col("order_id").isNull(),
        },
    )
    wanted = valid.select("order_id").distinct()
    headers = t.orders.join(wanted, "order_id", "left_semi").select(
        "order_id",
        "user_id",
        "payment_method",
        F.col("total_amount").alias("amount"),
        F.col("payment_status").alias("_from"),
        F.lit(True).alias("_known"),
    )
    placed = with_position(valid, "seq", "request_id", chunk_rows=chunk_rows)
    busy_order = crowded(placed, "order_id", chunk_rows)
    looked_up = running(
        look_up(placed, "order_id", headers, busy_order),
        "order_id",
        "last",
        F.col("payment_status"),
        "_asked",
        inclusive=False,
        split=busy_order,
    )
    before = F.coalesce("_asked", "_from")
    draws = (
        (F.col("payment_method") == "wallet") & (F.col("payment_status") == "completed") & (before != "completed")
    )
    updates = stored(looked_up.withColumn("_draws", F.coalesce(draws, F.lit(False))), "updates")
    unknown = updates.where(F.col("_known").isNull())
    known = updates.where(F.col("_known"))

    wallets = t.users.select("user_id", F.col("wallet_balance").cast(_MONEY).alias("funds"))
    drawing = known.where("_draws").select("user_id", "position", "chunk", F.col("amount").cast(_MONEY).alias("amount"))
    busy_user = crowded(drawing, "user_id", chunk_rows)
    # Without a balance there is nothing to lower and no limit to break.
    payable = F.coalesce(F.col("amount") > 0, F.lit(False))
    debits = look_up(drawing.where(payable), "user_id", wallets, busy_user).where(F.col("funds").isNotNull())
    unpayable = drawing.where(~payable).select("position", F.lit(False).alias("granted"))
    outcomes = settle_debits(debits, fold_rows, busy_user).unionByName(unpayable)

    judged = stored(
        running(
            known.join(outcomes, "position", "left"),
            "order_id",
            "last",
            F.col("granted"),
            "_granted",
            split=busy_order,
        ),
        "judged",
    )
    refuse = (F.col("payment_status") == "completed") & ~F.coalesce("_granted", F.lit(True))
    applied = judged.where(~refuse)
    denied = judged.where(refuse)

    final = applied.groupBy("order_id").agg(
        F.max(
            F.struct("position", F.col("order_status").alias("_order"), F.col("payment_status").alias("_payment"))
        ).alias("last")
    )
    last = final.select("order_id", "last._order", "last._payment")
    orders = changed(
        t.orders.join(last, "order_id", "left"),
        F.col("_order").isNotNull(),
        order_status=F.col("_order"),
        payment_status=F.col("_payment"),
        updated_at=stamp(as_of),
    ).select(*t.orders.columns)
    spent = (
        applied.where(F.col("_draws"))
        .groupBy("user_id")
        .agg(F.sum("amount").alias("_spent"))
    )
    users = changed(
        t.users.join(spent, "user_id", "left"),
        F.col("_spent").isNotNull(),
        wallet_balance=F.col("wallet_balance") - F.col("_spent"),
        updated_at=stamp(as_of),
    ).select(*t.users.columns)
    columns = requests.columns
    rejects = (
        malformed.select(*columns, "reason")
        .unionByName(refused(unknown.select(*columns), "order_not_found"))
        .unionByName(
            denied.withColumn("reason", F.when(payable, "insufficient_balance").otherwise("invalid_total")).select(
                *columns, "reason"
            )
        )
    )
    return Outcome(t.with_(orders=orders, users=users), rejects, applied.select(*columns))
