"""What every state change returns, and the pieces they share."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.schema import KEYS, Tables
from platter.session import collecting, remove
from platter.sources.tables import save_tables


@dataclass(frozen=True)
class Outcome:
    """The snapshot after a batch, the refused requests, and what was done.

    ``rejects`` holds the refused requests with a ``reason``; ``done`` lists
    one row per carried-out request where the caller needs to know more than
    the new snapshot tells (new ids, soft or hard delete).

    All three are lazy, and may read intermediate tables that the job has
    written (``scratch``). These belong to the outcome: ``save`` removes them
    once the new snapshot is written, ``release`` at any time the caller says.
    Whoever wants ``rejects`` or ``done`` reads them before.
    """

    tables: Tables
    rejects: DataFrame | None = None
    done: DataFrame | None = None
    scratch: Sequence[str] = ()

    def save(self, folder: str, **how: object) -> None:
        """Write the new snapshot to a new ``folder``, then let go of the intermediate tables."""
        save_tables(self.tables, folder, **how)
        self.release()

    def release(self) -> None:
        """Remove the intermediate tables; the frames of this outcome cannot be read any more."""
        remove(self.tables.users.sparkSession, self.scratch)


def owns_scratch(operator: Callable[..., Outcome]) -> Callable[..., Outcome]:
    """Hands the tables that a state change writes on its way over to its outcome."""

    @wraps(operator)
    def run(*args: object, **kwargs: object) -> Outcome:
        with collecting() as paths:
            outcome = operator(*args, **kwargs)
        return replace(outcome, scratch=paths)  # the list: tables made when they are read add to it

    return run


def judge(requests: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split requests by refusal rules: (accepted, refused with ``reason``).

    A rule refuses where it is true; the first such rule names the reason.
    """
    reason = F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    judged = requests.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def refused(requests: DataFrame, reason: str) -> DataFrame:
    return requests.withColumn("reason", F.lit(reason))


def fit_to(table: DataFrame, new: DataFrame) -> DataFrame:
    """New rows with the columns and types of ``table``; missing ones are null."""
    columns = [
        (F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in table.schema.fields
    ]
    return new.select(*columns)


def changed(table: DataFrame, touched: Column, **values: Column) -> DataFrame:
    """Set columns where ``touched`` is true, keeping their types and order.

    The new values all see the old row, as the assignments of one UPDATE do.
    """
    types = {f.name: f.dataType for f in table.schema.fields}
    return table.withColumns(
        {
            name: F.when(F.coalesce(touched, F.lit(False)), value).otherwise(F.col(name)).cast(types[name])
            for name, value in values.items()
        }
    )


def next_id(t: Tables, table: str) -> Column:
    """First free id of a table: after its high-water mark if the snapshot knows it, else a scalar subquery over the column."""
    known = t.high_water.get(table)
    if known is not None:
        return F.lit(known + 1).cast("bigint")
    frame = getattr(t, table)
    return frame.agg((F.coalesce(F.max(KEYS[table]).cast("bigint"), F.lit(0)) + 1).alias("id")).scalar()


def stamp(as_of: object | None, column: str = "updated_at") -> Column:
    """``as_of`` for a changed row; without it the old value stays."""
    return F.col(column) if as_of is None else F.lit(as_of)
