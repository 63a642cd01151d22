"""Sub-expressions several reports are built from."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.functions.ordered import frozen

BUSY_DAY = 64  # times the rows that are wanted


def completed(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("ProcessingStatus") == s.COMPLETED)


def ghosts(ledger: DataFrame, vouchers: DataFrame | None) -> DataFrame:
    """Ledger rows without a voucher, whatever their status.

    Copies of an EntryID are dropped before the shuffle; the anti join could not split them later.
    Without ``vouchers`` the rows are taken to be ghosts already: a suite of ghost reports can store
    them once instead of joining for each report.
    """
    if vouchers is None:
        return ledger
    return ledger.join(vouchers.select("EntryID").distinct(), "EntryID", "left_anti")


def completed_ghosts(ledger: DataFrame, vouchers: DataFrame | None) -> DataFrame:
    """Wallets were debited but no voucher came out. The status filter runs before the shuffle."""
    return ghosts(completed(ledger), vouchers)


def owners(wallets: DataFrame, merchants: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Wallet -> owner, merchant profile (if any) and effective tier; one row per profile."""
    held = wallets.select("WalletID", "UserID")
    if users is not None:
        held = held.join(users.select("UserID", "FullName"), "UserID")
    profiles = merchants.select("UserID", "MerchantID", "BusinessName", "MerchantTier")
    return held.join(profiles, "UserID", "left").withColumn(
        "EffectiveTier", F.coalesce("MerchantTier", F.lit(s.STANDARD))
    )


_ROW = ["EntryID", "WalletID", "ProductID", "Amount", "CommissionAmount", "CreatedTimestamp"]


def _newest_first() -> list[Column]:
    return [F.col("CreatedTimestamp").desc(), F.col("EntryID")]


class Timeline:
    """The ledger by time: its rows between two days, both inclusive and each optional, and the rows it has on each day.

    A table set that keeps the counts finds newest and oldest rows without reading the rest. The counts only place a window: if they are
    not up to date it is widened, never wrong. They are as many as the calendar has days.
    """

    def __init__(
        self,
        rows: Callable[[datetime.date | None, datetime.date | None], DataFrame],
        days: Callable[[], list[tuple[datetime.date, int]]],
    ):
        self.rows, self._days = rows, days

    @classmethod
    def of(cls, ledger: DataFrame | Timeline) -> Timeline:
        """That of a table set, or one that counts the ledger itself."""
        if isinstance(ledger, Timeline):
            return ledger
        return cls(lambda first, last: between(ledger, first, last), listed(lambda: days_of(ledger)))

    @property
    def days(self) -> list[tuple[datetime.date, int]]:
        """(day, rows), from the oldest day on."""
        return self._days()


def listed(counts: Callable[[], DataFrame]) -> Callable[[], list[tuple[datetime.date, int]]]:
    """The days of a Timeline from counts (Day, Entries), which are read once; a day may have several."""

    @cache
    def days() -> list[tuple[datetime.date, int]]:
        found = counts().filter(F.col("Day").isNotNull()).groupBy("Day").agg(F.sum("Entries").alias("Entries"))
        return sorted((row["Day"], row["Entries"]) for row in found.collect())

    return days


def days_of(ledger: DataFrame) -> DataFrame:
    """Day, Entries: how many rows the ledger has on each day."""
    return ledger.groupBy(F.to_date("CreatedTimestamp").alias("Day")).agg(F.count("*").alias("Entries"))


def between(ledger: DataFrame, first: datetime.date | None, last: datetime.date | None) -> DataFrame:
    """Rows from the first to the last day, both inclusive, in comparisons that reach the scan."""
    time = F.col("CreatedTimestamp")
    if first is not None:
        ledger = ledger.filter(time >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        ledger = ledger.filter(time < F.lit(last + datetime.timedelta(days=1)).cast("timestamp_ntz"))
    return ledger


def recent(
    ledger: DataFrame | Timeline,
    wallets: DataFrame,
    merchants: DataFrame,
    n: int,
    users: DataFrame | None = None,
    products: DataFrame | None = None,
) -> DataFrame:
    """The newest ``n`` rows of ledger x ``owners``; ties by EntryID, then MerchantID.

    With ``users`` or ``products`` only rows that have them count. Each ledger row that counts yields
    at least one joined row, so the newest n of those rows are enough to join the owner columns to; a
    second limit settles users with several profiles. Only a window of the ledger is looked up.
    """
    held = wallets if users is None else wallets.join(users.select("UserID"), "UserID", "left_semi")
    known = {"WalletID": held.select("WalletID")}
    if products is not None:
        known["ProductID"] = products.select("ProductID")

    def in_all(window: DataFrame, whole: bool) -> DataFrame:
        window = window.select(*_ROW)
        for key, table in known.items():
            window = window.join(table, key, "left_semi")
        return window

    newest = first_rows(ledger, n, in_all)
    return newest.join(owners(wallets, merchants, users), "WalletID").orderBy(*_newest_first(), "MerchantID").limit(n)


def first_rows(
    ledger: DataFrame | Timeline, n: int, found: Callable[[DataFrame, bool], DataFrame], newest: bool = True
) -> DataFrame:
    """The newest (oldest) ``n`` rows of found(window, whether it is the whole ledger), ties by EntryID.

    Windows are widened until one has n rows. These are written, so that what finds them runs once; there are at most n.
    """
    time = F.col("CreatedTimestamp")
    order = [time.desc() if newest else time.asc(), F.col("EntryID")]
    for window, whole in time_windows(Timeline.of(ledger), n, newest):
        rows = frozen(found(window, whole).orderBy(*order).limit(n))
        if whole or rows.count() == n:
            return rows.orderBy(*order).limit(n)
    raise AssertionError("the last window is the whole ledger")


def following(ledger: DataFrame | Timeline, after: tuple[datetime.datetime, object] | None) -> Timeline:
    """The rows that come after a row (CreatedTimestamp, EntryID) in the list newest first; all of them after None."""
    ledger = Timeline.of(ledger)
    if after is None:
        return ledger
    at, entry = after
    time, last_day = F.col("CreatedTimestamp"), at.date()
    instant = F.lit(at).cast("timestamp_ntz")

    def rows(first: datetime.date | None, last: datetime.date | None) -> DataFrame:
        found = ledger.rows(first, last_day if last is None else min(last, last_day))
        return found.filter((time < instant) | ((time == instant) & (F.col("EntryID") > F.lit(entry))))

    return Timeline(rows, lambda: [(day, n) for day, n in ledger.days if day <= last_day])


def time_windows(ledger: Timeline, n: int, newest: bool = True) -> Iterator[tuple[DataFrame, bool]]:
    """Parts of the ledger that hold its newest (oldest) rows, each wider than the one before, and whether it is all of it.

    The first holds at least 2 n rows, the next 16 times as many. Its edge is a day, found from the counts alone; of a day that has far
    more rows than are wanted, and only of that, the minutes are counted.
    """
    wanted = 2 * n
    days = ledger.days[::-1] if newest else ledger.days
    while True:
        seen = 0
        for day, entries in days:
            seen += entries
            if seen >= wanted:
                break
        else:
            yield ledger.rows(None, None), True
            return
        window = ledger.rows(day, None) if newest else ledger.rows(None, day)
        if entries > BUSY_DAY * wanted:
            window = _to_the_minute(window, ledger.rows(day, day), wanted - (seen - entries), newest)
        yield window, False
        wanted *= 16


def _to_the_minute(window: DataFrame, day: DataFrame, wanted: int, newest: bool) -> DataFrame:
    """The window without the minutes of its first (last) day that are not needed for the wanted rows."""
    minute = F.date_trunc("minute", "CreatedTimestamp").cast("timestamp_ntz").alias("minute")
    counts = sorted(map(tuple, day.groupBy(minute).count().collect()), reverse=newest)  # at most 1440
    for edge, entries in counts:
        wanted -= entries
        if wanted <= 0:
            time = F.col("CreatedTimestamp")
            return window.filter(time >= F.lit(edge) if newest else time < F.lit(edge + datetime.timedelta(minutes=1)))
    return window


def with_rules(rows: DataFrame, commissions: DataFrame) -> DataFrame:
    """Attach the active rules of the row's product and effective tier; duplicate rules repeat the row."""
    rules = commissions.filter(F.col("IsActive")).select(
        "ProductID", F.col("MerchantTier").alias("EffectiveTier"), "CommissionPercentage"
    )
    return rows.join(rules, ["ProductID", "EffectiveTier"])


def by_dimension(
    facts: DataFrame, key: str, sums: dict[str, Column], dimension: DataFrame, groups: Sequence[str]
) -> DataFrame:
    """Sum ``sums`` per ``key`` before joining ``dimension`` on it, then regroup by ``groups``.

    The first sum runs partly before its shuffle, so the join sees one row per key however many facts
    a key has.
    """
    per_key = facts.groupBy(key).agg(*[F.sum(column).alias(name) for name, column in sums.items()])
    return per_key.join(dimension, key).groupBy(*groups).agg(*[F.sum(name).alias(name) for name in sums])

