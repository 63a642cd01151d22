"""Issuing vouchers for a table of requests.

Two modes: ``issue_vouchers`` debits without looking at the balance, as the platform does;
``issue_vouchers_checked`` takes requests in the order they arrived and issues only what the wallet of
an active user can still pay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.functions.ordered import HOT_ROWS, frozen, running_sum
from reckon.operators.commissions import first_active_rule
from reckon.plans.requests import first_reason, given, given_id, known
from reckon.plans.validation import MAX_QUANTITY, MIN_QUANTITY

LINE_ORDER = ["RequestedAt", "RequestID", "Unit"]
FOLD_ROWS = 2_000
_MONEY = "decimal(38,2)"


def _reason() -> Column:
    return first_reason(
        (given_id("WalletID") & given_id("ProductID") & given("Reference"), "missing field"),
        (F.coalesce("Quantity", F.lit(1)).between(MIN_QUANTITY, MAX_QUANTITY), "quantity must be 1 to 20"),
    )


def voucher_rejections(requests: DataFrame, wallets: DataFrame, products: DataFrame) -> DataFrame:
    """Requests that are refused before anything is debited."""
    reason = F.coalesce(
        _reason(), first_reason((F.col("_wallet"), "wallet not found"), (F.col("_product"), "product not found"))
    )
    return (
        requests.transform(known, "WalletID", wallets, "_wallet")
        .transform(known, "ProductID", products, "_product")
        .select(*requests.columns, reason.alias("Reason"))
        .filter(F.col("Reason").isNotNull())
    )


def _hash_text(column: Column, start: int, length: int) -> Column:
    return F.substring(F.md5(column), start, length)


def _entry_id() -> Column:
    """Repeatable id in the form of a UUID: the same request yields the same entries on every run."""
    source = F.concat_ws("-", F.lit("voucher"), F.col("RequestID").cast("string"), F.col("Unit").cast("string"))
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.upper(F.concat_ws("-", *[_hash_text(source, *part) for part in parts]))


def pin_of(entry: Column) -> Column:
    """Repeatable pin of up to ten digits derived from the entry id."""
    return F.conv(_hash_text(entry.cast("string"), 1, 8), 16, 10)


def _lines(
    requests: DataFrame, wallets: DataFrame, products: DataFrame, commissions: DataFrame
) -> DataFrame:
    """One line per voucher asked for. Wallet, price and rate are looked up before quantities unfold."""
    rates = (
        first_active_rule(commissions)
        .filter(F.col("MerchantTier") == s.STANDARD)
        .select("ProductID", F.col("CommissionPercentage").alias("_rate"))
    )
    bulk = F.col("Quantity").isNotNull()
    unit = F.concat("Reference", F.lit("-"), F.col("Unit").cast("string"))
    commission = F.col("Amount") * F.coalesce("_rate", F.lit(0).cast(s.PERCENT)) * F.lit(0.01).cast("decimal(3,2)")
    return (
        requests.filter(_reason().isNull())
        .join(wallets.select("WalletID"), "WalletID", "left_semi")
        .join(products.select("ProductID", F.col("FaceValue").alias("Amount")), "ProductID")
        .join(rates, "ProductID", "left")
        .withColumn("Unit", F.explode(F.sequence(F.lit(1), F.coalesce("Quantity", F.lit(1)).cast("int"))))
        .withColumn("EntryID", _entry_id())
        .select(
            "RequestID",
            "Unit",
            "EntryID",
            "WalletID",
            "ProductID",
            "Amount",
            commission.cast(s.COMMISSION).alias("CommissionAmount"),
            F.when(bulk, unit).otherwise(F.col("Reference")).alias("ExternalReference"),
            "RequestedAt",
        )
    )


def _with_voucher(lines: DataFrame) -> DataFrame:
    return lines.select(
        "RequestID",
        "Unit",
        "EntryID",
        "WalletID",
        "ProductID",
        "Amount",
        "CommissionAmount",
        "ExternalReference",
        F.lit(s.COMPLETED).alias("ProcessingStatus"),
        F.col("RequestedAt").alias("CreatedTimestamp"),
        pin_of(F.col("EntryID")).alias("PinData"),
        (F.col("RequestedAt") + F.expr("INTERVAL '1' YEAR")).alias("ExpiryDate"),
    )


def issue_vouchers(
    requests: DataFrame, wallets: DataFrame, products: DataFrame, commissions: DataFrame
) -> DataFrame:
    """New ledger rows with their vouchers."""
    return _with_voucher(_lines(requests, wallets, products, commissions))


def debit_wallets(wallets: DataFrame, issued: DataFrame) -> DataFrame:
    """The wallet table after the debits."""
    spent = issued.groupBy("WalletID").agg(
        F.sum("Amount").alias("_spent"), F.max("CreatedTimestamp").alias("_at")
    )
    return wallets.join(spent, "WalletID", "left").select(
        "WalletID",
        "UserID",
        (F.col("Balance") - F.coalesce("_spent", F.lit(0))).alias("Balance"),
        "CurrencyCode",
        F.coalesce("_at", F.col("LastUpdated").cast("timestamp_ntz")).alias("LastUpdated"),
    )


def issue_vouchers_checked(
    requests: DataFrame,
    wallets: DataFrame,
    users: DataFrame,
    products: DataFrame,
    commissions: DataFrame,
    fold_rows: int = FOLD_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Vouchers of active users that their balance covers, in order of arrival.

    Each unit of a request is decided on its own, and a refused unit does not use up balance.
    """
    active = users.filter(F.col("ServiceStatus") == s.ACTIVE).select("UserID")
    usable = wallets.join(active, "UserID", "left_semi")
    lines = _lines(requests, usable, products, commissions)
    return _with_voucher(affordable(lines, usable, fold_rows, hot_rows))


def affordable(
    lines: DataFrame, wallets: DataFrame, fold_rows: int = FOLD_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The lines the balance covers when it is spent in ``LINE_ORDER``.

    Wallets with up to ``fold_rows`` lines are folded as one array each. Larger wallets whose balance
    covers everything need no order; the remaining ones are decided in rounds over all their lines.
    """
    demand = lines.groupBy("WalletID").agg(F.count("*").alias("_lines"), F.sum("Amount").alias("_demand"))
    funds = wallets.select("WalletID", F.col("Balance").cast(_MONEY).alias("_left"))
    large = frozen(demand.filter(F.col("_lines") > fold_rows).join(funds, "WalletID"))
    if large.isEmpty():
        return _folded(lines, funds)

    ids = large.select("WalletID")
    parts = [_folded(lines.join(ids, "WalletID", "left_anti"), funds)]
    covered = F.col("_demand") <= F.col("_left")
    parts.append(lines.join(large.filter(covered).select("WalletID"), "WalletID", "left_semi"))
    short = large.filter(~covered).select("WalletID", "_left")
    parts.extend(_in_rounds(lines.join(short.select("WalletID"), "WalletID", "left_semi"), short, hot_rows))
    return reduce(DataFrame.unionByName, [part.select(*lines.columns) for part in parts])


def _folded(lines: DataFrame, funds: DataFrame) -> DataFrame:
    rest = [c for c in lines.columns if c not in ["WalletID", "Amount", *LINE_ORDER]]

    def spend(state: Column, line: Column) -> Column:
        covered = F.coalesce(line["Amount"] <= state["left"], F.lit(False))
        left = F.when(covered, (state["left"] - line["Amount"]).cast(_MONEY)).otherwise(state["left"])
        return F.struct(left.alias("left"), F.array_append(state["taken"], covered).alias("taken"))

    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<boolean>").alias("taken"))
    return (
        lines.groupBy("WalletID")
        .agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "Amount", *rest))).alias("_all"))
        .join(funds, "WalletID")
        .withColumn("_taken", F.aggregate("_all", start, spend, lambda state: state["taken"]))
        .select("WalletID", F.inline(F.filter("_all", lambda line, i: F.col("_taken")[i])))
    )


def _in_rounds(lines: DataFrame, funds: DataFrame, hot_rows: int) -> list[DataFrame]:
    """Accepted lines of each round; every round leaves less than half of a wallet's balance.

    Lines dearer than the balance left are out. Of the others, small ones cost up to half of it. A round goes as far as the small
    line with which these have used more than half, or the first dear line that can be paid after the small ones before it. Up
    to there all small lines are paid and, but for that one, no dear line. So there are at most log2(balance / least price) rounds.
    """
    order = [F.col(c) for c in LINE_ORDER]
    columns = lines.columns
    undecided, funds, accepted = lines, frozen(funds), []
    small = F.col("Amount") * 2 <= F.col("_left")
    at = F.struct(*LINE_ORDER)
    while True:
        # Every wallet has funds here. A left join keeps Spark from broadcasting the unfolded lines, whose
        # number it underestimates.
        payable = undecided.join(funds, "WalletID", "left").filter(F.col("Amount") <= F.col("_left"))
        payable = payable.withColumn("_small", F.when(small, F.col("Amount")).otherwise(F.lit(0)).cast(_MONEY))
        summed = frozen(running_sum(payable, ["WalletID"], order, "_small", "_sum", hot_rows))
        if summed.isEmpty():
            return accepted
        ends = F.when(small, F.col("_sum") * 2 > F.col("_left")).otherwise(F.col("_sum") + F.col("Amount") <= F.col("_left"))
        stops = summed.groupBy("WalletID").agg(F.min(F.when(ends, at)).alias("_stop"))
        placed = frozen(summed.join(frozen(stops), "WalletID"))
        before = F.col("_stop").isNull() | (at <= F.col("_stop"))
        taken = placed.filter((small & before) | F.coalesce(at == F.col("_stop"), F.lit(False)))
        accepted.append(taken.select(*columns))
        spent = taken.groupBy("WalletID").agg(F.sum("Amount").alias("_spent"))
        left = (F.col("_left") - F.coalesce("_spent", F.lit(0))).cast(_MONEY)
        funds = frozen(funds.join(spent, "WalletID", "left").select("WalletID", left.alias("_left")))
        undecided = placed.filter(at > F.col("_stop")).select(*columns)
