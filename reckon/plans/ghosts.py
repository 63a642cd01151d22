"""Ghosts kept up to date from what each version of the tables adds, instead of joining ledger and vouchers again.

A version keeps the entries without a voucher and the vouchers without an entry. New entries and new vouchers are only held against
these two: a late voucher takes its ghost away, an entry that comes after its voucher is none. Entry ids are unique in the ledger.
"""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions.ordered import frozen
from reckon.operators.shared import Timeline
from reckon.sources.versions import Changes, Manifest, VersionedTables, Versions

Tables = Any


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The rows whose EntryID is not among the others.

    Spark would push an anti join below the union that ``rows`` is, and hash and sort all others once for each of its parts, for a small one
    in few tasks.
    """
    found = others.select("EntryID").distinct().withColumn("_found", F.lit(True))
    return rows.join(found, "EntryID", "left").filter(F.col("_found").isNull()).select(*rows.columns)


def updated(open_entries: DataFrame, loose: DataFrame, entries: DataFrame, vouchers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ghosts, vouchers without an entry) from those there were, and the entries and vouchers that came since."""
    all_open, all_loose = open_entries.unionByName(entries), loose.unionByName(vouchers)
    return _without(all_open, all_loose), _without(all_loose, all_open)


def changes_since(t: VersionedTables) -> Changes:
    """The two tables as of a version, from its rows that they were not computed from.

    If rows they were computed from are no longer part of the version under the same folder, everything is joined once.
    """
    sources = _sources(t.version)
    seen = t.version.seen if set(t.version.seen) <= set(sources) and "ghosts" in t.version.folders else []
    old = (t.ghosts, t.loose_vouchers) if seen else (t.ledger.limit(0), t.vouchers.limit(0))
    found, loose = updated(*old, t.added_since("ledger", seen), t.added_since("vouchers", seen))
    return Changes(replace={"ghosts": found, "loose_vouchers": loose})


def _sources(version: Manifest) -> list[str]:
    return [*version.folders.get("ledger", []), *version.folders.get("vouchers", [])]


def keep_ghosts(versions: Versions, as_of: datetime.date) -> Manifest:
    """Publish the ghosts of the newest version, unless they are there already."""
    t = VersionedTables(versions.spark, versions.folder, as_of)
    sources = _sources(t.version)
    if t.version.seen == sources:
        return t.version
    return versions.commit(f"ghosts-{t.version.number}", changes_since(t), t.version, sources)


class OfGhosts:
    """A table set whose ledger has ghosts only, for the ghost reports; they look for no vouchers then."""

    vouchers = None

    def __init__(self, tables: Tables):
        self._tables = tables
        self.ledger = self.ledger_amounts = tables.ghosts
        self.timeline = self.timeline_amounts = Timeline.of(tables.ghosts)

    def __getattr__(self, name: str) -> Any:
        return getattr(self._tables, name)


def ghosts_after_increments(t: Tables, versions: Versions) -> DataFrame:
    """All ghosts, kept up to date over two increments: old entries with every other voucher, then what is left.

    Vouchers of the second increment belong to entries of both.
    """
    old = F.year("CreatedTimestamp") < t.as_of.year - 3
    early = F.col("VoucherID") % 2 == 0
    for k, part in enumerate((lambda flag: F.coalesce(flag, F.lit(False)), lambda flag: ~F.coalesce(flag, F.lit(False)))):
        rows = {"ledger": t.ledger_amounts.withColumn("CommissionAmount", F.lit(None).cast("decimal(18,4)")).filter(part(old))}
        rows["vouchers"] = t.vouchers.filter(part(early))
        on = versions.manifest()
        versions.commit(f"part-{k}", Changes(append=rows), on)
        keep_ghosts(versions, t.as_of)
    found = VersionedTables(versions.spark, versions.folder, t.as_of).ghosts
    return frozen(found.select("EntryID", "WalletID", "ProductID", "Amount", "ProcessingStatus", "CreatedTimestamp"))
