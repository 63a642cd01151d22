"""Run one query of the catalogue over stored tables and write its result, or publish a batch of requests.

    spark-submit reckon/run.py NAME --tables FOLDER --out FOLDER [--as-of YYYY-MM-DD] [--format json] [--versioned]
    spark-submit reckon/run.py JOB --tables FOLDER --requests PARQUET --batch NAME [--as-of YYYY-MM-DD]

A batch of a name is applied once, however often the command is repeated. Folders with versions are read with --versioned.
"""

from __future__ import annotations

import argparse
import datetime
from decimal import Decimal

from pyspark.sql import SparkSession

from reckon.catalogue import QUERIES
from reckon.plans.batches import BATCHES
from reckon.session import configure
from reckon.sources.tables import StoredTables, export_json
from reckon.sources.versions import Manifest, VersionedTables, Versions


def run(
    spark: SparkSession,
    name: str,
    tables: str,
    out: str,
    as_of: datetime.date,
    form: str = "parquet",
    options: dict | None = None,
    versioned: bool = False,
) -> None:
    result = QUERIES[name]((VersionedTables if versioned else StoredTables)(configure(spark), tables, as_of, options))
    if form == "json":
        export_json(result, out)
    else:
        result.write.mode("overwrite").parquet(out)


def publish(spark: SparkSession, job: str, tables: str, requests: str, batch: str, as_of: datetime.date) -> Manifest:
    """Apply a table of requests to the newest version of the tables."""
    rows = configure(spark).read.parquet(requests)
    return Versions(spark, tables).apply(batch, lambda t: BATCHES[job][1](t, rows), as_of)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("name", choices=sorted(QUERIES | BATCHES))
    parser.add_argument("--tables", required=True)
    parser.add_argument("--out")
    parser.add_argument("--requests")
    parser.add_argument("--batch")
    parser.add_argument("--versioned", action="store_true")
    parser.add_argument("--as-of", type=datetime.date.fromisoformat, default=datetime.date.today())
    parser.add_argument("--format", choices=["parquet", "json"], default="parquet")
    parser.add_argument("--rapid-seconds", type=int)
    parser.add_argument("--status")
    parser.add_argument("--tier-change", action="append", default=[], metavar="TIER=POINTS")
    given = parser.parse_args()
    changes = {tier: Decimal(points) for tier, points in (change.split("=") for change in given.tier_change)}
    asked = {"rapid_seconds": given.rapid_seconds, "status": given.status, "tier_changes": changes or None}
    options = {name: value for name, value in asked.items() if value is not None}
    spark = SparkSession.builder.getOrCreate()
    if given.batch:
        if given.name not in BATCHES or not given.requests:
            parser.error("a batch needs a job that applies requests, and --requests")
        publish(spark, given.name, given.tables, given.requests, given.batch, given.as_of)
    elif given.out:
        run(spark, given.name, given.tables, given.out, given.as_of, given.format, options, given.versioned)
    else:
        parser.error("give --out for a result or --batch for a batch")


if __name__ == "__main__":
    main()
