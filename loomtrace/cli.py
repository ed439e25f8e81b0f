"""Command line: `python -m loomtrace.cli render|cases ROOT OUT [--session-dir DIR | --session ID | --latest] [--include-noisy] [--store]`.

ROOT holds a folder for each session with events.jsonl and manifest.json, or is a store of events (see `sources.store`).
With none of the three, all sessions are taken; of several the folder counts first, then the id. What was written is told
by an event of each session in OUT/events. With `--store` cases, pages and events are kept in stores, for many sessions;
else each session has a folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import cases, report
from .sources import logs, sinks, store


def chosen(spark: SparkSession, root: str, session: str | None, latest: bool, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events and manifests of one session (by folder, by id or the latest one), or of all. A session without a manifest
    has an empty one; one that isn't there is an error."""
    if store.commits(root):
        found = store.catalogue(spark, root)
        one = logs.resolved(found, folder, session, latest) if folder or session or latest else None
        there = found if one is None else found.where(F.col("session_id") == one)
        return logs.stored_events(spark, root, one), there.select("session_id", F.lit(None).cast("variant").alias("manifest"))
    if not folder and not session and latest:
        session = logs.resolved(logs.listed(spark, f"{root}/*/events.jsonl"), newest=True)
    where = folder.rstrip("/") if folder else f"{root}/{session or '*'}"
    files = logs.listed(spark, f"{where}/events.jsonl").select("session_id")
    if files.isEmpty():
        raise FileNotFoundError(f"no session at {where}")
    there = logs.manifests(spark, f"{where}/manifest.json" if folder else f"{root}/*/manifest.json")
    return logs.events(spark, f"{where}/events.jsonl"), files.join(there, "session_id", "left")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["render", "cases"])
    parser.add_argument("root")
    parser.add_argument("out")
    parser.add_argument("--session-dir")
    parser.add_argument("--session")
    parser.add_argument("--latest", action="store_true")
    parser.add_argument("--include-noisy", action="store_true")
    parser.add_argument("--store", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("loomtrace").getOrCreate()
    events, manifests = chosen(spark, given.root, given.session, given.latest, given.session_dir)
    pages, kept, told_to = (sinks.keep_pages, sinks.keep_cases, sinks.keep_events) if given.store else (sinks.write_pages, sinks.write_cases, sinks.append_lines)
    if given.command == "render":
        pages((report.lines if given.store else report.build)(events, manifests, given.include_noisy), f"{given.out}/reports")
        told = sinks.report_generated(manifests, given.out, given.include_noisy)
    else:
        found = cases.build(events, manifests)
        kept(found, f"{given.out}/cases")
        pages((cases.review_lines if given.store else cases.review)(found, manifests), f"{given.out}/reviews")
        told = sinks.cases_generated(manifests, found, given.out)
    told_to(told, f"{given.out}/events")


if __name__ == "__main__":
    main()
