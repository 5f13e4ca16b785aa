"""The stages of a job from the command line: python -m tilewright ingest|names|tissue|patch|extract|status."""

from __future__ import annotations

import argparse

from .plans import jobs
from .plans.config import PatchConfig, run_ledger
from .session import session, ship_package
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="stage", required=True)
    for name in ("ingest", "names", "tissue", "patch", "extract", "status"):
        own = sub.add_parser(name)
        own.add_argument("job")
        if name in ("ingest", "names"):
            own.add_argument("--registry", required=True)
        if name == "ingest":
            own.add_argument("--source", required=True)
            own.add_argument("--mpp", type=float)
            own.add_argument("--mpp-table")
            own.add_argument("--channel-names")
            own.add_argument("--nuclear")
            own.add_argument("--include", nargs="*")
            own.add_argument("--exclude", nargs="*")
        if name in ("patch", "extract"):
            own.add_argument("--size", type=int, default=256)
            own.add_argument("--stride", type=int)
            own.add_argument("--overlap", type=float, default=0.0)
            own.add_argument("--mode", choices=("grid", "cell_centered"), default="grid")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session(a.master)
    ship_package(spark)
    if a.stage == "status":
        jobs.status(spark, a.job).orderBy("stage").show(truncate=False)
        return 0
    with run_ledger(f"{a.job}/runs", a.stage, vars(a)):
        if a.stage == "ingest":
            table = tables.read_mpp_table(spark, a.mpp_table) if a.mpp_table else None
            names = tables.read_channel_names(spark, a.channel_names) if a.channel_names else None
            out = jobs.ingest(spark, a.source, a.job, tables.read_registry(spark, a.registry), a.mpp, table, names, a.nuclear, a.include, a.exclude)
        elif a.stage == "names":
            out = jobs.sync_names(spark, a.job, tables.read_registry(spark, a.registry))
        elif a.stage == "tissue":
            out = jobs.detect_tissue(spark, a.job)
        else:
            config = PatchConfig(a.size, a.stride, a.overlap, mode=a.mode)
            out = jobs.extract_patches(spark, a.job, config) if a.stage == "patch" else jobs.encode_mean_marker(spark, a.job, config)
        print(f"{a.stage}: {out.count()} rows")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
