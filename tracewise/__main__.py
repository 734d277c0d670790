"""Command line: ``python -m tracewise --input DIR --output DIR [--override | --add] [--per-run]``."""

import argparse

from tracewise.plans.report_job import run_report
from tracewise.plans.run_store import add_runs
from tracewise.session import get_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="tracewise")
    parser.add_argument("--input", required=True, help="folder with the runs")
    parser.add_argument("--output", required=True, help="folder for tables and reports")
    parser.add_argument("--override", action="store_true", help="replace existing output")
    parser.add_argument("--add", action="store_true", help="compute only runs that the output, a store, lacks")
    parser.add_argument("--lenient", action="store_true", help="go on when checks fail")
    parser.add_argument("--per-run", action="store_true", help="report each run's own last step")
    args = parser.parse_args()
    if args.add:
        add_runs(get_session(), args.input, args.output, strict=not args.lenient, per_run=args.per_run)
        return
    run_report(
        get_session(), args.input, args.output, args.override,
        strict=not args.lenient, per_run=args.per_run,
    )


if __name__ == "__main__":
    main()
