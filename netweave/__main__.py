"""``python -m netweave -layout L -rule R -output O``: trace one layout."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="netweave", description="What is connected with the start points of a rule file.")
    parser.add_argument("-layout")
    parser.add_argument("-rule")
    parser.add_argument("-output")
    parser.add_argument("-thread", help="accepted and ignored: the session decides")
    parser.add_argument("-orientation", choices=["as_coded", "physical"], default="as_coded")
    parser.add_argument("-flood", choices=["one_hop", "fixpoint"], default="one_hop")
    parser.add_argument("-phase1", choices=["reference_order", "fixpoint"], default="reference_order")
    parser.add_argument("-lenient", action="store_true", help="leave out points that can't be read instead of stopping")
    args, _ = parser.parse_known_args(argv)
    if not (args.layout and args.rule and args.output):
        parser.print_usage(sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from netweave.plans.trace import TraceOptions, trace_files

    spark = SparkSession.builder.appName("netweave").getOrCreate()
    options = TraceOptions(gate_orientation=args.orientation, gate_flood=args.flood, phase1=args.phase1)
    result = trace_files(spark, args.layout, args.rule, args.output, options, strict=not args.lenient, one_file=True)
    print(", ".join(f"{k} {v}" for k, v in result.metrics.first().asDict().items()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
