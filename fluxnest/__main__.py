"""Command line: starter plans, pipelines over JSON, and flattening of framed files."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fluxnest", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("skeleton", help="print a starter plan for a message")
    s.add_argument("proto")
    s.add_argument("message")
    s.add_argument("--import-path", action="append", default=[])
    r = sub.add_parser("run", help="run a pipeline over JSON values, one a line on standard input")
    r.add_argument("program")
    d = sub.add_parser("denorm", help="flatten a framed file or folder by a YAML plan")
    d.add_argument("config")
    d.add_argument("input")
    d.add_argument("--output", help="Parquet folder; without it the first rows are printed")
    a = p.parse_args(argv)
    if a.command == "skeleton":
        from .plans.config import skeleton
        from .wire.frames import RecordType

        print(skeleton(RecordType.from_proto(a.proto, a.message, a.import_path).schema, a.proto, a.message), end="")
        return 0
    if a.command == "run":
        from .pipeline.interpret import PipeError, execute
        from .pipeline.syntax import parse

        tree = parse(a.program)
        for line in sys.stdin:
            if line.strip():
                try:
                    for out in execute(tree, json.loads(line)):
                        print(json.dumps(out, ensure_ascii=False))
                except PipeError as e:
                    print(f"error: {e}", file=sys.stderr)
                    return 1
        return 0
    from pyspark.sql import SparkSession

    from .api import Transcoder
    from .sources.files import write_parquet
    from .wire.frames import read_framed

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    flat = Transcoder.from_config(a.config).denorm(read_framed(spark, a.input).select("payload"))
    if a.output:
        write_parquet(flat, a.output)
    else:
        flat.show(20, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
