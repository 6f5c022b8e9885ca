"""Career analysis of one YAML document: ``python -m vitalake.cli FILE [AS_OF]`` (``-`` reads standard input).

The result is written as YAML. What cannot be analysed gives an error document and exit code 1.
"""

from __future__ import annotations

import datetime
import importlib
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vitalake.operators import career
from vitalake.session import LOG, ship
from vitalake.sources import readers


def run(text: str, as_of: str, spark: SparkSession) -> tuple[str, int]:
    """(YAML, exit code) of one input document."""
    try:
        events = readers.events_yaml(spark, text).withColumns({"resume_id": F.lit(1), "event_id": F.col("event_seq")})
        done = career.analyze(events, as_of).drop("resume_id")
        return readers.to_yaml(done), 0
    except Exception as e:  # noqa: BLE001 - any fault of the input becomes a document
        LOG.warning("input refused: %s", e)
        return importlib.import_module("yaml").safe_dump({"error": {"type": type(e).__name__, "message": str(e).split("\n")[0]}}, allow_unicode=True), 1


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    text = sys.stdin.read() if args[0] == "-" else Path(args[0]).read_text(encoding="utf-8")
    spark = SparkSession.builder.appName("vitalake").getOrCreate()
    ship(spark)
    out, code = run(text, args[1] if len(args) > 1 else str(datetime.date.today()), spark)
    print(out, end="")
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
