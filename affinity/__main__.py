"""Command line: one preference build per call.

    python -m affinity --uid 42 --name shop --algorithm NPREF --source PARQUET \
        --path s3://bucket/lines --output s3://bucket/prefs [--rating explicit] [--sink FILE] \
        [--spec spec.xml] [--scores scores.xml]

JDBC sources take ``--url --table``, ``--user --password-file --driver``, and
``--partition-column --lower-bound --upper-bound --num-partitions`` (or
``--num-partitions 1`` for a read by one task).  ``--source LOG`` reads purchases
from an order-item log over JDBC: ``--site --startdate --enddate`` and
``--num-partitions``.

Runs in the session ``spark-submit`` provides (or a new default one) and prints
the written table paths, one per line.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from affinity.job import ALGORITHMS, LOG, RATINGS, PreferenceRequest, build
from affinity.sinks import SINKS
from affinity.sources.fieldspec import FieldSpec
from affinity.sources.readers import SOURCE_KINDS


def _properties(a) -> dict:
    found = {"user": a.user, "driver": a.driver}
    if a.password_file:
        with open(a.password_file, encoding="utf-8") as fh:  # a local file of whoever starts the job
            found["password"] = fh.read().strip()
    return {k: v for k, v in found.items() if v is not None}


def parse(argv: list[str], spark: SparkSession | None = None) -> PreferenceRequest:
    p = argparse.ArgumentParser(prog="python -m affinity", description="Build user preferences.")
    p.add_argument("--uid", required=True)
    p.add_argument("--name", required=True)
    p.add_argument("--algorithm", required=True, choices=ALGORITHMS)
    p.add_argument("--source", required=True, choices=(*SOURCE_KINDS, LOG))
    p.add_argument("--rating", default="implicit", choices=RATINGS)
    p.add_argument("--sink", default="PARQUET", choices=SINKS)
    p.add_argument("--output", required=True, help="base folder of the output tables")
    p.add_argument("--path", help="input path (FILE, PARQUET, ELASTIC documents)")
    p.add_argument("--url", help="JDBC url")
    p.add_argument("--table", help="JDBC table")
    p.add_argument("--user", help="JDBC user")
    p.add_argument("--password-file", help="file that holds the JDBC password")
    p.add_argument("--driver", help="JDBC driver class")
    p.add_argument("--partition-column", help="JDBC: numeric, date or timestamp column to read by strides of")
    p.add_argument("--lower-bound")
    p.add_argument("--upper-bound")
    p.add_argument("--num-partitions", type=int)
    p.add_argument("--site", help="LOG: site id")
    p.add_argument("--startdate", help="LOG: start of the interval (excluded), as yyyy-MM-dd HH:mm:ss")
    p.add_argument("--enddate", help="LOG: end of the interval (excluded)")
    p.add_argument("--spec", help="field spec XML file (mapped sources)")
    p.add_argument("--scores", help="event score XML file (EPREF)")
    a = p.parse_args(argv)
    args: dict = {}
    if a.source == "JDBC":
        args.update(url=a.url, table=a.table, properties=_properties(a), partition_column=a.partition_column,
                    lower_bound=a.lower_bound, upper_bound=a.upper_bound, num_partitions=a.num_partitions)
    elif a.source == LOG:
        args.update(url=a.url, table=a.table, properties=_properties(a))
        if a.num_partitions:
            args["partitions"] = a.num_partitions
    elif a.source == "ELASTIC":
        args["source"] = a.path
    else:
        args["path"] = a.path
    if a.spec:
        if a.source in ("FILE", LOG):
            p.error(f"--spec does not apply to {a.source} sources")
        args["spec"] = FieldSpec.load(a.spec, spark or SparkSession.builder.getOrCreate())
    return PreferenceRequest(uid=a.uid, name=a.name, algorithm=a.algorithm, source=a.source, rating=a.rating,
                             sink=a.sink, output=a.output, source_args=args, scores=a.scores,
                             site=a.site, startdate=a.startdate, enddate=a.enddate)


def main(argv: list[str] | None = None) -> int:
    request = parse(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.getOrCreate()
    for _, path in sorted(build(request, spark).items()):
        print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
