"""Command line: ``python -m vellum FILE [DPI] [--json] [--password=P]`` or ``python -m vellum batch IN OUT [--perfile]``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.functions.scalars import console
from vellum.operators.record import Facts, to_json
from vellum.plans import batch
from vellum.sources import pdf


def main(args: list[str]) -> int:
    flags = dict(a[2:].partition("=")[::2] for a in args if a.startswith("--"))
    plain = [a for a in args if not a.startswith("--")]
    if not plain:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("vellum").getOrCreate()
    if plain[0] == "batch":
        if len(plain) < 3:
            print(__doc__)
            return 2
        o = batch.Options(plain[1], plain[2], int(flags.get("dpi") or 150), flags.get("password"), "no-records" not in flags, "perfile" in flags)
        batch.run(spark, o).show(truncate=False, vertical=True)
        return 0
    f = Facts(pdf.files(spark, plain[0]).select(F.col("path").alias("doc_id"), "content"), flags.get("password"), int(plain[1]) if len(plain) > 1 else 150)
    if "json" in flags:
        for r in to_json(f.records()).toLocalIterator():
            print(r.json)
        return 0
    for name, df in (("documents", f.documents), ("images", f.images), ("fields", f.fields), ("text runs", f.runs)):
        print(name, df.count())
    lines = f.text().select(F.explode(F.split("text", "\n")).alias("t")).where("trim(t) <> ''").limit(30)
    for r in lines.select(console(F.col("t")).alias("t")).collect():
        print(r.t)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
