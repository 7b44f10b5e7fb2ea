"""python -m bytelens -i app.dex [--scan-vulns | --scan-pending-intent | --taint-method C#m ... | --emulate C#m | --show-bytecode] [-o folder]"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytelens.api import Program


def answer(p: Program, a: argparse.Namespace) -> DataFrame:
    """The table that the flags ask for; of several the first in this order: emulate, taint, pending intents, findings, listing."""
    if a.emulate:
        cls, method = a.emulate.split("#", 1)
        return p.emulate(cls, method, [x for x in (a.emulate_params or "").split(";") if x], a.emulate_max_steps)
    if a.taint_method:
        cls, method = a.taint_method.split("#", 1)
        own = p._wanted(None, None, cls, method).select("method_uid")
        if a.taint_offset is not None:
            return p.flow_from(own.select("method_uid", F.lit(a.taint_offset).cast("long").alias("off"), F.lit(a.taint_reg).cast("long").alias("reg")))
        return p.flow_from_apis(a.taint_api or [""]).join(own, "method_uid", "left_semi")
    if a.scan_pending_intent:
        return p.pending_intents(a.only_package, a.exclude)
    if a.scan_vulns:
        return p.findings(a.only_package, a.exclude, a.taint_api)
    if a.show_bytecode:
        return p.listing()
    return p.source().join(p._wanted(a.only_package, a.exclude), "method_uid").orderBy("class_name", "method_name", "method_uid", "off")


def parser() -> argparse.ArgumentParser:
    x = argparse.ArgumentParser(prog="bytelens", description=__doc__)
    x.add_argument("-i", "--input", action="append", required=True)
    x.add_argument("-o", "--output", help="write the answer as Parquet; without it all rows are printed, columns apart by tabs")
    x.add_argument("-d", "--output-dir", help="write statements as text files by class")
    x.add_argument("--only-package")
    x.add_argument("--exclude", action="append")
    x.add_argument("--scan-vulns", action="store_true")
    x.add_argument("--scan-pending-intent", action="store_true")
    x.add_argument("--show-bytecode", action="store_true")
    x.add_argument("--taint-method")
    x.add_argument("--taint-offset", type=int)
    x.add_argument("--taint-reg", type=int, default=0)
    x.add_argument("--taint-api", action="append")
    x.add_argument("--emulate")
    x.add_argument("--emulate-params", help="separated by ;")
    x.add_argument("--emulate-max-steps", type=int, default=10_000)
    return x


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    p = Program.open(SparkSession.builder.appName("bytelens").getOrCreate(), *a.input)
    if a.output_dir:
        p.write_sources(a.output_dir, a.only_package, a.exclude)
    elif a.output:
        answer(p, a).write.parquet(a.output)
    else:
        for row in answer(p, a).toLocalIterator():  # a partition at a time
            print("\t".join("" if x is None else str(x) for x in row))


if __name__ == "__main__":
    main()
