"""Command line: python -m readmill compress IN OUT, python -m readmill decompress IN OUT; - is stdin or stdout, as with -s and one name."""

from __future__ import annotations

import argparse
import os
import shutil
import sys

from readmill import api
from readmill.plans.options import PRESETS, Options
from readmill.plans.runtime import new_folder, session
from readmill.sources.archive import stream_report
from readmill.sources.fastq import file_system

EXTENSIONS = (".fastq", ".fq")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readmill")
    p.add_argument("verb", choices=["compress", "c", "decompress", "d"])
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    p.add_argument("-s", dest="standard", action="store_true", help="read from stdin or write to stdout; only the archive is named")
    p.add_argument("-d", dest="dna_level", type=int)
    p.add_argument("-q", dest="quality_level", type=int)
    p.add_argument("-b", dest="buffer_mb", type=int)
    p.add_argument("-o", dest="quality_offset", type=int)
    p.add_argument("-f", dest="fields", help="title fields to keep, such as 1,2,4")
    p.add_argument("-l", dest="lossy", action="store_true")
    p.add_argument("-c", dest="crc32", action="store_true")
    p.add_argument("-m", dest="preset", type=int, choices=sorted(PRESETS))
    p.add_argument("-t", dest="threads", type=int, default=8)
    p.add_argument("-v", dest="verbose", action="store_true")
    return p


def options_of(a: argparse.Namespace) -> Options:
    given = {k: v for k in ("dna_level", "quality_level", "buffer_mb", "quality_offset") if (v := getattr(a, k)) is not None}
    given |= {"lossy": a.lossy, "crc32": a.crc32, "threads": a.threads, "verbose": a.verbose}
    if a.fields:
        given["fields"] = tuple(int(x) for x in a.fields.split(","))
    return Options.preset(a.preset, **given) if a.preset is not None else Options(**given)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        options = options_of(a)
        if a.standard == (a.target is not None):
            raise ValueError("name an input and an output, or one of them with -s")
        if a.standard:
            a.source, a.target = ("-", a.source) if a.verb[0] == "c" else (a.source, "-")
        if a.source == a.target:
            raise ValueError("input and output have the same name")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = session("readmill", options.threads)
    try:
        if a.verb[0] == "c":
            source = a.source
            if source == "-":  # a pipe cannot be split: it becomes a file in the shared folder first
                source = f"{new_folder(spark, 'stdin')}.fastq"
                system, at = file_system(source)
                system.create_dir(os.path.dirname(at), recursive=True)
                with system.open_output_stream(at) as f:
                    shutil.copyfileobj(sys.stdin.buffer, f)
            elif not source.endswith(EXTENSIONS):
                print(f"the input's name does not end in {' or '.join(EXTENSIONS)}", file=sys.stderr)
            api.compress(spark, source, a.target, options)
        elif a.target == "-":
            for text in api.lines(spark, a.source):
                sys.stdout.write(text + "\n")
        else:
            api.decompress(spark, a.source, a.target)
        if a.verbose and a.verb[0] == "c":
            n = spark.read.parquet(f"{a.target}/blocks").agg({"*": "count", "n_records": "sum"}).first()
            print(f"blocks\t{n[0]}\nrecords\t{n[1]}", file=sys.stderr)
            for r in stream_report(spark, a.target).orderBy("stream").collect():
                print(*r, sep="\t", file=sys.stderr)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
