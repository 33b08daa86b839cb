"""FASTQ text to an archive and back, with settings: python examples/paths.py IN.fastq ARCHIVE OUT."""

import sys

from pyspark.sql import SparkSession

from readmill import api
from readmill.plans.options import Options
from readmill.plans.runtime import session


def main(spark: SparkSession, source: str, archive: str, target: str) -> None:
    api.compress(spark, source, archive, Options(dna_level=2, quality_level=2, buffer_mb=64, crc32=True))
    api.decompress(spark, archive, target)


if __name__ == "__main__":
    main(session("paths"), *sys.argv[1:])
