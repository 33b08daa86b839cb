"""Records of FASTQ text into an archive and out of it, one by one: python examples/records.py IN.fastq ARCHIVE."""

import sys

from pyspark.sql import SparkSession

from readmill import api
from readmill.plans.options import Options
from readmill.plans.runtime import session


def main(spark: SparkSession, source: str, archive: str) -> int:
    """Number of records that came back as they went in."""
    with api.RecordWriter(spark, archive, Options(buffer_mb=8)) as out:
        for record in api.records(spark, source):
            out.write(record)
    return sum(a == b for a, b in zip(api.records(spark, source), api.records(spark, archive, archive=True)))


if __name__ == "__main__":
    print(main(session("records"), *sys.argv[1:]))
