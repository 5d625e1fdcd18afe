"""One sorted text file from a distributed table, committed by a rename."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MARK = b"\xef\xbb\xbf"
COPY_BYTES = 1 << 20


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def csv_line(values: Sequence[object]) -> str:
    """One CSV record without its line end; numbers in their shortest exact form."""
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(values)
    return out.getvalue()


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """UTF-8 CSV with byte-order mark, header and CRLF line ends, rows in the order of ``order``.

    Tasks write ranges of lines without header; the commit copies them behind the header, block by block, into a file under a name of its
    own and renames that to ``path``. A failed or repeated attempt leaves only its own names behind; readers see the old or the new file.
    """
    spark, columns = df.sparkSession, df.columns

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([csv_line(r) for r in rows], pa.string())], names=["value"])

    attempt = f"{path}.{uuid.uuid4().hex}"
    df.orderBy(*order).mapInArrow(lines, "value string").write.option("lineSep", "\r\n").text(f"{attempt}.parts")
    jvm, folder, fs = _system(spark, f"{attempt}.parts")
    final, whole = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{attempt}.whole")
    out = fs.create(whole, True)
    try:
        out.write(bytearray(MARK + (csv_line(columns) + "\r\n").encode()))
        for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                part = fs.open(status.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, COPY_BYTES, False)
                part.close()
    finally:
        out.close()
    if fs.exists(final):
        fs.delete(final, True)
    if not fs.rename(whole, final):
        raise OSError(f"could not commit {path}")
    fs.delete(folder, True)
