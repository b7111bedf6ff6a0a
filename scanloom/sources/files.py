"""Source files and their lines."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.functions.text import LINE_BREAK, newline_lines, split_lines
from scanloom.session import materialise

# Fixed value: the limit of one external scanner; no default of the reader.
MAX_TARGET_BYTES = 10_000_000
# Byte ranges whose numbers (some 100 bytes each) are sent to every reader; more of them are joined by a shuffle.
FEW_BLOCKS = 1_000_000


def read_source_tree(spark: SparkSession, root: str, *, max_bytes: int | None = None, pattern: str = "*") -> DataFrame:
    """Every file below ``root`` as ``(path, content, n_bytes)``.

    Without ``max_bytes`` every file is read.  With it, oversize files are listed but not opened, and
    :func:`skipped_files` names them.  Bytes that are not UTF-8 become replacement characters.
    """
    raw = _listed(spark, root, pattern)
    raw = raw if max_bytes is None else raw.filter(F.col("length") <= max_bytes)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("n_bytes"))


def skipped_files(spark: SparkSession, root: str, *, max_bytes: int, pattern: str = "*") -> DataFrame:
    """``(path, n_bytes)`` of the files that :func:`read_source_tree` leaves out under this limit; none is opened."""
    return _listed(spark, root, pattern).filter(F.col("length") > max_bytes).select("path", F.col("length").alias("n_bytes"))


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def size_cap(files: DataFrame, max_bytes: int = MAX_TARGET_BYTES) -> DataFrame:
    """Keep files of at most ``max_bytes`` bytes of UTF-8 (a table of texts has no reader to push into)."""
    return files.filter(F.octet_length("content") <= max_bytes)


def source_lines(files: DataFrame, *, universal: bool = True) -> DataFrame:
    """``(path, line_no, text)``, 1-based.  A narrow step: no shuffle."""
    lines = split_lines(F.col("content")) if universal else newline_lines(F.col("content"))
    # The outer form: before the plain one, Spark would split every text again in a filter against empty arrays.
    return (files.select("path", F.posexplode_outer(lines).alias("pos", "text")).filter("pos IS NOT NULL")
            .select("path", (F.col("pos") + 1).alias("line_no"), "text"))


def python_only(files: DataFrame) -> DataFrame:
    """Only files a Python-only scanner looks at."""
    return files.filter(F.col("path").endswith(".py"))


@contextmanager
def _splits_of(spark: SparkSession, n_bytes: int | None):
    """Within, files are read in byte ranges of about ``n_bytes``; None: as the session says."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            if n_bytes:
                spark.conf.set(n, str(n_bytes))
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def numbered_blocks(lines: DataFrame, by: list[str], block: str) -> DataFrame:
    """``lines`` with ``line_no``, 1-based in each ``by``, where a block's rows are read in order and blocks are ordered by number.

    Rows are numbered as they are read; only one row per block is counted, summed over the blocks before it and joined back.  Up to
    :data:`FEW_BLOCKS` blocks are sent to the readers, so no line is shuffled.
    """
    read = lines.withColumn("at", F.monotonically_increasing_id())
    blocks = read.groupBy(*by, block).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = materialise(blocks.select(*by, block, (before - F.col("start") + 1).alias("shift")), "blocks")
    shifts = F.broadcast(shifts) if shifts.count() <= FEW_BLOCKS else shifts
    return read.join(shifts, [*by, block]).withColumn("line_no", F.col("at") + F.col("shift")).drop("at", "shift")


def read_source_lines(spark: SparkSession, root: str, *, universal: bool = True, pattern: str = "*", split_bytes: int | None = None) -> DataFrame:
    """``(path, line_no, text)`` of every file below ``root``, read in byte ranges: a file is never one row, whatever its size.

    A range begins after the first line break in it, so every line is read once; numbers come from prefix sums of the lines of
    a file's ranges.  With ``split_bytes`` the lines are kept as a table, because the ranges are planned when it is written.  The
    result is that of :func:`source_lines` over :func:`read_source_tree`, but that a byte order mark is no text, and that a file
    whose last character is a break other than CR or LF has an empty last line.
    """
    with _splits_of(spark, split_bytes):
        raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
               .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("text")))
        if universal:
            raw = raw.select("path", "block", F.explode_outer(F.split("text", LINE_BREAK, -1)).alias("text"))
        lines = numbered_blocks(raw, ["path"], "block").select("path", "line_no", "text")
        return lines if split_bytes is None else materialise(lines, "lines")
