"""Code around findings: line context, enclosing function, imports."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions.text import SPACE_CHARS, newline_lines
from scanloom.session import materialise

BEFORE = AFTER = 5
# Findings of one file are served in chunks of lines, so a request list stays bounded; so are the rows of a chunk of lines.
CHUNK = 4096
# Findings of fewer lines than this ask by their pair of lines, so a chunk has at most this many requests a line; a power of two.
SPAN_BITS = 6
_NEWLINE = re.compile(r"\r\n|\n|\r")


def _joined(lines: Column) -> Column:
    """Lines as the reader yields them: each but a file's last ends in a newline."""
    return F.array_join(lines, "\n")


def _window_text(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last (1-based, clipped to the file) as text with their newlines; '' when empty."""
    n = F.size(lines)
    lo, hi = F.greatest(first, F.lit(1)), F.least(last, n)
    text = _joined(F.slice(lines, lo, F.greatest(hi - lo + 1, F.lit(0))))
    # The last line of a file has its newline only if the text ends in one; ``ends_nl`` is in scope.
    return F.when(hi < lo, F.lit("")).otherwise(F.concat(text, F.when((hi < n) | F.col("ends_nl"), "\n").otherwise("")))


def _with_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("lines", newline_lines(F.col("content"))).withColumn("ends_nl", F.col("content").rlike(r"[\n\r]\z"))


def _text_lines(content: str) -> tuple[list[str], bool]:
    """(lines as a text reader yields them, without their breaks; whether the last one has a break)."""
    lines = _NEWLINE.split(content)
    ends = lines[-1] == ""
    return (lines[:-1] if ends else lines), ends and bool(content)


def line_context(files: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Every line with the text before and after it.

    A narrow step: a file's lines are cut into chunks of :data:`CHUNK` lines, each with ``before`` and ``after`` lines of its neighbours,
    and a generator hands on one chunk at a time, so no row holds more than a line's own texts and no shuffle is needed.
    """
    schema = "path string, line_no int, text string, context_before string, context_after string"

    def chunks(path: str, content: str) -> Iterator[pa.RecordBatch]:
        lines, ends = _text_lines(content)
        n = len(lines)

        def window(lo: int, hi: int) -> str:  # lines lo..hi-1 from 0, with their breaks
            lo, hi = max(lo, 0), min(hi, n)
            return "" if hi <= lo else "\n".join(lines[lo:hi]) + ("\n" if hi < n or ends else "")

        for at in range(0, n, CHUNK):
            own = range(at, min(at + CHUNK, n))
            yield pa.RecordBatch.from_arrays([
                pa.array([path] * len(own), pa.string()), pa.array([i + 1 for i in own], pa.int32()), pa.array([lines[i] for i in own], pa.string()),
                pa.array([window(i - before, i) for i in own], pa.string()), pa.array([window(i + 1, i + 1 + after) for i in own], pa.string())],
                names=["path", "line_no", "text", "context_before", "context_after"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                if content.is_valid:
                    yield from chunks(path.as_py(), content.as_py())

    return files.select("path", "content").mapInArrow(run, schema)


def window_context(lines: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """The same from a table of lines, where no whole file is at hand: one window per file."""
    w = Window.partitionBy("path").orderBy("line_no")
    text = lambda lo, hi: F.array_join(F.collect_list("text").over(w.rowsBetween(lo, hi)), "\n")
    return lines.withColumns({"context_before": text(-before, -1), "context_after": text(1, after)})


def add_context(findings: DataFrame, files: DataFrame, *, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Findings with ``context_before`` / ``context_after`` from their file; '' when the file or line is missing.

    What is wanted is first reduced to the distinct pairs of start line (for the text before) and end line (for the text after) of every
    file, counted in chunks of :data:`CHUNK` lines and then put into one row.  So a file's text meets its requests once and is split once,
    and a range of lines is a slice of its array.  Both texts then join the findings on (file, lines), so a finding is shuffled once,
    without a text.  Findings of 2^:data:`SPAN_BITS` lines and more, whose pairs have no bound, go through :func:`_by_line`.
    """
    findings = findings.drop("context_before", "context_after")
    short = F.coalesce((F.col("line_end").cast("long") - F.col("line_start")).between(0, (1 << SPAN_BITS) - 1), F.lit(False))
    out = _by_pair(findings.filter(short), files, before, after)
    long = findings.filter(~short)
    if long.isEmpty():
        return out
    return out.unionByName(_by_line(long, files, before, after))


def _by_pair(findings: DataFrame, files: DataFrame, before: int, after: int) -> DataFrame:
    """Context of findings of few lines: a pair of lines travels as one number, and both texts of a pair as one row."""
    start = F.col("line_start").cast("long")
    pair = F.shiftleft(start, SPAN_BITS) + (F.col("line_end") - start)
    chunks = (findings.select(F.col("file_path").alias("path"), F.floor(start / CHUNK).alias("chunk"), pair.alias("pair"))
              .groupBy("path", "chunk").agg(F.collect_set("pair").alias("pairs")))
    wanted = chunks.groupBy("path").agg(F.flatten(F.collect_list("pairs")).alias("pairs"))
    types = {c: findings.schema[c].dataType for c in ("line_start", "line_end")}

    def serve(x: Column) -> Column:
        first = F.shiftright(x, SPAN_BITS).cast("int")
        last = first + x.bitwiseAND(F.lit((1 << SPAN_BITS) - 1)).cast("int")
        # A start line past the end of the file has no context at all, on either side.
        inside = lambda text: F.when(first <= F.size("lines"), text).otherwise("")
        return F.struct(
            first.cast(types["line_start"]).alias("line_start"), last.cast(types["line_end"]).alias("line_end"),
            inside(_window_text(F.col("lines"), F.greatest(first - 1, F.lit(0)) - before + 1, first - 1)).alias("context_before"),
            inside(_window_text(F.col("lines"), F.greatest(last, F.lit(0)) + 1, F.greatest(last, F.lit(0)) + after)).alias("context_after"))

    served = _with_lines(wanted.join(files.select("path", "content"), "path")).select(
        F.col("path").alias("file_path"), F.inline_outer(F.transform("pairs", serve)))
    out = findings.join(served, ["file_path", "line_start", "line_end"], "left")
    return out.select(*findings.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in ("context_before", "context_after")))


def _by_line(findings: DataFrame, files: DataFrame, before: int, after: int) -> DataFrame:
    """Context of any findings: start and end lines are asked for, and join, on their own, so a file asks at most twice a line."""
    ask = lambda side, line: findings.select(F.col("file_path").alias("path"), F.col(line).alias("line"), F.lit(side).alias("side"))
    at = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("line")))
    chunks = (ask("start", "line_start").unionByName(ask("end", "line_end"))
              .groupBy("path", F.floor(F.col("line") / CHUNK).alias("chunk"))
              .agg(at("start").alias("starts"), at("end").alias("ends")))
    wanted = chunks.groupBy("path").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")))
    served = materialise(_with_lines(wanted.join(files.select("path", "content"), "path")).select(
        F.col("path").alias("file_path"),
        # A start line past the end of the file has no context at all, on either side.
        F.transform("starts", lambda x: F.struct(
            x.alias("line_start"), (x <= F.size("lines")).alias("inside"),
            _window_text(F.col("lines"), F.greatest(x - 1, F.lit(0)) - before + 1, x - 1).alias("context_before"))).alias("starts"),
        F.transform("ends", lambda x: F.struct(
            x.alias("line_end"),
            _window_text(F.col("lines"), F.greatest(x, F.lit(0)) + 1, F.greatest(x, F.lit(0)) + after).alias("context_after"))).alias("ends")), "context")
    befores = served.select("file_path", F.inline("starts"))
    afters = served.select("file_path", F.inline("ends"))
    out = findings.join(befores, ["file_path", "line_start"], "left").join(afters, ["file_path", "line_end"], "left")
    return out.select(*findings.columns, *(F.when(F.col("inside"), F.coalesce(c, F.lit(""))).otherwise("").alias(c) for c in ("context_before", "context_after")))


def _imports_of(content: str) -> list[str]:
    lines, ends = _text_lines(content)
    kept: list[str] = []
    for i, line in enumerate(lines):
        body = line.strip(SPACE_CHARS)
        if body.startswith(("import ", "from ")):
            kept.append(line + ("\n" if i < len(lines) - 1 or ends else ""))
        elif kept and body and not body.startswith(("#", '"""', "'''")):
            break
    return kept


def import_block(files: DataFrame) -> DataFrame:
    """Leading imports of Python files: import lines up to the first other code line after an import.

    A narrow step that stops reading a file at its first other code line; no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if c is None else _imports_of(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if f is None else "".join(f) for f in found], pa.string()),
                                              pa.array([None if f is None else len(f) for f in found], pa.int64())], names=["path", "imports", "import_count"])

    return files.filter(F.col("path").endswith(".py")).select("path", "content").mapInArrow(run, "path string, imports string, import_count long")


def _functions_of(content: str, wanted: list[int]) -> dict[int, tuple[int, int]]:
    """(first, last line) of the function or class around each of the wanted lines, in one pass down and one up.

    Upwards, a stack keeps the code lines that may close something: each is indented less than the one above it in the file, so the
    line that closes a depth is found by bisection.
    """
    lines, _ = _text_lines(content)
    n = len(lines)
    indents: list[int] = []
    header = [-1] * n
    code = [False] * n
    last = -1
    for i, line in enumerate(lines):
        body = line.lstrip(SPACE_CHARS)
        indents.append(len(line) - len(body))
        if body.startswith(("def ", "class ")):
            last = i
        header[i] = last
        code[i] = body != "" and not body.startswith("#")
    asked: dict[int, list[int]] = {}  # by the first line that may close
    for w in wanted:
        if 1 <= w <= n and header[w - 1] >= 0:
            asked.setdefault(max(w, header[w - 1] + 2), []).append(w)
    found = {w: (header[w - 1] + 1, n) for ws in asked.values() for w in ws}
    depths: list[int] = []
    places: list[int] = []
    for i in range(n - 1, min(asked, default=n) - 1, -1):
        if code[i]:
            while depths and depths[-1] >= indents[i]:
                depths.pop(), places.pop()
            depths.append(indents[i])
            places.append(i)
        for w in asked.get(i, ()):
            at = bisect_right(depths, indents[header[w - 1]]) - 1
            if at >= 0:
                found[w] = (header[w - 1] + 1, places[at])
    return found


def enclosing_function(targets: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, line_no, func_start, func_end)`` for each target line: the nearest ``def``/``class`` line at or
    above it, down to the line before the next code line indented no deeper; null when there is none.

    What is wanted is reduced to the distinct lines of each file, which meet the file's text once; a stack of indents then gives
    all answers of a file in one pass over its lines.  No line ever leaves its file's row.
    """
    wanted = targets.select("path", "line_no").groupBy("path").agg(F.collect_set("line_no").alias("lines"), F.count_if(F.col("line_no").isNull()).alias("no_line"))
    asked = wanted.join(files.select("path", "content"), "path", "left").select("path", "lines", "no_line", "content")
    schema = T.StructType([targets.schema["path"], targets.schema["line_no"], T.StructField("func_start", T.IntegerType()), T.StructField("func_end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, numbers, starts, ends = [], [], [], []
            for path, lines, no_line, content in zip(*(batch.column(i) for i in range(4))):
                own = [*lines.as_py()] + [None] * bool(no_line.as_py())
                found = _functions_of(content.as_py(), [w for w in own if w is not None]) if content.is_valid else {}
                paths += [path.as_py()] * len(own)
                numbers += own
                starts += [found.get(w, (None, None))[0] for w in own]
                ends += [found.get(w, (None, None))[1] for w in own]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, batch.schema.field(1).type.value_type),
                                              pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["path", "line_no", "func_start", "func_end"])

    return asked.mapInArrow(run, schema)


def function_text(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the function's text; '' where there is none."""
    src = _with_lines(files.select("path", "content"))
    text = F.when(F.col("func_start").isNull(), "").otherwise(
        _window_text(F.col("lines"), F.col("func_start"), F.col("func_end")))
    return (functions.join(src, "path", "left")
            .select("path", "line_no", "func_start", "func_end", F.coalesce(text, F.lit("")).alias("function_text")))
