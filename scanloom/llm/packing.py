"""Best-fit packing of documents into fixed-length sequences: best-two-fit over the histogram of piece lengths.

Only the counts per length, ``capacity`` numbers at most, decide the packing, so the plan is made on the driver in bounded memory
at any number of documents; every piece finds its place by its rank among the pieces of its length, in Spark.

Best-two-fit: a bin is filled greedily, longest fitting piece first; then its smallest piece is given back and two unpacked
pieces that together fill the larger gap more tightly take its place.  A bin's pattern is repeated as long as the counts allow it,
so there are at most a few thousand different patterns.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.tables import batches, materialise, shards, ship_package

#: Distinct words whose ids a Python worker keeps at a time, in each of two generations.
CACHE = 150_000
_TOKENIZERS: dict[str, WordIds] = {}
#: In the bytes of texts that are not lower-cased: the start of a special token, and the first byte of U+0300 to U+037F, where all
#: marks are that compose with ASCII letters.
_AS_IT_IS = re.compile(rb"<\||[\xcc\xcd]")
#: The printable character that byte-level models use for each byte.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds:
    """Ids of the white-space separated words of texts, for a tokenizer file under which words are independent of each other.

    Each distinct word is encoded once; texts are joined from the words' ids.  Upper and lower case of ASCII letters are one word
    where the tokenizer lower-cases, except in texts that might hold a special token or hold combining marks: the normalizer composes
    before it lower-cases, and some marks compose with the small letter only.
    """

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}
        # The short way is for the pipeline it was written for; any other tokenizer encodes every word in full.
        steps = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            self._plain = lambda word: None

    def __call__(self, text: str | None) -> np.ndarray:
        raw = b"" if text is None else text.encode("utf-8", "replace")
        words = (raw if _AS_IT_IS.search(raw) else raw.lower()).split()
        try:
            return np.frombuffer(b"".join(map(self.new.__getitem__, words)), "<u4")
        except KeyError:
            pass
        missing = {w for w in words if w not in self.new}
        if len(self.new) + len(missing) > CACHE:
            self.old, self.new = self.new, {}
            missing = set(words)
        rest = []
        for w in missing:
            known = self.old.get(w)
            if known is None:
                known = self._plain(w)
            if known is None:
                rest.append(w)
            else:
                self.new[w] = known
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            self.new[w] = np.array(e.ids, "<u4").tobytes()
        return np.frombuffer(b"".join(map(self.new.__getitem__, words)), "<u4")

    def _plain(self, word: bytes) -> bytes | None:
        """Ids of small letters with ``.,;:!?`` behind them, or None for any other word.

        Letters that the normalizer leaves as they are form one piece for the model, and the marks another, so the model can be
        asked without the steps before it.
        """
        letters = word.rstrip(b".,;:!?")
        text = letters.decode()
        if not text.isalpha() or text.lower() != text or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return None
        mapped = text if text.isascii() else "".join(map(_BYTE_CHARS.__getitem__, letters))
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], "<u4").tobytes()
        marks = word[len(letters):]
        if marks:
            if marks not in self.marks:
                self.marks[marks] = np.array([t.id for t in self.tokenizer.model.tokenize(marks.decode())], "<u4").tobytes()
            ids += self.marks[marks]
        return ids


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): narrow."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, WordIds(tokenizer))
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
            for p, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at:at + capacity]
                rows.append((i, p, at, len(part), zlib.crc32(part.tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                         ["doc", "piece", "start", "length", "ids_crc32"]) if rows else _NONE

    return batches(docs.select(F.col(id_col).cast("long"), text_col), run, "doc long, piece int, start long, length long, ids_crc32 long")


_NONE = pa.RecordBatch.from_pylist([], pa.schema([("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, bins packed so), for counts of pieces by length; every piece is used once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []

    def longest(gap: int) -> int:
        """Longest length up to ``gap`` that is left, or 0."""
        fit = np.flatnonzero(left[1:gap + 1])
        return int(fit[-1]) + 1 if len(fit) else 0

    while left.any():
        bin_: list[int] = []
        gap = capacity
        while gap and (take := longest(gap)):
            bin_.append(take)
            left[take] -= 1
            gap -= take
        if gap and len(bin_) > 1:  # give back the smallest and look for a tighter pair
            small = bin_[-1]
            room = gap + small
            have = np.flatnonzero(left[:room])
            if len(have):
                # The best partner of each length is the longest that fits beside it.
                best = np.maximum.accumulate(np.where(left[:room + 1] > 0, np.arange(room + 1), 0))
                other = best[room - have]
                single = (other == have) & (left[have] < 2)
                for k in np.flatnonzero(single):
                    lower = np.flatnonzero(left[1:have[k]])
                    other[k] = lower[-1] + 1 if len(lower) else 0
                pair = np.where(other > 0, have + other, 0)
                k = int(pair.argmax())
                if pair[k] > small:
                    left[small] += 1
                    bin_[-1:] = [int(have[k]), int(other[k])]
                    left[bin_[-2]] -= 1
                    left[bin_[-1]] -= 1
        used: dict[int, int] = {}
        for x in bin_:
            used[x] = used.get(x, 0) + 1
        more = int(min(left[x] // n for x, n in used.items()))
        for x, n in used.items():
            left[x] -= n * more
        out.append((used, 1 + more))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document, in its sequence.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, into pieces of ``capacity`` ids.  Null and
    empty texts are the end id alone.  Repeated rows and rows without an id are packed as rows of their own.  Sequences are
    filled from offset 0 without gaps.  Other columns are not read.  Empty table: no rows.

    Ranks within a length come from counts per (length, salt), so a length that most pieces have is never one group.
    """
    spark = docs.sparkSession
    ship_package(spark)
    salt = F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(16 * shards(spark))).cast("int")
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("salt", salt), "pieces")
    per_salt = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs, sequence, seen = [], 0, dict.fromkeys(counts, 0)
    for used, times in plan(counts, capacity):
        offset = 0
        for length, n in used.items():
            runs.append((length, seen[length], seen[length] + n * times, n, sequence, offset))
            seen[length] += n * times
            offset += n * length
        sequence += times
    placed_at = spark.createDataFrame(runs, "length long, lo long, hi long, per long, sequence long, at long")

    before = per_salt.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    # A shard holds a piece's slice (length, salt); numbering inside it is a small group.
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "piece", "ids_crc32"))
    ranked = (cut.withColumn("inside", inside).join(before.select("length", "salt", "before"), ["length", "salt"])
              .withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("inside") - 1))
    # ``placed_at`` has at most some ten thousand rows at any number of documents: its size depends on the capacity only.
    out = ranked.join(F.broadcast(placed_at.withColumnRenamed("length", "len")), F.expr("length = len AND rank >= lo AND rank < hi"))
    k = F.col("rank") - F.col("lo")
    return out.select(F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32",
                      (F.col("sequence") + F.floor(k / F.col("per"))).alias("sequence_id"),
                      (F.col("at") + F.pmod(k, F.col("per")) * F.col("length")).alias("offset"))
