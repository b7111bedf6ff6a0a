"""Near-duplicate documents by a signature-coordinate inverted join.

A document's set of word shingles gets a MinHash signature of ``coords`` coordinates.  It is posted under its coordinate-value
pairs; documents that agree on at least ``least`` coordinates are compared on their full sets.

Prefix: two documents that agree on ``least`` of ``coords`` coordinates agree on one of the first ``coords - least + 1`` in any
common order.  The order is rarest pair first, so a document is posted only under its rarest pairs: a passage that many documents
share sits at the end and is not posted, and a document with enough pairs of its own is not posted at all.
Skip: the long lists left are not merged pair by pair.  First every document of a list meets the list's smallest id only, and what
is confirmed is joined into components.  Then only documents of different components still meet, so a list whose documents are
already connected is skipped whole.  Nothing is lost by that: a pair left out lies inside one component.  Of these documents, each counts
its shingles that any other of them has at all.  A pair cannot have more in common than the smaller count, which must reach the
overlap that the similarity asks of two sets of their sizes: variants of one text that each differ too much do not meet pairwise.
The others meet in one list only, and only if their odd sketches, made for these documents alone, differ in few enough places: a sketch
keeps of each place how many shingles fall there, modulo 2, so two sketches differ in at most as many places as the sets differ
in shingles, and a pair that differs in more cannot be similar enough.  For large sets, which fill a sketch, wide signatures must agree
often enough as well.

With similarity 0.8, 64 coordinates and 36 agreements a true pair is missed with probability below 1e-5 at exactly 0.8 and falling
fast above it.  Equal sets are joined before, by their fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.components import components
from scanloom.llm.tables import batches, materialise, ship_package
from scanloom.llm.words import chunks, lowered, mix, separators, word_hashes

_TABLE = separators()
_rng = np.random.RandomState(77)
_MUL = _rng.randint(0, 2**62, 512, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.randint(0, 2**62, 512, dtype=np.int64).astype(np.uint64)
#: Shingles of one text that meet all coordinates at a time.
_STEP = 4096
#: Places of an odd sketch (64 to a number).  Sets with more shingles than ``LARGE`` also get signatures of ``WIDE`` coordinates, a byte each.
PLACES, LARGE, WIDE = 4096, 8192, 512


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``words`` consecutive words, or all of them if there are fewer."""
    for _, part in chunks([lowered(t) for t in texts]):
        h, first = word_hashes(part, _TABLE)
        n = max(0, len(h) - words + 1)
        s = np.zeros(n, np.uint64)
        for j in range(words):
            s += h[j:j + n] * _MUL[j]
        s = mix(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(s[a:b - words + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _MUL[:b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, coords: int) -> np.ndarray:
    """Per coordinate the least hash of the set, as a 32-bit integer."""
    out = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), _STEP):
        np.minimum(out, (shingles[a:a + _STEP, None] * _MUL[:coords] + _ADD[:coords]).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, coords: int) -> DataFrame:
    """(doc, version, n, k1, k2, sig): id and hash of the text, size, 128-bit fingerprint and signature of each document's set; narrow."""
    def run(batch: pa.RecordBatch):
        rows: dict[str, list] = {"doc": batch.column(0), "version": batch.column(2), "n": [], "k1": [], "k2": [], "sig": []}
        for s in shingle_sets(batch.column(1).to_pylist(), words):
            rows["n"].append(len(s))
            rows["k1"].append(int(s.sum(dtype=np.uint64).view(np.int64)))
            rows["k2"].append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
            rows["sig"].append(signature(s, coords) if len(s) else np.zeros(0, np.int32))
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.list_(pa.int32()))]))

    return batches(versions(docs, id_col, text_col), run, "doc long, version long, n long, k1 long, k2 long, sig array<int>")


def versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, version): one id may have several texts, which the hash tells apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))


def _rep() -> Column:
    return F.struct("doc", "version").alias("rep")


def shared_counts(texts: DataFrame, words: int) -> DataFrame:
    """(rep, u): how many of each document's shingles another document of the table has too."""
    def run(batch: pa.RecordBatch):
        sets = list(shingle_sets(batch.column(2).to_pylist(), words))
        at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), pa.int64())
        shingles = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), shingles], ["doc", "version", "s"])

    posts = batches(texts.select("rep.doc", "rep.version", "text"), run, "doc long, version long, s long")
    common = posts.groupBy("s").count().filter("count > 1")
    return posts.join(common, "s", "left_semi").groupBy("doc", "version").agg(F.count("*").alias("u")).select(_rep(), "u")


def wide_least(percent: int) -> int:
    """Agreements of wide signatures that a pair of this similarity misses with probability below 1e-7."""
    p = percent / 100
    return int(WIDE * p - 5.36 * (WIDE * p * (1 - p)) ** 0.5)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Per place whether an odd number of shingles falls there, as 64-bit integers."""
    odd = np.bincount((mix(shingles) % np.uint64(PLACES)).astype(np.int64), minlength=PLACES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(rep, odd, sig): the odd sketch of each document of the table; the wide signature of large sets, else an empty one."""
    none = np.zeros(0, np.int8)

    def run(batch: pa.RecordBatch):
        odd, sig = [], []
        for s in shingle_sets(batch.column(2).to_pylist(), words):
            odd.append(odd_sketch(s))
            sig.append(signature(s, WIDE).astype(np.int8) if len(s) > LARGE else none)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int8()))], ["doc", "version", "odd", "sig"])

    return batches(texts.select("rep.doc", "rep.version", "text"), run, "doc long, version long, odd array<long>, sig array<tinyint>").select(_rep(), "odd", "sig")


def prefixes(reps: DataFrame, coords: int, least: int) -> DataFrame:
    """(rep, n, coord, value): the rarest ``coords - least + 1`` pairs of each document, without those that nobody shares."""
    posts = reps.select("rep", "n", F.posexplode("sig").alias("coord", "value"))
    often = posts.groupBy("coord", "value").count().filter("count > 1")
    mine = posts.join(often, ["coord", "value"]).groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("count", "coord", "value"))).alias("p"))
    kept = mine.filter(F.size("p") >= least).withColumn("p", F.expr(f"slice(p, 1, {coords - least + 1} - ({coords} - size(p)))"))
    return kept.select("rep", "n", F.explode("p").alias("p")).select("rep", "n", "p.coord", "p.value")


def agreement() -> Column:
    """Coordinates in which the signatures ``sa`` and ``sb`` agree."""
    return F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, words: int, least: int, percent: int) -> DataFrame:
    """Ids (a, b) of the pairs that agree on ``least`` coordinates and whose full sets reach the similarity."""
    near = (pairs.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
            .join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
            .filter(agreement() >= least).select("a", "b"))
    both = (near.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b"), "ta", "tb"))

    def run(batch: pa.RecordBatch):
        ok = []
        for x, y in zip(shingle_sets(batch.column(2).to_pylist(), words), shingle_sets(batch.column(3).to_pylist(), words)):
            same = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * same >= percent * (len(x) + len(y) - same) > 0)
        yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return batches(both, run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80,
                    coords: int = 64, least: int = 36) -> DataFrame:
    """(``id_col``, n_shingles, component_id, kept) for every document.

    Documents whose shingle sets have ``100 * intersection >= percent * union`` are linked; ``component_id`` is the smallest id
    reachable and ``kept`` says whether the document is it.  Null or wordless text: an empty set, linked with nothing.  A document
    of fewer than ``words`` words has its whole sequence as the only shingle.  Ids given several times: one row, with the smallest
    component and the largest set among their texts.  Rows without an id take no part.  Other columns are not read.  Empty table:
    no rows.
    """
    ship_package(docs.sparkSession)
    docs = docs.filter(F.col(id_col).isNotNull())
    signed = materialise(signatures(docs, id_col, text_col, words, coords), "signatures")
    key = ["n", "k1", "k2"]
    # A class of equal sets is known by its smallest id, and by the hash of a text: an id with several texts may stand for several classes.
    classes = signed.filter("n > 0").groupBy(*key).agg(F.min(F.struct("doc", "version")).alias("rep"))
    of_doc = materialise(signed.filter("n > 0").join(classes, key).select("doc", "version", "n", "rep"), "classes")
    ids = of_doc.filter("doc = rep.doc AND version = rep.version").select("rep", "n").distinct()
    reps = ids.join(signed.select(_rep(), "n", "sig"), ["rep", "n"]).dropDuplicates(["rep"])
    posted = materialise(prefixes(reps, coords, least), "prefixes")
    involved = posted.select("rep").distinct()
    texts = materialise(versions(docs, id_col, text_col).select(_rep(), "text").join(involved, "rep", "left_semi").dropDuplicates(["rep"]), "texts")
    signs = materialise(reps.join(involved, "rep", "left_semi").select("rep", "sig"), "signs")

    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    heads = posted.groupBy("coord", "value").agg(F.min(F.struct("rep", "n")).alias("h"))
    star = posted.join(heads, ["coord", "value"]).select(F.col("h.rep").alias("a"), F.col("h.n").alias("m"), F.col("rep").alias("b"), "n")
    star = materialise(star.filter(f"a <> b AND {fits}").select("a", "b").distinct(), "stars")
    edges = materialise(confirmed(star, signs, texts, words, least, percent), "links")

    found = components(edges).withColumnRenamed("node", "id")
    placed = posted.withColumn("id", F.col("rep.doc")).join(found, "id", "left").withColumn("c", F.coalesce("component", "id"))
    open_lists = placed.groupBy("coord", "value").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("coord", "value")
    left = materialise(placed.join(open_lists, ["coord", "value"], "left_semi").select("coord", "value", "rep", "n", "c"), "open")
    counts = shared_counts(texts.join(left.select("rep").distinct(), "rep", "left_semi"), words)
    # 100 i >= percent (n + m - i) asks for (100 + percent) i >= percent (n + m); alone, i >= percent n / 100.
    open_now = left.join(counts, "rep").filter(f"100 * u >= {percent} * n").withColumn("code", F.shiftleft(F.col("coord").cast("long"), 32) + F.col("value"))
    # Two documents meet in one list only, the first of those that they share, and only if their sketches allow it.
    asked = texts.join(open_now.select("rep").distinct(), "rep", "left_semi")
    whole = open_now.groupBy("rep").agg(F.collect_list("code").alias("codes")).join(sketches(asked, words), "rep")
    left = materialise(open_now.join(whole, "rep").select("code", "rep", "n", "c", "u", "codes", "odd", "sig"), "open")
    right = left.select("code", *(F.col(x).alias(y) for x, y in {"rep": "b", "n": "m", "c": "d", "u": "v", "codes": "others", "odd": "ob", "sig": "sb"}.items()))
    may = F.expr(f"a < b AND c <> d AND {fits} AND {100 + percent} * least(u, v) >= {percent} * (n + m)")
    once = F.array_min(F.array_intersect("codes", "others")) == F.col("own")
    apart = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # The sets differ in n + m - 2 i shingles, and i >= percent (n + m) / (100 + percent).
    close = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m"))
    wide = (F.size("sa") == 0) | (F.size("sb") == 0) | (agreement() >= wide_least(percent))
    mine = left.withColumnsRenamed({"rep": "a", "sig": "sa", "odd": "oa", "code": "own"})
    rest = mine.join(right, (F.col("own") == F.col("code")) & may & close & once & wide).select("a", "b")
    more = confirmed(rest.join(star, ["a", "b"], "left_anti"), signs, texts, words, least, percent)
    final = materialise(components(edges.unionByName(more)), "components")

    of_class = of_doc.withColumn("id", F.col("rep.doc")).join(final.withColumnRenamed("node", "id"), "id", "left").select("doc", "n", F.coalesce("component", "id").alias("c"))
    lone = signed.filter("n = 0").select("doc", "n", F.col("doc").alias("c"))
    out = of_class.unionByName(lone).groupBy("doc").agg(F.max("n").alias("n_shingles"), F.min("c").alias("component_id"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))
