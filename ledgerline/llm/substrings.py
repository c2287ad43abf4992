"""Removal of repeated passages by hashing lines and their parts.

A text's units are its lines.  A line is normalised to its sequence of
lower-cased words and digested to 128 bits; a line without a word is no unit.
So that a passage is also found in the middle of a line, a line is cut
further, after sentences that one mark ends and after word pairs whose hash
falls in one of ``cut`` classes; parts under ``least`` words join the part
before them, at a line's start the one behind.  Every cut depends only on the
words beside it, so a passage is cut alike wherever it stands.

Digests of lines and parts are grouped over the whole corpus; the occurrence
in the least doc_id, and there the earliest, stays and all others are repeats.
A span is a run of words of which every line or part is a repeat itself, so no
word goes whose unit doesn't stand in an earlier place.  Spans of
``min_words`` words or more, of which the units that one document keeps hold
``min_anchored`` (``min_words``, if less), are reported with their code point
offsets in the original text; the second condition keeps short units that
recur by chance, each in another document, from making a span.

Defined results: null and empty texts and texts without a word have no span; a
line without a word inside a span goes with it; rows with equal doc_id are the
same occurrence, and each keeps its copy; a null doc_id ranks last; extra
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .textkit import NONBLANK, U, Words, chunks, code_points, mix


def unit_bounds(words: Words, data: np.ndarray, cut: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first words of lines, and of lines and their parts together."""
    n = len(words.hash)
    line = np.zeros(n, bool)
    line[words.at[:-1][words.at[:-1] < n]] = True
    marks, ends = (np.zeros(len(data) + 1, np.int64) for _ in range(2))
    np.cumsum((data == 46) | (data == 33) | (data == 63), out=marks[1:])
    np.cumsum(data == 10, out=ends[1:])
    left, right = words.end[:-1], words.start[1:]
    line[1:] |= ends[right] > ends[left]
    part = line.copy()
    # One mark and more between two words ends a sentence; "!!" behind every word does not.
    part[1:] |= (marks[right] - marks[left] == 1) & (right - left > 1)
    part[2:] |= mix(words.hash[:-2] * U(3) + words.hash[1:-1]) % U(cut) == 0
    first = np.flatnonzero(part)
    short = np.diff(np.append(first, n)) < least
    part[first[short & ~line[first]]] = False
    # The part behind a short one that begins a line.
    behind = first[1:][short[:-1] & line[first[:-1]]]
    part[behind[~line[behind]]] = False
    return np.flatnonzero(line), np.flatnonzero(part)


def line_edges(words: Words, data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of the lines of the given first and last words, without the blanks at both ends."""
    breaks, said = np.flatnonzero(data == 10), np.flatnonzero(NONBLANK[data])
    edge = np.concatenate([[-1], breaks, [len(data)]])
    start = np.maximum(edge[np.searchsorted(breaks, words.start[first])] + 1, at[row])
    end = np.minimum(edge[np.searchsorted(breaks, words.end[last]) + 1], at[row + 1])
    return said[np.searchsorted(said, start)], said[np.searchsorted(said, end) - 1] + 1


def units(rows: DataFrame, cut: int, least: int) -> DataFrame:
    """Lines and parts of ``rows`` (doc_id, row, text).

    ``idx`` is a unit's first part, ``parts`` how many it has; ``start`` and
    ``end`` are code points, ``words`` its words, d1 and d2 its digest, and
    ``again`` tells whether the row had it before.
    """
    source = rows.select("doc_id", "row", "text")
    whole = ("idx", "parts", "start", "end", "first_word", "words")
    schema = T.StructType([source.schema["doc_id"], source.schema["row"], *(T.StructField(n, T.IntegerType()) for n in whole), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("again", T.BooleanType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, at in chunks(batch.column(2)):
                words = Words(data, at)
                n = len(words.hash)
                if not n:
                    continue
                points = code_points(data)
                lines, parts = unit_bounds(words, data, cut, least)
                made = []
                for begin in (parts, lines):
                    last = np.append(begin[1:], n) - 1
                    place = (np.arange(n) - np.repeat(begin, last - begin + 1)).astype(U)
                    digest = [np.add.reduceat(mix(words.hash ^ mix(place + U(salt))), begin) for salt in (0x452821E638D01377, 0x3BD5AA1D07F3B2C9)]
                    row = np.searchsorted(words.at, begin, "right") - 1
                    start, end = words.start[begin], words.end[last]
                    whole_line = np.isin(begin, lines) & np.isin(last + 1, np.append(lines, n))
                    start[whole_line], end[whole_line] = line_edges(words, data, at, begin[whole_line], last[whole_line], row[whole_line])
                    idx = np.searchsorted(parts, begin)
                    made.append([row, idx, np.searchsorted(parts, last, "right") - idx, start, end, begin, last - begin + 1, *digest])
                many = made[1][2] > 1  # a line of one part is that part
                row, idx, count, start, end, first, size, d1, d2 = (np.concatenate([a, b[many]]) for a, b in zip(*made, strict=True))
                order = np.lexsort((idx, d2, d1, row))
                again = np.zeros(len(row), bool)
                a, b = order[:-1], order[1:]
                again[b] = (d1[a] == d1[b]) & (d2[a] == d2[b]) & (row[a] == row[b])
                base = points[at[row]]
                idx = idx - np.searchsorted(parts, words.at[row])
                pick = pa.array(low + row)
                numbers = [idx, count, points[start] - base, points[end] - base, first - words.at[row], size]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *(pa.array(x.astype(np.int32)) for x in numbers), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(again)], names=schema.names)

    return source.mapInArrow(each, schema)


def spans(rows: DataFrame, min_words: int, min_anchored: int, cut: int, least: int) -> DataFrame:
    """doc_id, row, start, end, n_words and first_doc_id of every repeated span of ``rows`` (doc_id, row, text)."""
    found = materialize(units(rows, cut, least), "units")
    # Written first, so that the join reads plain exchanges and a hot digest's rows can be split over tasks.
    shared = materialize(found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared")
    own = found.join(shared, ["d1", "d2"]).filter(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("first"))).drop("d1", "d2", "again")
    # A window holds one text's units; a unit begins a run if it lies behind all before it.
    order = Window.partitionBy("row").orderBy("idx", F.desc("parts"))
    reach = F.max(F.col("idx") + F.col("parts")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("reach", F.coalesce(reach, F.lit(-1)))
    marked = marked.withColumn("run", F.sum((F.col("idx") > F.col("reach")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    new = F.when(F.col("idx") + F.col("parts") > F.col("reach"), F.col("words")).otherwise(0)
    by_keeper = marked.groupBy("row", "run", "first").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_word").alias("a"), F.max(F.col("first_word") + F.col("words")).alias("b"), F.sum(new).alias("kept")
    )
    whole = by_keeper.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("b") - F.min("a")).cast("long").alias("n_words"), F.max("kept").alias("anchored"), F.min("first").alias("first_doc_id"))
    return whole.filter((F.col("n_words") >= min_words) & (F.col("anchored") >= min(min_words, min_anchored))).select("doc_id", "row", "start", "end", "n_words", "first_doc_id")


def repeats(docs: DataFrame, *, min_words: int = 8, min_anchored: int = 10, cut: int = 10, least: int = 3) -> DataFrame:
    """doc_id, row, start, end, n_words and first_doc_id of every repeated span of ``docs`` (doc_id, text).

    ``first_doc_id`` is the least document that keeps a unit of the span.
    """
    return spans(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), min_words, min_anchored, cut, least)


def strip_repeats(docs: DataFrame, *, min_words: int = 8, min_anchored: int = 10, cut: int = 10, least: int = 3) -> DataFrame:
    """doc_id, text without its repeated spans, and removed (array of start and end in the original) for every row of ``docs``."""
    # Rows are numbered once and written, as a second scan could number them otherwise.
    rows = materialize(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "texts")
    found = spans(rows, min_words, min_anchored, cut, least).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    joined = rows.join(found, "row", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = joined.withColumn("removed", F.coalesce("removed", none))
    ends = F.concat(F.array(F.lit(0)), F.col("removed.end"))
    starts = F.concat(F.col("removed.start"), F.array(F.length("text")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substr(F.col("text"), x["a"] + 1, x["b"] - x["a"]))
    return joined.select("doc_id", F.when(F.size("removed") > 0, F.array_join(kept, "")).otherwise(F.col("text")).alias("text"), "removed")
