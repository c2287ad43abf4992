"""Benchmark decontamination: BM25 over test items, searched by block-max WAND.

The test items are the indexed side.  A posting's BM25 weight is divided by
its item's total, so an item found whole scores 1; a passage's score is the
sum over its distinct words.  Items are indexed by length, up to 64 words, up
to 256, and so on by fours, so a long item doesn't change the passages that
others are sought in.  Every training text is cut into passages of 2L words,
one every L words, L being the length of the longest item of an index, so a
copied item lies whole in one passage.  Every passage is a query:

* the upper bound on all passages: words of the most items are set aside as
  long as they give no item more than ``slack`` of the threshold; an item can
  reach the threshold only if the other words give it the rest.  Their short
  posting lists are added up in numpy, and only passages that may pass go on;
* block-max WAND then retrieves all items at or above the threshold;
* a hit is verified: five-word shingles shared with the passage must cover
  ``overlap`` of the words of the question and of the answer each.  The answer
  is an item's last sentence, the question all before it; an item of one
  sentence is halved.  A part under five words is also covered by its exact
  word sequence at most an item's length from a run of the other part.

Items of two to four words aren't indexed; they match where their exact word
sequence stands.

What is broadcast at once is the indexes of about ``block_mb`` MB of items, so
it is bounded; further items make further scans.  Defined results: null and
empty texts and items never match; items of one word have no question and
answer to verify and are left out; equal items, those with a null item_id
included, are all reported; item ids may have any type; repeated rows are
reported alike; extra columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .textkit import U, Words, chunks, shingles

K1, B, BLOCK, SHINGLE = 1.2, 0.75, 64, 5


def answer_start(text: str, starts: np.ndarray) -> int:
    """Index of the first word of an item's answer; ``starts``: byte start of each word."""
    ends = [len(text[: m.end()].encode("utf-8", "replace")) for m in re.finditer(r"[.!?:]+(?=\s+\S)", text)]
    cut = int(np.searchsorted(starts, ends[-1])) if ends else 0
    return cut if 0 < cut < len(starts) else len(starts) // 2


def words_of(text: str) -> Words:
    """Words of one text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return Words(raw, np.array([0, len(raw)]))


class Index:
    """BM25 postings of test items in blocks, and what verification needs."""

    def __init__(self, items: list[tuple], threshold: float, slack: float = 0.6):
        self.threshold = threshold
        self.ids, self.words, self.answer = [], [], []
        brief: list[tuple] = []
        for i, text in items:
            own = words_of(text)
            if len(own.hash) >= SHINGLE:
                self.ids.append(i)
                self.words.append(own.hash)
                self.answer.append(answer_start(text, own.start))
            elif len(own.hash) > 1:
                brief.append((i, own.hash))
        n = len(self.ids)
        # Items of two to four words: their numbers by word sequence, of each length.
        self.brief: dict[int, dict[int, list[int]]] = {}
        for i, own in brief:
            run = int(shingles(_as_words(own), len(own))[1][0])
            self.brief.setdefault(len(own), {}).setdefault(run, []).append(len(self.ids))
            self.ids.append(i)
        self.longest = max([64, *(len(w) for w in self.words)])
        if not n:
            self.vocabulary = np.zeros(0, U)
            return
        flat, item = np.concatenate(self.words), np.repeat(np.arange(n), [len(w) for w in self.words])
        self.vocabulary, term = np.unique(flat, return_inverse=True)
        pair, tf = np.unique(term * n + item, return_counts=True)  # ordered by term, then item
        term, item = pair // n, pair % n
        df = np.bincount(term)
        sizes = np.array([len(w) for w in self.words])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / sizes.mean()))
        weight /= np.bincount(item, weight)[item]
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.item, self.weight = item, weight
        self.most = np.maximum.reduceat(weight, self.at[:-1])
        self.block_at = np.concatenate([[0], np.cumsum(-(-df // BLOCK))])
        first = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(self.at[:-1], self.at[1:], strict=True)])
        self.block_max = np.maximum.reduceat(weight, first)
        # Words set aside, commonest first.
        aside = np.zeros(n)
        self.rare = np.ones(len(df), bool)
        for t in np.argsort(-df, kind="stable"):
            own = slice(self.at[t], self.at[t + 1])
            if (aside[item[own]] + weight[own]).max() > slack * threshold:
                break
            aside[item[own]] += weight[own]
            self.rare[t] = False
        self.needed = threshold - aside - 1e-9
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.vocabulary[self.rare] >> U(48)).astype(np.int64)] = True

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, terms) of the word hashes that the index has."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        found = np.flatnonzero(self.vocabulary[at] == h)
        return found, at[found]

    def passages(self, words: Words) -> list[tuple[int, int, int]]:
        """(row, first word, end word) of the passages that the upper bound lets through."""
        length = self.longest
        maybe = np.flatnonzero(self.flags[(words.hash >> U(48)).astype(np.int64)])
        pos, term = self.terms(words.hash[maybe])
        pos, keep = maybe[pos], self.rare[term]
        pos, term = pos[keep], term[keep]
        if not len(pos):
            return []
        row = np.searchsorted(words.at, pos, "right") - 1
        stripe = (pos - words.at[row]) // length  # passage k holds stripes k and k+1
        stripes = -(-np.diff(words.at) // length)
        base = np.concatenate([[0], np.cumsum(np.maximum(1, stripes))])
        window = np.concatenate([base[row] + stripe, (base[row] + stripe - 1)[stripe > 0]])
        term = np.concatenate([term, term[stripe > 0]])
        window, term = np.divmod(np.unique(window * len(self.vocabulary) + term), len(self.vocabulary))
        count = self.at[term + 1] - self.at[term]
        own = np.repeat(self.at[term] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        key, back = np.unique(np.repeat(window, count) * len(self.ids) + self.item[own], return_inverse=True)
        score = np.bincount(back, self.weight[own])
        window = np.unique(key[score >= self.needed[key % len(self.ids)]] // len(self.ids))
        row = np.searchsorted(base, window, "right") - 1
        first = words.at[row] + (window - base[row]) * length
        return list(zip(row.tolist(), first.tolist(), np.minimum(first + 2 * length, words.at[row + 1]).tolist(), strict=True))

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of all items at or above the threshold for a set of terms, by block-max WAND."""
        goal = self.threshold - 1e-9
        cursors = [[int(self.item[self.at[t]]), int(self.at[t]), int(t)] for t in terms]
        found = []

        def seek(c, target):
            end = self.at[c[2] + 1]
            c[1] += int(np.searchsorted(self.item[c[1] : end], target))
            c[0] = int(self.item[c[1]]) if c[1] < end else math.inf

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= goal:
                    pivot = k
                    break
            if pivot is None:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # The blocks that hold the target in each list up to the pivot.
            blocks, past = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for c in cursors[: pivot + 1]:
                a, end = int(self.at[c[2]]), int(self.at[c[2] + 1])
                p = c[1] + int(np.searchsorted(self.item[c[1] : end], target))
                if p < end:
                    k = (p - a) // BLOCK
                    blocks += self.block_max[self.block_at[c[2]] + k]
                    past = min(past, int(self.item[min(a + (k + 1) * BLOCK, end) - 1]) + 1)
            if blocks < goal:
                past = max(past, target + 1)
                for c in cursors[: pivot + 1]:
                    if c[0] < past:
                        seek(c, past)
            elif cursors[0][0] == target:
                score = sum(float(self.weight[c[1]]) for c in cursors[: pivot + 1])
                if score >= goal:
                    found.append((target, score))
                for c in cursors[: pivot + 1]:
                    seek(c, target + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < target:
                        seek(c, target)
            cursors = [c for c in cursors if c[0] != math.inf]
        return found

    def overlaps(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the words of the question and of the answer that shared five-word shingles, or a part under five words as a whole, cover."""
        own = self.words[item]
        runs = [shingles(_as_words(x), SHINGLE)[1] for x in (own, passage)]
        hit = np.isin(runs[0], runs[1])
        covered = np.zeros(len(own), bool)
        for j in range(SHINGLE):
            covered[j : j + len(hit)] |= hit
        a = self.answer[item]
        parts, at = (own[:a], own[a:]), []
        for x in parts:
            size = min(SHINGLE, len(x))
            at.append(np.flatnonzero(np.isin(shingles(_as_words(passage), size)[1], shingles(_as_words(x), size)[1])))
        for k, place in enumerate((slice(0, a), slice(a, None))):
            if len(parts[k]) < SHINGLE and at[0].size and at[1].size and np.abs(at[0][:, None] - at[1]).min() <= len(own):
                covered[place] = True
        return float(covered[:a].mean()), float(covered[a:].mean())


def _as_words(h: np.ndarray) -> Words:
    """A row of word hashes as the words of one text."""
    out = object.__new__(Words)
    out.hash, out.at = h, np.array([0, len(h)])
    return out


def leaks(index: Index, words: Words, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item) -> (score, question overlap, answer overlap) of the verified hits of a chunk, best passage each."""
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not index.ids:
        return found
    for size, known in index.brief.items():
        row, run = shingles(words, size)
        for k in np.flatnonzero(np.isin(run, np.array(list(known), U))).tolist():
            found.update(((int(row[k]), item), (1.0, 1.0, 1.0)) for item in known[int(run[k])])
    if not len(index.vocabulary):
        return found
    for row, a, b in index.passages(words):
        h = words.hash[a:b]
        for item, score in index.retrieve(np.unique(index.terms(h)[1])):
            q, r = index.overlaps(item, h)
            if q >= overlap and r >= overlap:
                found[row, item] = max(found.get((row, item), (0.0, 0.0, 0.0)), (score, q, r))
    return found


def build(items: list[tuple], threshold: float) -> list[Index]:
    """Indexes of items (id, text) by length, in order of their ids, nulls first."""
    items = sorted(items, key=lambda x: (1, x[0], x[1]) if x[0] is not None else (0, x[1]))
    groups: dict[int, list] = {}
    for x in items:
        size, limit = len(words_of(x[1]).hash), 64
        while limit < size:
            limit *= 4
        groups.setdefault(limit, []).append(x)
    return [Index(groups[k], threshold) for k in sorted(groups)]


def indexes(items: DataFrame, threshold: float, block_mb: float) -> Iterator[list[Index]]:
    """Indexes of about ``block_mb`` MB of rows of ``items`` (item_id, text) at a time."""
    usable = items.filter(F.col("text").isNotNull()).select("item_id", "text")
    size = usable.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]
    blocks = max(1, int(-(-size // max(1, int(block_mb * (1 << 20))))))
    for k in range(blocks):
        part = usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else usable
        yield build([(r["item_id"], r["text"]) for r in part.collect()], threshold)


def find_leaks(docs: DataFrame, items: DataFrame, *, threshold: float = 0.5, overlap: float = 0.5, block_mb: float = 32) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every verified leak of ``items`` (item_id, text) in ``docs`` (doc_id, text)."""
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType), *(T.StructField(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap"))])
    item_type = to_arrow_type(schema["item_id"].dataType)
    found = None
    for some in indexes(items, threshold, block_mb):
        sent = docs.sparkSession.sparkContext.broadcast(some)

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, _, data, at in chunks(batch.column(1)):
                    words = Words(data, at)
                    hits = [(row, index.ids[i], v) for index in sent.value for (row, i), v in sorted(leaks(index, words, overlap).items())]
                    if hits:
                        ids = batch.column(0).take(pa.array([low + r for r, _, _ in hits]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i, _ in hits], item_type), *(pa.array([v[k] for _, _, v in hits]) for k in range(3))], names=schema.names)

        part = source.mapInArrow(each, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, items: DataFrame, *, threshold: float = 0.5, overlap: float = 0.5, block_mb: float = 32) -> DataFrame:
    """The rows of ``docs`` without a verified leak, with their own columns."""
    place, schema = docs.columns.index("text"), docs.schema
    for some in indexes(items, threshold, block_mb):
        sent = docs.sparkSession.sparkContext.broadcast(some)

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, data, at in chunks(batch.column(place)):
                    words, good = Words(data, at), np.ones(high - low, bool)
                    for index in sent.value:
                        good[[r for r, _ in leaks(index, words, overlap)]] = False
                    yield batch.slice(low, high - low).filter(pa.array(good))

        docs = docs.mapInArrow(each, schema)
    return docs
