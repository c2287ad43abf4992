"""Language identification by prediction by partial matching.

Per language, byte contexts of up to three symbols form a variable-order tree
with counts.  A byte costs its exact code length under frozen counts: at each
order it is coded, or escaped with probability d/(n+d) (escape method C) to
the next shorter context, where the symbols already refused are excluded.  As
the counts are frozen, the code length depends only on (context, byte), so it
is tabulated once, for the contexts that a language has seen, and a text costs
one table look-up per byte and language.

Learning uses a bounded sample: per language about ``sample_docs`` labelled
rows, those whose hash lies in a share of its range, of rows of at most
``sample_bytes`` bytes.  Scoring covers every byte of every text.

Defined results: a null text or one without a letter gives ``und`` with score
0 and null bits; equal code lengths go to the alphabetically first language;
no labelled rows at all means every text is ``und``; repeated rows are scored
alike; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import LOWER, chunks

ORDER = 3
DENSE = 1 << 22  # contexts up to which a table gives each one's node; beyond, nodes are searched, with the same results


def learn_rows(docs: DataFrame, sample_docs: int, sample_bytes: int) -> list[tuple[str, str]]:
    """(lang, text) of the bounded learning sample; ``docs`` has doc_id, text and lang."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") <= sample_bytes)).select(
        F.col("lang"), F.col("text"), F.xxhash64(F.col("doc_id").cast("string"), F.octet_length("text")).alias("_h")
    )
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not counts:
        return []
    chosen = F.lit(False)
    for r in counts:
        share = min(1.0, sample_docs / r["n"])
        chosen = chosen | ((F.col("lang") == r["lang"]) & (F.pmod("_h", F.lit(1 << 40)) < int(share * (1 << 40))))
    found = usable.filter(chosen).groupBy("lang", "_h").agg(F.min("text").alias("text"))
    return sorted((r["lang"], r["text"]) for r in found.select("lang", "text").collect())


class PPM:
    """Code-length tables of all languages over shared context nodes."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in rows})
        seen = np.zeros(256, bool)
        coded = {lang: [] for lang in self.langs}
        for lang, text in rows:
            data = LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
            seen[data] = True
            coded[lang].append(data)
        self.lut = np.full(256, seen.sum() + 1, np.int32)  # the last symbol: a byte never seen
        self.lut[np.flatnonzero(seen)] = np.arange(1, seen.sum() + 1)
        self.lut = self.lut[LOWER]
        a = self.a = int(seen.sum()) + 2  # with the start symbol 0
        grams = {}
        for lang in self.langs:
            keys = []
            for data in coded[lang]:
                s = np.concatenate([np.zeros(ORDER, np.int64), self.lut[data].astype(np.int64)])
                keys.append(((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:])
            grams[lang] = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # Nodes: contexts of order 3 and 2 that any language has seen, and all of order 1.
        self.three = np.unique(np.concatenate([g // a for g, _ in grams.values()]))
        self.two = np.unique(self.three % (a * a))
        n3, n2 = len(self.three), len(self.two)
        self.node = None
        if a**3 <= DENSE:
            self.node = self._find(np.arange(a**3))
        self.tables, self.rows = [], []
        for lang in self.langs:
            g, c = grams[lang]
            ctx, sym = g // a, g % a
            three, at3 = np.unique(ctx, return_inverse=True)
            two, at2 = np.unique(ctx % (a * a), return_inverse=True)
            dense = lambda at, n, c=c, sym=sym: np.bincount(at * a + sym, c, n * a).reshape(n, a)
            count3, count2, count1, count0 = dense(at3, len(three)), dense(at2, len(two)), dense(ctx % a, a), np.bincount(sym, c, a)
            self.tables.append(np.concatenate([
                self._lengths([count3, count2[np.searchsorted(two, three % (a * a))], count1[three % a]], count0), self._lengths([count2, count1[two % a]], count0), self._lengths([count1], count0),
            ]).astype(np.float32))
            # The table's row of each node: the longest part of the context that this language has seen.
            one = len(three) + len(two)
            own2 = np.where(np.isin(self.two, two), len(three) + np.searchsorted(two, self.two), one + self.two % a)
            own3 = np.where(np.isin(self.three, three), np.searchsorted(three, self.three), own2[np.searchsorted(self.two, self.three % (a * a))])
            self.rows.append(np.concatenate([own3, own2, one + np.arange(a)]).astype(np.int32))
        self.nodes = n3 + n2 + a

    def _find(self, ctx: np.ndarray) -> np.ndarray:
        """Node of each context of three symbols."""
        a, n3, n2 = self.a, len(self.three), len(self.two)
        out = (n3 + n2 + ctx % a).astype(np.int32)
        for known, own, first in ((self.two, ctx % (a * a), n3), (self.three, ctx, 0)):
            if len(known):
                near = np.minimum(np.searchsorted(known, own), len(known) - 1)
                out = np.where(known[near] == own, first + near, out).astype(np.int32)
        return out

    @staticmethod
    def _lengths(orders: list[np.ndarray], order0: np.ndarray) -> np.ndarray:
        """Bits of each symbol in each context, longest context first."""
        n, a = orders[0].shape
        p, escape, refused = np.zeros((n, a)), np.ones((n, 1)), np.zeros((n, a), bool)
        for counts in [*orders, np.broadcast_to(order0, (n, a))]:
            counts = np.where(refused, 0, counts)
            total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            whole = np.where(total > 0, total + kinds, 1)
            p += escape * counts / whole
            escape = escape * np.where(total > 0, kinds / whole, 1)
            refused |= counts > 0
        p += np.where(refused, 0, escape / np.maximum(1, 256 - refused.sum(1, keepdims=True)))
        return -np.log2(np.maximum(p, 1e-30))

    def bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        if not len(data):
            return out
        s = self.lut[data]
        before = np.zeros((ORDER, len(s)), np.int32)
        for j in range(1, ORDER + 1):
            before[j - 1, j:] = s[:-j]
            for i in range(j):  # the first symbols of a row have no context from the row before
                edge = at[:-1] + i
                edge = edge[(edge < len(s)) & (edge < at[1:])]
                before[j - 1, edge] = 0
        a = self.a
        ctx = (before[2].astype(np.int64) * a + before[1]) * a + before[0]
        node = self._find(ctx) if self.node is None else self.node[ctx]
        full = np.flatnonzero(np.diff(at))
        for k, (table, rows) in enumerate(zip(self.tables, self.rows, strict=True)):
            cost = table.ravel()[rows[node].astype(np.int64) * a + s]
            out[full, k] = np.add.reduceat(cost, at[full], dtype=np.float64)
        return out


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row holds a letter of any script."""
    ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))])
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    found = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for r in np.flatnonzero(~found & (high[at[1:]] > high[at[:-1]])):
        found[r] = any(c.isalpha() for c in bytes(data[at[r] : at[r + 1]]).decode("utf-8", "replace"))
    return found


def identify(docs: DataFrame, learn: DataFrame, text: str = "text", *, sample_docs: int = 300, sample_bytes: int = 16384) -> DataFrame:
    """``docs`` with columns lang_pred, score (posterior of the predicted language under equal priors) and bits_per_byte.

    ``learn`` has doc_id, text, lang and is only sampled.  Columns of ``docs``
    of those three names are replaced.
    """
    spark = docs.sparkSession
    rows = learn_rows(learn, sample_docs, sample_bytes)
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType())]
    docs = docs.drop(*(n for n, _ in added))
    if not rows:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    model = spark.sparkContext.broadcast(PPM(rows))  # its size follows the sample, which is bounded
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in added)])
    place = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = model.value
        for batch in batches:
            for low, high, data, at in chunks(batch.column(place)):
                bits = ppm.bits(data, at)
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                posterior = 1 / np.exp2(np.maximum(-1000, least[:, None] - bits)).sum(1)
                known = has_letter(data, at)
                per_byte = least / np.maximum(1, np.diff(at))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.where(known, np.array(ppm.langs, object)[best], "und"), pa.string()), pa.array(np.where(known, posterior, 0.0)), pa.array(per_byte, mask=~known)],
                    names=[*part.schema.names, *(n for n, _ in added)],
                )

    return docs.mapInArrow(score, schema)


def keep_known(docs: DataFrame, learn: DataFrame, *, min_score: float = 0.5, max_bits_per_byte: float = 8.0) -> DataFrame:
    """Rows of ``docs`` whose language is known, with their own columns.

    Rejected: ``und``, a posterior under ``min_score``, or a text on which even
    the best model is no better than raw bytes.
    """
    named = identify(docs.withColumnRenamed("score", "_own_score") if "score" in docs.columns else docs, learn)
    kept = named.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score) & (F.col("bits_per_byte") < max_bits_per_byte))
    kept = kept.drop("lang_pred", "score", "bits_per_byte")
    return kept.withColumnRenamed("_own_score", "score") if "_own_score" in kept.columns else kept
