"""Near-duplicates by ProbMinHash, banding and verification.

A text's words are runs of ASCII letters and digits and of non-ASCII
characters, A-Z and Latin-1 capitals lower-cased; its shingles are all runs of five words (all its
words, if fewer).  A shingle seen c times weighs 1+ln(c).  ProbMinHash lets
each shingle arrive at random registers at the times of a Poisson process
whose rate is its weight; a register keeps its earliest arrival, and a shingle
ends when its next arrival is later than all registers hold.  Two texts agree
in a register with their probability Jaccard similarity.

Texts with equal word sequences form one digest, and only one text of a digest
goes on.  Each band of four registers is a bucket.  A bucket's members are
first linked to its most central texts, its leaders; links are verified by the
exact Jaccard similarity of the shingle sets (32-bit hashes).  Then every two
members of a bucket that those links leave in different components are
compared, unless their registers rule a link out: a task holds two blocks of a
bucket, or several small buckets, with their shingle sets, and gives out only
the links that join components, so neither pairs nor a whole bucket are made
into rows.  Members of a bucket's largest component aren't compared with each
other.  Classes are the connected components of all links.

Defined results: null and empty texts and texts without a word have a class of
their own each; repeated rows share a class; a null doc_id takes part like
any other id and sorts last, so it names a class, or is kept, only where no row
of the class has an id; ties go to the least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .scratch import materialize
from .textkit import U, Words, binary_column, chunks, mix, sequence_digests, shingles, to_unit

SHINGLE, REGISTERS, ROWS, LEADERS = 5, 64, 4, 4


def weighted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles of each row, in order."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def probminhash(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers) signatures: in each register the shingle of the earliest arrival."""
    times = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, U)
    at = np.zeros(len(h))
    live, turn = np.arange(len(h)), 0
    latest = np.full(n, np.inf)
    while len(live):
        # A few arrivals at once where few shingles are left.
        burst = 1 if len(live) > 4096 else 8
        own, now = h[live], at[live]
        for _ in range(burst):
            turn += 1
            draw = mix(own ^ U(turn * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
            now = now - np.log(to_unit(draw)) / weight[live]
            cell = row[live] * registers + (mix(draw + U(0x632BE59BD9B4E019)) % U(registers)).astype(np.int64)
            np.minimum.at(times, cell, now)
            won = times[cell] == now
            kept[cell[won]] = own[won]
        at[live] = now
        latest = times.reshape(n, registers).max(1)
        live = live[at[live] < latest[row[live]]]
    return kept.reshape(n, registers)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), digest, bands and sig (low bytes of the registers) of every row of ``docs`` (doc_id, text); digest is null without a word."""
    bands = REGISTERS // ROWS
    source = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    schema = T.StructType([source.schema["doc_id"], source.schema["th"], T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, at in chunks(batch.column(2)):
                words = Words(data, at)
                n = len(at) - 1
                row, h, count = weighted(*shingles(words, SHINGLE))
                signature = probminhash(row, h, 1 + np.log(count), n)
                made = np.zeros((n, bands), U)
                for r in range(ROWS):
                    made = mix(made * U(0x9E3779B97F4A7C15) + signature[:, r::ROWS] + U(r + 1))
                blank = np.diff(words.at) == 0
                digest = binary_column(sequence_digests(words))
                digest = pc.if_else(pa.array(~blank), digest, pa.scalar(None, pa.binary()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(made.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), batch.column(1).slice(low, n), digest, lists, binary_column((signature & U(255)).astype(np.uint8))], names=schema.names)

    return source.mapInArrow(each, schema)


def bitmap(ids: DataFrame, bits: int = 23) -> np.ndarray:
    """2**bits flags (1 MB at 23), set for the hash of each id: a bounded prefilter, exact joins follow."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(F.floor(place / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest and set (sorted 32-bit shingle hashes, binary) of one row for each digest in ``wanted`` (id, digest)."""
    bits = 23
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap(wanted, bits), bitorder="little"))
    source = docs.select(F.col("doc_id").alias("id"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("place"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(1).to_numpy()
            good = (flags.value[place >> 3] >> (place & 7)) & 1 == 1
            for low, _, data, at in chunks(batch.column(2).filter(pa.array(good))):
                words = Words(data, at)
                n = len(at) - 1
                row, h = shingles(words, SHINGLE)
                row, h, _ = weighted(row, h >> U(32))
                edge = np.searchsorted(row, np.arange(n + 1)).astype(np.int64) * 4
                raw = h.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [binary_column(sequence_digests(words)), pa.array([raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["digest", "set"]
                )

    made = source.mapInArrow(each, "digest binary, set binary")
    return made.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b) with linked: whether their shingle sets have at least ``threshold`` Jaccard similarity."""
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("digest").alias("b"), F.col("set").alias("sb")), "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                if min(len(p), len(q)) < threshold * max(len(p), len(q)):
                    linked.append(False)
                    continue
                linked.append(alike(p, q, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return both.select("a", "b", "sa", "sb").mapInArrow(each, "a binary, b binary, linked boolean")


def against_leaders(members: DataFrame, leaders: DataFrame, floor: float) -> DataFrame:
    """(digest, leader) of members and the leader of their bucket that their registers look most like; ``across`` seeks the other links.

    Registers agree in about the share that the texts are alike; with 64 of
    them (four agree, as the bucket is shared) a similarity of 0.8 is seen under
    ``floor`` = 0.62 about once in 10,000 by the binomial law, and a pair shares
    several buckets.
    """
    met = members.join(leaders, ["band", "key"]).select("band", "key", "digest", "sig", "leaders")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i in range(batch.num_rows):
                own = batch.column(2)[i].as_py()
                sig = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8)
                listed = batch.column(4)[i].values
                names = listed.field(0)
                agree = (np.frombuffer(b"".join(listed.field(1).to_pylist()), np.uint8).reshape(-1, REGISTERS) == sig).mean(1)
                agree[[names[j].as_py() == own for j in range(len(names))]] = 0
                best = int(agree.argmax())
                if agree[best] >= floor:
                    at.append(i)
                    found.append(names[best].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], names=["digest", "leader"])

    return met.mapInArrow(each, "digest binary, leader binary")


def joining(band: np.ndarray, root: np.ndarray, free: np.ndarray, side: np.ndarray, keys: np.ndarray, sig: np.ndarray, sets: list, threshold: float, floor: float) -> list[tuple[int, int]]:
    """Links between the rows of one bucket that join components, by their places.

    Rows of one ``side`` are compared with those of another, or all with each
    other if there is one side only; ``free`` rows, those outside the largest
    component, with all, others with free ones.  A pair is judged in the first
    band that it shares.
    """
    n = len(root)
    agree = np.zeros((n, n))
    for i in range(0, n, 128):  # 128 rows against all at a time
        agree[i : i + 128] = (sig[i : i + 128, None, :] == sig[None, :, :]).mean(2)
    may = (agree >= floor) & (root[:, None] != root[None, :]) & (free[:, None] | free[None, :]) & np.triu(np.ones((n, n), bool), 1)
    if len(np.unique(side)) > 1:
        may &= side[:, None] != side[None, :]
    a, b = np.nonzero(may)
    size = np.array([len(x) for x in sets])
    good = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
    a, b = a[good], b[good]
    first = (keys[a] == keys[b]).argmax(1) == band[0]
    a, b = a[first], b[first]
    order = np.argsort(-agree[a, b], kind="stable")
    parent = {int(r): int(r) for r in root}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    out = []
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = top(int(root[i])), top(int(root[j]))
        if x != y and alike(sets[i], sets[j], threshold):
            parent[x] = y
            out.append((i, j))
    return out


def alike(p: np.ndarray, q: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have at least ``threshold`` Jaccard similarity."""
    common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
    return common >= threshold * (len(p) + len(q) - common)


def across(buckets: DataFrame, groups: DataFrame, sets: DataFrame, roots: DataFrame, threshold: float, floor: float, block: int = 256, block_mb: int = 4) -> DataFrame:
    """Verified links (a, b) between members of one bucket with different roots, all that can join two components.

    ``buckets`` has digest, band and key; ``roots`` the components so far
    (digest, root) of every digest in it.
    """
    placed = buckets.join(roots, "digest").join(sets.select("digest", F.octet_length("set").cast("long").alias("size")), "digest")
    per_root = placed.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    mixed = per_root.groupBy("band", "key").agg(F.max(F.struct("n", "root", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / (block_mb << 20))).cast("int")
    mixed = mixed.select("band", "key", F.col("top.root").alias("largest"), "n", parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("few"), parts(F.col("top.n"), F.col("top.size")).alias("many"))
    mixed = materialize(mixed, "mixed")
    # Buckets of one block a side share tasks' groups of about a block's rows.
    shared = mixed.filter("few = 1 and many = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    together = max(1, -(-shared // block))
    free = F.col("root") != F.col("largest")
    own = F.when(free, F.pmod(F.xxhash64("digest"), F.col("few"))).otherwise(F.pmod(F.xxhash64("digest"), F.col("many"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pair = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    zero = F.lit(0)
    against = F.transform(upto("few"), lambda j: pair(1, F.least("own", j), F.greatest("own", j), F.when(F.col("own") <= j, 0).otherwise(1)))
    spread = F.when(free, F.concat(against, F.transform(upto("many"), lambda j: pair(2, F.col("own"), j, zero)))).otherwise(F.transform(upto("few"), lambda i: pair(2, i, F.col("own"), F.lit(1))))
    alone = (F.col("few") == 1) & (F.col("many") == 1)
    where = placed.drop("size").join(mixed, ["band", "key"]).withColumn("own", own)
    where = where.withColumn("at", F.explode(F.when(alone, F.array(pair(0, zero, zero, zero))).otherwise(spread)))
    name = F.when(alone, F.pmod(F.xxhash64("band", "key"), F.lit(together))).otherwise(F.xxhash64("band", "key"))
    where = where.select(name.alias("name"), "at.kind", "at.i", "at.j", "at.side", "band", "key", "digest", "root", free.alias("free"))
    whole = where.join(groups.select("digest", "bands", "sig"), "digest").join(sets, "digest").drop("id")

    def judge(table: pa.Table) -> pa.Table:
        band, key, side, free = (table[n].to_numpy() for n in ("band", "key", "side", "free"))
        digests = table["digest"].to_pylist()
        root = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1]
        keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(band), -1)
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(band), -1)
        sets = [np.frombuffer(x, "<u4") for x in table["set"].to_pylist()]
        order = np.lexsort((key, band))
        cut = np.flatnonzero(np.concatenate([[True], (band[order][1:] != band[order][:-1]) | (key[order][1:] != key[order][:-1])]))
        found = []
        for mine in np.split(order, cut[1:]):
            if len(mine) > 1:
                links = joining(band[mine], root[mine], free[mine], side[mine], keys[mine], sig[mine], [sets[k] for k in mine], threshold, floor)
                found += [(digests[mine[i]], digests[mine[j]]) for i, j in links]
        return pa.table({"a": pa.array([min(x) for x in found], pa.binary()), "b": pa.array([max(x) for x in found], pa.binary())})

    return whole.groupBy("name", "kind", "i", "j").applyInArrow(judge, "a binary, b binary").distinct()


def links(docs: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between digests; ``groups`` has digest, id (a row's doc_id), bands and sig."""
    buckets = groups.select("digest", "sig", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = buckets.join(shared, ["band", "key"])
    # Texts in many and large buckets are central to their group and lead first.
    central = members.groupBy("digest").agg(F.sum("n").alias("pull"))
    members = materialize(members.drop("n").join(central, "digest"), "members")
    wanted = groups.select("digest", "id").join(central.select("digest"), "digest")
    sets = materialize(shingle_sets(docs, wanted), "sets")
    order = Window.partitionBy("band", "key").orderBy(F.desc("pull"), "digest")
    first = members.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= LEADERS)
    leaders = materialize(first.groupBy("band", "key").agg(F.collect_list(F.struct("digest", "sig")).alias("leaders")), "leaders")
    floor = threshold - 0.18
    met = against_leaders(members, leaders, floor).select(F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b")).distinct()
    found = materialize(verify(met, sets, threshold), "judged").filter("linked").select("a", "b")
    buckets = members.select("digest", "band", "key")
    roots = components(found).withColumnRenamed("node", "digest")
    roots = central.select("digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    return found.unionByName(materialize(across(buckets, groups, sets, materialize(roots, "roots"), threshold, floor), "across"))


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, th, digest, class_id (least doc_id of the class), class_size (rows) of every row of ``docs`` (doc_id, text)."""
    rows = materialize(sketch(docs), "sketch")
    groups = materialize(rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n")), "digests")
    roots = components(links(docs, groups, threshold))
    named = groups.select("digest", "id", "n").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    sized = named.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    of = named.select("digest", "root").join(sized, "root").select("digest", "class_id", "class_size", F.col("root").alias("class_key"))
    out = rows.select("doc_id", "th", "digest").join(of, "digest", "left")
    return out.withColumns({"class_id": F.coalesce("class_id", "doc_id"), "class_size": F.coalesce("class_size", F.lit(1).cast("long"))})


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` (with doc_id and text) less all but one document of each class, the one of least doc_id; rows without a word stay."""
    placed = materialize(classes(docs.select("doc_id", "text"), threshold), "classes")
    worded = placed.filter("digest is not null")
    first = worded.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f"))
    counts = worded.groupBy("class_key", "doc_id", "th").agg(F.count(F.lit(1)).alias("_copies"))
    chosen = counts.join(first.select("class_key", F.col("f.doc_id").alias("fd"), F.col("f.th").alias("ft")), "class_key").filter(F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft")))
    chosen = chosen.select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_th"), "_copies")
    blank = placed.filter("digest is null").select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_th"), F.lit(1).cast("long").alias("_copies")).distinct()
    own = docs.columns
    hashed = docs.withColumn("_th", F.xxhash64("text"))
    found = hashed.join(chosen.unionByName(blank), hashed["doc_id"].eqNullSafe(F.col("_kept_id")) & hashed["_th"].eqNullSafe(F.col("_kept_th")))
    single = found.filter("_copies = 1").select(own)
    repeated = found.filter("_copies > 1").dropDuplicates(["_kept_id", "_kept_th"]).select(own)
    return single.unionByName(repeated)
