"""Secret scanning: fixed patterns, and a character convolutional network over other candidates.

Patterns (``assign``, ``access``, ``hex``) always count.  Every further
candidate, a run of 16 or more token characters with a letter or a digit
outside the patterns' spans (what such spans leave of a run is a candidate of
its own), is judged with 32 bytes before it and after it, in overlapping
windows of which the highest probability counts, by a small convolutional
network in numpy (byte embedding, width-5 convolution, max and mean pooling,
one dense layer).  It is trained on labelled findings made by a seeded
generator and calibrated by Platt scaling on a part held out from that; its
threshold is the highest that keeps ``recall`` on another part held out from
both, and its recall and precision there are kept with it.

Spans are in code points.  Defined results: a null or empty text has no span
and the digest of the empty string; texts of any length are read whole;
overlapping spans of different kinds are all listed and are masked once;
repeated rows get equal results; extra columns stay.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import LOWER, chunks, code_points, runs

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "cnn")
MASK = b"[SECRET]"

BEFORE, WINDOW, STEP = 32, 96, 32


def byte_class(chars: str) -> np.ndarray:
    """Byte table: whether a byte is one of ``chars``."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


HEX = byte_class("0123456789abcdef")
TOKEN = byte_class(string.ascii_letters + string.digits + "+/_=.-")
DIGIT, LETTER = byte_class(string.digits), byte_class(string.ascii_letters)


def windows(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, inside flag) of a window for each span; 0 outside the span's row. ``begin``: where the spans begin if before ``start``."""
    begin = start if begin is None else begin
    row = np.searchsorted(at, start, "right") - 1
    place = start[:, None] - BEFORE + np.arange(WINDOW)
    good = (place >= at[row][:, None]) & (place < at[row + 1][:, None])
    x = np.where(good, data[np.clip(place, 0, max(0, len(data) - 1))] if len(data) else 0, 0)
    return x.astype(np.int64), ((place >= begin[:, None]) & (place < end[:, None])).astype(np.float32)


class CharCNN:
    """Embedding, width-5 convolution, pooling over the window and one dense layer."""

    def __init__(self, seed: int = 7, dim: int = 12, filters: int = 24, width: int = 5):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "e": rng.normal(0, 0.3, (256, dim)),
            "k": rng.normal(0, (width * (dim + 1)) ** -0.5, (width * (dim + 1), filters)),
            "b": np.zeros(filters),
            "w": rng.normal(0, 0.2, 2 * filters),
            "c": np.zeros(1),
        }
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.recall = self.precision = float("nan")

    def forward(self, x: np.ndarray, inside: np.ndarray):
        z = np.concatenate([self.p["e"][x], inside[:, :, None]], 2)
        cols = np.lib.stride_tricks.sliding_window_view(z, self.width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.p["k"].shape[0])
        h = np.maximum(cols @ self.p["k"] + self.p["b"], 0)
        pooled = np.concatenate([h.max(1), h.mean(1)], 1)
        return cols, h, pooled, pooled @ self.p["w"] + self.p["c"][0]

    def logits(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Uncalibrated logits, in blocks of bounded memory."""
        return np.concatenate([self.forward(x[i : i + 512], inside[i : i + 512])[3] for i in range(0, len(x), 512)] or [np.zeros(0, np.float32)])

    def probability(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return self.calibrated(self.logits(x, inside))

    def highest(self, data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each candidate's highest logit over windows that reach 32 bytes past its end."""
        more = np.maximum(0, -(-(end - start + 2 * BEFORE - WINDOW) // STEP)) + 1
        first = np.cumsum(more) - more
        best = np.full(len(start), -np.inf)
        for low in range(0, int(more.sum()), 4096):
            k = np.arange(low, min(low + 4096, int(more.sum())))
            own = np.searchsorted(first, k, "right") - 1
            x, inside = windows(data, at, start[own] + (k - first[own]) * STEP, end[own], start[own])
            np.maximum.at(best, own, self.logits(x, inside))
        return best

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        """Probabilities of logits by Platt's scaling."""
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50)))

    def train(self, x, inside, y, *, epochs: int = 8, rate: float = 4e-3, batch: int = 128, seed: int = 11) -> None:
        """Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v2 = {n: np.zeros_like(v) for n, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i : i + batch]
                cols, h, pooled, logit = self.forward(x[pick], inside[pick])
                d = ((1 / (1 + np.exp(-logit)) - y[pick]) / len(pick)).astype(np.float32)
                g = {"w": pooled.T @ d, "c": d.sum(keepdims=True)}
                dp = d[:, None] * self.p["w"]
                f = h.shape[2]
                dh = np.broadcast_to((dp[:, f:] / h.shape[1])[:, None, :], h.shape).copy()
                top = h.argmax(1)
                dh[np.arange(len(pick))[:, None], top, np.arange(f)] += dp[:, :f]
                dh[h <= 0] = 0
                g["b"] = dh.sum((0, 1))
                g["k"] = cols.reshape(-1, cols.shape[2]).T @ dh.reshape(-1, f)
                dcols = (dh @ self.p["k"].T).reshape(len(pick), h.shape[1], self.width, -1)
                dz = np.zeros((len(pick), x.shape[1], dcols.shape[3]), np.float32)
                for j in range(self.width):
                    dz[:, j : j + h.shape[1]] += dcols[:, :, j]
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], x[pick].ravel(), dz[:, :, :-1].reshape(-1, dz.shape[2] - 1))
                step += 1
                for n, grad in g.items():
                    m[n] = 0.9 * m[n] + 0.1 * grad
                    v2[n] = 0.999 * v2[n] + 0.001 * grad * grad
                    self.p[n] = (self.p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v2[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on the logits of held-out findings, with Platt's targets, which no number of findings makes certain."""
        goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 0.1, 0.0
        for _ in range(200):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            r = p * (1 - p) + 1e-6
            g = np.array([((p - goal) * z).sum() + 1e-2 * a, (p - goal).sum()])
            hess = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum()]])
            move = np.linalg.solve(hess, g)
            a, b = a - move[0], b - move[1]
            if np.abs(move).max() < 1e-9:
                break
        self.scale, self.shift = float(a), float(b)

    def choose_threshold(self, z: np.ndarray, y: np.ndarray, recall: float) -> None:
        """The highest threshold that keeps ``recall`` on held-out findings, and what it gives there."""
        p = self.calibrated(z)
        own = np.sort(p[y == 1])
        if len(own):
            self.threshold = float(own[int(np.floor((1 - recall) * len(own)))])
            self.recall, self.precision = float((own >= self.threshold).mean()), float(y[p >= self.threshold].mean())


def labelled_findings(n: int, seed: int) -> list[tuple[bytes, int, int, int]]:
    """(text, start, end, label) of made-up findings: keys of many forms, and harmless strings that look alike."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "ción", "ado", "que", "ung", "sch", "keit", "eau", "oi", "ment", "é", "ü"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    mixed = string.ascii_letters + string.digits
    secret = [
        lambda: pick(mixed, 20, 48), lambda: pick(mixed + "+/", 24, 64) + "=" * rng.randint(0, 2), lambda: pick("0123456789ABCDEF", 24, 64),
        lambda: rng.choice(["ghp_", "sk-", "pk_live_", "xoxb-", "glpat-", "key-"]) + pick(mixed, 20, 40), lambda: "eyJ" + pick(mixed, 16, 30) + "." + pick(mixed + "_-", 20, 50) + "." + pick(mixed + "_-", 20, 40),
        lambda: "-".join(pick(string.ascii_uppercase + string.digits, 5, 5) for _ in range(5)), lambda: pick(string.ascii_letters, 24, 48), lambda: pick(string.ascii_letters, 20, 40) + rng.choice(["", "=", "=="]),
    ]
    # Long words and compounds of several languages: consonants, vowels and endings in turn.
    onset = "b c ch d f g gl gr h j k kr l m n p pf pr qu r s sch sh sp st str t th tr tz v w wh z ".split(" ")
    coda = "b ch ck ll m n nd ng nn nt r rr rt s ss st t th tz ".split(" ")
    beat = lambda: rng.choice(onset) + rng.choice(["a", "e", "i", "o", "u", "ea", "ei", "ie", "io", "ou", "au", "eu", "y"]) + rng.choice(coda)
    long = lambda: "".join(rng.choice([word, beat])() for _ in range(rng.randint(4, 8)))
    plain = [
        lambda: word() + "." + word() + "." + pick(string.digits, 1, 4) + "-" + word() + word(), lambda: f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-00-00",
        lambda: "/".join([word() + word() for _ in range(rng.randint(2, 5))]) + f"/{rng.randint(1, 99999)}.html", lambda: f"{word()}-{word()}-{word()}-{word()}-{rng.randint(1, 2030)}",
        lambda: f"{word()}_{word()}{word()}_v{rng.randint(1, 20)}.{rng.randint(0, 99)}.tar.gz", lambda: word().capitalize() + word() + word() + word() + str(rng.randint(0, 99)),
        lambda: f"10.{rng.randint(1000, 9999)}/{word()}.{rng.randint(1000, 99999)}{word()}", lambda: "=" * rng.randint(3, 20) + word() + "1" + "=" * rng.randint(3, 20), lambda: (word() + str(rng.randint(0, 9)) + "-") * rng.randint(3, 9) + word(),
        lambda: "".join(word() for _ in range(6)) + str(rng.randint(0, 9)), lambda: (word() * 8)[:40] + str(rng.randint(1, 9)), lambda: f"{word()}.{word()}.{rng.randint(10, 99)}.mail{rng.randint(0, 9)}.example.com",
        long, long, lambda: long().capitalize(), lambda: long().capitalize(), lambda: long().upper(), lambda: pick(string.digits, 16, 24), lambda: "-".join(word() for _ in range(rng.randint(4, 8))), lambda: word() + "".join(word().capitalize() for _ in range(rng.randint(3, 6))),
    ]
    lead = ["", "", 'key = "', "Authorization: Bearer ", "export KEY=", 'credential: "', "client_id=", "private ", "auth: "]
    found = []
    while len(found) < n:
        label = rng.random() < 0.5
        value = rng.choice(secret if label else plain)()
        before = " ".join(word() for _ in range(rng.randint(0, 9)))
        before = before + " " + (rng.choice(lead) if label or rng.random() < 0.3 else rng.choice(["", "", "see ", "(", "http://", "file "]))
        after = rng.choice(['" ', " ", ". ", ") ", "\n"]) + " ".join(word() for _ in range(rng.randint(0, 6)))
        text, start = (before + value + after).encode(), len(before.encode())
        size = len(value.encode())
        if len(value) >= 16:
            found.append((text, start, start + size, int(label)))
    return found


def lengthened(rows: list[tuple[bytes, int, int, int]], seed: int) -> list[tuple[bytes, int, int, int, int]]:
    """The findings again behind a harmless path that is part of the candidate, and the path's length."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["al", "ber", "con", "des", "er", "fin", "in", "ing", "mon", "or", "pro", "ser", "st", "tion", "ver", "ice"], k=rng.randint(1, 5)))
    out = []
    for text, start, end, label in rows:
        path = "".join(word() + "/" for _ in range(rng.randint(2, 14))).encode()
        out.append((text[:start] + path + text[start:], start, end + len(path), label, len(path)))
    return out


def fit(n: int = 4000, recall: float = 0.98, seed: int = 5) -> CharCNN:
    """A trained and calibrated network; three quarters of the findings, as they are and behind a path, train it, an eighth each calibrates it and chooses the threshold."""
    rows = labelled_findings(n, seed)
    rows = [(*r, 0) for r in rows] + lengthened(rows, seed)
    data = np.frombuffer(b"".join(r[0] for r in rows), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    start, end = at[:-1] + [r[1] for r in rows], at[:-1] + [r[2] for r in rows]
    y, held = np.array([r[3] for r in rows], np.float32), np.arange(len(rows)) % n >= n * 3 // 4
    # The window of a path's end and what follows; of harmless findings also the first one.
    own = np.array([r[4] for r in rows]) // STEP * STEP
    pick = np.concatenate([np.flatnonzero(~held), np.flatnonzero(~held & (y == 0) & (own > 0))])
    shift = np.where(np.arange(len(pick)) < (~held).sum(), own[pick], 0)
    net = CharCNN()
    net.train(*windows(data, at, start[pick] + shift, end[pick], start[pick]), y[pick])
    last = held & (np.arange(len(rows)) % n >= n * 7 // 8)
    net.calibrate(net.highest(data, at, start[held & ~last], end[held & ~last]), y[held & ~last])
    net.choose_threshold(net.highest(data, at, start[last], end[last]), y[last], recall)
    return net


def scan(data: np.ndarray, at: np.ndarray, net: CharCNN) -> list[list[tuple[int, int, int, int]]]:
    """Per row its spans (start byte, kind, end byte, first byte to mask), ordered."""
    n = len(at) - 1
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    if not len(data):
        return found
    raw, lowered = data.tobytes(), LOWER[data].tobytes()

    def rows_with(where: bytes, word: bytes) -> set[int]:
        hits, k = [], where.find(word)
        while k >= 0:
            hits.append(k)
            k = where.find(word, k + len(word))
        return set((np.searchsorted(at, hits, "right") - 1).tolist()) if hits else set()

    for r in set().union(*(rows_with(lowered, h) for h in HINTS)):
        for m in ASSIGN.finditer(raw[at[r] : at[r + 1]]):
            if m.end(2) - m.start(2) >= 6:
                found[r].append((at[r] + m.start(), 0, at[r] + m.end(), at[r] + m.start(2)))
    for r in rows_with(raw, b"AKIA"):
        for m in ACCESS.finditer(raw[at[r] : at[r + 1]]):
            if m.end() - m.start() >= 20:
                found[r].append((at[r] + m.start(), 1, at[r] + m.end(), at[r] + m.start()))
    start, end = runs(HEX[data], at)
    long = end - start >= 24
    for s, e, r in zip(start[long], end[long], np.searchsorted(at, start[long], "right") - 1, strict=True):
        found[r].append((s, 2, e, s))
    free = TOKEN[data]
    for spans in found:
        for s, _, e, _ in spans:
            free[s:e] = False
    start, end = runs(free, at)
    digits, letters = (np.concatenate([[0], np.cumsum(t[data])]) for t in (DIGIT, LETTER))
    good = (end - start >= 16) & ((digits[end] > digits[start]) | (letters[end] > letters[start]))
    start, end = start[good], end[good]
    if len(start):
        judged = net.calibrated(net.highest(data, at, start, end)) >= net.threshold
        for s, e, r in zip(start[judged], end[judged], np.searchsorted(at, start[judged], "right") - 1, strict=True):
            found[r].append((s, 3, e, s))
    for spans in found:
        spans.sort(key=lambda x: x[:3])
    return found


def masked(raw: bytes, spans: list[tuple[int, int, int, int]], base: int) -> bytes:
    """A row's bytes with the secret part of every span replaced."""
    out, at = [], 0
    for s, e in sorted((x[3] - base, x[2] - base) for x in spans):
        if s >= at:
            out += [raw[at:s], MASK]
        at = max(at, e)
    return b"".join([*out, raw[at:]])


ADDED = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("n_cnn", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]


def find_secrets(docs: DataFrame, text: str = "text", *, mask: bool = False, recall: float = 0.98, drop_text: bool = False) -> DataFrame:
    """``docs`` with the columns of ``ADDED`` in place of any of those names; ``mask`` also replaces each secret in the text."""
    docs = docs.drop(*(n for n, _ in ADDED))
    net = docs.sparkSession.sparkContext.broadcast(fit(recall=recall))  # a few thousand weights
    place = docs.columns.index(text)
    kept = [i for i, n in enumerate(docs.columns) if not (drop_text and i == place)]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), *(T.StructField(n, k) for n, k in ADDED)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for batch in batches:
            for low, high, data, at in chunks(batch.column(place)):
                rows = scan(data, at, model)
                points = code_points(data) if any(rows) else None
                counts, digests, names = np.zeros((len(rows), 4), np.int64), [], []
                for r, spans in enumerate(rows):
                    said = [(f"{KINDS[k]}:{points[s] - points[at[r]]}:{points[e] - points[at[r]]}", k) for s, k, e, _ in spans]
                    for _, k in said:
                        counts[r, k] += 1
                    names.append(",".join(x for x, _ in said))
                    digests.append(hashlib.sha256(",".join(x for x, k in said if k < 3).encode()).hexdigest())
                part = batch.slice(low, high - low)
                columns = [part.column(i) for i in kept]
                if mask and any(rows):
                    own = part.column(place).to_pylist()
                    for r, spans in enumerate(rows):
                        if spans:
                            own[r] = masked(data[at[r] : at[r + 1]].tobytes(), spans, int(at[r])).decode("utf-8")
                    columns[kept.index(place)] = pa.array(own, part.column(place).type)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(names, pa.string())], names=[f.name for f in schema])

    return docs.mapInArrow(each, schema)


def mask_documents(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with their own columns: secrets masked, n_chars brought up to date."""
    own = docs.columns
    clash = {n: f"_own_{n}" for n, _ in ADDED if n in own}
    found = find_secrets(docs.withColumnsRenamed(clash), mask=True).drop(*(n for n, _ in ADDED)).withColumnsRenamed({v: k for k, v in clash.items()})
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(own) if "n_chars" in own else found.select(own)
