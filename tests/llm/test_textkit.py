"""Vectorised primitives against plain Python."""

import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from ledgerline.llm import textkit as K


def sample(seed=0, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcXYZ09 .,\n\t'éÉ×漢", k=rng.randint(0, 40))) for _ in range(n)] + ["", "   ", "a"]


def lower(t):
    return re.sub(r"[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t)


def test_words_and_shingles():
    texts = sample()
    for low, high, data, at in K.chunks(pa.array(texts), 500):
        words = K.Words(data, at)
        plain = [re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", lower(t)) for t in texts[low:high]]
        assert np.diff(words.at).tolist() == [len(p) for p in plain]
        flat = [w for p in plain for w in p]
        assert len({(w, h) for w, h in zip(flat, words.hash.tolist(), strict=True)}) == len(set(flat)) == len(set(words.hash.tolist()))
        row, h = K.shingles(words, 3)
        own = [[tuple(p[i : i + 3]) for i in range(max(1, len(p) - 2))] if p else [] for p in plain]
        assert row.tolist() == [r for r, x in enumerate(own) for _ in x]
        pairs = set(zip([g for x in own for g in x], h.tolist(), strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        digests = [bytes(d) for d in K.sequence_digests(words)]
        seen = {}
        assert all(seen.setdefault(tuple(p), d) == d for p, d in zip(plain, digests, strict=True)) and len(set(seen.values())) == len(seen)


def test_nulls_slices_and_code_points():
    column = pa.array(["skip", None, "é漢a", "b"])[1:]
    (low, high, data, at), = K.chunks(column)
    assert (low, high, bytes(data).decode(), at.tolist()) == (0, 3, "é漢ab", [0, 0, 6, 7])
    assert K.code_points(data)[[0, 2, 5, 6, 7]].tolist() == [0, 1, 2, 3, 4]
    assert list(K.chunks(pa.array([], pa.string()))) == []


def test_lean_gives_back_what_was_freed():
    """Work on a table, on two and on batches leaves no freed memory with the process, even between small pieces that stay."""
    code = """
import sys
import numpy as np
from ledgerline.llm.textkit import lean
stays = []
def used():
    return int(open("/proc/self/status").read().split("RssAnon:")[1].split()[0]) >> 10
def fill():
    for _ in range(1500):
        found.append(np.ones(100_000, np.uint8))
        stays.append(bytes(600))
    found.clear()
found = []
before = used()
fill()
held = used() - before
lean(lambda rows: fill())(None)
one = used() - before
lean(lambda left, right: fill())(None, None)
two = used() - before
def each(rows):
    fill()
    yield 1
assert list(lean(each)([])) == [1]
print(held, one, two, used() - before)
"""
    held, *left = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split())
    assert held > 100 and max(left) < 30
