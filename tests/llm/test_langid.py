"""Language ID: exact code lengths, held-out accuracy, odd rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import langid as L
from ledgerline.llm import queries as Q


def brute(rows, lang, text):
    """Bits of a text under counts of contexts up to three symbols, escape method C with exclusion."""
    model = L.PPM(rows)
    counts = {}
    low = lambda t: [int(model.lut[b]) for b in t.encode()]
    for own, t in rows:
        if own == lang:
            s = [0, 0, 0, *low(t)]
            for i in range(3, len(s)):
                for k in range(4):
                    c = counts.setdefault(tuple(s[i - k : i]), {})
                    c[s[i]] = c.get(s[i], 0) + 1
    s, bits = [0, 0, 0, *low(text)], 0.0
    for i in range(3, len(s)):
        p, refused, done = 1.0, set(), False
        for k in (3, 2, 1, 0):
            c = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in refused}
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if s[i] in c:
                p *= c[s[i]] / (n + d)
                done = True
                break
            p *= d / (n + d)
            refused |= set(c)
        if not done:
            p /= 256 - len(refused)
        bits -= math.log2(p)
    return bits


def test_code_lengths():
    rows = [("a", "the theme of the thing"), ("a", "then they"), ("b", "le chat et la chatte")]
    model = L.PPM(rows)
    texts = ["the chat", "zzz", "", "THE", "le thé"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = model.bits(data, at)
    for r, t in enumerate(texts):
        for k, lang in enumerate(model.langs):
            assert abs(got[r, k] - brute(rows, lang, t)) < 1e-3


def test_many_scripts(monkeypatch):
    """No context that was seen is dropped with many symbols, and searched nodes equal tabulated ones."""
    rows = [(f"l{k}", "".join(chr(base + i * i % 90) for i in range(400)) + " the end") for k, base in enumerate((0x61, 0x430, 0x3B1, 0x5D0, 0x905, 0xE01, 0x4E00, 0xAC00))]
    text = "the и γ ש ก 丁 가 end" + rows[6][1][:50]
    data, at = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    got = L.PPM(rows).bits(data, at)
    for k, (lang, _) in enumerate(rows):
        assert abs(got[0, k] - brute(rows, lang, text)) < 0.01
    monkeypatch.setattr(L, "DENSE", 0)
    searched = L.PPM(rows)
    assert searched.node is None and (searched.bits(data, at) == got).all()


def test_held_out_accuracy(spark):
    found = Q.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n, low, high = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1)), F.min("score"), F.max("score")).head()
    assert n > 100 and right > 0.97 and low >= 0 and high <= 1


def test_odd_rows(odd):
    found = L.identify(odd, odd.select("doc_id", "text", "lang"))
    assert found.count() == odd.count() and set(odd.columns) <= set(found.columns)
    und = {r["doc_id"] for r in found.filter("lang_pred = 'und'").collect()}
    assert und == {2, 3, 4, None, 6}
    assert [r["score"] for r in found.filter("lang_pred = 'und'").collect()] == [0.0] * 5
    kept = L.keep_known(odd, odd.select("doc_id", "text", "lang"))
    assert kept.columns and sorted(kept.columns) == sorted(odd.columns) and {r["score"] for r in kept.collect()} == {1}
    none = odd.limit(0)
    assert L.identify(none, none).count() == 0
    assert {r["lang_pred"] for r in L.identify(odd, none).collect()} == {"und"}
