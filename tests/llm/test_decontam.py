"""Decontamination against a scan of every text for every item."""

import random
import re

import numpy as np
import pytest

from ledgerline.llm import decontam as D
from ledgerline.llm import queries as Q


def plain(t):
    return " ".join(re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", re.sub(r"[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t)))


def test_every_copy(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], f" {plain(r['text'])} ") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], f" {plain(r['text'])} ") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in Q.op1_decontamination(spark, sf).collect()}
    assert whole and whole <= got
    words = {d: set(t.split()) for d, t in docs}
    assert all(len(words[d] & set(dict(items)[i].split())) > 0.6 * len(set(dict(items)[i].split())) for d, i in got)


@pytest.mark.parametrize("seed", range(4))
def test_retrieval_is_exact(seed):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(60), rng.randrange(60))}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 20)))) for i in range(400)]
    index = D.Index(items, 0.5)
    for _ in range(30):
        terms = np.unique(np.array(rng.sample(range(len(index.vocabulary)), 25)))
        score = np.zeros(len(index.ids))
        for t in terms:
            score[index.item[index.at[t] : index.at[t + 1]]] += index.weight[index.at[t] : index.at[t + 1]]
        assert {i for i, _ in index.retrieve(terms)} == set(np.flatnonzero(score >= 0.5 - 1e-9).tolist())


def test_partial_and_odd(spark, odd):
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog. It sat by the door of the house"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    # One word more in the item: five-word runs still cover most of both parts.
    got = D.find_leaks(odd, items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 1)] * 2 and all(0.5 <= r["answer_overlap"] <= 1 for r in got)
    half = spark.createDataFrame([(9, "the cat sat on the mat and the dog. Nothing of this was there before")], "item_id long, text string")
    assert D.find_leaks(odd, half).count() == 0
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog sat by the door of the house"), (1, "the cat sat on the mat and the dog sat by the door of the house")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in D.find_leaks(odd, items).collect()] == [(1, 1)] * 4
    clean = D.clean_documents(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2
    assert D.find_leaks(odd, items.limit(0)).count() == 0 and D.find_leaks(odd.limit(0), items).count() == 0
    assert D.find_leaks(odd, items, block_mb=1e-5).count() == 4


def test_short_answers_and_items():
    question = "Which river runs through the old town between the two hills of the north?"
    items = [(1, f"{question} Vltava"), (2, "Who wrote Ulysses? Joyce")]
    index = D.Index(items, 0.5)
    filler = " ".join(f"f{i}" for i in range(60))
    texts = [f"{filler} {question} Answer: Vltava {filler}", f"{filler} {question} {filler} Vltava {filler}", f"{filler} Who wrote Ulysses? Joyce", "Joyce wrote Ulysses who", "", "one"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert {(r, index.ids[i]) for r, i in D.leaks(index, D.Words(data, at), 0.5)} == {(0, 1), (2, 2)}


def test_equals_scoring_every_passage():
    """Both ways: a document is reported with an item exactly if one of its passages reaches the threshold and verifies."""
    rng = random.Random(6)
    word = lambda: f"w{min(rng.randrange(300), rng.randrange(300))}"
    said = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    items = [(i, f"{said(6, 30)}? {said(1, 8)}") for i in range(60)]
    texts = []
    for k in range(150):
        own = items[k % 60][1].split()
        cut = {0: own, 1: own[: len(own) // 2], 2: own[len(own) // 2 :], 3: [w if rng.random() > 0.15 else word() for w in own], 4: own[:-1]}[k % 5]
        texts.append(f"{said(0, 150)} {' '.join(cut)} {said(0, 200)}")
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    (index,) = D.build(items, 0.5)
    words, expected = D.Words(data, at), set()
    weights = [{} for _ in index.ids]
    for t in range(len(index.vocabulary)):
        for p in range(index.at[t], index.at[t + 1]):
            weights[index.item[p]][index.vocabulary[t]] = index.weight[p]
    for r in range(len(texts)):
        h = words.hash[words.at[r] : words.at[r + 1]]
        for first in range(0, max(1, len(h)), index.longest):
            passage = h[first : first + 2 * index.longest]
            there = set(passage.tolist())
            for i, own in enumerate(weights):
                if sum(x for w, x in own.items() if int(w) in there) >= 0.5 - 1e-9 and min(index.overlaps(i, passage)) >= 0.5:
                    expected.add((r, i))
    assert 40 < len(expected) < 9000 and set(D.leaks(index, words, 0.5)) == expected


def test_ids_of_any_type_and_long_items(spark):
    question = "Which river runs through the old town between the two hills of the north? It is the Vltava of the south"
    long = " ".join(f"z{i}" for i in range(900))
    docs = spark.createDataFrame([(1, f"a b c {question} d e f"), (2, long), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", question, 1), (None, question, 2), (None, question, 3), ("y", long, 4), ("z", None, 5), (None, None, 6), ("w", "", 7), ("v", "one", 8)], "item_id string, text string, score int")
    got = sorted((r["doc_id"], str(r["item_id"])) for r in D.find_leaks(docs, items).collect())
    assert got == [(1, "None"), (1, "None"), (1, "x"), (2, "y")]
    assert [r["doc_id"] for r in D.clean_documents(docs, items).collect()] == [3]
    # The long item has an index of its own, so the others' passages stay short.
    assert [i.longest for i in D.build([("x", question), ("y", long)], 0.5)] == [64, 900]
