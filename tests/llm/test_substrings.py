"""Repeated passages against windows of words compared one by one."""

import random
import re

from ledgerline.llm import queries as Q
from ledgerline.llm import substrings as S


def words(t):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", re.sub(r"[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t))


def repeated(docs, k, within=False):
    """Documents with a run of k words seen before: in another document or, if ``within``, anywhere."""
    first, out = {}, set()
    for i, t in sorted(docs):
        w = words(t)
        for j in range(len(w) - k + 1):
            run = tuple(w[j : j + k])
            if run in first and (within or first[run] != i):
                out.add(i)
            first.setdefault(run, i)
    return out


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r["doc_id"] for r in Q.op7_substring_dedup(spark, "/root/testdata/sf0.01").collect()}
    must = repeated(docs, 60)
    assert len(must - got) <= 0.05 * len(must)
    assert len(got - repeated(docs, 12, within=True)) <= 2


def test_planted_in_the_middle_of_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    passage = text(70)
    docs = [(i, f"{text(40)} {passage} {text(40)}" if i % 5 == 0 else text(120)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = S.repeats(df).collect()
    assert {r["doc_id"] for r in spans} == {i for i in range(5, 60, 5)} and {r["first_doc_id"] for r in spans} == {0}
    for r in spans:
        assert dict(docs)[r["doc_id"]][r["start"] : r["end"]].strip(".,") in passage
    left = {r["doc_id"]: r for r in S.strip_repeats(df).collect()}
    for i, t in docs:
        r, out, at = left[i], [], 0
        for a, b in r["removed"]:
            out.append(t[at:a])
            at = b
        assert r["text"] == "".join([*out, t[at:]])
    assert left[0]["text"] == docs[0][1] and len(words(left[5]["text"])) < 110


def test_only_repeats_go(spark):
    """Every word removed lies in a line or part that an earlier place has; text between repeated lines stays."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9)))
    head, tail = (" ".join(word() for _ in range(12)) for _ in range(2))
    between = [[f"{word()} {word()}" for _ in range(300)] for _ in range(2)]
    verse = "\n".join(" ".join(word() for _ in range(4)) for _ in range(30))
    pairs = "\n".join(f"{word()} {word()}" for _ in range(30))
    nine = " ".join(word() for _ in range(9))
    docs = [(i, "\n".join([head, *between[i], tail])) for i in range(2)]
    docs += [(10 + i, f"{word()} {word()} {word()}\n{verse}\n{word()} {word()}") for i in range(3)]
    docs += [(20 + i, f"{word()} {word()} {word()}\n{pairs}\n{word()} {word()}") for i in range(3)]
    docs += [(100 + i, f"{' '.join(word() for _ in range(30))}\n- {nine}!\n{' '.join(word() for _ in range(30))}") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in S.strip_repeats(df).collect()}
    assert left[0] == docs[0][1] and left[1].strip() == "\n".join(between[1])
    assert left[10] == docs[2][1] and all(len(words(left[i])) == 5 for i in (11, 12, 21, 22))
    assert left[100] == dict(docs)[100] and all(nine in dict(docs)[i] and len(words(left[i])) == 60 and "- " not in left[i] and "!" not in left[i] for i in range(101, 150))
    whole = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("text is not null").collect()]
    table = spark.createDataFrame(whole, "doc_id long, text string")
    before: dict[tuple, set] = {}
    for i, t in sorted(whole):
        w = words(t)
        for j in range(len(w) - 2):
            before.setdefault(tuple(w[j : j + 3]), set()).add(i)
    for r in S.repeats(table).collect():
        w = words(dict(whole)[r["doc_id"]][r["start"] : r["end"]])
        assert len(w) == r["n_words"] >= 8
        # Every part of three words or more stands elsewhere, so of any five runs of three words in a row most do; line breaks may part some.
        assert sum(len(before[tuple(w[j : j + 3])]) > 1 or w.count(w[j]) > 1 for j in range(len(w) - 2)) >= 0.4 * (len(w) - 2)


def test_odd_rows(odd):
    # Rows of one doc_id are one occurrence; the long text repeats itself.
    assert {r["doc_id"] for r in S.repeats(odd.select("doc_id", "text")).collect()} <= {5}
    assert S.repeats(odd.limit(0)).count() == 0
    assert S.strip_repeats(odd).count() == odd.count()
