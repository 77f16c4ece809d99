"""Operator 11 against brute force, with planted passages, copies, hot anchors and edge cases."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from collinea.llm import substring_dedup as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=50):
    least = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - length + 1):
            if doc is not None:
                window = tuple(words[k : k + length])
                least[window] = min(doc, least.get(window, doc))
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for k in range(len(words) - length + 1):
            if doc is not None and least[tuple(words[k : k + length])] < doc:
                gone.update(range(k, k + length))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["à", "Ab", "ab", "c.", "d", "ééé"]) + rng.choice(["x", "y", "zz", ""])
    text = lambda n: [word() + str(rng.randrange(40)) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 70, 130, 300)]
    loop = ["la", "li"] * 40  # one window again and again inside a document
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, " ".join(passages[4])), (None, " ".join(passages[4])), (None, " ".join(passages[5]))]
    for doc in range(10, 90):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice([*passages, text(rng.randint(0, 90)), passages[5][rng.randint(0, 120) : rng.randint(150, 300)], loop])
        rows.append((doc, rng.choice([" ", "\n", "  \x0b", "\t"]).join(parts)))
    rows += [(10, " ".join(passages[2] + ["end"])), (10, rows[6][1]), (95, rows[40][1]), (95, rows[40][1]), (96, " ".join(text(3000) + passages[3])), (97, " ".join(passages[3]))]
    rng.shuffle(rows)
    return rows


def found(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("part", F.lit("x")).withColumn("runs", F.lit(1)).withColumn("token", F.lit(None).cast("int"))
    return sorted((tuple(r) for r in D.remove_repeats(docs, **limits).collect()), key=str)


def test_equal_to_brute_force(spark):
    rows = planted(1)
    want = brute(rows)
    assert any(r[2] for r in want) and found(spark, rows) == want


def test_hot_anchors_get_prefixes_of_full_length(spark):
    rows = planted(2)
    assert found(spark, rows, split_runs=2) == brute(rows) == found(spark, rows, split_runs=0)


def test_other_lengths_and_kept_text(spark):
    rows = planted(3)
    assert found(spark, rows, length=20, anchor=5) == brute(rows, 20)
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60)))), (2, "a  b " + " ".join(map(str, range(60))) + "\nc")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in D.remove_repeats(docs, with_text=True).collect()} == {1: " ".join(map(str, range(60))), 2: "a b c"}


def test_empty_table(spark):
    assert found(spark, []) == []


def test_deep_nodes_order_and_borders():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2, 400)
    at = np.arange(390)
    order, new = D.deep_nodes(words, at, 10)
    texts = [tuple(words[k : k + 10]) for k in order]
    assert texts == sorted(texts)
    assert [k == 0 or texts[k] != texts[k - 1] for k in range(len(texts))] == new.tolist()
