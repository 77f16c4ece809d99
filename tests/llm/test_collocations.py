"""Operator 12 against brute force, with rare pairs, padded windows, ties and edge cases."""

import random
import re
from collections import Counter

import numpy as np

from collinea.llm import collocations as C


def brute(rows, support, top):
    totals, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    counts[lang, tuple(words[k : k + size])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= support}
    out = []
    for (lang, p), a in candidates.items():
        if any(other == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q))) and 100 * f >= 80 * a for (other, q), f in candidates.items()):
            continue
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    found = []
    for lang in totals:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        found += [(r[0], n + 1, *r[1:]) for n, r in enumerate(mine)]
    return sorted(found)


def planted(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcdeéßZ") + str(rng.randrange(30)) for _ in range(60)]
    rows = [("en", None), ("en", ""), (None, " \t\n"), (None, "New York"), ("xx", "."), ("en", "lone")]
    for _ in range(120):
        text = ""
        for _ in range(rng.randint(1, 40)):
            text += rng.choice(["New York City hall", "new YORK", "in spite of", "ça va", rng.choice(words), rng.choice(words[:4])])
            text += rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!", " "])
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    rows += [("fr", "la la la la la la " * 30)] * 3
    rng.shuffle(rows)
    return rows


def found(spark, rows, *limits):
    docs = spark.createDataFrame([(k, lang, text, 1, 2) for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n int, w1 int").repartition(3)
    return sorted(tuple(r) for r in C.mine(docs, *limits).collect())


def test_equal_to_brute_force(spark):
    rows = planted(1)
    want = brute(rows, 5, 40)
    assert len(want) > 60 and found(spark, rows, 5, 40) == want


def test_few_counters_lose_nothing(spark):
    rows = planted(2)
    want = brute(rows, 30, 2000)
    assert want and found(spark, rows, 30, 2000, 16) == want == found(spark, rows)


def test_counts_beyond_64_bit_products(spark):
    big = 1 << 60
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 3), ("en", 2, "a b", big - 7)], "lang string, size int, phrase string, f long")
    row = C.without_inner(C.best_cuts(phrases)).first()
    assert row.score == 2_000_000 * (big - 7) // (2 * big - 3)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_support_filter(spark):
    rows = planted(3)
    docs = spark.createDataFrame(rows, "lang string, text string").na.fill("")
    pairs = C.support_filter(docs, 30, 1 << 14)
    longer = C.support_filter(docs, 30, 1 << 14, pairs)
    assert 0 < np.unpackbits(longer).sum() < 400 and 0 < np.unpackbits(pairs).sum() < 400
