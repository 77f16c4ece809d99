"""Operators 8 and 10 against brute force, with the edge cases their docstrings name."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from collinea.llm import decontamination as D
from collinea.llm import quality_rules as Q
from collinea.llm.common import chunks

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents(seed, n=150):
    rng = random.Random(seed)
    words = ["Alpha", "beta,", "gämma", "x1", "The", "|", "#tag", "日本", "a-b", "é", "end.", "zeta"]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (None, "null id text " * 30), (5, "same same same same"), (5, "same same same same"), (6, "lorem " * 20000)]
    for k in range(10, 10 + n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 8))]
        rows.append((k, "\n".join(lines + rng.sample(lines, min(len(lines), rng.randint(0, 2))))))
    return rows


def quality_brute(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_measures(spark):
    rows = documents(1)
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, n_words string")
    got = Q.judge(df).collect()
    assert len(got) == len(rows)
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == Counter((a, *quality_brute(b)) for a, b in rows)
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_line_rules(spark):
    prose = " ".join(f"word{k}" for k in range(80)) + "."
    rows = [(1, prose), (2, prose + "\nHome | About | Contact | Login\nWe use cookies on this site."), (3, "\n".join(" | ".join(f"k{i}x{j}" for j in range(20)) for i in range(6)))]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, kept int")
    kept = {r.doc_id: r.text for r in Q.clean_documents(df).collect()}
    assert kept == {1: prose, 2: prose}
    assert Q.clean_documents(df).columns == df.columns
    assert Q.judge(df.limit(0)).count() == 0 and Q.clean_documents(df.limit(0)).count() == 0


def failed_lines_brute(text):
    lines = text.split("\n")
    words, ends = [SPACE_WORD.findall(x) for x in lines], tuple(x.decode() for x in Q.SENTENCE_ENDS)
    often, bad = Counter(lines), [False] * len(lines)
    filled = [k for k, w in enumerate(words) if w]
    for k in filled:
        line, w, size = lines[k], words[k], sum(map(len, words[k]))
        body = line.strip(" \t\n\v\f\r")
        separators = sum(line.count(c) for c in "|>\\")
        bad[k] = (
            100 * sum(line.count(c) for c in "#*$%&|<>") > 8 * size
            or 100 * sum(c.isalnum() or ord(c) > 127 for c in line) < 40 * size
            or (len(w) <= 12 and body.endswith(("...", "…")))
            or (separators >= 3 and 10 * separators > 3 * len(w))
            or (n := sum(bool(re.match(r"https?://|www\.", x)) for x in w)) > 0
            and 100 * n >= 50 * len(w)
            or (len(w) <= 30 and bool(Q.BOILERPLATE.search(line.encode().lower())))
            or (len(w) <= 10 and often[line] >= 4)
        )
    run = []
    for k in [*filled, None]:
        if k is not None and len(words[k]) <= 3 and not lines[k].strip(" \t\n\v\f\r").endswith(ends):
            run.append(k)
            continue
        for j in run if len(run) >= 4 else ():
            bad[j] = True
        run = []
    return bad


def test_quality_verdict(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta,", "gämma", "x1", "|", "#tag", "日本", "end.", "so…", "etc...", "http://a.b/c", "www.x.org", "--", "\\", ">", "privacy", "policy", "?!", "word", "more", "lines", "here"]
    rows = [(0, None), (1, ""), (2, "\n \n\t")]
    for k in range(10, 300):
        lines = [" ".join(rng.choice(words[-rng.choice([3, 12, 22]) :]) for _ in range(rng.choice([0, 1, 2, 3, 8, 25]))) for _ in range(rng.randint(1, 14))]
        lines += [" ".join(f"w{rng.randint(0, 999)}" for _ in range(20)) for _ in range(rng.randint(0, 6))] + [rng.choice(lines)] * rng.randint(0, 4)
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, lost_percent string").repartition(3)
    got, seen = {r.doc_id: r for r in Q.judge(df).collect()}, Counter()
    cleaned = {r.doc_id: r.text for r in Q.clean_documents(df).collect()}
    for doc_id, text in rows:
        lines, bad = (text or "").split("\n"), failed_lines_brute(text or "")
        size = [sum(map(len, SPACE_WORD.findall(x))) for x in lines]
        lost = sum(n for n, b in zip(size, bad) if b)
        kept = not quality_brute(text)[-1] and 100 * lost <= 50 * max(sum(size), 1)
        assert (got[doc_id].n_failed_lines, got[doc_id].kept) == (sum(bad), kept), (doc_id, text)
        assert cleaned.get(doc_id) == ("\n".join(x for x, b in zip(lines, bad) if not b) if kept else None)
        seen[kept, any(bad)] += 1
    assert len(seen) == 4 and min(seen.values()) > 5


def contamination_brute(text, items, window=13):
    words = ALNUM_WORD.findall(lower(text or ""))
    hit, names = set(), set()
    for name, item in items:
        item = ALNUM_WORD.findall(lower(item or ""))
        size = min(window, len(item))
        windows = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, block_bytes):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 13, 14, 30])))) for k in range(12)]
    items += [(90, None), (91, "?!"), (92, items[0][1]), (93, "w1 w2 w3"), (94, "Überall GROSS klein")]
    rows = [(0, None), (1, ""), (2, "w1 W2, w3"), (None, items[3][1]), (3, "überall gross klein")]
    for k in range(10, 60):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 2)):
            text += " ; " + rng.choice(items[:12])[1].upper()
        rows.append((k, text))
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, spans string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        n, hit, names = contamination_brute(text, items)
        r = got[doc_id]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, hit, names), doc_id
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_spans_are_removed(spark):
    item = " ".join(f"q{k}" for k in range(15))
    filler = " ".join(f"f{k}" for k in range(400))
    docs = spark.createDataFrame([(1, f"{filler}, {item}. tail"), (2, f"start {item}"), (3, filler), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()}
    assert kept == {1: f"{filler}, tail", 3: filler, 4: None}
    assert D.remove_spans(docs, bench.limit(0)).count() == 4
    assert D.find_contamination(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert D.find_contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_short_items_inside_a_longer_window_count_once(spark, block_bytes):
    words = [f"v{k}" for k in range(13)]
    items = [(1, " ".join(words[2:5])), (2, " ".join(words[7:10])), (3, " ".join(words)), (4, "v12")]
    rows = [(k, " ".join([*words, *(f"f{j}" for j in range(n))])) for k, n in enumerate((0, 246, 247, 248, 300, 307))]
    rows += [(90, "v12"), (91, "v12 v12 x v2 v3 v4 " + " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
    for doc_id, text in rows:
        n, hit, names = contamination_brute(text, items)
        r = got[doc_id]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, hit, names), doc_id
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert [tuple(x) for x in got[0].spans] == [(0, 13)]


def test_removal_does_not_depend_on_blocks(spark):
    first, second = ([f"{c}{k}" for k in range(15)] for c in "ab")
    fill = lambda n, c="f": [f"{c}{k}" for k in range(n)]
    items = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(first[5:] + ["c0", "c1", "c2"])), (4, " ".join(["left", "right"] * 7))]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    rows = [
        (1, text(fill(200), first, fill(250, "g"), second)),  # 3 percent by each of two items
        (2, text(fill(600), first, second, fill(5, "g"))),
        (3, text(fill(600), first, ["c0", "c1", "c2"], fill(5, "g"))),  # windows that overlap
        (4, text(fill(600), ["left", "right"] * 3, first, ["left", "right"] * 4)),  # the cut makes a new window
        (5, None), (6, ""), (7, text(fill(50))), (2, text(fill(601), second)), (None, text(second, fill(400))),
    ]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, _row_key string").repartition(3)
    docs = docs.select("*", *(docs["doc_id"].alias(name) for name in ("row_key", "spans", "found_key", "items")))
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    key = lambda r: (str(r[0]), str(r[1]))
    for drop in (True, False):
        whole = sorted(map(tuple, D.remove_spans(docs, bench, drop_contaminated=drop).collect()), key=key)
        for size in (20, 90):
            out = D.remove_spans(docs, bench, drop_contaminated=drop, block_bytes=size)
            assert out.columns == docs.columns
            assert sorted(map(tuple, out.collect()), key=key) == whole
        assert (1 in {r[0] for r in whole}) != drop
        assert {r[0]: r[1] for r in whole}[3] == text(fill(600), fill(5, "g"))
        assert {r[0]: r[1] for r in whole}[4] == text(fill(600), ["left", "right"] * 7)


def test_repeated_items_cost_about_one():
    """Eight hundred items with one passage make one set, and as many hits as one item."""
    passage = " ".join(f"w{k}" for k in range(60))
    text = pa.record_batch([pa.array([" ".join(f"x{k}" for k in range(500)) + " " + passage])], ["text"])
    hits = {}
    for n in (1, 800):
        matcher = D.ItemMatcher([(f"i{k}", passage) for k in range(n)], 13)
        hits[n] = matcher.match(next(chunks(text, "text")))[1]
        assert {held for *_, held in hits[n]} == {0} and len(matcher.names[0]) == n
    assert len(hits[1]) == len(hits[800]) == 48
    near = D.ItemMatcher([(f"i{k}", f"{passage} tail{k}") for k in range(800)], 13)
    assert len(near.match(next(chunks(text, "text")))[1]) == 48 and len(near.automaton.sets) < 900
