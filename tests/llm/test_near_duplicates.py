"""Operators 1, 6 and 7 against brute force, with planted chains, copies and edge cases."""

import hashlib
import random
import re

from collinea.llm import line_dedup as L
from collinea.llm import ngram_jaccard as J
from collinea.llm import suffix_dedup as S
from collinea.llm.graphs import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def groups(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def near_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (5, "one two three"), (None, "one two")]
    doc = 10
    for _ in range(12):  # chains: each text is like the one before it, the ends are not
        text = [word() for _ in range(rng.choice([8, 30, 120]))]
        for _ in range(rng.randint(1, 7)):
            rows.append((doc, " ".join(text)))
            doc += rng.randint(1, 3)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text = list(text)
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text + [word() for _ in range(len(text) // 8)]
    for _ in range(25):  # one passage in unlike texts, and in nothing else
        rows.append((doc, " ".join([word() for _ in range(rng.randint(0, 60))] + passage)))
        doc += 1
    centre = [word() for _ in range(60)]
    for _ in range(60):  # a large group of near copies and copies
        text = list(centre)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(60)] = word()
        rows.append((doc, " ".join(text)))
        doc += 1
    rng.shuffle(rows)
    return rows


def test_rows_on_either_side_of_the_whole_row_bound_are_linked(spark):
    """The short one of a pair is judged by all its columns, so the long one must show all of its."""
    words = [f"w{k}" for k in range(700)]
    rows = []
    for at, (short, long) in enumerate(((254, 304), (260, 345), (255, 270), (300, 390))):
        mark = [f"{w}x{at}" for w in words]
        rows += [(10 * at, " ".join(mark[:short])), (10 * at + 1, " ".join(mark[:long]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {doc: shingles(text) for doc, text in rows}
    want = groups(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert len(set(want.values())) == 4
    assert {r.doc_id: r.component_id for r in J.link_documents(docs).collect()} == want


def test_jaccard_components(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ENTRIES", 4000)
    monkeypatch.setattr(J, "EXPANDED", 50)
    monkeypatch.setattr(J, "PART_ENTRIES", 300)
    monkeypatch.setattr(J, "WHOLE_ROWS", 40)
    for seed in (1, 2):
        rows = near_texts(seed)
        docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, token string").repartition(4)
        sets = {a: shingles(b) for a, b in rows if a is not None}
        keys = sorted(sets)
        linked = [(a, b) for k, a in enumerate(keys) for b in keys[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        want = groups(keys, linked)
        assert len(linked) > 300
        got = {r.doc_id: r for r in J.link_documents(docs).collect()}
        assert len(got) == len(rows)
        assert {a: (got[a].n_shingles, got[a].component_id) for a in keys} == {a: (len(sets[a]), want[a]) for a in keys}
        assert got[None].component_id is None and got[None].n_shingles == 1
        kept = {r.doc_id for r in J.keep_one(docs).collect()}
        assert kept == {a for a in keys if want[a] == a} | {None}


def test_jaccard_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.link_documents(empty).count() == 0
    same = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (3, "A b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in J.link_documents(same).collect()} == {(4, 3), (3, 3)}
    assert J.link_documents(same).count() == 3


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == groups({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])


def removed_brute(rows, size=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            window = raw[k : k + size]
            if window in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    rng = random.Random(3)
    phrase = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(40, 400))) for _ in range(20)]
    parts = [lambda: rng.choice(phrase), lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 80))), lambda: "ab" * rng.randint(1, 120), lambda: rng.choice(phrase)[rng.randint(0, 30) :][: rng.randint(50, 200)]]
    rows = [(d, "".join(rng.choice(parts)() for _ in range(rng.randint(0, 6))) if d % 37 else None) for d in range(150)]
    extra = [(None, phrase[0] * 3), (None, phrase[0] * 3), (None, "x" + phrase[0] + phrase[1]), (None, "ab" * 90)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows + extra], "doc_id long, text string, kind long").repartition(5)
    got = S.remove_repeats(docs, with_text=True).collect()
    assert len(got) == len(rows) + 4
    want = removed_brute(rows)
    alone = sorted(removed_brute([(0, text)])[0] for _, text in extra)  # without an id: repeats in itself only
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is None) == alone and alone[-1][1] > 0
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_suffix_dedup_edges(spark):
    long = "z" + "".join(chr(97 + int(c, 16)) for c in hashlib.sha512(b"a").hexdigest() + hashlib.sha512(b"b").hexdigest() + hashlib.sha256(b"c").hexdigest())[:299]
    docs = spark.createDataFrame([(1, long), (1, long), (2, long), (3, "x" + long), (4, "y" + long)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.remove_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 300), (3, 300), (4, 300)]
    assert sum(r.n_removed == 0 for r in S.remove_repeats(spark.createDataFrame([(1, long), (1, "!" + long + "!"), (2, long)], "doc_id long, text string")).collect()) == 1
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup_ids_of_several_texts(spark):
    rng = random.Random(6)
    phrase = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(90, 250))) for _ in range(8)]
    rows = [(rng.choice([1, 2, 3, 50, 60, 70 + k]), "".join(rng.choice(phrase)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 3)))) for k in range(60)] + [(3, None), (3, None)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(4)
    part = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) h").distinct().collect()}
    seen, want = set(), {}
    for d, text in sorted(set(rows), key=lambda row: (row[0], part[row[1]])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        want.setdefault(d, []).append((len(raw), sum(gone), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    got = {}
    for r in S.remove_repeats(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.kept_sha256))
    assert got == {d: set(x) for d, x in want.items()} and len(want[1]) > 3


def test_difference_cover():
    for period in (7, 32, 64):
        cover = set(S.difference_cover(period).tolist())
        assert all(any((a - d) % period in cover for a in cover) for d in range(period)) and len(cover) <= 2 * period**0.5 + 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice([b"", b"a", b"b"])
        for threshold in (1, 2, 3):
            assert L.within(a, bytes(b), threshold) == (edits(a, bytes(b)) <= threshold)


def test_line_dedup(spark):
    rng = random.Random(1)
    base = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 12))) for _ in range(30)]
    rows = [(900, ""), (901, "short\nshort"), (902, "\n\n")]
    for d in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(s))
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            lines.append(" " * rng.randint(0, 1) + "".join(s))
        rows.append((d, "\n".join(lines) if lines else None))
    docs = spark.createDataFrame([(a, b, "n") for a, b in rows] + [(None, base[0], "n")], "doc_id long, text string, number string").repartition(4)
    seen = [(d, n, b) for d, t in rows for n, line in enumerate((t or "").split("\n")) if len(b := line.strip().encode()) >= L.MIN_BYTES]
    lines = sorted({b for _, _, b in seen})
    linked = [(a, b) for k, a in enumerate(lines) for b in lines[:k] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2]
    of, first, gone = groups(lines, linked), set(), {d: [] for d, _ in rows}
    for d, n, b in sorted(seen):
        if of[b] in first:
            gone[d].append(n)
        first.add(of[b])
    got = {r.doc_id: r for r in L.line_report(docs).collect()}
    assert {d: list(got[d].removed) for d in gone} == gone and not got[None].removed
    assert all(got[d].n_lines == (0 if t is None else t.count("\n") + 1) for d, t in rows)
    out = {r.doc_id: r.text for r in L.remove_lines(docs).collect()}
    assert all(out[d] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])) for d, t in rows)
    assert out[None] == base[0] and L.remove_lines(docs).columns == docs.columns
    assert L.line_report(docs.limit(0)).count() == 0 and L.remove_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_short_and_accented_lines(spark):
    rng = random.Random(3)
    words = ["élève", "Straße", "año", "naïve", "日本語", "plain", "über", "x", "😀", "ça"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 10))) for _ in range(12)]
    rows = [(900, "ok\n ok\n\n \nno"), (901, "no\nab\nac"), (902, "é\né"), (903, None)]
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 2, 3])):
                k = rng.randrange(len(s))
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "é", "語", "😀", "e"])
            lines.append("".join(s))
        rows.append((d, "\n".join(lines) or None))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = [(d, n, x) for d, t in rows for n, line in enumerate((t or "").split("\n")) if (x := line.strip(" \t\n\v\f\r"))]
    lines = sorted({x for _, _, x in seen})
    long = [x for x in lines if len(x.encode()) >= L.MIN_BYTES]
    linked = [(a, b) for k, a in enumerate(long) for b in long[:k] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2]
    assert any(abs(len(a.encode()) - len(b.encode())) > 2 for a, b in linked)
    of, first, gone = groups(lines, linked), set(), {d: [] for d, _ in rows}
    for d, n, x in sorted(seen):
        if of[x] in first:
            gone[d].append(n)
        first.add(of[x])
    assert gone[900] == [1] and gone[901] == [0] and gone[902] == [1]
    assert {r.doc_id: list(r.removed) for r in L.line_report(docs, **L.WHOLE).collect()} == gone
    out = {r.doc_id: r.text for r in L.remove_lines(docs, **L.WHOLE).collect()}
    assert all(out[d] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])) for d, t in rows)


def test_columns_with_clashing_names(spark):
    names = ("id", "_id", "gone", "_gone", "a", "b", "line", "number", "component", "token", "least", "node", "several")
    line = "one line of words that is long enough to be compared"
    docs = spark.createDataFrame([(1, line + "\nalpha"), (2, line), (3, "x y z"), (4, line)], "doc_id long, text string")
    docs = docs.select("*", *(docs["doc_id"].cast("string").alias(name) for name in names))
    lines = {r.doc_id: (r.text, r._id, r.gone) for r in L.remove_lines(docs).collect()}
    assert lines == {1: (line + "\nalpha", "1", "1"), 2: ("", "2", "2"), 3: ("x y z", "3", "3"), 4: ("", "4", "4")}
    assert {(r.doc_id, r._gone) for r in J.keep_one(docs).collect()} == {(1, "1"), (3, "3")}


def test_jaccard_ids_of_several_sets_and_long_texts(spark):
    rng = random.Random(8)
    long = [f"w{rng.randint(0, 5000)}" for _ in range(30000)]
    near = list(long)
    for k in range(0, 30000, 500):
        near[k] = "other"
    text = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(9, " ".join(long)), (8, " ".join(near)), (5, text("a")), (5, text("b")), (6, text("a")), (7, text("b")), (3, text("c")), (3, text("d")), (2, text("d")), (4, text("e")), (4, text("c") + " tail")]
    got = {}
    for r in J.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        assert got.setdefault(r.doc_id, r.component_id) == r.component_id
    assert got == {9: 8, 8: 8, 5: 5, 6: 5, 7: 5, 3: 2, 2: 2, 4: 2}


def test_tasks_of_short_texts_only(spark):
    docs = spark.createDataFrame([(k, "ab cd" if k % 2 else "\n") for k in range(8)], "doc_id long, text string").repartition(4)
    assert {r.doc_id: list(r.removed) for r in L.line_report(docs, **L.WHOLE).collect()} == {k: [0] if k % 2 and k > 1 else [] for k in range(8)}
    assert all(r.n_removed == 0 for r in S.remove_repeats(docs).collect())
    assert {r.doc_id: r.component_id for r in J.link_documents(docs).collect()} == {k: 1 if k % 2 else k for k in range(8)}
