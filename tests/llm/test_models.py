"""Operators 3 and 5: held-out accuracy and edge cases; the pipeline against its operators."""

import random

import numpy as np

from collinea.llm import html_extraction as H
from collinea.llm import toxicity as T


def toxic_rows(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = ["scum", "idiot", "vermin", "trashy"]
    rows = []
    for k in range(n):
        grade = rng.choice([0, 0, 0, 1, 2])
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))] + [rng.choice(bad) for _ in range((0, 2, 7)[grade])]
        rng.shuffle(text)
        rows.append((k, " ".join(text), grade))
    return rows


def test_toxicity_on_held_out_texts(spark):
    rows = toxic_rows(1, 900)
    docs = spark.createDataFrame([(k, t, 1.0) for k, t, _ in rows] + [(None, "scum idiot vermin trashy", 1.0), (5000, None, 1.0), (5001, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, g) for k, _, g in rows if k < 600] + [(7, None), (99999, 1)], "doc_id long, grade int")
    model = T.fit_on(docs, labels, [0, 1, 2], 400)
    assert len(model.biases) == 2 and model.biases[0] > model.biases[1]
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    held = [(got[k], g) for k, _, g in rows if k >= 600]
    assert np.mean([r.toxic == (g > 0) for r, g in held]) > 0.9
    severity = [np.mean([r.expected_severity for r, g in held if g == want]) for want in (0, 1, 2)]
    assert severity[0] < 0.3 < severity[1] < severity[2] and severity[2] > 1.3
    assert got[None].toxic and not got[5000].toxic and got[5000].expected_severity == got[5001].expected_severity


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert [r.expected_severity for r in T.score(docs, T.fit_on(docs, none, [0, 1, 2])).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, grade int")
    assert [r.expected_severity for r in T.score(docs, T.fit_on(docs, one, [0, 1, 2])).collect()] == [1.0, 1.0]
    assert T.score(docs.limit(0), T.fit_on(docs, one, [0, 1, 2])).count() == 0


def prose(seed, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randint(2, 9)))
    return [" ".join(word() for _ in range(rng.randint(10, 80))).capitalize() + "." for _ in range(n)]


def test_extraction_on_held_out_pages():
    rng = random.Random(11)
    train = [H.retold(prose(1), rng)[0] for _ in range(60)]
    model = H.fit_model(train)
    rng = random.Random(12)
    pages = [H.retold(prose(2), rng) for _ in range(200)]
    found = model.main_texts([source for source, _ in pages])
    exact = [text.split("\n\n") == [" ".join(x.split()) for x in main] for text, (_, main) in zip(found, pages)]
    assert np.mean(exact) > 0.9


def test_extraction_of_pages(spark):
    article = "<article><h1>Title &amp; more</h1><p><b>First\n  line<br>goes on.<p title='a>b'>Second paragraph, long enough to be one.</p></article>"
    page = f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy now.</div>{article}<footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (4, "x", "<nav>only</nav>"), (5, "y", "<p>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in H.extract(pages, H.fit_on(pages)).collect()}
    assert got[1].text == got[None].text == "Title & more\n\nFirst line goes on.\n\nSecond paragraph, long enough to be one."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == "" and got[2].url is None
    assert len(got) == 6 and H.extract(pages.limit(0), H.fit_on(pages.limit(0))).count() == 0


PARAGRAPHS = ["The river had been high for a week, and the mill stood idle until the water fell again.", "Nobody in the village could say who had opened the gate, or why the lamp was still burning.", "By the second morning the road was dry enough for carts, and the market opened at noon."]
P1, P2, P3 = PARAGRAPHS
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Contact</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2020 The Paper</p><ul><li><a href='/t'>Terms</a></li></ul></footer>"
#: (html, blocks of the main text), written by hand
BY_HAND = {
    "short heading": (f"<html><body>{NAV}<article><h1>T</h1><p>{P1}</p><p>{P2}</p></article>{FOOT}</body></html>", ["T", P1, P2]),
    "header inside": (f"<body>{NAV}<article><header><h1>My title</h1></header><p>{P1}</p><p>{P3}</p></article>{FOOT}</body>", ["My title", P1, P3]),
    "table": (f"<body>{NAV}<article><h1>Prices</h1><p>{P1}</p><table><tr><td>Corn</td><td>12</td><td>up</td></tr><tr><td>Rye</td><td>9</td><td>down</td></tr></table><p>{P2}</p></article>{FOOT}", ["Prices", P1, "Corn", "12", "up", "Rye", "9", "down", P2]),
    "short list": (f"<body>{NAV}<article><h1>What to bring</h1><p>{P1}</p><ul><li>Rope</li><li>Bread</li><li>A lamp</li></ul><p>{P2}</p></article>{FOOT}", ["What to bring", P1, "Rope", "Bread", "A lamp", P2]),
    "link paragraph": (f"<body>{NAV}<article><h1>The gate</h1><p>{P1}</p><p><a href='/x'>{P3}</a></p><p>{P2}</p></article>{FOOT}", ["The gate", P1, P3, P2]),
    "formula": (f"<body>{NAV}<article><h1>The gate</h1><p>{P1}</p><p>We find <math><mi>x</mi><mo>=</mo><mn>2</mn></math> at once.</p></article>{FOOT}", ["The gate", P1, "We find x=2 at once."]),
    "named like a side part": (f"<body>{NAV}<article class='related-story'><h1>The gate</h1><p>{P1}</p><p>{P2}</p></article>{FOOT}", ["The gate", P1, P2]),
    "unclosed comment": (f"<body>{NAV}<article><h1>The gate</h1><p>{P1}</p><!-- <p>{P2}</p></article>{FOOT}", ["The gate", P1]),
    "reader comments": (f"<body>{NAV}<div id='content'><h1>The gate</h1><p>{P1}</p><p>{P2}</p></div><div class='comments'><h3>Comments</h3><p>I was there, too, and saw it.</p><p>So did I.</p></div>{FOOT}", ["The gate", P1, P2]),
    "form and notice": (f"<body><div class='cookie-notice'><p>We use cookies to make this better.</p></div>{NAV}<main><h1>The gate</h1><p>{P1}</p><form><p>Sign up</p><input></form><p>{P2}</p></main><aside><h3>More</h3><p>Other news of the day.</p></aside>{FOOT}", ["The gate", P1, P2]),
}


SIDE = "<h3>Related</h3><p>Five more mills that you should see before the summer ends.</p>"
SAID = "<p>Great read, thank you for this!</p><p>I was there, too, and it was not like that at all.</p>"
CROSS = "<nav class='x1'><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"


def in_article(*parts):
    return f"<html><body>{NAV}<article>{''.join(parts)}</article>{FOOT}</body></html>"


TOP = f"<h1>The gate</h1><p>{P1}</p>"
#: more pages written by hand, mostly with foreign parts inside of the article
BY_HAND |= {
    "sidebar inside": (in_article(TOP, f"<aside class='sidebar'>{SIDE}</aside>", f"<p>{P2}</p>"), ["The gate", P1, P2]),
    "plain aside inside": (in_article(TOP, f"<aside>{SIDE}</aside>", f"<p>{P2}</p>"), ["The gate", P1, P2]),
    "comments inside": (in_article(TOP, f"<p>{P2}</p><section id='comments'><h3>2 comments</h3>{SAID}</section>"), ["The gate", P1, P2]),
    "footer inside": (in_article(TOP, f"<p>{P2}</p><footer><p>Filed under news</p></footer>"), ["The gate", P1, P2]),
    "unnamed replies after main": (f"<body>{NAV}<main>{TOP}<p>{P2}</p><p>{P3}</p></main><div><h3>Replies</h3>{SAID}</div>{FOOT}", ["The gate", P1, P2, P3]),
    "meaningless names": (f"<body><div class='a1'><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Sport</a></li></ul></div><div class='b7'>{TOP}<p>{P2}</p><p>{P3}</p></div><div class='k9'><p>&copy; 2020 The Paper</p></div>", ["The gate", P1, P2, P3]),
    "form inside": (in_article(TOP, "<form><p>Sign up for our letter</p><label>Mail</label><input></form>", f"<p>{P2}</p>"), ["The gate", P1, P2]),
    "advert inside": (in_article(TOP, "<div class='advert'><p>Buy our lamps, half price this week only.</p></div>", f"<p>{P2}</p>"), ["The gate", P1, P2]),
    "menu inside": (in_article(TOP, CROSS, f"<p>{P2}</p><p>{P3}</p>"), ["The gate", P1, P2, P3]),
    "notice inside": (in_article("<div class='notice'><p>This page uses cookies. By reading on you agree.</p></div>", TOP, f"<p>{P2}</p>"), ["The gate", P1, P2]),
    "comments list inside": (in_article(TOP, f"<p>{P2}</p>", "<div id='comments'><ol><li><p>First!</p></li><li><p>Where was this picture taken, please?</p></li></ol></div>"), ["The gate", P1, P2]),
    "aside at the end": (in_article(TOP, f"<p>{P2}</p><p>{P3}</p>", f"<aside>{SIDE}</aside>"), ["The gate", P1, P2, P3]),
    "two asides": (in_article(TOP, f"<aside>{SIDE}</aside>", f"<p>{P2}</p>", "<aside class='widget'><p>Most read this week</p></aside>", f"<p>{P3}</p>"), ["The gate", P1, P2, P3]),
    "footer with links inside": (in_article(TOP, f"<p>{P2}</p>", "<footer class='post-footer'><p>Posted by Anna</p><ul><li><a href='/t'>mills</a></li><li><a href='/u'>rivers</a></li></ul></footer>"), ["The gate", P1, P2]),
    "sections": (in_article("<h1>The gate</h1>", f"<section><h2>Water</h2><p>{P1}</p></section><section><h2>Roads</h2><p>{P3}</p></section>", f"<aside>{SIDE}</aside>"), ["The gate", "Water", P1, "Roads", P3]),
    "aside in a section": (in_article("<h1>The gate</h1>", f"<section><h2>Water</h2><p>{P1}</p><aside>{SIDE}</aside><p>{P2}</p></section>"), ["The gate", "Water", P1, P2]),
    "main with parts": (f"<body><header><h2>The Paper</h2></header>{NAV}<main><article>{TOP}<p>{P2}</p></article><aside class='related'>{SIDE}</aside></main>{FOOT}", ["The gate", P1, P2]),
    "quote and list stay": (in_article(TOP, f"<blockquote><p>{P2}</p></blockquote><ol><li>Shut the gate</li><li>Light the lamp</li></ol>", f"<aside>{SIDE}</aside>", f"<p>{P3}</p>"), ["The gate", P1, P2, "Shut the gate", "Light the lamp", P3]),
    "caption stays": (in_article(TOP, "<figure><img src='a'><figcaption>The mill in spring</figcaption></figure>", f"<p>{P2}</p>"), ["The gate", P1, "The mill in spring", P2]),
    "newsletter form and comments": (in_article(TOP, f"<p>{P2}</p>", "<form class='newsletter'><p>Our best stories, every week</p></form>", f"<section class='comment-list'><h3>Comments</h3>{SAID}</section>"), ["The gate", P1, P2]),
    "many comments": (in_article(TOP, f"<p>{P2}</p>", "<section id='comments'><h3>Comments</h3>" + SAID * 5 + "</section>"), ["The gate", P1, P2]),
    "related links": (in_article(TOP, f"<p>{P2}</p>", "<div class='related'><h3>Read on</h3><ul><li><a href='/1'>The mill burns</a></li><li><a href='/2'>The lamp is lit</a></li></ul></div>"), ["The gate", P1, P2]),
    "meaningless names, comments": (f"<body><div class='q1'><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></div><div class='q2'>{TOP}<p>{P2}</p><p>{P3}</p></div><div class='comments'><h3>Comments</h3>{SAID}</div><div class='q3'><p>&copy; The Paper</p></div>", ["The gate", P1, P2, P3]),
    "header with date": (in_article(f"<header><h1>The gate</h1><p>3 May 1911</p></header><p>{P1}</p><p>{P2}</p>", f"<aside>{SIDE}</aside>"), ["The gate", "3 May 1911", P1, P2]),
    "sidebar before main": (f"<body>{NAV}<div class='sidebar'>{SIDE}</div><div class='content'>{TOP}<p>{P2}</p></div>{FOOT}", ["The gate", P1, P2]),
    "subheadings": (in_article(TOP, f"<h2>Later</h2><p>{P2}</p><h2>Last</h2><p>{P3}</p>", "<footer><p>Filed under news</p></footer>"), ["The gate", P1, "Later", P2, "Last", P3]),
}

#: pages that still come out wrong with this small training set; README names them
NOT_YET = {"meaningless names, comments", "notice inside"}


def plain_page(text, k):
    body = "".join(f"<p>{x}</p>" for x in text[k : k + 2 + k % 3])
    return f"<html><head><title>x</title></head><body><nav><ul>{''.join(f'<li><a href=/>{w}</a></li>' for w in text[k].split()[:5])}</ul></nav><div class=ad>{text[k][:30]}</div><article><h1>{text[k][:50]}</h1>{body}</article><footer>&copy; {text[k][:40]}</footer></body></html>"


def test_extraction_of_pages_written_by_hand():
    text = prose(5, 120)
    model = H.fit_model([plain_page(text, k) for k in range(100)])
    found = dict(zip(BY_HAND, model.main_texts([source for source, _ in BY_HAND.values()])))
    wrong = {name: found[name] for name, (_, blocks) in BY_HAND.items() if found[name] != "\n\n".join(blocks)}
    assert set(wrong) <= NOT_YET, wrong


def test_parsing_is_linear():
    import time

    for piece in ("<option>x", "<a title='", "<p", "<!x", "<blockquote>", "</b", "<svg>", "<a b=\"c>"):
        seconds = []
        for n in (5_000, 40_000):
            began = time.process_time()
            H.parse("<p>one</p>" + piece * n)
            seconds.append(time.process_time() - began)
        assert seconds[1] < 25 * max(seconds[0], 0.02), (piece, seconds)


def test_decoding_is_consistent():
    rng = np.random.default_rng(0)
    source = H.retold(prose(3), random.Random(4))[0]
    page = H.parse(source)
    for _ in range(30):
        kept = set(H.decode(page, rng.normal(size=len(page.tag)) * 3))
        inside = {page.owner[k] for k in kept}
        for k, owner in enumerate(page.owner):
            if k in kept:
                continue
            # no kept block lies below a rejected one that lies below a kept one
            above = set()
            node = page.parent[owner]
            while node >= 0:
                above.add(node)
                node = page.parent[node]
            if above & inside:
                below = [j for j in kept if owner in _ancestors(page, page.owner[j])]
                assert not below


def _ancestors(page, node):
    out = set()
    while page.parent[node] >= 0:
        node = page.parent[node]
        out.add(node)
    return out


def test_pipeline_stages(spark, tmp_path):
    import pytest

    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioulnrstm") for _ in range(rng.randint(3, 8)))
    line = lambda: " ".join(word() for _ in range(30)) + "."
    passage = " ".join(f"bench{k}" for k in range(20))
    shared = line()
    clean = {k: "\n".join([line(), line(), line()]) for k in range(10)}
    rows = list(clean.items())
    rows += [(20, "too short"), (21, "\n".join([line(), shared, line()])), (22, "\n".join([line(), shared, line()])), (23, f"{line()} {passage} {line()}")]
    base = [word() for _ in range(150)]
    rows += [(30 + k, " ".join(base[:75] + [word()] + base[76:])) for k in range(3)]
    docs = spark.createDataFrame([(a, b, "en", "s", len(b)) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in P.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "sentencepiece"]
    held, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES[:-1]:
        held = P.cut(stage(spark, held, str(tmp_path)), "test")
        assert held.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in held.collect()}
    assert 20 not in kept["quality_rules"] and len(kept["quality_rules"]) == len(rows) - 1
    assert shared in kept["line_dedup"][21] and shared not in kept["line_dedup"][22]
    assert {30, 31, 32} & set(kept["ngram_jaccard"]) == {30}
    assert 23 not in kept["decontamination"]
    assert all(kept["decontamination"][k] == text for k, text in clean.items())
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept["decontamination"]) and all(len(r.piece_ids) == r.n_tokens for r in out)


def test_toxicity_keeps_the_base_rate_beyond_the_sample_bound(spark):
    grade = lambda k: 0 if k % 10 else 1 + (k % 20 == 0)
    rows = [(k, "" if k % 3 else f"plain words {k % 7}", grade(k)) for k in range(1000)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, g) for k, _, g in rows], "doc_id long, grade int")
    for bound in (4000, 400, 40):
        got = {r.doc_id: r for r in T.score(docs, T.fit_on(docs, labels, [0, 1, 2], bound)).collect()}
        assert abs(got[5000].p_toxic - 0.1) < 0.03 and abs(got[5000].expected_severity - 0.15) < 0.04 and not got[5000].toxic


def test_unread_elements_after_letters_that_grow_in_lower_case():
    for n in (0, 3, 12):
        for element in ("<script>x</script>", "<STYLE>x</Style>", "<select><option>x</SELECT>", "<head><title>x</title></HEAD>"):
            page = H.parse(f"<p>{'İ' * n}one {element}<p>two three</p><p>four</p>")
            assert page.text == [f"{'İ' * n}one", "two three", "four"], (n, element)
            assert [page.tag[k] for k in page.owner] == ["p"] * 3
