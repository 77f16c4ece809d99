"""Operators 2, 4 and 9."""

import hashlib
from collections import Counter

import pytest

from collinea.llm import sentencepieces as S
from collinea.llm import sharding, url_filters

tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a", "a  b \n\n c", "\n", "▁x ▁▁ y", "日本語 text\tx", "\x00a", "a\r\n b", "Hello, wörld! 🙂", "x" * 3000, "the " * 5000]


def test_round_trip_equals_library(spark):
    model = spm.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, TEXTS[3], "x")], "doc_id long, text string, n_tokens string")
    rows = S.encode_digests(docs, MODEL, with_ids=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = model.encode(text)
        assert list(r.piece_ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert r.n_span_bytes == len(text.encode())
    back = S.decode(S.encode(docs, MODEL), MODEL).collect()
    assert all(r.decoded == model.decode(model.encode(r.text or "")) for r in back)


def test_spans_equal_library(spark):
    model = spm.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in S.encode(docs, MODEL).collect():
        for piece, a, b in zip(model.encode(r.text or "", return_type="proto").pieces, r.piece_begin, r.piece_end):
            if not piece.piece.startswith("<0x"):  # the library gives byte pieces no span of their own
                assert (a, b) == (piece.begin, piece.end)


def test_character_map_equals_library():
    from sentencepiece import sentencepiece_model_pb2

    normaliser = spm.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(normaliser.serialized_model_proto())
    mine = S.Normaliser(proto.normalizer_spec)
    for text in ["ﬁne  Ⅳ ㌔ x", "　ａｂｃ ", "é é ½", "한국어 ㈱", "a\tb　c", "plain", ""]:
        out, origin = mine(text)
        assert out.replace(S.SPACE, " ").strip() == normaliser.normalize(text).replace(S.SPACE, " ").strip()
        assert len(origin) == len(out.encode()) + 1 and (origin[1:] >= origin[:-1]).all() and origin[-1] <= len(text.encode())


def test_shards_fit(spark):
    limit = 2000
    rows = [(k, "x" * (k % 97)) for k in range(1500)] + [(7, "y" * 900)] * 9 + [(8, "z" * 5000), (9, None), (None, "null"), (None, "null")]
    docs = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, shard string").repartition(5)
    got = sharding.assign(docs, limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((a, len(b or "")) for a, b in rows)
    held, number = Counter(), Counter()
    for r in got:
        held[r.shard] += r.n_bytes
        number[r.shard] += 1
    for r in got:
        assert held[r.shard] == r.shard_bytes and number[r.shard] == r.shard_docs
        assert r.shard_bytes <= limit or (r.over_limit and r.shard_docs == 1)
    bits = {r.shard.split(".")[0] for r in got}
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)
    # only full parents were split
    for b in bits - {""}:
        assert sum(n for s, n in held.items() if s.split(".")[0].startswith(b[:-1])) > limit
    assert sharding.assign(docs.limit(0), limit).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t" * 50, k % 3) for k in range(200)] + [(5, "t" * 50, 5)] * 60, "doc_id long, text string, extra long")
    sharding.write_shards(docs, str(tmp_path / "out"), 1500, 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 260 and back.select("extra").distinct().count() == 4
    assert back.groupBy("shard_bits").count().agg({"count": "max"}).first()[0] <= 30


def url_brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in url_filters.HOST_RULES:
        name, at = rule.name.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + at) and (best is None or len(rule.name) > len(best.name)):
            best = rule
    return host, path, best and best.name, best and best.verdict


def test_url_rules(spark):
    urls = [None, "", "no address", "http://a.org", "http://a.org/", "HTTPS://WWW.Example.ORG/es/x?y", "http://example.org/es", "http://notexample.org/es/1", "http://example.org/en/1", "http://example.org/en/123#a", "http://example.org/EN/1"]
    urls += ["http://x.com/fr/?q=/de/", "http://x.com/de/", "http://com/de/a", "http://x.com?/de/", "http://www.cheap-pills.example.com/en/2", "http://spam-farm.example.net/", "http://fine.example.net/en/1", "http://x.net/cart/checkout", "http://é.net/ü", "http://a.org/://b.com/de/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, urls[5], "h")], "page_id long, url string, host string")
    got = url_filters.filter_urls(pages, [*url_filters.HOST_RULES, *url_filters.PATTERN_RULES]).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = url_brute(urls[5] if r.page_id is None else urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        if rule:
            assert (r["name"], r.verdict) == (rule, verdict)
        else:
            assert r.tier in (None, 0)
    verdicts = {urls[r.page_id]: r.verdict for r in got if r.page_id is not None}
    assert [verdicts[u] for u in ("http://www.cheap-pills.example.com/en/2", "http://spam-farm.example.net/", "http://fine.example.net/en/1", "http://x.net/cart/checkout")] == ["block", "block", "allow", "block"]
    assert url_filters.filter_urls(pages.limit(0), url_filters.HOST_RULES).count() == 0


def test_rule_tokens():
    assert url_filters.rule_tokens("||example.org/en/1") == ["en", "example", "org"]
    assert url_filters.rule_tokens("^cheap^pills^") == ["cheap", "pills"]
    assert url_filters.rule_tokens("ad*vert") == []
