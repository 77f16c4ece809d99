"""The subpackage's queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from collinea.llm import collocations, conversation_trie, decontamination, html_extraction, line_dedup, ngram_jaccard, quality_rules, sentencepieces, sharding, substring_dedup, suffix_dedup, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_digests(table(spark, sf_dir, "documents"), piece_model())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit_on(docs, toxicity.severity_grades(labels), [0, 1, 2]))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.fit_on(pages))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), **line_dedup.WHOLE)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontamination.digest_items(F.col("items")).alias("items_sha256"),
        "contaminated",
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*url_filters.HOST_RULES, *url_filters.PATTERN_RULES]
    found = url_filters.filter_urls(table(spark, sf_dir, "pages"), rules)
    named = found.withColumn("rule", F.when(F.col("tier") == 1, F.col("name"))).withColumn("pattern", F.when(F.col("tier") == 0, F.col("name")))
    return named.select("page_id", "host", "path", "rule", "verdict", "pattern")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed_lines", "kept")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.branched_trie(table(spark, sf_dir, "conversations"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op4_sql() -> str:
    bits, limit = sharding.HASH_BITS, sharding.SHARD_BYTES
    return f"""
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash FROM documents),
n AS (SELECT d, hash >> ({bits} - d) AS prefix, sum(n_bytes)::BIGINT AS b, count(*)::BIGINT AS c, min(hash) = max(hash) AS single
      FROM h, (SELECT range::INT AS d FROM range(0, {bits} + 1)) GROUP BY 1, 2),
leaf AS (SELECT h.doc_id, h.n_bytes, h.hash, min(n.d) AS depth FROM h, n
         WHERE n.prefix = h.hash >> ({bits} - n.d) AND (n.b <= {limit} OR n.single) GROUP BY ALL)
SELECT leaf.doc_id, leaf.n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(n.prefix), 64, '0'), depth) END AS shard,
       depth::INT AS depth, n.b AS shard_bytes, n.c AS shard_docs, n.b > {limit} AS over_limit
FROM leaf JOIN n ON n.d = leaf.depth AND n.prefix = leaf.hash >> ({bits} - leaf.depth)"""


def _op9_sql() -> str:
    values = ", ".join(f"({_sql_text(r.name)}, {_sql_text(url_filters.rule_regex(r.pattern))}, {_sql_text(r.verdict)}, {r.tier}, {len(r.pattern)})" for r in [*url_filters.HOST_RULES, *url_filters.PATTERN_RULES])
    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(name, regex, verdict, tier, weight) AS (VALUES {values}),
b AS (SELECT host, path, max(struct_pack(tier := tier, weight := weight, name := name, verdict := verdict)) AS best
      FROM (SELECT DISTINCT host, path FROM p) d JOIN r ON regexp_matches('.' || host || path, regex) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, CASE WHEN best.tier = 1 THEN best.name END AS rule, coalesce(best.verdict, 'allow') AS verdict,
       CASE WHEN best.tier = 0 THEN best.name END AS pattern
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path"""


def _op12_sql() -> str:
    support, top = collocations.SUPPORT, collocations.TOP
    lower = f"translate(coalesce(text, ''), '{url_filters.UPPER}', '{url_filters.LOWER}')"
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
f AS (SELECT lang, m, ws[i:i + m - 1] AS p, count(*)::BIGINT AS f
      FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS m)
      WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= {support}),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (SELECT c.lang, c.m AS m, c.p AS p, c.f AS a, x.f AS l, y.f AS r, c.k AS k, (2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f) AS score
         FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m >= 2) c
         JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:c.m]),
best AS (SELECT lang, m, p, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, p[s:s + q - 1] AS p, max(a)::HUGEINT AS most
           FROM (SELECT *, unnest(range(1, m - q + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS q FROM best)) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.p, ' ') AS phrase FROM best LEFT JOIN longer USING (lang, p) WHERE most IS NULL OR 100 * most < 80 * a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {top}"""


def _op13_sql() -> str:
    # crc32, bit by bit: the reflected polynomial, all bits of start and end inverted
    step = "list_reduce(list_concat([xor(crc, byte)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, bit: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)), lambda crc, byte: {step}), 4294967295::UBIGINT)"
    return rf"""
WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, turns, ({crc} % 4)::INT AS h FROM own),
path AS (SELECT h.c AS c, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS path FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
n AS (SELECT path[1:d] AS p, d, min(c) AS low, count(*) AS n_convs, coalesce(array_to_string(list(c ORDER BY c) FILTER (WHERE len(path) = d), ','), '') AS ends
      FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM path) GROUP BY ALL),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.p AS p, n.d AS d, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE len(regexp_extract_all(n.p[n.d].t, '[^ 	-]+')) END * (n_convs - 1) AS saved
      FROM n LEFT JOIN kids ON kids.p = n.p),
s AS (SELECT p[1:k] AS p, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM w) GROUP BY ALL)
SELECT n.low::BIGINT AS conv_id, n.d::BIGINT AS depth, a.low::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN w ON w.p = n.p JOIN s ON s.p = n.p LEFT JOIN n a ON n.d > 0 AND a.p = n.p[1:n.d - 1]"""


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_toxicity": op3_toxicity,
        "op4_sharding": op4_sharding,
        "op5_html_extraction": op5_html_extraction,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_url_filters": op9_url_filters,
        "op10_quality_rules": op10_quality_rules,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_phrase_collocations": op12_phrase_collocations,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": _op4_sql(), "op9_url_filters": _op9_sql(), "op12_phrase_collocations": _op12_sql(), "op13_conversation_trie": _op13_sql()}
