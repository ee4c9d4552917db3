"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm import ann, bpe, langid, lm, minhash, packing, quality, sharding, suffix, trie, urls, variants, warc
from specimen_spark.llm.registry import ORACLES, QUERIES, query, table
from specimen_spark.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]



def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUALITY_SQL = r"""
WITH lines AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(array_to_string(words, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(array_to_string(words, ''), '[^!]', '', 'g')) AS n_marks,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(words, lambda w: length(w) > 1 AND w = upper(w) AND w <> lower(w))) AS n_upper,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS n_letter FROM lines
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM lines)
), repeated AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM repeated GROUP BY doc_id
), judged AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM measured m LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words OR 2 * n_upper > n_words OR 2 * n_letter < n_words OR 2 * n_marks > n_words) AS kept,
  (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
    + 32 * (2 * n_upper > n_words)::BIGINT + 64 * (2 * n_letter < n_words)::BIGINT + 128 * (2 * n_marks > n_words)::BIGINT
    + 256 * (n_words > 100000)::BIGINT AS fail_bits
FROM judged
"""


@query("op9_quality_rules", QUALITY_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = quality.ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejected_by("base").alias("base_failed"), (~quality.rejected_by("v1")).alias("kept"), "fail_bits",
    )


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]
URL_SQL = r"""
WITH RECURSIVE rules(rule_host, rule_path, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), found AS (
  SELECT url, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target,
    regexp_extract(url, '(?s)^.*?://[^/?#]*') AS origin
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), edges AS (
  SELECT split_part(url, '#', 1) AS a, split_part(CASE WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '/') THEN origin || target ELSE origin || '/' || target END, '#', 1) AS b
  FROM found WHERE target <> ''
), linked AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges UNION SELECT a, a FROM edges UNION SELECT b, b FROM edges
), reached AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
), placed AS (
  SELECT u AS node, translate(coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM (SELECT url AS u FROM pages UNION SELECT b FROM edges)
), judged AS (
  SELECT DISTINCT node, host, path, arg_min(rule_host || rule_path, (-length(rule_host || rule_path), action)) AS rule, arg_min(action, (-length(rule_host || rule_path), action)) AS action
  FROM placed LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
), alias AS (
  SELECT r.a AS node, min(j.action) AS action FROM reached r JOIN judged j ON split_part(j.node, '#', 1) = r.b GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(j.action, s.action, 'allow') AS verdict
FROM pages p JOIN judged j ON p.url IS NOT DISTINCT FROM j.node LEFT JOIN alias s ON s.node = split_part(p.url, '#', 1)
"""


@query("op7_url_filters", URL_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages", "page_id", "url", "html"), urls.rule_table(spark, URL_RULES))


@query("op10_bpe_tokenizer")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("word_bpe_49k.json"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"), with_ids=False)


WARC_SQL = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
largest AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS holder FROM payloads),
bits AS (
  SELECT *, [('0x' || digest[10 * i + 1:10 * i + 10])::BIGINT FOR i IN range(4)] AS parts FROM largest
)
SELECT page_id, octet_length(payload) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < holder THEN holder END AS refers_to
FROM bits
"""


@query("op4_warc", WARC_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), target, shard_bytes=16 << 20, roll_bytes=4 << 20)
    return warc.read_archives(spark, target, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.learn(docs.where(langid.fold("doc_id", 3) != 1))
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", (langid.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_words", "n_spans")


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=3, num=85, den=100)


@query("op5_nearest_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op6_suffix_array_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_lm_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents", "doc_id", "text"), langid.fold("doc_id", 10) == 0)


@query("op13_sharding")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), scratch_path(spark, "shards")
    sharding.write_shards(docs, target, n_shards=24, seed=20)
    return sharding.ledger(sharding.read_shards(spark, target, docs.schema))


def crc32_sql(data: str) -> str:
    """DuckDB expression: unsigned crc32 of a text's UTF-8 bytes; needs the table ``crc(steps)`` of ``CRC_SQL`` in scope."""
    octets = f"list_transform(range(octet_length(encode({data}))), lambda i: ('0x' || substr(hex(encode({data})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295)"


CRC_SQL = """crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256)) AS i))"""

VARIANTS_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (SELECT id || ':' || run AS hashed, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), marked AS (SELECT run, n, {crc32_sql("hashed")} AS h FROM counted, crc
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM marked GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), shorter AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), links AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM links GROUP BY word
), formed AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS root, form AS further FROM formed
  UNION ALL SELECT f.word, g.word, g.form FROM followed f JOIN formed g ON f.further = g.word
)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN (SELECT word, root FROM followed WHERE further IS NULL) USING (word)
"""


@query("op12_spelling_variants", VARIANTS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


TRIE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT conv_id, conv_id - conv_id % 20 AS head, {crc32_sql("conv_id::VARCHAR")} % 4 AS taken FROM (SELECT DISTINCT conv_id FROM turns), crc
), opened AS (
  SELECT conv_id, head, taken, least(taken, coalesce(there, 0)) AS opened
  FROM ids LEFT JOIN (SELECT conv_id AS head, count(*) AS there FROM turns GROUP BY 1) USING (head)
), rebuilt AS (
  SELECT o.conv_id, place AS depth, role, text FROM opened o JOIN turns t ON t.conv_id = head WHERE place <= taken
  UNION ALL SELECT conv_id, place - taken + opened, role, text FROM turns JOIN opened USING (conv_id) WHERE place > taken
), lists AS (
  SELECT o.conv_id, count(depth) AS turns, list(md5(length(role) || ':' || role || text) ORDER BY depth) AS steps,
    list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY depth) AS words
  FROM opened o LEFT JOIN rebuilt USING (conv_id) GROUP BY o.conv_id
), prefixes AS (
  SELECT conv_id, depth, md5(coalesce(array_to_string(steps[1:depth], ''), '')) AS node, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words, depth = turns AS ended
  FROM (SELECT *, unnest(range(0, turns + 1)) AS depth FROM lists)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), up AS (
  SELECT p.node, p.depth, n.node AS below, n.depth AS below_depth, (n.n_convs - 1) * n.words AS saved FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth
), children AS (SELECT node, depth, count(*) FILTER (below_depth = depth + 1) AS n_children FROM up GROUP BY node, depth
), sums AS (
  SELECT u.node, u.depth, sum(saved) AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
  FROM up u JOIN children c ON c.node = below AND c.depth = below_depth GROUP BY u.node, u.depth
), parents AS (
  SELECT u.below AS node, u.below_depth AS depth, n.conv_id AS parent_conv_id FROM up u JOIN nodes n ON n.node = u.node AND n.depth = u.depth WHERE u.depth = u.below_depth - 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM nodes JOIN children USING (node, depth) JOIN sums USING (node, depth) LEFT JOIN parents USING (node, depth)
"""


@query("op11_conversation_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
