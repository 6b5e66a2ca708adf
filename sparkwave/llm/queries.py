"""The queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, conversations, divergence, encoding, html_text, line_dedup, packing, quality, repeats, secrets, sharding, simhash, token_counts
from .common import Scratch, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffled_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), scratch.path("cache"), scratch=scratch)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_figures(table(spark, sf_dir, "documents"))


def op12_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summary(conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")), gone_col="gone"))


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def base_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op1: the figures that its base rules go by."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op8: the numbers of base spans."""
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


ALL = (
    op1_quality_rules, op2_best_fit_packing, op3_sharding, op4_simhash_near_dedup, op5_token_counts,
    op6_embedding_near_dedup, op7_line_dedup, op8_secret_scans, op9_bpe_encoding, op10_html_extraction,
    op11_suffix_array_dedup, op12_conversation_structure_repair, op13_source_divergence_audit,
)


def queries() -> dict:
    return {f.__name__: f for f in (*ALL, base_figures, base_secrets)}


def oracle_sql() -> dict[str, str]:
    return {
        "base_figures": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
     ws AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
     w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM ws),
     g AS (SELECT r, p, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g, lead(p, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
     c AS (SELECT r, p FROM g WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
     rep AS (SELECT r, count(DISTINCT p + k) AS n FROM c, range(5) AS five(k) GROUP BY 1),
     l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
           WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(ws) AS base_failed
FROM d JOIN ws USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r)""",
        "base_secrets": r"""
SELECT doc_id,
       len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12))::BIGINT AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::BIGINT AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16))::BIGINT AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        # By the shape of the table's pages: one article element of headings and paragraphs each, with nothing else inside.
        "op10_html_extraction": r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split_regex(a, '</?(p|h1)>'), lambda x:
             trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text
      FROM (SELECT page_id, url, regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<br>', ' ', 'g') AS a FROM pages))""",
        "op6_embedding_near_dedup": """
WITH RECURSIVE v AS (
       SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
       WHERE len(embedding) > 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda c: CASE WHEN c IS NULL OR NOT isfinite(c) THEN 1 ELSE 0 END)) = 0
         AND list_sum(list_transform(embedding::DOUBLE[], lambda c: abs(c))) > 0),
     e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
     r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
     c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
     n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
        "op7_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
     e AS (SELECT r, source, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS raw, trim(unnest(ls), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM d),
     n AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1),
     b AS (SELECT o.source, line
           FROM (SELECT source, line, count(DISTINCT r) AS c FROM e WHERE line <> '' GROUP BY 1, 2) o
           JOIN n ON o.source IS NOT DISTINCT FROM n.source WHERE c >= 2 AND c > 0.1 * pages),
     k AS (SELECT r, string_agg(raw, chr(10) ORDER BY i) AS text, count(*) AS lines
           FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM e.source AND b.line = e.line) GROUP BY 1)
SELECT doc_id, source, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - coalesce(lines, 0), 0)::BIGINT AS n_dropped
FROM d LEFT JOIN k USING (r)""",
        # Every string of 50 bytes, as hex digits cut out of blocks with an overlap.
        "op11_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     b AS (SELECT r, doc_id, s, substring(h, 2 * s + 1, 2098) AS b FROM (SELECT *, unnest(range(0, greatest(1, length(h) // 2), 1000)) AS s FROM d)),
     w AS (SELECT r, doc_id, s + k AS i, substring(b, 2 * k + 1, 100) AS w FROM (SELECT *, unnest(range(0, least(1000, length(b) // 2 - 49))) AS k FROM b)),
     f AS (SELECT r, i FROM w JOIN (SELECT w, min(doc_id) AS first FROM w GROUP BY 1) USING (w) WHERE doc_id > first),
     g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM f)),
     s AS (SELECT r, min(i) AS low, max(i) + 50 AS high FROM g GROUP BY r, g),
     p AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM s),
     k AS (SELECT r, string_agg(substring(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substring(any_value(h), 2 * max(high) + 1) AS kept,
                  sum(high - low) AS n, count(*) AS spans FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (r)""",
        "op13_source_divergence_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
     w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
     c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3),
     g AS (SELECT DISTINCT lang, source FROM d),
     v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
     q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (total + v))::BIGINT AS q FROM kept JOIN v USING (lang)),
     dense AS (SELECT lang, g.source, term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
     big AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY 1, 2),
     p AS MATERIALIZED (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (big.total + v))::BIGINT AS p FROM dense JOIN big USING (lang, source) JOIN v USING (lang)),
     pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
     every_pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
     parts AS (SELECT lang, source, 'pair' AS part, item, value FROM every_pair
               UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
        # Costs of the rest of each conversation from its last row on, then letters from its first row on; CRC-32 bit by bit.
        "op12_conversation_structure_repair": r"""
WITH RECURSIVE
     bits(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
     crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
     o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
     h AS (SELECT o.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS how FROM o, crc),
     d AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
           FROM (SELECT *, unnest(CASE how WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE how <> 0)),
     k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy FROM d),
     p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM k),
     f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM p),
     x AS MATERIALIZED (SELECT *, left(role, 1) AS c, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000 ELSE 0 END AS bar FROM f),
     ids AS (SELECT conv_id, coalesce(max(n), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN x USING (conv_id) GROUP BY 1),
     v(conv_id, i, v0, v1, v2, v3) AS (
       SELECT conv_id, n::BIGINT, 0::BIGINT, 10::BIGINT, 5::BIGINT, 0::BIGINT FROM ids
       UNION ALL
       SELECT conv_id, i, least(b0, 5 + least(b2, 5 + b3)), least(b1, 5 + least(b2, 5 + b3)), least(b2, 5 + b3), least(b3, 5 + b2)
       FROM (SELECT conv_id, x.i, least(2 + v0, bar + late + least(1 + v2, CASE c WHEN 's' THEN v1 WHEN 'u' THEN v2 ELSE 1000 END)) AS b0,
                    least(2 + v1, bar + late + least(1 + v2, CASE c WHEN 'u' THEN v2 ELSE 1000 END)) AS b1,
                    least(2 + v2, bar + late + least(1 + v3, CASE c WHEN 'a' THEN v3 ELSE 1000 END)) AS b2,
                    least(2 + v3, bar + late + least(1 + v2, CASE c WHEN 'u' THEN v2 ELSE 1000 END)) AS b3
             FROM v JOIN x USING (conv_id) WHERE x.i = v.i - 1)),
     vs AS MATERIALIZED (SELECT conv_id, i, [v0, v1, v2, v3] AS v FROM v),
     e(conv_id, i, s, audit, out) AS (
       SELECT conv_id, 0::BIGINT, 0, '', []::VARCHAR[] FROM ids
       UNION ALL
       SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END,
              CASE letter WHEN 'D' THEN s WHEN 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END,
              audit || letter,
              CASE letter WHEN 'D' THEN out WHEN 'K' THEN list_append(out, role || ':' || text) ELSE list_append(out, CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE letter WHEN 'R' THEN text ELSE '' END) END
       FROM (SELECT e.*, x.c, x.role, x.text,
                    CASE WHEN x.i IS NOT NULL AND a.v[s + 1] = 2 + b.v[s + 1] THEN 'D'
                         WHEN a.v[s + 1] = 5 + a.v[CASE s WHEN 2 THEN 4 ELSE 3 END] THEN 'I'
                         WHEN (c = 's' AND s = 0 AND a.v[1] = late + b.v[2]) OR (c = 'u' AND s <> 2 AND a.v[s + 1] = late + b.v[3]) OR (c = 'a' AND s = 2 AND a.v[3] = late + b.v[4]) THEN 'K'
                         ELSE 'R' END AS letter
             FROM e JOIN vs a ON a.conv_id IS NOT DISTINCT FROM e.conv_id AND a.i = e.i LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.i = e.i
                  LEFT JOIN vs b ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.i = e.i + 1
             WHERE x.i IS NOT NULL OR s IN (1, 2))),
     z AS (SELECT conv_id, audit, out FROM (SELECT e.*, row_number() OVER (PARTITION BY conv_id ORDER BY length(audit) DESC) AS last FROM e) WHERE last = 1),
     nb AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM x) WHERE pair IS NOT NULL GROUP BY 1),
     g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM x GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, vs.v[1]::BIGINT AS cost, audit, sha256(array_to_string(out, chr(10))) AS repaired_sha256
FROM z JOIN vs USING (conv_id) LEFT JOIN g USING (conv_id) LEFT JOIN nb USING (conv_id) WHERE vs.i = 0""",
    }
