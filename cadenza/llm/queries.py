"""Registered queries of the corpus operators: each applies its operator with
production parameters to the whole table and returns the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from cadenza.llm import audit, bpe, chat, decontam, exact, fim, html, lines, mixing, quality, simhash, tokens, warc
from cadenza.llm.common import sha256_hex, table
from cadenza.session import scratch_path

QueryFn = Callable[[SparkSession, str], DataFrame]

#: Text of both turns of the added conversation -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
#: Token that ends a document in the token files.
END_ID = 2


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4).select(
        "doc_id", "fingerprint", "component_id", "group_size")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(CONTROL_TEXT))
    done = chat.format_conversations(rows.union(added))
    read = done.select("conv_id", "formatted", "valid", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.loss_text(F.col("formatted"), F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256_hex(said).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha256_hex(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokens.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return tokens.document_starts(spark, path)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("best", "matched", "item_words")])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, manifest, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN, keep_ids=False)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "budget")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"),
                       sha256_hex(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


# ------------------------------------------------------------------ DuckDB twins

_ESC = (r"regexp_replace(regexp_replace({0}, '<(\\*)(s>|/s>)', '<\\\1\2', 'g'), "
        r"'\[(\\*)(SYS\]|/SYS\]|INST\]|/INST\]|OUT\]|ROLE\]|TEXT\]|/ROLE\])', '[\\\1\2', 'g')")

OP3_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY n)) AS loss_sha256,
  CAST(3 + sum(length({_ESC.format('text')}) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10
    ELSE 23 + length({_ESC.format('role')}) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN n = 1 WHEN 'user' THEN n = 1 OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN n > 1 AND before = 'user' ELSE false END) AS valid
FROM o GROUP BY conv_id
"""

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP6_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(lines) - 1)) AS pos, lines FROM l WHERE len(lines) >= 3),
x AS (SELECT doc_id, pos, lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] AS window_text FROM w),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY window_text ORDER BY doc_id, pos) AS rn FROM x
      WHERE regexp_matches(window_text, '[^ \t\r\n]')),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM f WHERE rn > 1),
g AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE
    coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)),
      lambda i: lines[i]), chr(10)), '') END AS text
FROM l LEFT JOIN g USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM (
       SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)),
b AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS q, len(t) AS n FROM (
       SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM benchmark)
     WHERE len(t) >= 5),
m AS (SELECT doc_id, item_id, n, p - q AS g, q FROM d JOIN b USING (w)),
s AS (SELECT doc_id, item_id, n, g, count(*) OVER (PARTITION BY doc_id, item_id, g ORDER BY q
        RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c, count(*) OVER (PARTITION BY doc_id, item_id, g) AS total FROM m)
SELECT doc_id, item_id, max(c) AS best, max(total) AS matched, CAST(max(n) AS BIGINT) AS item_words
FROM (SELECT doc_id, item_id, g, n, max(c) AS c, max(total) AS total FROM s GROUP BY ALL)
WHERE CASE WHEN n >= 13 THEN c >= 11 ELSE total >= n - n // 5 END GROUP BY doc_id, item_id
"""

OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP11_SQL = r"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
d AS (SELECT *, md5(key || ':' || (row_number() OVER (PARTITION BY doc_id, source, size, key) - 1)) AS pos FROM z),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size,
        [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w FROM d GROUP BY source),
f AS (SELECT *, CAST(sum(size) OVER () - coalesce(sum(3 * size) OVER o, 0) AS DOUBLE)
          / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
      FROM s WINDOW o AS (ORDER BY CAST(3 * size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, size AS source_size, least(CAST(3 * size AS DOUBLE), max(level) OVER () * w) AS target FROM f),
b AS (SELECT *, least(3 * source_size, CAST(floor(target + 0.5) AS BIGINT)) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS epochs FROM b),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY pos, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, p.source, budget,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""

OP12_SQL = r"""
WITH RECURSIVE x AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM x),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
       CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
       + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
       + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
     FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
r AS (SELECT CAST('' AS VARCHAR) AS o, 0 AS used, 0 AS step UNION ALL SELECT o || f, used + b, step + 1 FROM r JOIN f ON (used & b) = 0),
k AS (SELECT o AS filter_order FROM r WHERE step = 5),
s AS (SELECT filter_order, step, f.b, f.f, coalesce((SELECT sum(g.b) FROM f g WHERE instr(filter_order, g.f) < step), 0)::INT AS ran
      FROM k JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) n ON true JOIN f ON f.f = filter_order[step]),
a AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & (ran | b) = 0 THEN n ELSE 0 END) AS kept,
       sum(CASE WHEN mask & ran = 0 AND mask & b <> 0 THEN n ELSE 0 END) AS removed,
       sum(CASE WHEN mask & ran <> 0 AND mask & b <> 0 THEN n ELSE 0 END) AS redundant,
       sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
       sum(CASE WHEN mask & ran = 0 AND mask & b <> 0 THEN good ELSE 0 END) AS good_lost,
       sum(CASE WHEN mask & ran = 0 AND mask & b <> 0 THEN toxic ELSE 0 END) AS toxic_lost
     FROM c JOIN s ON true GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM a
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST(len(lines) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS i, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS j,
        CASE WHEN text = '' OR regexp_matches(text, '<P>|<S>|<M>') OR r[3] % 100 >= 100 THEN 'plain'
             WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, n, form, text, coalesce(array_to_string(lines[1:i], ''), '') AS a,
        coalesce(array_to_string(lines[i + 1:j], ''), '') AS b, coalesce(array_to_string(lines[j + 1:n], ''), '') AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
    ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE a || b || c END) AS restored_sha256
FROM p
"""

QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_quality_classifier, op3_chat_format, op4_exact_dedup, op5_token_files, op6_line_dedup,
    op7_html_main_text, op8_decontamination, op9_warc, op10_bpe, op11_source_mix, op12_filter_audit, op13_fill_in_middle)}
ORACLE: dict[str, str] = {"op3_chat_format": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL,
                          "op8_decontamination": OP8_SQL, "op9_warc": OP9_SQL, "op11_source_mix": OP11_SQL,
                          "op12_filter_audit": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
