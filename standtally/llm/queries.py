"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standtally.llm import cap_filters, collocations, language_model, licenses, minhash, mixing, order_minhash, packing, prefix_trie, quality, suffix_dedup, surrogates, url_lists
from standtally.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.fingerprint_documents(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    import public_tokenizers

    pieces = packing.tokenize_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    ).withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries that were active when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.filter_captures(
        url_lists.dated_captures(pages), url_lists.dated_entries(pages)
    ).select("page_id", "url", "fetched_on", "n_block", "n_allow", "first_pattern", "blocked")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data in its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs).select("doc_id", "text", "pii.n_entities", "pii.kinds")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and expressions of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = F.col("mix")
    return mixing.mix(docs).select(
        "doc_id",
        "source",
        m["size"].alias("size"),
        m["source_size"].alias("source_size"),
        m["target"].alias("target"),
        (m["whole"] * m["size"] + m["extra"]).alias("taken"),
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 50 bytes that earlier documents hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = suffix_dedup.remove_repeats(docs)
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents, on shingles of four words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, size=4, percent=80)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate vectors."""
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over all rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language, by their weakest cut."""
    return collocations.collocations(table(spark, sf_dir, "documents")).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the words' counts and under the model."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH parts AS (
  SELECT page_id, url,
    DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched_on,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'),
      lambda s: s <> '') AS segments
  FROM pages),
hosts AS (SELECT host, min(page_id) AS m FROM parts WHERE host <> '' GROUP BY 1),
starts AS (SELECT host || '/' || segments[1] AS path, min(page_id) AS m FROM parts
  WHERE host <> '' AND len(segments) > 0 GROUP BY 1),
entries AS (
  SELECT 'block' AS list, 'domain' AS scope, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS pattern,
    m * 11 % 200 AS day, 'add' AS action FROM hosts WHERE m % 3 = 0
  UNION ALL SELECT 'block', 'domain', regexp_extract(host, '([^.]+\\.[^.]+)$', 1), m * 11 % 200 + 60, 'remove'
    FROM hosts WHERE m % 3 = 0
  UNION ALL SELECT 'block', 'domain', regexp_extract(host, '([^.]+\\.[^.]+)$', 1), m * 11 % 200 + 120, 'add'
    FROM hosts WHERE m % 6 = 0
  UNION ALL SELECT 'block', 'host', host, m * 7 % 300, 'add' FROM hosts WHERE m % 5 = 1
  UNION ALL SELECT 'allow', 'host', host, m * 13 % 300, 'add' FROM hosts WHERE m % 7 = 2
  UNION ALL SELECT 'allow', 'host', host, m * 13 % 300 + 45, 'remove' FROM hosts WHERE m % 7 = 2
  UNION ALL SELECT 'block', 'prefix', path, m * 17 % 250, 'add' FROM starts WHERE m % 4 = 0
  UNION ALL SELECT 'block', 'prefix', path, m * 17 % 250 + 90, 'remove' FROM starts WHERE m % 4 = 0),
daily AS (SELECT list, scope, pattern, DATE '2024-01-01' + CAST(day AS INTEGER) AS dated,
    bool_or(action = 'remove') AS removed FROM entries GROUP BY 1, 2, 3, 4),
states AS (SELECT *, lead(dated) OVER (PARTITION BY list, scope, pattern ORDER BY dated) AS until FROM daily),
keys AS (
  SELECT DISTINCT url, fetched_on, scope, pattern FROM (
    SELECT url, fetched_on, 'domain' AS scope,
      unnest([array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)]) AS pattern
      FROM parts WHERE host <> ''
    UNION ALL SELECT url, fetched_on, 'host', host FROM parts WHERE host <> ''
    UNION ALL SELECT url, fetched_on, 'prefix',
      unnest([host || '/' || array_to_string(segments[:i], '/') FOR i IN range(1, len(segments) + 1)])
      FROM parts WHERE host <> '')),
verdicts AS (
  SELECT k.url, k.fetched_on, count(*) FILTER (s.list <> 'allow') AS n_block,
    count(*) FILTER (s.list = 'allow') AS n_allow,
    min(s.scope || ':' || s.pattern) FILTER (s.list <> 'allow') AS first_pattern
  FROM keys k JOIN states s ON s.scope = k.scope AND s.pattern = k.pattern AND NOT s.removed
    AND s.dated <= k.fetched_on AND (s.until IS NULL OR k.fetched_on < s.until)
  GROUP BY 1, 2)
SELECT p.page_id, p.url, p.fetched_on, coalesce(v.n_block, 0) AS n_block, coalesce(v.n_allow, 0) AS n_allow,
  v.first_pattern, coalesce(v.n_block, 0) > 0 AND coalesce(v.n_allow, 0) = 0 AS blocked
FROM parts p LEFT JOIN verdicts v ON v.url = p.url AND v.fetched_on = p.fetched_on
"""


# The checksum by shifts: one byte of the number at a time, eight steps a byte.
OP11_SQL = """
WITH RECURSIVE bits AS (SELECT i AS b, i::BIGINT AS r, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(r ORDER BY b) AS byte FROM bits WHERE step = 8),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT],
      [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
      lambda a, x: xor(a // 256, byte[xor(a, x) % 256 + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns), crc),
rebuilt AS (SELECT convs.c, pos, role, text FROM convs JOIN turns ON turns.c = convs.base AND pos <= h
  UNION ALL SELECT convs.c, pos, role, text FROM convs JOIN turns ON turns.c = convs.c AND pos > h),
rows AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth, {'r': role, 't': text} AS turn FROM rebuilt),
lists AS (SELECT convs.c, coalesce(list(turn ORDER BY depth) FILTER (depth IS NOT NULL), []) AS path
  FROM convs LEFT JOIN rows ON rows.c = convs.c GROUP BY 1),
prefixes AS (SELECT c, d AS depth, len(path) = d AS ends, path[:d] AS path
  FROM lists, LATERAL (SELECT unnest(range(len(path) + 1)) AS d)),
nodes AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY 1, 2),
sized AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1)
      * len(regexp_extract_all(n.path[n.depth].t, '[^\\x20\\x09-\\x0D]+')) END AS own
  FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
sums AS (SELECT d AS depth, path[:d] AS path, sum(own) AS saved_tokens, sum((n_children = 0)::BIGINT) AS n_leaves
  FROM sized, LATERAL (SELECT unnest(range(sized.depth + 1)) AS d) GROUP BY 1, 2)
SELECT conv_id, sized.depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM sized JOIN sums ON sums.depth = sized.depth AND sums.path = sized.path
"""


OP12_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
tokens AS (SELECT lang, id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words),
runs AS (SELECT lang, t, lead(t, 1) OVER o AS t2, lead(t, 2) OVER o AS t3, lead(t, 3) OVER o AS t4
  FROM tokens WINDOW o AS (PARTITION BY id ORDER BY i)),
phrases AS (SELECT lang, t AS p FROM runs UNION ALL SELECT lang, t || ' ' || t2 FROM runs WHERE t2 IS NOT NULL
  UNION ALL SELECT lang, t || ' ' || t2 || ' ' || t3 FROM runs WHERE t3 IS NOT NULL
  UNION ALL SELECT lang, t || ' ' || t2 || ' ' || t3 || ' ' || t4 FROM runs WHERE t4 IS NOT NULL),
counts AS (SELECT lang, string_split(p, ' ') AS p, f FROM
  (SELECT lang, p, count(*) AS f FROM phrases GROUP BY 1, 2 HAVING count(*) >= 30)),
candidates AS (SELECT lang, p, f AS a FROM counts WHERE len(p) > 1),
cuts AS (SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r,
    (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.p = c.p[:k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, p[s:s + m - 1] AS p, a FROM candidates, (SELECT unnest(range(2, 4)) AS m),
    (SELECT unnest(range(1, 4)) AS s) WHERE m < len(p) AND s + m - 1 <= len(p)),
longer AS (SELECT lang, p, max(a) AS longer FROM inner_phrases GROUP BY 1, 2),
ranked AS (SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, array_to_string(w.p, ' ')) AS rank,
    array_to_string(w.p, ' ') AS phrase, a, l, r, score
  FROM weakest w LEFT JOIN longer g ON g.lang = w.lang AND g.p = w.p
  WHERE g.longer IS NULL OR 100::HUGEINT * g.longer < 80::HUGEINT * a)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""


def queries() -> dict[str, Query]:
    return {
        "op1_document_fingerprints": op1_document_fingerprints,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_url_filters": op3_url_filters,
        "op4_pii_surrogates": op4_pii_surrogates,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_license_scans": op6_license_scans,
        "op7_mixing": op7_mixing,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_phrase_collocations": op12_phrase_collocations,
        "op13_lm_scoring": op13_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": OP3_SQL,
        "op11_conversation_trie": OP11_SQL,
        "op12_phrase_collocations": OP12_SQL,
    }
