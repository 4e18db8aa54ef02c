"""The queries of the dealt operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_text, langid, mixing, neighbours, packing, personal, prefix_trie, quality, simhash, spelling, token_counts, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of sources takes; nulls have size 0, a null source is its own, equal rows count each."""
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every url, null ones included; repeated rows stay, long urls are read whole."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the fixed patterns, and all spans with the learned ones."""
    return personal.report(_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every hundredth; unusable vectors take no part."""
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, null and empty ones included, as pieces placed in sequences of 2048 tokens at most."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with totals and quantiles for every context limit."""
    return token_counts.length_histogram(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, `und` without letters; learned from documents that are not held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal normalised texts of every document and which one stays."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page; empty where there is none."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest id that links reach from it."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all texts with its near words, its more frequent form and the root of its forms."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, whose first turns come from the first of their family."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), shared_starts=True)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text and whether it passes the table of thresholds; null texts have no words."""
    return quality.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_url_filter": op2_url_filter,
    "op3_personal": op3_personal,
    "op4_neighbours": op4_neighbours,
    "op5_pack": op5_pack,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html_text": op9_html_text,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality": op13_quality,
}

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
QUALITY_SQL = r"""
    WITH r AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    a AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM r),
    c AS (SELECT r, doc_id, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letters,
      len(list_filter(w, lambda x: translate(trim(x, AROUND), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN (STOP))) AS n_stop,
      len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•‣*·-][\x20\x09-\x0D]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(…|\.\.\.)[\x20\x09-\x0D]*$'))) AS n_dots FROM a),
    i AS (SELECT r, w, unnest(generate_series(1, n_words - 7)) AS i FROM c),
    g AS (SELECT r, list(i) AS spots FROM i GROUP BY r, array_to_string(w[i:i + 7], ' ') HAVING count(*) > 1),
    x AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM (SELECT r, unnest(spots) AS i FROM g)) GROUP BY r),
    m AS (SELECT *, coalesce(x.n_repeat_words, 0) AS n_repeat, n_words < 20 OR 100 * coalesce(x.n_repeat_words, 0) > 30 * n_words AS base_failed FROM c LEFT JOIN x USING (r)),
    f AS (SELECT *, concat_ws(',', CASE WHEN word_chars / nullif(n_words, 0) < 3 OR word_chars / nullif(n_words, 0) > 10 THEN 'word_length' END, CASE WHEN n_symbols / nullif(n_words, 0) > 0.1 THEN 'symbols' END,
      CASE WHEN n_letters / nullif(n_words, 0) < 0.8 THEN 'letters' END, CASE WHEN n_stop < 2 THEN 'stop_words' END, CASE WHEN n_bullets / nullif(n_lines, 0) > 0.9 THEN 'bullet_lines' END,
      CASE WHEN n_dots / nullif(n_lines, 0) > 0.3 THEN 'ellipsis_lines' END, CASE WHEN n_dup_lines / nullif(n_lines, 0) > 0.3 THEN 'duplicate_lines' END) AS failed FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words,
      base_failed, NOT base_failed AND failed = '' AS kept, failed FROM f""".replace("STOP", _STOP).replace("AROUND", "'" + quality.AROUND.replace("'", "''") + "'")

ORACLES: dict[str, str] = {
    "op2_url_filter": r"""
        WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
          ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        f AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
          FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY page_id)
        SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)""",
    "op8_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
          doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list({'k': concat(length(role), ':', role, length(text), ':', text), 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST) AS l FROM t GROUP BY conv_id),
        h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % 4 AS h FROM o),
        r AS (SELECT h.conv_id, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
        p AS (SELECT conv_id, d, sha256(array_to_string(list_transform(l[1:d], lambda x: x.k), '')) AS k, CASE WHEN d > 0 THEN l[d].w ELSE 0 END AS w, d = len(l) AS ends
          FROM (SELECT conv_id, l, unnest(generate_series(0, len(l))) AS d FROM r)),
        n AS (SELECT d, k, min(conv_id) AS c, count(*) AS n, max(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS e, count(*) FILTER (ends) = count(*) AS leaf FROM p GROUP BY d, k),
        up AS (SELECT n.d, n.k, q.k AS pk FROM n JOIN p q ON q.conv_id = n.c AND q.d = n.d - 1),
        ch AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM up GROUP BY ALL),
        s AS (SELECT a.d, a.k, sum(CASE WHEN n.leaf THEN 1 ELSE 0 END) AS n_leaves, sum((n.n - 1) * n.w) AS saved FROM n JOIN p a ON a.conv_id = n.c AND a.d <= n.d GROUP BY a.d, a.k)
        SELECT n.c AS conv_id, n.d AS depth, pn.c AS parent_conv_id, n.n AS n_convs, coalesce(ch.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.e AS ends_sha256
        FROM n JOIN s ON s.d = n.d AND s.k = n.k LEFT JOIN up ON up.d = n.d AND up.k = n.k LEFT JOIN n pn ON pn.d = n.d - 1 AND pn.k = up.pk LEFT JOIN ch ON ch.d = n.d AND ch.k = n.k""",
    "op13_quality": QUALITY_SQL,
}
