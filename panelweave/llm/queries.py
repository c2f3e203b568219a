"""The registered queries of the document operators, with SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import decontaminate, exact_dedup, fill_in_middle, fingerprint, html_text, language_id, mixing, near_dedup, packing, phrases, pii, secret_scan, suffix_dedup
from panelweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are alike to 85 in 100."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages of 100 bytes and more."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources, one row per shown copy of a document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-the-middle order."""
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of the benchmark."""
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_packing, op4_fingerprints, op5_near_dedup, op6_suffix_dedup, op7_mixing, op8_html_extraction, op9_pii, op10_secret_scan,
                               op11_fill_in_middle, op12_collocations, op13_decontamination)
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH folded AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM folded WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_near_dedup": r"""
        WITH RECURSIVE said AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i:i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM said),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
        way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, way.y FROM reach r JOIN way ON way.x = r.y)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN size USING (doc_id)""",
    "op6_suffix_dedup": """
        WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        windows AS (SELECT doc_id, p, h[2 * p + 1:2 * p + 200] AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM hexed WHERE len(h) >= 200)),
        again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 100)) AS p FROM again),
        runs AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM gone) GROUP BY doc_id, g),
        edges AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM hexed),
        kept AS (SELECT doc_id, string_agg(h[2 * c + 1:2 * a], '' ORDER BY a) AS h FROM (
          SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a) + 1, 0) AS c FROM edges) JOIN hexed USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, len(x.h) // 2 AS n_bytes, (len(x.h) - len(k.h)) // 2 AS n_removed, (SELECT count(*) FROM runs WHERE runs.doc_id = x.doc_id) AS n_spans,
          sha256(unhex(k.h)) AS kept_sha256 FROM hexed x JOIN kept k USING (doc_id)""",
    # the given pages hold one article element each, with paragraphs, line breaks, bold words, quotes and ampersands
    "op8_html_extraction": r"""
        WITH inner_part AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
        plain AS (SELECT page_id, url, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text
          FROM inner_part)
        SELECT page_id, url, text, length(text) AS n_chars FROM plain""",
    "op11_fill_in_middle": r"""
        WITH told AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
            sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        numbers AS (SELECT doc_id, t, w, len(w) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM told),
        cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
        parts AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM cuts)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
          sha256(t) AS restored_sha256 FROM parts""",
    "op12_collocations": r"""
        WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        said AS (SELECT lang, [x FOR x IN regexp_split_to_array(p, '[\x20\x09]+') IF x <> ''] AS w FROM piece),
        gram AS (SELECT lang, k, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g FROM said, (VALUES (1), (2), (3)) AS t(k)),
        f AS (SELECT lang, k, g, count(*)::HUGEINT AS c FROM gram GROUP BY ALL),
        spoken AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        cut AS (SELECT lang, g, k, c AS a, unnest(range(1, k)) AS j FROM f WHERE k > 1 AND c >= 10),
        both_parts AS (SELECT cut.*, x.c AS l, y.c AS r, (1000000::HUGEINT * a * a) // (x.c * y.c) AS score FROM cut
          JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:j] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[j + 1:]),
        best AS (SELECT * FROM both_parts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
        longer AS (SELECT lang, g, max(c) AS m FROM (SELECT lang, g[1:2] AS g, c FROM f WHERE k = 3 AND c >= 10 UNION ALL SELECT lang, g[2:3], c FROM f WHERE k = 3 AND c >= 10) GROUP BY lang, g),
        kept AS (SELECT best.lang, array_to_string(best.g, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.g = best.g WHERE m IS NULL OR 100 * m < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
        FROM kept JOIN spoken USING (lang) QUALIFY rank <= 2000""",
    "op13_decontamination": r"""
        WITH item AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        gram AS (SELECT DISTINCT item, g, len(g) AS width FROM (SELECT item, unnest([w[i:i + 9] FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS g FROM item WHERE len(w) > 0)),
        said AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        win AS (SELECT doc_id, width, i, w[i:i + width - 1] AS g FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM said, (SELECT DISTINCT width FROM gram))),
        hit AS (SELECT doc_id, i, win.width, item FROM win JOIN gram ON win.g = gram.g),
        word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + width)) AS k FROM hit) GROUP BY doc_id),
        named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM said LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
