"""The queries of this subpackage, over the whole given tables with production parameters."""

from visret.llm import (
    collocations, decontam, html_text, lang_id, licenses, packing, quality, simhash, substrings, token_align, token_scan, url_filter, vector_dedup,
)
from visret.llm.common import read


def op1_embedding_near_dedup(spark, sf_dir):
    return vector_dedup.near_dups(read(spark, sf_dir, "embeddings"))


def op2_url_filter(spark, sf_dir):
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op3_html_extraction(spark, sf_dir):
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark, sf_dir):
    return decontam.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_token_counts(spark, sf_dir):
    return token_scan.of_documents(read(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return lang_id.predict(read(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.digest(read(spark, sf_dir, "documents"))


def conversation_packing(spark, sf_dir):
    """The packing operator on instruction data, with all three limits at work."""
    sizes = packing.conversation_sizes(read(spark, sf_dir, "conversations"))
    return packing.pack_examples(sizes, max_tokens=4096, max_segments=16, max_loss=2048)


def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.groups(read(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return licenses.digest(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return quality.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_token_alignment(spark, sf_dir):
    return token_align.digest(read(spark, sf_dir, "documents"))


def op12_substring_dedup(spark, sf_dir):
    return substrings.digest(read(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup,
    op2_url_filter,
    op3_html_extraction,
    op4_benchmark_decontamination,
    op5_token_counts,
    op6_language_id,
    op7_packing,
    op8_simhash_near_dedup,
    op9_license_scan,
    op10_quality_classifier,
    op11_token_alignment,
    op12_substring_dedup,
    op13_collocations,
    conversation_packing,
)}
#: The others need zstandard sizes, XXH64, tokenizers or fitted models, which SQL doesn't have; tests
#: hold them against brute force, exact round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a), l AS (SELECT a AS vec_id, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN l USING (vec_id)""",
    "op4_benchmark_decontamination": r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows)),
found AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM p) JOIN windows USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT row, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
low AS (SELECT k, min(doc_id) AS first FROM p GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS j FROM p JOIN low USING (k) WHERE doc_id > first),
g AS (SELECT row, list(j) AS js FROM gone GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed, sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE
  list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN g USING (row)""",
    "op13_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) s(k)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, j, array_to_string(p[1:j], ' ') AS left_part, array_to_string(p[j + 1:], ' ') AS right_part FROM c, range(1, 3) s(j) WHERE j < k),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * cuts.a * cuts.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = left_part JOIN g y ON y.lang = cuts.lang AND y.phrase = right_part),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
longest AS (SELECT lang, phrase, max(a) AS longest FROM inside GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN longest USING (lang, phrase) JOIN n USING (lang) WHERE longest IS NULL OR 100 * longest < 50 * a QUALIFY rank <= 2000""",
}
