"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from rankmill.llm import centroids, chat, repair
from rankmill.llm.bpe import op3_byte_bpe
from rankmill.llm.centroids import op13_centroid_clustering
from rankmill.llm.chat import op7_chat_formatting
from rankmill.llm.digests import op9_fingerprints
from rankmill.llm.jaccard import op10_ngram_jaccard
from rankmill.llm.languages import op11_language_id
from rankmill.llm.licenses import op4_license_scans
from rankmill.llm.neighbours import op5_nearest_neighbours
from rankmill.llm.packing import op1_packing
from rankmill.llm.quality import op2_quality_classifier
from rankmill.llm.repair import op12_conversation_repair
from rankmill.llm.secrets import op6_secret_scans
from rankmill.llm.token_counts import op8_token_counts

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_quality_classifier, op3_byte_bpe, op4_license_scans, op5_nearest_neighbours, op6_secret_scans, op7_chat_formatting, op8_token_counts, op9_fingerprints, op10_ngram_jaccard, op11_language_id, op12_conversation_repair, op13_centroid_clustering)
}
#: Sets as lists of shingles' texts, pairs by what they share, and the least document that links reach.
_JACCARD = r"""
WITH RECURSIVE said AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) END AS s FROM said
), each AS (
    SELECT doc_id, len(s) AS size, unnest(s) AS shingle FROM sets
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)
    GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))
), reach AS (
    SELECT doc_id AS node, doc_id AS seen FROM documents
    UNION
    SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.seen
), least_seen AS (
    SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), degrees AS (
    SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT s.doc_id, len(s.s) AS n_shingles, l.component_id, coalesce(d.n, 0) AS n_links
FROM sets s JOIN least_seen l ON l.node = s.doc_id LEFT JOIN degrees d ON d.a = s.doc_id
"""
SQL: dict[str, str] = {"op10_ngram_jaccard": _JACCARD, "op13_centroid_clustering": centroids.sql(), "op12_conversation_repair": repair.SQL, "op7_chat_formatting": chat.SQL}
