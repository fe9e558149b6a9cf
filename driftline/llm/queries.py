"""The training-data operators' registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from driftline.llm import bpe, language_model, lines, neighbours, packing, quality_model, quality_rules, simhash, substring, toxicity
from driftline.llm.common import table


def op1_toxicity_crf(spark, sf_dir):
    """Toxicity of every document, learned from labels outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_adaptive_scan_neighbours(spark, sf_dir):
    """Five nearest of every fiftieth embedding, against all others."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op3_quality_fourier(spark, sf_dir):
    """Quality of every document, learned from labels outside the held-out fold."""
    return quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_attention_scores(spark, sf_dir):
    """Model and unigram base log probabilities of every document."""
    return language_model.scores(table(spark, sf_dir, "documents"))


def op5_mixture_packing(spark, sf_dir):
    """Every document's tokens in mixture-controlled sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_bpe_roundtrip(spark, sf_dir):
    """Every document encoded and decoded again, as digests."""
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"))


def op7_fuzzy_line_dedup(spark, sf_dir):
    """What every document keeps once near-equal lines stay at their first occurrence only."""
    return lines.kept_digests(table(spark, sf_dir, "documents"))


def op8_quality_outliers(spark, sf_dir):
    """Base counts and verdict of every document."""
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    """What every document keeps once passages of 50 words that an earlier one holds are gone."""
    return substring.kept_digests(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity_crf": op1_toxicity_crf,
    "op2_adaptive_scan_neighbours": op2_adaptive_scan_neighbours,
    "op3_quality_fourier": op3_quality_fourier,
    "op4_attention_scores": op4_attention_scores,
    "op5_mixture_packing": op5_mixture_packing,
    "op6_bpe_roundtrip": op6_bpe_roundtrip,
    "op7_fuzzy_line_dedup": op7_fuzzy_line_dedup,
    "op8_quality_outliers": op8_quality_outliers,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op9_substring_dedup": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), starts AS (
            SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS w
            FROM docs, unnest(range(1, len(words) - 48)) AS t(i)
        ), least AS (
            SELECT w, min(doc_id) AS least_id FROM starts GROUP BY w
        ), gone AS (
            SELECT DISTINCT doc_id, p
            FROM (SELECT s.doc_id, s.i FROM starts s JOIN least USING (w) WHERE s.doc_id > least_id) r, unnest(range(r.i, r.i + 50)) AS t(p)
        ), each AS (
            SELECT doc_id, p, words[p] AS word FROM docs, unnest(range(1, len(words) + 1)) AS t(p)
        ), kept AS (
            SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS text
            FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p
            WHERE g.p IS NULL GROUP BY e.doc_id
        )
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
}
