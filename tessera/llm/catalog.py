"""The queries of this subpackage and the SQL for those that SQL can express."""

from . import best_fit_packing, embedding_dedup, html_extraction, importance_resampling, jaccard_join, language_id, license_scan, quality_rules, sentencepiece_codec, source_divergence, substring_dedup, toxicity, warc

_MODULES = (substring_dedup, embedding_dedup, jaccard_join, sentencepiece_codec, license_scan, best_fit_packing, toxicity, language_id, html_extraction, quality_rules, warc, importance_resampling, source_divergence)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
