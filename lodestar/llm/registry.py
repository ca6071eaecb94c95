"""Queries of the training-data operators and the SQL that gives the same rows."""

from .embeddings import OP2_SQL, op2_embedding_near_dedup
from .fingerprint import op7_document_fingerprints
from .html import op1_html_extraction
from .interaction import OP11_SQL, op11_filter_interaction
from .language import op4_language_id
from .mixing import OP5_SQL, op5_mix_sources
from .ngram_join import OP8_SQL, op8_ngram_join
from .packing import op6_best_fit_packing
from .pii import op3_pii
from .quality import op10_quality
from .toxicity import op13_toxicity
from .urls import op9_url_filter
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_embedding_near_dedup, op3_pii, op4_language_id, op5_mix_sources, op6_best_fit_packing,
        op7_document_fingerprints, op8_ngram_join, op9_url_filter, op10_quality, op11_filter_interaction, op12_vector_codes, op13_toxicity,
    )
}
ORACLE_SQL = {
    "op2_embedding_near_dedup": OP2_SQL, "op5_mix_sources": OP5_SQL, "op8_ngram_join": OP8_SQL, "op11_filter_interaction": OP11_SQL, "op12_vector_codes": OP12_SQL,
}
