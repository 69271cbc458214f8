"""The opN_ queries over the training-data tables, and SQL for those that SQL can express."""

from lodeflow.llm.chat_format import OP1_SQL, op1_chat_formatting
from lodeflow.llm.divergence import OP11_SQL, op11_source_divergence
from lodeflow.llm.fingerprints import OP12_SQL, op12_document_fingerprints
from lodeflow.llm.html_text import op9_html_extraction
from lodeflow.llm.license_scan import op4_license_scans
from lodeflow.llm.lm_scoring import op5_lm_scoring
from lodeflow.llm.media_columns import op2_media_columns
from lodeflow.llm.ngram_jaccard import OP3_SQL, op3_ngram_jaccard_join
from lodeflow.llm.packing import op8_packing
from lodeflow.llm.periodic_runs import op13_periodic_runs
from lodeflow.llm.piece_encoding import op6_sentencepiece
from lodeflow.llm.quality_classifier import op7_quality_classifier
from lodeflow.llm.quality_rules import op10_quality_rules

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_media_columns": op2_media_columns,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_license_scans": op4_license_scans,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op11_source_divergence": OP11_SQL, "op12_document_fingerprints": OP12_SQL}
