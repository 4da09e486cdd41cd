"""The registered queries of the numbered operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from .bpe_fold import op12_byte_bpe
from .embedding_dedup import OP7_SQL, op7_embedding_dedup
from .html_text import op1_html_text
from .line_dedup import op6_line_dedup
from .near_join import OP8_SQL, op8_near_join
from .packing import op5_best_fit_packing
from .pseudonyms import op9_pseudonyms
from .quality_classifier import op4_quality_classifier
from .quality_rules import op10_quality_rules
from .sentencepiece_lattice import op3_sentencepiece
from .source_audit import OP11_SQL, op11_source_divergence
from .token_files import op2_token_files
from .whitening import op13_whitening

QUERIES = {
    "op3_sentencepiece": op3_sentencepiece,
    "op1_html_text": op1_html_text,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_near_join": op8_near_join,
    "op6_line_dedup": op6_line_dedup,
    "op9_pseudonyms": op9_pseudonyms,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op4_quality_classifier": op4_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op7_embedding_dedup": OP7_SQL,
    "op8_near_join": OP8_SQL,
    "op11_source_divergence": OP11_SQL,
}
