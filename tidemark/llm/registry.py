"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bpe import op6_bpe
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .fingerprints import op7_fingerprints
from .language_id import op9_language_id
from .licenses import op3_licenses
from .line_dedup import op8_line_dedup
from .lm_scoring import op12_lm_scoring
from .merkle import op11_merkle
from .mixing import OP5_SQL, op5_mixing
from .pii import op4_pii
from .simhash import op1_simhash
from .spelling import op13_spelling
from .suffix_dedup import op2_suffix_dedup

QUERIES = {"op1_simhash": op1_simhash, "op2_suffix_dedup": op2_suffix_dedup, "op3_licenses": op3_licenses, "op4_pii": op4_pii, "op5_mixing": op5_mixing, "op6_bpe": op6_bpe, "op7_fingerprints": op7_fingerprints, "op8_line_dedup": op8_line_dedup, "op9_language_id": op9_language_id, "op10_exact_dedup": op10_exact_dedup, "op11_merkle": op11_merkle, "op12_lm_scoring": op12_lm_scoring, "op13_spelling": op13_spelling}
ORACLES = {"op5_mixing": OP5_SQL, "op10_exact_dedup": OP10_SQL}
