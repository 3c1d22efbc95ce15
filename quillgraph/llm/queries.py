"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_langid as op1
from . import op2_warc as op2
from . import op3_quality as op3
from . import op4_ctw as op4
from . import op5_exact_dedup as op5
from . import op6_jaccard_join as op6
from . import op7_pii as op7
from . import op8_line_dedup as op8
from . import op9_decontaminate as op9
from . import op10_packing as op10
from . import op11_sentencepiece as op11
from . import op12_importance as op12
from . import op13_lexical_search as op13

_ALL = (
    op1.op1_language_id, op2.op2_warc, op3.op3_quality, op4.op4_lm_scoring, op5.op5_exact_dedup, op6.op6_jaccard_join, op7.op7_pii, op8.op8_line_dedup,
    op9.op9_decontaminate, op10.op10_best_fit_packing, op11.op11_sentencepiece, op12.op12_importance_resampling, op13.op13_lexical_search,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "op2_warc": op2.SQL, "op5_exact_dedup": op5.SQL, "op8_line_dedup": op8.SQL, "op9_decontaminate": op9.SQL, "op12_importance_resampling": op12.SQL, "op13_lexical_search": op13.SQL,
}
