"""Operators for training-data pipelines, and their registered queries. Nothing else in the library imports this package."""

from pulsegrid.llm.html_text import op2_main_text
from pulsegrid.llm.lexical_search import OP13_SQL, op13_lexical_search
from pulsegrid.llm.manifest import OP12_SQL, op12_merkle_manifest
from pulsegrid.llm.metric_tree import OP10_SQL, op10_top_k
from pulsegrid.llm.mixing import op3_mixing_sources
from pulsegrid.llm.near_dedup import OP6_SQL, op6_near_dedup
from pulsegrid.llm.packing import op11_best_fit_packing
from pulsegrid.llm.pieces import op4_piece_encoding
from pulsegrid.llm.quality import op8_quality_rules
from pulsegrid.llm.secrets import op1_secret_scan
from pulsegrid.llm.suffix_tree import op5_lm_scores
from pulsegrid.llm.token_files import op7_token_files
from pulsegrid.llm.warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_main_text, op3_mixing_sources, op4_piece_encoding, op5_lm_scores, op6_near_dedup, op7_token_files, op8_quality_rules, op9_warc, op10_top_k,
    op11_best_fit_packing, op12_merkle_manifest, op13_lexical_search)}
ORACLES: dict[str, str] = {"op6_near_dedup": OP6_SQL, "op9_warc": OP9_SQL, "op10_top_k": OP10_SQL,
                           "op12_merkle_manifest": OP12_SQL, "op13_lexical_search": OP13_SQL}
