"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from marlstone.llm.decontaminate import op1_query
from marlstone.llm.fmindex import ORACLE as SUBSTRING_SQL
from marlstone.llm.fmindex import op2_query
from marlstone.llm.heaplloyd import ORACLE as CODES_SQL
from marlstone.llm.heaplloyd import op11_query
from marlstone.llm.idstore import op10_query
from marlstone.llm.langid import op8_query
from marlstone.llm.lines import op7_query
from marlstone.llm.mainpage import op9_query
from marlstone.llm.middle import ORACLE as MIDDLE_SQL
from marlstone.llm.middle import op12_query
from marlstone.llm.minhash import ORACLE as NEAR_SQL
from marlstone.llm.minhash import op13_query
from marlstone.llm.parity import ORACLE as JACCARD_SQL
from marlstone.llm.parity import op4_query
from marlstone.llm.pieces import op3_query
from marlstone.llm.topk import ORACLE as TOPK_SQL
from marlstone.llm.topk import op6_query
from marlstone.llm.urllist import ORACLE as URL_SQL
from marlstone.llm.urllist import op5_query

QUERIES = {
    "op1_decontaminate": op1_query,
    "op2_substring_dedup": op2_query,
    "op3_sentencepiece": op3_query,
    "op4_jaccard_join": op4_query,
    "op5_url_filter": op5_query,
    "op6_exact_topk": op6_query,
    "op7_line_dedup": op7_query,
    "op8_language_id": op8_query,
    "op9_main_text": op9_query,
    "op10_id_store": op10_query,
    "op11_vector_codes": op11_query,
    "op12_fill_in_middle": op12_query,
    "op13_near_copies": op13_query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING_SQL,
    "op4_jaccard_join": JACCARD_SQL,
    "op5_url_filter": URL_SQL,
    "op6_exact_topk": TOPK_SQL,
    "op11_vector_codes": CODES_SQL,
    "op12_fill_in_middle": MIDDLE_SQL,
    "op13_near_copies": NEAR_SQL,
}
