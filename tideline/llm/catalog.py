"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tideline.llm.collocations import OP12_SQL, op12_collocations
from tideline.llm.decontamination import OP13_SQL, op13_decontamination
from tideline.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tideline.llm.html_text import op5_html_extraction
from tideline.llm.language_id import language_of_pages, op4_language_id
from tideline.llm.line_dedup import OP3_SQL, op3_line_dedup
from tideline.llm.near_duplicates import OP10_SQL, op10_jaccard_join
from tideline.llm.nearest import op7_nearest
from tideline.llm.packing import op6_packing, pack_conversations
from tideline.llm.pieces import op2_sentencepiece
from tideline.llm.runs import op11_periodic_runs
from tideline.llm.secret_scan import op9_secret_scan
from tideline.llm.substring_dedup import OP8_SQL, op8_substring_dedup

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_html_extraction": op5_html_extraction,
    "op6_packing": op6_packing,
    "op7_nearest": op7_nearest,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_decontamination": op13_decontamination,
    "language_of_pages": language_of_pages,
    "pack_conversations": pack_conversations,
}
SQL = {"op1_exact_dedup": OP1_SQL, "op3_line_dedup": OP3_SQL, "op8_substring_dedup": OP8_SQL, "op10_jaccard_join": OP10_SQL, "op12_collocations": OP12_SQL, "op13_decontamination": OP13_SQL}
