"""Queries of the text operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from agrispark.llm.chat_format import op10_chat_format
from agrispark.llm.decontaminate import op6_decontaminate
from agrispark.llm.html_extract import op5_html_extract
from agrispark.llm.licenses import op7_license_scan
from agrispark.llm.oracles import ORACLES
from agrispark.llm.packing import op8_packing
from agrispark.llm.pii import op9_pii
from agrispark.llm.quality_rules import op3_quality_rules
from agrispark.llm.simhash_golay import op2_simhash_golay
from agrispark.llm.spelling import op11_spelling_variants
from agrispark.llm.substring_dedup import op4_substring_dedup
from agrispark.llm.suffix_dedup import op1_suffix_array_dedup
from agrispark.llm.turn_repair import op12_turn_repair
from agrispark.llm.url_rules import op13_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_simhash_golay,
        op3_quality_rules,
        op4_substring_dedup,
        op5_html_extract,
        op6_decontaminate,
        op7_license_scan,
        op8_packing,
        op9_pii,
        op10_chat_format,
        op11_spelling_variants,
        op12_turn_repair,
        op13_url_filter,
    )
}
ORACLE_SQL = ORACLES
