"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from corpusflow.llm.chat_format import OP8_SQL, op8_chat_formatting
from corpusflow.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from corpusflow.llm.language_id import op3_language_id
from corpusflow.llm.license_scan import OP6_SQL, op6_license_scan
from corpusflow.llm.line_dedup import op7_line_dedup
from corpusflow.llm.packing import op1_best_fit_packing
from corpusflow.llm.signature_join import op4_jaccard_join
from corpusflow.llm.simhash import op11_simhash
from corpusflow.llm.source_mixing import OP5_SQL, op5_source_mixing
from corpusflow.llm.spelling import OP12_SQL, op12_spelling_variants
from corpusflow.llm.topk_search import OP2_SQL, op2_exact_topk
from corpusflow.llm.url_filter import op10_url_filter
from corpusflow.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_topk": op2_exact_topk,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_source_mixing": op5_source_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_simhash": op11_simhash,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE = {
    "op2_exact_topk": OP2_SQL,
    "op5_source_mixing": OP5_SQL,
    "op6_license_scan": OP6_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
