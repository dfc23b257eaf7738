"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from galaxis.llm import bpe, line_dedup, mixing, ngram_join, preference, quality, token_files, topk_search, url_filter, warc

QUERIES = {
    "op1_preference": preference.op1_preference,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_warc": warc.op5_warc,
    "op6_topk_search": topk_search.op6_topk_search,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_bpe": bpe.op8_bpe,
    "op9_token_files": token_files.op9_token_files,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op1_preference": preference.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_topk_search": topk_search.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
