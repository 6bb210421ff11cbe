"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from .audit import OP12_SQL, op12_filter_audit
from .bpe import op6_bpe_automaton
from .collocations import OP11_SQL, op11_collocations
from .jaccard import OP1_SQL, op1_ngram_jaccard
from .langid import op3_language_id
from .mixing import OP7_SQL, op7_mix_sources
from .mpeg import op5_mpeg_media
from .orcids import op9_orc_token_ids
from .phrases import OP8_SQL, op8_substring_dedup
from .sharding import op2_shard
from .spotsigs import OP4_SQL, op4_spotsigs
from .toolcalls import OP10_SQL, op10_tool_calls
from .warc import OP13_SQL, op13_warc


def queries():
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_shard": op2_shard,
        "op3_language_id": op3_language_id,
        "op4_spotsigs": op4_spotsigs,
        "op5_mpeg_media": op5_mpeg_media,
        "op6_bpe_automaton": op6_bpe_automaton,
        "op7_mix_sources": op7_mix_sources,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_orc_token_ids": op9_orc_token_ids,
        "op10_tool_calls": op10_tool_calls,
        "op11_collocations": op11_collocations,
        "op12_filter_audit": op12_filter_audit,
        "op13_warc": op13_warc,
    }


def oracle_sql():
    return {
        "op1_ngram_jaccard": OP1_SQL,
        "op4_spotsigs": OP4_SQL,
        "op7_mix_sources": OP7_SQL,
        "op8_substring_dedup": OP8_SQL,
        "op10_tool_calls": OP10_SQL,
        "op11_collocations": OP11_SQL,
        "op12_filter_audit": OP12_SQL,
        "op13_warc": OP13_SQL,
    }
