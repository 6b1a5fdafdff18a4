"""Registered queries of the training-data operators and their SQL; each reads whole tables."""

from __future__ import annotations

from tripspark.llm import alignment, chat, gam, html_text, jaccard_join, langid, licences, line_rules, permutation_index, pieces, prefix_trie, raking, simhash
from tripspark.llm.common import table

QUERIES = {
    "op1_quality_gam": lambda spark, d: gam.op1_quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_mixing": lambda spark, d: raking.op2_mixing(table(spark, d, "documents")),
    "op3_line_rules": lambda spark, d: line_rules.op3_line_rules(table(spark, d, "documents")),
    "op4_main_text": lambda spark, d: html_text.op4_main_text(table(spark, d, "pages")),
    "op5_pieces": lambda spark, d: pieces.op5_pieces(table(spark, d, "documents")),
    "op6_licences": lambda spark, d: licences.op6_licences(table(spark, d, "documents")),
    "op7_simhash": lambda spark, d: simhash.op7_simhash(table(spark, d, "documents")),
    "op8_chat_format": lambda spark, d: chat.op8_chat(table(spark, d, "conversations")),
    "op9_nearest": lambda spark, d: permutation_index.op9_nearest(table(spark, d, "embeddings")),
    "op10_language": lambda spark, d: langid.op10_language(table(spark, d, "documents")),
    "op11_jaccard": lambda spark, d: jaccard_join.op11_jaccard(table(spark, d, "documents")),
    "op12_alignment": lambda spark, d: alignment.op12_alignment(table(spark, d, "documents")),
    "op13_prefix_trie": lambda spark, d: prefix_trie.op13_prefix_trie(table(spark, d, "conversations")),
}

ORACLE = {"op3_line_rules": line_rules.SQL, "op6_licences": licences.oracle_sql(), "op8_chat_format": chat.SQL, "op11_jaccard": jaccard_join.SQL, "op13_prefix_trie": prefix_trie.SQL}
