"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import bayes_join, exact_dedup, importance, licences, packing, piecevocab, quality, repeats, sanitise, token_count

QUERIES = {
    "op1_licence_scan": licences.op1_licence_scan,
    "op2_ngram_join": bayes_join.op2_ngram_join,
    "op3_sentencepiece": piecevocab.op3_sentencepiece,
    "op4_repeated_strings": repeats.op4_repeated_strings,
    "op5_quality_resampling": importance.op5_quality_resampling,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_token_counts": token_count.op7_token_counts,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_personal_data": sanitise.op10_personal_data,
}

#: Token ids, transducers, suffix structures, MinHash and trained models have no SQL form.
ORACLE_SQL = {
    "op8_quality_rules": quality.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_personal_data": sanitise.OP10_SQL,
}
