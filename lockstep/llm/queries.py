"""The operators' queries over the given tables, and their SQL where SQL can say it."""

from lockstep.llm import (
    decontamination,
    extraction,
    fingerprints,
    language,
    mixing,
    near_duplicates,
    quality,
    sharding,
    spelling,
    substrings,
    suffix_tree_lm,
    suffixes,
    token_alignment,
)


def all_queries() -> dict:
    return {
        "op1_language": language.op1_language,
        "op2_suffix_tree_lm": suffix_tree_lm.op2_suffix_tree_lm,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_html": extraction.op4_html,
        "op5_sharding": sharding.op5_sharding,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_suffix_dedup": suffixes.op7_suffix_dedup,
        "op8_near_duplicates": near_duplicates.op8_near_duplicates,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality": quality.op10_quality,
        "op11_spelling": spelling.op11_spelling,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_fingerprints": fingerprints.op13_fingerprints,
    }


def all_oracles() -> dict[str, str]:
    return {"op5_sharding": sharding.ORACLE, "op9_mixing": mixing.ORACLE}
