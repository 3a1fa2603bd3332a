"""The training-data queries and their SQL, by name."""

from quarry.llm import alignment, exact_dedup, multiset, packing, quality, resampling, sharding, simhash, sniffing, suffixes, superkmers, toxicity, unigram


def queries() -> dict:
    return {
        "op1_kdtree_shards": sharding.op1_kdtree_shards,
        "op2_simhash": simhash.op2_simhash,
        "op3_weak_labels": quality.op3_weak_labels,
        "op4_superkmers": superkmers.op4_superkmers,
        "op5_unigram": unigram.op5_unigram,
        "op6_signatures": sniffing.op6_signatures,
        "op7_ftrl": toxicity.op7_ftrl,
        "op8_content_sort": exact_dedup.op8_content_sort,
        "op9_bin_slack": packing.op9_bin_slack,
        "op10_suffix_array": suffixes.op10_suffix_array,
        "op11_multiset": multiset.op11_multiset,
        "op12_groups": alignment.op12_groups,
        "op13_importance": resampling.op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_superkmers": superkmers.OP4_SQL,
        "op8_content_sort": exact_dedup.OP8_SQL,
        "op10_suffix_array": superkmers.OP4_SQL,
        "op13_importance": resampling.OP13_SQL,
    }
