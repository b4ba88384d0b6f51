"""Queries against their SQL. CHECK_ALL=1 runs every query, else one per family."""

import os

import pytest
from check import compare

import __spark_entry__ as entry

FAMILIES = [
    "samples_from_vectors", "split_samples", "split_ratio_kept", "filter_classes", "encode_all", "pack_words",
    "explode_bits", "split_groups", "w0_matrix", "w0_seed_modes", "majority_exact", "majority_exact_inline",
    "majority_rowwise", "majority_pixel", "majority_tree3", "majority_tree7", "majority_tree3_pixel_near",
    "grid_rot22", "grid_shuffle", "grid_spiral", "grid_chain", "color_points", "stencil_bin", "stencil_var",
    "hit_counts", "target_init_laplace", "log_odds", "class_offset", "score_samples", "argmax_nonzero",
    "votes_normalised", "prototypes", "correct_pass", "infer", "filter_combined", "filter_eval_pct", "spec_parse",
    "spec_lookup", "alias_xforms", "alias_encodings", "plan_sweep", "unused_seeds", "check_dims", "check_summary",
    "manifest_diff", "member_list_in", "pairs", "q_specialists", "class_recall", "en_curve", "agreement",
    "beam_level", "beam_cut", "swap_pass", "scan_scores_pruned", "member_ids",
]
SQL = entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("CHECK_ALL") else FAMILIES


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert compare(entry.queries()[name](spark, sf_dir), duck, SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())
