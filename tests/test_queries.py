"""Registered queries against their reference SQL at the smallest scale."""

import os

import pytest
from check_queries import compare, duck

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
# One per family; SPECIMEN_ALL_QUERIES=1 runs every registered query.
CHOSEN = [
    "B7_canonical_species", "B17_view_hint", "C1_clean_manifest", "C5_filter_processed", "D2_fallback_join", "E1_dedupe_by_url",
    "F7_species_ids", "F17_evaluate", "G1_rank_in_group", "G7_partition_by_weight", "H2_grouped_split", "J2_stream_dedupe",
]
NAMES = list(contract.queries()) if os.environ.get("SPECIMEN_ALL_QUERIES") else CHOSEN


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    text, _ = compare(spark, con, SF, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert text.startswith(("ok", "rows-only")) and "[types" not in text, text


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
