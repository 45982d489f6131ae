"""What a run stages goes when its scratch ends."""

import os

from docloom.llm import entries
from docloom.llm._storage import scratch, shared_dir

SF = "/root/testdata/sf0.001"


def test_nothing_is_left(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scratch(spark):
        for name in ("op11_substring_dedup", "op12_hard_negatives", "op8_token_store"):
            assert entries.queries()[name](spark, SF).count() > 0
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before
