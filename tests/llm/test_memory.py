"""Arrays that operators hold beside their texts, without Spark."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from lurescan.llm import near_dups


def test_shingles_of_a_batch_are_made_in_small_slices():
    rng = np.random.default_rng(5)
    rows = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400).tolist()) for _ in range(1800)]  # over 4 MB
    table = pa.table({"text": rows})
    tracemalloc.start()
    for at, to in near_dups.slices(table, "text"):
        part = table.slice(at, to - at)
        doc, name, weight, _, _ = near_dups.shingles(part, "text", 5)
        near_dups.signatures(doc, name, weight, part.num_rows, 130)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
