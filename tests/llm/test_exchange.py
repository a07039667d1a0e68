"""Totals beyond 32 bits."""

import numpy as np
import pyarrow as pa
import pyarrow.compute

from ledgerlens.llm import exchange


def test_totals_beyond_32_bits():
    listed = np.array([5, 9, 1 << 60], np.uint64)
    counts = [np.array([3_000_000_000, 1, 1 << 31], np.int64), np.array([3_000_000_000, 2, 1 << 31], np.int64)]
    asked = pa.concat_tables([exchange.messages(b, listed, c, 1) for b, c in enumerate(counts)])
    for b in (0, 1):
        answered = exchange.answer(None, asked)
        got = exchange.totals(answered.filter(pa.compute.equal(answered["batch"], b)))
        assert got.tolist() == [6_000_000_000, 3, 1 << 32]
