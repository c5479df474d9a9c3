"""A worker's freed memory goes back to the system."""

import re
import sys

import pytest

from strataq.llm.common import tidy


def _own_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Private_Dirty:\s+(\d+)", f.read())[1]) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_freed_memory_is_given_back():
    def batches():
        for i in range(2):
            small = [bytes(700) for _ in range(150_000)]  # over the size of Python's own pools
            last = small[-1]  # stands above the freed ones, so that the heap's end stays
            del small
            yield i, last

    kept = []
    before = _own_mb()
    for i, last in batches():
        kept.append(last)
    untidy = _own_mb()
    got = []
    for i, last in tidy(batches()):
        got.append(i)
        kept.append(last)
    assert got == [0, 1]
    assert untidy - before > 50, (before, untidy)
    assert _own_mb() - before < 20, (before, untidy, _own_mb())
