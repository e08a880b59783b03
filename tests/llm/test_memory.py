import gc
import re
import sys

import pytest

from trolley.llm.common import given_back


def held() -> int:
    """Bytes of anonymous memory of this process."""
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) << 10


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_free_memory_goes_back_when_a_task_ends():
    last = []

    def rows():
        parts = [b"x" * 60_000 + bytes([k % 256]) for k in range(3000)]
        last.append(bytes(60_000))  # above the others: they stay in the heap when they are freed
        yield len(parts)

    gc.collect()
    before = held()
    assert list(given_back(rows())) == [3000]
    assert held() - before < 60 << 20  # of 180 MB


def test_what_stops_early_is_closed():
    closed = []

    def rows():
        try:
            yield 1
            yield 2
        finally:
            closed.append(True)

    made = given_back(rows())
    assert next(made) == 1
    made.close()
    assert closed
    with pytest.raises(ValueError):
        list(given_back(int(x) for x in ["a"]))
