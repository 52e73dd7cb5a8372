"""Memory of the run-length index: places are 32-bit numbers and temporaries go as soon as they are used."""

import random
import tracemalloc

import numpy as np

from agrispark.llm.suffix_dedup import RunLengthIndex


def test_index_takes_under_70_bytes_a_byte():
    r = random.Random(5)
    base = [bytes(r.choice(b"abcdefgh ") for _ in range(1000)) for _ in range(40)]
    strings = [r.choice(base)[: r.randint(400, 1000)] + bytes([97 + i % 7]) for i in range(800)]
    size = sum(map(len, strings)) + len(strings)
    tracemalloc.start()
    try:
        index = RunLengthIndex(strings)
        longest = index.matching_statistics()
        assert tracemalloc.get_traced_memory()[1] < 70 * size
    finally:
        tracemalloc.stop()
    # brute force at a few places: the longest match that starts anywhere else
    for k in r.sample(range(len(strings)), 5):
        for at in (0, 17, len(strings[k]) - 3):
            own = strings[k][at:]
            best = 0
            for j, s in enumerate(strings):
                while best < len(own) and (s.find(own[: best + 1], at + 1 if j == k else 0) >= 0 or (j == k and 0 <= s.find(own[: best + 1]) < at)):
                    best += 1
            assert longest[index.start[k] + at] == best
    assert longest.dtype == np.int32
