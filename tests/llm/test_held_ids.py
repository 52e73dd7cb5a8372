"""Ids are held narrow and compressed between the stages of packing."""

import numpy as np
import pytest

from agrispark.llm import packing


@pytest.mark.parametrize("top", [1, 50_000, 65_535, 65_536, 2**32 - 1])
def test_squeezed_ids_come_back(top):
    ids = np.random.default_rng(top).integers(0, top, 5000, dtype=np.uint32, endpoint=True)
    ids[7] = top
    held = packing.squeezed(ids)
    assert np.array_equal(packing.unsqueezed(held), ids) and packing.unsqueezed(held).dtype == np.dtype("<u4")
    assert len(held) < (2.1 if top < 1 << 16 else 4.1) * len(ids) + 64
    assert not len(packing.unsqueezed(packing.squeezed(ids[:0])))
