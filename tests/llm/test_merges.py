"""Segments cut together, many at once, have the ids that each has through the heap."""

import random

import numpy as np

from kerbgrid.llm.pieces import LONG, MARK, Encoder, vocabulary


def test_many_segments_equal_each_one_through_the_heap():
    draw, encoder = random.Random(7), Encoder(vocabulary())
    segments = [MARK + "".join(draw.choices("aehnrst.é一\x01", k=draw.randrange(LONG))) for _ in range(400)]
    keys = np.arange(len(segments), dtype=np.uint64)
    assert encoder.cut_many(segments, keys) == [encoder.cut_long(s, k) for s, k in zip(segments, keys)]
