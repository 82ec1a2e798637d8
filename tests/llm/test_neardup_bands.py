"""Bands of near-duplicates: texts with repeats meet by their sets too."""

import numpy as np

from leafmill.llm import neardup


def test_texts_with_repeats_meet_by_their_sets():
    elements = np.arange(1, 401, dtype=np.uint64)
    more = np.arange(1, 493, dtype=np.uint64)
    once, often = np.ones(400, int), np.where(np.arange(492) < 400, 1, 50)
    one, two = neardup.bands_of(elements, once), neardup.bands_of(more, often)
    assert len(one) == neardup.BANDS and neardup.BANDS < len(two) <= 2 * neardup.BANDS
    plain = neardup.band_keys(neardup.prob_min_hash(more, np.ones(492)))
    weighted = neardup.band_keys(neardup.prob_min_hash(more, 1 + np.log(often)))
    assert set(two) == set(plain) | set(weighted) and np.intersect1d(one, two).size
