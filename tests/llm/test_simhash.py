"""Limits of the fingerprint search."""

import pytest

from ramplake.llm import simhash


def test_links_beyond_two_bits_are_an_error(spark):
    with pytest.raises(ValueError, match="not 3"):
        simhash.near_links(spark.createDataFrame([(0,), (7,)], "fp long"), distance=3)
