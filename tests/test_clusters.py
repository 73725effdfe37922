"""Clusters for every number from 3 to 12."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_every_number_of_clusters(spark):
    rows = entry.queries()["d22_vector_clusters"](spark, SF).collect()
    assert sorted(r.k for r in rows) == list(range(3, 13)) and all(r.silhouette is not None for r in rows)
