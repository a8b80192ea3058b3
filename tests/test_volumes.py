"""Bounding volumes over a table with a deepest cell of more points than a tree may have."""

import duckdb
import numpy as np
import pytest
from conftest import same_rows

from voxelake.plans import catalog


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """150 different points in one deepest cell and 70 equal ones in another, so both are dealt into parts."""
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.random((120, 3)), 0.5 + rng.random((150, 3)) / 40, np.full((70, 3), 0.9), [[0, 0, 0], [1, 1, 1]]])
    folder = str(tmp_path_factory.mktemp("crowded"))
    rows = [(i, [*map(float, p), 0.0, 0.0, 1.0], 0) for i, p in enumerate(at)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["bvh_roots", "bvh_one_root", "bvh_one_tree", "bvh_seeded_violations"])
def test_parts_of_a_cell_count_as_one(spark, crowded, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{crowded}/embeddings.parquet/*.parquet'")
    assert catalog.bvh_nodes(spark, crowded).select("part").distinct().count() > 1
    same_rows(catalog.QUERIES[name](spark, crowded), c, catalog.ORACLE[name])
