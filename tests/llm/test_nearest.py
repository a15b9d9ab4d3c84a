"""The exact check of the nearest search, on vectors for which centres and codes fitted on the table serve badly."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from repograph.llm import anisotropic


@pytest.mark.parametrize("kind", ["three dimensions", "queries unlike the rows"])
def test_no_neighbour_is_missed(spark, tmp_path, kind):
    rng, n = np.random.default_rng(4), 6000
    ids = np.arange(n)
    x = rng.normal(size=(n, 3))
    if kind == "queries unlike the rows":
        x = rng.normal(size=(20, 16))[rng.integers(0, 20, n)] + 0.1 * rng.normal(size=(n, 16))
        x[ids % 100 == 0] = rng.normal(size=(60, 16))
    x[7:9] = x[700]
    x = x.astype(np.float32)
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = {}
    for r in anisotropic.op10_nearest(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    exact = x.astype(np.float64)
    for q in range(0, n, 100):
        distance = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        assert got[q] == ids[np.lexsort((ids, distance))[:10]].tolist()
