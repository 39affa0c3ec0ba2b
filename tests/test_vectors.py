import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import vectors
from codeloom.operators import vector_search as vs


@pytest.fixture()
def basis(spark):
    rows = [
        ("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0]), ("c", [0.0, 0.0, 1.0, 0.0]),
        ("d", [0.0, 0.0, 0.0, 1.0]), ("e", [0.5, 0.5, 0.0, 0.0]), ("z", [0.0] * 4), ("n", None),
    ]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>")


def test_topk_orders_by_score(basis):
    found = vs.cosine_topk(basis, [1.0, 0, 0, 0], 3).orderBy(F.desc("score"), "chunk_id").collect()
    assert [r.chunk_id for r in found] == ["a", "e", "b"]
    assert found[0].score == pytest.approx(1.0)
    assert found[1].score == pytest.approx(2**-0.5)


def test_topk_edges(basis):
    assert vs.cosine_topk(basis, [0.0] * 4, 3).count() == 0
    assert vs.cosine_topk(basis, [1.0, 0, 0, 0], 100).count() == 6
    assert vs.cosine_topk(basis.where(F.lit(False)), [1.0, 0, 0, 0], 3).count() == 0


def test_column_search_agrees_with_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(f"v{i:03d}", [float(x) for x in rng.standard_normal(8)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(5)
    query = [float(x) for x in rng.standard_normal(8)]
    fast = vs.cosine_topk(frame, query, 10).collect()
    plain = vs.cosine_topk_columns(frame, vectors.literal_vector(query), 10).collect()
    assert {r.chunk_id for r in fast} == {r.chunk_id for r in plain}
    matrix = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    exact = matrix @ query / np.linalg.norm(matrix, axis=1) / np.linalg.norm(query)
    assert max(r.score for r in fast) == pytest.approx(exact.max())


def test_per_group_search_filters_groups(spark):
    rows = [(i, f"s{i % 3}", [float(i + 1), 1.0]) for i in range(30)]
    frame = spark.createDataFrame(rows, "chunk_id int, svc string, embedding array<float>")
    found = vs.cosine_topk_per_group(frame, [1.0, 0.0], 2, "svc", groups=["s0", "s1"]).collect()
    assert sorted((r.svc, r.rank) for r in found) == [("s0", 1), ("s0", 2), ("s1", 1), ("s1", 2)]
    assert {r.chunk_id for r in found if r.rank == 1} == {27, 28}


def test_blob_codec_round_trip(spark):
    frame = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    blob = frame.select(vectors.pack_float32(F.col("v")).alias("b"))
    back = [r[0] for r in blob.select(vectors.unpack_float32(F.col("b"))).collect()]
    assert [None if v is None else list(v) for v in back] == [[1.5, -2.0], None, None]


def test_mixed_dimensions_are_refused(spark):
    frame = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(Exception, match="one dimension"):
        vs.cosine_topk(frame.coalesce(1), [1.0], 1).collect()
