from pyspark.ml.linalg import Vectors

from gridsmith.operators.stages import set_places


def test_places_of_wide_vectors_cost_their_entries_only(spark):
    """Written out in full, one of these rows would hold a thousand million numbers."""
    wide = 1_000_000_000
    rows = [(k, Vectors.sparse(wide, [0, 3, wide - 1 - k], [2.5, 0.0, 1.0])) for k in range(50)]
    rows += [(50, Vectors.dense([0.0, 4.0, 0.0, -1.0])), (51, Vectors.sparse(wide, [], [])), (52, None)]
    found = set_places(spark.createDataFrame(rows, ["k", "v"]), "k", "v")
    expected = [x for k in range(50) for x in ((k, 0, 2.5), (k, wide - 1 - k, 1.0))] + [(50, 1, 4.0), (50, 3, -1.0)]
    assert found.columns == ["k", "place", "value"] and dict(found.dtypes)["place"] == "int"
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
