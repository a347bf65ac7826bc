"""Query ids that occur in several rows."""

import numpy as np

from cartolith.llm import ann


def test_a_repeated_query_has_all_its_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    vectors = spark.createDataFrame([*rows, *[rows[20]] * 9, (40, [9.0] * 6)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(vectors).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for i in (20, 40):
        x = min(v for v in [rows[i][1], *([[9.0] * 6] if i == 40 else [])])
        all_rows = [*rows, *[rows[20]] * 9, (40, [9.0] * 6)]
        best = sorted((-float(np.dot(v, x)), j) for j, v in all_rows if j != i)[:20]
        assert [got[i][k] for k in range(1, 21)] == [j for _, j in best]
