"""Microstates beside their SQL where epochs lack channels, samples or whole vectors."""

import pyarrow.parquet as pq
import pytest
from oracle import differences, duck

from traceloom import catalog

ODD = [
    (0, 64, 1.0), (1, 64, -0.4), (2, 64, 0.3), (3, 64, 0.2),  # whole
    (4, 64, 0.9), (5, 64, 0.1),  # two channels only
    (8, 64, 0.5), (8, 64, -0.7), (9, 64, 0.6), (10, 64, 0.1), (11, 64, 0.8),  # a channel twice
    (12, 64, 0.5), (13, 40, 0.5), (14, 64, 0.3), (15, 70, 0.2),  # short and long
    (16, None, 0.0), (17, 64, 0.5), (18, 64, 0.3), (19, 64, 0.2),  # no vector
    (-9, 64, 0.4), (None, 64, 0.4), (22, 64, 0.4),
]


def vectors(rows, hole=None):
    wave = lambda n, a, k: [None if hole and i % hole == 7 else a * ((i * (k + 3) * 37 % 101) / 50.0 - 1.0) for i in range(n)]
    return [(k, None if n is None else wave(n, a, k or 0), 0) for k, n, a in rows]


@pytest.mark.parametrize("hole", [None, 9])
@pytest.mark.parametrize("name", ["microstate_summary", "microstate_transitions"])
def test_incomplete_epochs_are_those_of_the_sql(spark, tmp_path, name, hole):
    made = spark.createDataFrame(vectors(ODD, hole), "vec_id bigint, embedding array<float>, label int")
    pq.write_table(made.toArrow(), tmp_path / "embeddings.parquet")
    assert differences(catalog.queries()[name](spark, str(tmp_path)), duck(str(tmp_path)), catalog.oracle_sql()[name]) is None
