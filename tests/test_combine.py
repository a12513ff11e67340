import numpy as np
import pytest

from uttermill.plans.combine import array_sum


@pytest.mark.parametrize("fan", [2, 3, 32])
@pytest.mark.parametrize("parts", [1, 7, 20])
def test_array_sum_adds_up_every_batch(spark, parts, fan):
    rows = spark.range(1_000).repartition(parts)
    got = array_sum(rows, lambda b: np.array([b.num_rows, b.column("id").to_numpy().sum()], float), 2, fan)
    assert got.tolist() == [1_000, 999 * 500]


def test_array_sum_of_nothing(spark):
    assert array_sum(spark.range(0), lambda b: np.ones(3), 3).tolist() == [0, 0, 0]
