"""What one task can sweep alone is packed in one go: no tables, jobs and plans for each round."""

import numpy as np
import pytest

from test_operators import best_fit
from loomgraph.llm import packing


@pytest.mark.parametrize("alone, low, high, rows", [(200_000, 1, 256, 700), (200_000, 1, 9, 900), (400, 1, 256, 900), (500, 20, 90, 800)])
def test_rounds_of_one_task_are_one_table(spark, monkeypatch, alone, low, high, rows):
    rng = np.random.default_rng(rows)
    lengths = [int(x) for x in rng.integers(low, high + 1, rows)]
    d = spark.createDataFrame([(i // 2, 0, 0, n, i % 5) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    made, write = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, label, *a: made.append(label) or write(df, label, *a))
    monkeypatch.setattr(packing, "ALONE", alone)
    got = packing.place(d, 256).toPandas().sort_values(["sequence_id", "offset"])
    assert made.count("finished") == 1 and (made.count("swept") > 0) == (alone < rows)
    assert sorted(zip(got.doc_id, got.length, got.ids_crc32)) == sorted((i // 2, n, i % 5) for i, n in enumerate(lengths))
    total = got.groupby("sequence_id").length
    assert (got.offset == total.cumsum() - got.length).all() and total.sum().max() <= 256
    assert len(total) <= 1.02 * best_fit(lengths, 256) + 1
