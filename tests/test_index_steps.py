"""What a task of the index search holds does not grow with the questions or the lists."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from causeway.operators import vector_index


def test_rows_of_questions_and_lists_stay_within_bounds():
    for questions, lists, dim in ((10_000, 784, 64), (10_000, 4096, 64), (3, 4096, 4096), (0, 16, 8), (100, 1, 8)):
        quantiser = SimpleNamespace(centroids=np.zeros((lists, dim)))
        batch = pd.DataFrame({"query_id": [str(i) for i in range(questions)]})
        steps = list(vector_index._steps(iter([batch, batch]), quantiser))
        assert [i for s in steps for i in s["query_id"]] == [*batch["query_id"], *batch["query_id"]]
        assert all(len(s) == 1 or len(s) * lists * dim * 8 <= vector_index._PAIR_BYTES for s in steps)
