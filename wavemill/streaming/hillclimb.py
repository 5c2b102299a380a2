"""Extension: the keep or discard rule on a stream of runs. The batch form is ``experiments.Log``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series string, exp_no long, metric double, label string"


def label_stream(runs: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """series, exp_no, metric, label of each run as it comes; the best of a series so far is its state.

    Runs of one trigger go by exp_no; those of later triggers count as later.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("exp_no")
        labels = []
        for m in rows.metric:
            if pd.isna(m):
                labels.append("crash")
            elif best is None or (m < best if lower_is_better else m > best):
                best = float(m)
                labels.append("keep")
            else:
                labels.append("discard")
        if best is not None:
            state.update((best,))
        yield pd.DataFrame({"series": key[0], "exp_no": rows.exp_no, "metric": rows.metric, "label": labels})

    return runs.groupBy("series").applyInPandasWithState(step, OUT, "best double", "append", GroupStateTimeout.NoTimeout)
