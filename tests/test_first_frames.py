"""Of frames of one time the first in the table counts: by file, then by row."""

import pandas as pd

from pixelquarry.registry import queries


def test_first_frame_of_a_time(spark, tmp_path):
    where = tmp_path / "lineitem.parquet"
    where.mkdir()
    keys = range(50)
    frame = lambda p, n: pd.DataFrame({"l_orderkey": list(keys) * n, "l_linenumber": 1, "l_partkey": 4, "l_discount": p})
    frame(0.01, 1).to_parquet(where / "a.parquet")
    frame(0.09, 400).to_parquet(where / "b.parquet")  # the larger file is read first
    got = queries()["x11_ctc"](spark, str(tmp_path)).collect()
    assert {r["confidence"] for r in got} == {0.01} and len(got) == 50
