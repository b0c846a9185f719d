"""Joins that reconcile records: the instants of local times."""

from datetime import datetime

from feedlab.operators import joins


def test_local_times_at_clock_changes(spark):
    cases = [
        (datetime(1996, 10, 27, 0, 59, 59), datetime(1996, 10, 27, 4, 59, 59)), (datetime(1996, 10, 27, 1), datetime(1996, 10, 27, 6)), (datetime(1996, 10, 27, 1, 30), datetime(1996, 10, 27, 6, 30)), (datetime(1996, 10, 27, 2), datetime(1996, 10, 27, 7)),
        (datetime(1996, 4, 7, 1, 59), datetime(1996, 4, 7, 6, 59)), (datetime(1996, 4, 7, 2, 30), datetime(1996, 4, 7, 7, 30)), (datetime(1996, 4, 7, 3), datetime(1996, 4, 7, 7)), (None, None),
    ]
    df = spark.createDataFrame([(i, at, datetime(1996, 1, 1)) for i, (at, _) in enumerate(cases)], "i int, local timestamp_ntz, utc timestamp_ntz").selectExpr("i", "CAST(local AS TIMESTAMP) AS local", "CAST(utc AS TIMESTAMP) AS utc")
    got = {r.i: r.delta_s for r in joins.start_time_delta(df, "local", "America/New_York", "utc").collect()}
    assert got == {i: None if at is None else int((at - datetime(1996, 1, 1)).total_seconds()) for i, (_, at) in enumerate(cases)}
