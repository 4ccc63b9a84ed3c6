from datetime import datetime, timedelta

from pyspark.sql import types as T

from tidemark.schemas import METRICS_SCHEMA

OBS_TS = datetime(2025, 6, 1, 12, 0, 0)


def metrics_rows(stations=(("station_1", 10.0), ("station_2", 5.0)), capacity=20.0, minutes=25 * 60 + 1,
                 end=OBS_TS):
    """The reference fixture: every minute for 25 hours up to and including ``end``."""
    rows = []
    for sid, bikes in stations:
        for k in range(minutes):
            ws = end - timedelta(minutes=minutes - 1) + timedelta(minutes=k)
            rows.append((sid, ws, ws + timedelta(minutes=1), bikes, capacity - bikes, capacity,
                         bikes / capacity if capacity else None, 0, 1, ws + timedelta(seconds=5)))
    return rows


def metrics_df(spark, rows):
    return spark.createDataFrame(rows, METRICS_SCHEMA)


OBS_SCHEMA = T.StructType([T.StructField("station_id", T.StringType()),
                           T.StructField("obs_ts", T.TimestampNTZType())])


def obs_df(spark, rows):
    return spark.createDataFrame(rows, OBS_SCHEMA)
