"""Plans over a bucketed table of bars have no shuffle."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from barloom.operators import rolling
from barloom.plans.registry import add_indicators
from barloom.schema import BARS, KEY
from barloom.sources import bucketed


def test_windows_and_joins_without_a_shuffle(spark, tmp_path):
    rows = [(s, "s", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h * (24 if i == "1d" else 1)), 1.0, 9.0, 0.5, float(h + 2), h) for s in "ABCDEFGHIJ" for i in ("1h", "1d") for h in range(40)]
    bars = spark.createDataFrame(rows, BARS)
    name = f"bars_{uuid.uuid4().hex}"
    bucketed.write_bucketed(bars, name, 4, path=str(tmp_path / "t"))
    stored = bucketed.read_bucketed(spark, name)
    try:
        columns = ["sma_10", "bb_upper", "swing_high_20", "rvol", "vwap"]
        with_columns = add_indicators(stored, columns)
        assert bucketed.shuffles(with_columns) == 0 and bucketed.shuffles(add_indicators(bars, columns)) > 0
        assert bucketed.shuffles(add_indicators(stored, ["ema_12", "atr"])) == 0  # a grouped pass by series too
        key = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert key(with_columns) == key(add_indicators(bars, columns))
        last = stored.groupBy(*KEY).agg(F.max_by("close", "ts").alias("last"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert bucketed.shuffles(stored.join(last, list(KEY)).withColumn("sma", rolling.sma(5))) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
