"""The candle source: chunks as partitions, conditions that prune them, and how an archive is read."""

import datetime as dt
from pathlib import Path

from barloom.sources import candles

HOUR = 3_600_000
START = 1_704_067_200_000  # 2024-01-01


def archive(tmp_path, chunks):
    for symbol, first, hours, lines in chunks:
        place = tmp_path / f"symbol={symbol}/interval=1h/chunk={START + first * HOUR}_{START + (first + hours) * HOUR}"
        place.mkdir(parents=True, exist_ok=True)
        (place / "a.json").write_text("\n".join(lines))
    return str(tmp_path)


def candle(hour, price=1.5, **more):
    fields = {"t": START + hour * HOUR, "o": f'"{price}"', "h": f'"{price + 1}"', "l": '"1.0"', "c": '"1.25"', "v": '"10.9"'} | more
    return "{" + ", ".join(f'"{k}": {v}' for k, v in fields.items()) + "}"


def test_reads_and_prunes(spark, tmp_path):
    folder = archive(tmp_path, [
        ("btc", 0, 10, [candle(h) for h in range(10)]), ("btc", 10, 10, [candle(h) for h in range(10, 20)]), ("btc", 30, 10, [candle(h) for h in range(30, 40)]),
        ("dex%3AETH", 0, 10, [candle(3), "", "not json", candle(4, c="null"), candle(5, v="null"), candle(6, o='"x"'), candle(7, l="[1]"), "[]", candle(99)]),
    ])
    (tmp_path / "_SUCCESS").write_text("")
    all_ = candles.read_archive(spark, folder, source="x")
    rows = all_.collect()
    assert len(rows) == 32 and all_.rdd.getNumPartitions() == 4 and {r.source for r in rows} == {"x"}
    eth = sorted((r.ts, r.volume) for r in rows if r.symbol == "DEX:ETH")
    assert eth == [(dt.datetime(2024, 1, 1, 3), 10), (dt.datetime(2024, 1, 1, 5), None)]
    late = all_.where("symbol = 'BTC' AND ts >= timestamp_ntz '2024-01-01 15:00:00' AND ts < timestamp_ntz '2024-01-02 08:00:00'")
    assert late.count() == 7 and late.rdd.getNumPartitions() == 2
    assert all_.where("symbol IN ('BTC', 'NONE')").rdd.getNumPartitions() == 3
    assert all_.where("source = 'y'").count() == 0 and all_.where("interval = '1d'").count() == 0
    at = all_.where("ts = timestamp_ntz '2024-01-02 07:00:00'")
    assert at.count() == 1 and at.rdd.getNumPartitions() == 1
    assert all_.where("symbol LIKE 'B%' AND close > 1").count() == 30  # what isn't pushed is looked at by Spark


def test_history_stops_at_the_first_gap(spark, tmp_path):
    folder = archive(tmp_path, [(s, first, 10, [candle(h) for h in range(first, first + 10)]) for s, first in (("a", 0), ("a", 20), ("a", 30), ("a", 40), ("b", 0))])
    count = lambda **o: {r.symbol: r["count"] for r in candles.read_archive(spark, folder, **o).groupBy("symbol").count().collect()}
    assert count() == {"A": 40, "B": 10}
    assert count(history="true") == {"A": 30, "B": 10}
    assert count(history="true", chunks="2") == {"A": 20, "B": 10}
    assert count(start="2024-01-01 05:00:00", end="2024-01-01 22:00:00") == {"A": 7, "B": 5}


def test_archive_round_trip(spark, tmp_path):
    rows = [("A:B", "s", "1h", dt.datetime(2024, 1, 1, h % 24) + dt.timedelta(days=h // 24), 1.0 + h, 2.0 + h, 0.5, 1.5, h) for h in range(50)] + [("Z", "s", "1d", dt.datetime(2024, 1, 5), 1.0, 2.0, 0.5, 1.5, None)]
    bars = spark.createDataFrame(rows, candles.BARS)
    folder = str(tmp_path / "out")
    candles.write_archive(bars, folder, 24)
    assert len(candles.listed(folder)) == 4 and all(len(c.files) == 1 for c in candles.listed(folder))
    assert sorted(map(tuple, candles.read_archive(spark, folder, source="s").collect())) == sorted(rows)
    assert len(list(Path(folder).glob("symbol=A%3AB/*/*"))) == 3
