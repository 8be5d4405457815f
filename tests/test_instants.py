from datetime import datetime, timezone

import pytest

from quillgraph.operators.instants import READING, dictionary, normalise, parse_instant, stored


def at(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "zone", "day_first", "wanted"),
    [
        ("2024-01-02 03:04:05", "Asia/Shanghai", False, at(2024, 1, 1, 19, 4, 5)),
        ("2024-01-02T03:04:05Z", "Asia/Shanghai", False, at(2024, 1, 2, 3, 4, 5)),
        ("2023-02-03T10:49:59+08:00[Asia/Shanghai]", "UTC", False, at(2023, 2, 3, 2, 49, 59)),
        ("20230202T041304Z", None, False, at(2023, 2, 2, 4, 13, 4)),
        ("02/03/2024 10:00", "UTC", True, at(2024, 3, 2, 10)),
        ("02/03/2024 10:00", "UTC", False, at(2024, 2, 3, 10)),
        ("4/2/2025 12:17:46 AM", "UTC", False, at(2025, 4, 2, 0, 17, 46)),
        ("2023年4月10日上午12:40", "UTC", False, at(2023, 4, 10, 0, 40)),
        ("2023年4月10日下午12:40", "UTC", False, at(2023, 4, 10, 12, 40)),
        ("31 mai 2023 20h49", "Europe/Paris", True, at(2023, 5, 31, 18, 49)),
        ("Fri, 17 Feb 2023 15:47:05 +0800", "UTC", False, at(2023, 2, 17, 7, 47, 5)),
        ("2024-02-01 00:00:00 CST", "Asia/Shanghai", False, at(2024, 1, 31, 16)),
        ("2024-02-01 00:00:00 CST", "America/Chicago", False, at(2024, 2, 1, 6)),
        ("2024-07-01 00:00:00 IST", "Asia/Kolkata", False, at(2024, 6, 30, 18, 30)),
        ("2024-02-01 00:00:00 GMT+5:45", "UTC", False, at(2024, 1, 31, 18, 15)),
        ("2024-10-27 02:30:00", "Europe/Berlin", True, at(2024, 10, 27, 0, 30)),
        ("2024-03-31 02:30:00", "Europe/Berlin", True, at(2024, 3, 31, 1, 30)),
        ("1700000000", None, None, 1_700_000_000_000_000),
        ("1700000000123", None, None, 1_700_000_000_123_000),
        ("1700000000123456", None, None, 1_700_000_000_123_456),
        ("1700000000.50", None, None, 1_700_000_000_500_000),
        ("2024-05-06", "Asia/Tokyo", False, at(2024, 5, 5, 15)),
        ("  2023-02-01 09:49:40\t", "nowhere/at all", False, at(2023, 2, 1, 9, 49, 40)),
        *[(x, "UTC", False, None) for x in (None, "", "-", "yesterday", "待定", "2025-02-30 08:15:00", "2024-05-17 27:61:00", "25/25/2025 10:00", "0000-00-00 00:00:00", "12")],
    ],
)
def test_forms(text, zone, day_first, wanted):
    assert parse_instant(text, zone, day_first) == wanted


def test_rows_keep_their_number_and_store_grows(spark, tmp_path):
    writers = spark.createDataFrame([(1, "UTC", False), (2, "Asia/Tokyo", True)], "writer_id int, tz_name string, day_first boolean")
    rows = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 2, "2024-01-01"), (3, None, "2024-01-01"), (4, 1, None), (5, 9, "n/a"), (6, 1, "2024-01-01")], "id int, writer_id int, raw_time string")
    store = f"file://{tmp_path}/store"
    out = {r.id: r.utc_micros for r in normalise(rows, writers, store).collect()}
    assert out == {1: at(2024, 1, 1), 2: at(2023, 12, 31, 15), 3: at(2024, 1, 1), 4: None, 5: None, 6: at(2024, 1, 1)}
    assert stored(spark, store).count() == 4
    folder = f"{store}/reading-{READING}"
    again = spark.createDataFrame(spark.read.parquet(folder).collect(), spark.read.parquet(folder).schema)
    again.write.mode("append").parquet(folder)  # a writer that appended the same once more
    assert normalise(rows, writers, store).count() == 6 and stored(spark, store).count() == 4
    assert spark.read.parquet(folder).count() == 8
    assert dictionary(rows.limit(0).selectExpr("raw_time text", "'' tz_name", "false day_first")).count() == 0
