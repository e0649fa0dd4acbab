import random

import pytest
from pyspark.sql import functions as F

from volquery.functions.scalars import decoder_weights, saturate
from volquery.operators import ordered, telemetry
from volquery.streaming.completeness import PREDICTION_SCHEMA, read_predictions, run_to_end, sample_stream, stitch_when_complete


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], "series string, ts int, value double")


@pytest.mark.parametrize("window, expected", [(1, [1, 2, 6, 8]), (2, [1.5, 3, 16 / 3, 7]), (3, [1.5, 3, 16 / 3, 7]), (4, [3, 4.25, 4.25, 16 / 3])])
def test_rolling_mean(spark, window, expected):
    got = [r.smooth for r in telemetry.rolling_mean(series(spark, [1.0, 2.0, 6.0, 8.0]), window).orderBy("ts").collect()]
    assert got == pytest.approx(expected)


def test_io_rate_keeps_its_reference(spark):
    mib = 1024.0 * 1024.0
    rows = [("n", 0.0, 0.0), ("n", 1.0, mib), ("n", 2.0, None), ("n", 3.0, 4 * mib), ("n", 4.0, mib), ("n", 4.0, 3 * mib)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "series string, t double, value double, i int")
    rates = [r.mib_s for r in telemetry.io_rate(frame, order=("i",)).orderBy("i").collect()]
    assert rates == [0.0, 1.0, 0.0, 3.0, 0.0, 0.0]
    held = [r.mib_s for r in telemetry.io_rate(frame, order=("i",), interval=0.5).orderBy("i").collect()]
    assert held[-1] == 4.0


def test_small_telemetry(spark):
    samples = series(spark, [5.0, 3.0, 9.0]).unionByName(series(spark, [1.0], "b"))
    assert {r.series: (r["mean"], r.peak) for r in telemetry.series_mean(samples).collect()} == {"a": (17 / 3, 9.0), "b": (1.0, 1.0)}
    assert [r.ts for r in telemetry.keep_last(samples, 2).where("series = 'a'").orderBy("ts").collect()] == [1, 2]
    assert telemetry.keep_last(samples, None).count() == telemetry.keep_last(samples, -1).count() == 4
    assert [r.value for r in telemetry.first_sample_zero(samples).where("series = 'a'").orderBy("ts").collect()] == [0.0, 3.0, 9.0]
    pivot = telemetry.series_pivot(samples, at="ts").where("series = 'a'").first()
    assert pivot["times"] == [0, 1, 2] and pivot["values"] == [5.0, 3.0, 9.0]
    assert telemetry.series_mean(samples.limit(0)).count() == 0
    assert samples.select(telemetry.cpu_per_core(F.lit(400.0), 8)).first()[0] == 50.0


def long_series(spark, n=400):
    rng = random.Random(3)
    rows = [("hot", i, None if rng.random() < 0.3 else float(rng.randint(0, 50) * 2**20), i / 4 if i % 9 else (i - 1) / 4) for i in range(n)]
    rows += [(None, i, float(i), float(i)) for i in range(7)] + [("one", 5, 3.0, 1.0), ("gaps", 1, None, 0.0), ("gaps", 900, None, 1.0), ("gaps", 901, 2.0**20, 2.0), ("gaps", 1000, 3 * 2.0**20, 3.0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "series string, i int, value double, t double"), rows


@pytest.mark.parametrize("parts", [5, 64])
@pytest.mark.parametrize("window", [2, 40])
def test_one_series_over_many_ranges(spark, monkeypatch, parts, window):
    """Ranges of fewer rows than the window reaches, and a series that nearly fills the table."""
    monkeypatch.setattr(telemetry, "ranged", lambda s, by, order: ordered.ranged(s, by, order, parts))
    monkeypatch.setattr(telemetry, "RING_ROWS", 10)
    frame, rows = long_series(spark)
    by = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append(r)
    smooth, rate, kept = {}, {}, set()
    for name, mine in by.items():
        known, then = None, None
        for at, (_, i, v, t) in enumerate(mine):
            near = [x[2] for x in mine[max(0, at - window // 2) : at + window // 2 + 1] if x[2] is not None]
            smooth[name, i] = sum(near) / len(near) if near else None
            ok = v is not None and known is not None and then is not None and t > then
            rate[name, i] = max(0.0, (v - known) / 2**20 / (t - then)) if ok else 0.0
            known, then = v if v is not None else known, t
        kept |= {(name, r[1]) for r in mine[-50:]}
    got = {(r.series, r.i): r.smooth for r in telemetry.rolling_mean(frame, window, order=("i",)).collect()}
    assert got.keys() == smooth.keys() and all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in smooth.items())
    assert {(r.series, r.i): pytest.approx(r.mib_s) for r in telemetry.io_rate(frame, order=("i",)).collect()} == rate
    assert {(r.series, r.i) for r in telemetry.keep_last(frame, 50, order=("i",)).collect()} == kept
    placed = ordered.numbered(ordered.ranged(frame, ["series"], ["i"], parts), ["series"], ["i"], "n").collect()
    assert {(r.series, r.i): r.n for r in placed} == {(n, r[1]): at for n, mine in by.items() for at, r in enumerate(mine)}
    if parts == 64:
        assert len({r._part for r in placed if r.series == "hot"}) > 40


@pytest.mark.parametrize("memory, kept", [([5, 7, 0, 0, 0, 0, 0], 3), ([0] * 7, 7), ([0, 0, 0, 0, 0, 3, 0], 6)])
def test_idle_truncate(spark, memory, kept):
    rows = [(g, i, float(m)) for g in (0, 1) for i, m in enumerate(memory) if not (g == 1 and i == 6 and memory[5])]
    frame = spark.createDataFrame(rows, "gpu int, ts int, memory_mib double")
    assert telemetry.idle_truncate(frame).where("gpu = 0").count() == kept


def test_saturation(spark):
    values = [-5.5, 3.99, 254.9, 300.0, float("nan"), 3e9, -0.5, 1e30]
    frame = spark.createDataFrame([(v,) for v in values], "v double")

    def cast(kind):
        return [r[0] for r in frame.select(saturate(F.col("v"), kind)).collect()]

    assert cast("uint8") == [0, 3, 254, 255, 0, 255, 0, 255]
    assert cast("int32")[5] == 2147483647 and cast("uint32")[5] == 3000000000 and cast("int16")[0] == -5
    assert int(cast("uint64")[7]) == 2**64 - 1 and cast("int64")[7] == 2**63 - 1


def test_decoder_weights(spark):
    frame = spark.sql("SELECT map('model.decoder.a', 1, 'decoder.b', 2, 'x', 3) AS m UNION ALL SELECT map('decoder.b', 2, 'x', 3)")
    assert [r[0] for r in frame.select(decoder_weights(F.col("m"))).collect()] == [{"a": 1}, {"b": 2}]


def test_blocks_leave_when_complete(spark, tmp_path):
    rng = random.Random(1)
    rows = [(b, p, 4, [0, 1, 2], [float(b * 100 + p), float(p), 1.0]) for b in range(12) for p in range(1, 5)]
    rows = [r for r in rows if not (r[0] == 7 and r[1] == 2)] + [rows[0]]  # one block never completes, one patch comes twice
    rng.shuffle(rows)
    for i in range(0, len(rows), 13):
        spark.createDataFrame(rows[i : i + 13], PREDICTION_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_predictions(spark, str(tmp_path / "in"))
    run_to_end(stitch_when_complete(stream), str(tmp_path / "state"), str(tmp_path / "out"))
    got = sorted((r.block, r.cell, r.value, r.patches) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((b, c, v, 4) for b in range(12) if b != 7 for c, v in enumerate([b * 100 + 4.0, 4.0, 1.0]))



def test_sample_clock(spark, tmp_path):
    query = sample_stream(spark, 50).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o")).trigger(processingTime="200 milliseconds").start()
    try:
        query.awaitTermination(4)
    finally:
        query.stop()
    rows = spark.read.schema("ts timestamp, n long").parquet(str(tmp_path / "o")).collect()
    assert sorted(r.n for r in rows) == list(range(len(rows))) and len(rows) > 10
