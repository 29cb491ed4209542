"""Readers of market files. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, symbol_stem
from ..operators.bars import keep_last

BARS = "symbol STRING, ts_ms BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, taker_buy_volume DOUBLE"
KLINE_FILE = "timestamp BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, taker_buy_volume DOUBLE"
FUNDING_FILE = "timestamp BIGINT, funding_rate DOUBLE"
KLINE_CSV = "open_time, open, high, low, close, volume, close_time, quote_volume, count, taker_buy_volume, taker_buy_quote_volume, ignore"
#: Base assets that a venue names otherwise.
BASE_ALIASES = {"XBT": "BTC", "XDG": "DOGE"}


def stem_of(path: Column, suffix: str) -> Column:
    """The symbol before the suffix, in a file's name or in that of the folder that Spark writes for one."""
    return F.regexp_extract(path, r"([^/=]+)" + suffix + r"(?:\.[^/]*)?(?:/[^/]*)?$", 1)


def _files(spark: SparkSession, path: str, schema: str, suffix: str) -> DataFrame:
    rows = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("seq"))
    return rows.withColumn("symbol", stem_of(F.col("file"), suffix))


def read_klines(spark: SparkSession, path: str, suffix: str = "_1m", drop_untraded: bool = True) -> DataFrame:
    """Bars of all files under a glob, a symbol for each file name; the last row of a timestamp holds.

    Duplicates go before untraded rows do: a repeated minute counts as its last version says.
    """
    rows = _files(spark, path, KLINE_FILE, suffix).withColumnRenamed("timestamp", "ts_ms")
    rows = keep_last(rows, ["symbol", "ts_ms"], "seq")
    if drop_untraded:
        rows = rows.where(F.col("volume") > 0)
    return rows.select(*[c.split()[0] for c in BARS.split(", ")])


def read_funding(spark: SparkSession, path: str, suffix: str = "_funding") -> DataFrame:
    rows = _files(spark, path, FUNDING_FILE, suffix).withColumnRenamed("timestamp", "ts_ms")
    return keep_last(rows, ["symbol", "ts_ms"], "seq").select("symbol", "ts_ms", "funding_rate")


def read_daily_universe(spark: SparkSession, path: str) -> DataFrame:
    """Daily files `<symbol>_1d`: (symbol, ts_ms, close, quote_volume, high)."""
    rows = _files(spark, path, "timestamp BIGINT, close DOUBLE, quote_volume DOUBLE, high DOUBLE", "_1d").withColumnRenamed("timestamp", "ts_ms")
    return rows.select("symbol", "ts_ms", "close", "quote_volume", "high")


def milliseconds(t: Column) -> Column:
    """Archives switched to microseconds; both are read."""
    t = t.cast("bigint")
    return F.when(t > 100_000_000_000_000, F.floor(t / 1000)).otherwise(t)


def _csv(spark: SparkSession, path: str, names: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{n.strip()} STRING" for n in names.split(","))).csv(path)


def read_kline_csv(spark: SparkSession, path: str) -> DataFrame:
    """Kline archives with or without a header line."""
    rows = _csv(spark, path, KLINE_CSV).where(F.col("open_time").rlike("^[0-9]"))
    numbers = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume")]
    return rows.select(F.col("_metadata.file_path").alias("file"), milliseconds(F.col("open_time")).alias("ts_ms"), *numbers)


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_kline_csv(spark, path).select("file", "ts_ms", "close", "quote_volume", "high")


def read_funding_csv(spark: SparkSession, path: str) -> DataFrame:
    """Funding archives; the time column is calc_time or fundingTime, the rate last_funding_rate or fundingRate."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    time = next(c for c in ("calc_time", "fundingTime", "timestamp") if c in rows.columns)
    rate = next(c for c in ("last_funding_rate", "fundingRate", "funding_rate") if c in rows.columns)
    return rows.select(milliseconds(F.col(time)).alias("ts_ms"), F.col(rate).cast("double").alias("funding_rate"))


def read_premium_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, KLINE_CSV).where(F.col("open_time").rlike("^[0-9]"))
    return rows.select(F.col("_metadata.file_path").alias("file"), milliseconds(F.col("open_time")).alias("open_time"), F.col("close").cast("double").alias("premium_close"))


def read_tbill_csv(spark: SparkSession, path: str) -> DataFrame:
    """(day_ms, rate) a day; a point stands for a missing quote."""
    rows = _csv(spark, path, "observation_date, DTB3").where(F.col("observation_date").rlike("^[0-9]") & (F.col("DTB3") != "."))
    return rows.select((F.unix_date(F.to_date("observation_date")).cast("bigint") * DAY_MS).alias("day_ms"), (F.col("DTB3").cast("double") / 100 / 360).alias("rate"))


def read_candle_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents {candles: [{time, open, ...}]}: the first row of a time holds; quote volume is volume times close."""
    candle = "STRUCT<time: BIGINT, open: STRING, high: STRING, low: STRING, close: STRING, volume: STRING>"
    rows = spark.read.schema(f"candles ARRAY<{candle}>").option("multiLine", True).json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode("candles").alias("seq", "c"))
    first = keep_last(rows.select("file", F.col("c.time").alias("ts_ms"), (-F.col("seq")).alias("seq"), *[F.col(f"c.{n}").cast("double").alias(n) for n in ("open", "high", "low", "close", "volume")]), ["file", "ts_ms"], "seq")
    return first.drop("seq").withColumn("quote_volume", F.col("volume") * F.col("close"))


def base_asset(name: Column) -> Column:
    """A venue's base asset under its common name."""
    pairs = [F.lit(x) for kv in BASE_ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name)


def tradable_instruments(rows: DataFrame) -> DataFrame:
    """Perpetuals that trade now, without multiples such as 1000X and names beyond ASCII."""
    name = F.col("base")
    return rows.where((F.col("type") == "flexible_futures") & F.col("tradeable") & ~name.startswith("1000") & name.rlike(r"^[\x00-\x7F]+$")).withColumn("base", base_asset(name))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of every file under a glob."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def failed_checksums(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose digest isn't the expected one, or that are missing."""
    return expected.alias("e").join(found.alias("f"), "file", "left").where("f.sha256 IS NULL OR f.sha256 <> e.sha256").select("file")


def read_zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of archives that hold exactly one member; others raise."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    (name,) = [n for n in z.namelist() if n.endswith(".csv")]
                    lines = z.read(name).decode().splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(range(len(lines)), pa.int32()), pa.array(lines)], names=["file", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, line_no int, line string")


def events_as_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as ticks: the type is the symbol, the value the price, one and k the volume."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("value").alias("price"),
        (1 + F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))).alias("volume"), F.col("event_id").alias("seq"), F.col("user_id"),
    )


__all__ = [n for n in dir() if n.startswith("read_")] + ["symbol_stem"]
