"""Bank transfers: reading, normalising, checks of the input."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.schema import LABEL, TRANSACTION_COLUMNS

#: Texts that mean a missing value in the CSV files.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: The raw header, whose second Account is the receiver's, and what names become.
RAW_HEADER = ["timestamp", "from_bank", "account", "to_bank", "account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering"]
ALIASES = {"account": "from_account", "account_1": "to_account"}
LEAST_ROWS = 5_000_000


def snake(name: str) -> str:
    return re.sub(r"[./ ]", "_", name.strip().lower())


def canonical_names(df: DataFrame) -> DataFrame:
    """Snake-case names, aliases applied; a repeated Account is the receiver's."""
    names = [snake(c) for c in df.columns]
    if names == RAW_HEADER or [re.sub(r"^account\d+$", "account", n) for n in names] == RAW_HEADER:
        return df.toDF(*TRANSACTION_COLUMNS)
    return df.toDF(*[ALIASES.get(n, n) for n in names])


def required(df: DataFrame) -> DataFrame:
    """The canonical columns alone; an error names those missing."""
    if lost := sorted(set(TRANSACTION_COLUMNS) - set(df.columns)):
        raise ValueError(f"missing transaction columns: {', '.join(lost)}")
    return df.select(*TRANSACTION_COLUMNS)


def parsed_time(c: Column) -> Column:
    text = c.cast("string")
    got = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm")), text.try_cast("timestamp")).cast("timestamp_ntz")
    return F.when(c.isNull() | got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp_ntz"))


def amount(c: Column) -> Column:
    x = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return F.when(x <= 0, 0.0).otherwise(x)  # no negative zero


def normalised(raw: DataFrame) -> DataFrame:
    """Any table of transfers in the canonical columns and types. Bad times, amounts or labels raise; a missing label is 0, a missing id 'nan'."""
    df = required(canonical_names(raw))
    ids = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("from_bank", "from_account", "to_bank", "to_account")}
    time = F.col("timestamp").cast("timestamp_ntz") if dict(df.dtypes)["timestamp"].startswith("timestamp") else parsed_time(F.col("timestamp"))
    return df.withColumns(ids | {"timestamp": time, "amount_received": amount(F.col("amount_received")), "amount_paid": amount(F.col("amount_paid")), LABEL: F.coalesce(F.col(LABEL).cast("double").cast("int"), F.lit(0))})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return normalised(raw.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin(MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns)))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers in the events table: sender is the user, receiver the number in props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    to = F.regexp_extract("props", "([0-9]+)", 1)
    return normalised(
        e.select(
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("B"), F.col("user_id") % 12).alias("from_bank"),
            F.concat(F.lit("ACC-"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("from_account"),
            F.concat(F.lit("B"), to.cast("int") % 12).alias("to_bank"),
            F.concat(F.lit("ACC-"), F.lpad(to, 5, "0")).alias("to_account"),
            F.col("value").alias("amount_received"),
            F.when(F.col("event_id") % 17 == 0, "Euro").otherwise("US Dollar").alias("receiving_currency"),
            F.col("value").alias("amount_paid"),
            F.when(F.col("event_id") % 5 == 0, "Euro").otherwise("US Dollar").alias("payment_currency"),
            F.expr("case event_type when 'purchase' then 'Cash' when 'view' then 'ACH' when 'click' then 'Credit Card' when 'signup' then 'Wire' else 'Cheque' end").alias("payment_format"),
            F.when((F.col("value") > 80) & (F.col("event_id") % 3 == 0), 1).otherwise(0).alias(LABEL),
        )
    )


def derived(tx: DataFrame) -> DataFrame:
    """date, hour, is_cash, is_cross_currency; rows without a time go. A missing currency counts as cross-currency, a missing format not as cash."""
    return tx.where("timestamp is not null").withColumns(
        {
            "date": F.to_date("timestamp"),
            "hour": F.hour("timestamp"),
            "is_cash": F.coalesce((F.lower("payment_format") == "cash").cast("int"), F.lit(0)),
            "is_cross_currency": F.coalesce((F.col("payment_currency") != F.col("receiving_currency")).cast("int"), F.lit(1)),
        }
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and a sum of row hashes: free of order and partitioning, and it counts repeated rows."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 (lowercase hex) of each input file. A file is one value here, so this is for files of at most 2 GB, as the source has it; empty files are not read by Spark and have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def guarded(n: int, least: int = LEAST_ROWS) -> int:
    if n < least:
        raise ValueError(f"{n} transactions; at least {least} are needed")
    return n


def guard_size(df: DataFrame, least: int = LEAST_ROWS) -> int:
    return guarded(df.count(), least)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df with an observation whose n is its rows, known once an action has read df: no scan of its own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen
