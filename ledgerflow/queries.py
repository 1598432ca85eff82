"""Registered queries of the account-day library, and DuckDB SQL for those that SQL can say.

Transfers come from the events table. Where a query needs model output but must be exact, scores are a stand-in that
both engines can work out: segments by a rule, percentiles of two features against the training days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.functions.schema import FEATURE_COLUMNS, LABEL, LINEAR, SEGMENT_NAMES, TRANSACTION_COLUMNS
from ledgerflow.jobs import runs
from ledgerflow.operators import evaluation, explain, features, model, network, scaling, segments, split
from ledgerflow.sources import sinks
from ledgerflow.sources.storage import shared_path, written
from ledgerflow.sources.transactions import derived, file_digests, fingerprint, from_events, guard_size, normalised, read_csv

BUDGET, FRACTION, PLACES = 100, 0.7, 6
COUNTS = [c for c in FEATURE_COLUMNS if c.endswith(("count", "parties", "banks", "hours"))]


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles to a fixed number of places: sums in another order differ beyond."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.account_days(transfers(spark, sf_dir))


def clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    """Account-days with the stand-in cluster, and the cutoff."""
    f = written(days(spark, sf_dir), "features")
    return f.withColumn("cluster", F.expr("case when total_tx_count >= 5 then 0 when flow_ratio > 1 then 1 when flow_ratio < -1 then 2 else 3 end")), split.cutoff(f, FRACTION)


def stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-days with stand-in cluster, percentiles, risk and the cutoff."""
    rows, cut = clustered(spark, sf_dir)
    train = rows.where(F.col("date") <= F.lit(cut))
    for column, name in (("total_value", "anomaly_percentile"), ("total_tx_count", "cluster_distance_percentile")):
        rows = model.rank_shares(rows, model.reference_counts(train, column), column, name)
    return rows.withColumn("risk_score", model.risk(F.col("anomaly_percentile"), F.col("cluster_distance_percentile"))).withColumn("cutoff", F.lit(cut))


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in(spark, sf_dir).where("date > cutoff")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.queue(late(spark, sf_dir), BUDGET)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The SQL forms build on these views, which use joins where the Spark side has none.
TX = """tx as (select cast(ts as timestamp) as timestamp, 'B' || cast(user_id % 12 as varchar) as from_bank, 'ACC-' || lpad(cast(user_id as varchar), 5, '0') as from_account,
  'B' || cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) % 12 as varchar) as to_bank, 'ACC-' || lpad(regexp_extract(props, '([0-9]+)', 1), 5, '0') as to_account,
  value as amount_received, case when event_id % 17 = 0 then 'Euro' else 'US Dollar' end as receiving_currency, value as amount_paid, case when event_id % 5 = 0 then 'Euro' else 'US Dollar' end as payment_currency,
  case event_type when 'purchase' then 'Cash' when 'view' then 'ACH' when 'click' then 'Credit Card' when 'signup' then 'Wire' else 'Cheque' end as payment_format,
  cast(case when value > 80 and event_id % 3 = 0 then 1 else 0 end as integer) as is_laundering from events)"""
T = TX + """, t as (select *, cast(timestamp as date) as date, cast(hour(timestamp) as integer) as hour, cast(lower(payment_format) = 'cash' as integer) as is_cash, cast(payment_currency <> receiving_currency as integer) as is_cross_currency from tx)"""
SIDES = T + """, o as (select date, from_account as account_id, count(*) as out_tx_count, sum(cast(amount_paid as decimal(18,4))) as out_sum, count(amount_paid) as out_known, max(amount_paid) as out_max, count(distinct to_account) as unique_out_counterparties,
  count(distinct to_bank) as unique_out_banks, count(distinct hour) as active_out_hours, sum(is_cash) as cash, sum(is_cross_currency) as crossed, max(is_laundering) as out_label from t group by all),
i as (select date, to_account as account_id, count(*) as in_tx_count, sum(cast(amount_received as decimal(18,4))) as in_sum, count(amount_received) as in_known, max(amount_received) as in_max, count(distinct from_account) as unique_in_counterparties,
  count(distinct from_bank) as unique_in_banks, max(is_laundering) as in_label from t group by all),
p as (select distinct date, from_account, to_account from t),
r as (select a.date, a.from_account as account_id, count(distinct a.to_account) as reciprocal_counterparties from p a join p b on a.date = b.date and a.from_account = b.to_account and a.to_account = b.from_account group by all)"""
F_ = SIDES + """, f as (select strftime(date, '%Y%m%d') || '-' || account_id as case_id, date, account_id, cast(coalesce(out_tx_count, 0) as bigint) as out_tx_count, cast(coalesce(in_tx_count, 0) as bigint) as in_tx_count,
  cast(coalesce(out_sum, 0) as double) as out_total, cast(coalesce(in_sum, 0) as double) as in_total, coalesce(cast(out_sum as double) / nullif(out_known, 0), 0) as out_mean, coalesce(cast(in_sum as double) / nullif(in_known, 0), 0) as in_mean,
  coalesce(out_max, 0) as out_max, coalesce(in_max, 0) as in_max, cast(coalesce(unique_out_counterparties, 0) as bigint) as unique_out_counterparties, cast(coalesce(unique_in_counterparties, 0) as bigint) as unique_in_counterparties,
  cast(coalesce(unique_out_banks, 0) as bigint) as unique_out_banks, cast(coalesce(unique_in_banks, 0) as bigint) as unique_in_banks, cast(coalesce(active_out_hours, 0) as bigint) as active_out_hours,
  coalesce(cast(cash as double) / out_tx_count, 0) as cash_share, coalesce(cast(crossed as double) / out_tx_count, 0) as cross_currency_share, cast(coalesce(reciprocal_counterparties, 0) as bigint) as reciprocal_counterparties,
  cast(coalesce(out_tx_count, 0) + coalesce(in_tx_count, 0) as bigint) as total_tx_count, cast(coalesce(out_sum, 0) + coalesce(in_sum, 0) as double) as total_value,
  ln(1 + cast(coalesce(in_sum, 0) as double)) - ln(1 + cast(coalesce(out_sum, 0) as double)) as flow_ratio, cast(greatest(coalesce(out_label, 0), coalesce(in_label, 0)) as integer) as is_laundering
  from o full join i using (date, account_id) left join r using (date, account_id))"""
CUT = F_ + f""", d as (select date, count(*) as cases from f group by date), d2 as (select *, sum(cases) over (order by date) as running, sum(cases) over () as total, max(date) over () as last from d),
cut as (select arg_min(date, (abs(running - total * {FRACTION}), date)) as cutoff, arg_min(running, (abs(running - total * {FRACTION}), date)) as train_cases, max(total) as cases from d2 where date < last)"""
SCORED = CUT + """, c as (select *, (select cutoff from cut) as cutoff, cast(case when total_tx_count >= 5 then 0 when flow_ratio > 1 then 1 when flow_ratio < -1 then 2 else 3 end as integer) as cluster from f),
q as (select *, coalesce(cast(count(*) filter (where date <= cutoff) over (partition by cluster order by total_value) as double) / nullif(count(*) filter (where date <= cutoff) over (partition by cluster), 0), 0) as anomaly_percentile,
  coalesce(cast(count(*) filter (where date <= cutoff) over (partition by cluster order by total_tx_count) as double) / nullif(count(*) filter (where date <= cutoff) over (partition by cluster), 0), 0) as cluster_distance_percentile from c),
s as (select *, round_even(100.0::double * least(greatest(100.0::double * (0.82::double * anomaly_percentile + 0.18::double * cluster_distance_percentile), 0), 100), 0) / 100.0::double as risk_score from q),
e as (select * from s where date > cutoff)"""
TOP = SCORED + f""", k as (select *, cast(row_number() over (order by risk_score desc, case_id) as integer) as rank from e qualify row_number() over (order by risk_score desc, case_id) <= {BUDGET})"""
FEATURE_SQL = ", ".join(f"round({c}, {PLACES}) + 0.0 as {c}" if c not in COUNTS else c for c in FEATURE_COLUMNS)
PREPARED_SQL = {c: c if c in LINEAR else f"ln(1 + greatest(cast({c} as double), 0))" for c in FEATURE_COLUMNS}


def query(key: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return put


def _round(*columns: str) -> str:
    return ", ".join(f"round({c}, {PLACES}) + 0.0 as {c.split('.')[-1]}" for c in columns)


# sources and projections -----------------------------------------------------------------------------------------

ALL_TX = ", ".join(TRANSACTION_COLUMNS)


@query("S1_read_csv", f"with {TX} select {ALL_TX.replace('timestamp', 'date_trunc(\'minute\', timestamp) as timestamp')} from tx")
def s1(spark, sf_dir):
    """Write the transfers as a raw CSV with slash times and a second Account (with a blank behind it, as Spark writes no name twice), and read them."""
    path = shared_path(spark, "raw")
    raw = transfers(spark, sf_dir).withColumn("timestamp", F.date_format("timestamp", "yyyy/MM/dd HH:mm"))
    names = ["Timestamp", "From Bank", "Account", "To Bank", "Account ", "Amount Received", "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering"]
    raw.toDF(*names).write.csv(path, header=True)
    return read_csv(spark, path)


@query("S8_guarded_rows", f"with {TX} select count(*) as transactions from tx")
def s8(spark, sf_dir):
    """The rows that the size guard lets through, with a limit that these tables pass."""
    return spark.createDataFrame([(guard_size(transfers(spark, sf_dir), least=100),)], "transactions long")


@query("S9_fingerprint", f"with {TX} select count(*) as n_rows, (select count(distinct ({ALL_TX})) from tx) as n_distinct from tx")
def s9(spark, sf_dir):
    """The fingerprint's rows beside the distinct ones; that its hash does not depend on order is tested."""
    t = transfers(spark, sf_dir)
    return fingerprint(t).select("n_rows").crossJoin(t.distinct().agg(F.count("*").alias("n_distinct")))  # one row each


@query("S9_file_digests")
def s9_files(spark, sf_dir):
    """Bytes and SHA-256 of each file of the events; tested against hashlib."""
    return file_digests(spark, f"{sf_dir}/events.parquet")


@query("P6_odd_values", "select event_id, case when event_id % 7 = 0 then 0.0::double when event_id % 11 = 0 then null else value end as amount_paid, cast(event_id % 17 <> 0 and event_id % 3 = 0 as integer) as is_laundering, cast(event_id % 13 <> 0 and event_type = 'purchase' as integer) as is_cash, cast(event_id % 19 = 0 as integer) as is_cross_currency from events")
def p6(spark, sf_dir):
    """P6-P8 where amounts are negative or missing, labels blank or text, formats and currencies missing: the events with such values put in."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    value = F.when(i % 7 == 0, -F.col("value")).when(i % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    raw = e.select("event_id", F.col("ts").alias("timestamp"), *(F.lit("x").alias(c) for c in ("from_bank", "from_account", "to_bank")), i.cast("string").alias("to_account"), value.alias("amount_received"), F.lit("Euro").alias("receiving_currency"), value.alias("amount_paid"), F.when(i % 19 != 0, "Euro").alias("payment_currency"), F.when(i % 13 != 0, F.when(F.col("event_type") == "purchase", "CASH").otherwise("Wire")).alias("payment_format"), F.when(i % 17 != 0, F.when(i % 3 == 0, "1").otherwise("0")).alias("is_laundering"))
    t = derived(normalised(raw.drop("event_id")))
    return t.select(F.col("to_account").cast("long").alias("event_id"), "amount_paid", LABEL, "is_cash", "is_cross_currency")


@query("P4_times", f"with {TX} select strftime(timestamp, '%Y/%m/%d %H:%M') as written, date_trunc('minute', timestamp) as read, count(*) as n from tx group by all")
def p4(spark, sf_dir):
    """Slash times, parsed as the input has them."""
    from ledgerflow.sources.transactions import parsed_time

    t = transfers(spark, sf_dir).select(F.date_format("timestamp", "yyyy/MM/dd HH:mm").alias("written"))
    return t.select("written", parsed_time(F.col("written")).alias("read")).groupBy("written", "read").agg(F.count("*").alias("n"))


@query("P5_normalised", f"with {TX} select {ALL_TX} from tx")
def p5(spark, sf_dir):
    """P1-P3, P5-P7: names, required columns, ids, amounts and labels."""
    return transfers(spark, sf_dir)


@query("P8_derived", f"with {T} select from_account, to_account, timestamp, date, hour, is_cash, is_cross_currency from t")
def p8(spark, sf_dir):
    return derived(transfers(spark, sf_dir)).select("from_account", "to_account", "timestamp", "date", "hour", "is_cash", "is_cross_currency")


@query("U1_append", f"with {TX}, b as (select {ALL_TX} from tx union all select {ALL_TX} from tx) select from_account, count(*) as n from b group by all")
def u1(spark, sf_dir):
    t = transfers(spark, sf_dir)
    return t.unionByName(t).groupBy("from_account").agg(F.count("*").alias("n"))


# features --------------------------------------------------------------------------------------------------------


@query("A1_outgoing", f"with {SIDES} select date, account_id, out_tx_count, cast(out_sum as double) as out_total, {_round('out_mean', 'cash_share', 'cross_currency_share')}, out_max, unique_out_counterparties, unique_out_banks, active_out_hours, out_label from (select *, cast(out_sum as double) / out_known as out_mean, cast(cash as double) / out_tx_count as cash_share, cast(crossed as double) / out_tx_count as cross_currency_share from o)")
def a1(spark, sf_dir):
    return rounded(features.outgoing(transfers(spark, sf_dir)))


@query("A2_incoming", f"with {SIDES} select date, account_id, in_tx_count, cast(in_sum as double) as in_total, {_round('in_mean')}, in_max, unique_in_counterparties, unique_in_banks, in_label from (select *, cast(in_sum as double) / in_known as in_mean from i)")
def a2(spark, sf_dir):
    return rounded(features.incoming(transfers(spark, sf_dir)))


@query("A3_pairs", f"with {SIDES} select date, from_account, to_account from p")
def a3(spark, sf_dir):
    return features.pairs(transfers(spark, sf_dir))


@query("A4_reciprocal", f"with {SIDES} select date, account_id, reciprocal_counterparties from r")
def a4(spark, sf_dir):
    return features.reciprocal_counts(transfers(spark, sf_dir))


@query("A5_account_days", f"with {F_} select case_id, date, account_id, {FEATURE_SQL}, is_laundering from f")
def a5(spark, sf_dir):
    return rounded(days(spark, sf_dir))


QUERIES["P9_feature_frame"], SQL["P9_feature_frame"] = QUERIES["A5_account_days"], SQL["A5_account_days"]


@query("J1_sides", f"with {SIDES} select date, account_id, coalesce(out_tx_count, 0) as out_tx_count, coalesce(in_tx_count, 0) as in_tx_count, coalesce(cast(out_sum as double), 0) as out_total, coalesce(cast(in_sum as double), 0) as in_total from o full join i using (date, account_id)")
def j1(spark, sf_dir):
    return features.joined_sides(transfers(spark, sf_dir)).select("date", "account_id", "out_tx_count", "in_tx_count", "out_total", "in_total")


@query("J2_with_reciprocal", f"with {SIDES} select date, account_id, coalesce(out_tx_count, 0) as out_tx_count, coalesce(in_tx_count, 0) as in_tx_count, cast(coalesce(reciprocal_counterparties, 0) as bigint) as reciprocal_counterparties from o full join i using (date, account_id) left join r using (date, account_id)")
def j2(spark, sf_dir):
    """The left join itself; account_days() gets the same counts without it."""
    t = transfers(spark, sf_dir)
    return features.with_reciprocal(features.joined_sides(t), features.reciprocal_counts(t)).select("date", "account_id", "out_tx_count", "in_tx_count", "reciprocal_counterparties")


@query("J3_reciprocity", f"with {SIDES} select a.date, a.from_account, a.to_account from p a join p b on a.date = b.date and a.from_account = b.to_account and a.to_account = b.from_account")
def j3(spark, sf_dir):
    return features.reciprocal_pairs(transfers(spark, sf_dir))


@query("A6_cases_per_day", f"with {F_} select date, count(*) as cases from f group by date")
def a6(spark, sf_dir):
    return features.cases_per_day(days(spark, sf_dir))


@query("A15_checks", f"with {F_} select cast(count(*) as bigint) as n_rows, count(distinct (date, account_id)) as n_keys, cast(0 as bigint) as n_missing from f")
def a15(spark, sf_dir):
    return features.checks(days(spark, sf_dir))


@query("F1_flow_ratio", f"with {F_} select case_id, {_round('flow_ratio')} from f")
def f1(spark, sf_dir):
    return rounded(days(spark, sf_dir).select("case_id", "flow_ratio"))


@query("F2_case_id", f"with {F_} select case_id, date, account_id from f")
def f2(spark, sf_dir):
    return days(spark, sf_dir).select("case_id", "date", "account_id")


@query("F3_totals", f"with {F_} select case_id, total_tx_count, total_value from f")
def f3(spark, sf_dir):
    return days(spark, sf_dir).select("case_id", "total_tx_count", "total_value")


@query("F4_prepare", f"with {F_} select case_id, {', '.join(f'round({PREPARED_SQL[c]}, {PLACES}) + 0.0 as {c}' for c in FEATURE_COLUMNS)} from f")
def f4(spark, sf_dir):
    return rounded(scaling.prepare(days(spark, sf_dir)))


def _money_sql(x: str) -> str:
    return f"case when abs({x}) >= 1e6 then '$' || format('{{:,.1f}}', {x} / 1e6) || 'M' when abs({x}) >= 1e3 then '$' || format('{{:,.1f}}', {x} / 1e3) || 'K' else '$' || format('{{:,.0f}}', {x}) end"


@query("F5_money_text", f"with {F_} select case_id, {_money_sql('cast(total_value as double)')} as value_text, {_money_sql('(cast(out_max as double) * 1000)')} as large_text from f")
def f5(spark, sf_dir):
    return days(spark, sf_dir).select("case_id", explain.money_text(F.col("total_value")).alias("value_text"), explain.money_text(F.col("out_max") * 1000).alias("large_text"))


# split and scaling -----------------------------------------------------------------------------------------------


@query("W1_cutoff", f"with {CUT} select cutoff, cast(train_cases as bigint) as train_cases, cast(cases as bigint) as cases from cut")
def w1(spark, sf_dir):
    return split.cutoff_table(days(spark, sf_dir), FRACTION)


@query("J4_train_rows", f"with {CUT} select case_id from f where date <= (select cutoff from cut)")
def j4(spark, sf_dir):
    f = written(days(spark, sf_dir))
    return split.train_rows(f, split.cutoff(f, FRACTION)).select("case_id")


@query("J5_not_evaluated", f"with {CUT} select case_id from f where date <= (select cutoff from cut)")
def j5(spark, sf_dir):
    f = written(days(spark, sf_dir))
    return split.without_cases(f, split.evaluation_rows(f, split.cutoff(f, FRACTION))).select("case_id")


@query("A14_parts", f"with {CUT} select case when date <= (select cutoff from cut) then 'train' else 'evaluation' end as part, min(date) as first_date, max(date) as last_date, count(*) as cases, cast(sum(is_laundering) as bigint) as positives, round(avg(is_laundering), {PLACES}) + 0.0 as prevalence from f group by 1")
def a14(spark, sf_dir):
    f = written(days(spark, sf_dir))
    return rounded(split.parts(f, split.cutoff(f, FRACTION)))


@query("M12_no_leakage", f"with {CUT} select max(date) filter (where date <= (select cutoff from cut)) as last_train, min(date) filter (where date > (select cutoff from cut)) as first_evaluation, max(date) filter (where date <= (select cutoff from cut)) < min(date) filter (where date > (select cutoff from cut)) as apart from f")
def m12(spark, sf_dir):
    f = written(days(spark, sf_dir))
    cut = F.lit(split.cutoff(f, FRACTION))
    last, first = F.max(F.when(F.col("date") <= cut, F.col("date"))), F.min(F.when(F.col("date") > cut, F.col("date")))
    return f.agg(last.alias("last_train"), first.alias("first_evaluation"), (last < first).alias("apart"))


SCALER_SQL = " union all ".join(f"select '{c}' as feature, quantile_cont({PREPARED_SQL[c]}, 0.5) as center, coalesce(nullif(quantile_cont({PREPARED_SQL[c]}, 0.9) - quantile_cont({PREPARED_SQL[c]}, 0.1), 0), 1) as spread from tr" for c in FEATURE_COLUMNS)


@query("A9_scaler", f"with {CUT}, tr as (select * from f where date <= (select cutoff from cut)), z as ({SCALER_SQL}) select feature, {_round('center', 'spread')} from z")
def a9(spark, sf_dir):
    f = written(days(spark, sf_dir))
    return rounded(scaling.scaler_table(split.train_rows(f, split.cutoff(f, FRACTION))))


@query("M1_scaled", f"with {CUT}, tr as (select * from f where date <= (select cutoff from cut)), z as ({SCALER_SQL}), m as (select map(list(feature), list(struct_pack(center := center, spread := spread))) as m from z) select case_id, {', '.join(f'''round(({PREPARED_SQL[c]} - m.m['{c}'].center) / m.m['{c}'].spread, 4) + 0.0 as {c}''' for c in FEATURE_COLUMNS)} from f, m")
def m1(spark, sf_dir):
    f = written(days(spark, sf_dir))
    scaler = scaling.scaler_of(split.train_rows(f, split.cutoff(f, FRACTION)))
    return rounded(f.select("case_id", *scaling.scaled_columns(scaler)), 4)


# evaluation on stand-in scores -----------------------------------------------------------------------------------


@query("W4_ecdf", f"with {SCORED} select case_id, {_round('anomaly_percentile', 'cluster_distance_percentile')} from s")
def w4(spark, sf_dir):
    """By the model's own references, whole and in the tasks."""
    rows, cut = clustered(spark, sf_dir)
    rows = written(rows.withColumns({"value": F.col("total_value").cast("double"), "times": F.col("total_tx_count").cast("double")}))
    refs = {c: model.Reference.of(rows.where(F.col("date") <= F.lit(cut)), c) for c in ("value", "times")}
    return rounded(refs["times"].shares(refs["value"].shares(rows, "value", "anomaly_percentile"), "times", "cluster_distance_percentile").select("case_id", "anomaly_percentile", "cluster_distance_percentile"))


@query("W4_ecdf_large", f"with {SCORED} select case_id, {_round('anomaly_percentile', 'cluster_distance_percentile')} from s")
def w4_large(spark, sf_dir):
    """The same for references of any size: ranks over ranges of values."""
    return rounded(stand_in(spark, sf_dir).select("case_id", "anomaly_percentile", "cluster_distance_percentile"))


@query("M6_risk", f"with {SCORED} select case_id, cluster, risk_score from s")
def m6(spark, sf_dir):
    return stand_in(spark, sf_dir).select("case_id", "cluster", "risk_score")


@query("K1_top", f"with {TOP} select case_id, risk_score, total_value, is_laundering from k")
def k1(spark, sf_dir):
    return evaluation.rank_alerts(late(spark, sf_dir), BUDGET).select("case_id", "risk_score", "total_value", LABEL)


@query("W3_rank", f"with {TOP} select rank, case_id from k")
def w3(spark, sf_dir):
    return alerts(spark, sf_dir).select("rank", "case_id")


@query("S3_queue", f"with {SCORED} select row_number() over (order by risk_score desc, case_id) as rank, case_id, risk_score from e")
def s3(spark, sf_dir):
    """The whole held-out queue with its ranks, written in their order and read back."""
    path = shared_path(spark, "queue")
    sinks.write_queue(evaluation.ranked_cases(late(spark, sf_dir).select("case_id", "risk_score")), path)
    return sinks.read_small_csv(spark, path, "rank long, case_id string, risk_score double")


@query("W2_running", f"with {TOP} select rank, case_id, cast(sum(is_laundering) over (order by rank) as bigint) as hits, cast(sum(cast(case when is_laundering > 0 then total_value else 0 end as decimal(24,4))) over (order by rank) as double) as detected_value from k")
def w2(spark, sf_dir):
    return evaluation.running(late(spark, sf_dir), BUDGET)


AP = """g as (select risk_score, count(*) as n, sum(is_laundering) as h from e group by risk_score), g2 as (select h, sum(n) over (order by risk_score desc) as seen, sum(h) over (order by risk_score desc) as caught, sum(h) over () as pos from g), ap as (select coalesce(sum(cast(h as double) / nullif(pos, 0) * (cast(caught as double) / seen)), 0) as pr_auc from g2)"""
TOT = "tot as (select count(*) as cases, cast(coalesce(sum(is_laundering), 0) as bigint) as positives from e)"


@query("A11_average_precision", f"with {SCORED}, {AP} select {_round('pr_auc')} from ap")
def a11(spark, sf_dir):
    return rounded(evaluation.average_precision(late(spark, sf_dir)))


METRICS_SQL = f"""with {TOP}, {AP}, {TOT}, h as (select count(*) as taken, cast(sum(is_laundering) as bigint) as hits, cast(coalesce(sum(cast(case when is_laundering > 0 then total_value end as decimal(24,4))), 0) as double) as detected_value, min(risk_score) as alert_threshold from k)
select cases, positives, {BUDGET} as alert_budget, hits, round(hits / taken, {PLACES}) + 0.0 as precision_at_k, round(coalesce(hits / nullif(positives, 0), 0), {PLACES}) + 0.0 as recall_at_k, round(coalesce(hits / taken / nullif(positives / cases, 0), 0), {PLACES}) + 0.0 as lift_at_k, {_round('pr_auc')}, detected_value, alert_threshold from tot, h, ap"""


@query("A10_metrics", METRICS_SQL)
def a10(spark, sf_dir):
    return rounded(evaluation.metrics(written(late(spark, sf_dir)), BUDGET))


@query("S4_metrics_json", METRICS_SQL)
def s4(spark, sf_dir):
    found = a10(spark, sf_dir)
    path = shared_path(spark, "metrics")
    sinks.write_json(found, path)
    return spark.read.schema(found.schema).json(path)


@query("A12_threshold", f"with {TOP} select min(risk_score) as alert_threshold from k")
def a12(spark, sf_dir):
    return evaluation.rank_alerts(late(spark, sf_dir), BUDGET).agg(F.min("risk_score").alias("alert_threshold"))


@query("A13_histogram", f"with {SCORED} select cast(least(floor(risk_score / (100.0::double / {evaluation.BINS})) + 1, {evaluation.BINS}) as integer) as bin, count(*) as cases from e group by 1")
def a13(spark, sf_dir):
    return evaluation.risk_histogram(late(spark, sf_dir))


def budgets_of(rows: DataFrame) -> list[int]:
    return evaluation.capacities(None, rows.count())


@query("K3_capacities", f"with {SCORED}, n as (select count(*) as n from e) select cast(unnest(range(10, least(250, n) + 1, 10)) as integer) as capacity from n")
def k3(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in budgets_of(late(spark, sf_dir))], "capacity int")


CURVE_SQL = f"""with {SCORED}, {TOT}, k as (select *, row_number() over (order by risk_score desc, case_id) as rank from e), cv as (select cast(rank as integer) as capacity, cast(sum(is_laundering) over (order by rank) as bigint) as hits, cast(sum(cast(case when is_laundering > 0 then total_value else 0 end as decimal(24,4))) over (order by rank) as double) as detected_value from k),
v as (select capacity, hits, hits / capacity as precision, coalesce(hits / nullif(positives, 0), 0) as recall, coalesce(hits / capacity / nullif(positives / cases, 0), 0) as lift, detected_value from cv, tot where capacity <= least(250, cases) and capacity % 10 = 0)"""


@query("K4_curve", f"{CURVE_SQL} select capacity, hits, {_round('precision', 'recall', 'lift')}, detected_value from v")
def k4(spark, sf_dir):
    rows = written(late(spark, sf_dir))
    return rounded(evaluation.capacity_curve(rows, budgets_of(rows)))


@query("U2_long_curve", f"{CURVE_SQL} select capacity, 'Precision' as metric, round(precision, {PLACES}) + 0.0 as value from v union all select capacity, 'Recall', round(recall, {PLACES}) + 0.0 from v")
def u2(spark, sf_dir):
    return evaluation.long_curve(k4(spark, sf_dir))


# segments and explanations ---------------------------------------------------------------------------------------

PROFILE_SQL = "pr as (select cluster, count(*) as cases, median(cast(total_tx_count as double)) as median_transactions, median(total_value) as median_value, median(cast(unique_out_counterparties + unique_in_counterparties as double)) as median_counterparties, median(cross_currency_share) as median_cross_currency_share, median(cash_share) as median_cash_share, median(flow_ratio) as median_flow_ratio from e group by cluster)"
MEDIANS = ("median_transactions", "median_value", "median_counterparties", "median_cross_currency_share", "median_cash_share", "median_flow_ratio")


@query("A7_profiles", f"with {SCORED}, {PROFILE_SQL} select cluster, cases, {_round(*MEDIANS)} from pr")
def a7(spark, sf_dir):
    return rounded(segments.profiles(late(spark, sf_dir)))


@query("U3_by_size", f"with {SCORED}, {PROFILE_SQL} select cluster, cases, cast(row_number() over (order by cases, cluster) as integer) as place from pr")
def u3(spark, sf_dir):
    return segments.profiles(late(spark, sf_dir)).select("cluster", "cases", F.row_number().over(Window.orderBy("cases", "cluster")).alias("place"))


def names_sql(rows: str) -> str:
    """Views pr and nm(cluster, cluster_name): each segment's name by the greedy rule, from the profiles of some rows."""
    each = " union all ".join(f"select cluster, {c} as v, '{c}' as m, '{high}' as high, '{low}' as low from pr" for c, high, low in SEGMENT_NAMES)
    return f"""{PROFILE_SQL.replace(' from e ', f' from {rows} ')}, nv as ({each}),
ns as (select m, median(v) as mid, coalesce(nullif(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0), nullif(stddev_samp(v), 0), 1) as spread from nv group by m),
nz as (select cluster, (v - mid) / spread as z, case when (v - mid) / spread >= 0 then high else low end as name from nv join ns using (m)),
nl as (select cluster, list(name order by abs(z) desc, name desc) as names, max(abs(z)) as top from nz group by cluster),
no_ as (select *, row_number() over (order by top desc, cluster) as i from nl),
nm(i, cluster, cluster_name, used) as (select i, cluster, names[1], [names[1]] from no_ where i = 1
  union all select o.i, o.cluster, coalesce(list_filter(o.names, lambda x: not list_contains(r.used, x))[1], o.names[1]), list_append(r.used, coalesce(list_filter(o.names, lambda x: not list_contains(r.used, x))[1], o.names[1])) from nm r join no_ o on o.i = r.i + 1)"""


@query("M11_segment_names", f"with recursive {SCORED}, {names_sql('e')} select cluster, cases, cluster_name from pr join nm using (cluster)")
def m11(spark, sf_dir):
    p = written(segments.profiles(late(spark, sf_dir)))
    return segments.named(p.select("cluster", "cases"), segments.name_table(spark, segments.segment_names(p.collect())))


@query("J6_named_cases", f"with recursive {SCORED}, {names_sql('e')} select case_id, cluster, cluster_name from e join nm using (cluster)")
def j6(spark, sf_dir):
    rows = written(late(spark, sf_dir))
    names = segments.name_table(spark, segments.segment_names(segments.profiles(rows).collect()))
    return segments.named(rows.select("case_id", "cluster"), names)


BASE_SQL = " union all ".join(f"select cluster, '{c}' as feature, median(cast({c} as double)) as median, coalesce(nullif(quantile_cont(cast({c} as double), 0.75) - quantile_cont(cast({c} as double), 0.25), 0), nullif(stddev_samp({c}), 0), 1) as scale from s where date <= cutoff group by cluster" for c in FEATURE_COLUMNS)


@query("A8_baselines", f"with {SCORED}, b as ({BASE_SQL}) select cluster, feature, {_round('median', 'scale')} from b")
def a8(spark, sf_dir):
    return rounded(segments.baselines(stand_in(spark, sf_dir).where("date <= cutoff")))


def _explained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = written(stand_in(spark, sf_dir))
    return rows, written(segments.baselines(rows.where("date <= cutoff")))


GROUP_SQL = "case " + " ".join(f"when feature = '{f}' then '{g}'" for f, _, g, _ in explain.FEATURES) + " end"
DEV_SQL = " union all ".join(f"select k.case_id, {i} as place, '{c}' as feature, case when {'k.out_tx_count = 0' if c in explain.SHARES else 'false'} then '-infinity'::double else abs((cast(k.{c} as double) - b.median) / b.scale) end as dev from k join b on b.cluster = k.cluster and b.feature = '{c}'" for i, c in enumerate(FEATURE_COLUMNS))


@query("M8_factors", f"with {TOP}, b as ({BASE_SQL}), dv as ({DEV_SQL}), g1 as (select *, {GROUP_SQL} as grp from dv), g2 as (select * from g1 qualify row_number() over (partition by case_id, grp order by dev desc, place) = 1), g3 as (select *, cast(row_number() over (partition by case_id order by dev desc, place) as integer) as n from g2) select case_id, n, feature, round(dev, 4) + 0.0 as deviation from g3 where n <= 3")
def m8(spark, sf_dir):
    rows, base = _explained(spark, sf_dir)
    f = explain.factors(evaluation.queue(rows.where("date > cutoff"), BUDGET), base)
    return f.select("case_id", F.posexplode("factors").alias("n", "x")).select("case_id", (F.col("n") + 1).alias("n"), "x.feature", (F.round("x.deviation", 4) + F.lit(0.0)).alias("deviation"))


def texts_sql(rows: str) -> str:
    """View tx9(case_id, alert_reason, alert_factors) of some rows, from their three largest deviations."""
    percent, share = "format('{{:,.0f}}', {} * 100) || '%'", []
    for i, (c, label, _, kind) in enumerate(explain.FEATURES):
        v, m = f"cast(k.{c} as double)", "b.median"
        if kind == "share":
            text = f"cast(cast(round_even({v} * k.out_tx_count, 0) as bigint) as varchar) || ' of ' || k.out_tx_count || ' outgoing ' || case when k.out_tx_count = 1 then 'transaction' else 'transactions' end || ' (' || {percent.format(v)} || ') vs segment median ' || {percent.format(m)} || case when k.out_tx_count < 3 then '; limited sample' else '' end"
        else:
            sign, d = {"money": ("$", 2), "count": ("", 0)}.get(kind, ("", 2))
            text = f"'{sign}' || format('{{:,.{d}f}}', {v}) || ' vs segment median {sign}' || format('{{:,.{d}f}}', {m})"
        share.append(f"select k.case_id, {i} as place, '{c}' as feature, case when {'k.out_tx_count = 0' if c in explain.SHARES else 'false'} then '-infinity'::double else abs(({v} - b.median) / b.scale) end as dev, 'Unusual {label}: ' || {text} as words from {rows} k join b on b.cluster = k.cluster and b.feature = '{c}'")
    return f"""b as ({BASE_SQL}), dv as ({' union all '.join(share)}), g1 as (select *, {GROUP_SQL} as grp from dv), g2 as (select * from g1 qualify row_number() over (partition by case_id, grp order by dev desc, place) = 1),
g3 as (select *, row_number() over (partition by case_id order by dev desc, place) as n from g2), tx9 as (select case_id, max(words) filter (where n = 1) as alert_reason, string_agg(words, ' • ' order by n) as alert_factors from g3 where n <= 3 group by case_id)"""


@query("M9_factor_texts", f"with {TOP}, {texts_sql('k')} select * from tx9")
def m9(spark, sf_dir):
    rows, base = _explained(spark, sf_dir)
    return explain.explained(evaluation.queue(rows.where("date > cutoff"), BUDGET), base).select("case_id", "alert_reason", "alert_factors")


@query("S2_scored_cases", f"with {SCORED}, {texts_sql('s')} select case_id, date, account_id, cluster, risk_score, alert_reason, alert_factors from s join tx9 using (case_id)")
def s2(spark, sf_dir):
    """All scored rows with reason and factors, written by date and read back."""
    rows, base = _explained(spark, sf_dir)
    path = shared_path(spark, "scored")
    sinks.write_scored(explain.explained(rows, base), path)
    return spark.read.parquet(path).select("case_id", F.col("date").cast("date").alias("date"), "account_id", "cluster", "risk_score", "alert_reason", "alert_factors")


@query("P10_chosen_segments", f"with {SCORED} select case_id, cluster from e where cluster in (0, 1)")
def p10(spark, sf_dir):
    return late(spark, sf_dir).where(F.col("cluster").isin([0, 1])).select("case_id", "cluster")


@query("P11_queue_view", f"with {TOP} select rank, case_id, date, account_id, cluster, risk_score, total_tx_count, total_value, {_round('flow_ratio')}, case when is_laundering > 0 then 'Confirmed laundering' else 'Unconfirmed' end as outcome from k")
def p11(spark, sf_dir):
    return rounded(explain.queue_view(alerts(spark, sf_dir), reveal=True))


@query("P12_cross_currency_count", f"with {TOP} select case_id, cast(round_even(cross_currency_share * out_tx_count, 0) as bigint) as cross_count from k")
def p12(spark, sf_dir):
    return alerts(spark, sf_dir).select("case_id", F.rint(F.col("cross_currency_share") * F.col("out_tx_count")).cast("long").alias("cross_count"))


@query("P13_outcomes", f"with {SCORED} select case when is_laundering > 0 then 'Confirmed laundering' else 'Unconfirmed' end as outcome, count(*) as cases from e group by 1")
def p13(spark, sf_dir):
    return late(spark, sf_dir).groupBy(explain.outcome(F.col(LABEL)).alias("outcome")).agg(F.count("*").alias("cases"))


CENTERS = {0: [0.0] * len(FEATURE_COLUMNS), 1: [1.0] * len(FEATURE_COLUMNS), 2: [-0.5] * len(FEATURE_COLUMNS)}
FAR_SQL = {k: "sqrt(" + " + ".join(f"({PREPARED_SQL[c]} - {v}) * ({PREPARED_SQL[c]} - {v})" for c, v in zip(FEATURE_COLUMNS, vs, strict=True)) + ")" for k, vs in CENTERS.items()}


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.assigned(scaling.prepare(days(spark, sf_dir)), FEATURE_COLUMNS, CENTERS)


@query("M3_nearest_centre", f"with {F_}, z as (select case_id, {', '.join(f'{x} as d{k}' for k, x in FAR_SQL.items())} from f) select case_id, cast(case when d0 <= d1 and d0 <= d2 then 0 when d1 <= d2 then 1 else 2 end as integer) as cluster from z")
def m3(spark, sf_dir):
    """Nearest of three fixed centres."""
    return _nearest(spark, sf_dir).select("case_id", "cluster")


@query("M4_centre_distance", f"with {F_}, z as (select case_id, {', '.join(f'{x} as d{k}' for k, x in FAR_SQL.items())} from f) select case_id, round(least(d0, d1, d2), {PLACES}) + 0.0 as center_distance from z")
def m4(spark, sf_dir):
    return rounded(_nearest(spark, sf_dir).select("case_id", "center_distance"))


# networks --------------------------------------------------------------------------------------------------------

EGO = TOP + ", ego as (select k.case_id, k.account_id, t.* from t join k on t.date = k.date and (t.from_account = k.account_id or t.to_account = k.account_id)), ed as (select case_id, from_account, to_account, cast(sum(cast(amount_paid as decimal(18,4))) as double) as weight, max(is_laundering) as illicit from ego group by 1, 2, 3)"


@query("J7_ego_transfers", f"with {EGO} select case_id, from_account, to_account, timestamp, amount_paid from ego")
def j7(spark, sf_dir):
    return network.ego_transactions(transfers(spark, sf_dir), alerts(spark, sf_dir)).select("case_id", "from_account", "to_account", "timestamp", "amount_paid")


@query("N1_ego_edges", f"with {EGO} select * from ed")
def n1(spark, sf_dir):
    return network.ego_edges(transfers(spark, sf_dir), alerts(spark, sf_dir))


@query("N2_ego_nodes", f"with {EGO}, ends as (select case_id, from_account as node from ed union all select case_id, to_account from ed) select ends.case_id, node, count(*) as degree, node = k.account_id as is_center from ends join k on k.case_id = ends.case_id group by ends.case_id, node, k.account_id")
def n2(spark, sf_dir):
    a = written(alerts(spark, sf_dir))
    return network.ego_nodes(network.ego_edges(transfers(spark, sf_dir), a), a)


def _fan_sql(hub: str, other: str) -> str:
    return f"with {T}, z as (select distinct {hub} as hub, {other} as other, cast(floor(epoch(timestamp)) as bigint) as s from t), y as (select a.hub, a.s, count(distinct b.other) as n from z a join z b on a.hub = b.hub and b.s between a.s - 3600 and a.s group by 1, 2) select hub, max(n) as most from y group by hub having max(n) >= 3"


@query("N3_fan_out", _fan_sql("from_account", "to_account"))
def n3(spark, sf_dir):
    return network.fans(transfers(spark, sf_dir))


@query("N3_fan_in", _fan_sql("to_account", "from_account"))
def n3b(spark, sf_dir):
    return network.fans(transfers(spark, sf_dir), out=False)


@query("N4_cycles", f"with {T}, z as (select distinct from_account as a, to_account as b, cast(floor(epoch(timestamp)) as bigint) as s, amount_paid as m from t where from_account <> to_account) select x.a || '>' || y.a || '>' || w.a as ring, x.s as first_s, w.s as last_s, cast(cast(x.m as decimal(18,4)) + cast(y.m as decimal(18,4)) + cast(w.m as decimal(18,4)) as double) as total from z x join z y on y.a = x.b and y.s > x.s and y.s <= x.s + 14400 join z w on w.a = y.b and w.s > y.s and w.s <= y.s + 14400 and w.b = x.a where y.b <> x.a")
def n4(spark, sf_dir):
    return network.cycles(transfers(spark, sf_dir), 3, 14_400)


_CYCLE_T = f"with {T}, z as (select distinct from_account as a, to_account as b, cast(floor(epoch(timestamp)) as bigint) as s, amount_paid as m from t where from_account <> to_account)"


@query("N4_cycles_2", f"{_CYCLE_T} select x.a || '>' || y.a as ring, x.s as first_s, y.s as last_s, cast(cast(x.m as decimal(18,4)) + cast(y.m as decimal(18,4)) as double) as total from z x join z y on y.a = x.b and y.s > x.s and y.s <= x.s + 14400 and y.b = x.a")
def n4_2(spark, sf_dir):
    return network.cycles(transfers(spark, sf_dir), 2, 14_400)


@query("N4_cycles_4", f"{_CYCLE_T} select x.a || '>' || y.a || '>' || w.a || '>' || v.a as ring, x.s as first_s, v.s as last_s, cast(cast(x.m as decimal(18,4)) + cast(y.m as decimal(18,4)) + cast(w.m as decimal(18,4)) + cast(v.m as decimal(18,4)) as double) as total from z x join z y on y.a = x.b and y.s > x.s and y.s <= x.s + 14400 join z w on w.a = y.b and w.s > y.s and w.s <= y.s + 14400 join z v on v.a = w.b and v.s > w.s and v.s <= w.s + 14400 and v.b = x.a where y.b <> x.a and w.b <> x.a and w.b <> y.a")
def n4_4(spark, sf_dir):
    """Rings of four accounts, as the reference deals them."""
    return network.cycles(transfers(spark, sf_dir), 4, 14_400)


@query("N5_scatter_gather", f"with {T} select a.date, a.from_account as source, b.to_account as sink, count(distinct a.to_account) as middles from t a join t b on a.date = b.date and a.to_account = b.from_account and a.timestamp < b.timestamp where a.from_account <> a.to_account and b.from_account <> b.to_account and a.from_account <> b.to_account group by all having count(distinct a.to_account) >= 2")
def n5(spark, sf_dir):
    return network.scatter_gather(transfers(spark, sf_dir))


# the fitted model and whole jobs ---------------------------------------------------------------------------------


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, model.RiskModel, DataFrame]:
    """Account-days, the model of the early ones, and the scores of all."""
    f = written(days(spark, sf_dir), "features")
    return f, *model.fit_score(f, split.cutoff(f, FRACTION))


@query("M5_model_scores")
def m5(spark, sf_dir):
    """M2, M5, M7, M10: segments, forests and the map of the fitted model, for every account-day."""
    return _fitted(spark, sf_dir)[2]


@query("S5_saved_model")
def s5(spark, sf_dir):
    """Scores of the model after saving and loading, beside those before."""
    f, fitted, scored = _fitted(spark, sf_dir)
    path = shared_path(spark, "model")
    fitted.save(spark, path)
    again = model.RiskModel.load(spark, path)
    return scored.select("case_id", "risk_score").join(again.score(f).select("case_id", F.col("risk_score").alias("again")), "case_id")


@query("B1_pipeline")
def b1(spark, sf_dir):
    """S2-S5 with it: the whole run; its metrics."""
    return runs.run_pipeline(transfers(spark, sf_dir), shared_path(spark, "run"), BUDGET)[1]


@query("B2_benchmark")
def b2(spark, sf_dir):
    """S6-S8, S10 with it: the benchmark's summary."""
    return runs.run_benchmark(transfers(spark, sf_dir), shared_path(spark, "bench"), check_size=False)


def _console(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return runs.console_tables(transfers(spark, sf_dir), written(stand_in(spark, sf_dir)), BUDGET)


@query("B3_console", f"with recursive {TOP}, {names_sql('s')} select rank, case_id, cluster_name, risk_score from k join nm using (cluster)")
def b3(spark, sf_dir):
    """The console's queue on the stand-in scores, with names from the profiles of all rows."""
    return _console(spark, sf_dir)["queue"].select("rank", "case_id", "cluster_name", "risk_score")


@query("B3_profiles", f"with recursive {SCORED}, {names_sql('s')} select cluster, cluster_name, cases, {_round(*MEDIANS)} from pr join nm using (cluster)")
def b3_profiles(spark, sf_dir):
    return rounded(_console(spark, sf_dir)["profiles"].select("cluster", "cluster_name", "cases", *MEDIANS))


@query("B3_metrics", METRICS_SQL)
def b3_metrics(spark, sf_dir):
    return rounded(_console(spark, sf_dir)["metrics"])


@query("B3_curve", f"{CURVE_SQL} select capacity, hits, {_round('precision', 'recall', 'lift')}, detected_value from v")
def b3_curve(spark, sf_dir):
    return rounded(_console(spark, sf_dir)["curve"])


@query("B3_nodes", SQL["N2_ego_nodes"])
def b3_nodes(spark, sf_dir):
    return _console(spark, sf_dir)["nodes"]


@query("B3_edges", SQL["N1_ego_edges"])
def b3_edges(spark, sf_dir):
    return _console(spark, sf_dir)["edges"]


@query("S6_capacity_curve", SQL["K4_curve"])
def s6(spark, sf_dir):
    """The curve as a CSV in two folders; the second is read back."""
    one, two = shared_path(spark, "curve"), shared_path(spark, "report")
    sinks.write_small_csv(k4(spark, sf_dir).orderBy("capacity"), one, two)
    return sinks.read_small_csv(spark, two, "capacity int, hits long, precision double, recall double, lift double, detected_value double")


@query("S6_profiles", f"with recursive {SCORED}, {names_sql('e')} select cluster, cluster_name, cases, {_round(*MEDIANS)} from pr join nm using (cluster)")
def s6_profiles(spark, sf_dir):
    path = shared_path(spark, "profiles")
    found = rounded(runs.named_profiles(written(late(spark, sf_dir))).select("cluster", "cluster_name", "cases", *MEDIANS))
    sinks.write_small_csv(found.orderBy("cluster"), path)
    return sinks.read_small_csv(spark, path, found.schema)


@query(
    "S7_summary",
    METRICS_SQL.replace(" from tot, h, ap", f""", (select count(*) from t) as transactions, {', '.join(f"(select {f} from s where date {'<=' if p == 'train' else '>'} cutoff) as {p}_{n}" for p in ('train', 'evaluation') for n, f in (('first_date', 'min(date)'), ('last_date', 'max(date)'), ('cases', 'count(*)')))}, least(25, cases // 10) as n_capacities from tot, h, ap"""),
)
def s7(spark, sf_dir):
    """The benchmark's summary of the stand-in scores, written as JSON and read back (S10); the list of capacities by its length."""
    rows = written(stand_in(spark, sf_dir))
    cut = split.cutoff(rows, FRACTION)
    late_rows = written(split.evaluation_rows(rows, cut))
    curve = evaluation.capacity_curve(late_rows, budgets_of(late_rows))
    found = runs.summary(transfers(spark, sf_dir).count(), rows, cut, written(evaluation.metrics(late_rows, BUDGET)), curve)
    path = shared_path(spark, "summary")
    sinks.write_json(found, path)
    return rounded(sinks.read_json(spark, path, found.schema).withColumn("n_capacities", F.size("capacity_results").cast("long")).drop("capacity_results"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
