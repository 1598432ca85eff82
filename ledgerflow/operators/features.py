"""Account-day features.

Each transfer gives two legs, one for each side, that are summed by day and account. Counterparties and banks are grouped
by day and pair first, and come to the same sums as flags: two shuffles of shrinking rows of fixed width replace five
distinct counts, a self-join and two outer joins, and a hub account is spread over its counterparties. Money is summed exactly, to four places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.schema import FEATURE_COLUMNS, LABEL
from ledgerflow.sources.transactions import derived

MONEY = "decimal(18,4)"


def _money(c: str) -> Column:
    return F.sum(F.col(c).cast(MONEY))


def outgoing(tx: DataFrame) -> DataFrame:
    """Sums by day and sender."""
    return derived(tx).groupBy("date", F.col("from_account").alias("account_id")).agg(
        F.count("*").alias("out_tx_count"), _money("amount_paid").cast("double").alias("out_total"), (_money("amount_paid").cast("double") / F.count("amount_paid")).alias("out_mean"), F.max("amount_paid").alias("out_max"),
        F.count_distinct("to_account").alias("unique_out_counterparties"), F.count_distinct("to_bank").alias("unique_out_banks"), F.bit_count(F.bit_or(F.expr("shiftleft(1, hour)"))).cast("long").alias("active_out_hours"),
        F.avg("is_cash").alias("cash_share"), F.avg("is_cross_currency").alias("cross_currency_share"), F.max(LABEL).alias("out_label"),
    )


def incoming(tx: DataFrame) -> DataFrame:
    """Sums by day and receiver."""
    return derived(tx).groupBy("date", F.col("to_account").alias("account_id")).agg(
        F.count("*").alias("in_tx_count"), _money("amount_received").cast("double").alias("in_total"), (_money("amount_received").cast("double") / F.count("amount_received")).alias("in_mean"), F.max("amount_received").alias("in_max"),
        F.count_distinct("from_account").alias("unique_in_counterparties"), F.count_distinct("from_bank").alias("unique_in_banks"), F.max(LABEL).alias("in_label"),
    )


def legs(tx: DataFrame) -> DataFrame:
    """Two rows a transfer: what its sender and what its receiver sees."""
    side = lambda out, account, money: F.struct(
        F.lit(out).alias("out"), F.col(account).alias("account_id"), F.col(money).alias("amount"),
        F.expr("shiftleft(1, hour)").alias("hours"), "is_cash", "is_cross_currency", F.col(LABEL).alias("label"),
    )
    both = F.array(side(True, "from_account", "amount_paid"), side(False, "to_account", "amount_received"))
    return derived(tx).select("date", F.inline(both))


def met(tx: DataFrame) -> DataFrame:
    """(date, account_id, other, party, paid, received): each counterparty (party) and each counterparty's bank that an account paid or was paid by on a day.

    The two accounts of a transfer are one key in their order, whichever of them paid. Values are of fixed width, so that
    hash aggregation does it: sets of banks were sorted.
    """
    sender, receiver = F.col("from_account"), F.col("to_account")
    turned, own = F.coalesce(receiver < sender, receiver.isNull()), sender.eqNullSafe(receiver)
    row = lambda party, a, b, there, back: F.struct(F.lit(party).alias("party"), a.alias("a"), b.alias("b"), there.alias("there"), back.alias("back"))
    pair = row(True, F.when(turned, receiver).otherwise(sender), F.when(turned, sender).otherwise(receiver), ~turned | own, turned | own)
    banks = row(False, sender, F.col("to_bank"), F.lit(True), F.lit(False)), row(False, receiver, F.col("from_bank"), F.lit(False), F.lit(True))
    keys = derived(tx).select("date", F.inline(F.array(pair, *banks))).where("party or b is not null")
    once = keys.groupBy("date", "party", "a", "b").agg(F.max("there").alias("there"), F.max("back").alias("back"))
    seen = lambda a, b, paid, received: F.struct(F.col(a).alias("account_id"), F.col(b).alias("other"), F.col(paid).alias("paid"), F.col(received).alias("received"))
    one, two = seen("a", "b", "there", "back"), seen("b", "a", "back", "there")
    return once.select("date", "party", F.inline(F.when(F.col("party") & ~F.col("a").eqNullSafe(F.col("b")), F.array(one, two)).otherwise(F.array(one))))


def account_days(tx: DataFrame) -> DataFrame:
    """case_id, date, account_id, the 19 features, label: one row for each account and day."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out, inn, party, paid, received = F.col("out"), ~F.col("out"), F.col("party"), F.col("paid"), F.col("received")
    pick = lambda side, c: F.when(side, F.col(c))
    both = legs(tx).unionByName(met(tx).drop("other"), allowMissingColumns=True)
    day = both.groupBy("date", "account_id").agg(
        F.count_if(out).alias("out_tx_count"), F.count_if(inn).alias("in_tx_count"),
        F.sum(pick(out, "amount").cast(MONEY)).alias("out_sum"), F.sum(pick(inn, "amount").cast(MONEY)).alias("in_sum"),
        F.count(pick(out, "amount")).alias("out_known"), F.count(pick(inn, "amount")).alias("in_known"),
        zero(F.max(pick(out, "amount"))).alias("out_max"), zero(F.max(pick(inn, "amount"))).alias("in_max"),
        F.count_if(party & paid).alias("unique_out_counterparties"), F.count_if(party & received).alias("unique_in_counterparties"),
        F.count_if(~party & paid).alias("unique_out_banks"), F.count_if(~party & received).alias("unique_in_banks"),
        F.coalesce(F.bit_count(F.bit_or(pick(out, "hours"))), F.lit(0)).cast("long").alias("active_out_hours"),
        F.sum(pick(out, "is_cash")).alias("cash"), F.sum(pick(out, "is_cross_currency")).alias("cross"),
        F.count_if(party & paid & received).alias("reciprocal_counterparties"), F.max("label").alias(LABEL),
    )
    money = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    full = day.withColumns(
        {
            "case_id": F.concat(F.date_format("date", "yyyyMMdd"), F.lit("-"), "account_id"),
            "out_total": money("out_sum"), "in_total": money("in_sum"),
            "out_mean": zero(F.try_divide(F.col("out_sum").cast("double"), "out_known")), "in_mean": zero(F.try_divide(F.col("in_sum").cast("double"), "in_known")),
            "cash_share": zero(F.try_divide(F.col("cash").cast("double"), "out_tx_count")), "cross_currency_share": zero(F.try_divide(F.col("cross").cast("double"), "out_tx_count")),
            "total_tx_count": F.col("out_tx_count") + F.col("in_tx_count"),
            "total_value": (F.coalesce("out_sum", F.lit(0)) + F.coalesce("in_sum", F.lit(0))).cast("double"),
            "flow_ratio": F.log1p(money("in_sum")) - F.log1p(money("out_sum")),
        }
    )
    return full.select("case_id", "date", "account_id", *FEATURE_COLUMNS, LABEL)


def pairs(tx: DataFrame) -> DataFrame:
    """Distinct (date, from, to)."""
    return derived(tx).select("date", "from_account", "to_account").distinct()


def reciprocal_pairs(tx: DataFrame) -> DataFrame:
    """Pairs of a day that exist in both directions; a transfer to oneself is its own reciprocal."""
    both = met(tx).where("party and paid and received")
    return both.select("date", F.col("account_id").alias("from_account"), F.col("other").alias("to_account"))


def reciprocal_counts(tx: DataFrame) -> DataFrame:
    return reciprocal_pairs(tx).groupBy("date", F.col("from_account").alias("account_id")).agg(F.count("*").alias("reciprocal_counterparties"))


def joined_sides(tx: DataFrame) -> DataFrame:
    """The literal form: both aggregates joined, so that accounts of one side survive."""
    return outgoing(tx).join(incoming(tx), ["date", "account_id"], "full").fillna(0)


def with_reciprocal(sides: DataFrame, counts: DataFrame) -> DataFrame:
    """The literal form: reciprocal counts joined to the sides, 0 where an account has none."""
    return sides.join(counts, ["date", "account_id"], "left").fillna(0, ["reciprocal_counterparties"])


def cases_per_day(features: DataFrame) -> DataFrame:
    return features.groupBy("date").agg(F.count("*").alias("cases"))


def checks(features: DataFrame) -> DataFrame:
    """One row: rows, distinct keys, rows with a missing feature."""
    lost = F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in FEATURE_COLUMNS)) > 0)
    return features.groupBy("date", "account_id").agg(F.count("*").alias("n"), lost.alias("lost")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum("lost").alias("n_missing"))
