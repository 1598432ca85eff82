"""Names and fixed values of the account-day model."""

from __future__ import annotations

#: Canonical transaction columns, in order.
TRANSACTION_COLUMNS = ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering"]

#: Feature name, label in texts, group of which one factor is named, kind of number.
FEATURES = (
    ("out_tx_count", "outgoing transaction velocity", "transaction_count", "count"),
    ("in_tx_count", "incoming transaction velocity", "transaction_count", "count"),
    ("out_total", "outgoing value", "transaction_value", "money"),
    ("in_total", "incoming value", "transaction_value", "money"),
    ("out_mean", "average outgoing amount", "typical_amount", "money"),
    ("in_mean", "average incoming amount", "typical_amount", "money"),
    ("out_max", "largest outgoing payment", "largest_amount", "money"),
    ("in_max", "largest incoming payment", "largest_amount", "money"),
    ("unique_out_counterparties", "outgoing counterparties", "counterparties", "count"),
    ("unique_in_counterparties", "incoming counterparties", "counterparties", "count"),
    ("unique_out_banks", "destination-bank diversity", "banks", "count"),
    ("unique_in_banks", "source-bank diversity", "banks", "count"),
    ("active_out_hours", "active-hour spread", "active_out_hours", "count"),
    ("cash_share", "cash-payment share", "cash_share", "share"),
    ("cross_currency_share", "cross-currency activity", "cross_currency_share", "share"),
    ("reciprocal_counterparties", "reciprocal counterparties", "counterparties", "count"),
    ("total_tx_count", "total transaction velocity", "transaction_count", "count"),
    ("total_value", "total value moved", "transaction_value", "money"),
    ("flow_ratio", "incoming/outgoing flow imbalance", "flow_ratio", "number"),
)
FEATURE_COLUMNS = [f[0] for f in FEATURES]
LABEL = "is_laundering"
#: Features taken as they are; the others go through log1p.
LINEAR = ("cash_share", "cross_currency_share", "flow_ratio")

#: Median column of a segment profile, name when high, name when low.
SEGMENT_NAMES = (
    ("median_transactions", "High-frequency activity", "Low-frequency activity"),
    ("median_value", "High-value movers", "Low-value activity"),
    ("median_counterparties", "Broad counterparty network", "Concentrated counterparties"),
    ("median_cross_currency_share", "Cross-currency activity", "Domestic-currency activity"),
    ("median_cash_share", "Cash-oriented activity", "Low-cash activity"),
    ("median_flow_ratio", "Net receivers", "Net senders"),
)
