"""Account-day library: fixtures with known answers, and the SQL forms on the small tables."""

import datetime as dt
import pathlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow import queries as core
from ledgerflow.functions.schema import FEATURE_COLUMNS, FEATURES, SEGMENT_NAMES, TRANSACTION_COLUMNS
from ledgerflow.jobs import runs
from ledgerflow.operators import evaluation, explain, features, model, network, quantiles, ranking, segments, split
from ledgerflow.sources import storage, transactions

TX = "timestamp string, from_bank string, from_account string, to_bank string, to_account string, amount_received double, receiving_currency string, amount_paid double, payment_currency string, payment_format string, is_laundering int"


def tx(spark, rows):
    return transactions.normalised(spark.createDataFrame([(t, "1", a, "2", b, float(m), c, float(m), "US Dollar", f, y) for t, a, b, m, f, c, y in rows], TX))


@pytest.fixture(scope="module")
def day(spark):
    d = "2024-01-01 "
    return tx(spark, [(d + "01:00", "A", "B", 100, "Cash", "US Dollar", 0), (d + "01:30", "A", "B", 50, "Wire", "Euro", 1), (d + "02:00", "B", "A", 30, "Wire", "US Dollar", 0), (d + "03:00", "A", "A", 7, "Wire", "US Dollar", 0)])


def test_account_days_by_hand(day):
    got = {r["account_id"]: r for r in features.account_days(day).collect()}
    a, b = got["A"], got["B"]
    assert (a["out_tx_count"], a["out_total"], a["out_max"], a["in_tx_count"], a["in_total"], a["in_max"]) == (3, 157, 100, 2, 37, 30)
    assert (a["unique_out_counterparties"], a["unique_in_counterparties"], a["active_out_hours"], a["reciprocal_counterparties"], a["total_tx_count"], a["total_value"], a["is_laundering"]) == (2, 2, 2, 2, 5, 194, 1)
    assert a["cash_share"] == pytest.approx(1 / 3) and a["cross_currency_share"] == pytest.approx(1 / 3)
    assert (b["out_tx_count"], b["in_tx_count"], b["reciprocal_counterparties"], b["total_value"], b["cash_share"], b["is_laundering"]) == (1, 2, 1, 180, 0, 1)


def test_account_days_are_hash_sums(spark):
    """Counterparties and banks of a day against plain sets (banks that differ for one pair, transfers to oneself, missing ids), without an aggregate that sorts."""
    rng, ids = np.random.default_rng(3), ["A", "B", "C", "D", None]
    pick = lambda of: of[rng.integers(len(of))]
    moves = [(dt.datetime(2024, 1, 1 + int(rng.integers(2)), int(rng.integers(24))), pick(["1", "2", None]), pick(ids), pick(["1", "2", "3", None]), pick(ids)) for _ in range(60)]
    kind = "timestamp timestamp_ntz, from_bank string, from_account string, to_bank string, to_account string"
    fixed = {"amount_received": F.lit(2.0), "receiving_currency": F.lit("Euro"), "amount_paid": F.lit(3.0), "payment_currency": F.lit("Euro"), "payment_format": F.lit("Wire"), "is_laundering": F.lit(0)}
    days = features.account_days(spark.createDataFrame(moves, kind).withColumns(fixed))
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    got = {(r["date"], r["account_id"]): r for r in days.collect()}
    assert set(got) == {(t.date(), a) for t, _, f, _, g in moves for a in (f, g)}
    for (day, a), r in got.items():
        paid, received = [(b, g) for t, _, f, b, g in moves if t.date() == day and f == a], [(b, f) for t, b, f, _, g in moves if t.date() == day and g == a]
        to, by = {g for _, g in paid}, {f for _, f in received}
        want = [len(paid), len(received), len(to), len(by), len({b for b, _ in paid} - {None}), len({b for b, _ in received} - {None}), len(to & by), 3.0 * len(paid), 2.0 * len(received)]
        assert [r[c] for c in ("out_tx_count", "in_tx_count", "unique_out_counterparties", "unique_in_counterparties", "unique_out_banks", "unique_in_banks", "reciprocal_counterparties", "out_total", "in_total")] == want


def test_raw_csv_header_times_and_nulls(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    (tmp_path / "a.csv").write_text(head + "2022/09/01 00:20,1,A,2,B,-5,Euro,10.0,,Wire,\n2025-01-01 10:00,1,A,2,B,NA,Euro,10.0,Euro,cash,1\n")
    first, second = transactions.read_csv(spark, str(tmp_path / "a.csv")).orderBy("timestamp").collect()
    assert (first["from_account"], first["to_account"], first["timestamp"], first["amount_received"], first["is_laundering"]) == ("A", "B", dt.datetime(2022, 9, 1, 0, 20), 0.0, 0)
    assert second["amount_received"] is None and second["is_laundering"] == 1
    flags = transactions.derived(transactions.read_csv(spark, str(tmp_path / "a.csv"))).orderBy("timestamp").collect()
    assert [r["is_cross_currency"] for r in flags] == [1, 0] and [r["is_cash"] for r in flags] == [0, 1]
    with pytest.raises(ValueError, match="payment_format"):
        transactions.required(spark.createDataFrame([(1,)], "timestamp int"))
    with pytest.raises(Exception, match="(?i)cast|malformed|invalid"):
        bad = (tmp_path / "b.csv")
        bad.write_text(head + "2022/09/01 00:20,1,A,2,B,x,Euro,10.0,Euro,Wire,0\n")
        transactions.read_csv(spark, str(bad)).collect()


def test_histogram_bins_every_score_as_the_sql_does(spark):
    """All scores of two decimals, edges of bins too (62.5 stood one bin higher before)."""
    scored = spark.range(10_001).select((F.col("id") / 100.0).alias("risk_score"))
    sql = core.oracle_sql()["A13_histogram"]
    bins = duckdb.sql(f"with e as (select range / 100.0::double as risk_score from range(10001)) {sql[sql.rindex('select cast(least('):]}").fetchall()
    assert sorted(map(tuple, evaluation.risk_histogram(scored).collect())) == sorted(bins)


def test_quantiles_open_no_row_for_each_value(spark):
    """Both passes read the rows as they are: none is made for each column of each row (24,000 here), and what the second hands on are values inside brackets."""
    d = spark.range(8_000).select(*(F.xxhash64("id", F.lit(k)).cast("double").alias(f"v{k}") for k in range(3)))
    bounds = {0: {i: ([-1e17], [1e17]) for i in range(3)}}
    rows = d.select(F.lit(0).alias("g_"), *(F.col(f"v{k}").alias(f"c{k}") for k in range(3))).repartition(2).mapInArrow(quantiles._counts(bounds), "g_ int, i_ int, p int, value double, n bigint").collect()
    assert len(rows) < 1_000 and {r["i_"] for r in rows} == {0, 1, 2}
    want = [d.where(f"v{k} < -1e17").count() for k in range(3)]
    assert [sum(r["n"] for r in rows if r["i_"] == k and r["value"] is None) for k in range(3)] == want
    odd = spark.createDataFrame([(0, float("nan")), (0, 1.0), (0, None), (0, -0.0), (0, float("nan"))], "g_ int, c0 double").coalesce(1)
    got = odd.mapInArrow(quantiles._counts({0: {0: ([0.0, float("nan")], [1.0, float("nan")])}}), "g_ int, i_ int, p int, value double, n bigint").collect()
    assert sorted((r["p"], str(r["value"]), r["n"]) for r in got) == [(0, "-0.0", 1), (0, "1.0", 1), (0, "None", 0), (1, "None", 2), (1, "nan", 2)]


def test_forest_walk_is_the_trees_own(spark):
    """Every point ends in the leaf that its comparisons lead to, infinities and NaN too."""
    rng = np.random.default_rng(2)
    rows = [(0, t, k, *r) for t in range(5) for k, r in enumerate(model.grow(rng.normal(size=(64, 4)).round(1), rng))]
    forest = model.Forest.of(model.pd.DataFrame(rows, columns=[c.split()[0] for c in model.TREE.split(", ")]), 64)
    x = rng.normal(size=(50, 4)).round(1)
    x[0], x[1, 2], x[2, 1] = np.inf, -np.inf, np.nan
    nodes = {(t, k): r for _, t, k, *r in rows}
    for point, got in zip(x, forest.anomaly(x), strict=True):
        total = 0.0
        for t in range(5):
            at = 0
            while nodes[t, at][0] >= 0:
                f, threshold, left, right, _ = nodes[t, at]
                at = left if point[f] <= threshold else right
            total += nodes[t, at][4]
        assert got == 2.0 ** (-total / 5 / model.mean_path(64))


def test_factors_by_hand(spark):
    """Values, ties, idle senders, missing values and segments against a plain walk; no lambda over the features runs for each row."""
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 4), *(None if rng.random() < 0.1 else float(rng.integers(0, 4)) for _ in FEATURE_COLUMNS)) for i in range(300)]
    data = spark.createDataFrame(rows, "id int, cluster int, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))
    base = {(k, f): (float(rng.integers(0, 3)), float(rng.integers(1, 3))) for k in range(3) for f in FEATURE_COLUMNS}
    told = explain.factors(data, spark.createDataFrame([(*key, *v) for key, v in base.items()], "cluster int, feature string, median double, scale double"))
    assert "lambda" not in told._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: [tuple(x) for x in r["factors"]] for r in told.collect()}
    for i, k, *values in rows:
        keys = []
        for place, (v, (f, _, group, kind)) in enumerate(zip(values, FEATURES, strict=True)):
            median, scale = base.get((k, f), (None, None))
            if kind == "share" and values[0] == 0:
                keys.append((float("inf"), place, group, f, v, median))
            elif v is not None and median is not None:
                keys.append((-abs((v - median) / scale), place, group, f, v, median))
        want, met = [], set()
        for key, _, group, f, v, median in sorted(keys, key=lambda x: x[:2]):
            if group not in met and len(want) < 3:
                met.add(group)
                want.append((f, -key, v, median))
        assert got[i] == want


def test_nearest_centres_in_the_tasks(spark):
    """As the column expressions had it: ties to the lowest number, a missing value gives no distance, NaN the largest."""
    rows = [(0.0, 0.0), (1.0, 0.0), (5.0, 5.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)]
    near = segments.assigned(spark.createDataFrame(rows, "a double, b double").coalesce(1), ["a", "b"], {4: [2.0, 0.0], 1: [0.0, 0.0], 7: [5.0, 4.0]})
    assert "ArrowEvalPython" in near._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["cluster"], str(r["center_distance"])) for r in near.collect()]
    assert got == [(1, "0.0"), (1, "1.0"), (7, "1.0"), (1, "None"), (1, "nan"), (1, "inf")]


def test_runs_send_each_row_through_the_forests_once(spark, tmp_path, monkeypatch):
    """Training rows were scored for the references, and then again with all others."""
    passes, scored = [], model.RiskModel._scored
    monkeypatch.setattr(model.RiskModel, "_scored", lambda self, rows: passes.append(1) or scored(self, rows))
    f = storage.written(core.days(spark, "/root/testdata/sf0.001"))
    last = split.cutoff(f)
    fitted, together = model.fit_score(f, last, starts=2)
    assert len(passes) == 1
    apart = model.fit(split.train_rows(f, last), starts=2).score(f)
    assert apart.columns == together.columns and sorted(map(tuple, apart.collect())) == sorted(map(tuple, together.collect())) and fitted.baseline.count() > 0


def test_split_by_volume(spark):
    rows = [(dt.date(2024, 1, d), f"c{d}-{i}") for d, n in ((1, 70), (2, 20), (3, 5), (4, 5)) for i in range(n)]
    f = spark.createDataFrame(rows, "date date, case_id string")
    assert split.cutoff(f, 0.7) == dt.date(2024, 1, 1) and split.train_rows(f, split.cutoff(f, 0.7)).count() == 70
    tie = spark.createDataFrame([(dt.date(2024, 1, d), str(d)) for d in (1, 2, 3)], "date date, case_id string")
    assert split.cutoff(tie, 0.5) == dt.date(2024, 1, 1)
    for bad in (0, 1):
        with pytest.raises(ValueError):
            split.cutoff(f, bad)
    with pytest.raises(ValueError):
        split.cutoff(tie.limit(1), 0.5)


def test_evaluation_sample(spark):
    s = spark.createDataFrame([("a", 99.0, 1, 1000.0), ("b", 90.0, 0, 500.0), ("c", 20.0, 1, 250.0), ("d", 10.0, 0, 100.0)], "case_id string, risk_score double, is_laundering int, total_value double")
    m = evaluation.metrics(s, 2).first()
    assert (m["precision_at_k"], m["recall_at_k"], m["lift_at_k"], m["detected_value"]) == (0.5, 0.5, 1.0, 1000.0)
    assert m["pr_auc"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    curve = {r["capacity"]: r for r in evaluation.capacity_curve(s, evaluation.capacities([1, 2, 4, 9], 4)).collect()}
    assert [curve[k]["hits"] for k in (1, 2, 4)] == [1, 1, 2] and [curve[k]["recall"] for k in (1, 2, 4)] == [0.5, 0.5, 1.0]
    with pytest.raises(ValueError):
        evaluation.rank_alerts(s, 0)
    none = evaluation.metrics(s.withColumn("is_laundering", F.lit(0)), 2).first()
    assert none["recall_at_k"] == none["lift_at_k"] == none["pr_auc"] == 0


def test_texts_and_names(spark):
    row = {c: 0.0 for c in FEATURE_COLUMNS} | {"out_tx_count": 1, "cross_currency_share": 1.0, "case_id": "x", "cluster": 0}
    base = spark.createDataFrame([(0, c, 0.0, 0.001 if c == "cross_currency_share" else 1000.0) for c in FEATURE_COLUMNS], "cluster int, feature string, median double, scale double")
    got = explain.explained(spark.createDataFrame([row]).withColumn("out_tx_count", F.col("out_tx_count").cast("long")), base).first()
    assert "1 of 1 outgoing transaction (100%)" in got["alert_reason"] and "limited sample" in got["alert_reason"] and got["alert_factors"].count(" • ") == 2
    rows = [{"cluster": k} | {m: float((k + 1) * (i + 1) if k == i else 1) for i, (m, *_) in enumerate(SEGMENT_NAMES)} for k in range(3)]
    assert len(set(segments.segment_names(rows).values())) == 3


def test_networks(spark, day):
    alerts = spark.createDataFrame([("x", dt.date(2024, 1, 1), "A")], "case_id string, date date, account_id string")
    edges = network.ego_edges(day, alerts)
    assert {(r["from_account"], r["to_account"]): r["weight"] for r in edges.collect()} == {("A", "B"): 150.0, ("B", "A"): 30.0, ("A", "A"): 7.0}
    assert {r["node"]: r["degree"] for r in network.ego_nodes(edges, alerts).collect()} == {"A": 4, "B": 2}
    ring = tx(spark, [(f"2024-01-02 02:{7 * i:02d}", a, b, 1000 * (1 - 0.008 * i), "Wire", "US Dollar", 1) for i, (a, b) in enumerate((("A", "B"), ("B", "C"), ("C", "D"), ("D", "A")))] + [(f"2024-01-02 04:{3 * i:02d}", "H", f"T{i}", 20000, "Wire", "Euro", 1) for i in range(3)])
    assert [r["ring"] for r in network.cycles(ring, 4, 900).collect()] == ["A>B>C>D"]
    assert [(r["hub"], r["most"]) for r in network.fans(ring, True, 600).collect()] == [("H", 3)]


def test_cycles_of_each_registered_length(spark, tmp_path):
    """Rings of 2, 3 and 4 accounts among few accounts: brute force, the registered queries and their SQL forms agree."""
    rng = np.random.default_rng(6)
    start = dt.datetime(2024, 1, 1)
    events = [(k, start + dt.timedelta(minutes=int(rng.integers(0, 3000))), int(rng.integers(1, 7)), "view", float(rng.integers(100, 9000)) / 100, f'{{"k": {rng.integers(1, 7)}}}') for k in range(90)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    moves = {(r["from_account"], r["to_account"], int((r["timestamp"] - start).total_seconds()), round(100 * r["amount_paid"])) for r in core.transfers(spark, str(tmp_path)).collect()}
    paths = [[m] for m in moves if m[0] != m[1]]
    shift = int(start.replace(tzinfo=dt.timezone.utc).timestamp())
    for length, key in ((2, "N4_cycles_2"), (3, "N4_cycles"), (4, "N4_cycles_4")):
        paths = [[*p, m] for p in paths for m in moves if m[0] != m[1] and m[0] == p[-1][1] and p[-1][2] < m[2] <= p[-1][2] + 14_400]
        rings = [p for p in paths if p[-1][1] == p[0][0] and len({m[0] for m in p}) == length]
        want = sorted((">".join(m[0] for m in p), p[0][2] + shift, p[-1][2] + shift, sum(m[3] for m in p) / 100) for p in rings)
        assert want
        assert sorted(map(tuple, core.QUERIES[key](spark, str(tmp_path)).select("ring", "first_s", "last_s", "total").collect())) == want
        assert sorted(con.sql(core.SQL[key]).fetchall()) == want


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(0, 1, (300, 3)), [[9, 9, 9]]])
    import pandas as pd

    nodes = pd.DataFrame([(t, k, *r) for t in range(50) for k, r in enumerate(model.grow(points[rng.choice(301, 256, False)], np.random.default_rng(t)))], columns=["tree", "node", "feature", "threshold", "left", "right", "length"])
    assert model.Forest.of(nodes, 256).anomaly(points).argmax() == 300


@pytest.mark.parametrize("key", ["A5_account_days", "W1_cutoff", "A9_scaler", "A8_baselines", "A10_metrics", "K4_curve", "N2_ego_nodes", "S3_queue", "W4_ecdf", "W4_ecdf_large", "J2_with_reciprocal", "P6_odd_values"])
def test_sql_form(spark, key):
    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{where}/events.parquet'")
    rel = con.sql(core.SQL[key])
    columns = sorted(rel.columns)
    want = sorted(repr([round(v, 5) if isinstance(v, float) else v for v in (r[rel.columns.index(c)] for c in columns)]) for r in rel.fetchall())
    df = core.QUERIES[key](spark, where)
    assert sorted(df.columns) == columns
    assert sorted(repr([round(r[c], 5) if isinstance(r[c], float) else r[c] for c in columns]) for r in df.collect()) == want


def test_partitions_do_not_matter(spark):
    t = core.transfers(spark, "/root/testdata/sf0.001")
    first = sorted(map(tuple, core.rounded(features.account_days(t)).collect()))
    assert first == sorted(map(tuple, core.rounded(features.account_days(t.repartition(7))).collect()))
    assert t.columns == TRANSACTION_COLUMNS


def test_size_guard_and_missing_file(spark, day, tmp_path):
    with pytest.raises(ValueError, match="at least 5000000"):
        transactions.guard_size(day)
    assert transactions.guard_size(day, least=4) == 4
    with pytest.raises(ValueError, match="transactions"):
        runs.run_benchmark(day, str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        transactions.read_csv(spark, str(tmp_path / "none.csv")).count()


def test_fingerprint_has_no_order(day):
    rows = [transactions.fingerprint(d).first() for d in (day, day.orderBy(F.desc("timestamp")).repartition(3), day.union(day))]
    assert rows[0] == rows[1] != rows[2]


@pytest.mark.parametrize("most", [0, 1_000])
def test_references_are_exact_at_any_size(spark, most):
    """In the tasks and as a table: ties, values beyond both ends and between, a segment without a reference."""
    rows = [(k % 2, float((k * 37) % 101)) for k in range(200)] + [(3, 5.0)]
    d = spark.createDataFrame(rows, "cluster int, x double")
    asked = d.unionByName(spark.createDataFrame([(0, -1.0), (0, 50.5), (1, 1e9), (3, 4.0), (7, 1.0)], d.schema)).repartition(3)
    ref = model.Reference.of(d, "x", most)
    assert (ref.arrays is None) == (most == 0)
    got = ref.shares(asked, "x", "s").collect()
    of = {k: [x for c, x in rows if c == k] for k in (0, 1, 3, 7)}
    assert len(got) == 206 and all(r["s"] == sum(y <= r["x"] for y in of[r["cluster"]]) / max(len(of[r["cluster"]]), 1) for r in got)


def test_ranks_over_ranges(spark):
    """Places in the whole and in groups, running sums of a large budget, on ties and repeated rows, as sorting gives them."""
    rng = np.random.default_rng(3)
    rows = [(f"c{k:04d}", float(rng.integers(0, 30)), int(rng.integers(0, 2)), float(k)) for k in range(2000)]
    d = spark.createDataFrame(rows, "case_id string, risk_score double, is_laundering int, total_value double").repartition(7)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r["case_id"] for r in evaluation.ranked_cases(d).orderBy("rank").collect()] == [r[0] for r in want]
    small, short = evaluation.running(d, 700).orderBy("rank").collect(), evaluation.SHORT
    try:
        evaluation.SHORT = 10
        assert evaluation.running(d, 700).orderBy("rank").collect() == small
        assert evaluation.queue(d, 5000).count() == 2000 and evaluation.queue(d.limit(0), 50).count() == 0
    finally:
        evaluation.SHORT = short
    assert [(r["rank"], r["case_id"], r["hits"]) for r in small] == [(k + 1, r[0], sum(x[2] for x in want[: k + 1])) for k, r in enumerate(want[:700])]
    per = ranking.ranked(d.unionByName(d), [F.col("case_id")], ["is_laundering"]).collect()
    for g in (0, 1):
        mine = sorted((r["rank"], r["case_id"]) for r in per if r["is_laundering"] == g)
        assert mine == list(enumerate(sorted([r[0] for r in rows if r[2] == g] * 2), 1))


def test_trees_are_dealt_evenly(spark):
    """Few and many rows: each tree gets about as many rows, no matter how many rows or trees there are, and few rows go to all trees."""
    from pyspark.sql import functions as F

    for n, trees in ((300, 50), (4_000, 200), (200_000, 250)):
        dealt = spark.range(n).select(F.explode(model._trees_of(F.col("id").cast("string"), F.lit(-1), F.lit(float(n)), trees, 42)).alias("t")).groupBy("t").count().collect()
        counts = [r["count"] for r in dealt]
        assert len(counts) == trees and min(counts) >= min(n, 800) and max(counts) <= max(2 * model.DRAWN, 1.5 * n * np.ceil(trees * model.DRAWN / n) / trees)


def test_segments_cost_no_more_than_full_fits(spark):
    """All starts in shared scans, against Spark's own k-means of ten starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(8)
    points = np.vstack([rng.normal(c, s, (400, 3)) for c, s in (((0, 0, 0), 1), ((6, 0, 1), 2), ((0, 7, 2), 1), ((5, 5, 9), 3))])
    d = spark.createDataFrame([(str(k), *map(float, p)) for k, p in enumerate(points)], "case_id string, a double, b double, c double").repartition(5).cache()
    got = model.segment_centers(d, ["a", "b", "c"], 4)
    cost = lambda centers: sum(min(((p - c) ** 2).sum() for c in centers) for p in points)
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(d)
    full = min(cost(np.array(KMeans(k=4, seed=s, featuresCol="v").fit(v).clusterCenters())) for s in range(10))
    assert cost(got) <= 1.01 * full
    moved, costs = model.lloyd_round(d, ["a", "b", "c"], np.array([got, got[::-1]]))
    assert costs[0] == pytest.approx(cost(got)) == costs[1] and np.allclose(moved[0], moved[1][::-1])


def test_starts_that_tie_do_not_go_by_rounding(spark, monkeypatch):
    """Starts that find the same segments have costs that differ by the order of the sums alone."""
    rows = spark.createDataFrame([(str(i), float(i % 7), float(i % 3)) for i in range(60)], "case_id string, a double, b double")
    chosen = []
    for costs in ([2e6, 1e6, 1e6 * (1 - 1e-15), 2e6], [2e6, 1e6 * (1 - 1e-15), 1e6, 2e6]):
        monkeypatch.setattr(model, "lloyd_round", lambda rows, columns, centers, costs=costs: (centers, np.array(costs)))
        chosen.append(model.segment_centers(rows, ["a", "b"], 3, starts=4).tolist())
    first = rows.orderBy(F.xxhash64("case_id", F.lit(model.SEED)), "case_id").select("a", "b").toPandas().to_numpy(float)
    assert chosen[0] == chosen[1] == model.first_centers(first, 3, np.random.default_rng((model.SEED, 1))).tolist()


def test_plane_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + [3, 0, -2, 9]
    mean, axes = model.plane(spark.createDataFrame(x.tolist(), "a double, b double, c double, d double").repartition(4), list("abcd"))
    want = np.linalg.svd(x - x.mean(0))[2][:2]
    assert np.allclose(mean, x.mean(0)) and np.allclose(axes, [a * np.sign(a[np.abs(a).argmax()]) for a in want], atol=1e-6)


def test_file_digests_and_observed_counts(spark, tmp_path):
    import hashlib

    parts = {"a.csv": b"x,y\n1,2\n", "b.csv": b"\x00" * 5000}
    for name, content in parts.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in transactions.file_digests(spark, str(tmp_path)).collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in parts.items()}
    seen_rows, seen = transactions.counted(spark.range(1234))
    seen_rows.write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 1234


def test_scratch_tables_go(spark, tmp_path):
    """Tables of quantiles, of a nested block and of a block that fails are gone; results, tables from outside and the folder stay."""
    kept = storage.written(spark.range(5), "outside")
    shared = pathlib.Path(kept.inputFiles()[0].removeprefix("file:")).parent.parent
    before = set(shared.iterdir())
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    with storage.scratch(spark):
        once = storage.written(rows, "rows")
        with storage.scratch(spark):
            storage.written(rows, "inner")
            assert len(set(shared.iterdir()) - before) == 2
        assert len(set(shared.iterdir()) - before) == 1
        once.groupBy("g").agg(F.sum("x").alias("x")).write.parquet(str(tmp_path / "sums"))
    assert set(shared.iterdir()) == before
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "sums")).collect()} == {(0, 249500.0), (1, 250000.0)}
    with pytest.raises(ValueError, match="stop"), storage.scratch(spark):
        storage.written(rows)
        raise ValueError("stop")
    assert set(shared.iterdir()) == before and kept.count() == 5
    storage.written(rows)
    assert len(set(shared.iterdir()) - before) == 1


def test_model_jobs(spark, tmp_path):
    """Trees of all rows; scores alike with and without explanations, after saving, and in any partitioning; texts with three factors."""
    f = core.written(core.days(spark, "/root/testdata/sf0.001"))
    train = split.train_rows(f, split.cutoff(f))
    with pytest.raises(ValueError, match="rows"):
        model.fit(train.limit(20), k=5)
    fitted = model.fit(train, k=3, starts=2)
    scored = fitted.score(f)
    rows = {r["case_id"]: r for r in scored.collect()}
    assert len(rows) == f.count() and all(0 <= r["risk_score"] <= 100 and r["cluster"] in range(3) for r in rows.values())
    told = explain.explained(scored, fitted.baseline).collect()
    assert all(r["risk_score"] == rows[r["case_id"]]["risk_score"] and len(r["alert_reason"]) > 10 and r["alert_factors"].count(" \u2022 ") == 2 for r in told)
    fitted.save(spark, str(tmp_path / "model"))
    again = model.RiskModel.load(spark, str(tmp_path / "model")).score(f.repartition(5)).collect()
    assert {r["case_id"]: r["risk_score"] for r in again} == {i: r["risk_score"] for i, r in rows.items()}
    used = fitted.trees.groupby("scope")["tree"].nunique()
    assert used[-1] == model.GLOBAL_TREES and all(fitted.sizes[s] <= model.SAMPLE for s in used.index) and fitted.anomaly_ref.arrays is not None
    axes = np.array(fitted.axes)
    assert np.allclose(axes @ axes.T, np.eye(2), atol=1e-6) and all(a[np.abs(a).argmax()] > 0 for a in axes)


def plain_scatter_gather(moves, least):
    """moves: (from, to, second) of one day."""
    inn, out, pairs = {}, {}, {}
    for a, b, s in moves:
        if a != b:
            inn.setdefault(b, {})[a] = min(s, inn.get(b, {}).get(a, s))
            out.setdefault(a, {})[b] = max(s, out.get(a, {}).get(b, s))
    for m in inn:
        for a, s in inn[m].items():
            for b, e in out.get(m, {}).items():
                if s < e and a != b:
                    pairs.setdefault((a, b), set()).add(m)
    return {p: len(m) for p, m in pairs.items() if len(m) >= least}


def timed(spark, moves, start=dt.datetime(2024, 1, 1)):
    rows = [(start + dt.timedelta(seconds=int(s)), "1", str(a), "1", str(b), 1.0, "Euro", 1.0, "Euro", "Wire", 0) for a, b, s in moves]
    return transactions.normalised(spark.createDataFrame(rows, TX.replace("timestamp string", "timestamp timestamp_ntz")))


@pytest.mark.parametrize("light", [0, 3, 10_000])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_scatter_gather_light_and_heavy(spark, least, light):
    """Few accounts with many payments, so that middles are light, heavy and mixed: the same pairs by brute force."""
    rng = np.random.default_rng(least)
    moves = [(f"a{a}", f"a{b}", s) for a, b, s in zip(rng.zipf(1.4, 300) % 25, rng.zipf(1.4, 300) % 25, rng.integers(0, 80_000, 300), strict=True)]
    got = {(r["source"], r["sink"]): r["middles"] for r in network.scatter_gather(timed(spark, moves), least, light).collect()}
    assert got == plain_scatter_gather(moves, least) and got


def hub_moves(spark, n, extra):
    """n payers of one hub and n payees, as a table, with a few other transfers."""
    k = spark.range(n)
    row = lambda a, b, s: k.select((F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(secs=s)).cast("timestamp_ntz").alias("timestamp"), F.lit("1").alias("from_bank"), a.alias("from_account"), F.lit("1").alias("to_bank"), b.alias("to_account"), F.lit(1.0).alias("amount_received"), F.lit("Euro").alias("receiving_currency"), F.lit(1.0).alias("amount_paid"), F.lit("Euro").alias("payment_currency"), F.lit("Wire").alias("payment_format"), F.lit(0).alias("is_laundering"))
    name = lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    return row(name("p"), F.lit("hub"), F.col("id") % 3000).unionByName(row(F.lit("hub"), name("q"), F.col("id") % 3000 + 1)).unionByName(timed(spark, extra))


def test_hub_without_products(spark):
    """A hub of 100,000 payers and as many payees within an hour: 10**10 pairs are not made, and the few patterns are found."""
    extra = [("p1", "m", 10), ("m", "q5", 5000), ("q7", "p7", 3500), ("q8", "z", 3200), ("z", "p8", 3300), ("z", "p9", 3301), ("a", "b", 1), ("b", "a", 2)]
    t = hub_moves(spark, 100_000, extra)
    assert sorted(map(tuple, network.scatter_gather(t).select("source", "sink", "middles").collect())) == [("p1", "q5", 2)]
    assert [r["ring"] for r in network.cycles(t, 2, 3600).collect()] == ["a>b"]
    assert {r["ring"] for r in network.cycles(t, 3, 3600).collect()} == {"p7>hub>q7"}
    assert {r["ring"] for r in network.cycles(t, 4, 3600).collect()} == {"p8>hub>q8>z"}


@pytest.mark.parametrize("accounts", [5, 9])
def test_rings_among_hubs(spark, accounts):
    rng = np.random.default_rng(accounts)
    moves = sorted({(f"a{a}", f"a{b}", int(s)) for a, b, s in zip(rng.zipf(1.5, 160) % accounts, rng.zipf(1.5, 160) % accounts, rng.integers(0, 40_000, 160), strict=True) if a != b})
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    paths = [[m] for m in moves]
    for length in (2, 3, 4):
        paths = [[*p, m] for p in paths for m in moves if m[0] == p[-1][1] and p[-1][2] < m[2] <= p[-1][2] + 3000]
        want = sorted((">".join(m[0] for m in p), p[0][2] + start, p[-1][2] + start, float(length)) for p in paths if p[-1][1] == p[0][0] and len({m[0] for m in p}) == length)
        assert sorted(map(tuple, network.cycles(timed(spark, moves), length, 3000).select("ring", "first_s", "last_s", "total").collect())) == want and want


@pytest.mark.parametrize("sketched", [True, False])
def test_quantiles_are_exact(spark, sketched):
    """Against numpy: ties, nulls, few and many values, one value, none, groups of unlike sizes, and infinities."""
    rng = np.random.default_rng(1)
    rows = [(0, float(x), float(x % 7), None) for x in rng.normal(0, 1e6, 9000)] + [(1, float(k), 5.0, None) for k in range(3)] + [(2, None, 1e300, None), (2, 4.0, float("inf"), None)]
    d = spark.createDataFrame(rows, "g int, a double, b double, c double").repartition(5)
    at = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["name"]): (r["n"], r["q"]) for r in quantiles.quantiles(d, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, at, ["g"], sketched).collect()}
    for g in (0, 1, 2):
        for i, c in enumerate("abc", 1):
            v = sorted(r[i] for r in rows if r[0] == g and r[i] is not None)
            want = [None] * len(at)
            if v:
                ends = [(v[int(np.floor(p * (len(v) - 1)))], v[int(np.ceil(p * (len(v) - 1)))], p * (len(v) - 1) % 1) for p in at]
                want = [lo if lo == hi else lo + (hi - lo) * f for lo, hi, f in ends]
            assert got[g, c][0] == len(v) and got[g, c][1] == pytest.approx(want, rel=1e-12) if v else got[g, c] == (0, want)
    whole = quantiles.quantiles(d, {"a": F.col("a")}, [0.5]).first()
    assert whole["q"][0] == pytest.approx(float(np.median([r[1] for r in rows if r[1] is not None])), rel=1e-12)
