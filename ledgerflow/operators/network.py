"""Networks of transfers: around alerts, and patterns in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.schema import LABEL
from ledgerflow.sources.storage import written
from ledgerflow.sources.transactions import derived


def ego_transactions(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """The transfers of each alert's day with its account on either side. Two equi-joins stand for the OR; alerts (case_id, date, account_id) are a review budget, and Spark broadcasts them if their size is small."""
    t = derived(tx)
    a = alerts.select("case_id", "date", "account_id")
    cols = ["case_id", "account_id", *t.columns]
    out = t.join(a.withColumnRenamed("account_id", "from_account"), ["date", "from_account"]).withColumn("account_id", F.col("from_account"))
    inn = t.where("from_account <> to_account").join(a.withColumnRenamed("account_id", "to_account"), ["date", "to_account"]).withColumn("account_id", F.col("to_account"))
    return out.select(*cols).unionByName(inn.select(*cols))


def ego_edges(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    return ego_transactions(tx, alerts).groupBy("case_id", "from_account", "to_account").agg(F.sum(F.col("amount_paid").cast("decimal(18,4)")).cast("double").alias("weight"), F.max(LABEL).alias("illicit"))


def ego_nodes(edges: DataFrame, alerts: DataFrame) -> DataFrame:
    """case_id, node, degree (a loop counts twice), is_center."""
    ends = edges.select("case_id", F.explode(F.array("from_account", "to_account")).alias("node"))
    c = alerts.select("case_id", F.col("account_id").alias("center"))
    return ends.groupBy("case_id", "node").agg(F.count("*").alias("degree")).join(c, "case_id").select("case_id", "node", "degree", (F.col("node") == F.col("center")).alias("is_center"))


def fans(tx: DataFrame, out: bool = True, seconds: int = 3600, least: int = 3) -> DataFrame:
    """hub, most: hubs that pay (or are paid by) at least so many distinct accounts within the time, and the most they had at once."""
    hub, other = ("from_account", "to_account") if out else ("to_account", "from_account")
    t = derived(tx).select(F.col(hub).alias("hub"), F.col(other).alias("other"), F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("s"))
    # an account counts from its payment until its next one or the end of the time, so each has one interval at a moment
    last = F.lead("s").over(Window.partitionBy("hub", "other").orderBy("s"))
    active = t.distinct().select("hub", "s", F.least(F.coalesce(last, F.col("s") + seconds + 1), F.col("s") + seconds + 1).alias("end"))
    # a hub's time is cut into buckets, each with the intervals that reach into it, so a hub is not one task
    width = 24 * (seconds + 1)
    cut = active.select("hub", "s", "end", F.explode(F.array_distinct(F.array(F.floor(F.col("s") / width), F.floor((F.col("end") - 1) / width)))).alias("bucket"))
    begins = F.struct(F.greatest("s", F.col("bucket") * width).alias("at"), F.lit(1).alias("step"))
    ends = F.struct(F.col("end").alias("at"), F.lit(-1).alias("step"))
    steps = cut.select("hub", "bucket", F.inline(F.array(begins, ends))).groupBy("hub", "bucket", "at").agg(F.sum("step").alias("step"))
    running = F.sum("step").over(Window.partitionBy("hub", "bucket").orderBy("at"))
    return steps.withColumn("n", running).groupBy("hub").agg(F.max("n").cast("long").alias("most")).where(F.col("most") >= least)


def _after(left: DataFrame, right: DataFrame, on: list[str], s: str, t: str, span: int) -> DataFrame:
    """left joined with right on equal columns where the time t of right is in (s, s + span]: an equi-join on buckets of time too."""
    bucket = lambda c: F.floor(F.col(c) / span)
    early = left.withColumn("bucket_", F.explode(F.array(bucket(s), bucket(s) + 1)))
    late = right.withColumn("bucket_", bucket(t))
    return early.join(late, [*on, "bucket_"]).where((F.col(t) > F.col(s)) & (F.col(t) <= F.col(s) + span)).drop("bucket_")


def _returning(edges: DataFrame, span: int, rounds: int = 2) -> DataFrame:
    """Edges (x, y, s, m) that can be part of a ring of that span: near their time x is paid and y pays, by the edges that are left. Sets of (account, bucket) meet, so a hub is one row of each."""
    bucket = F.floor(F.col("s") / span)
    for _ in range(rounds):
        here = edges.withColumn("k_", bucket)
        near = lambda c: here.select(F.col(c).alias("who_"), F.explode(F.array(F.col("k_") - 1, F.col("k_"), F.col("k_") + 1)).alias("k_")).distinct()  # noqa: E731, B023
        pays, paid = near("x").withColumnRenamed("who_", "y"), near("y").withColumnRenamed("who_", "x")
        edges = here.join(pays, ["y", "k_"], "left_semi").join(paid, ["x", "k_"], "left_semi").select(*edges.columns)
    return edges


def _with_degrees(edges: DataFrame) -> DataFrame:
    """edges with kx and ky: (degree, account) of both ends, a strict order of accounts by how many edges they have."""
    ends = edges.select(F.explode(F.array("x", "y")).alias("who_")).groupBy("who_").agg(F.count("*").alias("degree_"))
    of = lambda c: ends.select(F.col("who_").alias(c), F.struct("degree_", F.col("who_")).alias(f"k{c}"))
    return edges.join(of("x"), "x").join(of("y"), "y")


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    """The columns of df that are values of names, under the new names."""
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def _rings_of_three(e: DataFrame, w: int) -> DataFrame:
    """Each ring is found once, at its account of the least degree: two of its edges meet there, the third is looked up by both ends."""
    into = _renamed(e.where("kx > ky"), p="x", u="y", si="s", mi="m")
    out = _renamed(e.where("ky > kx"), u="x", q="y", so="s", mo="m")
    third = _renamed(e, q="x", p="y", st="s", mt="m")
    total = (F.col("mi") + F.col("mo") + F.col("mt")).alias("total")
    ring = lambda df, accounts, first, last: df.select(F.array(*accounts).alias("ring"), F.col(first).alias("first_s"), F.col(last).alias("last_s"), total)
    wedge = _after(into, out, ["u"], "si", "so", w).where("p <> q")
    second = ring(_after(wedge, third, ["q", "p"], "so", "st", w), ("p", "u", "q"), "si", "st")
    last = ring(_after(third, wedge, ["q", "p"], "st", "si", w), ("q", "p", "u"), "st", "so")
    around = _after(out, into, ["u"], "so", "si", 2 * w).where("p <> q")
    first = ring(_after(around, third, ["q", "p"], "so", "st", w).where((F.col("si") > F.col("st")) & (F.col("si") <= F.col("st") + w)), ("u", "q", "p"), "so", "si")
    return second.unionByName(last).unionByName(first)


def _rings_of_four(e: DataFrame, w: int) -> DataFrame:
    """Two half rings meet at their ends, one of which has a higher degree than both accounts between: so none is made around a hub, and each ring is found once."""
    into, out = _renamed(e, p="x", u="y", si="s", mi="m", kp="kx", ku="ky"), _renamed(e, u="x", q="y", so="s", mo="m", kq="ky", ku_="kx")
    high_in, high_out = into.where("kp > ku"), out.where("kq > ku_")

    def halves(meet) -> DataFrame:
        higher = meet(high_in, out).where("kq < kp"), meet(into, high_out).where("kp < kq")
        return higher[0].unionByName(higher[1].select(*higher[0].columns)).select("p", "u", "q", "si", "so", (F.col("mi") + F.col("mo")).alias("m"))

    on = halves(lambda i, o: _after(i, o, ["u"], "si", "so", w))  # p pays u, then u pays q
    back = halves(lambda i, o: _after(o, i, ["u"], "so", "si", 3 * w))  # u pays q, and is paid by p at the end
    other = _renamed(on, q="p", v="u", p="q", sj="si", sp="so", n="m")
    total = (F.col("m") + F.col("n")).alias("total")
    one = _after(on, other, ["p", "q"], "so", "sj", w).where("u <> v").select(F.array("p", "u", "q", "v").alias("ring"), F.col("si").alias("first_s"), F.col("sp").alias("last_s"), total)
    two = _after(back, other, ["p", "q"], "so", "sj", w).where((F.col("si") > F.col("sp")) & (F.col("si") <= F.col("sp") + w) & (F.col("u") != F.col("v")))
    return one.unionByName(two.select(F.array("u", "q", "v", "p").alias("ring"), F.col("so").alias("first_s"), F.col("si").alias("last_s"), total))


def cycles(tx: DataFrame, length: int = 3, seconds: int = 3600) -> DataFrame:
    """Time-ordered rings of two to four transfers that come back to their first account, each step within the time; the accounts are distinct.

    First go the edges whose ends cannot return in time. What is left meets in the middle, and only around accounts of
    low degree: the rows of every join are those of edges with their neighbours of higher degree, whatever a hub has.
    """
    if length not in (2, 3, 4):
        raise ValueError("rings of 2, 3 or 4 accounts")
    t = derived(tx).where("from_account <> to_account")
    e = t.select(F.col("from_account").alias("x"), F.col("to_account").alias("y"), F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("s"), F.coalesce("amount_paid", F.lit(0.0)).cast("decimal(18,4)").alias("m"), F.col("amount_paid").alias("raw")).distinct()
    e = written(_returning(e, length * seconds), "edges")
    if length == 2:
        back = _renamed(e, y="x", x="y", sj="s", n="m")
        rings = _after(e, back, ["x", "y"], "s", "sj", seconds).select(F.array("x", "y").alias("ring"), F.col("s").alias("first_s"), F.col("sj").alias("last_s"), (F.col("m") + F.col("n")).alias("total"))
    else:
        e = written(_with_degrees(e), "edges")
        rings = (_rings_of_three if length == 3 else _rings_of_four)(e, seconds)
    return rings.select(F.array_join("ring", ">").alias("ring"), "first_s", "last_s", F.col("total").cast("double").alias("total"))


#: Pairs of a source and a sink that one account may make by itself; those that could make more are met by the demand for others.
LIGHT = 10_000


def _demanded(inn: DataFrame, out: DataFrame, least: int, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Less the payments of sources and to sinks that have fewer than so many middles, and of middles without a side."""
    key = ["date", "middle"]
    enough = lambda df, c: df.join(df.groupBy("date", c).agg(F.count("*").alias("n_")).where(F.col("n_") >= least).drop("n_"), ["date", c], "left_semi")
    for _ in range(rounds):
        inn = enough(inn.join(out.select(*key).distinct(), key, "left_semi"), "source")
        out = enough(out.join(inn.select(*key).distinct(), key, "left_semi"), "sink")
    return inn, out


def scatter_gather(tx: DataFrame, least: int = 2, light: int = LIGHT) -> DataFrame:
    """source, sink, middles: accounts of one day through which a source reaches a sink in time order, at least so many.

    Sources and sinks with too few middles go first, so a hub whose payers pay it alone makes no pairs. Middles that could
    still make more than light pairs are heavy. Light ones are joined by themselves; heavy ones count for the pairs that light ones made, and make
    pairs of their own only two by two, for sources and sinks that both have. So with the demand for two middles every row made is a pair of the result or one of a light middle.
    """
    t = derived(tx).where("from_account <> to_account")
    key, pair = ["date", "middle"], ["date", "source", "sink"]
    # the earliest payment in and the latest out are all that order needs, so hubs meet as distinct pairs
    edges = written(t.groupBy("date", "from_account", "to_account").agg(F.min("timestamp").alias("t_in"), F.max("timestamp").alias("t_out")), "edges")
    inn, out = _renamed(edges, date="date", middle="to_account", source="from_account", t_in="t_in"), _renamed(edges, date="date", middle="from_account", sink="to_account", t_out="t_out")
    inn, out = _demanded(inn, out, least)
    inn, out = written(inn, "in"), written(out, "out")
    times = inn.groupBy(*key).agg(F.count("*").alias("a")).join(out.groupBy(*key).agg(F.count("*").alias("b")), key)
    heavy = written(times.where(F.col("a") * F.col("b") > light).select(*key), "heavy") if least > 1 else times.select(*key).limit(0)
    ordered = (F.col("t_in") < F.col("t_out")) & (F.col("source") != F.col("sink"))
    by_light = inn.join(heavy, key, "left_anti").join(out, key).where(ordered).groupBy(*pair).agg(F.count("*").alias("middles"))
    if heavy.isEmpty():
        return by_light.where(F.col("middles") >= least)
    by_light = written(by_light, "pairs")
    hi, ho = written(inn.join(heavy, key, "left_semi"), "in"), written(out.join(heavy, key, "left_semi"), "out")
    twice = lambda df, who, at: _renamed(df, date="date", **{who: who}, middle="middle", t1=at).join(_renamed(df, date="date", **{who: who}, other="middle", t2=at), ["date", who]).where("middle < other")
    both = ["date", "middle", "other"]
    two_in, two_out = twice(hi, "source", "t_in"), twice(ho, "sink", "t_out").withColumnsRenamed({"t1": "u1", "t2": "u2"})
    met = two_in.join(two_out, both).where("t1 < u1 and t2 < u2 and source <> sink").select(*pair).distinct()
    asked = by_light.select(*pair).unionByName(met).distinct()
    by_heavy = asked.join(hi, ["date", "source"]).join(ho, ["date", "middle", "sink"]).where("t_in < t_out").groupBy(*pair).agg(F.count("*").alias("middles"))
    return by_light.unionByName(by_heavy).groupBy(*pair).agg(F.sum("middles").alias("middles")).where(F.col("middles") >= least)
