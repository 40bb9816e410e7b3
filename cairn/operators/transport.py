"""Exact optimal transport by auction: bids, holdings and prices are tables, a round is a join and two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.plans.stages import materialize, release, written


def _served(order: list[Column], upto: Column, *by: str) -> Column:
    """How many of ``units`` lie within the first ``upto`` units of the window."""
    before = F.sum("units").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return F.greatest(F.lit(0), F.least(F.col("units"), upto - F.coalesce(before, F.lit(0))))


def _segments(held: DataFrame, sinks: DataFrame) -> DataFrame:
    """Units of every sink at their prices: held ones with their source, free ones (null) at the sink's first price."""
    taken = held.groupBy("key", "dst").agg(F.sum("units").alias("taken"))
    free = sinks.join(taken.hint("merge"), ["key", "dst"], "left").withColumn("units", F.col("demand") - F.coalesce("taken", F.lit(0))).where("units > 0")
    return held.select("key", "dst", "src", "price", "units").union(free.select("key", "dst", F.lit(None).cast("long"), "first_price", "units"))


def _round(pairs: DataFrame, sources: DataFrame, sinks: DataFrame, held: DataFrame, epsilon: int) -> DataFrame:
    """Holdings after every source with units to place has bid, and every sink has kept its highest bids."""
    placed = held.groupBy("key", "src").agg(F.sum("units").alias("placed"))
    need = sources.join(placed.hint("merge"), ["key", "src"], "left").withColumn("need", F.col("supply") - F.coalesce("placed", F.lit(0))).where("need > 0")
    market = _segments(held, sinks)
    offers = pairs.join(need.select("key", "src", "need").hint("merge"), ["key", "src"]).join(market.withColumnRenamed("src", "holder").hint("merge"), ["key", "dst"])
    offers = offers.where("holder IS NULL OR holder <> src").withColumn("total", F.col("cost") + F.col("price"))
    cheap = [F.col("total"), F.col("dst"), F.col("price"), F.col("holder").asc_nulls_first()]
    mine = Window.partitionBy("key", "src")
    offers = offers.withColumns({"bid": _served(cheap, F.col("need"), "key", "src"), "upto": F.sum("units").over(mine.orderBy(*cheap).rowsBetween(Window.unboundedPreceding, 0))})
    # the price of the first unit that it can do without, else of the last that it must have
    other = F.coalesce(F.min(F.when(F.col("upto") > F.col("need"), F.col("total"))).over(mine), F.max("total").over(mine))
    offers = offers.withColumn("level", other + epsilon).where("bid > 0").withColumn("price", F.col("level") - F.col("cost"))
    bids = offers.groupBy("key", "dst", "src", "cost", "price").agg(F.sum("bid").alias("units"), F.any_value("level").alias("level"))
    # what a bidder holds is worth as much to it as what it bids for, so its price rises to that, too
    rows = held.withColumn("level", F.lit(None).cast("long")).unionByName(bids).join(sinks.select("key", "dst", "demand").hint("merge"), ["key", "dst"])
    rows = rows.withColumns({"age": F.col("level").isNotNull(), "level": F.max("level").over(mine)})
    rows = rows.withColumn("price", F.greatest("price", F.col("level") - F.col("cost")))
    best = [F.col("price").desc(), F.col("age"), F.col("src")]
    rows = rows.withColumn("units", _served(best, F.col("demand"), "key", "dst")).where("units > 0")
    return rows.groupBy("key", "dst", "src", "cost", "price").agg(F.sum("units").alias("units"))


def exact_transport(pairs: DataFrame, sources: DataFrame, sinks: DataFrame, scaling: int = 8) -> tuple[DataFrame, DataFrame]:
    """Transport of least cost for any number of balanced problems at once.

    ``pairs(key, src, dst, cost)`` has whole-number costs of what may be sent
    where, ``sources(key, src, supply)`` and ``sinks(key, dst, demand)`` whole
    weights, equal in sum for each key. Returns the plan ``key, src, dst,
    units`` and the certificate ``key, units, cost, bound, gap``: ``bound`` is
    the dual value of the final prices, so ``gap`` limits how far ``cost`` is
    from the least. It is 0 for feasible problems: costs are multiplied by one
    more than a problem's units, and the last phase's bids rise by 1.

    Each phase is an auction. A source with units to place ranks all units of
    the sinks by cost and price and bids for the cheapest, up to the price at
    which the next best is as good, and ``epsilon`` more; a sink keeps the
    highest bids for its units. Prices only rise, within a phase, so it ends;
    the next begins from them with an ``epsilon`` of ``1 / scaling``, so that
    rounds grow with the logarithm of the costs. A source's offers are one
    window (one row of a cost matrix), a sink's holdings another; no task needs
    a whole problem. Rounds are written to the shared folder. Joins are merges:
    written tables look small by their packed size, and to broadcast them in
    every round would fill the driver.

    Zero weights take no part. A problem whose weights differ in sum, a
    negative weight, a repeated pair, or a source that no allowed sink can
    serve raises ``ValueError``. Null keys and ids are dropped. No problems:
    no rows.
    """
    pairs = pairs.select("key", F.col("src").cast("long"), F.col("dst").cast("long"), F.col("cost").cast("long")).dropna()
    sources = materialize(sources.select("key", F.col("src").cast("long"), F.col("supply").cast("long")).dropna().where("supply <> 0"), "sources")
    sinks = materialize(sinks.select("key", F.col("dst").cast("long"), F.col("demand").cast("long")).dropna().where("demand <> 0"), "sinks")
    sums = sources.selectExpr("key", "supply AS s", "0L AS d", "supply AS w").union(sinks.selectExpr("key", "0L", "demand", "demand"))
    sums = sums.groupBy("key").agg(F.sum("s").alias("units"), F.sum("d").alias("asked"), F.min("w").alias("least"))
    if not sums.where("units <> asked OR least < 0").isEmpty():
        raise ValueError("supply and demand differ, or a weight is negative")
    pairs = pairs.join(sources.select("key", "src").hint("merge"), ["key", "src"], "left_semi").join(sinks.select("key", "dst").hint("merge"), ["key", "dst"], "left_semi")
    pairs = materialize(pairs.join(sums.select("key", "units").hint("merge"), "key").select("key", "src", "dst", (F.col("cost") * (F.col("units") + 1)).alias("cost")), "pairs")
    if not pairs.groupBy("key", "src", "dst").count().where("count > 1").isEmpty():
        raise ValueError("a pair has more than one cost")
    need, widest, units = sources.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0], *pairs.agg(F.coalesce(F.max(F.abs("cost")), F.lit(0)), F.count("*")).first()
    served = pairs.select("key", "src").distinct()
    if not sources.join(served.hint("merge"), ["key", "src"], "left_anti").isEmpty():
        raise ValueError("a source may send nowhere")
    # no price of a feasible problem rises beyond costs times sources; what does is bid for a unit that can't be had
    highest = (2 * widest + 2) * (2 + sources.groupBy("key").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    held_schema = "key {}, dst long, src long, cost long, price long, units long".format(pairs.schema["key"].dataType.simpleString())
    prices = materialize(sinks.withColumn("first_price", F.lit(0).cast("long")), "prices")
    held = pairs.sparkSession.createDataFrame([], held_schema)
    epsilon, rounds = max(1, widest // scaling), written()
    while need:
        held = pairs.sparkSession.createDataFrame([], held_schema)
        while True:
            held = materialize(_round(pairs, sources, prices, held, epsilon).select("key", "dst", "src", "cost", "price", "units"), "held")
            done, top = held.agg(F.sum("units"), F.max("price")).first()
            if done == need:
                break
            if top > highest * 2:
                raise ValueError("some source's units fit no allowed sink")
        if epsilon == 1:
            break
        low = held.groupBy("key", "dst").agg(F.min("price").alias("first_price"))
        prices = materialize(sinks.join(low.hint("merge"), ["key", "dst"]), "prices")
        release(pairs.sparkSession, since=rounds, keep=prices)
        epsilon = max(1, epsilon // scaling)
    plan = held.groupBy("key", "src", "dst").agg(F.sum("units").alias("units"))
    return plan, _certificate(pairs, sources, sinks, held, sums)


def _certificate(pairs: DataFrame, sources: DataFrame, sinks: DataFrame, held: DataFrame, sums: DataFrame) -> DataFrame:
    """Primal cost and dual bound of each problem, in the costs' own units."""
    low = held.groupBy("key", "dst").agg(F.min("price").alias("price"))
    primal = held.groupBy("key", "src", "dst").agg(F.sum("units").alias("units")).join(pairs.hint("merge"), ["key", "src", "dst"]).groupBy("key").agg(F.sum(F.col("units") * F.col("cost")).alias("primal"))
    profit = pairs.join(low.hint("merge"), ["key", "dst"]).groupBy("key", "src").agg(F.min(F.col("cost") + F.col("price")).alias("p")).join(sources.hint("merge"), ["key", "src"])
    paid = low.join(sinks.hint("merge"), ["key", "dst"]).groupBy("key").agg(F.sum(F.col("price") * F.col("demand")).alias("paid"))
    dual = profit.groupBy("key").agg(F.sum(F.col("p") * F.col("supply")).alias("earned")).join(paid.hint("merge"), "key")
    rows = primal.join(dual.hint("merge"), "key").join(sums.hint("merge"), "key")
    scale = F.col("units") + 1
    # the least cost is a multiple of the scale, so the bound is rounded up to one
    rows = rows.select("key", "units", F.expr("primal div (units + 1)").alias("cost"), F.ceil((F.col("earned") - F.col("paid")) / scale).alias("bound"))
    return rows.withColumn("gap", F.col("cost") - F.col("bound"))


def whole_costs(pairs: DataFrame, digits: int = 3) -> DataFrame:
    """``pairs(key, src, dst, distance)`` with distances as whole numbers of the last of ``digits`` decimals.

    A plan that is exact for these costs is within half of that digit a unit of the exact one for the distances.
    """
    return pairs.select("key", "src", "dst", F.floor(F.col("distance") * 10**digits + 0.5).cast("long").alias("cost"))
