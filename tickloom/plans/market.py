"""Market tables from the driver's generic ones, and queries over them that exercise every operator."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.series import Series, latest
from ..operators import checks, datasets, decision, features, labels, metrics, model, serving
from ..operators.asof import asof_join
from ..schemas import FEATURE_NAMES
from ..sources import decode
from ..sources.tables import last_by_key, number_orders

HOUR = 3600
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: symbol, time, price, size, seq."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), (F.col("value") + 100).alias("price"), F.col("value").cast("decimal(18,2)").alias("size"), F.col("event_id").alias("seq"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the ticks."""
    order = F.struct("time", "seq")
    df = ticks(spark, sf_dir).groupBy("symbol", F.window("time", "1 hour")["start"].alias("bar")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").cast("double").alias("volume"), F.count(F.lit(1)).cast("int").alias("trades")
    )
    return df.withColumnRenamed("bar", "time")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot a tick: levels around the price, as many a side as the tick's number gives (2 to 8)."""
    t = ticks(spark, sf_dir)
    n, k = (F.col("seq") % 7 + 2).cast("int"), F.sequence(F.lit(0), F.lit(7))
    levels = lambda f: F.slice(F.transform(k, f), 1, n)
    size = F.col("size").cast("double")
    return t.select("symbol", "time", levels(lambda i: F.col("price") - 0.5 * (i + 1)).alias("bid_px"), levels(lambda i: size + i).alias("bid_sz"), levels(lambda i: F.col("price") + 0.5 * (i + 1)).alias("ask_px"), levels(lambda i: size + 2 * i + 1).alias("ask_sz"))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick as a funding row of its symbol."""
    return ticks(spark, sf_dir).select("symbol", "time", (F.col("size").cast("double") / 1e4).alias("funding_rate"), (F.col("price") * 1000).alias("open_interest"), "seq")


def _round(df: DataFrame, names: Iterable[str], scale: dict[str, float] | None = None, digits: int = 6) -> list[Column]:
    return [F.round(X.finite_or_null(F.col(n) * (scale or {}).get(n, 1.0)), digits).alias(n) for n in names]


SCALE = {"kyle_lambda": 1e6, "amihud_illiq": 1e6, "funding_rate": 1e4}


def q_bars(spark, sf):
    return bars(spark, sf)


def _bar_query(names: tuple[str, ...], make: Callable[[DataFrame, Series], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(bars(spark, sf_dir), Series())
        return df.select("symbol", "time", *_round(df, names, SCALE))

    return run


RETURNS = ("ret_1", "ret_5", "ret_15", "ret_30", "ret_60", "ret_240", "ret_co", "wick_up", "wick_dn", "price_pos_60", "ret_accel")
VOLATILITY = ("realized_vol_30", "parkinson_30", "garman_klass_30", "downside_vol_30", "vol_of_vol_60")
VOLUME = ("volume_log", "volume_z_60", "volume_ratio_5_30", "trade_count_log")
MICRO = ("amihud_illiq", "kyle_lambda", "vpin_50", "roll_spread")


def q_temporal(spark, sf):
    df = bars(spark, sf).withColumns(X.day_cycle())
    return df.select("symbol", "time", *_round(df, ("hour_sin", "hour_cos", "dow_sin", "dow_cos")))


def q_asof(spark, sf):
    """Each view with the last click of its user."""
    e = table(spark, sf, "events").withColumn("time", F.col("ts").cast("timestamp"))
    right = e.filter("event_type = 'click'").select("user_id", "time", F.col("value").alias("click_value"), F.col("event_id").alias("click_id"))
    return asof_join(e.filter("event_type = 'view'").select("user_id", "time", "event_id"), right, ["click_value", "click_id"], by=("user_id",), tie=("click_id",)).select("event_id", "user_id", "time", "click_value", "click_id")


def q_funding(spark, sf):
    df = features.funding_features(bars(spark, sf), funding(spark, sf), tie=("seq",))
    return df.select("symbol", "time", *_round(df, features.FUNDING_FEATURES, SCALE))


def q_book(spark, sf):
    df = features.book_features(book(spark, sf), HOUR)
    return df.select("symbol", "time", *_round(df, features.BOOK_FEATURES))


def q_cross(spark, sf):
    df = features.cross_features(features.returns(bars(spark, sf), Series()))
    return df.select("symbol", "time", *_round(df, features.CROSS_FEATURES))


def q_recursive(spark, sf):
    df = features.recursions(bars(spark, sf))
    return df.select("symbol", "time", *_round(df, ("sigma_ewma", "rsi_14", "macd_line", "macd_signal", "macd_hist", "atr_14")))


def q_adx(spark, sf):
    df = features.recursions(bars(spark, sf))
    return df.select("symbol", "time", *_round(df, ("adx_14",)))


def q_features(spark, sf):
    """All 58 features of the hourly bars."""
    df = features.compute_features(bars(spark, sf), book(spark, sf), funding(spark, sf), seconds=HOUR, funding_tie=("seq",))
    return df.select("symbol", "time", *_round(df, FEATURE_NAMES, SCALE))


def _labelled(spark, sf, horizon=12):
    return labels.label_bars(bars(spark, sf), horizon=horizon)


def q_cusum(spark, sf):
    """CUSUM events at a fixed threshold."""
    df = labels.labelled_bars(bars(spark, sf)).withColumn("threshold", F.lit(0.15))
    return labels.cusum_events(df)


def q_barriers(spark, sf):
    """Barriers of every bar, at a fixed volatility."""
    df = labels.labelled_bars(bars(spark, sf)).withColumn("sigma", F.lit(0.02))
    out = labels.average_uniqueness(df, labels.triple_barrier(df, df.select("symbol", "idx"), 1.3, 0.7, 12))
    return out.select("symbol", "time", "label", "touch_barrier", "t1", "touch_time", *_round(out, ("ret", "pt_level", "sl_level", "sample_weight")))


def q_labels(spark, sf):
    """The labels table by volatility-scaled events."""
    out = _labelled(spark, sf)
    exact = ("ret", "sigma", "pt_level", "sl_level", "sample_weight")
    return out.select(*[c for c in out.columns if c not in exact], *_round(out, exact))


def _toy(spark, sf):
    """Samples for the dataset operators: three features of the bars and labels of every bar."""
    df = features.volumes(features.returns(bars(spark, sf), Series()), Series()).select("symbol", "time", "ret_1", "ret_co", "volume_ratio_5_30")
    marks = labels.labelled_bars(bars(spark, sf)).withColumn("sigma", F.lit(0.02))
    made = labels.triple_barrier(marks, marks.select("symbol", "idx"), 1.0, 1.0, 12)
    return df, made.withColumn("sample_weight", F.lit(1.0))


TOY = ("ret_1", "ret_co", "volume_ratio_5_30")


def q_samples(spark, sf):
    df, made = _toy(spark, sf)
    return datasets.samples(df, made, 40, TOY)


def q_folds(spark, sf):
    df, made = _toy(spark, sf)
    found = datasets.walk_forward(datasets.samples(df, made, 40, TOY), 5, 12, 60)
    return found.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("first"), F.max("t0").alias("last"), F.max("t1").alias("last_t1"))


def q_cutoffs(spark, sf):
    """The time before which bars may serve each fold's normaliser."""
    df, made = _toy(spark, sf)
    return datasets.fold_cutoffs(datasets.walk_forward(datasets.samples(df, made, 40, TOY), 5, 12, 60), 12, 60)


def q_final_split(spark, sf):
    """Samples by their role in the final fit."""
    df, made = _toy(spark, sf)
    found = datasets.final_split(datasets.samples(df, made, 40, TOY), 0.15, 12, 60)
    return found.groupBy("symbol", "role").agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("first"), F.max("t0").alias("last"), F.max("t1").alias("last_t1"))


def _drift(x):
    """Logits of windows of TOY features: the mean return against nothing."""
    import numpy as np

    z = 1000 * x[:, :, 0].astype(np.float64).mean(1)
    return np.stack([-z, 0 * z, z], axis=1)


def q_predictions(spark, sf):
    """Predictions for the latest bar of each symbol, by a fixed scorer."""
    df = features.volumes(features.returns(bars(spark, sf), Series()), Series()).select("symbol", "time", *TOY)
    out = model.infer_latest(df, _drift, "drift", 40, TOY)
    return out.select("symbol", "time", "model_version", "signal", *_round(out, ("prob_down", "prob_flat", "prob_up"), digits=4))


def q_pending(spark, sf):
    """Orders as recorded before they are sent, by status."""
    df = decision.gate(_gated(spark, sf), sent=False)
    return df.groupBy("symbol", "intent", "order_type", "status", "risk_passed").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("size").cast("decimal(18,2)")), 2).cast("double").alias("size"))


def q_normaliser(spark, sf):
    df, made = _toy(spark, sf)
    split = datasets.walk_forward(datasets.samples(df, made, 40, TOY), 5, 12, 60)
    out = datasets.normaliser(df, datasets.fold_cutoffs(split, 12, 60), TOY)
    return out.select("fold", "name", *_round(out, ("mean", "std"), digits=8))


def q_normalised(spark, sf):
    out = datasets.normalise(features.returns(bars(spark, sf), Series()).select("symbol", "time", "ret_1", "ret_co"), {"ret_1": (0.0, 0.01), "ret_co": (0.001, 0.02)}, 5.0)
    return out.select("symbol", "time", *_round(out, ("ret_1", "ret_co")))


def _classified(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("p"))


def q_class_weights(spark, sf):
    out = metrics.class_weights(_classified(spark, sf), 3)
    return out.select("y", *_round(out, ("weight",)))


def q_confusion(spark, sf):
    return metrics.confusion(_classified(spark, sf), 3)


def q_scores(spark, sf):
    out = metrics.scores(_classified(spark, sf), 3)
    return out.select("y", *_round(out, ("precision", "recall", "f1", "accuracy", "macro_f1")))


def q_cross_entropy(spark, sf):
    df = table(spark, sf, "labels").select(F.col("quality").alias("y"), (F.col("doc_id") % 5 + 1).cast("double").alias("w"), F.array(F.lit(0.2), F.lit(0.5) + F.col("toxic") * 0.1, F.lit(0.3) - F.col("toxic") * 0.1).alias("probs"))
    out = metrics.weighted_cross_entropy(df, metrics.class_weights(df, 3))
    return out.select(*_round(out, ("loss",)))


def _accounts(spark, sf):
    """Customers as predictions with a position and an equity."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("key"), F.col("c_mktsegment").alias("symbol"), ((k * 37 % 100) / F.lit(100.0)).alias("prob_down"), ((k * 53 % 100) / F.lit(100.0)).alias("prob_up"), ((k % 11) / F.lit(500.0)).alias("sigma"), ((k % 13) * 50.0).alias("mark"), ((k % 5) - 2).cast("double").alias("position"), F.col("c_acctbal").alias("equity"))


def q_plans(spark, sf):
    df = decision.plan_orders(_accounts(spark, sf))
    out = df.select("key", "signal", "action", F.posexplode_outer("orders").alias("place", "o"))
    return out.select("key", "signal", "action", "place", "o.side", "o.intent", "o.order_type", F.round("o.size", 6).alias("size"), F.round("o.price", 6).alias("price"))


def _gated(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice").distinct()
    k = F.col("l_partkey")
    kinds = F.array(F.lit("entry"), F.lit("take_profit"), F.lit("stop_loss"), F.lit("other"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("id"), F.lit("BTC").alias("symbol"), F.when(k % 2 == 0, "buy").when(k % 97 == 1, "hold").otherwise("sell").alias("side"), F.get(kinds, (F.col("l_orderkey") % 16 / 5).cast("int")).alias("intent"),
        F.when(F.col("l_orderkey") % 16 < 10, "limit").otherwise("market").alias("order_type"), (F.col("l_quantity") - 1).alias("size"), (F.lit(1000.0) + F.col("l_discount") * 1000).alias("price"), F.when(k % 50 != 3, F.lit(1000.0)).alias("mark"),
        (F.col("l_linenumber") - 4).cast("double").alias("position"), F.abs(F.col("l_linenumber") - 4) * 1000.0 + (k % 8) * 10000.0, F.when(k % 40 != 7, F.lit(20000.0)).otherwise(F.lit(0.0)).alias("equity"), ((k % 30) * -50.0).alias("daily_pnl"), (k % 22).cast("int").alias("open_orders"), (k % 61 == 5).alias("kill_switch"),
    ).toDF("id", "symbol", "side", "intent", "order_type", "size", "price", "mark", "position", "exposure", "equity", "daily_pnl", "open_orders", "kill_switch")


def q_risk_gate(spark, sf):
    df = decision.gate(_gated(spark, sf))
    return df.groupBy("intent", "side", "status", "risk_passed", F.regexp_replace("reason", "[0-9.]+ above", "# above").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_latest(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("time"), "o_orderkey", "o_totalprice")
    return latest(o, order=("time", "o_orderkey"), n=3)


def q_top(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("time"), "o_orderkey")
    return serving.top_latest(o, 50, "F", ("o_orderkey",))


def q_candles(spark, sf):
    return serving.candles(bars(spark, sf), "click", 200)


def q_monitoring(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    out = serving.monitoring(ticks(spark, sf), now - F.expr("interval 1 hour"), ("click", "view", "none"))
    return out.withColumn("state", serving.is_stale(F.col("seconds_since_last_write"), "ohlcv_bars"))


def q_last_by_key(spark, sf):
    """One order a customer, the last by date and key: what an upsert keeps."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return last_by_key(o, ["o_custkey"], ("o_orderdate", "o_orderkey"))


def q_held(spark, sf):
    o = table(spark, sf, "orders").withColumn("time", F.col("o_orderdate").cast("timestamp"))
    at = F.lit("1999-01-01 00:00:00").cast("timestamp")
    return o.select("o_orderkey", serving.bars_held(F.col("time"), at, 86400).alias("held"))


def q_decode(spark, sf):
    """Candle messages made of ticks, with text and number fields, some broken, decoded back."""
    t = ticks(spark, sf)
    num = lambda c: F.when(F.col("seq") % 2 == 0, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))
    price = F.col("price").cast("decimal(18,2)")
    text = F.concat(
        F.lit('{"channel":"'), F.when(F.col("seq") % 10 == 3, "trades").otherwise("candle"), F.lit('","data":{"s":"'), F.when(F.col("symbol") == "click", "BTC").when(F.col("symbol") == "view", "ETH").otherwise("DOGE"), F.lit('","t":'), (F.unix_micros("time") / F.lit(1000)).cast("long").cast("string"),
        F.lit(',"o":'), num(price), F.lit(',"h":'), F.when(F.col("seq") % 7 == 5, F.lit('"x"')).otherwise(num(price)), F.lit(',"l":'), num(price), F.lit(',"c":'), num(price), F.lit(',"v":'), num(F.col("size")), F.lit(',"n":1}}'),
    )
    return decode.candles(t.select(text.alias("value"))).select("symbol", "time", "open", "high", "low", "close", "volume", "trades")


def q_props(spark, sf):
    """Numbers out of JSON text, by user."""
    e = table(spark, sf, "events").select("user_id", F.from_json("props", "k string").alias("p"))
    return e.groupBy("user_id").agg(F.sum(decode.number("p.k")).alias("k_sum"), F.count(decode.number("p.k")).alias("k_n"))


def q_levels(spark, sf):
    """Book formulas over orders' lines as levels."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))).alias("lv"))
    px, sz = F.transform("lv", lambda x: x["l_extendedprice"]), F.transform("lv", lambda x: x["l_quantity"])
    top = lambda n: F.aggregate(F.slice(sz, 1, n), F.lit(0.0), lambda a, b: a + b)
    return li.select("l_orderkey", F.size("lv").alias("n_levels"), top(5).alias("depth_5"), top(10).alias("depth_10"), F.get(px, F.lit(4)).alias("px_5"), F.round(X.finite_or_null(X.fdiv(top(5), F.get(px, F.lit(0)) - F.get(px, F.lit(4)))), 6).alias("slope"))


def q_filled_rates(spark, sf):
    s = Series()
    df = features.volumes(features.volatilities(features.returns(bars(spark, sf), s), s), s)
    out = checks.filled_rates(df, {"price_return": RETURNS, "volatility": VOLATILITY, "volume": VOLUME})
    return out.select("category", *_round(out, ("rate",)))


def q_validate(spark, sf):
    """Counts of rows by the rules they break."""
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 9 == 0, "DOGE").otherwise("BTC").alias("symbol"), F.when(F.col("o_orderkey") % 3 == 0, "entry").otherwise("stop_loss").alias("intent"), F.when(F.col("o_orderstatus") == "F", "limit").otherwise("market").alias("order_type"),
        F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("short").alias("side"), F.lit("open").alias("status"),
    )
    good, bad = checks.validate(o, "orders")
    bad = bad.select(F.array_join(F.array_sort("broken"), ",").alias("broken")).groupBy("broken").agg(F.count(F.lit(1)).alias("n"))
    return bad.unionByName(good.select(F.lit("").alias("broken")).groupBy("broken").agg(F.count(F.lit(1)).alias("n")))


def q_table_stats(spark, sf):
    return checks.table_stats(ticks(spark, sf))


def q_softmax(spark, sf):
    """Probabilities (all, and those of the first three) and likeliest class of each vector."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    out = X.softmax(e, "z", "p").select("vec_id", "p", X.argmax(F.col("z")).alias("best"))
    return out.select("vec_id", *[F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)], F.round(F.array_max("p"), 6).alias("most"), "best")


def q_positions(spark, sf):
    """Customers' balances as positions with their last open order and the days since."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("symbol"), F.lit("1999-01-01").cast("timestamp").alias("time"), F.col("c_acctbal").alias("size"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("time"), F.when(F.col("o_orderstatus") == "O", "stop_loss").otherwise("entry").alias("intent"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("order_id"))
    out = serving.position_views(c, o, F.lit("2002-01-01").cast("timestamp"))
    return out.select("symbol", "side", "sl_level", "entry_time", "bars_held", F.round("held_share", 6).alias("held_share"))


def q_latest_windows(spark, sf):
    """The last 40 bars' windows of three features, as their length and the last return."""
    df = features.volumes(features.returns(bars(spark, sf), Series()), Series()).select("symbol", "time", *TOY)
    out = datasets.latest_windows(df, 40, TOY)
    return out.select("symbol", "time", F.coalesce(F.size("x"), F.lit(0)).alias("n"), F.round(F.col("x")[39][0].cast("double"), 5).alias("last_ret"))


def q_labelled_events(spark, sf):
    df, made = _toy(spark, sf)
    return datasets.labelled_events(df, made)


def q_numbered(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("time"), F.col("o_orderpriority").alias("symbol"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("intent"))
    return number_orders(o, 1000)


def q_risk_state(spark, sf):
    """Suppliers' orders with the exposure of their nation, whose positions are its customers' balances by segment."""
    c = table(spark, sf, "customer")
    held = c.groupBy(F.col("c_nationkey").alias("account"), F.col("c_mktsegment").alias("symbol")).agg((F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / 1000).alias("position"))
    marks = c.select(F.col("c_mktsegment").alias("symbol")).distinct().filter("symbol <> 'BUILDING'").withColumn("mark", F.length("symbol").cast("double"))
    accounts = table(spark, sf, "nation").select(F.col("n_nationkey").alias("account"), (F.col("n_nationkey") * 1000.0).alias("equity"), F.lit(0.0).alias("daily_pnl"), F.col("n_regionkey").alias("open_orders"), (F.col("n_nationkey") == 3).alias("kill_switch"))
    names = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE")])
    orders = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("account"), F.get(names, (F.col("s_suppkey") % 6).cast("int")).alias("symbol"))
    out = decision.risk_state(orders, held, marks, accounts)
    return out.select("key", "account", "symbol", "mark", "equity", "open_orders", "kill_switch", *_round(out, ("position", "exposure")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bars": q_bars,
    "features_returns": _bar_query(RETURNS, features.returns),
    "features_volatility": _bar_query(VOLATILITY, lambda b, s: features.volatilities(features.returns(b, s), s)),
    "features_volume": _bar_query(VOLUME, features.volumes),
    "features_microstructure": _bar_query(MICRO, lambda b, s: features.microstructure(features.returns(b, s), s)),
    "features_bands": _bar_query(("bb_pctb_20", "stoch_k_14"), features.bands),
    "features_temporal": q_temporal, "features_recursive": q_recursive, "features_adx": q_adx, "features_book": q_book, "features_funding": q_funding, "features_cross": q_cross, "features_all": q_features,
    "asof_join": q_asof, "book_levels": q_levels, "cusum_events": q_cusum, "triple_barrier": q_barriers, "labels": q_labels,
    "samples": q_samples, "walk_forward": q_folds, "fold_cutoffs": q_cutoffs, "final_split": q_final_split, "latest_predictions": q_predictions, "pending_orders": q_pending, "normaliser": q_normaliser, "normalised": q_normalised,
    "class_weights": q_class_weights, "confusion": q_confusion, "classification_scores": q_scores, "weighted_cross_entropy": q_cross_entropy, "softmax_argmax": q_softmax,
    "order_plans": q_plans, "risk_gate": q_risk_gate, "latest_per_key": q_latest, "top_latest": q_top, "candles": q_candles, "monitoring": q_monitoring, "positions": q_positions,
    "last_by_key": q_last_by_key, "bars_held": q_held, "decode_candles": q_decode, "decode_numbers": q_props, "latest_windows": q_latest_windows, "labelled_events": q_labelled_events, "numbered_orders": q_numbered, "risk_state": q_risk_state, "filled_rates": q_filled_rates, "validation": q_validate, "table_stats": q_table_stats,
}
