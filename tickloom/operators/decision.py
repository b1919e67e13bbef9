"""From predictions to orders: signal, action, size, brackets, and the risk gate, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import _c, scale_to_horizon
from ..schemas import HORIZON, PROB_THRESHOLD, PT_MULT, RISK_FRACTION, RISK_LIMITS, SL_MULT

ORDER = "struct<symbol:string,side:string,intent:string,order_type:string,size:double,price:double>"


def signal(down="prob_down", up="prob_up", threshold: float = PROB_THRESHOLD) -> Column:
    """1, -1 or 0: the likelier direction if it reaches the threshold (up at a tie)."""
    down, up = _c(down), _c(up)
    return F.when((up >= threshold) & (up >= down), 1).when((down >= threshold) & (down > up), -1).otherwise(0)


def action(sig, position) -> Column:
    """hold, enter_long, enter_short, reverse_long or reverse_short."""
    sig, side = _c(sig), F.signum(F.coalesce(_c(position), F.lit(0.0)))
    way = F.when(sig > 0, "long").otherwise("short")
    return F.when((sig == 0) | (side == sig), "hold").when(side == 0, F.concat(F.lit("enter_"), way)).otherwise(F.concat(F.lit("reverse_"), way))


def position_size(price, sigma, equity, sl_mult: float = SL_MULT, horizon: int = HORIZON, risk_frac: float = RISK_FRACTION) -> Column:
    """Contracts that lose `risk_frac` of equity at the stop; 0 on inputs that are not positive."""
    price, sigma, equity = _c(price), _c(sigma), _c(equity)
    distance = price * (1 - F.exp(-scale_to_horizon(sigma, horizon) * sl_mult))
    good = (price > 0) & (sigma > 0) & (equity > 0) & (distance > 0)
    return F.when(good, equity * risk_frac / F.when(distance > 0, distance)).otherwise(0.0)


def brackets(price, side, sigma, pt_mult: float = PT_MULT, sl_mult: float = SL_MULT, horizon: int = HORIZON) -> tuple[Column, Column]:
    """(take-profit, stop-loss) levels, symmetric in log space with the labels' barriers."""
    way, wide = F.when(_c(side) == "buy", 1.0).otherwise(-1.0), scale_to_horizon(sigma, horizon)
    return _c(price) * F.exp(way * wide * pt_mult), _c(price) * F.exp(-way * wide * sl_mult)


def plan_orders(df: DataFrame, threshold: float = PROB_THRESHOLD, pt_mult: float = PT_MULT, sl_mult: float = SL_MULT, horizon: int = HORIZON, risk_frac: float = RISK_FRACTION) -> DataFrame:
    """`df` (symbol, prob_down, prob_up, sigma, mark, position, equity) with signal, action and `orders`.

    Orders come as close, entry, take-profit, stop; none where the action is to hold or there is no positive mark price.
    """
    df = df.withColumn("signal", signal(threshold=threshold)).withColumn("action", action("signal", "position"))
    act, pos = F.col("action"), F.coalesce("position", F.lit(0.0))
    side = F.when(act.endswith("long"), "buy").otherwise("sell")
    back = F.when(side == "buy", "sell").otherwise("buy")
    size = position_size("mark", "sigma", "equity", sl_mult, horizon, risk_frac)
    tp, sl = brackets("mark", side, "sigma", pt_mult, sl_mult, horizon)
    order = lambda side, intent, kind, size, price: F.struct(F.col("symbol").alias("symbol"), side.alias("side"), F.lit(intent).alias("intent"), F.lit(kind).alias("order_type"), size.alias("size"), price.alias("price")).cast(ORDER)
    live = (act != "hold") & F.coalesce(F.col("mark") > 0, F.lit(False))
    close = F.when(live & act.startswith("reverse") & (pos != 0), order(F.when(pos > 0, "sell").otherwise("buy"), "stop_loss", "market", F.abs(pos), F.lit(None).cast("double")))
    opens = live & (size > 0)
    found = F.array(close, F.when(opens, order(side, "entry", "limit", size, F.col("mark"))), F.when(opens, order(back, "take_profit", "limit", size, tp)), F.when(opens, order(back, "stop_loss", "market", size, sl)))
    return df.withColumn("orders", F.filter(found, lambda o: o.isNotNull()))


def exposure(positions: DataFrame) -> DataFrame:
    """(account, exposure): sum of |position| * mark over the account's symbols with a price."""
    return positions.groupBy("account").agg(F.sum(F.when(F.col("mark") != 0, F.abs("position") * F.col("mark")).otherwise(0.0)).alias("exposure"))


def risk_state(orders: DataFrame, positions: DataFrame, marks: DataFrame, accounts: DataFrame) -> DataFrame:
    """Orders (account, symbol, …) with what the risk rules need: mark, position, exposure and the account's equity, daily_pnl, open_orders, kill_switch.

    `positions` are (account, symbol, position), `marks` (symbol, mark), `accounts` a row an account.  A symbol without
    a price adds nothing to the exposure.
    """
    held = positions.join(marks, "symbol", "left").select("account", "symbol", "position", "mark")
    state = accounts.join(exposure(held), "account", "left").na.fill(0.0, ["exposure"])
    met = orders.join(positions.select("account", "symbol", "position"), ["account", "symbol"], "left").join(marks.select("symbol", "mark"), "symbol", "left")
    return met.join(state, "account").na.fill(0.0, ["position"])


def risk_reason(limits: dict | None = None) -> Column:
    """The first rule an order breaks, or null; needs side, intent, order_type, size, price, mark, position, exposure, equity, daily_pnl, open_orders, kill_switch.

    Exits pass every rule about exposure, but not those about size and price.
    """
    m = RISK_LIMITS | (limits or {})
    c, text = F.col, F.format_string
    num = lambda x: x.cast("string")
    entry, mark_ok = c("intent") == "entry", F.coalesce(c("mark") > 0, F.lit(False))
    signed = F.when(c("side") == "buy", c("size")).otherwise(-c("size"))
    held = F.coalesce(c("position"), F.lit(0.0))
    notional = F.abs(held + signed) * c("mark")
    total = c("exposure") - F.abs(held) * c("mark") + notional
    deviation = F.abs(c("price") - c("mark")) / F.when(mark_ok, c("mark"))
    leverage = total / F.when(c("equity") > 0, c("equity"))
    limit, kind = c("order_type") == "limit", F.coalesce(c("order_type"), F.lit(""))
    shaped = (c("intent").isin("entry", "take_profit") & (kind == "limit")) | ((c("intent") == "stop_loss") & (kind == "market"))
    # The order of the rules; stored orders carry the reasons.
    rules = [
        (~F.coalesce(c("side").isin("buy", "sell"), F.lit(False)), F.concat(F.lit("invalid side: "), F.coalesce("side", F.lit("null")))),
        (~F.coalesce(c("intent").isin("entry", "take_profit", "stop_loss"), F.lit(False)), F.concat(F.lit("invalid intent: "), F.coalesce("intent", F.lit("null")))),
        (~F.coalesce((c("size") > 0) & ~F.isnan("size"), F.lit(False)), F.lit("size must be > 0")),
        (c("size") < m["min_order_size"], F.concat(F.lit("size below "), F.lit(str(m["min_order_size"])))),
        (c("size") > m["max_order_size"], F.concat(F.lit("size above "), F.lit(str(m["max_order_size"])))),
        (~shaped, F.concat(F.lit("intent and order type do not fit: "), F.concat_ws("/", "intent", "order_type"))),
        (limit & F.coalesce(c("price") <= 0, F.lit(True)), F.lit("limit order requires a positive price")),
        (limit & mark_ok & (deviation > m["max_price_deviation"]), text("price deviation %.4f above limit", deviation)),
        (entry & c("kill_switch"), F.lit("kill switch active")),
        (entry & (c("daily_pnl") <= -m["daily_loss_limit"]), F.lit("daily loss limit hit")),
        (entry & (c("open_orders") >= m["max_open_orders"]), F.concat(F.lit("open orders at limit: "), num(c("open_orders")))),
        (entry & ~mark_ok, F.concat(F.lit("no mark price for "), c("symbol"))),
        (entry & ~F.coalesce(c("equity") > 0, F.lit(False)), F.lit("equity is not positive")),
        (entry & (notional > m["max_position_notional"]), text("position notional %.0f above limit", notional)),
        (entry & (total > m["max_total_notional"]), text("total notional %.0f above limit", total)),
        (entry & (leverage > m["max_leverage"]), text("leverage %.2f above limit", leverage)),
    ]
    return F.coalesce(*[F.when(F.coalesce(on, F.lit(False)), why) for on, why in rules])


def gate(orders: DataFrame, limits: dict | None = None, sent: bool = True) -> DataFrame:
    """Orders with risk_passed, reason and the status they are recorded with: open, or pending before they are `sent`, or rejected."""
    why = risk_reason(limits)
    ok = F.when(F.col("intent") == "entry", "ok").otherwise("ok (exit allowed)")
    return orders.withColumn("reason", F.coalesce(why, ok)).withColumn("risk_passed", F.col("reason").startswith("ok")).withColumn("status", F.when(F.col("risk_passed"), "open" if sent else "pending").otherwise("rejected"))


def wire_order(tif: str = "Alo") -> Column:
    """The order as an exchange request: limits with a time in force, stops as market triggers, exits reduce only."""
    stop = F.col("intent") == "stop_loss"
    kind = F.when(stop, F.to_json(F.struct(F.struct(F.col("price").alias("triggerPx"), F.lit(True).alias("isMarket"), F.lit("sl").alias("tpsl")).alias("trigger")))).otherwise(F.to_json(F.struct(F.struct(F.lit(tif).alias("tif")).alias("limit"))))
    whole = F.struct(F.col("symbol").alias("name"), (F.col("side") == "buy").alias("is_buy"), F.col("size").alias("sz"), F.col("price").alias("limit_px"), kind.alias("order_type"), (F.col("intent") != "entry").alias("reduce_only"))
    return F.when(F.col("price").isNotNull(), whole)
