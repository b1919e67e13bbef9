"""Tables, feature catalogue, defaults and validation rules."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and order of the feature columns, by category.
FEATURE_CATEGORIES: dict[str, tuple[str, ...]] = {
    "price_return": ("ret_1", "ret_5", "ret_15", "ret_30", "ret_60", "ret_240", "ret_co", "wick_up", "wick_dn", "price_pos_60", "ret_accel"),
    "volatility": ("sigma_ewma", "realized_vol_30", "parkinson_30", "garman_klass_30", "vol_of_vol_60", "downside_vol_30"),
    "volume": ("volume_log", "volume_z_60", "volume_ratio_5_30", "trade_count_log"),
    "obi": ("obi_l1", "obi_l5", "obi_l10", "bid_depth_5_log", "ask_depth_5_log", "depth_ratio_5", "obi_weighted", "microprice_dev", "bid_slope", "ask_slope"),
    "spread": ("spread_bps", "spread_z_60", "spread_vol_30"),
    "technical": ("rsi_14", "macd_line", "macd_signal", "macd_hist", "bb_pctb_20", "atr_14", "stoch_k_14", "adx_14"),
    "microstructure": ("kyle_lambda", "amihud_illiq", "roll_spread", "ofi", "vpin_50"),
    "cross_asset": ("cross_corr_60", "cross_beta_60", "cross_ret_spread"),
    "temporal": ("hour_sin", "hour_cos", "dow_sin", "dow_cos"),
    "funding_oi": ("funding_rate", "funding_z_60", "oi_log", "oi_change"),
}
FEATURE_NAMES: tuple[str, ...] = tuple(n for names in FEATURE_CATEGORIES.values() for n in names)

# Defaults on which results depend.
SYMBOLS = ("BTC", "ETH")
BAR_SECONDS = 300
RET_HORIZONS = (1, 5, 15, 30, 60, 240)
WARMUP_BARS = 1000
SIGMA_SPAN, SIGMA_MIN_PERIODS = 100, 2
HORIZON, PT_MULT, SL_MULT, H_MULT = 48, 1.0, 1.0, 1.0
SEQ_LEN, N_SPLITS, EMBARGO_BARS, CLIP_SIGMA, BAR_MINUTES, VAL_FRACTION = 128, 5, 48, 5.0, 5, 0.15
RISK_FRACTION, PROB_THRESHOLD = 0.01, 0.5
RISK_LIMITS = {
    "max_position_notional": 50_000.0, "max_total_notional": 100_000.0, "max_leverage": 5.0, "min_order_size": 1e-4,
    "max_order_size": 100.0, "max_price_deviation": 0.05, "max_open_orders": 20, "daily_loss_limit": 1_000.0,
}
LIVE_FEATURES = ("sigma_ewma", "obi_l5", "rsi_14", "macd_hist", "spread_bps", "funding_rate")


_KINDS = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "int": T.IntegerType(), "short": T.ShortType(), "long": T.LongType(), "boolean": T.BooleanType(), "money": T.DecimalType(38, 18), "doubles": T.ArrayType(T.DoubleType()),
}


def _table(text: str) -> T.StructType:
    """Columns as "name kind"; a kind with an exclamation mark is never null.  Needs no session, so workers can import it."""
    out = T.StructType()
    for name, kind in (part.split() for part in text.split(",")):
        out.add(name, _KINDS[kind.rstrip("!")], not kind.endswith("!"))
    return out


# Names and kinds of the tables' columns.
TABLES: dict[str, T.StructType] = {
    "ohlcv_bars": _table("symbol string!, time timestamp!, open double, high double, low double, close double, volume double, trades int, vwap double"),
    "orderbook_snapshots": _table("symbol string!, time timestamp!, bid_px doubles, bid_sz doubles, ask_px doubles, ask_sz doubles"),
    "funding_oi": _table("symbol string!, time timestamp!, funding_rate double, open_interest double, mark_px double, oracle_px double, premium double"),
    "bar_features": _table("symbol string!, time timestamp!, " + ", ".join(f"{n} double" for n in FEATURE_NAMES)),
    "labels": _table("symbol string!, time timestamp!, label short, ret double, sigma double, pt_level double, sl_level double, pt_mult double, sl_mult double, horizon_bars int, t1 timestamp, touch_time timestamp, touch_barrier string, sample_weight double"),
    "model_predictions": _table("symbol string!, time timestamp!, model_version string!, prob_down double, prob_flat double, prob_up double, signal short, sigma double"),
    "orders": _table("order_id long, symbol string!, time timestamp!, side string, intent string, order_type string, price money, size money, status string, filled_size money, avg_fill_price money, exchange_oid string, cloid string, risk_passed boolean, reason string"),
    "positions": _table("symbol string!, time timestamp!, size money, entry_price money, mark_price money, unrealized_pnl money, realized_pnl money, leverage double, liquidation_px money, margin_used money"),
}
KEYS = {t: ("symbol", "time") for t in TABLES} | {"model_predictions": ("symbol", "time", "model_version"), "orders": ("symbol", "time", "order_id")}
#: How a second row of one key is treated: the later wins, the first wins, or both stay.
CONFLICT = {"orderbook_snapshots": "first", "orders": "append"}

_IN = lambda c, *v: f"{c} in ({', '.join(repr(x) for x in v)})"
# The values that columns may have, by table, as SQL predicates; a row is good where none is false.
RULES: dict[str, dict[str, str]] = {t: {"symbol": _IN("symbol", *SYMBOLS)} for t in TABLES}
RULES["labels"] |= {"label": _IN("label", -1, 0, 1), "touch_barrier": _IN("touch_barrier", "pt", "sl", "vertical")}
RULES["model_predictions"] |= {"signal": _IN("signal", -1, 0, 1)}
RULES["orders"] |= {
    "side": _IN("side", "buy", "sell"), "intent": _IN("intent", "entry", "take_profit", "stop_loss"), "order_type": _IN("order_type", "limit", "market"),
    "status": _IN("status", "pending", "open", "filled", "partially_filled", "canceled", "rejected"),
    "asymmetry": "(intent in ('entry', 'take_profit') and order_type = 'limit') or (intent = 'stop_loss' and order_type = 'market')",
}
