"""Fixed row contracts. Nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampType()
DEC = T.DecimalType(18, 8)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


#: A tick as it arrives: numbers are text, sizes are optional.
TICK = _struct(
    ("product_id", S), ("timestamp", S), ("price", S), ("best_bid", S), ("best_ask", S),
    ("volume_24_h", S), ("bid_size", S), ("ask_size", S), ("ingest_mode", S),
)

#: Websocket envelope around ticks.
ENVELOPE = _struct(
    ("channel", S),
    ("timestamp", S),
    ("sequence_num", L),
    (
        "events",
        T.ArrayType(
            _struct(
                ("type", S),
                (
                    "tickers",
                    T.ArrayType(
                        _struct(
                            ("product_id", S), ("price", S), ("best_bid", S), ("best_ask", S),
                            ("volume_24_h", S), ("best_bid_quantity", S), ("best_ask_quantity", S),
                        )
                    ),
                ),
            )
        ),
    ),
)

PREDICTION = _struct(
    ("event_id", S), ("source_partition", I), ("source_offset", L), ("feature_ts", S), ("api_ts", S),
    ("model_variant", S), ("model_version", S), ("score", D), ("vol_60s", D), ("spread_bps", D),
    ("log_return", D), ("trade_intensity_60s", D), ("feature_id", S), ("stream_epoch", I), ("tau", D),
    ("run_id", S), ("market_price", D), ("stream_id", S), ("ingest_mode", S), ("product_id", S),
)

#: `written_at` is stamped when the outcome is stored, it is not on the wire.
OUTCOME = _struct(
    ("feature_id", S), ("stream_epoch", I), ("product_id", S), ("feature_ts", S),
    ("future_vol_60s", D), ("vol_spike", I), ("label_schema", S), ("stream_id", S),
)
STORED_OUTCOME = T.StructType([*OUTCOME.fields, T.StructField("written_at", S, True)])

FEATURE = _struct(
    ("product_id", S), ("timestamp", S), ("price", D), ("midprice", D), ("log_return", D),
    ("spread_abs", D), ("spread_bps", D), ("vol_60s", D), ("mean_return_60s", D), ("n_ticks_60s", L),
    ("trade_intensity_60s", D), ("spread_mean_60s", D), ("price_range_60s", D), ("feature_set_id", S),
    ("feature_schema_version", S), ("future_vol_60s", D), ("vol_spike", L),
)

CHANGE = _struct(("side", S), ("price", DEC), ("quantity", DEC))
ANCHOR = _struct(
    ("product_id", S), ("anchor_second", TS), ("source_sequence_num", L), ("best_bid", DEC),
    ("best_ask", DEC), ("bid_book", T.MapType(DEC, DEC)), ("ask_book", T.MapType(DEC, DEC)),
)
DELTA = _struct(
    ("product_id", S), ("changed_second", TS), ("source_sequence_num_start", L),
    ("source_sequence_num_end", L), ("best_bid", DEC), ("best_ask", DEC), ("changes", T.ArrayType(CHANGE)),
)
REPLAY_METADATA = _struct(
    ("product_id", S), ("window_start", TS), ("window_end", TS), ("status", S), ("gap_count", I),
    ("metadata", S),
)
BOOK_STATE = _struct(
    ("source", S), ("product_id", S), ("observed_through", TS), ("sequence_start", L), ("sequence_end", L),
    ("best_bid", DEC), ("bid_size", DEC), ("best_ask", DEC), ("ask_size", DEC), ("segment_id", L),
    ("changes_json", S), ("source_revision", S), ("source_date", S),
)
TRADE = _struct(
    ("source", S), ("product_id", S), ("trade_id", S), ("event_time", TS), ("price", DEC), ("size", DEC),
    ("reported_side", S), ("side_semantics", S), ("source_date", S),
)
MODEL_TICK_COLUMNS = (
    "product_id", "timestamp", "price", "best_bid", "best_ask", "bid_size", "ask_size", "trade_id",
    "trade_size", "reported_side", "book_observed_through", "segment_id",
)


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> DataFrame:
    """Fail with the sorted list of missing columns, or return the frame."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what}; missing required columns: {missing}")
    return df


def exact_columns(df: DataFrame, expected: Iterable[str], what: str) -> DataFrame:
    """Fail unless the columns match the contract in name and order."""
    if list(df.columns) != list(expected):
        raise ValueError(f"{what}: columns {df.columns} differ from the contract {list(expected)}")
    return df
