"""Next-session forecasts: scores of members, consensus, documents, and scoring against actual prices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.features import compute_features
from tideline.functions.windows import safe_div, series
from tideline.operators.align import join_actuals, merge_macro, require_rows
from tideline.operators.protocol import apply_lag_pca, apply_scaler
from tideline.schema import FEATURE_COLUMNS, KEYS
from tideline.sources.bars import backfill, tail_n

# The least mean confidence of an agreement, and the label below it.
LOW_CONFIDENCE, MIXED = 0.52, "MIXED / LOW CONFIDENCE"


def next_session(day: Column) -> Column:
    """The next weekday: three days after a Friday, two after a Saturday, else one."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def resolve_window(live: DataFrame, history: DataFrame, macro: DataFrame | None, need: int, steps: int = 20, pca: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The last `steps` usable feature rows of every symbol, and the symbols that have too few, with the reason. Without macro the bars have its column."""
    bars = backfill(live, history, need)
    bare = bars.drop("data_source")
    features = compute_features(bare if macro is None else merge_macro(bare, macro)).na.drop("any", subset=list(FEATURE_COLUMNS))
    ok, rejected = require_rows(tail_n(features, steps), steps)
    ok = ok.join(bars.select("symbol", "data_source").distinct(), "symbol")
    return (apply_lag_pca(ok, pca) if pca else ok), rejected


def score_member(df: DataFrame, member: str, probability: Column, predicted_return: Column, direction: Column | None = None, order: int = 0) -> DataFrame:
    """(symbol, as_of_date, member, direction, confidence, predicted_return_pct, member_order)."""
    up = direction if direction is not None else probability >= 0.5
    return df.select("symbol", "as_of_date", F.lit(member).alias("member"), F.lit(order).alias("member_order"), F.when(up, "UP").otherwise("DOWN").alias("direction"), F.when(up, probability).otherwise(1 - probability).alias("confidence"), predicted_return.alias("predicted_return_pct"))


def consensus(members: DataFrame, keys: Sequence[str] = ("symbol", "as_of_date"), threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Agreement gives the means, unless their confidence is below the threshold; else the most confident member decides, the first of equals."""
    rank = F.struct("confidence", (-F.col("member_order")).alias("o"))
    out = members.groupBy(*keys).agg(F.count_distinct("direction").alias("_k"), F.avg("confidence").alias("_c"), F.avg("predicted_return_pct").alias("_r"), F.max_by(F.struct("direction", "confidence", "predicted_return_pct"), rank).alias("_b"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("member", F.struct("direction", "confidence", "predicted_return_pct"))))).alias("models"))
    same, weak = F.col("_k") == 1, F.col("_c") < threshold
    return out.select(
        *keys, F.when(same & weak, MIXED).otherwise(F.col("_b.direction")).alias("direction"), (same & ~weak).alias("agreement"),
        F.when(same, F.col("_c")).otherwise(F.col("_b.confidence")).alias("confidence"), F.when(same, F.col("_r")).otherwise(F.col("_b.predicted_return_pct")).alias("predicted_return_pct"), "models",
    )


def macro_chain(sources: Sequence[tuple[str, DataFrame]]) -> tuple[DataFrame | None, str]:
    """The first labelled macro table that has rows, with its label; without any none, and `unavailable`."""
    return next(((df, label) for label, df in sources if not df.isEmpty()), (None, "unavailable"))


def forecast_stored(live: DataFrame, history: DataFrame, macro_sources: Sequence[tuple[str, DataFrame]], models: dict, need: int = 300, steps: int = 20) -> tuple[DataFrame, DataFrame]:
    """(forecasts, rejected): every stored member scores each symbol's last window, and their consensus is the forecast.

    models, as load_models gives them: scaler and pca, and of direction with huber (trees), and net (a sequence net), those that are there. Without
    a macro table its column is 0 and the label says so. rejected: symbols with too few usable rows, with the reason.
    """
    macro, macro_label = macro_chain(macro_sources)
    bars = live if macro is not None else live.withColumn("yield_differential", F.lit(0.0))
    past = history if macro is not None else history.withColumn("yield_differential", F.lit(0.0))
    window, rejected = resolve_window(bars, past, macro, need, steps, models["pca"])
    columns = list(models["scaler"])
    window = apply_scaler(window, {c: tuple(p) for c, p in models["scaler"].items()})
    last = F.row_number().over(series(order=F.desc("ts")))
    row = window.withColumn("_k", last).where("_k = 1").withColumn("as_of_date", F.to_date("ts")).persist()
    scored = []
    if "direction" in models and "huber" in models:
        trees = models["huber"].transform(models["direction"].transform(row))
        scored.append(score_member(trees, "trees", F.col("probability"), F.col("predicted_return"), order=0))
    if "net" in models:
        seqs = window.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", F.array(*columns).alias("x")))), lambda s: s["x"]).alias("seq"), F.to_date(F.max("ts")).alias("as_of_date"))
        scored.append(score_member(models["net"].transform(seqs), "net", F.col("probability"), F.col("predicted_return"), order=1))
    if not scored:
        raise ValueError("no member is stored")
    agreed = consensus(reduce(DataFrame.unionByName, scored))
    used = backfill(bars, past, need).join(row.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    return forecast(used, agreed, F.col("data_source"), macro_label), rejected


def forecast(asof_bars: DataFrame, agreed: DataFrame, data_source: str | Column = "live", macro_source: str | Column = "table") -> DataFrame:
    """Forecast rows with provenance: the bar used, the members and the consensus; the sources' labels are texts or columns of the bars."""
    bar = F.struct("open", "high", "low", "close", "tick_volume")
    rows = asof_bars.select("symbol", F.to_date("ts").alias("as_of_date"), bar.alias("bar_used"), F.lit(data_source).alias("data_source"), F.lit(macro_source).alias("macro_source"))
    both = rows.join(agreed, ["symbol", "as_of_date"])
    return both.select("symbol", "as_of_date", next_session(F.col("as_of_date")).alias("forecasting_date"), "data_source", "macro_source", "bar_used", "models", F.struct("direction", "agreement", "confidence", "predicted_return_pct").alias("consensus"))


def to_document(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("symbol", "as_of_date", F.to_json(F.struct(*[c for c in forecasts.columns if c != "symbol"])).alias("document"))


def to_ledger(forecasts: DataFrame) -> DataFrame:
    return forecasts.select("symbol", "as_of_date", "forecasting_date", F.col("bar_used.close").alias("as_of_close"), F.col("consensus.direction").alias("pred_direction"), F.col("consensus.predicted_return_pct").alias("pred_return_pct"), F.col("consensus.confidence").alias("pred_confidence"), F.transform_values("models", lambda k, v: v["direction"]).alias("members"), F.current_timestamp().alias("logged_at"))


def score_ledger(ledger: DataFrame, bars: DataFrame, closed_before: Column | None = None) -> DataFrame:
    """Adds actual_close, actual_return_pct, actual_direction and outcome (correct, wrong, pending)."""
    out = join_actuals(ledger, bars, closed_before)
    ret = safe_div(F.col("actual_close") - F.col("as_of_close"), F.col("as_of_close")) * 100
    out = out.withColumn("actual_return_pct", ret).withColumn("actual_direction", F.when(F.col("actual_return_pct") > 0, "UP").when(F.col("actual_return_pct").isNotNull(), "DOWN"))
    return out.withColumn("outcome", F.when(F.col("actual_direction").isNull(), "pending").when(F.col("pred_direction").startswith(F.col("actual_direction")), "correct").otherwise("wrong"))


def hit_rate(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    hit, done = F.count_if(F.col("outcome") == "correct"), F.count_if(F.col("outcome") != "pending")
    return scored.groupBy(*keys).agg(hit.alias("n_correct"), done.alias("n_resolved"), safe_div(hit, done).alias("hit_rate"))


def display_columns(scored: DataFrame) -> DataFrame:
    percent = lambda c: F.when(F.col(c).isNull(), "—").otherwise(F.format_string("%+.4f%%", F.col(c)))
    confidence = F.when(F.col("pred_confidence").isNull(), "—").otherwise(F.format_string("%.1f%%", F.bround(F.col("pred_confidence") * 100, 1)))
    return scored.select("symbol", "as_of_date", "forecasting_date", "pred_direction", percent("pred_return_pct").alias("predicted"), confidence.alias("confidence"), percent("actual_return_pct").alias("actual"), "outcome")
