"""Decision rules: strategy choice, effective configuration, verdicts, outcome texts, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brokerlens.functions.scalars import CLASS_NAMES, compact_map
from brokerlens.operators.joins import with_strategy_config

UNSURE = "HYBRID_UNKNOWN"


def select_strategy(
    df: DataFrame, min_confidence: float = 90.0, predicted: str = "prediction", confidence: str = "confidence",
    actual: str | None = None,
) -> DataFrame:
    """Strategy and workload of each prediction. A known actual label wins once confidence suffices."""
    trusted = F.coalesce(F.col(confidence) >= min_confidence, F.lit(False))
    code = F.col(predicted) if actual is None else F.coalesce(F.col(actual), F.col(predicted))
    real_time, batch = trusted & (code == 0), trusted & (code == 1)
    strategy = (
        F.when(real_time, "QUICK_REBALANCE").when(batch, "RESOURCE_OPTIMIZED").otherwise("CONTROLLED_GRADUAL")
    )
    workload = F.when(real_time, CLASS_NAMES[0]).when(batch, CLASS_NAMES[1]).otherwise(UNSURE)
    return df.withColumns({"strategy": strategy, "workload": workload})


def effective_config(df: DataFrame, dim: DataFrame, source: str = "config_source", custom: str | None = None):
    """The configuration a recovery applies: nothing for ``default``, the strategy's for ``buffer``, else custom.

    ``applied`` is FALSE only when there was no configuration at all; an empty
    configuration has nothing to apply and still succeeds.
    """
    joined = with_strategy_config(df, dim)
    empty = F.create_map().cast("map<string,string>")
    given = F.lit(None).cast("map<string,string>") if custom is None else F.col(custom)
    chosen = F.when(F.col(source) == "default", empty).when(F.col(source) == "buffer", F.col("config")).otherwise(given)
    used = F.when(F.col(source).isin("default", "buffer"), F.col(source)).when(given.isNotNull(), "custom")
    return joined.withColumns({"effective": compact_map(chosen), "config_used": used, "applied": chosen.isNotNull()})


def alignment_verdict(df: DataFrame, predicted: str = "prediction", actual: str = "actual") -> DataFrame:
    equal = F.col(predicted) == F.col(actual)
    verdict = F.when(equal.isNull(), "unknown").when(equal, "match").otherwise("mismatch")
    return df.withColumn("verdict", verdict)


def outcome(
    df: DataFrame, recovered: Column, strategy: str = "strategy", restarted: Column | None = None
) -> DataFrame:
    """Result label and detail text of a recovery."""
    # The texts of the recovery log.
    strategy = F.coalesce(F.col(strategy), F.lit("DEFAULT"))
    detail = F.when(recovered, F.format_string("Successfully recovered broker with strategy '%s'", strategy)).otherwise(
        F.format_string("Broker still unavailable after applying strategy '%s'", strategy)
    )
    if restarted is not None:
        detail = F.when(~restarted, "Failed to restart broker").otherwise(detail)
        recovered = recovered & restarted
    return df.withColumns({"result": F.when(recovered, "SUCCESS").otherwise("FAILURE"), "details": detail})


def recovery_kind(recovered: Column) -> Column:
    """Detail text of an experiment run: recovered by itself or by hand."""
    # The texts of the experiment table.
    return F.concat(F.when(recovered, "Automatic").otherwise("Manual"), F.lit(" recovery"))


# Display bands of the dashboards, as (lowest value, name).
CONFIDENCE_BANDS = [(float("-inf"), "red"), (70.0, "yellow"), (90.0, "green")]
LATENCY_BANDS = [(float("-inf"), "green"), (10.0, "yellow"), (30.0, "red")]
# Texts of the 0/1 gauges.
WORKLOAD_TEXT = {0: "REAL_TIME_EVENT_DRIVEN", 1: "BATCH_DATA_INTENSIVE"}
MATCH_TEXT = {0: "Incorrect", 1: "Correct"}


def band(column: Column | str, bands: list[tuple[float, str]]) -> Column:
    """The last band whose lowest value does not exceed the value."""
    column = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("string")
    for low, name in sorted(bands):
        out = F.when(column >= low, name).otherwise(out)
    return out


def value_text(column: Column | str, texts: dict[int, str]) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("string")
    for value, text in texts.items():
        out = F.when(column == value, text).otherwise(out)
    return out
