"""Queries of projections, filters, scalar functions, nested messages and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from brokerlens.functions import nested, rules, scalars
from brokerlens.operators import joins
from brokerlens.plans import views
from brokerlens.plans.registry import PROGRESS_SQL, RECOVERY_SQL, query, rounded, us


def recovery(spark, sf_dir):
    return views.recovery(spark, sf_dir)


@query("p1_project", f"""WITH {PROGRESS_SQL} SELECT us AS ts, workload_type, cpu_usage, memory_usage FROM prg""")
def p1(spark, sf):
    rows = views.progress(spark, sf).withColumn("ts", us("timestamp"))
    return scalars.project_features(rows, ["cpu_usage", "memory_usage"], ["ts", "workload_type"])


@query("p2_recode", f"""WITH {RECOVERY_SQL} SELECT id, line, price,
    CASE config_source WHEN 'default' THEN 'baseline' WHEN 'buffer' THEN 'ARMS' ELSE config_source END AS configuration FROM rec""")
def p2(spark, sf):
    rows = scalars.recode(recovery(spark, sf), "config_source", scalars.CONFIGURATION_NAMES, "configuration")
    return rows.select("id", "line", "price", "configuration")


@query("p3_scale", f"""WITH {RECOVERY_SQL} SELECT id, line, price, round(cpu_usage_percent * 100, 4) AS cpu_usage_percent FROM rec""")
def p3(spark, sf):
    rows = scalars.scale(recovery(spark, sf), "cpu_usage_percent", 100.0)
    return rounded(rows.select("id", "line", "price", "cpu_usage_percent"), ["cpu_usage_percent"])


@query("p4_labels", f"""WITH {RECOVERY_SQL} SELECT o_orderkey AS id,
    CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'batch' ELSE 'real-time' END AS workload,
    CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'batch' ELSE 'real-time' END AS canonical,
    CASE o_orderstatus WHEN 'F' THEN 'REAL_TIME_EVENT_DRIVEN' WHEN 'O' THEN 'BATCH_DATA_INTENSIVE' ELSE 'UNKNOWN' END AS class_name,
    CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'batch' ELSE 'real_time' END ||
      CASE WHEN o_orderstatus = 'F' THEN '_with_arms' ELSE '_without_arms' END AS scenario
    FROM orders""")
def p4(spark, sf):
    batch = F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")
    code = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    raw = F.when(batch, "BATCH_DATA_INTENSIVE").otherwise("REAL_TIME_EVENT_DRIVEN")
    return views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        scalars.batch_or_real_time(raw).alias("workload"),
        scalars.canonical_workload(raw).alias("canonical"),
        scalars.class_name(code).alias("class_name"),
        scalars.scenario_name(F.when(batch, "batch").otherwise("real_time"), F.col("o_orderstatus") == "F").alias("scenario"),
    )


@query("p5_group_key", f"""WITH {RECOVERY_SQL} SELECT config_source || '_' || workload_type AS grp, CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY 1""")
def p5(spark, sf):
    return recovery(spark, sf).groupBy(scalars.group_key("config_source", "workload_type").alias("grp")).agg(F.count("*").alias("n"))


@query("p6_parse_ts", """SELECT event_id, epoch_us(ts) AS iso, epoch_us(date_trunc('second', ts)) AS spaced, epoch_us(date_trunc('second', ts)) AS epoch,
    CAST(NULL AS BIGINT) AS bad FROM events""")
def p6(spark, sf):
    text = {
        "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "spaced": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "epoch": F.unix_timestamp("ts").cast("string"),
        "bad": F.lit("N/A"),
    }
    rows = views.events(spark, sf).select("event_id", *[c.alias(n) for n, c in text.items()])
    return rows.select("event_id", *[us(scalars.parse_ts(n)).alias(n) for n in text])


@query("p7_changes", """SELECT l_orderkey AS id, l_linenumber AS line, round(l_extendedprice, 2) AS price,
    l_linenumber - CAST(l_quantity AS INTEGER) AS under_replicated_change, round(l_tax - l_discount, 4) AS offline_change FROM lineitem""")
def p7(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round("l_extendedprice", 2).alias("price"),
        F.col("l_quantity").cast("int").alias("before"), "l_discount", "l_tax",
    )
    rows = scalars.add_changes(rows, {"under_replicated_change": ("before", "line"), "offline_change": ("l_discount", "l_tax")})
    return rounded(rows.drop("before", "l_discount", "l_tax"), ["offline_change"])


@query("p8_sentinels", """SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS kind,
    CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS DOUBLE) END AS reading,
    CASE WHEN user_id % 7 <> 0 THEN value END AS text_reading FROM events""")
def p8(spark, sf):
    rows = views.events(spark, sf).select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(F.when(F.col("user_id") % 2 == 0, "N/A").otherwise("")).alias("kind"),
        F.when(F.col("user_id") % 10 == 0, -1).otherwise(F.col("user_id")).alias("reading"),
        F.when(F.col("user_id") % 7 == 0, "N/A").otherwise(F.col("value").cast("string")).alias("text_reading"),
    )
    return scalars.nullify_sentinels(rows, ["kind"], ["reading", "text_reading"])


@query("p9_impute", """SELECT event_id, round(coalesce(CASE WHEN user_id % 5 <> 0 THEN value END,
      avg(CASE WHEN user_id % 5 <> 0 THEN value END) OVER ()), 4) AS value, CAST(NULL AS DOUBLE) AS empty FROM events""")
def p9(spark, sf):
    rows = views.events(spark, sf).select(
        "event_id", F.when(F.col("user_id") % 5 != 0, F.col("value")).alias("value"), F.lit(None).cast("double").alias("empty")
    )
    return rounded(scalars.impute_mean(rows, ["value", "empty"]), ["value"])


@query("p10_filters", """SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'signup') AND value BETWEEN 10 AND 60
    AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def p10(spark, sf):
    rows = views.table(spark, sf, "events")
    span = F.col("ts").between(F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    condition = F.col("event_type").isin("error", "signup") & F.col("value").between(10, 60) & span
    return scalars.where(rows, condition).select("event_id", "event_type", "value")


@query("p11_matchers", """SELECT epoch_us(ts) AS ts, value FROM events WHERE event_type = 'click' AND regexp_full_match(CAST(user_id % 3 + 1 AS VARCHAR), '[12]')""")
def p11(spark, sf):
    rows = views.samples(spark, sf).filter(F.col("metric") == "click")
    return scalars.match_labels(rows, regex={"broker": "[12]"}).select(us("ts").alias("ts"), "value")


@query("p12_math", """SELECT event_id, round(abs(value - 50), 4) AS distance, round(-log10(value / 1000), 6) AS strength,
    round_even(round(value * 100) / 2, 0) AS half FROM events""")
def p12(spark, sf):
    return views.events(spark, sf).select(
        "event_id",
        F.round(F.abs(F.col("value") - 50), 4).alias("distance"),
        F.round(scalars.neg_log10(F.col("value") / 1000), 6).alias("strength"),
        scalars.round_like_pandas(F.round(F.col("value") * 100) / 2, 0).alias("half"),
    )


@query("p13_align", """SELECT event_id, (epoch_us(ts) // 30000000 + 1) * 30000000 AS boundary FROM events""")
def p13(spark, sf):
    return views.events(spark, sf).select("event_id", us(scalars.align_up("ts", 30)).alias("boundary"))


@query("p14_interval", """SELECT event_id, CASE WHEN user_id > 0 THEN least(10.0::DOUBLE, user_id / 6.0::DOUBLE) ELSE 10.0::DOUBLE END AS seconds FROM events""")
def p14(spark, sf):
    return views.events(spark, sf).select("event_id", scalars.effective_interval(F.lit(10.0), "user_id").alias("seconds"))


@query("p15_missing", """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'a' WHEN user_id % 3 = 0 THEN 'b' END AS missing,
    CASE WHEN user_id % 4 = 0 OR user_id % 3 = 0 THEN 'UNKNOWN' ELSE 'READY' END AS type FROM events""")
def p15(spark, sf):
    rows = views.events(spark, sf).select(
        "event_id", F.when(F.col("user_id") % 4 != 0, F.col("value")).alias("a"), F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("b")
    )
    rows = rows.withColumn("missing", scalars.missing_feature(["a", "b"]))
    return rows.select("event_id", "missing", F.when(F.col("missing").isNotNull(), "UNKNOWN").otherwise("READY").alias("type"))


@query("p16_organize", """SELECT user_id AS "user", event_id, event_type AS kind, value FROM events""")
def p16(spark, sf):
    return scalars.organize(views.events(spark, sf), ["ts", "props"], ["user_id"], {"user_id": "user", "event_type": "kind"})


@query("p17_compact_map", """SELECT event_id, CAST(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS entries,
    user_id % 2 <> 0 AND user_id % 3 <> 0 AS nothing FROM events""")
def p17(spark, sf):
    config = F.create_map(
        F.lit("x"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")), F.lit("y"), F.when(F.col("user_id") % 3 == 0, F.lit("1"))
    )
    rows = views.events(spark, sf).select("event_id", config.alias("config"))
    return rows.select("event_id", F.size(scalars.compact_map("config")).alias("entries"), scalars.nothing_to_apply("config").alias("nothing"))


@query("p18_map_json", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '{"kind":"' || event_type || '"}' ELSE '' END AS text,
    CASE WHEN user_id % 2 = 0 THEN event_type END AS back, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def p18(spark, sf):
    config = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("kind"), F.col("event_type")))
    rows = views.events(spark, sf).select("event_id", "props", scalars.map_to_json(config).alias("text"))
    return rows.select(
        "event_id", "text", scalars.json_to_map("text")["kind"].alias("back"), scalars.json_to_map("props")["k"].cast("int").alias("k")
    )


@query("p19_brokers", f"""WITH {RECOVERY_SQL} SELECT split_part(broker_url, ':', 1) AS host,
    CAST(regexp_replace(split_part(broker_url, ':', 1), '[^0-9]', '', 'g') AS INTEGER) AS id,
    CASE split_part(broker_url, ':', 1) WHEN 'kafka2' THEN '9981' WHEN 'kafka3' THEN '9982' ELSE '9980' END AS port,
    CAST(count(*) AS BIGINT) AS n FROM rec GROUP BY ALL""")
def p19(spark, sf):
    rows = scalars.primary_brokers(recovery(spark, sf))
    return rows.groupBy(
        scalars.host_of("broker_url").alias("host"), scalars.broker_id("broker_url").alias("id"), scalars.jmx_port("broker_url").alias("port")
    ).agg(F.count("*").alias("n"))


@query("p20_fallback", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN value WHEN user_id % 3 = 0 THEN CAST(user_id AS DOUBLE) ELSE -1.0::DOUBLE END AS reading FROM events""")
def p20(spark, sf):
    first = F.when(F.col("user_id") % 2 == 0, F.col("value").cast("string")).otherwise("NaN")
    second = F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")).otherwise("none")
    return views.events(spark, sf).select("event_id", scalars.first_usable(first, second, unknown=-1.0).alias("reading"))


# ---------------------------------------------------------------- nested messages

_TURNS = "CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS key"


@query("n1_parse", f"""SELECT {_TURNS}, CASE WHEN role = 'user' THEN 'real_time' ELSE 'batch' END AS shape,
    CASE WHEN role = 'user' THEN CAST(turn AS DOUBLE) END AS seconds, CASE WHEN role <> 'user' THEN CAST(conv_id AS INTEGER) END AS batch_id,
    CAST(len(string_split(text, ' ')) AS INTEGER) AS words FROM conversations""")
def n1(spark, sf):
    rows = nested.parse_messages(views.messages(spark, sf))
    return rows.select(
        "key", "shape", F.col("message.metadata.duration_seconds").alias("seconds"), F.col("message.batch_metadata.batch_id").alias("batch_id"),
        F.size("message.results.words").alias("words"),
    )


@query("n2_transcript", f"SELECT {_TURNS}, text AS transcript FROM conversations")
def n2(spark, sf):
    rows = nested.parse_messages(views.messages(spark, sf))
    return rows.select("key", nested.transcript("message.results.words").alias("transcript"))


@query("n3_payload", """SELECT role, CAST(count(*) AS BIGINT) AS messages, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, round(avg(strlen(text)), 4) AS avg_bytes,
    CAST(min(strlen(text)) AS INTEGER) AS min_bytes, CAST(max(strlen(text)) AS INTEGER) AS max_bytes FROM conversations GROUP BY role""")
def n3(spark, sf):
    return rounded(nested.payload_stats(views.table(spark, sf, "conversations"), ["role"], "text"), ["avg_bytes"])


@query("n3_running_payload", """SELECT event_type, epoch_us(ts) AS ts, CAST(count(*) OVER w AS BIGINT) AS messages,
    round(sum(strlen(props)) OVER w / count(*) OVER w, 4) AS avg_bytes FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def n3_running(spark, sf):
    rows = nested.running_payload(views.events(spark, sf), ["event_type"], value="props")
    return rounded(rows.withColumn("ts", us("ts")), ["avg_bytes"])


@query("n4_taxonomy", """SELECT CASE WHEN role = 'user' THEN 'real_time' ELSE 'batch' END AS latency_sensitivity,
    CASE WHEN role = 'user' THEN 'mission_critical' ELSE 'best_effort' END AS data_criticality,
    CASE WHEN role = 'user' THEN 'event_driven' ELSE 'batch' END AS processing_pattern,
    'class_' || CAST(turn % 3 AS VARCHAR) AS resource_intensity, CAST(count(*) AS BIGINT) AS messages FROM conversations GROUP BY ALL""")
def n4(spark, sf):
    return nested.taxonomy_counts(nested.parse_messages(views.messages(spark, sf)))


@query("n5_words", f"""SELECT key, CAST(position - 1 AS INTEGER) AS position, word, round((position - 1) * 0.3, 4) AS start_time, round(position * 0.3, 4) AS end_time
    FROM (SELECT {_TURNS}, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS position FROM conversations)""")
def n5(spark, sf):
    rows = nested.word_offsets(nested.parse_messages(views.messages(spark, sf)), ["key"])
    return rounded(rows, ["start_time", "end_time"])


# ---------------------------------------------------------------- rules


def predictions(spark, sf):
    """Events as predictions: class, confidence and, for some, the actual class."""
    return views.events(spark, sf).select(
        "event_id", "ts",
        (F.col("user_id") % 3).cast("int").alias("prediction"),
        F.least(F.col("value"), F.lit(100.0)).alias("confidence"),
        F.when(F.col("user_id") % 5 != 0, (F.col("user_id") % 2).cast("int")).alias("actual"),
    )


_PREDICTIONS = """prd AS (SELECT event_id, ts, user_id % 3 AS prediction, least(value, 100.0) AS confidence,
    CASE WHEN user_id % 5 <> 0 THEN user_id % 2 END AS actual FROM events)"""


@query("r1_strategy", f"""WITH {_PREDICTIONS}, c AS (SELECT *, coalesce(actual, prediction) AS code FROM prd)
    SELECT event_id, CASE WHEN confidence >= 90 AND code = 0 THEN 'QUICK_REBALANCE' WHEN confidence >= 90 AND code = 1 THEN 'RESOURCE_OPTIMIZED'
      ELSE 'CONTROLLED_GRADUAL' END AS strategy,
      CASE WHEN confidence >= 90 AND code = 0 THEN 'REAL_TIME_EVENT_DRIVEN' WHEN confidence >= 90 AND code = 1 THEN 'BATCH_DATA_INTENSIVE'
      ELSE 'HYBRID_UNKNOWN' END AS workload FROM c""")
def r1(spark, sf):
    return rules.select_strategy(predictions(spark, sf), actual="actual").select("event_id", "strategy", "workload")


@query("r2_config", """SELECT event_id, source AS config_used, source IN ('default') OR strategy IS NOT NULL AS applied,
    CASE WHEN source = 'buffer' THEN CASE strategy WHEN 'QUICK_REBALANCE' THEN '10000' WHEN 'RESOURCE_OPTIMIZED' THEN '30000' WHEN 'CONTROLLED_GRADUAL' THEN '30000' END END AS lag_ms,
    CASE WHEN source = 'buffer' AND strategy IS NOT NULL THEN 6 WHEN source = 'default' THEN 0 END AS entries
    FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'default' ELSE 'buffer' END AS source,
      CASE user_id % 4 WHEN 0 THEN 'QUICK_REBALANCE' WHEN 1 THEN 'RESOURCE_OPTIMIZED' WHEN 2 THEN 'CONTROLLED_GRADUAL' END AS strategy FROM events)""")
def r2(spark, sf):
    names = F.array(*[F.lit(n) for n in joins.STRATEGY_CONFIGS])
    rows = views.events(spark, sf).select(
        "event_id", F.when(F.col("user_id") % 2 == 0, "default").otherwise("buffer").alias("config_source"),
        F.get(names, (F.col("user_id") % 4).cast("int")).alias("strategy"),
    )
    out = rules.effective_config(rows, joins.strategy_dimension(spark))
    entries = F.when(F.col("effective").isNotNull(), F.size("effective"))
    return out.select("event_id", "config_used", "applied", F.col("effective")["replica.lag.time.max.ms"].alias("lag_ms"), entries.alias("entries"))


@query("r3_verdict", f"""WITH {_PREDICTIONS} SELECT event_id, CASE WHEN actual IS NULL THEN 'unknown' WHEN actual = prediction THEN 'match' ELSE 'mismatch' END AS verdict FROM prd""")
def r3(spark, sf):
    return rules.alignment_verdict(predictions(spark, sf)).select("event_id", "verdict")


@query("r4_outcome", f"""WITH {RECOVERY_SQL} SELECT result, details, kind, CAST(count(*) AS BIGINT) AS n FROM (
    SELECT CASE WHEN recovery_time_seconds <= 40 THEN 'SUCCESS' ELSE 'FAILURE' END AS result,
      CASE WHEN recovery_time_seconds <= 40 THEN 'Successfully recovered broker with strategy ''' || strategy || ''''
           ELSE 'Broker still unavailable after applying strategy ''' || strategy || '''' END AS details,
      CASE WHEN recovery_time_seconds <= 40 THEN 'Automatic' ELSE 'Manual' END || ' recovery' AS kind FROM rec) GROUP BY ALL""")
def r4(spark, sf):
    done = F.col("recovery_time_seconds") <= 40
    rows = rules.outcome(recovery(spark, sf), done).withColumn("kind", rules.recovery_kind(done))
    return rows.groupBy("result", "details", "kind").agg(F.count("*").alias("n"))


@query("r5_bands", f"""WITH {_PREDICTIONS} SELECT event_id, CASE WHEN confidence >= 90 THEN 'green' WHEN confidence >= 70 THEN 'yellow' ELSE 'red' END AS confidence_band,
    CASE WHEN confidence >= 30 THEN 'red' WHEN confidence >= 10 THEN 'yellow' ELSE 'green' END AS latency_band,
    CASE prediction WHEN 0 THEN 'REAL_TIME_EVENT_DRIVEN' WHEN 1 THEN 'BATCH_DATA_INTENSIVE' END AS text FROM prd""")
def r5(spark, sf):
    return predictions(spark, sf).select(
        "event_id", rules.band("confidence", rules.CONFIDENCE_BANDS).alias("confidence_band"),
        rules.band("confidence", rules.LATENCY_BANDS).alias("latency_band"), rules.value_text("prediction", rules.WORKLOAD_TEXT).alias("text"),
    )
