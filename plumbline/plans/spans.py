"""Span queries: ``events`` in groups of eight as traces, each a binary tree of spans."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spans as S
from .registry import Tables, query

X = "(SELECT event_id // 8 AS trace_id, event_id AS span_id, CASE WHEN event_id % 8 > 0 THEN event_id - event_id % 8 + (event_id % 8 - 1) // 2 END AS parent_span_id, event_type AS service, 'op' || (user_id % 3)::VARCHAR AS operation, (event_id % 8 * 10)::DOUBLE AS start_ms, value AS duration_ms, value > 200 AS error, ts FROM events)"


def spans(t: Tables) -> DataFrame:
    k = F.col("event_id") % 8
    return t.events.select(F.floor(F.col("event_id") / 8).alias("trace_id"), F.col("event_id").alias("span_id"), F.when(k > 0, F.col("event_id") - k + F.floor((k - 1) / 2)).alias("parent_span_id"), F.col("event_type").alias("service"), F.concat(F.lit("op"), (F.col("user_id") % 3).cast("string")).alias("operation"), (k * 10).cast("double").alias("start_ms"), F.col("value").alias("duration_ms"), (F.col("value") > 200).alias("error"), "ts")


_AN = f"SELECT s.*, coalesce(c.n, 0) AS children, greatest(0, duration_ms - coalesce(c.ms, 0)) AS self_ms, duration_ms > 100 AS slow, duration_ms / 100 AS slowness FROM {X} s LEFT JOIN (SELECT trace_id AS t, parent_span_id AS p, count(*) AS n, sum(duration_ms) AS ms FROM {X} WHERE parent_span_id IS NOT NULL GROUP BY ALL) c ON c.t = s.trace_id AND c.p = s.span_id"


@query(f"SELECT service, sum(children)::BIGINT AS children, sum(self_ms) AS self_ms, count(*) FILTER (WHERE slow) AS slow, max(slowness) AS slowness FROM ({_AN}) GROUP BY 1", "self_ms slowness")
def span_analysis(t: Tables) -> DataFrame:
    return S.analyzed(spans(t)).groupBy("service").agg(F.sum("children").alias("children"), F.sum("self_ms").alias("self_ms"), F.count_if("slow").alias("slow"), F.max("slowness").alias("slowness"))


_SM = "SELECT {by}, count(*) AS n, count(*) FILTER (WHERE error) AS errors, avg(duration_ms) AS mean, min(duration_ms) AS min, max(duration_ms) AS max, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99, count(*) / greatest((max(start_ms + duration_ms) - min(start_ms)) / 1000, 1) AS throughput, count(*) FILTER (WHERE error)::DOUBLE / count(*) AS error_rate FROM {x} GROUP BY ALL"
_D = "mean min max p50 p95 p99 throughput error_rate"


@query(_SM.format(by="service", x=X), _D)
def span_service_metrics(t: Tables) -> DataFrame:
    return S.service_metrics(spans(t))


@query(_SM.format(by="service, operation", x=X), _D)
def span_operation_metrics(t: Tables) -> DataFrame:
    return S.service_metrics(spans(t), ("service", "operation"))


_TRACES = f"SELECT trace_id, min(span_id) FILTER (WHERE parent_span_id IS NULL) AS root, count(*) AS spans, count(DISTINCT service) AS services, count(*) FILTER (WHERE error) AS errors, min(start_ms) AS start_ms, max(start_ms + duration_ms) AS end_ms, coalesce(min_by(duration_ms, span_id) FILTER (WHERE parent_span_id IS NULL), max(duration_ms)) AS duration_ms FROM {X} GROUP BY 1"


@query(_TRACES, "start_ms end_ms duration_ms")
def trace_summary(t: Tables) -> DataFrame:
    return S.traces(spans(t))


@query(f"WITH RECURSIVE s AS MATERIALIZED {X}, d AS (SELECT trace_id, span_id, 1 AS depth FROM s WHERE parent_span_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, d.depth + 1 FROM d JOIN s ON s.trace_id = d.trace_id AND s.parent_span_id = d.span_id) SELECT depth, count(*) AS n FROM d GROUP BY 1")
def trace_depth(t: Tables) -> DataFrame:
    return S.depths(spans(t)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT service, greatest(0, 100 - least(30, error_rate * 300) - CASE WHEN p99 > 500 THEN 40 WHEN p99 > 200 THEN 20 WHEN p99 > 100 THEN 10 ELSE 0 END) AS health FROM ({_SM.format(by='service', x=X)})", "health")
def service_health(t: Tables) -> DataFrame:
    return S.service_metrics(spans(t)).select("service", S.health_score(F.col("error_rate"), F.col("p99"), 100.0).alias("health"))


_MAP = "SELECT src, dst, calls, errors, mean, p99, calls / sum(calls) OVER () AS share FROM (SELECT p.service AS src, s.service AS dst, count(*) AS calls, count(*) FILTER (WHERE s.error) AS errors, avg(s.duration_ms) AS mean, quantile_cont(s.duration_ms, 0.99) AS p99 FROM {x} s JOIN {x} p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id WHERE p.service <> s.service {w} GROUP BY ALL)"


@query(_MAP.format(x=X, w=""), "mean p99 share")
def service_map(t: Tables) -> DataFrame:
    return S.service_map(spans(t))


@query(f"SELECT * FROM ({_MAP.format(x=X, w='')}) WHERE share >= 0.05 OR errors > 50", "mean p99 share")
def service_map_pruned(t: Tables) -> DataFrame:
    return S.service_map(spans(t)).filter((F.col("share") >= 0.05) | (F.col("errors") > 50))


@query(f"SELECT src, dst FROM ({_MAP.format(x=X, w='AND s.duration_ms > 20')}) EXCEPT SELECT src, dst FROM ({_MAP.format(x=X, w='AND s.duration_ms > 90')})")
def service_map_ghost_edges(t: Tables) -> DataFrame:
    s = spans(t)
    both = s.join(s.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("src")), S.PARENT).filter("src != service").withColumnRenamed("service", "dst")
    return S.ghost_edges(both.filter("duration_ms > 90").select("src", "dst").distinct(), both.filter("duration_ms > 20").select("src", "dst").distinct())


@query("SELECT p_name, lower(regexp_replace(regexp_replace(trim(p_type || 'SizeOf ' || p_name), '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[\\s_.]+', '-', 'g')) AS canonical FROM part")
def service_canonical_name(t: Tables) -> DataFrame:
    return t.part.select("p_name", S.canonical(F.concat("p_type", F.lit("SizeOf "), "p_name")).alias("canonical"))


_O = f"(SELECT trace_id, span_id, CASE WHEN span_id % 11 = 3 AND parent_span_id IS NOT NULL THEN -1 ELSE parent_span_id END AS parent_span_id, service, start_ms, duration_ms FROM {X})"


@query(f"WITH s AS MATERIALIZED {_O} SELECT trace_id, span_id, CASE WHEN parent_span_id = -1 THEN coalesce((SELECT min_by(p.span_id, (p.duration_ms, p.span_id)) FROM s p WHERE p.trace_id = s.trace_id AND p.span_id <> s.span_id AND p.start_ms <= s.start_ms AND p.start_ms + p.duration_ms >= s.start_ms + s.duration_ms), (SELECT min(p.span_id) FROM s p WHERE p.trace_id = s.trace_id AND p.parent_span_id IS NULL AND p.span_id <> s.span_id)) ELSE parent_span_id END AS parent_span_id FROM s")
def trace_orphans_adopted(t: Tables) -> DataFrame:
    o = spans(t).withColumn("parent_span_id", F.when((F.col("span_id") % 11 == 3) & F.col("parent_span_id").isNotNull(), F.lit(-1).cast("long")).otherwise(F.col("parent_span_id")))
    return S.orphans_adopted(o).select("trace_id", "span_id", "parent_span_id")


@query(f"WITH RECURSIVE s AS MATERIALIZED {X}, b AS MATERIALIZED (SELECT trace_id, parent_span_id, max_by(span_id, (duration_ms, -span_id)) AS span_id FROM s WHERE parent_span_id IS NOT NULL GROUP BY ALL), c AS (SELECT trace_id, 1 AS depth, span_id FROM s WHERE parent_span_id IS NULL UNION ALL SELECT c.trace_id, c.depth + 1, b.span_id FROM c JOIN b ON b.trace_id = c.trace_id AND b.parent_span_id = c.span_id) SELECT c.trace_id, c.depth, c.span_id, s.service, s.duration_ms FROM c JOIN s USING (span_id)", "duration_ms")
def trace_critical_path(t: Tables) -> DataFrame:
    return S.critical_path(spans(t))


@query(f"SELECT trace_id, sum(CASE WHEN ns >= start_ms + duration_ms THEN least(duration_ms, nd) ELSE 0 END) AS parallel_ms FROM (SELECT *, lead(duration_ms) OVER w AS nd, lead(start_ms) OVER w AS ns FROM {X} WHERE parent_span_id IS NOT NULL WINDOW w AS (PARTITION BY trace_id, parent_span_id ORDER BY start_ms, span_id)) GROUP BY 1", "parallel_ms")
def trace_parallelization(t: Tables) -> DataFrame:
    return S.parallelizable(spans(t))


@query(f"SELECT service, operation, a.m AS before, b.m AS after, coalesce(b.m, 0) - coalesce(a.m, 0) AS delta FROM (SELECT service, operation, avg(duration_ms) AS m FROM {X} WHERE trace_id = 3 GROUP BY ALL) a FULL JOIN (SELECT service, operation, avg(duration_ms) AS m FROM {X} WHERE trace_id = 5 GROUP BY ALL) b USING (service, operation) WHERE abs(coalesce(b.m, 0) - coalesce(a.m, 0)) > 1", "before after delta")
def trace_comparison(t: Tables) -> DataFrame:
    s = spans(t)
    return S.compared(s.filter("trace_id = 3"), s.filter("trace_id = 5"))


@query(f"SELECT service, operation, avg(self_ms / whole) AS contribution, count(*) AS n FROM (SELECT a.*, w.duration_ms AS whole FROM ({_AN}) a JOIN ({_TRACES}) w USING (trace_id)) WHERE whole > 0 GROUP BY ALL ORDER BY contribution DESC, service, operation LIMIT 5", "contribution")
def trace_bottlenecks(t: Tables) -> DataFrame:
    return S.bottlenecks(spans(t))


@query("SELECT 't' || trace_id::VARCHAR AS trace_id, span_id::VARCHAR AS span_id, parent_span_id::VARCHAR AS parent_span_id, operation, service, 'SERVER' AS kind, start_ms, floor(duration_ms * 1000) / 1000 AS duration_ms, error FROM " + X, "start_ms duration_ms")
def trace_from_otlp(t: Tables) -> DataFrame:
    ns = lambda c: F.floor(c * 1000).cast("long") * 1000
    span = F.struct(F.concat(F.lit("t"), F.col("trace_id").cast("string")).alias("traceId"), F.col("span_id").cast("string").alias("spanId"), F.coalesce(F.col("parent_span_id").cast("string"), F.lit("")).alias("parentSpanId"), F.col("operation").alias("name"), F.lit(2).alias("kind"), ns(F.col("start_ms")).cast("string").alias("startTimeUnixNano"), (ns(F.col("start_ms")) + ns(F.col("duration_ms"))).cast("string").alias("endTimeUnixNano"), F.struct(F.when(F.col("error"), 2).otherwise(1).alias("code")).alias("status"))
    doc = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return S.otlp(spans(t).select(doc.alias("json")))


@query("SELECT 't' || trace_id::VARCHAR AS trace_id, span_id::VARCHAR AS span_id, parent_span_id::VARCHAR AS parent_span_id, operation, service, 'CLIENT' AS kind, start_ms, floor(duration_ms * 1000) / 1000 AS duration_ms, error FROM " + X, "start_ms duration_ms")
def trace_from_zipkin(t: Tables) -> DataFrame:
    us = lambda c: F.floor(c * 1000).cast("long")
    span = F.struct(F.concat(F.lit("t"), F.col("trace_id").cast("string")).alias("traceId"), F.col("span_id").cast("string").alias("id"), F.col("parent_span_id").cast("string").alias("parentId"), F.col("operation").alias("name"), F.lit("client").alias("kind"), us(F.col("start_ms")).alias("timestamp"), us(F.col("duration_ms")).alias("duration"), F.struct(F.col("service").alias("serviceName")).alias("localEndpoint"), F.when(F.col("error"), F.create_map(F.lit("error"), F.lit("1"))).otherwise(F.create_map(F.lit("k"), F.lit("v"))).alias("tags"))
    return S.zipkin(spans(t).select(F.to_json(F.array(span)).alias("json")))


@query("SELECT 't' || trace_id::VARCHAR AS trace_id, span_id::VARCHAR AS span_id, parent_span_id::VARCHAR AS parent_span_id, operation, service, 'INTERNAL' AS kind, start_ms, floor(duration_ms * 1000) / 1000 AS duration_ms, error FROM " + X, "start_ms duration_ms")
def trace_from_jaeger(t: Tables) -> DataFrame:
    us = lambda c: F.floor(c * 1000).cast("long")
    refs = F.when(F.col("parent_span_id").isNotNull(), F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.col("parent_span_id").cast("string").alias("spanID"))))
    span = F.struct(F.concat(F.lit("t"), F.col("trace_id").cast("string")).alias("traceID"), F.col("span_id").cast("string").alias("spanID"), F.col("operation").alias("operationName"), refs.alias("references"), us(F.col("start_ms")).alias("startTime"), us(F.col("duration_ms")).alias("duration"), F.array(F.struct(F.lit("error").alias("key"), F.col("error").cast("string").alias("value"))).alias("tags"), F.lit("p1").alias("processID"))
    doc = F.to_json(F.struct(F.array(F.struct(F.array(span).alias("spans"), F.create_map(F.lit("p1"), F.struct(F.col("service").alias("serviceName"))).alias("processes"))).alias("data")))
    return S.jaeger(spans(t).select(doc.alias("json")))
