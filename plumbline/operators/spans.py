"""Spans, traces and service maps over rows of trace_id, span_id, parent_span_id, service, operation, start_ms, duration_ms, error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARENT = ["trace_id", "parent_span_id"]


def analyzed(spans: DataFrame, slow_ms: float = 100.0) -> DataFrame:
    """Slow flag and factor, number of children, self time (duration less the children's, 0 at least)."""
    kids = spans.filter("parent_span_id is not null").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("children"), F.sum("duration_ms").alias("child_ms")).withColumnRenamed("parent_span_id", "span_id")
    out = spans.join(kids, ["trace_id", "span_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return out.withColumn("self_ms", F.greatest(F.lit(0.0), F.col("duration_ms") - F.coalesce("child_ms", F.lit(0.0)))).withColumn("slow", F.col("duration_ms") > slow_ms).withColumn("slowness", F.col("duration_ms") / slow_ms).drop("child_ms")


def service_metrics(spans: DataFrame, by: Sequence[str] = ("service",)) -> DataFrame:
    d = F.col("duration_ms")
    span = F.greatest((F.max(F.col("start_ms") + d) - F.min("start_ms")) / 1000, F.lit(1.0))
    return spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("errors"), F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"), F.percentile(d, F.lit(0.5)).alias("p50"), F.percentile(d, F.lit(0.95)).alias("p95"), F.percentile(d, F.lit(0.99)).alias("p99"), (F.count(F.lit(1)) / span).alias("throughput")).withColumn("error_rate", F.col("errors") / F.col("n"))


def traces(spans: DataFrame) -> DataFrame:
    """One row a trace: root, spans, services, errors, duration (the root's, else the longest), start and end."""
    root = F.col("parent_span_id").isNull()
    t = spans.groupBy("trace_id").agg(F.min(F.when(root, F.col("span_id"))).alias("root"), F.count(F.lit(1)).alias("spans"), F.count_distinct("service").alias("services"), F.count_if("error").alias("errors"), F.min_by(F.when(root, F.col("duration_ms")), F.when(root, F.col("span_id"))).alias("root_ms"), F.max("duration_ms").alias("longest"), F.min("start_ms").alias("start_ms"), F.max(F.col("start_ms") + F.col("duration_ms")).alias("end_ms"))
    return t.withColumn("duration_ms", F.coalesce("root_ms", "longest")).drop("root_ms", "longest")


def depths(spans: DataFrame, most: int = 4096) -> DataFrame:
    """trace_id, span_id, depth (1 for roots): level by level; a cycle's spans never appear."""
    from .graph import _cut

    level = _cut(spans.filter("parent_span_id is null").select("trace_id", "span_id", F.lit(1).alias("depth")))
    kids = _cut(spans.filter("parent_span_id is not null").select("trace_id", "span_id", "parent_span_id"))
    out = level
    for d in range(2, most + 1):
        up = level.select("trace_id", F.col("span_id").alias("parent_span_id"))
        level = _cut(kids.join(up, PARENT).select("trace_id", "span_id", F.lit(d).alias("depth")))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def health_score(error_rate: Column, p99: Column, slow_ms: float) -> Column:
    """100 less an error penalty (30 at most) and a latency penalty by p99 against 1, 2 and 5 times the threshold."""
    late = F.when(p99 > 5 * slow_ms, 40.0).when(p99 > 2 * slow_ms, 20.0).when(p99 > slow_ms, 10.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), 100 - F.least(F.lit(30.0), error_rate * 100 * 3) - late)


def service_map(spans: DataFrame) -> DataFrame:
    """Cross-service edges src -> dst (caller to callee): calls, errors, mean, p99."""
    a = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("src"))
    j = spans.filter("parent_span_id is not null").join(a, PARENT).filter("src != service")
    e = j.groupBy("src", F.col("service").alias("dst")).agg(F.count(F.lit(1)).alias("calls"), F.count_if("error").alias("errors"), F.avg("duration_ms").alias("mean"), F.percentile("duration_ms", F.lit(0.99)).alias("p99"))
    return e.withColumn("share", F.col("calls") / F.sum("calls").over(W.partitionBy(F.lit(1))))


def pruned(edges: DataFrame, least_share: float = 0.001) -> DataFrame:
    """Edges of at least that share of traffic, and those with errors."""
    return edges.filter((F.col("share") >= least_share) | (F.col("errors") > 0))


def ghost_edges(now: DataFrame, before: DataFrame) -> DataFrame:
    """Edges of the window before that are absent now."""
    return before.select("src", "dst").join(now.select("src", "dst"), ["src", "dst"], "left_anti")


def canonical(name: Column) -> Column:
    """camelCase, underscores and blanks as lower-case kebab."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), "([a-z0-9])([A-Z])", "$1-$2"), r"[\s_.]+", "-"))


def orphans_adopted(spans: DataFrame) -> DataFrame:
    """Spans whose parent is missing get the tightest span of their trace that encloses them, else the root."""
    end = F.col("start_ms") + F.col("duration_ms")
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known"))
    s = spans.join(known, PARENT, "left").withColumn("orphan", F.col("parent_span_id").isNotNull() & F.col("known").isNull()).drop("known")
    o = s.filter("orphan").select("trace_id", "span_id", "start_ms", end.alias("end_ms"))
    c = spans.select("trace_id", F.col("span_id").alias("p"), F.col("start_ms").alias("ps"), (F.col("start_ms") + F.col("duration_ms")).alias("pe"), F.col("duration_ms").alias("pd"))
    fit = o.join(c, "trace_id").filter("p != span_id and ps <= start_ms and pe >= end_ms").groupBy("trace_id", "span_id").agg(F.min_by("p", F.struct("pd", "p")).alias("adopter"))
    root = spans.filter("parent_span_id is null").groupBy("trace_id").agg(F.min("span_id").alias("root"))
    j = s.join(fit, ["trace_id", "span_id"], "left").join(root, "trace_id", "left")
    return j.withColumn("parent_span_id", F.when(F.col("orphan"), F.coalesce("adopter", F.when(F.col("root") != F.col("span_id"), F.col("root")))).otherwise(F.col("parent_span_id"))).drop("adopter", "root")


def critical_path(spans: DataFrame, most: int = 4096) -> DataFrame:
    """From each root down to the longest child, level by level: trace_id, depth, span_id, service, duration_ms."""
    from .graph import _cut

    pick = F.max_by(F.struct("span_id", "service", "duration_ms"), F.struct("duration_ms", -F.col("span_id")))
    best = _cut(spans.filter("parent_span_id is not null").groupBy(*PARENT).agg(pick.alias("x")).select(*PARENT, "x.*"))
    level = _cut(spans.filter("parent_span_id is null").select("trace_id", F.lit(1).alias("depth"), "span_id", "service", "duration_ms"))
    out = level
    for d in range(2, most + 1):
        up = level.select("trace_id", F.col("span_id").alias("parent_span_id"))
        level = _cut(up.join(best, PARENT).select("trace_id", F.lit(d).alias("depth"), "span_id", "service", "duration_ms"))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def parallelizable(spans: DataFrame) -> DataFrame:
    """Sum of min(duration, next duration) over neighbouring siblings that don't overlap."""
    w = W.partitionBy(*PARENT).orderBy("start_ms", "span_id")
    s = spans.filter("parent_span_id is not null").withColumn("nd", F.lead("duration_ms").over(w)).withColumn("ns", F.lead("start_ms").over(w))
    gain = F.when(F.col("ns") >= F.col("start_ms") + F.col("duration_ms"), F.least("duration_ms", "nd")).otherwise(0.0)
    return s.groupBy("trace_id").agg(F.sum(gain).alias("parallel_ms"))


def compared(a: DataFrame, b: DataFrame, least: float = 1.0) -> DataFrame:
    """Full outer comparison of mean durations by service and operation; differences above ``least`` ms."""
    x, y = (d.groupBy("service", "operation").agg(F.avg("duration_ms").alias(n)) for d, n in ((a, "before"), (b, "after")))
    j = x.join(y, ["service", "operation"], "full").withColumn("delta", F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    return j.filter(F.abs("delta") > least)


def bottlenecks(spans: DataFrame, top: int = 5) -> DataFrame:
    """The services and operations with the largest mean share of their trace's duration."""
    t = traces(spans).select("trace_id", F.col("duration_ms").alias("whole"))
    s = analyzed(spans).join(t, "trace_id").filter("whole > 0")
    g = s.groupBy("service", "operation").agg(F.avg(F.col("self_ms") / F.col("whole")).alias("contribution"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("contribution").desc(), "service", "operation").limit(top)


# trace formats


def otlp(df: DataFrame, column: str = "json") -> DataFrame:
    """Spans of OTLP JSON documents: resourceSpans, scopeSpans and spans flattened, ns to ms."""
    value = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>"
    schema = f"resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:{value}>>>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>>>>>>>"
    r = df.select(F.explode(F.from_json(column, schema)["resourceSpans"]).alias("r"))
    name = F.get(F.filter("r.resource.attributes", lambda a: a["key"] == "service.name"), F.lit(0))["value"]["stringValue"]
    s = r.select(F.coalesce(name, F.lit("unknown")).alias("service"), F.explode("r.scopeSpans").alias("x")).select("service", F.explode("x.spans").alias("s"))
    a, b = F.col("s.startTimeUnixNano").cast("long"), F.col("s.endTimeUnixNano").cast("long")
    kinds = F.element_at(F.array(*map(F.lit, ("INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"))), F.when(F.col("s.kind").between(1, 5), F.col("s.kind")).otherwise(1))
    return s.select(F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.nullif("s.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("s.name").alias("operation"), "service", kinds.alias("kind"), (a / 1e6).alias("start_ms"), ((b - a) / 1e6).alias("duration_ms"), (F.coalesce(F.col("s.status.code"), F.lit(0)) == 2).alias("error"))


def zipkin(df: DataFrame, column: str = "json") -> DataFrame:
    """Spans of Zipkin JSON arrays, microseconds to ms."""
    schema = "array<struct<traceId:string,id:string,parentId:string,name:string,kind:string,timestamp:bigint,duration:bigint,localEndpoint:struct<serviceName:string>,tags:map<string,string>>>"
    s = df.select(F.explode(F.from_json(column, schema)).alias("s"))
    return s.select(F.col("s.traceId").alias("trace_id"), F.col("s.id").alias("span_id"), F.col("s.parentId").alias("parent_span_id"), F.col("s.name").alias("operation"), F.coalesce("s.localEndpoint.serviceName", F.lit("unknown")).alias("service"), F.coalesce(F.upper("s.kind"), F.lit("INTERNAL")).alias("kind"), (F.col("s.timestamp") / 1e3).alias("start_ms"), (F.col("s.duration") / 1e3).alias("duration_ms"), F.coalesce(F.col("s.tags")["error"].isNotNull(), F.lit(False)).alias("error"))


def jaeger(df: DataFrame, column: str = "json") -> DataFrame:
    """Spans of Jaeger JSON documents: CHILD_OF references, the process table, error tags."""
    tag = "array<struct<key:string,value:string>>"
    schema = f"data array<struct<spans:array<struct<traceID:string,spanID:string,operationName:string,references:array<struct<refType:string,spanID:string>>,startTime:bigint,duration:bigint,tags:{tag},processID:string>>,processes:map<string,struct<serviceName:string>>>>"
    d = df.select(F.explode(F.from_json(column, schema)["data"]).alias("d")).select(F.col("d.processes").alias("p"), F.explode("d.spans").alias("s"))
    parent = F.get(F.filter("s.references", lambda r: r["refType"] == "CHILD_OF"), F.lit(0))["spanID"]
    err = F.exists("s.tags", lambda x: (x["key"] == "error") & (x["value"] == "true"))
    kind = F.get(F.filter("s.tags", lambda x: x["key"] == "span.kind"), F.lit(0))["value"]
    return d.select(F.col("s.traceID").alias("trace_id"), F.col("s.spanID").alias("span_id"), parent.alias("parent_span_id"), F.col("s.operationName").alias("operation"), F.coalesce(F.col("p")[F.col("s.processID")]["serviceName"], F.lit("unknown")).alias("service"), F.coalesce(F.upper(kind), F.lit("INTERNAL")).alias("kind"), (F.col("s.startTime") / 1e3).alias("start_ms"), (F.col("s.duration") / 1e3).alias("duration_ms"), F.coalesce(err, F.lit(False)).alias("error"))
