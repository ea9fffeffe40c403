"""Queries over texts, pages and findings.

Findings are made of ``lineitem``: rule = return flag and line status, file = part, line = line number and quantity.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as X
from ..operators import pages as P
from ..operators import text as S
from .registry import Tables, query

Q = "''"


@query(r"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS hash FROM (SELECT doc_id, regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]') AS t FROM documents)")
def text_tokens(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", S.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), S.token_hash(F.col("t")).alias("hash"))


@query("WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), g AS (SELECT doc_id, ch, count(*) AS c FROM c GROUP BY ALL), s AS (SELECT doc_id, sum(c) AS n, sum(c * log2(c)) AS s FROM g GROUP BY 1) SELECT doc_id, coalesce(log2(n) - s / n, 0) AS entropy FROM documents LEFT JOIN s USING (doc_id)", "entropy")
def text_entropy(t: Tables) -> DataFrame:
    return S.entropy(t.documents, "doc_id", "text")


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 2) || right(c_name, 2) END AS masked FROM customer")
def text_masked(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.masked(F.col("c_name")).alias("masked"))


def _secret_sql() -> str:
    parts = []
    for category in dict.fromkeys(p[0] for p in S.SECRETS):
        own = [p for p in S.SECRETS if p[0] == category]
        case = lambda f: "CASE " + " ".join(f"WHEN regexp_matches(s, '{p[3]}') THEN {f(p)}" for p in own) + " END"  # noqa: E731, B023
        parts.append(f"SELECT doc_id, line, '{category}' AS category, {case(lambda p: repr(p[1]))} AS kind, {case(lambda p: repr(p[2]))} AS severity, {case(lambda p: f'regexp_extract(s, {chr(39)}{p[3]}{chr(39)})')} AS v FROM l")
    return "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line FROM documents), f AS (" + " UNION ALL ".join(parts) + ") SELECT doc_id, line, category, kind, severity, CASE WHEN length(v) <= 4 THEN repeat('*', length(v)) ELSE repeat('*', length(v) - 2) || right(v, 2) END AS masked FROM f WHERE kind IS NOT NULL"


@query(_secret_sql().replace(r"\w", "[0-9A-Za-z_]").replace("[[0-9A-Za-z_]", "[0-9A-Za-z_"))
def text_secrets(t: Tables) -> DataFrame:
    return S.secrets(t.documents, "doc_id", "text")


@query("SELECT event_id, CASE WHEN regexp_matches(l, '(?i)failed (?:login|password)|authentication fail') THEN 'auth_failure' WHEN regexp_matches(l, '(?i)\\berror\\b|exception') THEN 'error' WHEN regexp_matches(l, '(?i)union\\s+select|<script') THEN 'injection' WHEN regexp_matches(l, '(?i)time(?:d )?out') THEN 'timeout' END AS event_class, nullif(regexp_extract(l, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'), '') AS ip FROM (SELECT event_id, event_type || ' Failed login from 10.0.' || user_id % 200 || '.7' AS l FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, event_type || ' timed out' FROM events WHERE event_id % 5 <> 0)")
def log_classification(t: Tables) -> DataFrame:
    e, fail = t.events, F.col("event_id") % 5 == 0
    line = F.when(fail, F.concat("event_type", F.lit(" Failed login from 10.0."), (F.col("user_id") % 200).cast("string"), F.lit(".7"))).otherwise(F.concat("event_type", F.lit(" timed out")))
    return S.log_events(e.select("event_id", line.alias("l")), "l").drop("l")


_NAMES = "(SELECT DISTINCT p_name || p_size AS name FROM part WHERE (p_size > 25) = {k})"


@query(f"SELECT name, x.popular, x.distance FROM (SELECT n.name, min({{'distance': levenshtein(n.name, p.name), 'popular': p.name}}) AS x FROM {_NAMES.format(k="false")} n, {_NAMES.format(k="true")} p WHERE n.name NOT IN (SELECT name FROM {_NAMES.format(k="true")}) AND levenshtein(n.name, p.name) BETWEEN 1 AND 2 AND abs(length(n.name) - length(p.name)) <= 2 GROUP BY 1)")
def typosquats(t: Tables) -> DataFrame:
    names = lambda k: t.part.filter((F.col("p_size") > 25) == k).select(F.concat("p_name", F.col("p_size").cast("string")).alias("name")).distinct()
    return S.typosquats(names(False), names(True))


_LIC = "CASE WHEN length(s) <= 100 THEN CASE " + " ".join(f"WHEN regexp_matches(s, '{rx}') THEN '{n}'" for n, rx in S.LICENCES) + " END END"


@query(f"SELECT spdx, CASE WHEN spdx IS NULL THEN 'unknown' WHEN spdx IN ('MIT', 'Apache-2.0') THEN 'allowed' WHEN spdx = 'GPL-3.0' THEN 'warn' ELSE 'prohibited' END AS policy, count(*) AS lines FROM (SELECT {_LIC} AS spdx FROM (SELECT unnest(string_split(text, chr(10))) AS s FROM documents)) GROUP BY ALL")
def licences(t: Tables) -> DataFrame:
    l = t.documents.select(F.explode(F.split("text", "\n")).alias("s")).select(S.licence(F.col("s")).alias("spdx"))
    return l.groupBy("spdx", S.licence_policy(F.col("spdx"), ["MIT", "Apache-2.0"], ["GPL-3.0"]).alias("policy")).agg(F.count(F.lit(1)).alias("lines"))


_BL = r"WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), w AS (SELECT doc_id, unnest(range(1, len(l) - 4 + 2, 2))::INT AS start, l FROM l WHERE len(l) >= 4), b AS (SELECT doc_id, start, md5(array_to_string(regexp_extract_all(array_to_string(l[start:start + 3], chr(10)), '[0-9A-Za-z_]+|[^0-9A-Za-z_\s]'), ' ')) AS hash FROM w) "


@query(_BL + "SELECT hash, copies, texts, x.doc_id AS first, x.start AS start FROM (SELECT hash, count(*) AS copies, count(DISTINCT doc_id) AS texts, min({'doc_id': doc_id, 'start': start}) AS x FROM b GROUP BY 1 HAVING count(*) > 1)")
def clone_families(t: Tables) -> DataFrame:
    return S.clone_families(S.blocks(t.documents, "doc_id", "text", 4), "doc_id")


@query(_BL + "SELECT doc_id, count(*) AS blocks, avg(CASE WHEN c > 1 THEN 1.0 ELSE 0.0 END) * 100 AS duplicated_pct FROM (SELECT *, count(*) OVER (PARTITION BY hash) AS c FROM b) GROUP BY 1", "duplicated_pct")
def clone_share(t: Tables) -> DataFrame:
    return S.duplicated_share(S.blocks(t.documents, "doc_id", "text", 4), "doc_id")


@query("SELECT key, count(*) AS present, string_agg(DISTINCT k, ',' ORDER BY k) AS types, min(TRY_CAST(v AS DOUBLE)) AS min, max(TRY_CAST(v AS DOUBLE)) AS max, max(length(v))::INT AS longest, count(DISTINCT v) AS values, count(*) = (SELECT count(*) FROM events WHERE props IS NOT NULL) AS required FROM (SELECT key, v, CASE WHEN regexp_matches(v, '^-?\\d+$') THEN 'integer' WHEN regexp_matches(v, '^-?\\d+\\.\\d+$') THEN 'number' WHEN v IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS k FROM (SELECT unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events)) GROUP BY 1", "min max")
def schema_inference(t: Tables) -> DataFrame:
    return S.inferred_schema(t.events, "props")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}') THEN 'date-time' WHEN regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'date' WHEN regexp_matches(v, '^[a-z][a-z0-9+.-]*://') THEN 'uri' END AS kind FROM (SELECT url AS v FROM pages UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT c_name FROM customer)) GROUP BY 1")
def format_detection(t: Tables) -> DataFrame:
    v = t.pages.select(F.col("url").alias("v")).unionByName(t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("v"))).unionByName(t.customer.select(F.col("c_name").alias("v")))
    return v.groupBy(S.value_format(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN s IS NULL THEN 'high' WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' WHEN s > 0 THEN 'low' ELSE 'none' END AS severity FROM (SELECT event_id, CASE WHEN event_id % 13 > 0 THEN (user_id % 101)::DOUBLE / 10 END AS s FROM events)")
def cvss_severity(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.cvss_severity(F.when(F.col("event_id") % 13 > 0, (F.col("user_id") % 101) / 10.0)).alias("severity"))


# pages

_M = "CASE WHEN regexp_matches(html, '{r}') THEN regexp_extract(html, '{r}', 1) END"
_TITLE = _M.format(r="(?is)<title[^>]*>(.*?)</title>")
_DESC = _M.format(r="(?is)<meta\\s+(?:name|property)=[\"'']description[\"'']\\s+content=[\"'']([^\"'']*)[\"'']")
_CANON = _M.format(r="(?is)<link\\s+rel=[\"'']canonical[\"'']\\s+href=[\"'']([^\"'']*)[\"'']")


@query(f"SELECT *, (100 - CASE WHEN title IS NULL THEN 25 WHEN NOT title_ok THEN 15 ELSE 0 END - CASE WHEN description IS NULL THEN 25 WHEN NOT description_ok THEN 15 ELSE 0 END - CASE WHEN canonical IS NULL THEN 10 ELSE 0 END)::DOUBLE AS score FROM (SELECT *, coalesce(length(title) BETWEEN 30 AND 60, false) AS title_ok, coalesce(length(description) BETWEEN 50 AND 160, false) AS description_ok FROM (SELECT page_id, {_TITLE} AS title, {_DESC} AS description, {_CANON} AS canonical, coalesce(contains(lower({_DESC.replace('description', 'robots')}), 'noindex'), false) AS noindex, {_DESC.replace('description', 'viewport')} IS NOT NULL AS has_viewport FROM pages))", "score")
def page_seo(t: Tables) -> DataFrame:
    return P.seo(t.pages, "page_id", "html")


_LINKS = "(SELECT page_id, url, unnest(l) AS href, unnest(range(0, len(l)))::INT AS place FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']', 1) AS l FROM pages))"


@query(f"SELECT page_id, place, href, CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN starts_with(lower(href), 'mailto:') THEN 'mailto' WHEN starts_with(lower(href), 'tel:') THEN 'tel' WHEN starts_with(lower(href), 'javascript:') THEN 'javascript' WHEN NOT regexp_matches(lower(href), '^https?://') AND NOT regexp_matches(lower(href), '^[a-z][a-z0-9+.-]*:') THEN 'internal' WHEN regexp_matches(lower(href), '^https?://') AND regexp_extract(href, '^https?://([^/?#]+)', 1) = regexp_extract(url, '^https?://([^/?#]+)', 1) THEN 'internal' WHEN regexp_matches(lower(href), '^https?://') THEN 'external' ELSE 'other' END AS link_type FROM {_LINKS}")
def page_links(t: Tables) -> DataFrame:
    return P.links(t.pages, "page_id", "url", "html")


@query(f"SELECT page_id, place, regexp_replace(regexp_replace(CASE WHEN regexp_matches(href, '^(?i)https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL ELSE regexp_extract(url, '^(https?://[^?#]*/)', 1) || href END, '[?#].*$', ''), '/$', '') AS link FROM {_LINKS}")
def page_normalized_links(t: Tables) -> DataFrame:
    l = P.links(t.pages, "page_id", "url", "html").join(t.pages.select("page_id", "url"), "page_id")
    return l.select("page_id", "place", P.normalized_url(F.col("url"), F.col("href")).alias("link"))


@query("WITH c AS (SELECT p_partkey, (p_size * 5 % 256)::DOUBLE / 255 AS r, (p_partkey % 256)::DOUBLE / 255 AS g, (p_partkey * 7 % 256)::DOUBLE / 255 AS b FROM part), l AS (SELECT p_partkey, 0.2126 * CASE WHEN r <= 0.03928 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END + 0.7152 * CASE WHEN g <= 0.03928 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END + 0.0722 * CASE WHEN b <= 0.03928 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS l FROM c) SELECT p_partkey, (greatest(l, 1.0) + 0.05) / (least(l, 1.0) + 0.05) AS contrast FROM l", "contrast")
def page_contrast(t: Tables) -> DataFrame:
    lum = P.luminance(F.col("p_size") * 5 % 256, F.col("p_partkey") % 256, F.col("p_partkey") * 7 % 256)
    return t.part.select("p_partkey", P.contrast(lum, F.lit(1.0)).alias("contrast"))


@query("SELECT page_id, CASE WHEN n > 5000 THEN 'fail' WHEN n > 2000 THEN 'warn' ELSE 'pass' END AS verdict, greatest(0, least(1, 1 - (n - 2000) / 3000.0::DOUBLE)) AS headroom FROM (SELECT page_id, length(html) AS n FROM pages)", "headroom")
def page_budget(t: Tables) -> DataFrame:
    n = F.length("html")
    return t.pages.select("page_id", P.budget(n, 2000, 5000).alias("verdict"), P.headroom(n, 2000, 5000).alias("headroom"))


# findings

FIND = "(SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_returnflag || l_linestatus AS rule_id, 'f' || l_partkey || '.py' AS file_path, (l_quantity * 7)::BIGINT AS line, CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'medium' ELSE 'low' END AS severity, l_linestatus AS category, l_discount * 10 AS confidence, l_orderkey, l_linenumber FROM lineitem)"


def findings(t: Tables) -> DataFrame:
    l = t.lineitem
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"), F.concat("l_returnflag", "l_linestatus").alias("rule_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("file_path"), (F.col("l_quantity") * 7).cast("long").alias("line"), F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "medium").otherwise("low").alias("severity"), F.col("l_linestatus").alias("category"), (F.col("l_discount") * 10).alias("confidence"), "l_orderkey", "l_linenumber")


_ISS = f"(SELECT finding_id AS issue_id, rule_id, file_path, line, severity, CASE WHEN finding_id % 3 = 0 THEN 'resolved' WHEN finding_id % 3 = 1 THEN 'open' ELSE 'confirmed' END AS status, l_orderkey AS last_seen, l_orderkey AS first_detected FROM {FIND})"


def issues(t: Tables) -> DataFrame:
    k = F.col("finding_id") % 3
    return findings(t).select(F.col("finding_id").alias("issue_id"), "rule_id", "file_path", "line", "severity", F.when(k == 0, "resolved").when(k == 1, "open").otherwise("confirmed").alias("status"), F.col("l_orderkey").alias("last_seen"), F.col("l_orderkey").alias("first_detected"))


@query("WITH m AS (SELECT event_type, ts::DATE AS d, avg(value) AS value FROM events GROUP BY ALL), p AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY d) AS prev, row_number() OVER (PARTITION BY event_type ORDER BY d DESC) AS r FROM m), c AS (SELECT event_type, value AS current, prev AS previous, value - prev AS change, (value - prev) / abs(prev) * 100 AS change_pct FROM p WHERE r = 1) SELECT *, CASE WHEN abs(change_pct) < 5 THEN 'stable' WHEN (change_pct < 0) = (event_type = 'error') THEN 'improving' ELSE 'degrading' END AS direction FROM c", "current previous change change_pct")
def history_trend(t: Tables) -> DataFrame:
    m = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("value"))
    return X.metric_trend(m, ["event_type"], "d", "value", F.col("event_type") == "error")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def history_upsert(t: Tables) -> DataFrame:
    s = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return X.upserted(s, s.filter("o_orderkey % 5 = 0").withColumn("status", F.lit("new")), ["o_orderkey"])


@query(f"SELECT severity, category, count(*) AS n, 5000 AS loc, count(*) / 5000.0::DOUBLE * 1000 AS density FROM {FIND} GROUP BY 1, 2", "density")
def finding_density(t: Tables) -> DataFrame:
    return X.density(findings(t), ["category"], F.lit(5000))


@query(f"SELECT f.finding_id, x.issue_id FROM {FIND} f LEFT JOIN (SELECT g.finding_id, min({{'gap': abs(g.line - i.line), 'issue_id': i.issue_id}}).issue_id AS issue_id FROM {FIND} g JOIN {_ISS} i ON i.rule_id = g.rule_id AND i.file_path = g.file_path AND abs(g.line - i.line) <= 5 AND i.status IN ('open', 'confirmed') GROUP BY 1) x USING (finding_id)")
def issue_matching(t: Tables) -> DataFrame:
    return X.matched(findings(t), issues(t)).select("finding_id", "issue_id")


@query(f"SELECT issue_id, CASE WHEN status IN ('open', 'confirmed') AND last_seen < 5000 THEN 'resolved' ELSE status END AS status FROM {_ISS}")
def issue_resolution(t: Tables) -> DataFrame:
    return X.resolved(issues(t), F.lit(5000)).select("issue_id", "status")


@query(f"SELECT status, severity, count(*) AS n, min(first_detected) AS oldest FROM {_ISS} GROUP BY GROUPING SETS ((status, severity), (status), ())")
def issue_summary(t: Tables) -> DataFrame:
    return X.issue_summary(issues(t))


@query(f"SELECT finding_id FROM {FIND} f WHERE NOT EXISTS (SELECT 1 FROM {_ISS} i WHERE i.rule_id = f.rule_id AND i.file_path = f.file_path AND (i.last_seen > 5000 OR i.last_seen % 4 = 1))")
def baseline_suppression(t: Tables) -> DataFrame:
    b = issues(t).select("rule_id", "file_path", F.when(F.col("last_seen") % 4 != 1, F.col("last_seen")).alias("expires"))
    return X.unsuppressed(findings(t), b, ["rule_id", "file_path"], F.lit(5000)).select("finding_id")


_FP = "sha256(rule_id || chr(31) || file_path || chr(31) || (line // 50)::VARCHAR)"


def prints(d: DataFrame) -> DataFrame:
    return d.withColumn("fingerprint", X.fingerprint(F.col("rule_id"), F.col("file_path"), F.floor(F.col("line") / 50)))


@query(f"SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN {_FP} IN (SELECT {_FP} FROM {FIND} WHERE l_linenumber <= 3) THEN 'pre_existing' WHEN severity = 'critical' THEN 'new_blocking' ELSE 'new_advisory' END AS verdict FROM {FIND}) GROUP BY 1")
def gate_differential(t: Tables) -> DataFrame:
    f = prints(findings(t))
    return X.differential(f, f.filter("l_linenumber <= 3"), F.col("severity") == "critical").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_FP} AS fingerprint FROM {FIND} WHERE l_linenumber <= 3 INTERSECT SELECT {_FP} FROM {FIND} WHERE l_linenumber > 3")
def gate_ratchet(t: Tables) -> DataFrame:
    f = prints(findings(t))
    return X.ratchet(f.filter("l_linenumber <= 3"), f.filter("l_linenumber > 3"))


@query(f"WITH a AS (SELECT DISTINCT rule_id, {_FP} AS p FROM {FIND} WHERE l_linenumber <= 3), b AS (SELECT DISTINCT rule_id, {_FP} AS p FROM {FIND} WHERE l_linenumber > 3) SELECT rule_id, count(*) AS differing FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY 1")
def gate_determinism(t: Tables) -> DataFrame:
    f = prints(findings(t))
    return X.undetermined_rules(f.filter("l_linenumber <= 3"), f.filter("l_linenumber > 3"))


_COND = (("click", "<", 60.0, True), ("view", ">=", 10.0, False), ("error", "<=", 1.0, True), ("absent", ">", 0.0, True))


@query("SELECT metric, op, threshold, value, CASE WHEN value IS NULL THEN 'warning' WHEN CASE op WHEN '<' THEN value < threshold WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold ELSE value > threshold END THEN 'passed' WHEN blocking THEN 'failed' ELSE 'warning' END AS status FROM (VALUES ('click', '<', 60.0::DOUBLE, true), ('view', '>=', 10.0, false), ('error', '<=', 1.0, true), ('absent', '>', 0.0, true)) c(metric, op, threshold, blocking) LEFT JOIN (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1) v USING (metric)", "value")
def gate_conditions(t: Tables) -> DataFrame:
    v = t.events.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return X.gate(v, _COND, "warn")


@query("SELECT file_path, floor(100 * pow(0.4, c) * pow(0.8, h) * pow(0.9, m / s) * pow(0.95, l / s) + 0.5) AS score FROM (SELECT file_path, sum(c) AS c, sum(h) AS h, sum(m) AS m, sum(l) AS l, sqrt(2.5::DOUBLE) AS s FROM (SELECT file_path, category, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h, pow(count(*) FILTER (WHERE severity = 'medium'), 0.8) AS m, pow(count(*) FILTER (WHERE severity = 'low'), 0.8) AS l FROM " + FIND + " GROUP BY ALL) GROUP BY 1)", "score")
def security_score(t: Tables) -> DataFrame:
    return X.security_score(findings(t), ["file_path"], F.lit(2500.0))


@query("SELECT p_partkey, exp(-8 * p_size / (p_retailprice + 200)) AS utility, CASE WHEN exp(-8 * p_size / (p_retailprice + 200)) >= 0.9 THEN 'A' WHEN exp(-8 * p_size / (p_retailprice + 200)) >= 0.8 THEN 'B' WHEN exp(-8 * p_size / (p_retailprice + 200)) >= 0.7 THEN 'C' WHEN exp(-8 * p_size / (p_retailprice + 200)) >= 0.6 THEN 'D' ELSE 'E' END AS grade, p_size * 60 / (p_retailprice * 30) * 100 AS debt_pct FROM part", "utility debt_pct")
def rating_utility(t: Tables) -> DataFrame:
    u = X.count_utility(F.col("p_size"), F.col("p_retailprice"))
    return t.part.select("p_partkey", u.alias("utility"), X.grade(u).alias("grade"), X.debt_percent(F.col("p_size") * 60, F.col("p_retailprice")).alias("debt_pct"))


@query("SELECT p_partkey, 0.4 * (rank() OVER (ORDER BY p_size) - 1) / (count(*) OVER () - 1) + 0.6 * (rank() OVER (ORDER BY p_retailprice) - 1) / (count(*) OVER () - 1) AS interest FROM part", "interest")
def debt_interest(t: Tables) -> DataFrame:
    return X.interest(t.part.select("p_partkey", "p_size", "p_retailprice"), [("p_size", 0.4), ("p_retailprice", 0.6)]).select("p_partkey", "interest")


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = greatest(1, ceil(0.9::DOUBLE * n))", "value")
def calibration_nearest_rank(t: Tables) -> DataFrame:
    return X.nearest_rank(t.events, ["event_type"], "value", 90)


@query("WITH t AS (SELECT DISTINCT event_type, user_id AS id FROM events WHERE value > 50), f AS (SELECT DISTINCT event_type, user_id AS id FROM events WHERE value > 60 OR event_id % 50 = 0), g AS (SELECT coalesce(t.event_type, f.event_type) AS event_type, count(*) FILTER (WHERE t.id IS NOT NULL AND f.id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.id IS NULL) AS fp, count(*) FILTER (WHERE f.id IS NULL) AS fn FROM t FULL JOIN f ON t.event_type = f.event_type AND t.id = f.id GROUP BY 1) SELECT event_type, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 5 * (tp / (tp + fp)) * (tp / (tp + fn)) / (4 * (tp / (tp + fp)) + tp / (tp + fn)) AS f_beta FROM g", "precision recall f_beta")
def evaluation_precision_recall(t: Tables) -> DataFrame:
    e = t.events.withColumn("id", F.col("user_id"))
    return X.precision_recall(e.filter("value > 50"), e.filter("value > 60 or event_id % 50 = 0"), ["event_type"], 2.0)


@query("SELECT least(floor(s * 10), 9)::BIGINT AS bin, count(*) AS n, avg(s) AS mean_score, avg(y) AS hit_rate FROM (SELECT l_discount * 10 AS s, CASE WHEN l_quantity < 25 THEN 1.0 ELSE 0.0 END AS y FROM lineitem) GROUP BY 1", "mean_score hit_rate")
def evaluation_reliability(t: Tables) -> DataFrame:
    return X.reliability(t.lineitem.select((F.col("l_discount") * 10).alias("s"), F.when(F.col("l_quantity") < 25, 1.0).otherwise(0.0).alias("y")), "s", "y")


@query("SELECT l_returnflag, avg(pow(l_discount * 10 - CASE WHEN l_quantity < 25 THEN 1.0 ELSE 0.0 END, 2)) AS brier FROM lineitem GROUP BY 1", "brier")
def evaluation_brier(t: Tables) -> DataFrame:
    return X.brier(t.lineitem.withColumn("s", F.col("l_discount") * 10).withColumn("y", F.when(F.col("l_quantity") < 25, 1.0).otherwise(0.0)), ["l_returnflag"], "s", "y")


@query("WITH g AS (SELECT (user_id % 40)::BIGINT AS x, sum(value) AS s, count(*)::DOUBLE AS w FROM events GROUP BY 1), b AS (SELECT a.x AS lo, c.x AS hi, (SELECT sum(s) / sum(w) FROM g WHERE g.x BETWEEN a.x AND c.x) AS m FROM g a JOIN g c ON c.x >= a.x) SELECT g.x, (SELECT max(v) FROM (SELECT lo, min(m) AS v FROM b WHERE hi >= g.x GROUP BY lo) q WHERE q.lo <= g.x) AS fitted FROM g", "fitted")
def evaluation_isotonic(t: Tables) -> DataFrame:
    return X.isotonic(t.events.withColumn("x", F.col("user_id") % 40), "x", "value")


@query(f"SELECT finding_id, confidence FROM {FIND} QUALIFY row_number() OVER (PARTITION BY rule_id, file_path ORDER BY confidence DESC, finding_id) = 1", "confidence")
def finding_dedup(t: Tables) -> DataFrame:
    return X.best_findings(findings(t), ["rule_id", "file_path"]).select("finding_id", "confidence")


@query("SELECT l_orderkey, l_linenumber, l_quantity * (1 + least(l_partkey % 80, 50) / 10.0::DOUBLE) * (1 + l_tax) AS priority FROM lineitem", "priority")
def hotspot_priority(t: Tables) -> DataFrame:
    f = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("weight"), (F.col("l_partkey") % 80).alias("churn"), F.col("l_tax").alias("reach"))
    return X.hotspots(f).select("l_orderkey", "l_linenumber", "priority")
