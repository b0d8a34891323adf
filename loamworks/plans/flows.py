"""Queries over conversations, events, pages and the sales tables: contracts, gates, windows, review, segments, increments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contracts, gates, graph, review, scoring, segments, similarity
from ..sources import readers
from ..streaming import incremental
from .registry import query, table

NOW = "2024-01-25 12:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp")


# Events and contracts ------------------------------------------------------------------------------------------------


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, max(turn) AS last_turn, arg_max(role, turn) AS last_role
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def event_roles(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


@query("""WITH t AS (SELECT user_id, arg_max(event_type, event_id) FILTER (event_type IN ('login', 'logout', 'click', 'view')) AS last FROM events GROUP BY user_id)
SELECT e.user_id, count(*) AS n, any_value(t.last) AS last_toggle FROM events e JOIN t USING (user_id) WHERE t.last IS NULL OR t.last <> 'click' GROUP BY e.user_id""")
def latest_toggle(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    toggles = F.when(F.col("event_type").isin("login", "logout", "click", "view"), F.col("event_id"))
    last = events.groupBy("user_id").agg(F.max_by("event_type", toggles).alias("last_toggle"))
    kept = last.where("last_toggle IS NULL OR last_toggle <> 'click'")
    return events.join(kept, "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.any_value("last_toggle").alias("last_toggle"))


def candidates(spark, sf_dir):
    """Facts made from turns: the evidence is a span of the turn, or for every seventh conversation of another text."""
    t = table(spark, sf_dir, "conversations").withColumn("line", F.regexp_replace("text", r"\s+", " "))
    evidence = F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit("no "), F.substring("line", 1, 60))).otherwise(F.substring("line", 11, 60))
    role = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "assistant_context").otherwise("system")
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("fact"), F.substring("line", 1, 500).alias("content"), evidence.alias("evidence"), F.col("conv_id").cast("string").alias("source_chat"), F.col("turn").alias("source_event"),
        role.alias("source_role"), F.when(F.col("turn") % 3 == 0, "high").when(F.col("turn") % 3 == 1, "medium").otherwise("low").alias("confidence"), F.when(F.col("turn") % 5 == 4, "none").otherwise("stable").alias("memory_tier"), F.lit("2024-01-02").alias("source_date"),
    )


_CAND = r"""c AS (SELECT conv_id * 1000 + turn AS fact, substr(line, 1, 500) AS content, CASE WHEN conv_id % 7 = 3 THEN 'no ' || substr(line, 1, 60) ELSE substr(line, 11, 60) END AS evidence, conv_id::VARCHAR AS source_chat, turn AS source_event,
CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant_context' ELSE 'system' END AS source_role, CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN turn % 5 = 4 THEN 'none' ELSE 'stable' END AS memory_tier, text, role FROM (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS line FROM conversations)),
j AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS cs, regexp_replace(evidence, '^\s+|\s+$', '', 'g') AS es FROM c),
r AS (SELECT *, CASE WHEN cs = '' THEN 'empty content' WHEN length(cs) > 320 THEN 'content too long or of several lines' WHEN starts_with(cs, '- ') THEN 'content has a bullet' WHEN es = '' THEN 'empty evidence'
WHEN memory_tier = 'none' THEN 'invalid memory_tier' WHEN source_role = 'system' THEN 'invalid source_role' WHEN source_role <> 'user' AND confidence = 'high' THEN 'high confidence without the user' WHEN source_event < 1 THEN 'source_event is not positive' END AS reason FROM j)"""


@query(f"WITH {_CAND} SELECT fact, reason FROM r")
def candidate_contract(spark, sf_dir):
    return contracts.judged(candidates(spark, sf_dir), contracts.candidate_checks()).select("fact", "reason")


@query(rf"""WITH {_CAND} SELECT fact, coalesce(reason, CASE WHEN NOT contains(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), es) THEN 'evidence is not in the event' END) AS reason FROM r""")
def evidence_join(spark, sf_dir):
    events = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("chat"), F.col("turn").alias("event_no"), "role", "text")
    judged = contracts.judged(candidates(spark, sf_dir), contracts.candidate_checks())
    return contracts.with_evidence(judged, events).select("fact", "reason")


@query("""WITH e AS (SELECT DISTINCT doc_id, true AS wanted FROM documents), g AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id + 10000000 FROM labels WHERE doc_id % 11 = 0) GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'extra' ELSE 'duplicate' END AS problem FROM e FULL JOIN g USING (doc_id) WHERE n IS NULL OR wanted IS NULL OR n > 1""")
def route_completeness(spark, sf_dir):
    got = table(spark, sf_dir, "labels").select("doc_id")
    got = got.unionAll(got.where("doc_id % 9 = 0")).unionAll(got.where("doc_id % 11 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id")))
    return contracts.completeness(table(spark, sf_dir, "documents"), got, "doc_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l2.k IS NOT NULL THEN 'R' ELSE l_linestatus END AS l_linestatus, l2.k IS NOT NULL AS recovered
FROM (SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem) l LEFT JOIN (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem WHERE l_quantity > 45) l2 ON l.k = l2.k""")
def overlay_fallback(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    again = lines.where("l_quantity > 45").select("k", F.lit("R").alias("l_linestatus"))
    return contracts.overlaid(lines.select("k", "l_orderkey", "l_linenumber", "l_linestatus"), again, "k", ["l_linestatus"]).drop("k")


@query("""WITH p AS (SELECT DISTINCT s_nationkey::VARCHAR AS vault, 'wiki/' || s_name AS page FROM supplier), r AS (SELECT c_custkey, c_nationkey::VARCHAR AS vault, 'x/Supplier#' || lpad((1 + c_custkey % 12)::VARCHAR, 9, '0') AS page FROM customer),
b AS (SELECT vault, string_split(page, '/')[-1] AS name, count(*) AS n, min(page) AS only FROM p GROUP BY ALL)
SELECT c_custkey, coalesce(p1.page, p2.page, b.only) AS canonical FROM r LEFT JOIN p p1 ON p1.vault = r.vault AND p1.page = r.page LEFT JOIN p p2 ON p2.vault = r.vault AND p2.page = 'wiki/' || r.page LEFT JOIN b ON b.n = 1 AND b.vault = r.vault AND b.name = string_split(r.page, '/')[-1]""")
def canonical_targets(spark, sf_dir):
    pages = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("vault"), F.concat(F.lit("wiki/"), "s_name").alias("page"))
    routes = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("vault"), F.concat(F.lit("x/Supplier#"), F.lpad((1 + F.col("c_custkey") % 12).cast("string"), 9, "0")).alias("page"))
    return contracts.canonical_pages(routes, pages).select("c_custkey", "canonical")


# Gates ---------------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, event_type <> 'view' AS ok FROM events), r AS (SELECT event_id, ok, row_number() OVER (PARTITION BY user_id, ok ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id, event_type, ok ORDER BY ts, event_id) AS s FROM e)
SELECT event_id, array_to_string(list_filter([CASE WHEN ok AND p > 40 THEN 'run_page_limit' END, CASE WHEN ok AND s > 12 THEN 'run_section_limit' END], lambda x: x IS NOT NULL), ',') AS density_reasons FROM r""")
def density_gate(spark, sf_dir):
    out = gates.density(table(spark, sf_dir, "events"), ["user_id"], ["user_id", "event_type"], ["ts", "event_id"], F.col("event_type") != "view", 40, 12)
    return out.select("event_id", F.array_join("density_reasons", ",").alias("density_reasons"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1) // 25 + 1) AS batch_no FROM orders""")
def batch_numbering(spark, sf_dir):
    return gates.batches(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 25, ["o_orderpriority"]).select("o_orderkey", "position", "batch_no")


@query("""WITH f AS (SELECT event_id, user_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events) SELECT event_id, 'p' || lpad(dense_rank() OVER (PARTITION BY user_id ORDER BY f, event_type)::VARCHAR, 3, '0') AS id FROM f""")
def first_seen_ids(spark, sf_dir):
    return gates.numbered(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id").select("event_id", "id")


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'current' WHEN o_orderstatus = 'F' THEN 'stable' ELSE 'audit' END AS tier, CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' THEN 'medium' ELSE 'low' END AS confidence, date_diff('day', o_orderdate::DATE, DATE '1998-12-01') AS age_days FROM orders)
SELECT o_orderkey, age_days, CASE WHEN tier = 'audit' THEN 'audit' ELSE 'routable' END AS route, tier = 'current' AND age_days >= 700 AS historical_review, CASE WHEN tier = 'current' AND age_days >= 700 AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence FROM d""")
def age_and_tier(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "O", "current").when(F.col("o_orderstatus") == "F", "stable").otherwise("audit").alias("tier"),
        F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low").alias("confidence"),
    )
    out = gates.age_gate(o.withColumn("route", gates.tier(F.col("tier"))), "o_orderdate", "tier", "confidence", F.lit("1998-12-01").cast("date"), 700)
    return out.select("o_orderkey", "age_days", "route", "historical_review", "confidence")


MARKERS = {"metal": ("brass", "steel", "copper", "tin", "nickel"), "finish": ("polished", "brushed", "plated", "anodized", "burnished"), "size": ("small", "medium", "large", "economy", "promo", "standard")}


@query("SELECT p_partkey, CASE " + " ".join("WHEN regexp_matches(lower(p_type || ' ' || p_name), '(^|[^\\p{L}])(" + "|".join(ws) + ")($|[^\\p{L}])') THEN '" + n + "'" for n, ws in MARKERS.items()) + " ELSE 'other' END AS fact_class, p_size > 40 AS big FROM part")
def policy_classes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", gates.fact_class(F.concat_ws(" ", "p_type", "p_name"), MARKERS).alias("fact_class"), (F.col("p_size") > 40).alias("big"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'destructive' WHEN o_orderpriority LIKE '5%' THEN 'brainstormed' WHEN o_orderpriority LIKE '3%' THEN 'uncertain' ELSE 'routine' END AS bucket FROM orders""")
def review_buckets(spark, sf_dir):
    action = F.when(F.col("o_orderstatus") == "P", "supersede").otherwise("new")
    confidence = F.when(F.col("o_orderpriority").startswith("5"), "low").when(F.col("o_orderpriority").startswith("3"), "medium").otherwise("high")
    return table(spark, sf_dir, "orders").select("o_orderkey", gates.review_bucket(action, confidence).alias("bucket"))


@query("""SELECT c_custkey, (c_acctbal < 0) OR ((coalesce(n.n_regionkey, -1) IN (1, 3) OR c_mktsegment = 'BUILDING') AND c_mktsegment <> 'MACHINERY') AS needs_review FROM customer LEFT JOIN nation n ON c_nationkey = n_nationkey""")
def enforced_policies(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).alias("needs_review"), (F.col("c_mktsegment") == "BUILDING").alias("policy_review_only"), F.lit(False).alias("person_review_only"), F.when(F.col("c_mktsegment") == "MACHINERY", "duplicate").otherwise("new").alias("action"))
    policies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").isin(1, 3).alias("review_only"))
    return gates.enforced(c, policies, "c_nationkey").select("c_custkey", "needs_review")


@query(r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\?.*$', '') || '.md' AS path FROM pages), d AS (SELECT *, string_split(path, '/') AS parts FROM u)
SELECT page_id, NOT list_contains(parts, 'Attachments') AND parts[-1] NOT IN ('README.md', 'index.md') AND len(list_filter(parts, lambda p: starts_with(p, '.'))) = 0 AS content, page_id % 3 <> 0 OR starts_with(path, parts[1] || '/') AS inside,
CASE WHEN list_has_any(list_transform(parts[:-2], lambda p: lower(p)), ['archive', 'archived', 'draft', 'drafts', 'log', 'logs', 'raw']) THEN 'directory' WHEN list_has_any(regexp_extract_all(lower(regexp_replace(parts[-1], '\.[^.]*$', '')), '[a-z0-9]+'), ['archive', 'archived', 'draft', 'drafts', 'log', 'logs', 'raw']) THEN 'page type'
WHEN page_id % 10 = 0 THEN 'status' END AS excluded FROM d""")
def page_filters(spark, sf_dir):
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"\?.*$", ""), F.lit(".md"))
    u = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.when(F.col("page_id") % 10 == 0, "Archived ").otherwise("active").alias("status"))
    host = F.element_at(F.split("path", "/"), 1)
    reason = F.substring_index(gates.exclusion_reason(F.col("path"), F.col("status")), ":", 1)
    return u.select("page_id", gates.content_page(F.col("path")).alias("content"), ((F.col("page_id") % 3 != 0) | F.col("path").startswith(F.concat(host, F.lit("/")))).alias("inside"), reason.alias("excluded"))


@query("""WITH f AS (SELECT p_partkey, lower(p_type) AS t FROM part), n AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1) || CASE WHEN p_size % 2 = 0 THEN ' ' || split_part(p_type, ' ', 2) ELSE '' END) AS name, p_brand AS vault FROM part),
m AS (SELECT p_partkey, name, vault, row_number() OVER (PARTITION BY p_partkey ORDER BY length(name) DESC, name, vault) AS r FROM f JOIN n ON t = name OR starts_with(t, name || ' ')) SELECT p_partkey, name, vault FROM m WHERE r = 1""")
def roster_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    second = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.split_part("p_type", F.lit(" "), F.lit(2)))).otherwise("")
    names = part.select(F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), second).alias("name"), F.col("p_brand").alias("vault")).distinct()
    return gates.roster_match(part, "p_partkey", "p_type", names)


# Windows, increments -------------------------------------------------------------------------------------------------


@query(f"""SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03')) // 604800000000 AS batch_no, TIMESTAMP '2024-01-03' + to_days(7 * ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03')) // 604800000000)::INT) AS window_start,
least(TIMESTAMP '{NOW}', TIMESTAMP '2024-01-03' + to_days(7 * ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03')) // 604800000000)::INT) + to_days(7)) AS window_end, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '{NOW}' GROUP BY ALL""")
def weekly_batches(spark, sf_dir):
    out = incremental.in_windows(table(spark, sf_dir, "events"), "ts", at("2024-01-03 00:00:00"), 7, at(NOW))
    return out.groupBy("batch_no", "window_start", "window_end").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT event_type, min(ts) + INTERVAL 10 DAY AS cursor FROM events WHERE event_type <> 'view' GROUP BY event_type) SELECT e.event_type, count(*) AS n, min(e.event_id) AS first_id FROM events e LEFT JOIN c USING (event_type)
WHERE e.ts >= coalesce(c.cursor, TIMESTAMP '1970-01-01') AND e.ts < TIMESTAMP '{NOW}' GROUP BY e.event_type""")
def cursor_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cursors = events.where("event_type <> 'view'").groupBy(F.col("event_type").alias("source")).agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("cursor"))
    return incremental.since(events, cursors, "event_type", "ts", at(NOW)).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH a AS (SELECT event_type AS source, max(ts) FILTER (user_id % 2 = 0) AS x, max(ts) FILTER (user_id % 2 = 1) AS y FROM events GROUP BY event_type) SELECT source, greatest(x, y) AS cursor FROM a""")
def cursor_commit(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    top = lambda r: events.where(F.col("user_id") % 2 == r).groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("cursor"))
    return incremental.advanced(top(0), top(1))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_counts(spark, sf_dir):
    return incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 day", "1 hour")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    return incremental.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours")


# Review, metrics -----------------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_state(spark, sf_dir):
    return review.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH b AS (SELECT user_id, arg_max(event_type, event_id) AS before FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY user_id), a AS (SELECT user_id, arg_max(event_type, event_id) AS after FROM events WHERE ts < TIMESTAMP '2024-01-12' GROUP BY user_id)
SELECT user_id, before, after FROM b FULL JOIN a USING (user_id) WHERE before IS DISTINCT FROM after""")
def decision_diff(spark, sf_dir):
    state = lambda until: table(spark, sf_dir, "events").where(F.col("ts") < at(until)).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"))
    return review.changed(state("2024-01-10 00:00:00"), state("2024-01-12 00:00:00"), "user_id", "state")


@query("""WITH n AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE user_id % 3 = 0 GROUP BY ALL), h AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL)
SELECT * FROM h WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n""")
def history_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    history = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    new = events.where("user_id % 3 = 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return review.upserted(history, new, "user_id", ["user_id", "event_type"])


@query("""SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15' UNION SELECT DISTINCT user_id, event_type FROM events""")
def queue_append(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    queue = events.where(F.col("ts") < at("2024-01-15 00:00:00")).select("user_id", "event_type").distinct()
    return review.queued(queue, events.select("user_id", "event_type"), ["user_id", "event_type"])


_DIMS = ("o_orderpriority", "o_orderstatus")


@query("WITH o AS (SELECT *, CASE WHEN o_totalprice > 200000 THEN 'reject' ELSE 'approve' END AS outcome FROM orders) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS value, outcome, count(*) AS n FROM o GROUP BY ALL" for d in _DIMS))
def outcome_dims(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("outcome", F.when(F.col("o_totalprice") > 200_000, "reject").otherwise("approve"))
    return review.outcomes(orders, list(_DIMS), "outcome")


@query("WITH o AS (SELECT *, o_totalprice > 200000 AS bad FROM orders) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS value, count(*) AS n, count(*) FILTER (bad) AS rejected, round(count(*) FILTER (bad) / count(*), 4) AS reject_rate FROM o GROUP BY ALL" for d in _DIMS))
def reject_rates(spark, sf_dir):
    return review.reject_rates(outcome_dims(spark, sf_dir), "reject")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS rows, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(spark, sf_dir):
    out = review.totals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], rows=F.lit(1), quantity=F.col("l_quantity"), price=F.col("l_extendedprice"))
    return out.withColumn("price", F.round("price", 2))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O')
SELECT o_orderkey, CASE WHEN r.k IS NOT NULL THEN 'returned' WHEN o.k IS NOT NULL THEN 'open' ELSE 'status ' || o_orderstatus END AS disposition FROM orders LEFT JOIN r ON r.k = o_orderkey LEFT JOIN o ON o.k = o_orderkey""")
def dispositions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    tables = [("returned", lines.where("l_returnflag = 'R'")), ("open", lines.where("l_linestatus = 'O'"))]
    return review.disposition(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", tables, F.concat(F.lit("status "), "o_orderstatus")).select("o_orderkey", "disposition")


@query("""SELECT 'bulk' AS cohort, l_linestatus AS outcome, count(*) AS n FROM lineitem WHERE l_quantity >= 40 GROUP BY ALL UNION ALL SELECT 'discounted', l_linestatus, count(*) FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL UNION ALL SELECT 'taxed', l_linestatus, count(*) FROM lineitem WHERE l_tax > 0.04 GROUP BY ALL""")
def gate_cohorts(spark, sf_dir):
    return review.cohort_counts(table(spark, sf_dir, "lineitem"), "l_linestatus", bulk=F.col("l_quantity") >= 40, discounted=F.col("l_discount") > 0.05, taxed=F.col("l_tax") > 0.04)


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return review.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""WITH r AS (SELECT unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'debts' END, CASE WHEN c_acctbal > 9000 THEN 'rich' END, 'all'], lambda x: x IS NOT NULL)) AS section, c_name || ' (' || c_nationkey || ')' AS line FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY line) AS r, count(*) OVER (PARTITION BY section) AS n FROM r) SELECT section, any_value(n) AS n, string_agg(line, chr(10) ORDER BY line) AS lines FROM k WHERE r <= 10 GROUP BY section""")
def receipts(spark, sf_dir):
    line = F.concat("c_name", F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")"))
    return review.receipt(table(spark, sf_dir, "customer"), {"debts": F.col("c_acctbal") < 0, "rich": F.col("c_acctbal") > 9000, "all": F.lit(True)}, line)


@query("""WITH s AS (SELECT event_type, user_id, count(*) AS u, sum(length(props))::BIGINT AS b, count(*) FILTER (value > 50) AS c FROM events GROUP BY ALL)
SELECT event_type, sum(u)::BIGINT AS units, sum(b)::BIGINT AS bytes, sum(c)::BIGINT AS candidates, (SELECT count(*) FROM events e WHERE e.event_type = s.event_type AND NOT coalesce(e.value > 50, false)) AS zero_yield, max(u) AS most_units_of_a_source FROM s GROUP BY event_type""")
def unit_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "user_id", F.length("props").alias("size"), F.coalesce((F.col("value") > 50).cast("int"), F.lit(0)).alias("found"))
    return review.unit_metrics(events, "event_type", "size", "found", "user_id")


@query("""SELECT event_type, round(sum(value), 4) AS amount, string_agg(DISTINCT (user_id % 4)::VARCHAR, ',' ORDER BY (user_id % 4)::VARCHAR) AS models, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall_seconds FROM events GROUP BY event_type""")
def run_usage(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("model", (F.col("user_id") % 4).cast("string"))
    return review.usage(events, "event_type", F.col("value"), "model", "ts")


@query("""SELECT event_id, sha256(user_id::VARCHAR || chr(0) || event_type) AS fingerprint FROM events WHERE sha256(user_id::VARCHAR || chr(0) || event_type) NOT IN (SELECT sha256(user_id::VARCHAR || chr(0) || event_type) FROM events WHERE ts < TIMESTAMP '2024-01-05')""")
def unseen_tasks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mark = F.sha2(F.concat_ws("\0", F.col("user_id").cast("string"), "event_type"), 256)
    done = events.where(F.col("ts") < at("2024-01-05 00:00:00")).select(mark.alias("fingerprint"))
    return review.unseen(events.select("event_id", "user_id", "event_type"), done, ["user_id", "event_type"]).select("event_id", "fingerprint")


@query("""SELECT o_orderkey, 'c-' || substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'), 1, 20) AS candidate_id FROM orders""")
def candidate_ids(spark, sf_dir):
    return review.identity(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey", "o_orderpriority"]).select("o_orderkey", "candidate_id")


@query("""SELECT l_orderkey, list_filter([CASE WHEN count(*) > 5 THEN 'many lines' END, CASE WHEN max(l_quantity) >= 50 THEN 'a full line' END, CASE WHEN min(l_discount) = 0 THEN 'an undiscounted line' END], lambda x: x IS NOT NULL) AS alerts FROM lineitem GROUP BY l_orderkey""")
def health_alerts(spark, sf_dir):
    state = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"), F.min("l_discount").alias("d"))
    return state.select("l_orderkey", review.alerts(many=(F.col("n") > 5, "many lines"), full=(F.col("q") >= 50, "a full line"), plain=(F.col("d") == 0, "an undiscounted line")).alias("alerts"))


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal) / count(*), 4) AS mean, round(count(*) FILTER (c_acctbal < 0) / count(*), 4) AS debt_share FROM customer WHERE c_mktsegment <> '' GROUP BY c_mktsegment""")
def value_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment <> ''").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"), F.count_if(F.col("c_acctbal") < 0).alias("d"))
    return c.select("c_mktsegment", "n", F.round(F.try_divide("s", "n"), 4).alias("mean"), F.round(F.try_divide("d", "n"), 4).alias("debt_share"))


# Segments ------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS d FROM lineitem GROUP BY ALL), o AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c)
SELECT l.l_orderkey, l.l_linenumber, o.off AS "offset", l.l_tax + o.off AS start_at FROM lineitem l JOIN o USING (l_orderkey, l_linenumber)""")
def segment_offsets(spark, sf_dir):
    out = segments.shifted(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "offset", (F.col("l_tax") + F.col("offset")).alias("start_at"))


@query("""SELECT conv_id, sha256(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY turn)) AS body, arg_min(nullif(role, 'system'), turn) FILTER (role <> 'system') AS language, count(*) AS n FROM conversations GROUP BY conv_id""".replace("\\\\", "\\"))
def segment_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("language", F.when(F.col("role") != "system", F.col("role")))
    return segments.merged(turns, ["conv_id"], ["turn"], "text", "language").select("conv_id", F.sha2("text", 256).alias("body"), "language", "n")


_CUE = "lpad((({0})::BIGINT // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({0})::BIGINT // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((({0})::BIGINT // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((({0})::BIGINT % 1000)::VARCHAR, 3, '0')"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_linestatus) AS n, (l_linenumber * 1700000 + l_quantity * 10)::BIGINT AS a, (l_linenumber * 1700000 + l_quantity * 1000)::BIGINT AS b, l_linestatus FROM lineitem)
SELECT l_orderkey, string_agg(n || chr(10) || {_CUE.format('a')} || ' --> ' || {_CUE.format('b')} || chr(10) || l_linestatus, chr(10) || chr(10) ORDER BY n) AS body FROM s GROUP BY l_orderkey""")
def srt_cues(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_linenumber") * 1700 + F.col("l_quantity") / 100, "b": F.col("l_linenumber") * 1700 + F.col("l_quantity")})
    return segments.cues(lines, ["l_orderkey"], ["l_linenumber", "l_quantity", "l_linestatus"], "a", "b", "l_linestatus")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), m AS (SELECT *, sum(regexp_matches(line, '^[A-D]')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS event FROM l)
SELECT doc_id, event::BIGINT AS event, min(pos) AS first_line, sha256(string_agg(line, chr(10) ORDER BY pos)) AS body FROM m WHERE event > 0 GROUP BY doc_id, event""")
def event_islands(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return segments.islands(lines, ["doc_id"], "pos", "line", "^[A-D]").select("doc_id", "event", F.col("first_line").cast("long").alias("first_line"), F.sha2("text", 256).alias("body"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * CASE l_returnflag WHEN 'A' THEN 0.006 WHEN 'N' THEN 0.003 END, 6) AS cost FROM lineitem")
def cost_estimates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", segments.cost("l_quantity", "l_returnflag", {"A": 0.006, "N": 0.003}).alias("cost"))


# Sets, links ---------------------------------------------------------------------------------------------------------


@query("SELECT 'order without lines' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'document without label', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_children(spark, sf_dir):
    lacking = lambda a, b, ka, kb, kind: table(spark, sf_dir, a).join(table(spark, sf_dir, b).select(F.col(kb).alias(ka)), ka, "left_anti").select(F.lit(kind).alias("kind"), F.col(ka).alias("id"))
    return lacking("orders", "lineitem", "o_orderkey", "l_orderkey", "order without lines").unionAll(lacking("documents", "labels", "doc_id", "doc_id", "document without label"))


@query("""WITH b AS (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents), x AS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels), y AS (SELECT doc_id + 7 AS doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
SELECT 'both' AS kind, count(*) AS n, min(doc_id) AS least FROM b UNION ALL SELECT 'unlabelled', count(*), min(doc_id) FROM x UNION ALL SELECT 'beyond', count(*), min(doc_id) FROM y""")
def orphan_sets(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    one = lambda kind, df: df.agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).select(F.lit(kind).alias("kind"), "n", "least")
    return one("both", lab.intersect(d)).unionAll(one("unlabelled", d.subtract(lab))).unionAll(one("beyond", lab.select(F.col("doc_id") + 7).toDF("doc_id").subtract(d)))


@query(r"""WITH p AS (SELECT url AS name FROM pages), l AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst FROM pages), i AS (SELECT url AS name FROM pages WHERE page_id % 4 <> 0 UNION SELECT 'gone/' || page_id FROM pages WHERE page_id % 50 = 0)
SELECT DISTINCT 'broken_link' AS signal, src AS subject, dst AS detail FROM l WHERE dst NOT IN (SELECT name FROM p) UNION SELECT 'orphan', name, NULL FROM p WHERE name NOT IN (SELECT dst FROM l WHERE src <> dst)
UNION SELECT 'not_in_index', name, NULL FROM p WHERE name NOT IN (SELECT name FROM i) UNION SELECT 'stale_index', name, NULL FROM i WHERE name NOT IN (SELECT name FROM p)""")
def link_audit(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = p.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("dst"))
    index = p.where("page_id % 4 <> 0").select(F.col("url").alias("name")).unionAll(p.where("page_id % 50 = 0").select(F.concat(F.lit("gone/"), F.col("page_id").cast("string")).alias("name")))
    return graph.link_audit(p.select(F.col("url").alias("name")), links, index)


@query("""WITH old AS (SELECT event_type AS signal, user_id::VARCHAR AS file, min(ts) AS first_seen, count(*) AS deferred FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY ALL), new AS (SELECT event_type AS signal, user_id::VARCHAR AS file, min(ts) AS seen FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT signal, file, coalesce(first_seen, seen) AS first_seen, CASE WHEN first_seen IS NULL THEN 0 ELSE deferred + 1 END AS deferred FROM new LEFT JOIN old USING (signal, file)""")
def carried_over(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("signal"), F.col("user_id").cast("string").alias("file"), "ts")
    old = e.where(F.col("ts") < at("2024-01-08 00:00:00")).groupBy("signal", "file").agg(F.min("ts").alias("first_seen"), F.count("*").alias("deferred"))
    new = e.where(F.col("ts") >= at("2024-01-20 00:00:00")).groupBy("signal", "file").agg(F.min("ts").alias("seen"))
    return graph.carried_over(old, new)


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), 'x', 'x') AS key FROM pages""")
def page_facts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), T.key_name(F.col("url")).alias("key"))


@query(r"""SELECT doc_id, nullif(regexp_extract_all(text, 'token = "([0-9a-f]{6})', 1)[-1], '') AS last_token, nullif(regexp_extract_all(text, '(\d+\.\d+\.\d+\.\d+)', 1)[-1], '') AS last_address FROM documents""")
def log_patterns(spark, sf_dir):
    found = readers.log_facts(table(spark, sf_dir, "documents"), "doc_id", "text", {"last_token": 'token = "([0-9a-f]{6})', "last_address": r"(\d+\.\d+\.\d+\.\d+)"})
    return found.select("doc_id", "last_token", "last_address")


@query("""WITH n AS (SELECT l_suppkey AS s, l_partkey AS p FROM lineitem), i AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY min(p)) AS r FROM n GROUP BY s, p) SELECT s AS supplier, count(*) AS parts, string_agg(p::VARCHAR, ',' ORDER BY p) FILTER (r <= 10) AS first_parts FROM i GROUP BY s""")
def grouped_targets(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("p")).agg(F.count("*").alias("n"))
    grouped = parts.groupBy("supplier").agg(F.count("*").alias("parts"), F.slice(F.array_sort(F.collect_list("p")), 1, 10).alias("ten"))
    return grouped.select("supplier", "parts", F.array_join(F.col("ten").cast("array<string>"), ",").alias("first_parts"))


@query("""WITH k AS (SELECT o_orderkey, 1000 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, CASE WHEN o_orderstatus = 'F' THEN true ELSE false END AS good, floor(o_totalprice / 20000)::BIGINT AS score, o_orderpriority FROM orders)
SELECT o_orderpriority, count(*) FILTER (good) AS n_pos, count(*) FILTER (NOT good) AS n_neg, round((sum(CASE WHEN good THEN rk END) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2) / (count(*) FILTER (good) * count(*) FILTER (NOT good)), 9) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY score) + (count(*) OVER (PARTITION BY o_orderpriority, score) - 1) / 2 AS rk FROM k) GROUP BY o_orderpriority""")
def order_auc(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 20_000).alias("score"), (F.col("o_orderstatus") == "F").alias("good"))
    return scoring.roc_auc(orders, "score", "good", ["o_orderpriority"])


@query()
def order_components(spark, sf_dir):
    """Over every line; recursive SQL takes too long for that, so tests hold it against a union-find."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (F.lit(1_000_000_000) + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("b"))
    return graph.components(edges)
