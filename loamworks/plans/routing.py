"""Queries over the sales tables and conversations as rosters, facts, routes, decisions and review entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, gates, reconcile, retrieval, routing
from .registry import query, table

c = F.col


def roster_lines(spark, sf_dir):
    """The parts as lines of people pages: of each size a page, of each type a heading."""
    p = table(spark, sf_dir, "part")
    vault, page = F.concat(F.lit("v"), (c("p_size") % 3).cast("string")), F.concat(F.lit("people/"), c("p_size").cast("string"), F.lit(".md"))
    name = F.concat(F.lit("- **"), F.initcap("p_name"), F.lit(' "'), "p_brand", F.lit('" (x)** and `y`'))
    return p.select(vault.alias("vault"), page.alias("page"), c("p_partkey").alias("pos"), F.when(c("p_partkey") % 4 == 0, F.concat(F.lit("## "), "p_type")).otherwise(name).alias("line"))


_LINES = """rl AS (SELECT 'v' || p_size % 3 AS vault, 'people/' || p_size || '.md' AS page, p_partkey AS pos, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS h, lower(p_name) AS n1, lower(p_brand) AS n2 FROM part),
rs AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY vault, page ORDER BY pos), 'People') AS section FROM rl),
ri AS (SELECT name, vault, page, arg_min(section, pos) AS section FROM (SELECT n1 AS name, * FROM rs WHERE h IS NULL UNION ALL SELECT n2, * FROM rs WHERE h IS NULL) GROUP BY ALL)"""


@query(f"WITH {_LINES} SELECT * FROM ri")
def roster_index(spark, sf_dir):
    return routing.roster_index(roster_lines(spark, sf_dir))


@query("SELECT DISTINCT lower(unnest([c_mktsegment, 'Customers of ' || c_mktsegment])) AS term FROM customer UNION SELECT lower(o_orderpriority) FROM orders")
def known_terms(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(c("c_mktsegment").alias("title"), F.array(F.concat(F.lit("Customers of "), "c_mktsegment")).alias("headings"))
    b = table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("title"), F.lit(None).cast("array<string>").alias("headings"))
    return routing.known_terms(a.unionAll(b))


@query(f"""WITH {_LINES}, t AS (SELECT name, vault, page, section FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY vault <> 'v1', vault, page) AS r FROM ri WHERE name NOT LIKE 'red %') WHERE r = 1),
f AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part)
SELECT f.p_partkey, CASE WHEN t.vault IS NOT NULL THEN 'pre_routed' WHEN f.name NOT LIKE 'Blue %' AND f.name <> 'Red Bolt' THEN 'new_person' ELSE 'remaining' END AS status, t.vault, t.page, t.section,
CASE WHEN t.vault IS NULL AND f.name NOT LIKE 'Blue %' AND f.name <> 'Red Bolt' THEN f.name END AS detected FROM f LEFT JOIN t ON t.name = lower(f.name)""")
def fact_partition(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("content", F.concat(F.initcap("p_name"), F.lit(" asked for an offer")))
    index = routing.roster_index(roster_lines(spark, sf_dir)).where("name NOT LIKE 'red %'")
    terms = part.where("p_name LIKE 'blue %'").select(F.lower("p_name").alias("term")).distinct()
    out = routing.partitioned(part.select("p_partkey", "content"), "p_partkey", "content", index, terms, ("Red Bolt",), "v1")
    return out.select("p_partkey", "status", "vault", "page", "section", "detected")


@query("""WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), j AS (SELECT l_partkey, l_suppkey, lower(p_name || ' ' || p_type || CASE WHEN p_size % 5 = 0 THEN ' met with a manager' ELSE '' END) AS q, 'people/' || p_brand AS x, s_nationkey FROM p JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_partkey, l_suppkey, (least(7.0, 2.0 * (contains(' ' || q || ' ', ' ring ')::INT + contains(' ' || q || ' ', ' widget ')::INT + contains(' ' || q || ' ', ' small ')::INT + contains(' ' || q || ' ', ' economy ')::INT)) + CASE WHEN contains(q, 'met with') AND s_nationkey % 2 = 0 THEN 12 ELSE 0 END
+ CASE WHEN s_nationkey % 3 = 0 AND contains(' ' || q || ' ', ' red widget ') THEN 14 ELSE 0 END + CASE WHEN s_nationkey % 3 <> 0 AND contains(' ' || q || ' ', ' ring ') THEN 14 ELSE 0 END + CASE WHEN contains(' ' || q || ' ', ' ring economy ') THEN 14 ELSE 0 END)::DOUBLE AS boost FROM j""")
def domain_boosts(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = table(spark, sf_dir, "part").select(c("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit(" "), "p_type", F.when(c("p_size") % 5 == 0, " met with a manager").otherwise("")).alias("q"))
    folder, stem = F.when(c("s_nationkey") % 2 == 0, "People/").otherwise("wiki/"), F.when(c("s_nationkey") % 3 == 0, "red-widget.md").otherwise("ring.md")
    supplier = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("l_suppkey"), F.concat(folder, stem).alias("page"))
    joined = pairs.join(part, "l_partkey").join(supplier, "l_suppkey")
    return routing.domain_boosts(joined, c("q"), F.lit("ring widget small economy"), c("page"), F.lit("Ring Economy")).select("l_partkey", "l_suppkey", "boost")


@query("""WITH r AS (SELECT o_custkey AS batch, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 97)::VARCHAR END AS id, o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS payload FROM orders),
n AS (SELECT *, count(*) OVER (PARTITION BY batch, id) AS n FROM r) SELECT o_orderkey, CASE WHEN id IS NULL THEN 'missing id' WHEN payload IS NULL THEN 'missing payload' WHEN n > 1 THEN 'repeated id' END AS reason FROM n""")
def batch_contract(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("batch"), F.when(c("o_orderkey") % 13 != 0, (c("o_orderkey") % 97).cast("string")).alias("id"), F.when(c("o_orderkey") % 17 != 0, c("o_orderstatus")).alias("payload"))
    return routing.judged_batches(orders, "batch", "id", "payload").select("o_orderkey", "reason")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing vault' WHEN o_orderkey % 7 = 0 THEN 'missing section' END AS reason, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey ELSE o_orderpriority END AS page FROM orders WHERE o_orderstatus = 'F'""")
def routed_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    nested = F.when(c("o_orderkey") % 2 == 0, F.struct(F.when(c("o_orderstatus") == "F", "routed").otherwise("gap").alias("status"), F.concat(F.lit("n"), c("o_orderkey").cast("string")).alias("page")))
    rows = o.select("o_orderkey", nested.alias("route"), F.when(c("o_orderstatus") == "F", "routed").alias("status"), c("o_orderpriority").alias("page"), F.when(c("o_orderkey") % 5 != 0, "v").alias("vault"), F.when(c("o_orderkey") % 7 == 0, " ").otherwise("s").alias("section"))
    return routing.routed_only(routing.unwrapped(rows, "route", ["status", "page"])).select("o_orderkey", "reason", "page")


@query("""SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_custkey % 6 = 0 THEN 'segment' END], lambda x: x IS NOT NULL) AS missing FROM customer""")
def required_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(c("c_acctbal") >= 0, c("c_acctbal")).alias("balance"), F.when(c("c_custkey") % 6 == 0, "  ").otherwise(c("c_mktsegment")).alias("segment"))
    return routing.required(rows, ["balance", "segment"]).select("c_custkey", "missing")


@query(r"""SELECT DISTINCT lang AS vault, source || '/' || doc_id % 10 || CASE WHEN doc_id % 10 = 3 THEN '/README.md' WHEN doc_id % 10 = 4 THEN '.txt' ELSE '.md' END AS page FROM documents WHERE doc_id % 10 NOT IN (3, 4)""")
def canonical_set(spark, sf_dir):
    end = F.when(c("doc_id") % 10 == 3, "/README.md").when(c("doc_id") % 10 == 4, ".txt").otherwise(".md")
    return routing.canonical_set(table(spark, sf_dir, "documents").select(c("lang").alias("vault"), F.concat("source", F.lit("/"), (c("doc_id") % 10).cast("string"), end).alias("page")))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'routed' WHEN 'O' THEN 'ambiguous' ELSE 'gap' END AS status FROM orders), a AS (SELECT DISTINCT l_orderkey AS o_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'),
p AS (SELECT o_orderkey, list(s_name ORDER BY s_acctbal DESC, s_name)[1:32] AS retrieved FROM r JOIN a USING (o_orderkey) JOIN supplier ON s_suppkey = l_suppkey WHERE status <> 'routed' GROUP BY o_orderkey)
SELECT o_orderkey, status, CASE WHEN status = 'ambiguous' THEN 'ambiguous_pages' WHEN retrieved IS NOT NULL THEN 'no_suitable_page' ELSE 'no_candidates' END AS reason, coalesce(retrieved, []) AS retrieved FROM r LEFT JOIN p USING (o_orderkey) WHERE status <> 'routed'""")
def routing_gaps(spark, sf_dir):
    routes = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "F", "routed").when(c("o_orderstatus") == "O", "ambiguous").otherwise("gap").alias("status"))
    allowed = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(c("l_orderkey").alias("o_orderkey"), c("l_suppkey").alias("page_id")).distinct()
    catalog = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("page_id"), c("s_name").alias("page"), c("s_acctbal").alias("score"))
    return routing.gap_rows(routes, allowed, catalog, "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'again' WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS answer, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 1 THEN 'empty' END AS reason, o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AS recovered FROM orders""")
def retried_routes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("failed", c("o_orderkey") % 3 == 0)
    first = o.select("o_orderkey", F.when(~c("failed"), c("o_orderstatus")).alias("answer"), F.when(c("failed"), "empty").alias("reason"))
    again = o.where("o_custkey % 2 = 0").select("o_orderkey", F.lit("again").alias("answer"), F.lit(None).cast("string").alias("reason"))
    return routing.retried(first, again, "o_orderkey", ["answer"])


# Decisions -----------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey AS batch, l_linenumber AS pos, l_quantity, l_partkey % 40 AS id, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
g AS (SELECT batch, list(id ORDER BY k) AS ids, list(CASE WHEN batch % 7 = 0 THEN id + 1 ELSE id END ORDER BY k) AS flat, bool_or(l_suppkey % 5 = 0 AND batch % 3 = 0) AS off FROM l GROUP BY batch)
SELECT batch, CASE WHEN ids <> flat THEN 'groups and list differ' WHEN len(list_distinct(ids)) < len(ids) THEN 'repeated id' WHEN off THEN 'target differs' END AS fault FROM g""")
def packed_batches(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = line.select(c("l_orderkey").alias("batch"), F.lit(0).alias("group"), "pos", (c("l_partkey") % 40).cast("string").alias("id"), F.lit("v").alias("vault"), F.when((c("l_suppkey") % 5 == 0) & (c("l_orderkey") % 3 == 0), "q").otherwise("p").alias("page"), F.lit("v").alias("target_vault"), F.lit("p").alias("target_page"))
    flat = line.select(c("l_orderkey").alias("batch"), "pos", F.when(c("l_orderkey") % 7 == 0, c("l_partkey") % 40 + 1).otherwise(c("l_partkey") % 40).cast("string").alias("id"))
    return reconcile.batch_faults(rows, flat, "batch", "id")


def decisions(spark, sf_dir):
    """Orders as decisions about customers' facts."""
    o = table(spark, sf_dir, "orders")
    action = F.element_at(F.array(*map(F.lit, ("new", "duplicate", "supersede", "contradict", "other"))), (c("o_orderkey") % 5 + 1).cast("int"))
    old = F.when(c("o_orderkey") % 3 == 0, "- old").when(c("o_orderkey") % 3 == 1, "| cell |")
    return o.select("o_orderkey", action.alias("action"), old.alias("old_content"), c("o_orderpriority").alias("content"), "o_custkey")


_DEC = """d AS (SELECT o_orderkey, ['new', 'duplicate', 'supersede', 'contradict', 'other'][o_orderkey % 5 + 1] AS action, CASE o_orderkey % 3 WHEN 0 THEN '- old' WHEN 1 THEN '| cell |' END AS old_content, o_orderpriority AS content, o_custkey FROM orders),
j AS (SELECT d.*, CASE WHEN o_custkey % 2 = 0 THEN '- ' ELSE '' END || c_name AS fact, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'medium' ELSE 'low' END AS conf, c_mktsegment AS section, c_name, c_acctbal FROM d LEFT JOIN customer ON c_custkey = o_custkey),
k AS (SELECT *, CASE action WHEN 'new' THEN 'append' WHEN 'duplicate' THEN 'none' WHEN 'supersede' THEN 'replace' WHEN 'contradict' THEN 'replace' END AS mode, CASE WHEN action <> 'other' THEN conf END AS confidence, CASE WHEN action <> 'other' THEN NOT (action = 'duplicate' OR (action = 'new' AND conf = 'high')) END AS needs_review,
CASE WHEN action = 'duplicate' THEN '' WHEN action = 'new' THEN fact WHEN action <> 'other' AND fact IS NOT NULL THEN CASE WHEN old_content = '- old' THEN '- ' || regexp_replace(fact, '^- ', '') ELSE content END ELSE content END AS new_content,
CASE WHEN action NOT IN ('duplicate', 'new') THEN old_content END AS kept_old FROM j)"""


def derived(spark, sf_dir):
    d = decisions(spark, sf_dir)
    customer = table(spark, sf_dir, "customer").withColumn("confidence", F.when(c("c_acctbal") > 5000, "high").when(c("c_acctbal") > 0, "medium").otherwise("low"))
    facts = d.select("o_orderkey", "o_custkey").join(customer, c("o_custkey") == c("c_custkey"), "left")
    candidates = facts.select("o_orderkey", F.concat(F.when(c("o_custkey") % 2 == 0, "- ").otherwise(""), "c_name").alias("candidate_content"), "confidence")
    return reconcile.canonical_decisions(d.drop("o_custkey"), candidates, reconcile.packed_sections(facts, "o_orderkey", c("c_mktsegment"), F.lit(None).cast("string")), "o_orderkey")


@query(f"WITH {_DEC} SELECT o_orderkey, action, mode, section, confidence, needs_review, new_content AS content, kept_old AS old_content FROM k")
def canonical_decisions(spark, sf_dir):
    return derived(spark, sf_dir)


@query(f"""WITH {_DEC} SELECT action, CASE WHEN needs_review THEN 'queued' ELSE 'applied' END AS review_status, CASE WHEN needs_review THEN CASE confidence WHEN 'low' THEN 'brainstormed' WHEN 'medium' THEN 'uncertain' ELSE 'destructive' END ELSE '' END AS queue_bucket,
'v/' || section || '.md' AS target, confidence, count(*) AS n, min(new_content) AS least FROM k GROUP BY ALL""")
def fact_events(spark, sf_dir):
    rows = derived(spark, sf_dir).withColumns({"vault": F.lit("v"), "page": F.concat("section", F.lit(".md"))})
    return reconcile.fact_events(rows).groupBy("action", "review_status", "queue_bucket", "target", "confidence").agg(F.count("*").alias("n"), F.min("content").alias("least"))


@query(f"""WITH {_DEC} SELECT o_orderkey, new_content AS title, '/vaults/v' AS vault_root, 'v/p.md#' || coalesce(section, '') AS target_display, c_name AS candidate_type, c_acctbal AS evidence, 'r1' AS run_id FROM k""")
def decision_sidecars(spark, sf_dir):
    rows = derived(spark, sf_dir).withColumns({"vault": F.lit("v"), "page": F.lit("p.md")})
    roots = spark.createDataFrame([("v", "/vaults/v"), ("w", "/vaults/w")], "vault string, root string")
    facts = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("c_custkey") == c("o_custkey"), "left").select("o_orderkey", c("c_name").alias("type"), c("c_acctbal").alias("evidence"))
    out = reconcile.enriched(reconcile.sidecars(rows, roots, "o_orderkey"), facts, "o_orderkey", {"run_id": "r1"})
    return out.select("o_orderkey", "title", "vault_root", "target_display", "candidate_type", "evidence", "run_id")


@query("""WITH s AS (SELECT c_custkey, 'v' AS vault, CASE WHEN c_custkey % 3 = 0 THEN 'supersede' END AS action, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS content, CASE WHEN c_acctbal > 0 THEN 'old' ELSE '' END AS old, CASE WHEN c_custkey % 7 = 0 THEN 'seen' END AS ev FROM customer WHERE c_custkey % 4 <> 0),
j AS (SELECT p.c_custkey, p.c_mktsegment AS title, s.*, coalesce(s.action, 'new') AS act FROM customer p LEFT JOIN s ON s.c_custkey = p.c_custkey)
SELECT c_custkey, coalesce(vault, '') AS vault, title || '.md' AS target_file, 'Sec' AS target_section, act AS proposed_action, CASE WHEN act = 'supersede' AND old <> '' THEN 'old' END AS before, CASE WHEN act = 'supersede' AND old <> '' THEN NULL ELSE coalesce(content, title) END AS add_line, ev IS NOT NULL AS source_evidence_available,
c_custkey % 5 = 0 AS decided, CASE WHEN title = 'HOUSEHOLD' AND vault IS NOT NULL THEN 'active_state' ELSE 'other' END AS fact_class, CASE WHEN vault IS NULL THEN 'legacy' ELSE 'run' END AS review_cohort FROM j""")
def review_cards(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    text = lambda v: F.lit(v).cast("string")
    pending = cust.select("c_custkey", c("c_mktsegment").alias("title"), F.concat("c_mktsegment", F.lit(".md#Sec")).alias("target"), text("why").alias("evidence"), text(None).alias("confidence"), text(None).alias("bucket"), text("2024-01-02T03:04").alias("captured"))
    sides = cust.where("c_custkey % 4 <> 0").select("c_custkey", text("v").alias("vault"), text(None).alias("page"), text(None).alias("section"), F.when(c("c_custkey") % 3 == 0, "supersede").alias("action"), F.when(c("c_custkey") % 2 == 0, c("c_name")).alias("content"), F.when(c("c_acctbal") > 0, "old").otherwise("").alias("old_content"), F.when(c("c_custkey") % 7 == 0, "seen").alias("source_evidence"), text(None).alias("rationale"), text("thing").alias("candidate_type"), F.when(c("c_mktsegment") == "HOUSEHOLD", "current").alias("memory_tier"), text(None).alias("fact_class"), text("r1").alias("run_id"))
    decided = cust.where("c_custkey % 5 = 0").select("c_custkey", text("accept").alias("decision"))
    out = reconcile.review_cards(pending, sides, decided, "c_custkey")
    return out.select("c_custkey", "vault", "target_file", "target_section", "proposed_action", "diff.before", "diff.add_line", "source_evidence_available", "decided", "fact_class", "review_cohort")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), a AS (SELECT doc_id, list(line) AS lines FROM l GROUP BY doc_id), m AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'no such line' ELSE string_split(text, chr(10))[1] END AS line FROM documents)
SELECT m.doc_id, len(list_filter(lines, lambda x: x = m.line)) AS hits, len(list_filter(lines, lambda x: x = m.line)) = 1 AS valid FROM m JOIN a USING (doc_id)""")
def cleanup_preview(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n"))
    manifest = d.select(c("doc_id").alias("page"), F.when(c("doc_id") % 6 == 0, "no such line").otherwise(F.element_at("lines", 1)).alias("line"))
    return reconcile.previewed(manifest, d.select(c("doc_id").alias("page"), "lines")).withColumnRenamed("page", "doc_id").select("doc_id", "hits", "valid")


@query("""SELECT l_orderkey AS manifest, count(*) AS n, count(*) FILTER (l_quantity > 45) AS faults, count(*) FILTER (l_quantity > 45) = 0 AS accepted FROM lineitem GROUP BY l_orderkey""")
def cleanup_acceptance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("manifest"), (c("l_quantity") <= 45).alias("valid"))
    return reconcile.accepted(rows, "manifest")


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN 'unknown action' WHEN user_id % 9 = 0 THEN 'missing page' WHEN event_type = 'view' AND user_id % 4 = 0 THEN 'replace without old_content' END AS reason FROM events""")
def undo_contract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    action = F.when(c("event_type") == "click", "append").when(c("event_type") == "view", "replace").when(c("event_type") == "error", "remove").otherwise(c("event_type"))
    log = e.select("event_id", action.alias("action"), F.when(c("user_id") % 9 != 0, "p.md").alias("page"), F.when(c("user_id") % 4 != 0, "old").alias("old_content"))
    return reconcile.valid_undo(log, ["page"]).select("event_id", "reason")


@query(r"""WITH l AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY page ORDER BY pos) AS used FROM l WHERE pos < 20),
b AS (SELECT page, list(line ORDER BY pos) AS lines, max(used)::BIGINT AS used FROM u WHERE used <= 900 GROUP BY page)
SELECT doc_id AS page, coalesce(len(lines), 0)::BIGINT AS n, coalesce(used, 0) AS used, sha256(text) AS sha256 FROM documents LEFT JOIN b ON page = doc_id""")
def page_contexts(spark, sf_dir):
    """Pages without headings: what stands before the first one, within the cap (tests have pages with sections)."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(c("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    none = d.select(c("doc_id").alias("page"), F.lit("Section").alias("section"))
    facts = table(spark, sf_dir, "benchmark").select(c("item_id").alias("page"), c("item_id").alias("fact"), c("text").alias("content"))
    return reconcile.page_contexts(lines, none, facts, 900).select("page", F.size("lines").cast("long").alias("n"), "used", "sha256")


OLD, NEW = ("- keep", "plain", "| a | b |", "# T", "- twice", "absent", "two\nlines"), ("- b", "t", "| c | d |", "| e", "", "- n", "u", "a\nb", "w")
LINES = ("# T", "- keep", "- twice", "- twice", "| a | b |", "plain", "two\nlines")


def _picked(values, n):
    return "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + f"][{n} + 1]"


@query(f"""WITH d AS (SELECT o_orderkey, ['new', 'duplicate', 'supersede', 'contradict', 'forget'][o_orderkey % 5 + 1] AS action, o_orderkey % 11 = 0 AS wrong_mode, o_orderkey % 13 = 0 AS off_page, o_orderkey % 17 = 0 AS off_section,
CASE WHEN o_orderkey % 19 = 0 THEN 'sure' ELSE ['high', 'medium', 'low'][o_orderkey % 3 + 1] END AS confidence, o_orderkey % 31 = 0 AS unsaid,
CASE WHEN o_orderkey % 5 IN (2, 3) THEN {_picked(OLD, "o_orderkey % 7")} WHEN o_orderkey % 37 = 0 THEN 'x' END AS old, CASE WHEN o_orderkey % 5 = 1 THEN CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE '' END ELSE {_picked(NEW, "o_orderkey % 9")} END AS new FROM orders),
e AS (SELECT *, action IN ('supersede', 'contradict') AS replaces, CASE WHEN o_orderkey % 23 = 0 THEN 'low' ELSE confidence END AS candidate FROM d)
SELECT o_orderkey, CASE WHEN action = 'forget' THEN 'invalid action' WHEN wrong_mode THEN 'mode does not fit the action' WHEN off_page THEN 'other target than the batch' WHEN off_section THEN 'other section than routed' WHEN confidence = 'sure' THEN 'invalid confidence'
WHEN confidence <> candidate THEN 'confidence is not the candidate''s' WHEN o_orderkey % 29 = 0 THEN 'needs_review does not follow' WHEN unsaid THEN 'no rationale' WHEN NOT replaces AND old IS NOT NULL THEN 'old_content without a replacement'
WHEN (action = 'duplicate') <> (new = '') THEN 'content does not fit the action' WHEN contains(new, chr(10)) THEN 'content of several lines' WHEN action = 'new' AND starts_with(new, '- ') THEN 'new content has a bullet'
WHEN replaces AND contains(old, chr(10)) THEN 'old_content of several lines' WHEN replaces AND len(list_filter([{", ".join("'" + x + "'" for x in LINES[:-1])}], lambda x: x = old)) <> 1 THEN 'old_content is not one line of the page' WHEN replaces AND starts_with(old, '#') THEN 'a heading may not be replaced'
WHEN replaces AND starts_with(old, '- ') AND NOT starts_with(new, '- ') THEN 'the bullet is lost' WHEN replaces AND starts_with(old, '|') AND NOT (new LIKE '|%|') THEN 'the table row is lost' END AS reason FROM e""")
def decision_contract(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), c("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    action = pick(("new", "duplicate", "supersede", "contradict", "forget"), 5)
    mode = F.when(k % 11 == 0, "stale").otherwise(pick(("append", "none", "replace", "replace", "none"), 5))
    confidence = F.when(k % 19 == 0, "sure").otherwise(pick(("high", "medium", "low"), 3))
    rows = o.select(
        "o_orderkey", action.alias("action"), mode.alias("mode"), confidence.alias("confidence"), F.when(k % 23 == 0, "low").otherwise(confidence).alias("candidate_confidence"),
        F.lit("v").alias("vault"), F.lit("v").alias("target_vault"), F.when(k % 13 == 0, "q.md").otherwise("p.md").alias("page"), F.lit("p.md").alias("target_page"), F.when(k % 17 == 0, "X").otherwise("S").alias("section"), F.lit("S").alias("target_section"),
        F.when(k % 31 == 0, "  ").otherwise("why").alias("rationale"), F.when((k % 5).isin(2, 3), pick(OLD, 7)).when(k % 37 == 0, "x").alias("old_content"), F.when(k % 5 == 1, F.when(k % 41 == 0, "x").otherwise("")).otherwise(pick(NEW, 9)).alias("content"),
        F.array(*map(F.lit, LINES)).alias("lines"),
    )
    rows = rows.withColumn("needs_review", F.when(k % 29 == 0, ~contracts.expected_review(c("action"), c("confidence"))).otherwise(contracts.expected_review(c("action"), c("confidence"))))
    return contracts.judged(rows, contracts.decision_checks()).select("o_orderkey", "reason")


_STARTERS = ", ".join(f"'{w}'" for w in (*gates.NO_NAMES, "nobody"))
_SPAN = r"'^[^\p{L}\p{N}_]*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})(?:[^\p{L}\p{N}_]|$)'"


@query(rf"""WITH s AS (SELECT *, regexp_extract(text, {_SPAN}, 1) AS span FROM documents), f AS (SELECT *, lower(regexp_extract(span, '^\S+')) AS first FROM s)
SELECT doc_id, CASE WHEN first LIKE '%ing' OR first IN ({_STARTERS}) THEN '' ELSE span END AS span, contains(source, 'src1') AS inside FROM f""")
def person_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(gates.person_span(c("text"), ("Nobody",)), F.lit("")).alias("span"), (gates.safe_path(c("source")) & F.contains("source", F.lit("src1"))).alias("inside"))


BEFORE, AFTER = ("", '"', "Implementing ", "Met ", "- ", "The ", "* **", "Next "), (" asked", "'s tea", "", '" said', " (new)")


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(rf"""WITH {_LINES}, f AS (SELECT p_partkey, {_list(BEFORE)}[p_partkey % 8 + 1] || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || {_list(AFTER)}[p_partkey % 5 + 1] AS content FROM part),
i AS (SELECT DISTINCT name FROM ri WHERE name NOT LIKE 'red %' AND name NOT LIKE 'green %'), k AS (SELECT name FROM i UNION SELECT 'blue'),
r AS (SELECT p_partkey, max(name) AS name FROM f JOIN i ON regexp_matches(lower(content), '^[^\p{{L}}\p{{N}}_]*' || regexp_escape(name) || '(?:[^\w''’-]|$)') GROUP BY p_partkey),
s AS (SELECT f.*, r.name AS known, regexp_extract(content, {_SPAN}, 1) AS span FROM f LEFT JOIN r USING (p_partkey)), t AS (SELECT *, lower(regexp_extract(span, '^\S+')) AS first FROM s),
d AS (SELECT *, known IS NULL AND span <> '' AND NOT first LIKE '%ing' AND first NOT IN ({_STARTERS.replace("'nobody'", "'red bolt'")}) AND lower(span) <> 'red bolt' AND lower(span) NOT IN (FROM k) AND first NOT IN (FROM k) AS fresh FROM t)
SELECT p_partkey, CASE WHEN known IS NOT NULL THEN 'pre_routed' WHEN fresh THEN 'new_person' ELSE 'remaining' END AS status, CASE WHEN fresh THEN span END AS detected FROM d""")
def new_persons(spark, sf_dir):
    """Facts that begin with a name, with marks, words and possessives around it."""
    k = c("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    facts = table(spark, sf_dir, "part").select(k, F.concat(pick(BEFORE, 8), F.initcap("p_name"), pick(AFTER, 5)).alias("content"))
    index = routing.roster_index(roster_lines(spark, sf_dir)).where("name NOT LIKE 'red %' AND name NOT LIKE 'green %'")
    terms = table(spark, sf_dir, "part").select(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("term")).where("term = 'blue'").distinct()
    return routing.partitioned(facts, "p_partkey", "content", index, terms, ("Red Bolt",)).select("p_partkey", "status", "detected")


FRAGMENTS = {2: "PR #12 waits. ", 3: "The current branch is feat/x. ", 5: "See commit 0abc123. ", 7: "All tests have passed. ", 11: "Currently debugging it. ", 13: "Do not push! "}
KINDS = ("Tool Choice", "exam-prep", "debug state", "Person", None, "misc")


@query(f"""WITH t AS (SELECT o_orderkey, {" || ".join(f"CASE WHEN o_orderkey % {n} = 0 THEN '{x}' ELSE '' END" for n, x in FRAGMENTS.items())} || lower(o_orderpriority) AS content, [{", ".join("NULL" if x is None else f"'{x}'" for x in KINDS)}][o_orderkey % 6 + 1] AS kind, o_orderstatus = 'O' AS current FROM orders),
u AS (SELECT *, regexp_replace(lower(coalesce(kind, '')), '[^a-z0-9]+', '_', 'g') || ' ' || lower(content) AS told FROM t),
v AS (SELECT *, CASE {" ".join("WHEN " + " OR ".join(f"contains(told, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in gates.CLASS_MARKS.items())} WHEN current THEN 'active_state' ELSE 'other' END AS fact_class FROM u)
SELECT o_orderkey, fact_class, list_filter([{", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{n}' END" for n, p in gates.EXECUTION_PATTERNS.items())}, CASE WHEN fact_class = 'audit_telemetry' THEN 'audit_telemetry' END], lambda x: x IS NOT NULL) AS policy_reasons, len(policy_reasons) > 0 AS policy_review_only FROM v""")
def policy_reasons(spark, sf_dir):
    k = c("o_orderkey")
    parts = [F.when(k % n == 0, x).otherwise("") for n, x in FRAGMENTS.items()]
    kind = F.element_at(F.array(*(F.lit(x).cast("string") for x in KINDS)), (k % 6 + 1).cast("int"))
    facts = table(spark, sf_dir, "orders").select(k, F.concat(*parts, F.lower("o_orderpriority")).alias("content"), kind.alias("kind"), F.when(c("o_orderstatus") == "O", "current").otherwise("stable").alias("tier"))
    return gates.with_policy(facts, "kind", "content", "tier").select("o_orderkey", "fact_class", "policy_reasons", "policy_review_only")


_TOK = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_+-]*'), lambda t: length(t) > 1)"


@query(rf"""WITH pg AS (SELECT 'v' || p_size % 4 AS vault, CASE WHEN p_partkey % 5 = 0 THEN 'people/' ELSE 'wiki/' END || replace(p_name, ' ', '-') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || p_partkey END || '.md' AS page, p_type AS title, [p_brand, p_name] AS headings,
['notes on metal work', 'widget and gear plans', 'small economy', ''][p_size % 4 + 1] AS purpose, p_name || ' ' || p_name || ' about ' || p_type AS overview, p_partkey FROM part),
p AS (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY vault, page ORDER BY p_partkey) = 1),
q AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'I met with someone' WHEN 1 THEN 'The Red Widget is a SMALL thing' WHEN 2 THEN 'plans of metal gear, says a friend' ELSE 'economy polished steel' END || ' ' || s_name AS text FROM supplier),
w AS (SELECT vault, page, unnest({_TOK('page')}) AS t, 5 AS n FROM p UNION ALL SELECT vault, page, unnest({_TOK('title')}), 5 FROM p UNION ALL SELECT vault, page, unnest({_TOK("array_to_string(headings, ' ')")}), 3 FROM p UNION ALL SELECT vault, page, unnest({_TOK('purpose')}), 2 FROM p UNION ALL SELECT vault, page, unnest(list_distinct({_TOK('overview')})), 1 FROM p),
tf AS (SELECT vault, page, t, sum(n) AS tf FROM w GROUP BY ALL), ln AS (SELECT vault, page, sum(tf) AS len FROM tf GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len) AS mean FROM ln), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
qt AS (SELECT s_suppkey, t, count(*) AS qf FROM (SELECT s_suppkey, unnest({_TOK('text')}) AS t FROM q) GROUP BY ALL),
b AS (SELECT s_suppkey, vault, page, sum(qf * ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS bm25 FROM qt JOIN tf USING (t) JOIN df USING (t) JOIN ln USING (vault, page), st GROUP BY ALL),
x AS (SELECT s_suppkey, vault, page, ' ' || array_to_string({_TOK('text')}, ' ') || ' ' AS words, {_TOK('text')} AS ws, lower(text) AS low, ' ' || array_to_string({_TOK('title')}, ' ') || ' ' AS title, ' ' || array_to_string({_TOK("replace(regexp_replace(regexp_extract(page, '[^/]+$'), '[.][^.]*$', ''), '-', ' ')")}, ' ') || ' ' AS stem, {_TOK('purpose')} AS purpose FROM q, p),
s AS (SELECT x.s_suppkey, x.vault, x.page, coalesce(bm25, 0) + least(7.0, 2.0 * len(list_intersect(list_distinct(ws), purpose))) + CASE WHEN contains(words, stem) THEN 14 ELSE 0 END + CASE WHEN contains(words, title) THEN 14 ELSE 0 END + CASE WHEN contains(page, 'people') AND (contains(low, 'met with') OR contains(low, 'friend')) THEN 12 ELSE 0 END AS score
FROM x LEFT JOIN b USING (s_suppkey, vault, page)),
r AS (SELECT s_suppkey, vault, page, round(score, 6) AS score, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(score, 6) DESC, vault, page) AS rank FROM s WHERE round(score, 6) > 0)
SELECT * FROM r WHERE rank <= 12""")
def boosted_pages(spark, sf_dir):
    """Suppliers' notes look for parts' pages: by words, phrases, purposes, and people for whom no word is shared."""
    part, k = table(spark, sf_dir, "part"), c("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    name = F.concat(F.when(k % 5 == 0, "people/").otherwise("wiki/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("-"), k.cast("string"))), F.lit(".md"))
    page = part.select(F.concat(F.lit("v"), (c("p_size") % 4).cast("string")).alias("vault"), name.alias("page"), F.struct(k, c("p_type").alias("title"), F.array("p_brand", "p_name").alias("headings"), pick(("notes on metal work", "widget and gear plans", "small economy", ""), c("p_size") % 4).alias("purpose"), F.concat("p_name", F.lit(" "), "p_name", F.lit(" about "), "p_type").alias("overview")).alias("s"))
    pages = page.groupBy("vault", "page").agg(F.min_by("s", "s.p_partkey").alias("s")).select("vault", "page", "s.title", "s.headings", "s.purpose", "s.overview")
    said = pick(("I met with someone", "The Red Widget is a SMALL thing", "plans of metal gear, says a friend", "economy polished steel"), c("s_suppkey") % 4)
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(said, F.lit(" "), "s_name").alias("text"))
    return retrieval.search_pages(asked, "s_suppkey", "text", pages, 12)
