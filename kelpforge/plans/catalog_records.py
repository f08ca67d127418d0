"""Queries over records: states, queues, retrieval, metrics. Facts, sources and jobs are read off the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import grounding as G
from ..operators import records as R
from ..operators import retrieval as Q
from .registry import query

AS_OF = "1996-06-30"
STATUS = ["extracted", "needs_review", "approved", "published", "rejected"]


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))


def _facts(t):
    """Line items as facts of their order."""
    li = t("lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(
        key.alias("record_id"), F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").cast("string").alias("workspace_id"), _pick(STATUS, F.pmod(key, F.lit(5))).alias("status"),
        F.when(F.pmod(key, F.lit(11)) == 0, key + 1).alias("superseded_by"), F.col("l_shipdate").alias("valid_from"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")).alias("valid_until"), F.col("l_shipdate").alias("created_at"),
    )


FACTS = f"""facts AS (SELECT l_orderkey * 10 + l_linenumber AS record_id, l_orderkey AS source_id, l_suppkey::VARCHAR AS workspace_id, ({STATUS})[((l_orderkey * 10 + l_linenumber) % 5 + 1)::INT] AS status,
  CASE WHEN (l_orderkey * 10 + l_linenumber) % 11 = 0 THEN l_orderkey * 10 + l_linenumber + 1 END AS superseded_by, l_shipdate AS valid_from, CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 90 DAY END AS valid_until, l_shipdate AS created_at FROM lineitem)"""


@query(f"""
WITH {FACTS}, s AS (SELECT o_orderkey AS source_id FROM orders WHERE o_orderstatus <> 'P')
SELECT record_id, f.source_id, workspace_id, status FROM facts f JOIN s ON f.source_id = s.source_id WHERE status = 'published' AND superseded_by IS NULL
  AND valid_from <= TIMESTAMP '{AS_OF}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AS_OF}')""")
def published_view(t):
    facts = _facts(t)
    sources = t("orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("published").alias("source_status"), F.lit(None).cast("timestamp").alias("deleted_at"))
    held = facts.select("source_id", "workspace_id").distinct()
    shown = R.published(facts, sources.join(held, "source_id"), F.lit(AS_OF).cast("timestamp"))
    return shown.select("record_id", "source_id", "workspace_id", "status")


@query(f"""
WITH {FACTS}, c AS (SELECT o_orderkey * 10 + unnest([1, 2]) AS record_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT record_id, status FROM facts WHERE record_id IN (SELECT record_id FROM c)""")
def contradiction_semi(t):
    base = F.col("o_orderkey") * 10
    listed = t("orders").select(F.array(base + 1, base + 2).alias("record_ids"), F.when(F.col("o_orderpriority") == "1-URGENT", "open").otherwise("resolved").alias("status"))
    return R.contradicted(_facts(t), listed).select("record_id", "status")


QUEUE = f"""{FACTS}, q AS (SELECT source_id AS chunk_id, count(*) AS facts, count(*) FILTER (status IN ('extracted', 'needs_review')) AS pending,
  min(created_at) FILTER (status IN ('extracted', 'needs_review')) AS first_pending FROM facts GROUP BY 1 HAVING pending > 0)"""


def _queue(t):
    return R.review_queue(t("orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderpriority"), _facts(t).withColumnRenamed("source_id", "chunk_id"))


@query(f"WITH {QUEUE} SELECT chunk_id, o_orderpriority, facts, pending, first_pending FROM q JOIN orders ON o_orderkey = chunk_id")
def review_queue(t):
    return _queue(t).select("chunk_id", "o_orderpriority", "facts", "pending", "first_pending")


@query(f"WITH {QUEUE} SELECT chunk_id, facts, pending FROM q JOIN orders ON o_orderkey = chunk_id ORDER BY first_pending, chunk_id LIMIT 20 OFFSET 20")
def review_page(t):
    return R.page_of(_queue(t), [F.asc("first_pending"), F.asc("chunk_id")], 2, 20).select("chunk_id", "facts", "pending")


@query("""
SELECT * FROM (SELECT 'rule' AS kind, o_orderkey AS id, o_orderdate AS published_at FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'fact', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem WHERE l_linestatus = 'F') ORDER BY published_at DESC, kind, id LIMIT 50 OFFSET 100""")
def knowledge_page(t):
    rules = t("orders").where("o_orderstatus = 'F'").select(F.lit("rule").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"))
    facts = t("lineitem").where("l_linestatus = 'F'").select(F.lit("fact").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("published_at"))
    return R.page_of(rules.unionByName(facts), [F.desc("published_at"), F.asc("kind"), F.asc("id")], 3, 50)


@query(f"""
WITH {FACTS}, ch AS (SELECT source_id, 'record' AS kind, status FROM facts UNION ALL SELECT o_orderkey, 'job', CASE o_orderkey % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'succeeded' END FROM orders),
s AS (SELECT source_id, count(*) FILTER (kind = 'job' AND status IN ('queued', 'running', 'retrying')) AS active, count(*) FILTER (kind = 'job' AND status = 'failed') AS failed,
  count(*) FILTER (kind = 'record' AND status IN ('extracted', 'needs_review')) AS pending, count(*) FILTER (kind = 'record' AND status NOT IN ('published', 'rejected', 'superseded', 'deprecated')) AS unpublished,
  count(*) FILTER (kind = 'record' AND status = 'published') AS published FROM ch GROUP BY 1)
SELECT *, CASE WHEN active > 0 THEN 'processing' WHEN failed > 0 THEN 'failed' WHEN pending > 0 THEN 'needs_review' WHEN unpublished = 0 AND published > 0 THEN 'published' ELSE 'extracted' END AS source_status FROM s""")
def source_state(t):
    at = F.col("o_orderkey") % 9
    jobs = t("orders").select(F.col("o_orderkey").alias("source_id"), F.lit("job").alias("kind"), F.when(at == 0, "failed").when(at == 1, "running").otherwise("succeeded").alias("status"))
    return R.source_state(_facts(t).select("source_id", F.lit("record").alias("kind"), "status").unionByName(jobs))


@query("""
SELECT user_id, event_type AS last_type, ts AS last_ts, event_id AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_state(t):
    return R.latest(t("events"), ["user_id"], ["ts", "event_id"], ["event_type", "ts", "event_id"]).select("user_id", F.col("event_type").alias("last_type"), F.col("ts").alias("last_ts"), F.col("event_id").alias("last_id"))


_ACTIONS = ["approve", "publish", "reject", "deprecate"]
_ROLES = ["owner", "reviewer", "viewer"]


@query(f"""
WITH {FACTS}, q AS (SELECT DISTINCT record_id, status, ({_ACTIONS})[(record_id % 4 + 1)::INT] AS action, ({_ROLES})[(record_id % 3 + 1)::INT] AS role, record_id % 10 IN (1, 2) AND record_id // 10 IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AS blocked FROM facts),
j AS (SELECT *, CASE WHEN role = 'viewer' OR (role = 'reviewer' AND action IN ('publish', 'deprecate')) THEN 'forbidden'
  WHEN action = 'approve' AND status NOT IN ('extracted', 'needs_review', 'approved') OR action = 'publish' AND status <> 'approved' OR action = 'reject' AND status = 'published'
    OR action = 'deprecate' AND status NOT IN ('approved', 'published') THEN 'invalid_status' WHEN action = 'publish' AND blocked THEN 'open_contradiction' END AS reason FROM q)
SELECT record_id, action, role, status, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN CASE action WHEN 'approve' THEN 'approved' WHEN 'publish' THEN 'published' WHEN 'reject' THEN 'rejected' ELSE 'deprecated' END END AS new_status FROM j""")
def transitions(t):
    facts = _facts(t).select("record_id", "status").distinct()
    asked = facts.select("record_id", _pick(_ACTIONS, F.col("record_id") % 4).alias("action"), _pick(_ROLES, F.col("record_id") % 3).alias("role"))
    base = F.col("o_orderkey") * 10
    blocked = t("orders").where("o_orderpriority = '1-URGENT'").select(F.explode(F.array(base + 1, base + 2)).alias("record_id"))
    return R.transitions(facts, asked, blocked)


@query("""
WITH j AS (SELECT sha256(concat_ws(':', user_id::VARCHAR, event_type)) AS idempotency_key, event_id AS job_id, ts AS created_at FROM events)
SELECT idempotency_key, arg_min(job_id, (created_at, job_id)) AS job_id, min(created_at) AS created_at, count(*) AS requests FROM j GROUP BY 1""")
def idempotent_jobs(t):
    from ..functions import values as V

    return R.first_jobs(t("events").select(V.idempotency_key(F.col("user_id").cast("string"), F.col("event_type")).alias("idempotency_key"), F.col("event_id").alias("job_id"), F.col("ts").alias("created_at")))


@query("""
WITH m AS (SELECT max(ts) AS m FROM events) SELECT event_id AS job_id, ts AS created_at FROM events, m WHERE event_type = 'view' AND ts < m - INTERVAL 300 MINUTE""")
def stale_jobs(t):
    jobs = t("events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "view", "queued").otherwise("running").alias("status"))
    as_of = jobs.agg(F.max("created_at").alias("as_of"))  # one row
    return R.stale_jobs(jobs.crossJoin(F.broadcast(as_of)), F.col("as_of"), 300).select("job_id", "created_at")


@query("SELECT p_partkey AS object_id, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def orphan_gc(t):
    return R.orphans(t("part").select(F.col("p_partkey").alias("object_id"), "p_name"), t("lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("object_id")))


@query("""
WITH d AS (SELECT 'PRT-' || l_partkey AS document_code, CASE WHEN l_linenumber = 7 THEN '' WHEN l_quantity > 45 THEN chr(65 + (l_linenumber % 3)::INT) ELSE (l_linenumber * 4)::VARCHAR END AS revision,
  CASE l_returnflag WHEN 'A' THEN 'vigent' WHEN 'R' THEN 'obsolete' ELSE CASE WHEN l_quantity < 20 THEN 'approved' ELSE 'draft' END END AS status, (l_suppkey % 2)::VARCHAR AS content_hash FROM lineitem),
k AS (SELECT *, CASE WHEN regexp_matches(revision, '^[0-9]+$') THEN 0 ELSE 1 END AS g, CASE WHEN regexp_matches(revision, '^[0-9]+$') THEN revision::BIGINT ELSE 0 END AS n FROM d),
r AS (SELECT document_code, revision, any_value(g) AS g, any_value(n) AS n, bool_or(revision <> '' AND status IN ('approved', 'vigent')) AS act, bool_or(revision <> '' AND status = 'obsolete') AS obs, count(DISTINCT content_hash) AS c FROM k GROUP BY 1, 2),
f AS (SELECT document_code, coalesce(string_agg(revision, ',' ORDER BY g, n, revision) FILTER (revision <> ''), '') AS revision_order,
  coalesce(arg_max(revision, (g, n, revision)) FILTER (act), arg_max(revision, (g, n, revision)) FILTER (revision <> '')) AS candidate_revision,
  bool_or(revision = '') AS unnamed, bool_or(c > 1 AND revision <> '') AS conflict, list(revision) FILTER (act) AS actives, coalesce(list(revision) FILTER (obs), []) AS obsoletes FROM r GROUP BY 1),
b AS (SELECT *, concat_ws(',', CASE WHEN unnamed THEN 'missing_revision' END, CASE WHEN conflict THEN 'duplicate_revision_conflict' END,
  CASE WHEN len(actives) > 1 AND len(list_filter(actives, lambda x: x <> candidate_revision AND NOT list_contains(obsoletes, x))) > 0 THEN 'ambiguous_vigent_revision' END) AS blocking_gaps FROM f)
SELECT document_code, revision_order, candidate_revision, blocking_gaps, CASE WHEN blocking_gaps = '' THEN candidate_revision END AS vigent_revision FROM b""")
def revision_family(t):
    line, quantity, flag = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_returnflag")
    revision = F.when(line == 7, "").when(quantity > 45, F.concat(F.lit("rev. "), _pick(["a", "b", "c"], line % 3))).otherwise(F.concat(F.lit("Rev "), (line * 4).cast("string")))
    status = F.when(flag == "A", "VIGENTE").when(flag == "R", "Obsoleto").when(quantity < 20, "approved").otherwise("rascunho")
    rows = t("lineitem").select(F.concat(F.lit("prt_"), F.col("l_partkey").cast("string")).alias("document_code"), revision.alias("revision"), status.alias("status"), (F.col("l_suppkey") % 2).cast("string").alias("content_hash"))
    return R.revision_families(R.normalized_documents(rows))


@query("""
WITH n AS (SELECT 'r' || r_regionkey AS node_id FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'n' || n_nationkey FROM nation),
e AS (SELECT 'n' || n_nationkey AS from_id, 'r' || n_regionkey AS to_id FROM nation)
SELECT * FROM e WHERE from_id NOT IN (SELECT node_id FROM n) OR to_id NOT IN (SELECT node_id FROM n)""")
def edge_integrity(t):
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = t("region").where("r_regionkey <> 2").select(node("r", "r_regionkey").alias("node_id")).union(t("nation").select(node("n", "n_nationkey")))
    return R.broken_edges(t("nation").select(node("n", "n_nationkey").alias("from_id"), node("r", "n_regionkey").alias("to_id")), nodes)


TERMS = "list_distinct(list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[a-zA-Z0-9_]+'), lambda x: length(x) >= 3 AND x NOT IN (" + ", ".join(f"'{x}'" for x in X.STOPWORDS) + ")))"
RANKED = f"""q AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark), d AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
m AS (SELECT item_id AS question_id, doc_id AS record_id, count(*) AS lexical FROM q JOIN d USING (term) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, record_id) AS rank FROM m QUALIFY rank <= 10)"""


def _ranked(t):
    found = Q.matches(t("benchmark").select(F.col("item_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("question")), t("documents").select(F.col("doc_id").alias("record_id"), F.coalesce("text", F.lit("")).alias("text")))
    return Q.top(found, 10, [F.desc("lexical"), F.asc("record_id")])


@query(f"WITH {RANKED} SELECT question_id, record_id, lexical, rank::INT AS rank FROM ranked")
def relevance_topk(t):
    return _ranked(t)


@query(f"""
WITH RECURSIVE {RANKED}, i AS (SELECT question_id, rank, record_id, greatest(1, ceil(n_chars / 4.0))::BIGINT AS tokens FROM ranked JOIN documents ON doc_id = record_id),
f AS (SELECT question_id, 0::BIGINT AS rank, 0::BIGINT AS used, false AS took FROM (SELECT DISTINCT question_id FROM i)
  UNION ALL SELECT f.question_id, i.rank, CASE WHEN used + tokens <= 4000 THEN used + tokens ELSE used END, used + tokens <= 4000 FROM f JOIN i ON i.question_id = f.question_id AND i.rank = f.rank + 1)
SELECT f.question_id, f.rank::INT AS rank, record_id, tokens, used FROM f JOIN i ON f.question_id = i.question_id AND f.rank = i.rank WHERE took""")
def budget_fit(t):
    sizes = t("documents").select(F.col("doc_id").alias("record_id"), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 4)).cast("long").alias("tokens"))
    return Q.fit_budget(_ranked(t).join(sizes, "record_id"), 4000)


@query(f"""
WITH {RANKED}, a AS (SELECT question_id, list(record_id ORDER BY rank) AS actual FROM ranked GROUP BY 1),
e AS (SELECT item_id AS question_id, coalesce(list(doc_id ORDER BY doc_id) FILTER (doc_id IS NOT NULL), []) AS expected FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
j AS (SELECT question_id, expected, coalesce(actual, []) AS actual FROM e LEFT JOIN a USING (question_id)),
s AS (SELECT question_id, len(expected) AS n_expected, CASE WHEN len(expected) = 0 THEN (CASE WHEN len(actual) = 0 THEN 1 ELSE 0 END)::DOUBLE ELSE len(list_filter(expected, lambda x: list_contains(actual[1:5], x))) / len(expected) END AS recall_at_5,
  list_min(list_filter(list_transform(range(1, len(actual) + 1), lambda i: CASE WHEN list_contains(expected, actual[i]) THEN i END), lambda x: x IS NOT NULL)) AS first_hit FROM j)
SELECT question_id, n_expected::INT AS n_expected, recall_at_5, CASE WHEN first_hit IS NOT NULL THEN 1.0::DOUBLE / first_hit WHEN n_expected = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reciprocal_rank FROM s""")
def recall_mrr(t):
    actual = _ranked(t).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "record_id"))), lambda x: x["record_id"]).alias("actual"))
    held = t("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("quote"))
    hits = Q.quoted(t("documents"), held).groupBy("question_id").agg(F.array_sort(F.collect_list("doc_id")).alias("expected"))
    empty = F.expr("array() :: array<bigint>")
    rows = held.join(hits, "question_id", "left").join(actual, "question_id", "left").select("question_id", F.coalesce("expected", empty).alias("e"), F.coalesce("actual", empty).alias("a"))
    return rows.select("question_id", F.size("e").alias("n_expected"), Q.recall_at(F.col("e"), F.col("a"), 5).alias("recall_at_5"), Q.reciprocal_rank(F.col("e"), F.col("a")).cast("double").alias("reciprocal_rank"))


_SIDES = """e AS (SELECT lang, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
p AS (SELECT lang, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE n_chars > 1000),
i AS (SELECT lang, item, max(e) AS e, max(p) AS p FROM (SELECT *, 1 AS e, 0 AS p FROM e UNION ALL SELECT *, 0, 1 FROM p) GROUP BY 1, 2)"""
_SCORES = """sum(e)::BIGINT AS expected, sum(p)::BIGINT AS predicted, sum(e * p)::BIGINT AS correct,
  CASE WHEN sum(p) = 0 THEN 0 ELSE sum(e * p) / sum(p) END::DOUBLE AS precision, CASE WHEN sum(e) = 0 THEN 0 ELSE sum(e * p) / sum(e) END::DOUBLE AS recall,
  CASE WHEN sum(e) + sum(p) = 0 THEN 0 ELSE 2 * sum(e * p) / (sum(e) + sum(p)) END::DOUBLE AS f1"""


def _sets(t):
    rows = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id").withColumnRenamed("doc_id", "item")
    return rows.where("quality = 1"), rows.where("n_chars > 1000")


@query(f"WITH {_SIDES} SELECT lang, {_SCORES} FROM i GROUP BY lang")
def set_metrics_by_lang(t):
    return Q.set_scores(*_sets(t), ["lang"])


@query(f"WITH {_SIDES} SELECT {_SCORES} FROM i")
def set_metrics(t):
    return Q.set_scores(*_sets(t), [])


_RATES = """m AS (SELECT round(count(*) FILTER (event_type = 'purchase') / count(*), 4) AS approval_rate, round(count(*) FILTER (event_type = 'click') / count(*), 4) AS edit_rate, count(*) FILTER (value < 0)::DOUBLE AS critical_errors FROM events)"""


def _pilot(t):
    from ..functions import values as V

    share = lambda kind: V.rate(F.count_if(F.col("event_type") == kind), F.count("*"))
    return t("events").agg(share("purchase").alias("approval_rate"), share("click").alias("edit_rate"), F.count_if(F.col("value") < 0).cast("double").alias("critical_errors"))


@query(f"WITH {_RATES} SELECT * FROM m")
def pilot_metrics(t):
    return _pilot(t)


@query(f"""WITH {_RATES} SELECT 'approval_rate' AS gate, approval_rate AS value, 0.8::DOUBLE AS bound, approval_rate >= 0.8 AS passed FROM m
UNION ALL SELECT 'edit_rate', edit_rate, 0.2, edit_rate <= 0.2 FROM m UNION ALL SELECT 'critical_errors', critical_errors, 0, critical_errors <= 0 FROM m""")
def gates(t):
    return Q.gates(_pilot(t), {"approval_rate": 0.8}, {"edit_rate": 0.2, "critical_errors": 0})


@query("""
WITH c AS (SELECT 'higher.' || event_type AS path, count(*) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT 'lower.' || event_type, count(*) FROM events WHERE user_id % 2 = 0 GROUP BY 1),
b AS (SELECT 'higher.' || event_type AS path, count(*) AS v FROM events WHERE user_id % 2 = 1 AND event_type <> 'view' GROUP BY 1 UNION ALL SELECT 'lower.' || event_type, count(*) FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT coalesce(c.path, b.path) AS path, c.v AS current, b.v AS baseline, CASE WHEN c.v IS NULL THEN 'regression' WHEN b.v IS NULL OR c.v = b.v THEN 'neutral'
  WHEN (c.v > b.v) = starts_with(coalesce(c.path, b.path), 'higher') THEN 'improvement' ELSE 'regression' END AS change FROM c FULL JOIN b ON c.path = b.path""")
def ratchet_compare(t):
    def signals(rows, left_out=None):
        counted = rows.groupBy("event_type").agg(F.count("*").alias("value"))
        kept = counted if left_out is None else counted.where(F.col("event_type") != left_out)
        up = kept.select(F.concat(F.lit("higher."), F.col("event_type")).alias("path"), "value")
        return up.union(counted.select(F.concat(F.lit("lower."), F.col("event_type")).alias("path"), "value"))

    events = t("events")
    return Q.compare(signals(events.where("user_id % 2 = 0")), signals(events.where("user_id % 2 = 1"), "view"), ["higher."], ["lower."])


@query(r"""
WITH r AS (SELECT doc_id, substr(text, 11, 40) AS quote, text AS chunk, CASE WHEN doc_id % 3 = 0 THEN 10 WHEN doc_id % 3 = 1 THEN 11 END AS s FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, trim(regexp_replace(quote, '\s+', ' ', 'g')) AS q, trim(regexp_replace(chunk, '\s+', ' ', 'g')) AS c, CASE WHEN s IS NOT NULL THEN s + 40 END AS e FROM r),
j AS (SELECT *, CASE WHEN q = '' THEN 'empty evidence quote' WHEN s IS NOT NULL AND (s > length(chunk) OR e > length(chunk)) THEN 'offsets out of range'
  WHEN s IS NOT NULL AND trim(regexp_replace(substr(chunk, s + 1, 40), '\s+', ' ', 'g')) <> q THEN 'slice does not match' WHEN s IS NULL AND NOT contains(c, q) THEN 'quote not found' END AS reason,
  len(c) - len(replace(c, q, '')) AS gone FROM n)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'passed' ELSE 'failed' END AS status, reason, CASE WHEN reason IS NULL THEN CASE WHEN s IS NOT NULL AND substr(chunk, s + 1, 40) = quote THEN 'exact' ELSE 'normalized' END END AS match_mode FROM j""")
def ground_check(t):
    start = F.when(F.col("doc_id") % 3 == 0, 10).when(F.col("doc_id") % 3 == 1, 11)
    rows = t("documents").where("text IS NOT NULL").select("doc_id", F.substring("text", 11, 40).alias("quote"), F.col("text").alias("chunk"), start.alias("char_start"), (start + 40).alias("char_end"))
    return G.verify_quote(rows).select("doc_id", "status", "reason", "match_mode")


_KINDS = ["service_price", "Procedure ", "discount_rule", "weather", "unknown"]


@query(f"""
WITH l AS (SELECT event_id, ({_KINDS})[(event_id % 5 + 1)::INT] AS classification, (event_id % 100) / 100 AS confidence FROM events),
k AS (SELECT *, CASE lower(trim(classification)) WHEN 'procedure' THEN 'industrial_requirement' ELSE lower(trim(classification)) END AS kind FROM l),
d AS (SELECT *, kind NOT IN ('weather', 'unknown') AS known, kind NOT IN ('weather', 'unknown') AND confidence >= 0.75 AS passes FROM k)
SELECT event_id AS chunk_id, CASE WHEN kind = 'weather' THEN classification ELSE kind END AS fact_type, confidence::DOUBLE AS confidence, CASE WHEN kind = 'weather' THEN 'unsupported_classification: r' ELSE 'r' END AS reason,
  CASE WHEN NOT passes THEN 'unknown_facts_queue' WHEN kind = 'discount_rule' THEN 'business_rules' ELSE 'extracted_facts' END AS destination, passes FROM d WHERE NOT known OR confidence >= 0.3""")
def classification_routes(t):
    labels = t("events").select(F.col("event_id").alias("chunk_id"), _pick(_KINDS, F.col("event_id") % 5).alias("classification"), ((F.col("event_id") % 100) / 100).alias("confidence"), F.lit("r").alias("reason"))
    return G.decisions(labels)


@query()
def bundle_json(t):
    """One nested document with its hash: regions as sources, nations as facts, suppliers as evidence."""
    from .bundle import bundle

    sources = t("region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"))
    facts = t("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("content"), F.col("n_regionkey").cast("string").alias("source_id"))
    evidence = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("quote"), F.col("s_nationkey").cast("string").alias("fact_id"))
    return bundle({"sources": sources, "facts": facts, "evidence": evidence}, blockers=[], warnings=["no_tests"])


@query("SELECT count(*) AS documents, count(*) FILTER (n_chars < 100) AS too_short, sum(n_chars)::BIGINT AS chars FROM documents")
def corpus_summary(t):
    return t("documents").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") < 100).alias("too_short"), F.sum("n_chars").alias("chars"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, ts, n, ts AS opened, 1 AS used FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_id, o.ts, o.n, CASE WHEN o.ts - r.opened >= INTERVAL 3600 SECOND THEN o.ts ELSE r.opened END, CASE WHEN o.ts - r.opened >= INTERVAL 3600 SECOND THEN 1 ELSE r.used + 1 END
  FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, ts, used <= 5 AS allowed FROM r""")
def rate_limit(t):
    from ..streaming.jobs import rate_limited

    return rate_limited(t("events").select("user_id", "event_id", "ts"), limit=5, seconds=3600)


@query("""
WITH r AS (SELECT 'f' || (c_nationkey % 3) || '.csv' AS filename, (c_nationkey // 6)::VARCHAR AS sheet, c_custkey AS k, '| ' || c_name || ' | ' || c_mktsegment || ' |' AS l,
  row_number() OVER (PARTITION BY c_nationkey % 3, c_nationkey // 6 ORDER BY c_custkey) - 1 AS p FROM customer)
SELECT filename, sheet, min(k) AS row_start, max(k) AS row_end, 'Tabela: ' || sheet || chr(10) || '| name | segment |' || chr(10) || string_agg(l, chr(10) ORDER BY k) AS text FROM r GROUP BY filename, sheet, p // 15""")
def sheet_blocks(t):
    nation = F.col("c_nationkey")
    names = F.concat(F.lit("f"), (nation % 3).cast("string"), F.lit(".csv")).alias("filename"), F.floor(nation / 6).cast("string").alias("sheet")
    rows = t("customer").select(*names, F.col("c_custkey").alias("row_index"), F.array(F.lit("name"), F.lit("segment")).alias("headers"), F.array("c_name", "c_mktsegment").alias("cells"))
    return D.sheet_blocks(rows)


_TYPES = ["catalog", "risk_matrix", "price_catalog", "notes"]


def _uuid_sql(text):
    from ..functions.values import NAMESPACE

    d = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({text}))"
    return f"{d}[1:8] || '-' || {d}[9:12] || '-5' || {d}[14:16] || '-' || (['8', '9', 'a', 'b'])[(instr('0123456789abcdef', {d}[17]) - 1) % 4 + 1] || {d}[18:20] || '-' || {d}[21:32]"


@query(f"""
WITH r AS (SELECT 'f' || c_nationkey || '.csv' AS filename, c_custkey AS row_number, ({_TYPES})[c_nationkey % 4 + 1] AS document_type, c_name || ' | ' || c_mktsegment AS quote FROM customer),
k AS (SELECT *, CASE WHEN document_type = 'risk_matrix' THEN 'rule' ELSE 'fact' END AS record FROM r WHERE document_type <> 'notes')
SELECT {_uuid_sql("record || ':' || filename || ':row:' || row_number")} AS id, {_uuid_sql("'evidence:' || filename || ':row:' || row_number")} AS evidence_id, record, document_type = 'price_catalog' AS is_synthetic,
  CASE WHEN record = 'rule' THEN row_number END AS priority, quote FROM k""")
def pack_records(t):
    from ..operators import packs as P

    rows = t("customer").select(
        F.concat(F.lit("f"), F.col("c_nationkey").cast("string"), F.lit(".csv")).alias("filename"), F.col("c_custkey").alias("row_number"), _pick(_TYPES, F.col("c_nationkey") % 4).alias("document_type"), F.array("c_name", F.lit(""), "c_mktsegment").alias("cells")
    )
    return P.records_of_rows(rows).select("id", "evidence_id", "record", "is_synthetic", "priority", "quote")


@query("""
WITH l AS (SELECT p_partkey AS k FROM part WHERE p_size > 10), p AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 5)
SELECT 'p' || k AS filename, 'missing' AS problem FROM l WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT 'p' || k, 'unlisted' FROM p WHERE k NOT IN (SELECT k FROM l)""")
def pack_preflight(t):
    from ..operators import packs as P

    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("filename")
    return P.preflight(t("part").where("p_size > 10").select(name("p_partkey")), t("lineitem").where("l_quantity < 5").select(name("l_partkey")).distinct())
