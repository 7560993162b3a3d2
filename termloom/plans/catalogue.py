"""Queries that show each operator on the common tables, and the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.functions import text as X
from termloom.operators import geometry as G
from termloom.operators import layout as L
from termloom.operators import sequence as S
from termloom.operators import store as R
from termloom.operators import vision as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader (name to DataFrame) under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


c = F.col
desc = F.desc


def _seconds(ts):
    return F.unix_micros(ts.cast("timestamp")) / 1000000.0


@query("SELECT doc_id, source, lang FROM documents WHERE lower(text) LIKE '%the%a%' OR lower(source) LIKE '%the%a%'")
def q_search_terms(t):
    return R.search(t("documents"), "The%A", ["text", "source"], [desc("doc_id")]).select("doc_id", "source", "lang")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def q_recent_topk(t):
    return R.recent(t("orders"), 20, desc("o_orderdate"), desc("o_orderkey")).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT event_id, ts, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def q_added_after(t):
    return R.added_after(t("events"), "ts", "2024-01-20 00:00:00", desc("ts")).select("event_id", "ts", "event_type")


@query("SELECT event_id, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) WHERE event_type = 'purchase'")
def q_topk_then_filter(t):
    return R.recent(t("events"), 1000, desc("ts"), desc("event_id")).where("event_type = 'purchase'").select("event_id", "ts")


@query("""WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)
SELECT event_id, event_type, coalesce(event_type <> lag(event_type) OVER (ORDER BY ts DESC, event_id DESC), true) AS head FROM n""")
def q_export_breaks(t):
    w = W.orderBy(desc("ts"), desc("event_id"))  # 200 rows
    return R.recent(t("events"), 200, desc("ts"), desc("event_id")).select("event_id", "event_type", S.breaks(c("event_type"), w).alias("head"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '✅' WHEN 'O' THEN '🔍' WHEN 'P' THEN '📝' ELSE '❓' END AS icon,
  o_orderstatus || ' → ' || o_orderpriority || chr(10) || CASE WHEN o_totalprice > 100000 THEN '  👤 ' || o_orderpriority || chr(10) ELSE '' END AS line, count(*) OVER () AS total FROM orders""")
def q_export_lines(t):
    status = F.when(c("o_orderstatus") == "F", "verified").when(c("o_orderstatus") == "O", "reviewed").when(c("o_orderstatus") == "P", "draft").otherwise("other")
    who = F.when(c("o_totalprice") > 100000, c("o_orderpriority")).otherwise(" ")
    line = F.concat(X.language_pair(c("o_orderstatus"), c("o_orderpriority")), F.lit("\n"), X.optional_line("  👤 ", who))
    total = t("orders").agg(F.count(F.lit(1)).alias("total"))  # one row
    return t("orders").select("o_orderkey", X.status_icon(status).alias("icon"), line.alias("line")).crossJoin(F.broadcast(total))


@query("SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 'approved' ELSE p_brand END AS p_brand FROM part")
def q_update_status(t):
    return R.update(t("part"), c("p_partkey") == 7, {"p_brand": F.lit("approved")}).select("p_partkey", "p_brand")


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'new' ELSE s_name END AS s_name, CASE WHEN s_suppkey = 3 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def q_update_row(t):
    return R.update(t("supplier"), c("s_suppkey") == 3, {"s_name": F.lit("new"), "s_acctbal": F.lit(None).cast("double")}).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def q_delete(t):
    return R.delete(t("part"), t("lineitem").where("l_quantity > 49").select(c("l_partkey").alias("p_partkey")), "p_partkey").select("p_partkey", "p_name")


@query("SELECT count(*) AS n, count(DISTINCT s_suppkey) AS ids, min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_nationkey) FROM nation)")
def q_insert_ids(t):
    new = t("nation").select(c("n_name").alias("s_name"), c("n_nationkey").alias("s_nationkey"), F.lit(0.0).alias("s_acctbal"))
    merged, _ = R.insert(t("supplier"), new, ["s_name"], "s_suppkey")
    return merged.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s_suppkey").alias("ids"), F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi"))


@query("SELECT p_partkey, p_name, p_type FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_type = a.p_type AND b.p_size = a.p_size AND b.p_partkey < a.p_partkey AND contains(lower(b.p_name), lower(a.p_name)))")
def q_dedup_anti(t):
    parts = t("part").withColumn("k", F.struct("p_type", "p_size"))
    return R.drop_contained(parts, "k", "p_name", "p_partkey").select("p_partkey", "p_name", "p_type")


@query("SELECT l_orderkey, CAST(floor(l_quantity / 30) * 30 AS BIGINT) AS line, string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_linenumber) AS text FROM lineitem GROUP BY 1, 2")
def q_line_bucket(t):
    return L.ordered_text(t("lineitem").withColumn("line", L.bucket(c("l_quantity"), 30)), ["l_orderkey", "line"], ["l_linenumber"], "l_linenumber", " ")


_SESSIONS = """WITH e AS (SELECT *, epoch_us(ts) / 1000000.0 AS s FROM events), f AS (
  SELECT *, CASE WHEN event_type = 'signup' OR coalesce(s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600, false) THEN 1 ELSE 0 END AS b FROM e),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)"""


def _sessions(t):
    return L.sessions(t("events"), ["user_id"], ["ts", "event_id"], _seconds(c("ts")), 3600, c("event_type") == "signup")


@query(_SESSIONS + " SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY 1, 2")
def q_gap_sessions(t):
    return _sessions(t).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(_SESSIONS + " SELECT user_id, CAST(session AS BIGINT) AS session, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS last_type FROM g GROUP BY 1, 2")
def q_subject_last(t):
    return _sessions(t).groupBy("user_id", "session").agg(F.max_by("event_type", F.when(c("event_type") != "view", c("event_id"))).alias("last_type"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'english' WHEN p_size < 20 THEN 'subject' WHEN p_size < 35 THEN 'term' WHEN p_size < 40 THEN NULL ELSE 'definition' END AS band FROM part")
def q_band_columns(t):
    return t("part").select("p_partkey", L.band(c("p_size"), [(10, "english"), (20, "subject"), (35, "term"), (40, None)], "definition").alias("band"))


@query("""WITH m AS (SELECT CAST(p_size AS DOUBLE) * 40 + 900 AS at, max(p_partkey) AS mark FROM part GROUP BY 1)
SELECT p_partkey, m.mark FROM part ASOF LEFT JOIN m ON part.p_retailprice >= m.at""")
def q_asof_boundary(t):
    marks = t("part").groupBy((c("p_size").cast("double") * 40 + 900).alias("at")).agg(F.max("p_partkey").alias("mark")).withColumn("k", c("at") * 0)
    return G.as_of(t("part").withColumn("k", F.lit(0.0)), marks, ["k"], "p_retailprice", "at", "mark").select("p_partkey", "mark")


@query("""WITH RECURSIVE v AS (SELECT DISTINCT p_size AS x FROM part), r(x) AS (
  SELECT min(x) FROM v UNION ALL SELECT (SELECT min(v.x) FROM v WHERE v.x - r.x > 5) FROM r WHERE EXISTS (SELECT 1 FROM v WHERE v.x - r.x > 5))
SELECT x AS leader FROM r""")
def q_leader_clusters(t):
    values = t("part").agg(F.sort_array(F.collect_set("p_size")).alias("v"))  # as many as there are sizes
    return values.select(F.explode(L.leaders(c("v"), 5)).alias("leader"))


#: white places of all lines
_WHITE = "h AS (SELECT CAST(i - 1 AS INTEGER) AS position, count(*) AS n FROM (SELECT unnest(list_filter(range(1, len(c) + 1), lambda j: regexp_matches(c[j], '[ \\t\\f\\r\\x0B]'))) AS i FROM (SELECT string_split(unnest(string_split(text, chr(10))), '') AS c FROM documents)) GROUP BY 1)"


@query(f"WITH {_WHITE} SELECT position, n FROM h")
def q_whitespace_histogram(t):
    return L.white_columns(t("documents"), "text")


@query("""WITH RECURSIVE v AS (SELECT DISTINCT p_type, p_size AS x FROM part), r(p_type, x) AS (
  SELECT p_type, min(x) FROM v GROUP BY 1 UNION ALL
  SELECT r.p_type, (SELECT min(v.x) FROM v WHERE v.p_type = r.p_type AND v.x - r.x > 3) FROM r WHERE EXISTS (SELECT 1 FROM v WHERE v.p_type = r.p_type AND v.x - r.x > 3))
SELECT p_type, x AS row_start FROM r""")
def q_row_tolerance(t):
    values = t("part").groupBy("p_type").agg(F.sort_array(F.collect_set("p_size")).alias("v"))  # as many as there are sizes
    return values.select("p_type", F.explode(L.leaders(c("v"), 3)).alias("row_start"))


@query(f"""WITH {_WHITE}, b AS (SELECT position AS p, position - row_number() OVER (ORDER BY position) AS g FROM h WHERE n * 100 >= 75 * (SELECT max(n) FROM h))
SELECT CAST(min(p) AS INTEGER) AS first, count(*) AS width FROM b GROUP BY g HAVING count(*) >= 2""")
def q_column_islands(t):
    counts = L.white_columns(t("documents"), "text")  # as many rows as the longest line has places
    frequent = counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).where("n * 100 >= 75 * most")
    runs = frequent.withColumn("g", c("position") - F.row_number().over(W.orderBy("position")))
    return runs.groupBy("g").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("width")).where("width >= 2").select("first", "width")


@query("""WITH e AS (SELECT *, epoch_us(ts) / 1000000.0 - lag(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT event_id, CASE WHEN gap > 7200 THEN 4 WHEN gap > 3600 THEN 2 WHEN gap > 600 THEN 1 ELSE 0 END AS spaces FROM e""")
def q_gap_spaces(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = _seconds(c("ts")) - F.lag(_seconds(c("ts"))).over(w)
    return t("events").select("event_id", F.when(gap > 7200, 4).when(gap > 3600, 2).when(gap > 600, 1).otherwise(0).alias("spaces"))


@query("""WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts > INTERVAL 2 HOUR AS far FROM events)
SELECT user_id, ts, event_type AS ch FROM e UNION ALL SELECT user_id, ts, ' ' FROM e WHERE far""")
def q_space_rows(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    far = _seconds(F.lead("ts").over(w)) - _seconds(c("ts")) > 7200
    return t("events").withColumn("far", far).select("user_id", "ts", F.explode(F.when(c("far"), F.array(c("event_type"), F.lit(" "))).otherwise(F.array("event_type"))).alias("ch"))


@query("SELECT l_orderkey, min(l_linenumber) AS x, min(l_quantity) AS y, max(l_linenumber + 2) - min(l_linenumber) AS w, max(l_quantity + 3) - min(l_quantity) AS h FROM lineitem GROUP BY 1")
def q_bbox_union(t):
    return G.bounding(t("lineitem").select("l_orderkey", c("l_linenumber").alias("x"), c("l_quantity").alias("y"), F.lit(2).alias("w"), F.lit(3.0).alias("h")), ["l_orderkey"])


def _order_spans(t):
    return t("orders").select(c("o_custkey").alias("k"), c("o_orderkey").alias("id"), (F.floor("o_totalprice") - F.floor("o_totalprice") % 100).cast("long").alias("lo"), (F.floor("o_totalprice") - F.floor("o_totalprice") % 100 + c("o_orderkey") % 5000).cast("long").alias("hi"))


_ORDER_SPANS = "WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) - CAST(floor(o_totalprice) AS BIGINT) % 100 AS lo, CAST(floor(o_totalprice) AS BIGINT) - CAST(floor(o_totalprice) AS BIGINT) % 100 + o_orderkey % 5000 AS hi FROM orders)"


@query(_ORDER_SPANS + " SELECT a.k, a.id AS outer_id, b.id AS inner_id FROM s a JOIN s b ON a.k = b.k AND a.id <> b.id AND a.lo <= b.lo AND b.hi <= a.hi")
def q_containment(t):
    s = _order_spans(t)
    return G.contained(s, s, "k", "lo", "hi", "id").drop("size")


@query(_ORDER_SPANS + ", p AS (SELECT a.k, a.id AS o, b.id AS i, row_number() OVER (PARTITION BY a.k, b.id ORDER BY a.hi - a.lo, a.id) AS r FROM s a JOIN s b ON a.k = b.k AND a.id <> b.id AND a.lo <= b.lo AND b.hi <= a.hi) SELECT k, i AS inner_id, o AS outer_id FROM p WHERE r = 1")
def q_innermost(t):
    s = _order_spans(t)
    return G.innermost(G.contained(s, s, "k", "lo", "hi", "id"), "k")


@query(_ORDER_SPANS + " SELECT a.k, a.id AS a, b.id AS b FROM s a JOIN s b ON a.k = b.k AND a.id < b.id AND a.hi > a.lo AND b.hi > b.lo AND greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) * 100 >= 77 * least(a.hi - a.lo, b.hi - b.lo)")
def q_overlap_join(t):
    a = _order_spans(t).where("hi > lo").toDF("k", "a", "l1", "h1")
    b = _order_spans(t).where("hi > lo").toDF("k", "b", "l2", "h2")
    common = F.greatest(F.lit(0), F.least("h1", "h2") - F.greatest("l1", "l2"))
    return a.join(b, "k").where((c("a") < c("b")) & (common * 100 >= 77 * F.least(c("h1") - c("l1"), c("h2") - c("l2")))).select("k", "a", "b")


@query(_ORDER_SPANS + """, f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM s),
g AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS p FROM f)
SELECT k, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY k, p""")
def q_interval_merge(t):
    return G.merge_overlaps(_order_spans(t), "k", "lo", "hi").drop("part")


@query("""WITH n AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 2) AS m FROM supplier GROUP BY 1)
SELECT s_suppkey, (SELECT min(k) FROM n WHERE abs(n.m - s_acctbal) = (SELECT min(abs(n2.m - s_acctbal)) FROM n n2)) AS k FROM supplier""")
def q_nearest_line(t):
    lines = t("supplier").groupBy(c("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 2).alias("m"))
    at = F.collect_list(F.struct("m", "k"))
    every = lines.agg(at.alias("lines"))  # at most 25 nations
    best = F.array_min(F.transform("lines", lambda x: F.struct(F.abs(x["m"] - c("s_acctbal")).alias("d"), x["k"].alias("k"))))
    return t("supplier").crossJoin(F.broadcast(every)).select("s_suppkey", best["k"].alias("k"))


_DAYS = "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)"


def _days(t):
    return t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))  # a row a day


def _by_day():
    return W.orderBy("day")


@query(_DAYS + " SELECT day FROM (SELECT day, n < 320 AND lag(n) OVER (ORDER BY day) >= 320 AS x FROM d) WHERE x")
def q_threshold_cross(t):
    return _days(t).withColumn("x", S.crossings(c("n"), 320, _by_day())).where("x").select("day")


@query(_DAYS + " SELECT day, n FROM (SELECT day, n, n < lag(n) OVER (ORDER BY day) AND n < lead(n) OVER (ORDER BY day) AS x FROM d) WHERE x")
def q_local_minima(t):
    return _days(t).withColumn("x", S.local_minima(c("n"), _by_day())).where("x").select("day", "n")


@query(_DAYS + " SELECT CAST(dayofmonth(day) // 7 AS INTEGER) AS week, arg_min(day, n * 100 + dayofmonth(day)) AS day FROM d GROUP BY 1")
def q_segment_argmin(t):
    return _days(t).groupBy(F.floor(F.dayofmonth("day") / 7).cast("int").alias("week")).agg(F.min_by("day", c("n") * 100 + F.dayofmonth("day")).alias("day"))


@query("SELECT event_id, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 4 FOLLOWING)")
def q_neighbourhood(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-6, 4)
    return t("events").select("event_id", F.min("value").over(w).alias("lo"), F.max("value").over(w).alias("hi"))


@query("SELECT n_nationkey, CAST(sum(n) OVER (PARTITION BY n_regionkey) - n AS BIGINT) AS others FROM (SELECT n_nationkey, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def q_leave_one_out(t):
    n = t("nation").join(t("customer"), c("c_nationkey") == c("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(F.count("c_custkey").alias("n"))
    return n.select("n_nationkey", (F.sum("n").over(W.partitionBy("n_regionkey")) - c("n")).alias("others"))


@query("SELECT o_orderkey, o_orderpriority FROM orders o JOIN (SELECT o_orderpriority AS p, median(o_totalprice) AS m FROM orders GROUP BY 1) ON p = o_orderpriority WHERE o_totalprice > 2 * m")
def q_median_filter(t):
    m = t("orders").groupBy(c("o_orderpriority").alias("p")).agg(F.median("o_totalprice").alias("m"))
    return t("orders").join(m, c("p") == c("o_orderpriority")).where("o_totalprice > 2 * m").select("o_orderkey", "o_orderpriority")


@query("SELECT l_returnflag, q AS majority FROM (SELECT l_returnflag, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def q_mode(t):
    return S.majority(t("lineitem"), ["l_returnflag"], "l_quantity")


_WORDS = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)"


def _words(t, name="documents"):
    return t(name).select(*(["doc_id"] if name == "documents" else []), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))


@query(_WORDS + " SELECT word, count(*) AS n FROM w GROUP BY 1")
def q_tokenize(t):
    return _words(t).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT unnest(regexp_extract_all(lower(text), '[bcdfghjklmnpqrstvwxz]+[aeiouy]*')) AS stack, count(*) AS n FROM documents GROUP BY 1")
def q_stack_tokens(t):
    return t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([bcdfghjklmnpqrstvwxz]+[aeiouy]*)"), F.lit(1))).alias("stack")).groupBy("stack").agg(F.count(F.lit(1)).alias("n"))


@query(_WORDS + " SELECT doc_id, count(v.word) AS found, count(*) AS n FROM w LEFT JOIN v ON w.word = v.word GROUP BY 1")
def q_dict_score(t):
    known = _words(t, "benchmark").distinct().withColumn("hit", F.lit(1))
    return _words(t).join(known, "word", "left").groupBy("doc_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("n"))


@query(_WORDS + " SELECT doc_id, count(*) FILTER (v.word IS NULL AND length(w.word) > 8) AS bad, count(*) AS n FROM w LEFT JOIN v ON w.word = v.word GROUP BY 1")
def q_target_score(t):
    known = _words(t, "benchmark").distinct().withColumn("hit", F.lit(1))
    return _words(t).join(known, "word", "left").groupBy("doc_id").agg(F.count_if(c("hit").isNull() & (F.length("word") > 8)).alias("bad"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, (length(text) - length(replace(text, ', ', ''))) // 2 AS marks, length(text) AS n FROM documents")
def q_punc_ratio(t):
    return t("documents").select("doc_id", ((F.length("text") - F.length(F.replace(c("text"), F.lit(", "), F.lit("")))) / 2).cast("long").alias("marks"), F.length("text").cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN length(s) > 30 THEN left(s, 25) || '...' ELSE s || '།' END AS term FROM (SELECT p_partkey, replace(p_name || p_type || p_brand, ' ', '') AS s FROM part)")
def q_truncate_term(t):
    return t("part").select("p_partkey", X.cut_term(F.concat("p_name", "p_type", "p_brand")).alias("term"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'econ' WHEN 1 THEN 'bio' WHEN 2 THEN 'com' ELSE '' END AS code FROM nation")
def q_norm_subject(t):
    raw = F.element_at(F.array(F.lit("com, Econ"), F.lit(" Bio. "), F.lit("com, zzz"), F.lit("unknown")), (c("n_nationkey") % 4 + 1).cast("int"))
    return t("nation").select("n_nationkey", X.subject_code(raw).alias("code"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+) ([a-z]+)', 1)) AS head FROM documents")
def q_regex_terms(t):
    return t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+) ([a-z]+)"), F.lit(1))).alias("head"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '^([a-z]+) \\|', 1), ''), nullif(regexp_extract(text, '^([A-Z][a-z]+)\\.', 1), ''), text) AS term FROM documents")
def q_split_cascade(t):
    first = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return t("documents").select("doc_id", F.coalesce(first(r"^([a-z]+) \|"), first(r"^([A-Z][a-z]+)\."), "text").alias("term"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS b FROM conversations)
SELECT conv_id, CAST(p AS BIGINT) AS page, count(*) AS n FROM (SELECT conv_id, sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT DISTINCT * FROM l)) GROUP BY 1, 2""")
def q_page_split(t):
    d = t("conversations").select("conv_id", "turn", (c("role") == "user").cast("int").alias("b")).distinct()
    return S.islands(d, ["conv_id"], ["turn"], c("b") == 1, "page").groupBy("conv_id", "page").agg(F.count(F.lit(1)).alias("n"))


_TURNS = "WITH b AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), n AS (SELECT a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY 1, 2)"


def _turns(t):
    w = S.bigrams(t("events").withColumn("at", F.struct("ts", "event_id")), ["user_id"], "at", "event_type")
    return w.groupBy(c("event_type").alias("a"), c("next").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query(_TURNS + " SELECT * FROM n")
def q_bigrams(t):
    return _turns(t)


@query(_TURNS + " SELECT a, b, round(ln(greatest(0.00001, n / CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE))), 6) AS lp FROM n")
def q_bigram_logprob(t):
    share = c("n") / F.sum("n").over(W.partitionBy("a"))
    return _turns(t).select("a", "b", F.round(F.log(F.greatest(F.lit(0.00001), share)), 6).alias("lp"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 2) AS k, coalesce(json_extract_string(props, '$.mode'), 'line_cut') AS mode FROM events")
def q_config_merge(t):
    p = F.from_json("props", "k bigint, mode string")
    return t("events").select("event_id", F.coalesce(p["k"], F.lit(2)).alias("k"), F.coalesce(p["mode"], F.lit("line_cut")).alias("mode"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT a, b, c2 AS c, d, e, f FROM range(4) r1(a), range(2) r2(b), range(3) r3(c2), range(2) r4(d), range(2) r5(e), range(2) r6(f)")
def q_param_grid(t):
    one = t("region").limit(1)
    for name, n in zip("abcdef", (4, 2, 3, 2, 2, 2)):
        one = one.withColumn(name, F.explode(F.array(*[F.lit(i).cast("long") for i in range(n)])))
    return one.select(*"abcdef")


@query("SELECT r_regionkey AS k FROM region UNION SELECT n_regionkey FROM nation")
def q_union_distinct(t):
    return t("region").select(c("r_regionkey").alias("k")).unionByName(t("nation").select(c("n_regionkey").alias("k"))).distinct()


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) AS best, list_position(embedding, list_sort(embedding, 'DESC')[3]) AS third FROM embeddings")
def q_label_decode_topk(t):
    top = F.sort_array("embedding", False)
    return t("embeddings").select("vec_id", F.array_position("embedding", F.array_max("embedding")).cast("int").alias("best"), F.array_position("embedding", F.element_at(top, 3)).cast("int").alias("third"))


@query("SELECT o_orderkey, round((o_totalprice - m) / s, 4) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def q_zscale(t):
    m = t("orders").agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))  # one row
    return t("orders").crossJoin(F.broadcast(m)).select("o_orderkey", F.round((c("o_totalprice") - c("m")) / c("s"), 4).alias("z"))


@query("SELECT p_partkey, round(-0.5 * ln(2 * pi() * 225) - (p_size - 25) * (p_size - 25) / 450.0, 6) AS lp FROM part")
def q_gauss_logprob(t):
    return t("part").select("p_partkey", F.round(-0.5 * F.log(2 * F.pi() * 225) - (c("p_size") - 25) * (c("p_size") - 25) / 450.0, 6).alias("lp"))


@query("SELECT source, count(*) AS n, count(*) FILTER ((n_chars > 100) = (quality = 1)) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def q_accuracy(t):
    return t("labels").join(t("documents"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if((c("n_chars") > 100) == (c("quality") == 1)).alias("hits"))


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2)
SELECT event_id, n.event_type AS smooth FROM events JOIN n USING (user_id) WHERE r = 1""")
def q_majority_smooth(t):
    return t("events").join(S.majority(t("events"), ["user_id"], "event_type", "smooth"), "user_id").select("event_id", "smooth")


@query("SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS kept FROM events")
def q_carry_forward(t):
    return t("events").select("event_id", S.carry_forward(F.when(c("event_type") != "view", c("event_type")), W.partitionBy("user_id").orderBy("ts", "event_id")).alias("kept"))


@query()
def q_viterbi(t):
    kinds = t("events").select("event_type").where("event_type IS NOT NULL").distinct().orderBy("event_type")
    number = {r[0]: i for i, r in enumerate(kinds.collect())}  # a row for each type
    state = F.element_at(F.create_map(*[x for k, v in number.items() for x in (F.lit(k), F.lit(v))]), c("event_type"))
    e = t("events").select(c("user_id").alias("seq"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("t"), state.alias("state"), F.lit(0.6).alias("p"))
    n = len(number)
    return S.viterbi(e, {i: 1 / n for i in range(n)}, {(i, j): 0.6 if i == j else 0.4 / (n - 1) for i in range(n) for j in range(n)})


@query()
def q_gmm_widths(t):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        w, m, s = V.mixture(g["l_quantity"].to_numpy(), g["count"].to_numpy())
        return pd.DataFrame({"l_returnflag": g["l_returnflag"].iloc[0], "part": range(2), "weight": w, "mean": m, "dev": s})

    counted = t("lineitem").groupBy("l_returnflag", "l_quantity").count()  # a row for each quantity
    return counted.groupBy("l_returnflag").applyInPandas(run, "l_returnflag string, part int, weight double, mean double, dev double")


@query()
def q_kmeans_lines(t):
    sizes = t("part").groupBy("p_type", "p_size").count()  # a row for each size
    return sizes.groupBy("p_type").applyInPandas(lambda g: pd.DataFrame({"p_type": g["p_type"].iloc[0], "centre": V.kmeans_1d(g["p_size"].to_numpy(float), 3)}), "p_type string, centre double")


def _pictured(f):
    """``f`` of a vector as a square picture; null for one that isn't."""

    def run(e):
        side = math.isqrt(len(e)) if e is not None else 0
        return f(np.asarray(e, float).reshape(side, side)) if side and side * side == len(e) else None

    return run


@query()
def q_features(t):
    @F.pandas_udf("array<double>")
    def features(v: pd.Series) -> pd.Series:
        return v.map(_pictured(lambda e: V.feature_vector(e).tolist()))

    return t("embeddings").select("vec_id", features("embedding").alias("features"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, 'e') AS a FROM part)
SELECT p_partkey, array_to_string(list_transform(range(len(a)), lambda i: a[i + 1] || CASE WHEN i < len(a) - 1 AND (m.bits >> i) & 1 = 1 THEN 'e' ELSE '' END), '') AS form
FROM p, range(256) m(bits) WHERE m.bits < 1 << (len(a) - 1)""")
def q_mark_choices(t):
    return t("part").select("p_partkey", F.explode(S.mark_choices(c("p_name"), "e")).alias("form"))


@query()
def q_components(t):
    @F.pandas_udf("array<struct<x:long,y:long,w:long,h:long,pixels:long>>")
    def boxes(v: pd.Series) -> pd.Series:
        return v.map(_pictured(lambda e: [dict(zip(("x", "y", "w", "h", "pixels"), map(int, b))) for b in V.components(e > 0)[1]]))

    return t("embeddings").select("vec_id", F.explode(boxes("embedding")).alias("box")).select("vec_id", "box.*")


@query()
def q_zernike(t):
    @F.pandas_udf("array<double>")
    def moments(v: pd.Series) -> pd.Series:
        return v.map(_pictured(lambda e: V.zernike(e).tolist()))

    return t("embeddings").select("vec_id", moments("embedding").alias("moments"))
