"""Queries of the export, of recognised characters and of further text functions, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.functions import parse as P
from termloom.functions import spelling as S
from termloom.functions import text as X
from termloom.operators import geometry as G
from termloom.operators import layout as L
from termloom.operators import recognition as R
from termloom.operators import sequence as Q
from termloom.operators import store as T
from termloom.plans import export as E
from termloom.plans.catalogue import query
from termloom.plans.parse_queries import _SQL_LINES, _SQL_PAGES, _TEXT_LINES, _lines, _pages, _q
from termloom.sources.words import normal_page

c = F.col
NOW, DAYS = "1998-08-01 12:30:00", 30

# export

_TERMS = """terms AS (SELECT o_orderkey AS id, 'term ' || o_custkey AS source_term, lower(o_orderstatus) AS source_language, o_orderpriority AS target_term, 'bo' AS target_language,
  CASE WHEN o_orderkey % 3 = 0 THEN 'about ' || o_orderkey WHEN o_orderkey % 3 = 1 THEN ' ' END AS context, CASE WHEN o_orderkey % 4 > 0 THEN 'c' || (o_custkey % 5) END AS contributor, o_orderdate AS date_added,
  CASE o_orderkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'Reviewed' WHEN 2 THEN 'draft' WHEN 3 THEN 'odd' END AS verified_status, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey END AS notes FROM orders)"""


def _terms(t):
    k = c("o_orderkey")
    return t("orders").select(
        k.alias("id"), F.concat(F.lit("term "), c("o_custkey").cast("string")).alias("source_term"), F.lower("o_orderstatus").alias("source_language"), c("o_orderpriority").alias("target_term"), F.lit("bo").alias("target_language"),
        F.when(k % 3 == 0, F.concat(F.lit("about "), k.cast("string"))).when(k % 3 == 1, " ").alias("context"), F.when(k % 4 > 0, F.concat(F.lit("c"), (c("o_custkey") % 5).cast("string"))).alias("contributor"), c("o_orderdate").cast("timestamp").alias("date_added"),
        F.when(k % 5 == 0, "verified").when(k % 5 == 1, "Reviewed").when(k % 5 == 2, "draft").when(k % 5 == 3, "odd").alias("verified_status"), F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("notes"),
    )


_PAIR = "source_language || ' → ' || target_language"
_CONTEXT = "CASE WHEN trim(coalesce(context, '')) <> '' THEN '  📝 _' || context || '_' || chr(10) ELSE '' END"


def _numbered(source: str) -> str:
    return f"n AS (SELECT *, row_number() OVER (ORDER BY date_added DESC, id DESC) AS position, lag({_PAIR}) OVER (ORDER BY date_added DESC, id DESC) AS before FROM {source})"


def _head(rule: str) -> str:
    return f"CASE WHEN {_PAIR} IS DISTINCT FROM before THEN CASE WHEN before IS NOT NULL THEN chr(10) ELSE '' END || '🌍 *' || upper({_PAIR}) || '*' || chr(10) || '{rule}' || chr(10) ELSE '' END"


_BODY = f"{_head(E.HEADING_RULE)} || '• **' || source_term || '**' || chr(10) || '  ➜ ' || target_term || chr(10) || {_CONTEXT} || CASE WHEN trim(coalesce(contributor, '')) <> '' THEN '  👤 ' || contributor || chr(10) ELSE '' END || chr(10)"


def _ends(title: str, rule: str, noun: str, gap: str = "") -> str:
    text = lambda s: " || chr(10) || ".join(_q(x) for x in s.split("\n"))
    return f"""SELECT position, line FROM l UNION ALL SELECT 0, {text(title + chr(10) + rule + chr(10) + chr(10))} UNION ALL SELECT (SELECT count(*) FROM l) + 1, {text(gap + rule + chr(10) + '📊 Total: ')} || (SELECT count(*) FROM l) || {text(' ' + noun + chr(10) + '🕐 Gerado em: ')} || strftime(TIMESTAMP '{NOW}', '%d/%m/%Y %H:%M')"""


@query(f"WITH {_TERMS}, r AS (SELECT * FROM terms WHERE date_added > TIMESTAMP '{NOW}' - INTERVAL {DAYS} DAY), {_numbered('r')}, l AS (SELECT position, {_BODY} AS line FROM n) {_ends(f'📚 *{E.NAME}*{chr(10)}🗓️ Novos termos dos últimos {DAYS} dias', E.SHORT_RULE, 'novos termos')}")
def q_export_recent(t):
    return E.recent_document(_terms(t), NOW, DAYS)


@query(f"WITH {_TERMS}, r AS (SELECT * FROM terms ORDER BY date_added DESC, id DESC LIMIT {E.NEWEST}), {_numbered('r')}, l AS (SELECT position, {_head(E.LONG_HEADING_RULE)} || '• **' || source_term || '** → ' || target_term || ' ' || CASE lower(coalesce(verified_status, 'draft')) WHEN 'verified' THEN '✅' WHEN 'approved' THEN '✅' WHEN 'reviewed' THEN '🔍' WHEN 'draft' THEN '📝' ELSE '❓' END || chr(10) || {_CONTEXT} AS line FROM n) {_ends(f'📚 *{E.WHOLE_NAME}*', E.LONG_RULE, 'termos', chr(10))}")
def q_export_all(t):
    return E.whole_document(_terms(t), NOW)


@query(f"WITH {_TERMS}, r AS (SELECT * FROM (SELECT * FROM terms ORDER BY date_added DESC, id DESC LIMIT {E.NEWEST}) WHERE contributor = 'c2'), {_numbered('r')}, l AS (SELECT position, '• **' || source_term || '**' || chr(10) || '  ➜ ' || target_term || chr(10) || {_CONTEXT} || '  📅 ' || strftime(date_added, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) AS line FROM n) {_ends(f'📚 *{E.NAME}*{chr(10)}👤 Contribuições de: c2', E.SHORT_RULE, 'termos')}")
def q_export_contributor(t):
    return E.contributor_document(_terms(t), "c2", NOW)


@query(f"""WITH {_TERMS} SELECT id, '🔤 Termo Original: ' || source_term || chr(10) || '🌍 Idioma Original: ' || source_language || chr(10) || chr(10) || '📝 Tradução: ' || target_term || chr(10) || '🌍 Idioma Tradução: ' || target_language || chr(10) || chr(10)
  || CASE WHEN trim(coalesce(context, '')) <> '' THEN '📖 Contexto: ' || context || chr(10) || chr(10) ELSE '' END || CASE WHEN trim(coalesce(contributor, '')) <> '' THEN '👤 Contribuidor: ' || contributor || chr(10) ELSE '' END
  || '📅 Data: ' || strftime(date_added, '%Y-%m-%d %H:%M:%S') || chr(10) || '✓ Status: ' || coalesce(verified_status, 'null') || chr(10) || CASE WHEN trim(coalesce(notes, '')) <> '' THEN '📌 Notas: ' || notes || chr(10) ELSE '' END
  || {' || chr(10) || '.join(_q(x) for x in E.SHARE.split(chr(10)))} AS view FROM terms""")
def q_detail_view(t):
    return _terms(t).select("id", E.shared(E.detail_view()).alias("view"))


@query("SELECT s_suppkey, s_name, TIMESTAMP '2024-01-01 00:00:00' AS date_added, CASE WHEN s_suppkey % 2 = 0 THEN 'reviewed' ELSE 'draft' END AS verified_status FROM supplier")
def q_insert_defaults(t):
    new = t("supplier").select("s_suppkey", "s_name", F.when(c("s_suppkey") % 2 == 0, "reviewed").alias("verified_status"))
    return T.with_defaults(new, "2024-01-01 00:00:00")


# boxes and characters


@query("""WITH p AS (SELECT *, p_size * 10 AS w, p_partkey % 40 * 5 + 100 AS h, CASE WHEN p_partkey % 3 = 0 THEN 'book' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'line_cluster' WHEN 1 THEN 'line_cut' END AS method FROM part),
m AS (SELECT *, CASE WHEN kind IS NULL AND method IS NULL THEN CASE WHEN w > 2 * h THEN 'line_cluster' ELSE 'line_cut' END ELSE method END AS m, CASE WHEN kind IS NULL AND method IS NULL THEN CASE WHEN w > 2 * h THEN 'pecha' ELSE 'book' END ELSE kind END AS k FROM p)
SELECT p_partkey, CASE WHEN m = 'line_cluster' THEN 'pecha' ELSE k END AS kind, m AS method, CASE WHEN p_partkey % 7 > 0 THEN 35.0 / ((w - p_partkey % 9) / CAST(p_partkey % 7 AS DOUBLE)) ELSE 1.0 END AS scale,
  w BETWEEN 250 - 3 * 40 AND 250 + 40 AS mark, w / 500.0 > 0.66 AND w / 500.0 < 0.995 AND h < 150 AS rule FROM m""")
def q_page_kind(t):
    k, w, h = c("p_partkey"), c("p_size") * 10, c("p_partkey") % 40 * 5 + 100
    kind, method = R.page_kind(w, h, F.when(k % 3 == 0, "book"), F.when(k % 4 == 0, "line_cluster").when(k % 4 == 1, "line_cut"))
    return t("part").select("p_partkey", kind.alias("kind"), method.alias("method"), R.scale_factor(w, k % 9, k % 7).alias("scale"), R.mark_width(w, F.lit(250), F.lit(40)).alias("mark"), R.header_rule(w, h, F.lit(500), F.lit(600)).alias("rule"))


_BOXES = "boxes AS (SELECT l_orderkey AS page, l_linenumber AS id, CAST(l_linenumber * 12 + l_partkey % 9 AS INTEGER) AS x, CAST(l_suppkey % 60 AS INTEGER) AS y, CAST(4 + l_quantity % 14 AS INTEGER) AS w, CAST(3 + l_partkey % 11 AS INTEGER) AS h, substr('ཀཁགངཅཆཇ', l_linenumber, 1) AS ch FROM lineitem)"


def _boxes(t):
    i = lambda e: F.expr(f"CAST({e} AS INTEGER)")
    return t("lineitem").select(c("l_orderkey").alias("page"), c("l_linenumber").alias("id"), i("l_linenumber * 12 + l_partkey % 9").alias("x"), i("l_suppkey % 60").alias("y"), i("4 + l_quantity % 14").alias("w"), i("3 + l_partkey % 11").alias("h"), F.substr(F.lit("ཀཁགངཅཆཇ"), c("l_linenumber"), F.lit(1)).alias("ch"))


@query(f'WITH {_BOXES} SELECT page, id, x AS "left", x + w AS "right", y AS top, y + h AS bottom, w, h FROM boxes')
def q_box_edges(t):
    return _boxes(t).select("page", "id", *R.box_edges())


@query(f"WITH {_BOXES} SELECT page, max(y) - min(y) AS spread, max(y) - min(y) > 50 AS several FROM boxes GROUP BY 1")
def q_several_lines(t):
    return R.several_lines(_boxes(t), ["page"])


@query(f"WITH {_BOXES}, s AS (SELECT page, id, x AS lo, x + w AS hi FROM boxes) SELECT a.page, a.id AS a, b.id AS b FROM s a JOIN s b ON a.page = b.page AND a.id < b.id WHERE a.lo < b.hi AND b.lo < a.hi AND greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / CAST(least(a.hi - a.lo, b.hi - b.lo) AS DOUBLE) >= 0.3")
def q_overlapping(t):
    s = _boxes(t).select("page", "id", c("x").alias("lo"), (c("x") + c("w")).alias("hi"))
    return R.overlapping(s, s, ["page"], 0.3).where("a < b")


@query("WITH s AS (SELECT n_regionkey AS page, n_nationkey AS id, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey - n_nationkey % 4 END AS parent FROM nation), i AS (SELECT page, parent AS id, list(id ORDER BY id) AS k FROM s WHERE parent IS NOT NULL GROUP BY 1, 2) SELECT s.page, s.id, coalesce(array_to_string(k, ','), '') AS children FROM s LEFT JOIN i ON s.page = i.page AND s.id = i.id WHERE parent IS NULL")
def q_with_children(t):
    s = t("nation").select(c("n_regionkey").alias("page"), c("n_nationkey").alias("id"), F.when(c("n_nationkey") % 4 > 0, c("n_nationkey") - c("n_nationkey") % 4).alias("parent"))
    return R.with_children(s, ["page"]).select("page", "id", F.array_join(c("children").cast("array<string>"), ",").alias("children"))


_EVENTS = "e AS (SELECT user_id % 50 AS page, event_id AS id, CAST(event_id % 7 AS INTEGER) AS line, CAST(event_id * 37 % 211 AS INTEGER) AS y, CAST(event_id * 53 % 997 AS INTEGER) AS x FROM events)"


def _events(t):
    k = c("event_id")
    return t("events").select((c("user_id") % 50).alias("page"), k.alias("id"), (k % 7).cast("int").alias("line"), (k * 37 % 211).cast("int").alias("y"), (k * 53 % 997).cast("int").alias("x"))


@query(f"WITH {_EVENTS}, m AS (SELECT page, line, avg(y) AS m FROM e WHERE id % 3 > 0 GROUP BY 1, 2), d AS (SELECT p.id, p.page, p.x, p.y, m.line, row_number() OVER (PARTITION BY p.id ORDER BY abs(m.m - p.y), m.line) AS r FROM e p LEFT JOIN m ON p.page = m.page WHERE p.id % 3 = 0) SELECT id, page, x, y, line FROM d WHERE r = 1")
def q_nearest_text_line(t):
    e = _events(t)
    return R.nearest_line(e.where("id % 3 = 0").drop("line"), e.where("id % 3 > 0"), ["page"]).select("id", "page", "x", "y", "line")


@query(f"WITH {_EVENTS}, d AS (SELECT p.id, p.page, k.id AS known, sqrt((p.x - k.x) ** 2 + (p.y - k.y) ** 2) AS d FROM e p JOIN e k ON p.page = k.page AND p.id % 3 = 0 AND k.id % 3 > 0) SELECT e.id, e.page, (SELECT known FROM (SELECT known, d FROM d WHERE d.id = e.id AND d.d < 30 ORDER BY d, known LIMIT 1)) AS nearest FROM e WHERE e.id % 3 = 0")
def q_nearest_within(t):
    e = _events(t)
    return R.nearest_within(e.where("id % 3 = 0"), e.where("id % 3 > 0"), ["page"]).select("id", "page", "nearest")


_MARKS = "marks AS (SELECT o_orderkey AS page, CAST(o_custkey % 90 AS INTEGER) AS x, '་' AS ch FROM orders)"


def _marks(t):
    return t("orders").select(c("o_orderkey").alias("page"), (c("o_custkey") % 90).cast("int").alias("x"), F.lit("་").alias("ch"))


@query(f"WITH {_BOXES}, {_MARKS}, u AS (SELECT page, x, ch, 0 AS k FROM boxes UNION ALL SELECT page, x, ch, 1 FROM marks) SELECT page, x, ch, CAST(row_number() OVER (PARTITION BY page ORDER BY x, k, ch) AS INTEGER) AS place FROM u")
def q_with_marks(t):
    return R.with_marks(_boxes(t), _marks(t), ["page"])


@query("WITH a AS (SELECT n_regionkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation), b AS (SELECT c_nationkey % 5 AS k, c_name, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS r FROM customer) SELECT a.k, n_name, c_name FROM a JOIN b ON a.k = b.k AND a.r = b.r")
def q_paired(t):
    a = t("nation").select(c("n_regionkey").alias("k"), c("n_nationkey").cast("long").alias("at"), "n_name")
    b = t("customer").select((c("c_nationkey") % 5).alias("k"), c("c_custkey").alias("at"), "c_name")
    return R.paired(a, b, ["k"], "at").select("k", "n_name", "c_name")


@query(f"""WITH {_BOXES}, blobs AS (SELECT o_orderkey AS page, 1 AS id, CAST(o_custkey % 50 AS INTEGER) AS x, 30 AS w FROM orders UNION ALL SELECT o_orderkey, 2, CAST(o_custkey % 50 + 25 AS INTEGER), 40 FROM orders),
h AS (SELECT b.page, b.id, min(l.id) AS blob FROM boxes b JOIN blobs l ON b.page = l.page AND b.x >= l.x - 15 AND b.x + b.w <= l.x + l.w + 15 GROUP BY 1, 2), o AS (SELECT b.*, blob, CASE WHEN blob IS NULL THEN b.id END AS own FROM boxes b LEFT JOIN h ON b.page = h.page AND b.id = h.id)
SELECT page, min(id) AS part, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM o GROUP BY page, blob, own""")
def q_merge_low_ink(t):
    at = (c("o_custkey") % 50).cast("int")
    blobs = t("orders").select(c("o_orderkey").alias("page"), F.explode(F.array(F.struct(F.lit(1).alias("id"), at.alias("x"), F.lit(30).alias("w")), F.struct(F.lit(2).alias("id"), (at + 25).alias("x"), F.lit(40).alias("w")))).alias("b")).select("page", "b.*")
    return R.merge_low_ink(_boxes(t), blobs, ["page"])


@query(f"""WITH {_BOXES}, g AS (SELECT *, lead(x) OVER p - x - w AS gap, lead(w) OVER p AS nw, row_number() OVER p AS r FROM boxes WINDOW p AS (PARTITION BY page ORDER BY x, y, w, h, ch)), s AS (SELECT *, gap >= 8 OR gap >= 0.4 * (w + nw) OR (gap >= 2 AND gap >= 3) AS wide FROM g)
SELECT page, r * 2 AS place, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, ch FROM s UNION ALL SELECT page, r * 2 + 1, -1, -1, -1, -1, ' ' FROM s WHERE wide""")
def q_with_spaces(t):
    return R.with_spaces(_boxes(t), ["page"], 4.0)


@query(f"WITH {_EVENTS}, m AS (SELECT page, line, avg(CASE WHEN y >= 20 THEN y - 20 END) AS y FROM e GROUP BY 1, 2) SELECT page, line, round(y, 6) AS y, CAST(row_number() OVER (PARTITION BY page ORDER BY y ASC NULLS LAST, line) AS INTEGER) AS place FROM m")
def q_lines_by_height(t):
    own = _events(t).withColumn("y", F.when(c("y") >= 20, c("y") - 20).otherwise(-1))
    return R.lines_by_height(own, ["page"]).withColumn("y", F.round("y", 6))


@query(f"WITH {_BOXES}, o AS (SELECT page, y // 20 AS line, x, x + w AS r, ch FROM boxes), n AS (SELECT *, ch || CASE WHEN lead(line) OVER p = line + 1 THEN chr(10) WHEN lead(x) OVER p - r >= 6 THEN ' ' ELSE '' END AS t FROM o WINDOW p AS (PARTITION BY page ORDER BY line, x, r, ch)) SELECT page, string_agg(t, '' ORDER BY line, x, r, ch, t) AS text FROM n GROUP BY 1")
def q_page_text(t):
    own = _boxes(t).select("page", F.floor(c("y") / 20).cast("int").alias("line"), "x", (c("x") + c("w")).alias("r"), "ch")
    return R.page_text(own, ["page"], 6)


@query("WITH e AS (SELECT event_id, row_number() OVER p AS r, max(CASE WHEN event_type = 'click' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS any, CASE WHEN event_type = 'click' THEN row_number() OVER p END AS m, user_id, ts FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CAST(r - coalesce(max(m) OVER (PARTITION BY user_id ORDER BY r), 0) AS INTEGER) AS run FROM e")
def q_run_without(t):
    own = t("events").withColumn("at", F.struct("ts", "event_id"))
    return own.select("event_id", R.run_without(["user_id"], "at", c("event_type") == "click").alias("run"))


_SIZES = "z AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN '།' WHEN 'view' THEN 's' WHEN 'purchase' THEN 'b' WHEN 'signup' THEN '༼' ELSE CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 's' END END AS ch FROM events)"


def _sizes(t):
    kind = c("event_type")
    ch = F.when(kind == "click", "།").when(kind == "view", "s").when(kind == "purchase", "b").when(kind == "signup", "༼").otherwise(F.when(c("event_id") % 2 == 0, "b").otherwise("s"))
    return t("events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), ch.alias("ch"))


@query(f"""WITH {_SIZES}, r AS (SELECT *, coalesce(sum(CASE WHEN ch = '།' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(CASE WHEN ch = '༼' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM z),
n AS (SELECT *, count(*) FILTER (ch = 's') OVER i AS s, count(*) FILTER (ch = 'b') OVER i AS b, count(*) FILTER (ch = 's') OVER u AS us, count(*) FILTER (ch = 'b') OVER u AS ub FROM r WINDOW i AS (PARTITION BY user_id, run), u AS (PARTITION BY user_id))
SELECT event_id, ch, CASE WHEN s > b THEN 's' WHEN b > s THEN 'b' WHEN ub > us THEN 'b' ELSE 's' END AS smooth FROM n""")
def q_smoothed_sizes(t):
    return R.smoothed_sizes(_sizes(t), ["user_id"], "at").select("event_id", "ch", "smooth")


@query(f"""WITH {_SIZES}, y AS (SELECT user_id, event_id, ts, CASE WHEN ch IN ('s', 'b') THEN ch ELSE 's' END AS size, substr(CAST(event_id AS VARCHAR), 1, 1) AS ch FROM z), o AS (SELECT *, size <> 's' AND coalesce(lag(size) OVER p, 's') = 's' AS a, size <> 's' AND coalesce(lead(size) OVER p, 's') = 's' AS b FROM y WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, user_id AS line, string_agg(CASE WHEN a THEN '<span class="format_size">' ELSE '' END || ch || CASE WHEN b THEN '</span>' ELSE '' END, '' ORDER BY ts, event_id) AS html FROM o GROUP BY 1""")
def q_marked_up(t):
    own = _sizes(t).select("user_id", c("user_id").alias("line"), "at", F.when(c("ch").isin("s", "b"), c("ch")).otherwise("s").alias("size"), F.left(c("event_id").cast("string"), F.lit(1)).alias("ch"))
    return R.marked_up(own, ["user_id"], "line", "at", "s")


@query("WITH l AS (SELECT DISTINCT p_size * 3 AS idx, 'c' || p_size AS ch FROM part WHERE p_size % 4 = 1) SELECT p_partkey, coalesce((SELECT arg_max(ch, idx) FROM l WHERE idx <= part.p_partkey % 200), '�') AS ch FROM part")
def q_labelled(t):
    labels = t("part").where("p_size % 4 = 1").select((c("p_size") * 3).alias("idx"), F.concat(F.lit("c"), c("p_size").cast("string")).alias("ch")).distinct()
    return R.labelled(t("part").select("p_partkey", (c("p_partkey") % 200).cast("int").alias("idx")), labels).select("p_partkey", "ch")


@query("WITH s AS (SELECT p_partkey, [p_size / 10.0, p_retailprice / 500.0, p_partkey % 7 / 2.0] AS v FROM part), e AS (SELECT p_partkey, list_transform(v, lambda x: exp(x - list_max(v))) AS g FROM s) SELECT p_partkey, round(g[1] / list_sum(g), 9) AS a, round(g[2] / list_sum(g), 9) AS b, round(g[3] / list_sum(g), 9) AS c FROM e")
def q_softmax(t):
    p = R.softmax(F.array(c("p_size") / 10.0, c("p_retailprice") / 500.0, c("p_partkey") % 7 / 2.0))
    own = t("part").select("p_partkey", p.alias("p"))
    return own.select("p_partkey", *[F.round(F.get("p", F.lit(i)), 9).alias(n) for i, n in enumerate("abc")])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def q_beam(t):
    return R.beam(t("lineitem"), ["l_orderkey"], "l_quantity", 2, "l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity")


_READINGS = """ch AS (SELECT c_custkey AS seq, i AS choice, string_split(CASE i WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name ELSE c_mktsegment || c_nationkey END, '') AS syllables FROM customer, range(3) r(i)),
pr AS (SELECT n_name[1] AS a, n_name[2] AS b, count(*) / 50.0 AS p FROM nation GROUP BY 1, 2)"""


@query(f"""WITH {_READINGS}, st AS (SELECT seq, choice, unnest(range(1, len(syllables))) AS i, syllables FROM ch), m AS (SELECT seq, choice, sum(ln(coalesce(p, 0.00001))) AS l FROM st LEFT JOIN pr ON a = syllables[i] AND b = syllables[i + 1] GROUP BY 1, 2),
w AS (SELECT c.seq, c.choice, exp(coalesce(l, 0.0)) AS p FROM ch c LEFT JOIN m ON c.seq = m.seq AND c.choice = m.choice) SELECT seq, CAST(choice AS INTEGER) AS choice FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(p, 15) DESC, choice) AS r FROM w) WHERE r = 1""")
def q_likeliest_reading(t):
    text = lambda i: c("c_mktsegment") if i == 0 else c("c_name") if i == 1 else F.concat("c_mktsegment", c("c_nationkey").cast("string"))
    choices = t("customer").select(c("c_custkey").alias("seq"), F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.split(text(i), "").alias("syllables")) for i in range(3)])).alias("s")).select("seq", "s.*")
    pairs = t("nation").groupBy(F.substring("n_name", 1, 1).alias("a"), F.substring("n_name", 2, 1).alias("b")).agg((F.count(F.lit(1)) / 50.0).alias("p"))
    return R.likeliest_reading(choices, pairs, ["seq"]).select("seq", "choice")


@query("""WITH m AS (SELECT l_returnflag AS k, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1), x AS (SELECT l_returnflag AS k, l_quantity AS w, m, s, f FROM lineitem JOIN m ON k = l_returnflag, (SELECT unnest([0.5, 1.0, 1.5, 1.75, 2.5])::DOUBLE AS f)),
p AS (SELECT *, CASE WHEN w >= m + f * s THEN floor(w / (m - s)) ELSE 0 END AS p FROM x), a AS (SELECT k, f, sum(1 + p) AS n, sum(w + p * m) AS t, sum(w * w + p * m * m) AS q FROM p GROUP BY 1, 2)
SELECT k, f AS factor FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(q / n - (t / n) ** 2, 6), f) AS r FROM a) WHERE r = 1""")
def q_least_variance(t):
    return Q.least_variance(t("lineitem").select(c("l_returnflag").alias("k"), c("l_quantity").alias("w")), ["k"], "w", (0.5, 1.0, 1.5, 1.75, 2.5))


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS lo, max(l_quantity) AS hi, max(l_quantity) - min(l_quantity) AS contrast FROM lineitem GROUP BY 1")
def q_contrast(t):
    return Q.contrast(t("lineitem"), ["l_returnflag"], "l_quantity").withColumns({n: F.round(n, 6) for n in ("mean", "std")})


@query("WITH d AS (SELECT n_nationkey AS k, n_regionkey AS r, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT a.k, coalesce(a.n > (SELECT avg(b.n) + 2 * stddev_pop(b.n) FROM d b WHERE b.r = a.r AND b.k <> a.k) + 1e-9, false) AS tall FROM d a")
def q_over_others(t):
    n = t("nation").join(t("customer"), c("c_nationkey") == c("n_nationkey"), "left").groupBy(c("n_nationkey").alias("k"), c("n_regionkey").alias("r")).agg(F.count("c_custkey").alias("n"))
    return n.select("k", Q.over_others(c("n").cast("double"), W.partitionBy("r")).alias("tall"))


@query("SELECT round(avg(share), 9) AS accuracy FROM (SELECT avg(CASE WHEN (n_chars > 100) = (quality = 1) THEN 1.0 ELSE 0.0 END) AS share FROM labels JOIN documents USING (doc_id) GROUP BY source)")
def q_mean_accuracy(t):
    hit = F.when((c("n_chars") > 100) == (c("quality") == 1), 1.0).otherwise(0.0)
    return t("labels").join(t("documents"), "doc_id").groupBy("source").agg(F.avg(hit).alias("share")).agg(F.round(F.avg("share"), 9).alias("accuracy"))


@query("SELECT p_partkey, round(abs((ax * bx + ay * by_) / sqrt((ax * ax + ay * ay) * (bx * bx + by_ * by_))), 9) AS cosine FROM (SELECT p_partkey, p_size - 7.5 AS ax, 3.0 AS ay, p_partkey % 11 - 7.5 AS bx, p_partkey % 5 + 1.0 AS by_ FROM part)")
def q_cosine(t):
    zero, k = F.lit(0.0), c("p_partkey")
    return t("part").select("p_partkey", F.round(G.cosine(c("p_size") - 7.5, F.lit(3.0), zero, zero, k % 11 - 7.5, k % 5 + 1.0), 9).alias("cosine"))


@query(f"WITH {_EVENTS} SELECT id, page, CAST(row_number() OVER (PARTITION BY page ORDER BY y // 50, x, y) AS INTEGER) AS place FROM e WHERE page < 35")
def q_reading_order(t):
    return G.reading_order(_events(t).where("page < 35"), ["page"], ties=("id",)).select("id", "page", "place")


@query("WITH s AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ''))) AS a, list_sort(list_distinct(string_split(lower(p_type), ''))) AS b FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), '') AS either, array_to_string(list_sort(list_intersect(a, b)), '') AS both, list_has_any(a, b) AS some, list_has_all(b, a) AS within FROM s")
def q_alphabets(t):
    a, b = F.array_distinct(F.split("p_name", "")), F.array_distinct(F.split(F.lower("p_type"), ""))
    own = t("part").select("p_partkey", a.alias("a"), b.alias("b"))
    text = lambda x: F.array_join(F.sort_array(x), "")
    return own.select("p_partkey", text(F.array_union("a", "b")).alias("either"), text(F.array_intersect("a", "b")).alias("both"), F.arrays_overlap("a", "b").alias("some"), (F.size(F.array_except("a", "b")) == 0).alias("within"))


# text


def _clean_words() -> str:
    drop = lambda s, word: f"regexp_replace(regexp_replace({s}, '(^|[^\\pL\\pN_])({word})($|[^\\pL\\pN_])', '\\1\\3', 'g'), '(^|[^\\pL\\pN_])({word})($|[^\\pL\\pN_])', '\\1\\3', 'g')"
    first = "regexp_replace(regexp_replace(regexp_replace(s, '\\s+x\\s*$', ''), '\\s+x\\s+', ' ', 'g'), '^x\\s+', '')"
    plain = f"trim({drop(drop(first, 'x'), 'BNA|ANA|aT|AQ|STARE|ATS|AAS')})"
    marks = drop("regexp_replace(plain, '''[aA]', '', 'g')", "[aA]")
    latin = "regexp_replace(regexp_replace(regexp_replace(" + marks + ", '[a-zA-Z]''|''[a-zA-Z]', '', 'g'), '[a-df-zA-DF-Z]', '', 'g'), '\\s+', '', 'g')"
    return f"p AS (SELECT k, {plain} AS plain FROM s), d AS (SELECT k, CASE WHEN regexp_matches(plain, '[ༀ-࿿]') THEN trim({latin}) ELSE plain END AS cleaned FROM p)"


@query(f"WITH s AS (SELECT doc_id AS k, text AS s FROM documents), {_clean_words()} SELECT k AS doc_id, cleaned FROM d")
def q_clean_noise(t):
    return t("documents").select("doc_id", X.clean_word(c("text")).alias("cleaned"))


@query(f"WITH {_SQL_LINES}, s AS (SELECT p_partkey AS k, 'x ' || line || '''a BNA x' AS s FROM lines), {_clean_words()} SELECT k AS p_partkey, cleaned FROM d")
def q_clean_words(t):
    return _lines(t).select("p_partkey", X.clean_word(F.concat(F.lit("x "), c("line"), F.lit("'a BNA x"))).alias("cleaned"))


def _clean_definition(source: str) -> str:
    whole = lambda s, word: f"regexp_replace(regexp_replace({s}, '(^|[^\\pL\\pN_])({word})($|[^\\pL\\pN_])', '\\1\\3', 'g'), '(^|[^\\pL\\pN_])({word})($|[^\\pL\\pN_])', '\\1\\3', 'g')"
    first = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + whole("s", "x") + ", '[0-9]+', '', 'g'), '[A-Z]{2,}', '', 'g'), '[''‘’]', '', 'g'), '\\s+', ' ', 'g'))"
    second = f"regexp_replace({first}, 'ས་སུ་|་ཤོས་ཤོག|ATS|AAS|STARE|AQ', '', 'g')"
    third = whole(f"regexp_replace({second}, chr(39) || '[aA]', '', 'g')", "[aA]")
    return "SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(" + third + ", '[a-zA-Z]''|''[a-zA-Z]', '', 'g'), '[a-df-zA-DF-Z]', '', 'g'), '\\s+', '', 'g')) AS cleaned FROM " + source


@query(f"WITH {_SQL_LINES}, s AS (SELECT p_partkey AS k, line || ' 12 ABC ས་སུ་' AS s FROM lines UNION ALL SELECT -p_partkey, p_name || ' ' || p_type FROM part) {_clean_definition('s')}")
def q_clean_definition(t):
    own = _lines(t).select(c("p_partkey").alias("k"), F.concat(c("line"), F.lit(" 12 ABC ས་སུ་")).alias("s"))
    more = t("part").select((-c("p_partkey")).alias("k"), F.concat_ws(" ", "p_name", "p_type").alias("s"))
    return own.unionByName(more).select("k", X.clean_definition(c("s")).alias("cleaned"))


_ENDS = "'^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'"


@query(f"WITH a AS (SELECT doc_id, left(text, 25) AS c1, ltrim(substr(text, 26), ' ') AS r FROM documents), b AS (SELECT *, left(r, 10) AS c2, ltrim(substr(r, 11), ' ') AS q FROM a) SELECT doc_id, regexp_replace(c1, {_ENDS}) AS c1, regexp_replace(c2, {_ENDS}) AS c2, regexp_replace(left(q, 25), {_ENDS}) AS c3, regexp_replace(ltrim(substr(q, 26), ' '), {_ENDS}) AS c4 FROM b")
def q_fixed_width(t):
    own = t("documents").select("doc_id", P.fixed_columns(c("text")).alias("v"))
    return own.select("doc_id", *[F.get("v", F.lit(i)).alias(f"c{i + 1}") for i in range(4)])


_TERM = "replace(regexp_replace(line, '\\s+', '', 'g'), 'x', 'y')"


@query(f"""WITH {_SQL_LINES}, s AS (SELECT p_partkey, {_TERM} AS t FROM lines), a AS (SELECT *, strpos(t, '།') AS shad, strpos(substr(t, 21, 10), '་') AS mark FROM s)
SELECT p_partkey, CASE WHEN t = '' THEN '' WHEN shad > 1 AND shad <= 50 THEN left(t, shad) WHEN length(t) > 30 AND mark > 0 THEN left(t, mark + 20) WHEN length(t) > 30 THEN left(t, 25) || '...' WHEN NOT suffix(t, '།') AND NOT suffix(t, '་') THEN t || '།' ELSE t END AS term FROM a""")
def q_cut_terms(t):
    return _lines(t).select("p_partkey", X.cut_term(F.replace(c("line"), F.lit("x"), F.lit("y"))).alias("term"))


@query(f"WITH {_SQL_LINES}, s AS (SELECT p_partkey, list_transform(regexp_split_to_array(trim(regexp_replace(lower(line || ', bio,' || split_part(line, ' ', 2)), '[^a-z,\\s]', '', 'g')), '[,\\s]+'), lambda x: x) AS v FROM lines), w AS (SELECT p_partkey, list_filter(v, lambda x: x IN ({', '.join(map(_q, X.SUBJECTS))})) AS v FROM s) SELECT p_partkey, v[-1] AS code FROM w")
def q_subject_codes(t):
    return _lines(t).select("p_partkey", X.subject_code(F.concat("line", F.lit(", bio,"), F.coalesce(F.get(F.split("line", " "), F.lit(1)), F.lit("")))).alias("code"))


@query(f"WITH {_SQL_LINES} SELECT p_partkey, CASE WHEN strpos(line, '།') > 0 THEN left(line, strpos(line, '།')) ELSE line END AS term, CASE WHEN strpos(line, '།') > 0 THEN trim(substr(line, strpos(line, '།') + 1)) ELSE '' END AS rest, regexp_matches(line, '^\\s*\\d+\\s*$') OR regexp_matches(line, 'absolute pressure.*\\d') OR (trim(line) = '' AND length(line) < 5) AS page_break, array_to_string(regexp_extract_all(line, '[\\x{{0F40}}-\\x{{0F6C}}][\\x{{0F71}}-\\x{{0F84}}\\x{{0F8D}}-\\x{{0FBC}}]*'), '|') AS stacks FROM lines")
def q_shad_split(t):
    term, rest = X.split_at_shad(c("line"))
    return _lines(t).select("p_partkey", term.alias("term"), rest.alias("rest"), X.page_break(c("line")).alias("page_break"), F.array_join(X.stacks(c("line")), "|").alias("stacks"))


def _corrected() -> str:
    s = "line"
    for wrong, right in [("་' || chr(10) || '", "' || chr(10) || '"), ("་་", "་"), *S.CONFUSED]:
        s = f"replace({s}, '{wrong}', '{right}')"
    return f"WITH {_SQL_LINES} SELECT p_partkey, regexp_replace(replace(array_to_string(list_filter(string_split({s}, '་'), lambda w: NOT regexp_full_match(w, '\\s*')), '་'), '་' || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM lines"


@query(_corrected())
def q_corrected(t):
    return _lines(t).select("p_partkey", S.corrected(c("line")).alias("text"))


@query(f"""WITH {_SQL_LINES} SELECT p_partkey, 'Page ' || p_partkey || ' (OCR extracted)' || CASE WHEN p_partkey % 3 > 0 THEN ' | Subject: s' || p_partkey % 3 ELSE '' END AS context,
  CASE WHEN trim(line) = '' THEN 'Requires manual review' WHEN length('Definition: ' || trim(repeat(line, 8))) > 200 THEN left('Definition: ' || trim(repeat(line, 8)), 200) || '...' ELSE 'Definition: ' || trim(repeat(line, 8)) END AS notes FROM lines""")
def q_saved_pairs(t):
    k = c("p_partkey")
    context, notes = P.saved_pair(k, "OCR extracted", F.when(k % 3 > 0, F.concat(F.lit("s"), (k % 3).cast("string"))).otherwise(""), F.repeat(c("line"), F.lit(8)))
    return _lines(t).select("p_partkey", context.alias("context"), notes.alias("notes"))


@query(f"""WITH {_SQL_LINES}, l AS (SELECT CAST(p_partkey // 7 AS BIGINT) AS page, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'tbocrtifs' || line WHEN p_partkey % 5 = 1 THEN '༄༅། །' || line WHEN p_partkey % 5 = 2 THEN line || '་་་' ELSE line END AS v FROM lines),
g AS (SELECT page, string_agg(v || chr(10), '' ORDER BY p_partkey) AS s FROM l WHERE NOT starts_with(v, 'tbocrtifs') GROUP BY 1)
SELECT page, regexp_replace(replace(regexp_replace(replace(replace(s, '༄༅། །', ''), '༄༅', ''), '་{{2,}}' || chr(10), '་' || chr(10), 'g'), chr(10), ''), '^This.*corrections\\.', '') AS text FROM g""")
def q_normal_page(t):
    k, v = c("p_partkey"), c("line")
    value = F.when(k % 5 == 0, F.concat(F.lit("tbocrtifs"), v)).when(k % 5 == 1, F.concat(F.lit("༄༅། །"), v)).when(k % 5 == 2, F.concat(v, F.lit("་་་"))).otherwise(v)
    return normal_page(_lines(t).select(F.floor(k / 7).cast("long").alias("page"), "p_partkey", value.alias("value")), ["page"], "p_partkey")


_WHITE = "w AS (SELECT CAST(i - 1 AS INTEGER) AS position, count(*) AS n FROM (SELECT unnest(list_filter(range(1, length(line) + 1), lambda j: regexp_matches(line[j], '\\s'))) AS i FROM b) GROUP BY 1)"


@query(f"""WITH {_SQL_PAGES}, {_TEXT_LINES}, b AS (SELECT line FROM tl), {_WHITE}, g AS (SELECT position, position - row_number() OVER (ORDER BY position) AS g FROM w WHERE n >= greatest(1, 0.05 * (SELECT count(*) FROM b)))
SELECT CAST(min(position) AS INTEGER) AS start, CAST(max(position) + 1 AS INTEGER) AS "end" FROM g GROUP BY g HAVING count(*) >= 2""")
def q_wide_boundaries(t):
    from termloom.operators.lines import text_lines

    return L.wide_boundaries(text_lines(_pages(t), "text", ["page"]), "line", 0.05)


@query(f"WITH {_SQL_LINES} SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 4 = 0 THEN regexp_split_to_array(line, '\\s{{2,}}') ELSE list_filter([trim(left(line, 6)), trim(substr(line, 9, 4)), trim(substr(line, 15))], lambda x: x <> '') END, '|') AS parts FROM lines")
def q_cut_at_boundaries(t):
    none = F.array().cast("array<int>")
    starts, ends = (F.when(c("p_partkey") % 4 == 0, none).otherwise(F.array(*[F.lit(x) for x in v])) for v in ((6, 12), (8, 14)))
    return _lines(t).select("p_partkey", F.array_join(L.cut_at(c("line"), starts, ends), "|").alias("parts"))


@query("WITH b AS (SELECT l_orderkey, CAST(l_linenumber * 90 + l_partkey % 70 AS INTEGER) AS l, CAST(l_quantity + 10 AS INTEGER) AS w, CAST(l_partkey AS VARCHAR) AS t FROM lineitem), g AS (SELECT *, l - lag(l + w) OVER (PARTITION BY l_orderkey ORDER BY l, t) AS gap FROM b) SELECT l_orderkey, string_agg(CASE WHEN gap > 100 THEN '    ' WHEN gap > 50 THEN '  ' WHEN gap > 10 THEN ' ' ELSE '' END || t, '' ORDER BY l, t) AS text FROM g GROUP BY 1")
def q_spaced_line(t):
    own = t("lineitem").select("l_orderkey", F.expr("CAST(l_linenumber * 90 + l_partkey % 70 AS INTEGER)").alias("left"), F.expr("CAST(l_quantity + 10 AS INTEGER)").alias("width"), c("l_partkey").cast("string").alias("text"))
    return L.spaced_line(own, ["l_orderkey"])


@query("SELECT doc_id, regexp_matches(text, '[a-zA-Z]{3,}') AND regexp_matches(text, '[ༀ-࿿]') AND len(string_split(text, chr(10))) > 10 AS glossary, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM documents")
def q_glossary_structure(t):
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.length(x))).cast("long")
    return t("documents").select("doc_id", X.glossary_structure(c("text")).alias("glossary"), longest.alias("longest"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, array_to_string(list(event_type ORDER BY ts, event_id), ',') AS every FROM events GROUP BY 1")
def q_growing_lists(t):
    every = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"])
    return t("events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"), F.array_join(every, ",").alias("every"))


@query(f"WITH {_SQL_LINES} SELECT CAST(length(r) AS INTEGER) AS width, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, ' +')) AS r FROM lines) GROUP BY 1")
def q_blank_runs(t):
    return _lines(t).select(F.explode(X.blank_runs(c("line"))).alias("width")).groupBy("width").agg(F.count(F.lit(1)).alias("n"))


_RECTS = "rects AS (SELECT o_custkey % 300 AS page, o_orderkey AS id, CAST(o_orderkey % 40 AS INTEGER) AS x, CAST(o_orderkey * 7 % 30 AS INTEGER) AS y, CAST(5 + o_orderkey * 3 % 60 AS INTEGER) AS w, CAST(5 + o_orderkey % 50 AS INTEGER) AS h FROM orders)"


@query(f"""WITH {_RECTS}, p AS (SELECT a.page, a.id, b.id AS parent, row_number() OVER (PARTITION BY a.page, a.id ORDER BY b.x DESC, b.id) AS r FROM rects a JOIN rects b ON a.page = b.page AND a.id <> b.id AND b.x <= a.x AND b.y <= a.y AND b.x + b.w >= a.x + a.w AND b.y + b.h >= a.y + a.h
  AND (NOT (a.x = b.x AND a.y = b.y AND a.w = b.w AND a.h = b.h) OR b.id < a.id)) SELECT rects.page, rects.id, parent FROM rects LEFT JOIN p ON rects.page = p.page AND rects.id = p.id AND r = 1""")
def q_box_tree(t):
    k = c("o_orderkey")
    rects = t("orders").select((c("o_custkey") % 300).alias("page"), k.alias("id"), (k % 40).cast("int").alias("x"), (k * 7 % 30).cast("int").alias("y"), (5 + k * 3 % 60).cast("int").alias("w"), (5 + k % 50).cast("int").alias("h"))
    return R.box_tree(rects, ["page"])


@query("SELECT doc_id, text FROM documents")
def q_packed_text(t):
    return t("documents").select("doc_id", X.unpacked(X.packed(c("text"))).alias("text"))


@query("""WITH b AS (SELECT l_suppkey % 40 AS page, l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 3 AS INTEGER) AS parent, CAST(l_quantity AS INTEGER) AS w, CAST(2 + l_partkey % 23 AS INTEGER) AS h, CAST(l_orderkey % 50 AS INTEGER) AS y FROM lineitem),
n AS (SELECT page, parent, count(*) AS c FROM b GROUP BY 1, 2), p AS (SELECT page, sum(c) AS n, arg_min(parent, -c * 100 + parent) AS top FROM n GROUP BY 1), m AS (SELECT page, median(w) AS mw, median(h) AS mh, median(w * h) AS ma FROM b GROUP BY 1)
SELECT b.page, id, w, h, w BETWEEN 3 AND 6 AND h BETWEEN 3 AND 6 AND w * h BETWEEN 9 AND 25 AND y BETWEEN 5 AND 35 AS mark FROM b JOIN p ON b.page = p.page JOIN m ON b.page = m.page WHERE (w < 0.1 * 300 OR n < 40)
  AND (parent = top OR (b.page % 2 = 0 AND w * h >= CASE WHEN n > 6 THEN greatest(10, floor(ma * 0.25)) ELSE 15 END AND w >= CASE WHEN n > 6 THEN greatest(3, floor(least(mw, mh) * 0.3)) ELSE 4 END AND h >= CASE WHEN n > 6 THEN greatest(3, floor(least(mw, mh) * 0.3)) ELSE 4 END
  AND NOT (h < CASE WHEN n > 6 THEN greatest(8, floor(mh * 0.4)) ELSE 10 END AND w > 1.4 * h)))""")
def q_outer_pieces(t):
    i = lambda e: F.expr(f"CAST({e} AS INTEGER)")
    boxes = t("lineitem").select((c("l_suppkey") % 40).alias("page"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), i("l_partkey % 3").alias("parent"), i("l_quantity").alias("w"), i("2 + l_partkey % 23").alias("h"), i("l_orderkey % 50").alias("y"))
    kept = R.outer_pieces(boxes, ["page"], F.lit(300), c("page") % 2 == 0)
    return kept.select("page", "id", "w", "h", R.small_mark(c("w"), c("h"), c("y")).alias("mark"))
