"""Further queries over the driver's tables, each with SQL that states the same: guards, objects, tables, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import geometry, text
from docspark.operators import detectors, findings, fonts, guards, invoices, layout, matching, objects, versions
from docspark.plans.queries import _FOLD_SQL, _KIND_SQL, query
from docspark.sources import pdf_bytes, scans
from docspark.sources.scans import table

_SPLIT_SQL = r"list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


# -- guards -------------------------------------------------------------------------------------------------------

#: Events as words: place, size and confidence follow from their numbers.
_WORDS_SQL = """SELECT event_id, user_id, event_type, value, value * 10 - 50 AS x0, (event_id % 100) * 9.0::DOUBLE - 30 AS y0, value * 10 - 20 AS x1, (event_id % 100) * 9.0::DOUBLE - 18 AS y1,
  CASE WHEN event_type <> 'view' THEN value / 100 END AS conf FROM events"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    v, y = F.col("value"), (F.col("event_id") % 100) * F.lit(9.0)
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value", (v * 10 - 50).alias("x0"), (y - 30).alias("y0"), (v * 10 - 20).alias("x1"), (y - 18).alias("y1"),
        F.when(F.col("event_type") != "view", v / 100).alias("conf"))


_ON_PAGE_SQL = "((x0 + x1) / 2 BETWEEN -2 AND 614 AND (y0 + y1) / 2 BETWEEN -2 AND 794)"


def _on_page() -> Column:
    return guards.on_page(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(612.0), F.lit(792.0))


@query(f"SELECT user_id, count(*) FILTER ({_ON_PAGE_SQL}) AS kept, count(*) FILTER (NOT {_ON_PAGE_SQL}) AS dropped FROM ({_WORDS_SQL}) GROUP BY 1")
def ocr_guard_offpage(spark, d):
    return guards.kept_and_dropped(_words(spark, d), ["user_id"], _on_page())


@query(f"SELECT user_id, count(*) FILTER (conf IS NULL OR conf >= 0.5) AS kept, count(*) FILTER (conf < 0.5) AS dropped FROM ({_WORDS_SQL}) GROUP BY 1")
def ocr_guard_confidence(spark, d):
    return guards.kept_and_dropped(_words(spark, d), ["user_id"], guards.confident(F.col("conf")))


@query(f"""
WITH w AS ({_WORDS_SQL}), o AS (SELECT *, event_id % 3 AS page FROM w WHERE event_type <> 'view'), b AS (SELECT *, event_id % 3 AS page FROM w WHERE event_type = 'view'),
f AS (SELECT *, EXISTS (SELECT 1 FROM b WHERE b.user_id = o.user_id AND b.page = o.page AND o.x0 <= b.x1 AND b.x0 <= o.x1 AND o.y0 - 60 <= b.y1 AND b.y0 <= o.y1 + 60) AS touches FROM o)
SELECT event_id, user_id, page FROM (SELECT *, count(*) FILTER (NOT touches) OVER (PARTITION BY user_id, page) >= 8 AS many FROM f) WHERE touches OR many""")
def ocr_graphic_orphans(spark, d):
    w = _words(spark, d).withColumn("page", F.col("event_id") % 3)
    o = w.where("event_type <> 'view'")
    b = w.where("event_type = 'view'").select("user_id", "page", *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1")], (F.col("y0") - 60).alias("b_y0"), (F.col("y1") + 60).alias("b_y1"))
    o = o.select("event_id", "user_id", "page", *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    return guards.without_graphics(o, b, ["user_id", "page"], geometry.overlaps("o", "b")).select("event_id", "user_id", "page")


@query(f"""
SELECT user_id, count(*) FILTER (k = 'offpage') AS offpage_dropped, count(*) FILTER (k = 'low_confidence') AS low_conf_dropped, count(*) FILTER (k IN ('agree', 'mismatch')) AS matched,
  count(*) FILTER (k = 'agree') AS agree, count(*) FILTER (k = 'mismatch') AS mismatch, count(*) FILTER (k IN ('agree', 'mismatch', 'embedded_only', 'ocr_only')) AS compared
FROM (SELECT user_id, CASE WHEN NOT {_ON_PAGE_SQL} THEN 'offpage' WHEN conf < 0.5 THEN 'low_confidence' WHEN event_type = 'purchase' THEN 'mismatch' WHEN event_type = 'click' THEN 'ocr_only'
  WHEN event_type = 'view' THEN 'embedded_only' ELSE 'agree' END AS k FROM ({_WORDS_SQL})) GROUP BY 1""")
def ocr_diagnostics(spark, d):
    t = F.col("event_type")
    kind = F.when(~_on_page(), "offpage").when(~guards.confident(F.col("conf")), "low_confidence").when(t == "purchase", "mismatch").when(t == "click", "ocr_only").when(t == "view", "embedded_only").otherwise("agree")
    return guards.diagnostics(_words(spark, d).withColumn("kind", kind), ["user_id"])


_BAG_SQL = "list_sort(list_transform({}, lambda w: " + _FOLD_SQL.format("w") + "))"
_TURN_SQL = _SPLIT_SQL.format("text")


@query(f"""SELECT conv_id, turn, len(a) > 1 AND {_BAG_SQL.format('a')} = {_BAG_SQL.format('b')} AS same
FROM (SELECT conv_id, turn, w AS a, list_concat(w[3:], CASE WHEN turn % 3 = 0 THEN w[1:1] ELSE w[1:2] END) AS b FROM (SELECT *, {_TURN_SQL} AS w FROM conversations))""")
def ocr_same_bag(spark, d):
    w = text.tokens("text")
    moved = F.concat(F.slice(w, 3, 1 << 20), F.when(F.col("turn") % 3 == 0, F.slice(w, 1, 1)).otherwise(F.slice(w, 1, 2)))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.array_join(w, " ").alias("a"), F.array_join(moved, " ").alias("b"))
    return rows.select("conv_id", "turn", matching.same_bag(F.col("a"), F.col("b")).alias("same"))


@query(f"""
SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY (y0 + y0 + 10) / 2, (x0 + x0 + 40) / 2, l_returnflag || l_linenumber) AS text
FROM (SELECT *, floor(l_quantity / 10) * 12 AS y0, l_discount * 1000 AS x0 FROM lineitem) GROUP BY 1""")
def ocr_reading_order(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"y0": F.floor(F.col("l_quantity") / 10) * 12, "x0": F.col("l_discount") * 1000, "t": F.concat("l_returnflag", "l_linenumber")})
    return layout.reading_order(rows, ["l_orderkey"], (F.col("y0") + F.col("y0") + 10) / 2, (F.col("x0") + F.col("x0") + 40) / 2, "t")


def _high_sql(words: str) -> str:
    return f"list_filter({words}, lambda w: {_KIND_SQL} <> 'none')"


@query(rf"""
WITH t AS (SELECT doc_id, text AS glyph, array_to_string(list_filter({_SPLIT_SQL.format('text')}, lambda w: length(w) < 4 + doc_id % 12), ' ') AS prim FROM documents)
SELECT doc_id, length(regexp_replace(glyph, '[ \t\n\x0B\f\r]', '', 'g')) >= 20 AND (length(regexp_replace(prim, '[ \t\n\x0B\f\r]', '', 'g')) < 0.5 * length(regexp_replace(glyph, '[ \t\n\x0B\f\r]', '', 'g'))
  OR len(list_filter({_high_sql(_SPLIT_SQL.format('glyph'))}, lambda x: NOT list_contains({_SPLIT_SQL.format('prim')}, x))) > 0) AS incomplete FROM t""")
def extract_incomplete(spark, d):
    w, high = text.tokens("text"), lambda a: F.filter(a, lambda x: text.kind(x).isNotNull())
    rows = table(spark, d, "documents").select("doc_id", "text", w.alias("g"), F.filter(w, lambda x: F.length(x) < 4 + F.col("doc_id") % 12).alias("p"))
    return rows.select("doc_id", guards.looks_incomplete(text.non_space_length(F.array_join("p", " ")), text.non_space_length("text"), high(F.col("p")), high(F.col("g"))).alias("incomplete"))


# -- boxes and tables ---------------------------------------------------------------------------------------------

@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + 5) AS x1, max(l_discount + l_tax) AS y1 FROM lineitem GROUP BY 1")
def geo_token_box(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").select("l_orderkey", c("l_quantity").alias("x0"), c("l_discount").alias("y0"), (c("l_quantity") + 5).alias("x1"), (c("l_discount") + c("l_tax")).alias("y1"))
    return layout.union_box(rows, ["l_orderkey"])


@query("""SELECT p_partkey, least(s, s + 10, r) AS x0, least(r, s) AS y0, greatest(s, s + 10, r) AS x1, greatest(r, s) AS y1 FROM (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice % 97 AS r FROM part)""")
def geo_quad_box(spark, d):
    s, r = F.col("p_size").cast("double"), F.col("p_retailprice") % 97
    point = lambda x, y: F.array(x, y)
    box = geometry.quad_to_box(F.array(point(s, r), point(s + 10, s), point(r, r), point(s, s)))
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


@query("""SELECT p_partkey, x * 612 * (300 / 72.0::DOUBLE) AS x0, y * 792 * (300 / 72.0::DOUBLE) AS y0 FROM (SELECT p_partkey, p_size / 100.0::DOUBLE AS x, p_size / 200.0::DOUBLE AS y FROM part)""")
def geo_pixels(spark, d):
    x, y = F.col("p_size") / 100.0, F.col("p_size") / 200.0
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 0.1).alias("x1"), (y + 0.1).alias("y1"))
    rows = table(spark, d, "part").select("p_partkey", geometry.to_pixels(box, 300.0, F.lit(612.0), F.lit(792.0)).alias("b"))
    return rows.select("p_partkey", F.round("b.x0", 6).alias("x0"), F.round("b.y0", 6).alias("y0"))


@query("""SELECT p_partkey, l_orderkey, l_linenumber, a0 - 2 <= b0 + 5 AND b0 <= a0 + 10 + 2 AS touches
FROM (SELECT p_partkey, l_orderkey, l_linenumber, p_size::DOUBLE AS a0, l_quantity AS b0 FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def geo_margin_overlap(spark, d):
    a, b, zero = F.col("p_size").cast("double"), F.col("l_quantity"), F.lit(0.0)
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumns({"a_x0": a, "a_x1": a + 10, "b_x0": b, "b_x1": b + 5, "a_y0": zero, "a_y1": zero, "b_y0": zero, "b_y1": zero})
    return rows.select("p_partkey", "l_orderkey", "l_linenumber", geometry.overlaps("a", "b", 2.0).alias("touches"))


_TOKEN_SQL = "CASE WHEN l_returnflag = 'N' THEN l_linestatus ELSE printf('%d', l_partkey) END"


@query(f"""
SELECT l_orderkey, col, string_agg(t, ' ' ORDER BY l_discount, t) AS text, CASE WHEN count(v) = 1 THEN max(v) END AS value
FROM (SELECT l_orderkey, l_linenumber % 3 AS col, l_discount, {_TOKEN_SQL} AS t, CASE WHEN l_returnflag <> 'N' THEN l_partkey::DOUBLE END AS v FROM lineitem) GROUP BY 1, 2""")
def table_cells(spark, d):
    t = F.when(F.col("l_returnflag") == "N", F.col("l_linestatus")).otherwise(F.format_string("%d", F.col("l_partkey")))
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("col"), F.col("l_discount").alias("x"), t.alias("t"), text.parse_amount(t).alias("v"))
    return layout.row_cells(rows, ["l_orderkey", "col"], "x", "t", "v")


@query("""
SELECT l_orderkey, l_linenumber, n, k, last_value(s IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, n, k ROWS UNBOUNDED PRECEDING) AS columns, s IS NULL AS inferred
FROM (SELECT l_orderkey, l_linenumber, l_partkey AS n, l_suppkey AS k, CASE WHEN l_returnflag = 'A' THEN 'qty,rate,' || l_linestatus END AS s FROM lineitem)""")
def table_continued(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("n"), F.col("l_suppkey").alias("k"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("qty,rate,"), "l_linestatus")).alias("s"))
    return layout.inferred_table(rows, ["l_orderkey"], ["l_linenumber", "n", "k"], "s").drop("s")


@query(f"""
SELECT doc_id, len(w) AS n, md5(array_to_string(list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_concat(w[greatest(i - 3, 1):i - 1], w[i + 1:i + 3]), ' ')), '|')) AS near
FROM (SELECT doc_id, {_SPLIT_SQL.format('text')} AS w FROM documents)""")
def token_window(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.tokens("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join(layout.context_window(F.col("w")), "|")).alias("near"))


_LINE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Grand Total' WHEN '2-HIGH' THEN 'Sub Total' WHEN '3-MEDIUM' THEN 'Total GST 9' WHEN '5-LOW' THEN 'Notes' ELSE 'CGST' END"


@query(f"""
SELECT o_orderkey, role, CASE role WHEN 'grand_total' THEN 'Grand Total' WHEN 'subtotal' THEN 'Sub Total' ELSE 'CGST' END AS role_label, printf('%d', o_custkey) AS text, o_custkey::DOUBLE AS value
FROM (SELECT *, CASE {_LINE_SQL} WHEN 'Grand Total' THEN 'grand_total' WHEN 'Sub Total' THEN 'subtotal' WHEN 'CGST' THEN 'cgst' END AS role FROM orders) WHERE role IS NOT NULL""")
def inv_summary_lines(spark, d):
    p = F.col("o_orderpriority")
    label = F.when(p == "1-URGENT", "Grand Total").when(p == "2-HIGH", "Sub Total").when(p == "3-MEDIUM", "Total GST 9").when(p == "5-LOW", "Notes").otherwise("CGST")
    rows = table(spark, d, "orders").select("o_orderkey", F.split(F.concat_ws(" ", label, F.format_string("%d", F.col("o_custkey"))), " ").alias("tokens"))
    return invoices.summary_cells(rows, ["o_orderkey"])


@query("""SELECT o_orderkey, contains(regexp_replace(lower(label), '[^a-z0-9]', '', 'g'), 'page') AS of_page FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Pa ge' ELSE 'Sub' END || ' total ' || o_orderpriority AS label FROM orders)""")
def inv_page_label(spark, d):
    label = F.concat(F.when(F.col("o_orderstatus") == "F", "Pa ge").otherwise("Sub"), F.lit(" total "), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", invoices.is_page_subtotal(label).alias("of_page"))


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS numeric_cells, count(*) FILTER (l_returnflag <> 'N' AND l_tax <= 0.04) AS reconciled, count(*) FILTER (l_returnflag <> 'N' AND l_tax > 0.04) AS broken FROM lineitem GROUP BY 1""")
def arith_cell_counts(spark, d):
    shown = F.when(F.col("l_returnflag") == "N", "see note").otherwise(F.format_string("%d", F.col("l_partkey")))
    number, fits = text.parse_amount(shown).isNotNull(), F.col("l_tax") <= 0.04
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(number).alias("numeric_cells"), F.count_if(number & fits).alias("reconciled"), F.count_if(number & ~fits).alias("broken"))


# -- versions, objects --------------------------------------------------------------------------------------------

@query("""
WITH v AS (SELECT conv_id, turn, text FROM conversations), p AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, coalesce(a.text, '') AS x, coalesce(b.text, '') AS y, a.conv_id IS NULL OR b.conv_id IS NULL AS u
  FROM v a FULL JOIN (SELECT conv_id - 1 AS conv_id, turn, text FROM v) b ON a.conv_id = b.conv_id AND a.turn = b.turn)
SELECT conv_id, count(*) AS pages, count(*) FILTER (x <> y) AS changed_pages, bool_or(x <> y) AS changed, bool_or(u) AS page_count_changed FROM p GROUP BY 1""")
def ver_pages(spark, d):
    v = table(spark, d, "conversations").select("conv_id", "turn", "text")
    pages = versions.join_pages(v, v.withColumn("conv_id", F.col("conv_id") - 1), ["conv_id"], "turn", "text")
    return pages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("changed").alias("changed_pages"), F.bool_or("changed").alias("changed"), F.bool_or("unpaired").alias("page_count_changed"))


@query(f"""
SELECT conv_id, CASE min(CASE {_KIND_SQL} WHEN 'amount' THEN 0 WHEN 'date' THEN 1 WHEN 'id_like' THEN 2 END) WHEN 0 THEN 'amount' WHEN 1 THEN 'date' WHEN 2 THEN 'id_like' END AS best
FROM (SELECT conv_id, unnest({_TURN_SQL}) AS w FROM conversations) GROUP BY 1""")
def ver_best_kind(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.explode(text.tokens("text")).alias("w"))
    return versions.best_kind(rows.select("conv_id", text.kind("w").alias("kind")), ["conv_id"])


@query("""
SELECT c_custkey, v IS NULL OR lower(trim(v, ' ')) = 'null' OR trim(v, ' ') IN ('', '()', '/') AS unfilled, v IS NOT DISTINCT FROM w AS same
FROM (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '()' WHEN 2 THEN ' / ' WHEN 3 THEN 'NULL' WHEN 4 THEN '  ' ELSE c_mktsegment END AS v, CASE WHEN c_custkey % 14 >= 6 THEN c_mktsegment END AS w FROM customer)""")
def obj_values(spark, d):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    v = F.when(k % 7 == 0, None).when(k % 7 == 1, "()").when(k % 7 == 2, " / ").when(k % 7 == 3, "NULL").when(k % 7 == 4, "  ").otherwise(s)
    same = objects.value_signature(v).eqNullSafe(objects.value_signature(F.when(k % 14 >= 6, s)))
    return table(spark, d, "customer").select("c_custkey", objects.unfilled(v).alias("unfilled"), same.alias("same"))


_OBJECTS_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber = 7 AS sig, k % 11 = 1 AS form, CASE WHEN k % 2 = 0 THEN l_returnflag END AS o, CASE WHEN k % 3 > 0 THEN l_linestatus ELSE '()' END AS n,
  CASE k % 9 WHEN 0 THEN '/Sig' WHEN 1 THEN '/Annot' WHEN 2 THEN '/Page' WHEN 3 THEN '/Pages' WHEN 4 THEN '/ObjStm' END AS type, CASE k % 5 WHEN 0 THEN '/Stamp' WHEN 1 THEN '/Form' WHEN 2 THEN '/XML' END AS sub,
  k % 7 > 4 AS stream, CASE WHEN k % 13 = 0 THEN k % 4 END AS ap, CASE WHEN k % 17 = 0 THEN k % 5 END AS cp, k % 3 AS pg, l_tax > 0.04 AS hit, k % 4 = 0 AS touched, k % 19 = 0 AS meta
  FROM (SELECT *, (l_partkey + l_suppkey)::INT AS k FROM lineitem)"""
_CHANGE_SQL = f"""SELECT *, CASE WHEN sig OR (NOT stream AND type = '/Sig') THEN 'signature'
  WHEN form AND o IS DISTINCT FROM n THEN CASE WHEN o IS NULL AND n <> '()' THEN 'form_fill' ELSE 'field_edit' END
  WHEN ap IS NOT NULL OR (NOT stream AND type = '/Annot') THEN CASE WHEN sub = '/Stamp' OR (ap IS NOT NULL AND hit) THEN 'overlay' ELSE 'markup' END
  WHEN cp IS NOT NULL THEN 'content' WHEN NOT stream AND type = '/Page' AND touched THEN 'content' WHEN stream AND sub = '/Form' THEN 'content'
  WHEN meta OR (stream AND (sub = '/XML' OR type = '/ObjStm')) OR (NOT stream AND type = '/Pages') THEN 'meta' WHEN NOT stream AND type = '/Page' THEN 'markup' ELSE 'content' END AS change FROM ({_OBJECTS_SQL})"""
_CHANGED_SQL = f"""SELECT *, CASE WHEN change IN ('signature', 'form_fill', 'field_edit', 'meta') THEN NULL WHEN ap IS NOT NULL THEN ap WHEN NOT stream AND type = '/Annot' THEN NULL WHEN change = 'content' AND cp IS NOT NULL THEN cp
  WHEN change = 'content' AND NOT stream AND type = '/Page' AND touched THEN pg END AS page FROM ({_CHANGE_SQL})"""


def _changes(spark, d):
    k = (F.col("l_partkey") + F.col("l_suppkey")).cast("int")

    def case(m, names):
        return reduce(lambda w, x: w.when(k % m == x[0], x[1]), names.items(), F)

    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") == 7).alias("signature"), (k % 11 == 1).alias("form"), F.when(k % 2 == 0, F.col("l_returnflag")).alias("old_value"),
        F.when(k % 3 > 0, F.col("l_linestatus")).otherwise("()").alias("new_value"), case(9, {0: "/Sig", 1: "/Annot", 2: "/Page", 3: "/Pages", 4: "/ObjStm"}).alias("type"),
        case(5, {0: "/Stamp", 1: "/Form", 2: "/XML"}).alias("subtype"), (k % 7 > 4).alias("is_stream"), F.when(k % 13 == 0, k % 4).alias("annot_page"), F.when(k % 17 == 0, k % 5).alias("content_page"),
        (k % 3).alias("page_no"), (F.col("l_tax") > 0.04).alias("overlaps"), (k % 4 == 0).alias("contents_changed"), (k % 19 == 0).alias("metadata"))
    return objects.classify(rows)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, change, page FROM ({_CHANGED_SQL})")
def obj_classes(spark, d):
    return _changes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "change", "page")


@query(f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(change))), ',') AS classes FROM ({_CHANGED_SQL}) GROUP BY 1")
def obj_class_sets(spark, d):
    return objects.class_sets(_changes(spark, d), ["l_orderkey"]).select("l_orderkey", F.array_join("classes", ",").alias("classes"))


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def obj_written(spark, d):
    rows = table(spark, d, "lineitem")
    return objects.written([rows.where("l_returnflag = 'A'"), rows.where("l_linestatus = 'F'")], ["l_orderkey", "l_partkey"])


@query(f"""
WITH c AS ({_CHANGED_SQL}), t AS (SELECT DISTINCT l_orderkey, l_linenumber % 3 AS page FROM lineitem WHERE l_orderkey % 3 > 0 AND l_discount > 0.06),
k AS (SELECT l_orderkey, page, l_partkey::VARCHAR AS object FROM c WHERE change = 'content')
SELECT t.l_orderkey, 'text' AS kind, t.page, coalesce(array_to_string(list_sort(list_distinct(list(object) FILTER (object IS NOT NULL))), ','), '') AS objects FROM t LEFT JOIN k ON t.l_orderkey = k.l_orderkey AND (k.page IS NULL OR k.page = t.page) GROUP BY 1, 3
UNION ALL SELECT l_orderkey, change, page, l_partkey::VARCHAR FROM c WHERE change IN ('overlay', 'field_edit', 'form_fill')
UNION ALL SELECT l_orderkey, 'content_without_text', page, object FROM k WHERE l_orderkey NOT IN (SELECT l_orderkey FROM t)""")
def rev_findings(spark, d):
    texts = table(spark, d, "lineitem").where("l_orderkey % 3 > 0 AND l_discount > 0.06").select("l_orderkey", (F.col("l_linenumber") % 3).alias("page")).distinct()
    changes = _changes(spark, d).withColumn("object", F.col("l_partkey").cast("string"))
    return objects.revision_findings(texts, changes, ["l_orderkey"]).withColumn("objects", F.array_join("objects", ","))


# -- bytes --------------------------------------------------------------------------------------------------------

#: Texts as files: perhaps a header, the text, up to three closed increments, perhaps an end marker inside a stream.
_FILES_SQL = "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN 9 ELSE 0 END + strlen(coalesce(text, '')) + 1 AS h, doc_id % 4 AS k, doc_id % 3 = 0 AS fake FROM documents"
_CLOSED = 29  # bytes of a closed increment


def _files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.when(i % 5 > 0, "%PDF-1.4\n").otherwise(""), F.coalesce("text", F.lit("")), F.lit("\n")).alias("t"))
    closed = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.when(n < i % 4, F.concat(F.lit("/Prev "), (n + 17).cast("string"), F.lit("\nstartxref "), (n + 101).cast("string"), F.lit("\n%%EOF\n"))).otherwise(""))
    content = F.concat("t", F.array_join(closed, ""), F.when(i % 3 == 0, "q %%EOF\n").otherwise(""))
    return rows.select("doc_id", i.cast("string").alias("path"), content.cast("binary").alias("content"))


@query(f"""SELECT doc_id, h + {_CLOSED} * k + CASE WHEN fake THEN 8 ELSE 0 END AS size, k AS valid, fake::INT::BIGINT AS invalid, 1 + (doc_id % 5 = 0)::INT + (k > 0 AND fake)::INT + (k = 0 AND fake)::INT::BIGINT AS notes FROM ({_FILES_SQL})""")
def rev_detect(spark, d):
    got = pdf_bytes.detected(_files(spark, d))
    return got.select(F.col("path").cast("long").alias("doc_id"), F.col("size").cast("long").alias("size"), "valid", "invalid", F.size("notes").cast("long").alias("notes"))


@query(f"""
SELECT doc_id, n AS idx, h + {_CLOSED} * n + 23 AS off, h + {_CLOSED} * (n + 1) AS end_off, CASE WHEN n = 0 THEN 0 ELSE h + {_CLOSED} * n END AS from_off, (101 + n)::VARCHAR AS startxref, (17 + n)::VARCHAR AS prev, TRUE AS valid
FROM (SELECT *, unnest(range(k)) AS n FROM ({_FILES_SQL}))
UNION ALL SELECT doc_id, k, h + {_CLOSED} * k + 2, h + {_CLOSED} * k + 8, CASE WHEN k = 0 THEN 0 ELSE h + {_CLOSED} * k END, NULL, NULL, FALSE FROM ({_FILES_SQL}) WHERE fake""")
def rev_pointers(spark, d):
    got = pdf_bytes.file_boundaries(_files(spark, d))
    return got.select(F.col("path").cast("long").alias("doc_id"), F.col("idx").cast("long").alias("idx"), "off", "end_off", "from_off", "startxref", "prev", "valid")


def _tables(spark, d):
    """Texts as files with one classic table each; a quarter of their pointers lie beside it."""
    i, t = F.col("doc_id"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    n = (i % 50).cast("string")
    at = (F.octet_length(t) + F.when(i % 4 == 0, 1).otherwise(0)).cast("string")
    content = F.concat(t, F.lit("xref\n"), n, F.lit(" 2\n0000000009 00000 n \n0000000020 00003 n \ntrailer\nstartxref "), at, F.lit("\n%%EOF\n"))
    return table(spark, d, "documents").select(i.cast("string").alias("path"), content.cast("binary").alias("content"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE (doc_id % 50) || ' 0,' || (doc_id % 50 + 1) || ' 3' END AS objects FROM documents")
def rev_objects(spark, d):
    return pdf_bytes.revisions(_tables(spark, d)).select(F.col("path").cast("long").alias("doc_id"), F.array_join("objects", ",").alias("objects"))


@query(r"""
SELECT doc_id, h + strlen((doc_id % 50)::VARCHAR) + strlen((h + (doc_id % 4 = 0)::INT)::VARCHAR) + strlen('xref. 2.' || repeat('0000000009 00000 n .', 2) || 'trailer.startxref .%%EOF.') AS truncate_len, doc_id % 4 = 0 AS failed,
  CASE WHEN doc_id % 4 > 0 THEN 0::BIGINT END AS idx FROM (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS h FROM documents)""")
def rev_reconstruct(spark, d):
    got = pdf_bytes.reconstructed(_tables(spark, d))
    return got.select(F.col("path").cast("long").alias("doc_id"), "truncate_len", F.col("reason").isNotNull().alias("failed"), F.col("idx").cast("long").alias("idx"))


@query("""SELECT stage, FALSE AS ok, 'inconclusive' AS tier, NULL::INT AS score, 'file not found' AS error FROM (VALUES ('fonts'), ('revisions')) AS s(stage)""")
def scan_failed(spark, d):
    return scans.stage_rows(scans.requested(spark, [f"{d}/no such file.pdf"]), ["fonts", "revisions"])[1].drop("requested")


# -- findings -----------------------------------------------------------------------------------------------------

@query("""
WITH n AS (SELECT o_custkey, 'F' || o_orderstatus AS font, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2)
SELECT o_custkey, font FROM (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS t FROM n) WHERE t >= 5 AND n >= 0.8 * t""")
def font_form_data(spark, d):
    p = F.col("o_orderpriority")
    rows = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("F"), "o_orderstatus").alias("font"), F.when(p == "1-URGENT", "amount").when(p == "2-HIGH", "date").when(p == "5-LOW", "id_like").alias("kind"))
    return fonts.form_data_fonts(rows, ["o_custkey"], "font", "kind")


@query("""
SELECT o_orderkey, CASE WHEN g < 2 OR f <= 1 THEN 'inconclusive' WHEN a OR b THEN 'high' WHEN c THEN 'medium' ELSE 'low' END AS tier,
  CASE WHEN g < 2 OR f <= 1 THEN NULL WHEN a THEN 95 WHEN b THEN 80 WHEN c THEN 45 ELSE 15 END AS score
FROM (SELECT o_orderkey, o_custkey % 50 AS g, o_custkey % 4 AS f, o_orderpriority = '1-URGENT' AS a, o_orderpriority = '2-HIGH' AS b, o_orderpriority = '3-MEDIUM' AS c FROM orders)""")
def font_score(spark, d):
    p = F.col("o_orderpriority")
    tier, score = detectors.font_score(F.col("o_custkey") % 50, F.col("o_custkey") % 4, {"high_value": p == "1-URGENT", "high_id": p == "2-HIGH", "baseline": p == "3-MEDIUM"})
    return table(spark, d, "orders").select("o_orderkey", tier.alias("tier"), score.alias("score"))


@query("""
SELECT o_orderkey, CASE WHEN w THEN 'medium' ELSE 'low' END AS tier, CASE WHEN w AND b THEN 55 WHEN w THEN 45 WHEN b THEN 20 ELSE 0 END AS score
FROM (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS w, o_orderstatus = 'P' AS b FROM orders)""")
def prov_score_of_metadata(spark, d):
    none = F.lit(None).cast("string")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "Sejda 5").otherwise("a press").alias("producer"), F.when(F.col("o_orderstatus") == "P", "Mozilla/5.0 Chrome").otherwise("writer").alias("creator"),
        *[none.alias(c) for c in ("creation_date", "mod_date", "xmp_producer", "id_first", "id_second")])
    return detectors.provenance_score(rows).withColumnRenamed("doc_id", "o_orderkey")


_RELATIONS_SQL = "SELECT *, l_tax <= 0.02 AS within, l_linenumber % 3 + 1 AS conv FROM lineitem"


def _broken(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"within": F.col("l_tax") <= 0.02, "convergence": F.col("l_linenumber") % 3 + 1, "stated": F.when(F.col("l_returnflag") == "N", "as is").otherwise(F.format_string("%d", F.col("l_partkey")))})
    return findings.arithmetic(rows)


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tier, high_value, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier = 'high' DESC, conv DESC, l_linenumber, l_quantity, l_partkey, l_suppkey) AS place
FROM (SELECT *, CASE WHEN conv >= 2 THEN 'high' ELSE 'medium' END AS tier, CASE WHEN l_returnflag <> 'N' THEN 'amount' END AS high_value FROM ({_RELATIONS_SQL}) WHERE NOT within)""")
def arith_findings(spark, d):
    order = [*findings.arithmetic_order(page="l_linenumber", x0="l_quantity"), "l_partkey", "l_suppkey"]
    return findings.ordered(_broken(spark, d), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tier", "high_value", "place")


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, conv >= 2 DESC, l_quantity, l_partkey, l_suppkey) AS place FROM ({_RELATIONS_SQL}) WHERE NOT within""")
def font_order(spark, d):
    order = [*findings.font_order(page="l_linenumber", x0="l_quantity"), "l_partkey", "l_suppkey"]
    return findings.ordered(_broken(spark, d), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "place")


@query(f"""
SELECT stage, tier, coalesce(high_value, 'none') AS high_value, count(*) AS n, count(page) AS paged, sum(len(object_ids)) AS objects FROM (
  SELECT 'arithmetic' AS stage, CASE WHEN conv >= 2 THEN 'high' ELSE 'medium' END AS tier, CASE WHEN l_returnflag <> 'N' THEN 'amount' END AS high_value, l_linenumber AS page, NULL::VARCHAR[] AS object_ids FROM ({_RELATIONS_SQL}) WHERE NOT within
  UNION ALL SELECT 'revision', CASE WHEN change = 'content' THEN 'high' ELSE 'medium' END, NULL, page, [l_partkey::VARCHAR] FROM ({_CHANGED_SQL}) WHERE change <> 'meta') GROUP BY 1, 2, 3""")
def stage_findings(spark, d):
    a = findings.adapt(_broken(spark, d), ["l_orderkey"], "arithmetic", {"tier": F.col("tier"), "high_value": F.col("high_value"), "page": F.col("l_linenumber"), "before": F.col("stated")})
    c = _changes(spark, d).where("change <> 'meta'")
    b = findings.adapt(c, ["l_orderkey"], "revision", {"tier": F.when(F.col("change") == "content", "high").otherwise("medium"), "page": F.col("page"), "object_ids": F.array(F.col("l_partkey").cast("string"))})
    return a.unionByName(b).groupBy("stage", "tier", F.coalesce("high_value", F.lit("none")).alias("high_value")).agg(
        F.count(F.lit(1)).alias("n"), F.count("page").alias("paged"), F.sum(F.when(F.col("object_ids").isNotNull(), F.size("object_ids")).cast("long")).alias("objects"))


_FINDINGS_SQL = """SELECT event_id, user_id, event_type AS kind, CASE WHEN event_id % 4 > 0 THEN CASE WHEN value >= 50 THEN 'amount' ELSE 'date' END END AS cls, CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS page, CASE WHEN event_id % 3 > 0 THEN value END AS x0 FROM events"""


def _findings(spark, d):
    i, v = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select(
        "event_id", "user_id", F.col("event_type").alias("kind"), F.when(i % 4 > 0, F.when(v >= 50, "amount").otherwise("date")).alias("cls"), F.when(i % 5 > 0, i % 3).alias("page"), F.when(i % 3 > 0, v).alias("x0"))


@query(f"SELECT event_id, user_id, page, x0 FROM ({_FINDINGS_SQL}) WHERE page IS NOT NULL AND x0 IS NOT NULL")
def rollup_localizable(spark, d):
    return findings.localizable(_findings(spark, d), "x0").select("event_id", "user_id", "page", "x0")


@query(f"SELECT user_id, kind, coalesce(cls, '') AS cls, count(*) AS n FROM ({_FINDINGS_SQL}) GROUP BY 1, 2, 3")
def rollup_shown_groups(spark, d):
    return findings.shown_groups(_findings(spark, d), ["user_id"], "kind", "cls")


@query(f"""SELECT event_id, CASE kind WHEN 'purchase' THEN 'a value differs' WHEN 'click' THEN 'a word is only in the picture' ELSE 'a sign of an edit' END AS meaning,
  CASE kind WHEN 'purchase' THEN 'compare both' WHEN 'click' THEN 'look at it' ELSE 'review it' END AS implication FROM ({_FINDINGS_SQL})""")
def rollup_glossary(spark, d):
    entries = spark.createDataFrame([("purchase", "a value differs", "compare both"), ("click", "a word is only in the picture", "look at it")], "type string, meaning string, implication string")
    return findings.explain(_findings(spark, d), entries, "kind", ("a sign of an edit", "review it")).select("event_id", "meaning", "implication")


@query(f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM ({_FINDINGS_SQL}) WHERE kind <> 'view'),
p AS (SELECT user_id, event_id AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM ({_FINDINGS_SQL}) WHERE kind <> 'click')
SELECT f.event_id, payload FROM f LEFT JOIN p USING (user_id, k)""")
def rollup_payload(spark, d):
    rows = _findings(spark, d)
    f = rows.where("kind <> 'view'").withColumn("at", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1)
    p = rows.select("user_id", F.col("event_id").alias("payload"), "kind")
    return findings.with_payload(f.drop("kind"), p, ["user_id"], "at", ["payload"], F.col("kind") == "click").select("event_id", "payload")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok THEN least(q, t) END AS x0, CASE WHEN ok THEN greatest(q + 1, t + 2) END AS x1
FROM (SELECT *, l_returnflag <> 'R' AND l_linestatus = 'O' AND l_suppkey % 4 > 0 AND (q <> 0 OR t <> 0 OR TRUE) AS ok FROM (SELECT *, l_quantity - 10 AS q, l_tax * 100 AS t FROM lineitem))""")
def rollup_boxes(spark, d):
    q, t, zero = F.col("l_quantity") - 10, F.col("l_tax") * 100, F.lit(0.0)
    box = lambda a, b: F.struct(a.alias("x0"), zero.alias("y0"), b.alias("x1"), zero.alias("y1"))
    found = findings.guarded_box(F.array(box(q, q + 1), box(t, t + 2)), F.col("l_returnflag") != "R", F.col("l_linestatus") == "O", (F.col("l_suppkey") % 4).cast("double"), F.lit(792.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", found.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "b.x0", "b.x1")


@query("""
SELECT o_orderkey, o_orderkey NOT IN (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F')) AS grounded FROM orders""")
def advisory_citations(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return findings.uncited(table(spark, d, "orders").select("o_orderkey"), rows.where("l_returnflag = 'A'"), rows.where("l_linestatus = 'F'").select("o_orderkey", "l_partkey").distinct(), "o_orderkey", "l_partkey")


# -- display ------------------------------------------------------------------------------------------------------

@query("""
SELECT p_partkey, length(split_part(shown, '.', 2)) AS decimals, CASE WHEN r = floor(r) THEN r::BIGINT::VARCHAR ELSE printf('%.2f', r) END AS number,
  CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 11) || '…' ELSE p_name END AS short, upper(substr(lower(replace(p_type, '_', ' ')), 1, 1)) || substr(lower(replace(p_type, '_', ' ')), 2) AS human, TRUE AS money
FROM (SELECT *, printf('%.2f', p_retailprice) AS shown, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE p_size + 0.25 END AS r FROM part)""")
def text_display(spark, d):
    shown, size = F.format_string("%.2f", F.col("p_retailprice")), F.col("p_size")
    number = F.when(size % 2 == 0, size.cast("double")).otherwise(size + F.lit(0.25))
    return table(spark, d, "part").select(
        "p_partkey", text.displayed_decimals(shown).cast("long").alias("decimals"), text.format_number(number).alias("number"), text.truncate("p_name", 12).alias("short"), text.humanize("p_type").alias("human"),
        text.monetary_context(shown).alias("money"))


@query("""
SELECT user_id, CASE WHEN len(p) = 1 THEN 'page ' || (p[1] + 1) ELSE 'pages ' || (p[1] + 1) || '–' || (p[-1] + 1) END AS pages FROM (SELECT user_id, list_sort(list_distinct(list(event_id % 40))) AS p FROM events GROUP BY 1)""")
def text_page_range(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("event_id") % 40)).alias("p"))
    return rows.select("user_id", text.page_range("p").alias("pages"))
