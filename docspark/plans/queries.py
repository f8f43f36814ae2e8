"""One query per operator family over the driver's tables, each with SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import dates, fonts as font_names, geometry, numbers, provenance, text
from docspark.operators import detectors, equations, fonts, fusion, invoices, layout, matching, ocr, spatial, versions
from docspark.sources.scans import sniff_html, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ORDER_SQL = ", ".join(_LINE_ORDER)


# -- arithmetic ---------------------------------------------------------------------------------------------------

@query("""
SELECT l_orderkey, l_linenumber, l_partkey, e AS expected, l_extendedprice AS stated, round(l_extendedprice - e, 4) AS delta, w AS within,
       NOT w AND abs(l_extendedprice - e) / greatest(abs(e), 1e-9) >= 0.05 AS gross
FROM (SELECT *, abs(l_extendedprice - e) <= 0.05 OR abs(l_extendedprice - e) <= 0.005 * greatest(abs(e), 1e-9) AS w
      FROM (SELECT *, l_quantity * p_retailprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey))""")
def arith_line_item(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *equations.check(F.col("l_quantity") * F.col("p_retailprice"), F.col("l_extendedprice")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, rate, l_extendedprice >= least(a, b) - 0.05 AND l_extendedprice <= greatest(a, b) + 0.05 AS in_band
FROM (SELECT *, l_quantity * (rate - 0.005) AS a, l_quantity * (rate + 0.005) AS b
      FROM (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS rate FROM lineitem))""")
def arith_rate_band(spark, d):
    rows = table(spark, d, "lineitem").withColumn("rate", F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "rate", numbers.in_rate_band(F.col("l_quantity"), F.col("rate"), F.col("l_extendedprice"), F.lit(2)).alias("in_band"))


@query("""
SELECT o_orderkey, n, total AS expected, o_totalprice AS stated,
       abs(o_totalprice - total) <= 0.05 OR abs(o_totalprice - total) <= 0.005 * greatest(abs(total), 1e-9) AS within
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice::DECIMAL(28,6))::DOUBLE AS total FROM lineitem GROUP BY 1 HAVING count(*) >= 2)
  ON o_orderkey = l_orderkey""")
def arith_subtotal(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), equations.exact_sum(F.col("l_extendedprice")).alias("total")).where("n >= 2")
    rows = table(spark, d, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", "n", F.col("total").alias("expected"), F.col("o_totalprice").alias("stated"), numbers.within(F.col("total"), F.col("o_totalprice")).alias("within"))


_TOTALS = """SELECT l_orderkey, sum(l_extendedprice::DECIMAL(28,6))::DOUBLE AS subtotal, sum((l_extendedprice * l_discount)::DECIMAL(28,6))::DOUBLE AS discount,
       sum((l_extendedprice * l_tax)::DECIMAL(28,6))::DOUBLE AS tax, sum((l_extendedprice * l_tax / 2)::DECIMAL(28,6))::DOUBLE AS half FROM lineitem GROUP BY 1"""


def _totals(spark, d):
    p, s = F.col("l_extendedprice"), equations.exact_sum
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        s(p).alias("subtotal"), s(p * F.col("l_discount")).alias("discount"), s(p * F.col("l_tax")).alias("tax"), s(p * F.col("l_tax") / 2).alias("half"))


@query(f"""
SELECT l_orderkey, e AS expected, o_totalprice AS stated, abs(o_totalprice - e) <= 0.05 OR abs(o_totalprice - e) <= 0.005 * greatest(abs(e), 1e-9) AS within
FROM (SELECT *, subtotal - discount + tax AS e FROM ({_TOTALS}) JOIN orders ON o_orderkey = l_orderkey)""")
def arith_grand_total(spark, d):
    rows = _totals(spark, d).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = F.col("subtotal") - F.col("discount") + F.col("tax")
    return rows.select("l_orderkey", e.alias("expected"), F.col("o_totalprice").alias("stated"), numbers.within(e, F.col("o_totalprice")).alias("within"))


@query(f"""
SELECT l_orderkey, half + half AS expected, tax AS stated, abs(tax - 2 * half) <= 0.05 OR abs(tax - 2 * half) <= 0.005 * greatest(abs(2 * half), 1e-9) AS within FROM ({_TOTALS})""")
def arith_tax_parts(spark, d):
    e = F.col("half") + F.col("half")
    return _totals(spark, d).select("l_orderkey", e.alias("expected"), F.col("tax").alias("stated"), numbers.within(e, F.col("tax")).alias("within"))


@query("""
SELECT o_orderkey, c_acctbal AS deposit, balance, abs(o_totalprice - (c_acctbal + balance)) <= 0.05 OR abs(o_totalprice - (c_acctbal + balance)) <= 0.005 * greatest(abs(c_acctbal + balance), 1e-9) AS within
FROM (SELECT *, greatest(o_totalprice - c_acctbal, 0.0) AS balance FROM orders JOIN customer ON o_custkey = c_custkey)""")
def arith_deposit_balance(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("balance", F.greatest(F.col("o_totalprice") - F.col("c_acctbal"), F.lit(0.0)))
    return rows.select("o_orderkey", F.col("c_acctbal").alias("deposit"), "balance", numbers.within(F.col("c_acctbal") + F.col("balance"), F.col("o_totalprice")).alias("within"))


@query("""
WITH p AS (SELECT l_orderkey, l_linestatus, sum(l_extendedprice::DECIMAL(28,6)) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, count(*) AS pages, sum(s)::DOUBLE AS total, bool_and(n >= 2) AS checkable FROM p GROUP BY 1 HAVING count(*) >= 2""")
def arith_page_subtotal(spark, d):
    pages = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sum(F.col("l_extendedprice").cast("decimal(28,6)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return pages.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pages"), F.sum("s").cast("double").alias("total"), F.bool_and(F.col("n") >= 2).alias("checkable")).where("pages >= 2")


@query("SELECT l_orderkey, l_returnflag, min(l_linenumber) AS owner FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def arith_unique_owner(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("owner")).where("n = 1").drop("n")


@query("""
SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS duplicated FROM
  (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def arith_suppressed(spark, d):
    many = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), ",").alias("duplicated"))


#: Invoices made of orders: amounts as they should be, but one line a hundredfold in every 97th order, and subtotals
#: off by a hundredth in every 89th and by a fifth in every 83rd.
_INVOICE = f"""
x AS (SELECT l_orderkey, l_quantity * p_retailprice AS expected, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_SQL}) AS k
      FROM lineitem JOIN part ON l_partkey = p_partkey),
li AS (SELECT l_orderkey, expected, CASE WHEN k = 1 AND l_orderkey % 97 = 0 THEN expected * 100 ELSE expected END AS amount FROM x),
s AS (SELECT l_orderkey, count(*) AS n, sum(amount::DECIMAL(28,6))::DOUBLE AS total, sum(expected::DECIMAL(28,6))::DOUBLE AS e,
             count(*) FILTER (NOT (abs(amount - expected) <= 0.05 OR abs(amount - expected) <= 0.005 * greatest(abs(expected), 1e-9))) AS bad_lines FROM li GROUP BY 1),
t AS (SELECT o_orderkey, o_orderstatus, o_orderdate, coalesce(n, 0) AS n, coalesce(bad_lines, 0) AS bad_lines, total,
             e * CASE WHEN o_orderkey % 89 = 0 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN o_orderkey % 83 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS subtotal
      FROM orders LEFT JOIN s ON o_orderkey = l_orderkey),
u AS (SELECT *, n >= 2 AND NOT (abs(subtotal - total) <= 0.05 OR abs(subtotal - total) <= 0.005 * greatest(abs(total), 1e-9)) AS bad_sum,
             abs(subtotal - total) / greatest(abs(total), 1e-9) >= 0.05 AS far FROM t),
f AS (SELECT DISTINCT li.l_orderkey FROM li JOIN u ON li.l_orderkey = u.o_orderkey
      WHERE bad_sum AND NOT (abs(amount - expected) <= 0.05 OR abs(amount - expected) <= 0.005 * greatest(abs(expected), 1e-9))
        AND abs(total - amount + expected - subtotal) <= greatest(0.05, 1e-6 + 0.005 * abs(subtotal))),
a AS (SELECT u.*, bad_lines + bad_sum::INT AS broken, CASE WHEN bad_lines + bad_sum::INT = 0 THEN 0 WHEN f.l_orderkey IS NOT NULL THEN 2 ELSE 1 END AS convergence
      FROM u LEFT JOIN f ON f.l_orderkey = o_orderkey),
r AS (SELECT *, CASE WHEN 3 * n < 4 THEN 'inconclusive' WHEN broken = 0 THEN 'low' WHEN convergence >= 2 THEN 'high' ELSE 'medium' END AS tier,
             CASE WHEN 3 * n < 4 THEN NULL WHEN broken = 0 THEN 10 WHEN convergence >= 2 THEN 92 WHEN bad_lines > 0 OR (bad_sum AND far) THEN 65 ELSE 45 END AS score FROM a)"""


def _invoices(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    rows = rows.withColumn("expected", F.col("l_quantity") * F.col("p_retailprice")).withColumn("k", k)
    amount = F.when((F.col("k") == 1) & (F.col("l_orderkey") % 97 == 0), F.col("expected") * 100).otherwise(F.col("expected"))
    lines = rows.select(F.col("l_orderkey").alias("o_orderkey"), "expected", amount.alias("amount"))
    sums = lines.groupBy("o_orderkey").agg(equations.exact_sum(F.col("expected")).alias("e"))
    off = lambda n, x: F.when(F.col("o_orderkey") % n == 0, x).otherwise(1.0)
    totals = table(spark, d, "orders").select("o_orderkey").join(sums, "o_orderkey", "left").select("o_orderkey", (F.col("e") * off(89, 1.01) * off(83, 1.2)).alias("subtotal"))
    return equations.invoice_check(lines, totals, "o_orderkey")


@query(f"WITH {_INVOICE} SELECT o_orderkey, tier, score::INT AS score, broken::INT AS broken, convergence::INT AS convergence FROM r")
def arith_score(spark, d):
    return _invoices(spark, d)


@query(f"WITH {_INVOICE} SELECT o_orderkey, convergence::INT AS convergence FROM r WHERE broken > 0")
def arith_convergence(spark, d):
    return _invoices(spark, d).where("broken > 0").select("o_orderkey", "convergence")


# -- provenance ---------------------------------------------------------------------------------------------------

_PROVENANCE = """
p AS (SELECT o_orderkey, o_orderstatus = 'P' AS producer, coalesce(bool_or(l_shipdate > o_orderdate), false) AS dates
      FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus),
pr AS (SELECT o_orderkey, CASE WHEN producer AND dates THEN 'medium' ELSE 'low' END AS ptier,
              least(60, greatest(0, CASE WHEN producer THEN 35 ELSE 0 END, CASE WHEN dates THEN 25 ELSE 0 END, CASE WHEN producer AND dates THEN 55 ELSE 0 END)) AS pscore FROM p)"""


def _provenance(spark, d):
    late = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("l_shipdate") > F.col("o_orderdate"))
    late = late.groupBy("o_orderkey").agg(F.lit(True).alias("dates"))
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("producer")).join(late, "o_orderkey", "left").fillna(False, ["dates"])
    points = lambda c, n: F.when(c, n).otherwise(0)
    both = F.col("producer") & F.col("dates")
    return rows.select("o_orderkey", F.when(both, "medium").otherwise("low").alias("tier"), provenance.capped(points(F.col("producer"), 35), points(F.col("dates"), 25), points(both, 55)).alias("score"))


@query(f"WITH {_PROVENANCE} SELECT o_orderkey, ptier AS tier, pscore::INT AS score FROM pr")
def prov_score(spark, d):
    return _provenance(spark, d)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate > o_orderdate AS modified_after FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def prov_dates(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_shipdate") > F.col("o_orderdate")).alias("modified_after"))


_named = lambda c, names: "CASE " + " ".join(f"WHEN contains(lower({c}), '{n}') THEN '{n}'" for n in names) + " END"


@query(f"SELECT page_id, {_named('html', provenance.WEB_EDITORS)} AS editor, {_named('html', provenance.BROWSERS)} AS browser FROM pages")
def prov_matchers(spark, d):
    return table(spark, d, "pages").select("page_id", provenance.named_in(F.col("html"), provenance.WEB_EDITORS).alias("editor"), provenance.named_in(F.col("html"), provenance.BROWSERS).alias("browser"))


@query("SELECT o_orderkey, o_orderdate - INTERVAL 330 MINUTE AS parsed FROM orders")
def pdf_date_parse(spark, d):
    text_ = F.concat(F.lit("D:"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMddHHmmss"), F.lit("+05'30'"))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_pdf_date(text_).alias("parsed"))


# -- fusion -------------------------------------------------------------------------------------------------------

@query(f"""
WITH {_INVOICE}, {_PROVENANCE}
SELECT o_orderkey, CASE WHEN tier = 'high' OR (tier = 'medium' AND ptier = 'medium') THEN 'high' WHEN tier = 'medium' THEN 'medium' ELSE 'low' END AS tier,
  (CASE WHEN tier = 'high' THEN score WHEN tier = 'medium' AND ptier = 'medium' THEN least(100, greatest(70, score + 20)) WHEN tier IN ('medium', 'low') THEN score
        WHEN ptier = 'medium' THEN 15 ELSE pscore END)::INT AS score, 'invoice_arithmetic,provenance_metadata' AS stages
FROM r JOIN pr USING (o_orderkey)""")
def fuse_assessment(spark, d):
    a = _invoices(spark, d).select("o_orderkey", F.lit("invoice_arithmetic").alias("stage"), "tier", "score", F.lit(True).alias("ok"))
    p = _provenance(spark, d).select("o_orderkey", F.lit("provenance_metadata").alias("stage"), "tier", "score", F.lit(True).alias("ok"))
    return fusion.fuse(a.unionByName(p), "o_orderkey")


_TIER_SQL = "CASE WHEN value >= 100 THEN 'high' WHEN value >= 50 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'inconclusive' END"


def _event_findings(spark, d):
    v = F.col("value")
    tier = F.when(v >= 100, "high").when(v >= 50, "medium").when(v >= 10, "low").otherwise("inconclusive")
    return table(spark, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("stage"), tier.alias("tier"), (F.col("event_id") % 7).alias("page"))


_RANK_SQL = "CASE tier WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"""
WITH f AS (SELECT user_id, event_type AS stage, {_TIER_SQL} AS tier, event_id % 7 AS page FROM events)
SELECT user_id, stage, CASE max({_RANK_SQL}) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'inconclusive' END AS tier, count(*) AS n_findings,
       array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM f GROUP BY 1, 2""")
def rollup_groups(spark, d):
    return fusion.roll_up(_event_findings(spark, d), ["user_id", "stage"])


@query("SELECT event_id, event_type || '-' || (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) AS finding_id FROM events")
def rollup_ids(spark, d):
    return fusion.finding_ids(_event_findings(spark, d), "user_id", "stage", ["ts", "event_id"]).select("event_id", "finding_id")


@query(f"""SELECT event_type || '-' || (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) AS finding_id, event_type AS stage,
       {_TIER_SQL} AS tier, event_id % 7 AS page FROM events""")
def scrub_projection(spark, d):
    rows = fusion.finding_ids(_event_findings(spark, d), "user_id", "stage", ["ts", "event_id"])
    rows = rows.where(text.safe_token("finding_id") & text.safe_token("stage")).select("finding_id", "stage", "tier", "page")
    return fusion.project_allowed(rows)


@query("SELECT c_custkey, substr(sha256('salt' || c_name), 1, 12) AS hash FROM customer")
def safe_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.salted_hash("c_name", "salt").alias("hash"))


# -- text ---------------------------------------------------------------------------------------------------------

@query(r"""
SELECT doc_id, md5(t) AS digest, length(t) AS n_chars, len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS n_tokens, length(replace(t, ' ', '')) AS n_non_space
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents)""")
def text_normalize(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.normalize("text").alias("t"))
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"), F.size(text.tokens("t")).alias("n_tokens"), text.non_space_length("t").alias("n_non_space"))


_AMOUNT_SQL = r"^([₹$]|Rs|INR)?([0-9]{1,3}(,[0-9]{2,3})+(\.[0-9]+)?|[0-9]+(\.[0-9]+)?)$|^([₹$]|Rs|INR)$"
_KIND_SQL = rf"""CASE WHEN regexp_matches(w, '{_AMOUNT_SQL}') THEN 'amount' WHEN regexp_matches(w, '^([0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$') THEN 'date'
 WHEN regexp_matches(w, '[A-Za-z0-9]{{6,}}') THEN 'id_like' ELSE 'none' END"""


@query(rf"""
SELECT lang, kind, count(*) AS n FROM (SELECT lang, {_KIND_SQL} AS kind FROM (SELECT lang, unnest(string_split_regex(text, '[ \t\n\x0B\f\r]+')) AS w FROM documents) WHERE w <> '') GROUP BY 1, 2""")
def token_kind_counts(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(text.tokens("text")).alias("w"))
    return words.groupBy("lang", F.coalesce(text.kind("w"), F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS parsed FROM lineitem""")
def token_parse_amount(spark, d):
    rows, shown = table(spark, d, "lineitem"), F.format_string("%.2f", F.col("l_extendedprice"))
    grouped = F.regexp_replace(shown, r"(\d)(\d{3})\.", "$1,$2.")
    t = F.when(F.col("l_returnflag") == "N", F.concat(shown, F.lit("%"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("(Rs "), grouped, F.lit(")"))).otherwise(F.concat(F.lit("₹ "), grouped))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", text.parse_amount(t).alias("parsed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'date' WHEN 'A' THEN 'amount' ELSE 'identifier' END AS primary_kind, 'strong' AS strength FROM lineitem""")
def token_context_class(spark, d):
    rows, flag = table(spark, d, "lineitem"), F.col("l_returnflag")
    token = F.when(flag == "R", F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd")).when(flag == "A", F.format_string("%d", F.col("l_partkey"))).otherwise(F.format_string("%d", F.col("l_orderkey")))
    near = F.when(flag == "A", "Total due").otherwise("invoice no")
    kind, strength = text.contextual_class(token, near)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("primary_kind"), strength.alias("strength"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS label, length(p_name) AS n FROM part")
def label_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_label("p_name").alias("label"), F.length("p_name").alias("n"))


_FOLD_SQL = r"translate(replace(replace(lower(trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')), ' ', ''), 'rn', 'm'), 'oqdl|isbz', '000111582')"


@query(f"SELECT item_id, md5({_FOLD_SQL.format('text')}) AS folded FROM benchmark")
def ocr_fold(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(text.fold("text")).alias("folded"))


_a, _b = (_FOLD_SQL.format(c) for c in ("n_name", "r_name"))


@query(f"""SELECT n_nationkey, r_regionkey, levenshtein({_a}, {_b}) AS edits,
  levenshtein({_a}, {_b}) <= greatest(1, floor(greatest(length(n_name), length(r_name), 1) * 0.15)::INT) AS within FROM nation JOIN region ON n_regionkey = r_regionkey""")
def ocr_tolerance(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", "r_regionkey", F.levenshtein(text.fold("n_name"), text.fold("r_name")).cast("long").alias("edits"), text.within_tolerance("n_name", "r_name", F.lit("prose")).alias("within"))


@query("SELECT page_id, regexp_matches(lower(ltrim(substr(html, 1, 256), ' ')), '^(<!doctype html|<html)') AS is_html FROM pages")
def html_sniff(spark, d):
    return table(spark, d, "pages").select("page_id", sniff_html("html").alias("is_html"))


# -- recognised text ----------------------------------------------------------------------------------------------

_DIVERGENCE = """SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'mismatch' WHEN 'click' THEN 'ocr_only' WHEN 'view' THEN 'embedded_only' ELSE 'agree' END AS kind,
  CASE WHEN value >= 100 THEN 'amount' WHEN value >= 50 THEN 'id' ELSE 'prose' END AS cls, floor(value / 10)::INT AS txt FROM events"""
_WEIGHT_SQL = """(CASE kind WHEN 'mismatch' THEN 1.0::DOUBLE WHEN 'ocr_only' THEN 0.7::DOUBLE WHEN 'embedded_only' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END
  * CASE cls WHEN 'amount' THEN 3.0::DOUBLE WHEN 'id' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)"""


def _divergences(spark, d):
    t, v = F.col("event_type"), F.col("value")
    kind = F.when(t == "purchase", "mismatch").when(t == "click", "ocr_only").when(t == "view", "embedded_only").otherwise("agree")
    cls = F.when(v >= 100, "amount").when(v >= 50, "id").otherwise("prose")
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", kind.alias("kind"), cls.alias("cls"), F.floor(v / 10).cast("int").alias("txt"))
    return rows.withColumn("w", ocr.weight(F.col("kind"), F.col("cls")))


@query(f"""
SELECT user_id, sum(w::DECIMAL(18,6))::DOUBLE AS mass FROM (SELECT *, {_WEIGHT_SQL} AS w, row_number() OVER (PARTITION BY user_id, kind, txt ORDER BY ts, event_id) AS k FROM ({_DIVERGENCE}))
WHERE kind = 'mismatch' OR k <= 2 GROUP BY 1""")
def ocr_orphan_cap(spark, d):
    return ocr.capped_mass(_divergences(spark, d), ["user_id"], "kind", "txt", "w", ["ts", "event_id"])


@query(f"""
WITH x AS (SELECT *, {_WEIGHT_SQL} AS w FROM ({_DIVERGENCE})),
m AS (SELECT user_id, sum(w::DECIMAL(18,6))::DOUBLE AS mass FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind, txt ORDER BY ts, event_id) AS k FROM x) WHERE kind = 'mismatch' OR k <= 2 GROUP BY 1),
c AS (SELECT user_id, count(*) AS n, count(*) FILTER (cls = 'amount' AND kind = 'mismatch') AS mm, count(*) FILTER (cls = 'amount' AND kind IN ('ocr_only', 'embedded_only')) AS oo FROM x GROUP BY 1)
SELECT user_id, CASE WHEN n < 5 THEN 'inconclusive' WHEN mm > 0 OR oo >= 2 THEN 'high' WHEN oo > 0 OR mass >= greatest(2.0, 0.02 * n) THEN 'medium' ELSE 'low' END AS tier,
  CASE WHEN n < 5 THEN NULL WHEN mm > 0 THEN 95 WHEN oo >= 2 THEN 75 WHEN oo > 0 OR mass >= greatest(2.0, 0.02 * n) THEN 50 WHEN mass > 0 THEN 15 ELSE 0 END::INT AS score
FROM c JOIN m USING (user_id)""")
def ocr_score(spark, d):
    rows = _divergences(spark, d)
    high = F.col("cls") == "amount"
    n = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(high & (F.col("kind") == "mismatch")).alias("mm"), F.count_if(high & F.col("kind").isin("ocr_only", "embedded_only")).alias("oo"))
    both = n.join(ocr.capped_mass(rows, ["user_id"], "kind", "txt", "w", ["ts", "event_id"]), "user_id")
    tier, points = ocr.score(F.col("n") < 5, F.col("n"), F.col("mm"), F.col("oo"), F.col("mass"))
    return both.select("user_id", tier.alias("tier"), points.alias("score"))


@query("""SELECT user_id, count(*) AS n_text, count(*) FILTER (event_type = 'view') AS n_ocr,
  count(*) < 10 OR (count(*) FILTER (event_type = 'view') > 0 AND count(*) < 0.10 * count(*) FILTER (event_type = 'view')) AS routed FROM events GROUP BY 1""")
def ocr_sparse_route(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_text"), F.count_if(F.col("event_type") == "view").alias("n_ocr"))
    return n.withColumn("routed", ocr.sparse(F.col("n_text"), F.col("n_ocr")))


# -- boxes --------------------------------------------------------------------------------------------------------

_BOXES_SQL = """SELECT vec_id, label, (300 + 500 * embedding[1])::DOUBLE AS x0, (400 + 500 * embedding[2])::DOUBLE AS y0,
  (300 + 500 * embedding[1])::DOUBLE + 20 + 100 * abs(embedding[3])::DOUBLE AS x1, (400 + 500 * embedding[2])::DOUBLE + 20 + 100 * abs(embedding[4])::DOUBLE AS y1 FROM embeddings"""


def _boxes(spark, d, side=""):
    e = lambda i: F.col("embedding")[i].cast("double")
    x0, y0 = 300 + 500 * e(0), 400 + 500 * e(1)
    cols = {"x0": x0, "y0": y0, "x1": x0 + 20 + 100 * F.abs(e(2)), "y1": y0 + 20 + 100 * F.abs(e(3))}
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(f"{side}vec_id"), "label", *[c.alias(f"{side}{k}") for k, c in cols.items()])


_BOXES_SQL = _BOXES_SQL.replace("500 * embedding[1]", "500 * embedding[1]::DOUBLE").replace("500 * embedding[2]", "500 * embedding[2]::DOUBLE").replace("abs(embedding[3])::DOUBLE", "abs(embedding[3]::DOUBLE)").replace("abs(embedding[4])::DOUBLE", "abs(embedding[4]::DOUBLE)")


@query(f"""
WITH b AS (SELECT *, x0 / 612.0::DOUBLE AS l, x1 / 612.0::DOUBLE AS r, 1 - y1 / 792.0::DOUBLE AS t, 1 - y0 / 792.0::DOUBLE AS u, (vec_id % 4) * 90 AS q FROM ({_BOXES_SQL}))
SELECT vec_id, round(least(1, greatest(0, CASE q WHEN 0 THEN l WHEN 90 THEN 1 - u WHEN 180 THEN 1 - r ELSE t END)), 9) AS x0,
       round(least(1, greatest(0, CASE q WHEN 0 THEN t WHEN 90 THEN l WHEN 180 THEN 1 - u ELSE 1 - r END)), 9) AS y0,
       round(least(1, greatest(0, CASE q WHEN 0 THEN r WHEN 90 THEN 1 - t WHEN 180 THEN 1 - l ELSE u END)), 9) AS x1,
       round(least(1, greatest(0, CASE q WHEN 0 THEN u WHEN 90 THEN r WHEN 180 THEN 1 - t ELSE 1 - l END)), 9) AS y1 FROM b""")
def geo_canonical(spark, d):
    c = geometry.canonical(*(F.col(k) for k in ("x0", "y0", "x1", "y1")), F.lit(612.0), F.lit(792.0), (F.col("vec_id") % 4) * 90)
    return _boxes(spark, d).select("vec_id", c.alias("b")).select("vec_id", *[F.round(F.col(f"b.{k}"), 9).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query(f"""
WITH b AS ({_BOXES_SQL}), p AS (SELECT a.vec_id AS a_vec_id, b.vec_id AS b_vec_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM b a JOIN b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT a_vec_id, b_vec_id, round(i / (s - i), 9) AS iou FROM p WHERE i > 0 AND i / (s - i) >= 0.3""")
def geo_iou_pairs(spark, d):
    found = spatial.iou_pairs(_boxes(spark, d, "a_"), _boxes(spark, d, "b_"), ["label"], 64.0)
    return found.where("a_vec_id < b_vec_id").select("a_vec_id", "b_vec_id", F.round("iou", 9).alias("iou"))


@query(f"""
WITH b AS ({_BOXES_SQL}) SELECT a.vec_id AS a_vec_id, min(b.vec_id) AS b_vec_id FROM b a JOIN b ON a.label = b.label
 AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1 GROUP BY 1""")
def geo_containment(spark, d):
    found = spatial.first_container(_boxes(spark, d, "a_"), _boxes(spark, d, "b_"), ["label"], 64.0, "a_vec_id", "b_vec_id")
    return found.select("a_vec_id", "b_vec_id")


# -- matching -----------------------------------------------------------------------------------------------------

@query()
def ocr_match(spark, d):
    """Words of the benchmark's items, set in lines of ten, against boxes of their tokens that are moved and misread by rule."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(text.tokens("text")).alias("pos", "text"))
    x, y, move = F.col("pos") % 10 * 60.0, F.floor(F.col("pos") / 10) * 20.0, F.when(F.col("pos") % 7 == 0, 45.0).otherwise(F.when(F.col("pos") % 5 == 0, 25.0).otherwise(2.0))
    at = lambda by: [(x + by).alias("x0"), y.alias("y0"), (x + by + 50).alias("x1"), (y + 15).alias("y1")]
    seen = F.when(F.col("pos") % 11 == 0, F.reverse("text")).otherwise(F.upper("text"))
    boxes = words.where("pos % 13 <> 0").select("item_id", "pos", seen.alias("text"), *at(move))
    return matching.classify(matching.match_words(words.select("item_id", "pos", "text", *at(F.lit(0.0))), boxes, ["item_id"]))


@query()
def ocr_token_bag(spark, d):
    rows = table(spark, d, "benchmark").withColumn("turned", F.array_join(F.reverse(text.tokens("text")), " "))
    return rows.select("item_id", matching.same_bag(F.col("text"), F.col("turned")).alias("same_bag"))


# -- versions -----------------------------------------------------------------------------------------------------

_PAIRS = "SELECT conv_id, turn, text AS after, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations"


def _pairs(spark, d):
    return versions.consecutive(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")


@query(f"SELECT conv_id, turn, before = after AS same, length(before) AS n_before, length(after) AS n_after FROM ({_PAIRS}) WHERE before IS NOT NULL")
def ver_pairs(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", (F.col("before") == F.col("after")).alias("same"), F.length("before").alias("n_before"), F.length("after").alias("n_after"))


@query(rf"""
WITH p AS (SELECT * FROM ({_PAIRS}) WHERE before IS NOT NULL),
t AS (SELECT conv_id, turn, unnest(string_split_regex(after, '[ \t\n\x0B\f\r]+')) AS token, 1 AS n FROM p UNION ALL SELECT conv_id, turn, unnest(string_split_regex(before, '[ \t\n\x0B\f\r]+')), -1 FROM p)
SELECT conv_id, turn, token, sum(n)::BIGINT AS change FROM t WHERE token <> '' GROUP BY 1, 2, 3 HAVING sum(n) <> 0""")
def ver_added_tokens(spark, d):
    return versions.changed_tokens(_pairs(spark, d), ["conv_id", "turn"])


@query()
def ver_diff_seq(spark, d):
    return versions.sequence_changes(_pairs(spark, d), ["conv_id", "turn"]).withColumn("kind", text.change_kind("old", "new"))


# -- layout and fonts ---------------------------------------------------------------------------------------------

@query("""
WITH e AS (SELECT *, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM e""")
def line_sessions(spark, d):
    gap = F.col("ts") - F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return layout.sessions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], gap > F.expr("INTERVAL 1 HOUR")).select("event_id", "user_id", "session")


@query()
def line_clusters(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "value")
    return layout.cluster_lines(rows, ["user_id"], "value", "event_id", 5.0)


@query("SELECT event_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS header FROM events")
def table_fill(spark, d):
    return layout.header_fill(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "header")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS boundary FROM events""")
def rev_boundaries(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return layout.last_before(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], value, "boundary").select("event_id", "boundary")


@query("""
WITH c AS (SELECT l_returnflag, l_linestatus, min(l_quantity) + 10 * dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) AS center FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, (lag(center) OVER w + center) / 2 AS lo, (lead(center) OVER w + center) / 2 AS hi FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY center))
SELECT l_orderkey, l_linenumber, l_partkey, b.l_linestatus AS role FROM lineitem l JOIN b ON l.l_returnflag = b.l_returnflag AND (lo IS NULL OR l_quantity >= lo) AND (hi IS NULL OR l_quantity < hi)""")
def col_assign(spark, d):
    cells = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    rank = F.dense_rank().over(W.partitionBy("l_returnflag").orderBy("l_linestatus"))
    columns = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_quantity").alias("q")).select(
        "l_returnflag", F.col("l_linestatus").alias("role"), (F.col("q") + 10 * rank).alias("center"))
    return layout.assign_columns(cells, columns, ["l_returnflag"], "l_quantity", "center", "role").select("l_orderkey", "l_linenumber", "l_partkey", "role")


_MODE = "SELECT {0}, v AS dominant, n_distinct FROM (SELECT {0}, l_returnflag AS v, count(*) AS n, count(*) OVER (PARTITION BY {0}) AS n_distinct, row_number() OVER (PARTITION BY {0} ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY {0}, l_returnflag) WHERE k = 1"


@query(_MODE.format("l_orderkey"))
def font_mode(spark, d):
    return fonts.dominant(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("SELECT l_partkey, count(*) AS inspected, count(*) FILTER (l_returnflag = 'R') AS mixed, count(*) >= 8 AND count(*) FILTER (l_returnflag = 'R') / count(*) >= 0.3 AS pervasive FROM lineitem GROUP BY 1")
def font_pervasive(spark, d):
    return fonts.pervasive(table(spark, d, "lineitem"), ["l_partkey"], F.col("l_returnflag") == "R")


@query(f"""
WITH o AS ({_MODE.format('l_orderkey')}), p AS ({_MODE.format('l_partkey')})
SELECT l.l_orderkey, l.l_partkey, l_linenumber, o.dominant <> p.dominant AS deviates FROM lineitem l JOIN o ON l.l_orderkey = o.l_orderkey JOIN p ON l.l_partkey = p.l_partkey""")
def font_baseline(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    o = fonts.dominant(rows, ["l_orderkey"], "l_returnflag", "a").drop("n_distinct")
    p = fonts.dominant(rows, ["l_partkey"], "l_returnflag", "b").drop("n_distinct")
    return rows.join(o, "l_orderkey").join(p, "l_partkey").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("a") != F.col("b")).alias("deviates"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'ABCDEF' END AS tag, replace(p_brand, '#', '') || '-' || 'Bold' AS base, replace(p_brand, '#', '') AS family FROM part")
def font_identity(spark, d):
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "").otherwise("ABCDEF+"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("-Bold"))
    return table(spark, d, "part").select("p_partkey", font_names.subset_tag(name).alias("tag"), font_names.base(name).alias("base"), font_names.family(name).alias("family"))


# -- invoices from cells, detectors -------------------------------------------------------------------------------

def _cells(spark, d):
    t = _totals(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey") == F.col("l_orderkey"))
    cells = F.array(*[F.struct(F.lit(r).alias("role"), c.cast("double").alias("value")) for r, c in (
        ("subtotal", F.col("subtotal")), ("discount", F.col("discount")), ("cgst", F.col("half")), ("sgst", F.col("half")), ("gst", F.col("tax")), ("grand_total", F.col("o_totalprice")))])
    return t.select("l_orderkey", F.explode(cells).alias("c")).select("l_orderkey", "c.role", "c.value")


@query(f"""
SELECT l_orderkey, subtotal - discount + (half::DECIMAL(28,6) + half::DECIMAL(28,6))::DOUBLE AS expected, o_totalprice AS stated
FROM (SELECT * FROM ({_TOTALS}) JOIN orders ON o_orderkey = l_orderkey)""")
def inv_grand_total(spark, d):
    return invoices.grand_total(_cells(spark, d), ["l_orderkey"])


@query(f"SELECT l_orderkey, (half::DECIMAL(28,6) + half::DECIMAL(28,6))::DOUBLE AS expected, tax AS stated FROM ({_TOTALS}) JOIN orders ON o_orderkey = l_orderkey")
def inv_tax_sum(spark, d):
    return invoices.tax_sum(_cells(spark, d), ["l_orderkey"])


@query("""
WITH r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'purchase' THEN 'amount' WHEN 'click' THEN 'qty' WHEN 'view' THEN 'description' END AS role FROM events)
SELECT user_id, day, count(role) >= 2 AND count(*) FILTER (role IN ('qty', 'rate', 'amount')) > 0 AS is_header FROM r GROUP BY 1, 2""")
def inv_header_lines(spark, d):
    t = F.col("event_type")
    label = F.when(t == "purchase", "Line Total").when(t == "click", "No. of Days").when(t == "view", "Particulars").otherwise("?")
    return invoices.header_lines(table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), label.alias("text")), ["user_id", "day"])


@query("SELECT l_orderkey, l_returnflag AS role, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def inv_unique_roles(spark, d):
    cells = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("role"), "l_linenumber")
    return invoices.unique_roles(cells, ["l_orderkey"])


@query()
def inv_logical(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("page"),
        F.lit(1).alias("tables"), F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1)).alias("anchor"), (F.col("o_orderstatus") == "F").alias("title"),
        F.when(F.col("o_orderstatus") != "O", "qty,rate,amount").alias("roles"), F.lit(False).alias("continued"), F.lit(2).alias("triples"), (F.col("o_totalprice") > 200_000).alias("terminal"))
    return invoices.logical_invoices(rows).select("doc_id", "page", "invoice", "confidence")


_FONT_SQL = "CASE l_returnflag WHEN 'A' THEN 'ABCDEF+Helvetica' WHEN 'N' THEN 'GHIJKL+Helvetica' ELSE 'Courier-Bold' END"


@query(f"""
WITH g AS (SELECT l_orderkey, {_FONT_SQL} AS f, count(*) AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey, f AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f) AS k FROM g) WHERE k = 1)
SELECT g.l_orderkey, dominant, sum(CASE WHEN f <> dominant AND f LIKE '%+Helvetica' AND dominant LIKE '%+Helvetica' THEN n ELSE 0 END)::BIGINT AS n_subset,
  sum(CASE WHEN (f LIKE 'Courier%') <> (dominant LIKE 'Courier%') THEN n ELSE 0 END)::BIGINT AS n_family FROM g JOIN b ON g.l_orderkey = b.l_orderkey GROUP BY 1, 2""")
def font_token_mix(spark, d):
    flag = F.col("l_returnflag")
    font = F.when(flag == "A", "ABCDEF+Helvetica").when(flag == "N", "GHIJKL+Helvetica").otherwise("Courier-Bold")
    return detectors.token_font_mix(table(spark, d, "lineitem").select("l_orderkey", font.alias("fontname")), ["l_orderkey"])


@query("""
SELECT user_id, CASE WHEN n <= 1 THEN 'inconclusive' WHEN p > 0 AND c > 0 THEN 'high' WHEN s > 0 THEN 'medium' ELSE 'low' END AS tier,
  CASE WHEN n <= 1 THEN NULL WHEN p > 0 AND c > 0 THEN 95 WHEN s > 0 THEN 55 ELSE 15 END::INT AS score
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1)""")
def rev_score(spark, d):
    is_ = lambda t: F.count_if(F.col("event_type") == t) > 0
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), is_("purchase").alias("p"), is_("click").alias("c"), is_("signup").alias("s"))
    tier, points = detectors.revision_score(F.col("n"), F.col("p"), F.lit("amount"), F.col("c"), {"overlay": F.col("s")})
    return n.select("user_id", tier.alias("tier"), points.alias("score"))


_META = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'Smallpdf' WHEN o_orderstatus = 'P' THEN '4.2' ELSE 'Billing' END AS producer,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'Mozilla/5.0' END AS creator FROM orders"""


@query(f"""
WITH m AS ({_META}), k AS (
SELECT doc_id, unnest([CASE WHEN producer = 'Smallpdf' THEN 'web_editor_producer' END, CASE WHEN producer = '4.2' THEN 'version_only_producer' END,
  CASE WHEN creator IS NOT NULL THEN 'browser_creator' END, CASE WHEN producer <> 'Billing' AND creator IS NOT NULL THEN 'composite_edit_footprint' END]) AS kind FROM m)
SELECT doc_id, kind, (CASE kind WHEN 'web_editor_producer' THEN 45 WHEN 'version_only_producer' THEN 35 WHEN 'browser_creator' THEN 20 ELSE 55 END)::INT AS score,
  CASE WHEN kind IN ('web_editor_producer', 'composite_edit_footprint') THEN 'medium' ELSE 'low' END AS tier FROM k WHERE kind IS NOT NULL""")
def prov_findings(spark, d):
    status = F.col("o_orderstatus")
    none = [F.lit(None).cast("string").alias(x) for x in ("creation_date", "mod_date", "xmp_producer", "id_first", "id_second")]
    meta = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(status == "F", "Smallpdf").when(status == "P", "4.2").otherwise("Billing").alias("producer"),
        F.when(F.col("o_orderpriority").startswith("1"), "Mozilla/5.0").alias("creator"), *none)
    return detectors.provenance_findings(meta)
