"""From tokens on lines to tables and logical invoices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions.text import normalize_label, parse_amount

# The labels of each role; the first role that lists a label has it.
ROLES = {
    "qty": ["qty", "quantity", "qnty", "units", "unit", "nos", "no", "billable", "billableqty", "days", "noofdays", "daysofstay", "quantitybilled"],
    "rate": ["rate", "unitprice", "price", "unitrate", "ratepernight", "roomrate", "rateperday", "tariff", "mrp", "rateperunit"],
    "amount": ["amount", "linetotal", "total", "lineamount", "value", "amountinr", "grossamount", "charge", "charges", "totalamount"],
    "subtotal": ["subtotal", "subtotalamount", "grosstotal", "totalbeforetax", "pagesubtotal", "pagetotal"],
    "discount": ["discount", "disc", "lessdiscount", "rebate", "concession"],
    "cgst": ["cgst", "cgstamount"],
    "sgst": ["sgst", "sgstamount", "ugst", "utgst"],
    "igst": ["igst", "igstamount"],
    "gst": ["gst", "tax", "taxamount", "totalgst", "totaltax", "gstamount"],
    "grand_total": ["grandtotal", "nettotal", "netpayable", "netamount", "amountdue", "amountpayable", "totalpayable", "balancedue", "totaldue", "finalamount", "payableamount"],
    "deposit": ["deposit", "advance", "advancepaid", "amountpaid", "paid"],
    "balance": ["balance", "balanceamount", "duebalance", "outstanding"],
    "date": ["date", "admissiondate", "dischargedate", "admission", "discharge", "doa", "dod", "fromdate", "todate", "billdate", "invoicedate"],
    "description": ["description", "particulars", "item", "items", "name", "productname", "service", "services", "details", "narration"],
}
NUMERIC_ROLES = ["qty", "rate", "amount"]
LEAST_HEADERS = 2


def role_of(label) -> Column:
    """The role of a header or summary label, null if it names none."""
    c = normalize_label(label)
    return reduce(lambda w, r: w.when(c.isin(r[1]), r[0]), ROLES.items(), F)


def header_lines(tokens: DataFrame, line: list[str], text: str = "text") -> DataFrame:
    """line and is_header: at least two tokens name roles, one of them a numeric one."""
    role = role_of(text)
    return tokens.groupBy(*line).agg(
        ((F.count(role) >= LEAST_HEADERS) & (F.count_if(role.isin(NUMERIC_ROLES)) > 0)).alias("is_header"))


def unique_roles(cells: DataFrame, by: list[str], role: str = "role") -> DataFrame:
    """Cells that are the only one of their role; a role printed twice has no owner."""
    n = cells.groupBy(*by, role).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return cells.join(n, [*by, role], "left_semi")


def tax_sum(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, expected, stated: the parts of the tax there are, two at least, against the printed tax."""
    part = F.col("role").isin("cgst", "sgst", "igst")
    return cells.groupBy(*by).agg(
        F.sum(F.when(part, F.col("value").cast("decimal(28,6)"))).cast("double").alias("expected"),
        F.max(F.when(F.col("role") == "gst", F.col("value"))).alias("stated"), F.count_if(part).alias("parts"),
    ).where("parts >= 2 AND stated IS NOT NULL").drop("parts")


def grand_total(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, expected, stated: subtotal less discount plus tax (its parts, or where there are none the whole)."""
    of = lambda *roles: F.sum(F.when(F.col("role").isin(*roles), F.col("value").cast("decimal(28,6)"))).cast("double")
    a = cells.groupBy(*by).agg(of("subtotal").alias("s"), of("discount").alias("d"), of("cgst", "sgst", "igst").alias("p"), of("gst").alias("g"), of("grand_total").alias("stated"))
    expected = F.col("s") - F.coalesce("d", F.lit(0.0)) + F.coalesce("p", "g", F.lit(0.0))
    return a.where("s IS NOT NULL AND stated IS NOT NULL").select(*by, expected.alias("expected"), "stated")


def logical_invoices(pages: DataFrame) -> DataFrame:
    """pages with invoice and confidence.

    pages: doc_id, page, tables int, anchor string (invoice number, null if none), title boolean, roles string (the
    header's, null without one), continued boolean, triples int, terminal boolean (holds a closing total). Each page
    depends on the group before it, but only by its last printed anchor and roles: after a page with an anchor the group
    has that one, and whether a page without an anchor starts a group hangs on no anchor. So windows over the pages of a
    document, which spill, do without a fold.
    """
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    text = lambda name: F.when(c(name) != "", c(name))
    w = W.partitionBy("doc_id").orderBy(c("page").asc_nulls_last())
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    held = lambda when, value: F.last(F.when(when, F.struct(value.alias("x"))), ignorenulls=True).over(before)["x"]
    anchor, roles, title, many = text("anchor"), text("roles"), yes(c("title")), yes(c("tables") > 1)
    opens = c("_closed") & (roles.isNotNull() | title)  # without anchors to compare
    known = anchor.isNotNull() & c("_anchor").isNotNull()
    found = pages.withColumns({"_first": F.row_number().over(w) == 1, "_closed": yes(F.lag("terminal").over(w))})
    found = found.withColumn("_anchor", held(anchor.isNotNull() | many | c("_first") | opens, anchor))
    found = found.withColumn("_start", many | c("_first") | F.when(known, anchor != c("_anchor")).otherwise(opens))
    found = found.withColumns({"_roles": held(c("_start") | roles.isNotNull(), roles), "invoice": (F.sum(F.when(c("_start"), 1).otherwise(0)).over(upto) - 1).cast("int")})
    follows = roles.isNull() & (yes(c("triples") >= 2) | yes(c("continued")) | yes(c("tables") == 0)) & ~title
    doubt = F.when(many, 2).when(c("_first") | known | opens | yes(roles == c("_roles")), 0).when(follows, 1).otherwise(2)
    worst = F.max(doubt).over(W.partitionBy("doc_id", "invoice"))
    found = found.withColumn("confidence", F.when(worst == 0, "high").when(worst == 1, "medium").otherwise("ambiguous"))
    return found.select(*pages.columns, "invoice", "confidence")


#: Roles that a line of a label and one number may sum up.
SUMMARY_ROLES = ["subtotal", "discount", "cgst", "sgst", "igst", "gst", "grand_total", "deposit", "balance"]


def summary_cells(lines: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """keys, role, role_label, text, value of lines that have exactly one number and whose other tokens name a summary role."""
    number = lambda t: parse_amount(t).isNotNull()
    rows = lines.select(*keys, F.filter(tokens, number).alias("_n"), F.filter(tokens, lambda t: ~number(t)).alias("_l")).where("size(_n) = 1 AND size(_l) > 0")
    rows = rows.withColumn("role", role_of(F.array_join("_l", "")))
    return rows.where(F.col("role").isin(SUMMARY_ROLES)).select(*keys, "role", F.array_join("_l", " ").alias("role_label"), F.col("_n")[0].alias("text"), parse_amount(F.col("_n")[0]).alias("value"))


def is_page_subtotal(label: Column) -> Column:
    """A subtotal that its label says is a page's."""
    return F.contains(normalize_label(label), F.lit("page"))
