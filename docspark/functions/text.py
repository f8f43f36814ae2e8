"""Text and token functions. Everything here is a Column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tables that decide results.
ZERO_WIDTH = "[​‌‍­]"
AMOUNT = r"^(?:[₹$]|Rs|INR)?(?:\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)$|^(?:[₹$]|Rs|INR)$"
DATE = r"^(?:\d{1,2}[/\-]\d{1,2}[/\-]\d{4}|\d{4}-\d{2}-\d{2})$"
ID_LIKE = r"[A-Za-z0-9]{6,}"
CURRENCY = r"(?i)(?:₹|\$|\bRs\.?\b|\bINR\b)"
NUMERIC = r"^[+-]?(?:\d+(?:,\d+)*)(?:\.\d+)?$"
TWO_DECIMALS = r"^[+-]?\d+(?:,\d+)*\.\d{2}$"
GROUPED = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})*,\d{3})(?:\.\d{2})?$"
LONG_DIGITS = r"^\d{8,}$"
ALNUM_ID = r"^(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9._/-]{6,}$"
MONEY_LABEL = r"(?i)\b(?:amount|total|due|price|balance|subtotal|payable|grand\s+total|net\s+amount)\b"
IDENTIFIER_LABEL = (
    r"(?i)\b(?:abn|gstin|tax\s*id|account(?:\s*(?:no|number))?|invoice\s*(?:no|number)|"
    r"phone|mobile|policy\s*(?:no|number)|claim\s*(?:no|number))\b"
)
QUANTITY_LABEL = r"(?i)\b(?:qty|quantity|units?|hours?|days?)\b"
CURRENCY_WORDS = r"(?i)(?:₹|\$|£|€|rs\.?|inr|rupees?|usd)"
CLEAN_NUMBER = r"^[+-]?(?:\d+(?:\.\d+)?|\.\d+)$"
#: Letters that recognition confuses, folded (after lower-casing) to the first of their class.
CONFUSED_FROM, CONFUSED_TO = "oqdl|isbz", "000111582"
PRIORITY = {"amount": 0, "date": 1, "id_like": 2}
ALLOWED_SHARE, PROSE_FLOOR = 0.15, 1

_col = lambda c: F.col(c) if isinstance(c, str) else c


def normalize(c, strip_zero_width: bool = True, collapse: bool = True) -> Column:
    """Zero-width characters go, white space becomes single spaces, ends are trimmed. Composed form is expected of the
    input; ``sources.compose`` makes it where it is not."""
    c = _col(c)
    if strip_zero_width:
        c = F.regexp_replace(c, ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(c, r"\s+", " ")) if collapse else c


def tokens(c) -> Column:
    return F.array_remove(F.split(_col(c), r"\s+"), "")


def fold(c) -> Column:
    """What recognition can't tell apart becomes equal: case, inner spaces, rn and m, confused characters."""
    c = F.replace(F.lower(normalize(c)), F.lit(" "), F.lit(""))
    return F.translate(F.replace(c, F.lit("rn"), F.lit("m")), CONFUSED_FROM, CONFUSED_TO)


def allowed_edits(kind: Column, length: Column, share: float = ALLOWED_SHARE) -> Column:
    part = F.floor(length * share).cast("int")
    return (F.when(kind.isin("amount", "date"), F.lit(0)).when(kind == "id", part).otherwise(F.greatest(F.lit(PROSE_FLOOR), part)))


def within_tolerance(a, b, kind: Column) -> Column:
    x, y = fold(a), fold(b)
    longest = F.greatest(F.length(_col(a)), F.length(_col(b)), F.lit(1))
    return F.levenshtein(x, y) <= allowed_edits(kind, longest)


def kind(c) -> Column:
    """amount, date, id_like or null."""
    c = F.trim(_col(c))
    return F.when(c.rlike(AMOUNT), "amount").when(c.rlike(DATE), "date").when(c.rlike(ID_LIKE), "id_like")


def change_kind(before, after) -> Column:
    """The kind of higher priority of both."""
    a, b = kind(before), kind(after)
    rank = lambda k: reduce(lambda w, p: w.when(k == p[0], p[1]), PRIORITY.items(), F).otherwise(9)
    return F.when(rank(a) <= rank(b), a).otherwise(b)


def monetary_context(c) -> Column:
    c = _col(c)
    return c.rlike(CURRENCY) | c.rlike(r"[.,]") | (F.length(F.regexp_replace(c, r"[^0-9]", "")) >= 3)


def token_class(c, need_context: bool = True) -> Column:
    k = kind(c)
    amount = F.when(monetary_context(c), "amount").otherwise("prose") if need_context else F.lit("amount")
    return F.when(k == "amount", amount).when(k == "date", "date").when(k == "id_like", "id").otherwise("prose")


def contextual_class(token, near) -> tuple[Column, Column]:
    """primary and strength of a token, given the text around it."""
    t, near = F.trim(_col(token)), _col(near)
    money, ident, qty = near.rlike(MONEY_LABEL), near.rlike(IDENTIFIER_LABEL), near.rlike(QUANTITY_LABEL)
    numeric = t.rlike(NUMERIC)
    intrinsic = t.rlike(CURRENCY) | t.rlike(TWO_DECIMALS) | t.rlike(GROUPED)
    rules = [
        (t.rlike(DATE), "date", "strong"),
        (intrinsic, "amount", "strong"),
        (ident & ~money & t.rlike(r"[0-9]"), "identifier", "strong"),
        (money & numeric, "amount", "strong"),
        (qty & numeric, "quantity", "medium"),
        (t.rlike(LONG_DIGITS) | t.rlike(ALNUM_ID), "identifier", "medium"),
        (numeric, "unknown_numeric", "weak"),
        (t.rlike(ID_LIKE), "identifier", "weak"),
    ]
    pick = lambda i: reduce(lambda w, r: w.when(r[0], r[i]), rules, F)
    return pick(1), pick(2)


def parse_amount(c) -> Column:
    """A double, or null for what is no clean number: percentages, labels, ids."""
    c = F.trim(_col(c))
    wrapped = c.rlike(r"^\(.*\)$")
    body = F.when(wrapped, F.trim(F.regexp_extract(c, r"^\((.*)\)$", 1))).otherwise(c)
    body = F.trim(F.regexp_replace(body, CURRENCY_WORDS, ""))
    minus = body.startswith("-")
    body = F.trim(F.regexp_replace(body, r"^[+-]", ""))
    body = F.regexp_replace(F.regexp_replace(body, r"(\d),(\d)", "$1$2"), r"(\d),(\d)", "$1$2")
    body = F.replace(body, F.lit(" "), F.lit(""))
    value = F.when(body.rlike(CLEAN_NUMBER), body.try_cast("double"))
    return F.when(c.endswith("%"), F.lit(None).cast("double")).when(wrapped != minus, -value).otherwise(value)


def normalize_label(c) -> Column:
    return F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]", "")


def displayed_decimals(c) -> Column:
    c = _col(c)
    return F.when(c.rlike(r"\.\d"), F.length(F.regexp_extract(c, r"\.(\d+)", 1))).when(c.rlike(r"\d"), 0)


def format_number(c) -> Column:
    c = _col(c)
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(F.format_string("%.2f", c))


def non_space_length(c) -> Column:
    return F.length(F.regexp_replace(_col(c), r"\s", ""))


def truncate(c, most: int = 200) -> Column:
    c = F.regexp_replace(_col(c), r"\n", " ")
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def humanize(c) -> Column:
    c = F.lower(F.replace(_col(c), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))


def page_range(pages) -> Column:
    """pages: sorted zero-based page numbers."""
    p = _col(pages)
    first, last = F.element_at(p, 1) + 1, F.element_at(p, -1) + 1
    return F.when(F.size(p) == 1, F.concat(F.lit("page "), first.cast("string"))).when(
        F.size(p) > 1, F.concat(F.lit("pages "), first.cast("string"), F.lit("–"), last.cast("string")))


def salted_hash(c, salt: str = "", digits: int = 12) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), _col(c)), 256), 1, digits)


def safe_token(c, most: int = 64) -> Column:
    """Whether a token may leave the engine: short and without spaces."""
    c = _col(c)
    return (F.length(c) <= most) & ~c.contains(" ")
