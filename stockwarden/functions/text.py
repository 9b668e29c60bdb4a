"""Column expressions over names, keys and titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockwarden.config import UNIT_DECIMALS


def present(col: Column) -> Column:
    """Text dimensions use '' for 'absent'; NULL and blanks count as absent too."""
    return F.coalesce(F.trim(col), F.lit("")) != ""


def blank_to_null(col: Column) -> Column:
    return F.when(present(col), col)


def container_size(name: Column) -> Column:
    """Container content stated in a product name: decimal comma allowed, litres and kilos in mL and g."""
    # The size pattern and its units.
    pattern = r"(\d+(?:[.,]\d+)?)\s*(ml|mL|ML|g|gr|kg|L)\b"
    number = F.replace(F.regexp_extract(name, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.lower(F.regexp_extract(name, pattern, 2))
    return number * F.when(unit.isin("l", "kg"), 1000.0).otherwise(1.0)


def region(location: Column) -> Column:
    """Leading letters of the first path segment with the distribution-centre prefix removed."""
    upper = F.upper(location)
    token = F.trim(F.split(F.regexp_replace(upper, "CEDIS[- ]?", ""), "/")[0])
    letters = F.regexp_extract(token, "^[A-ZÁÉÍÓÚÑ]+", 0)
    return F.when(letters != "", letters).otherwise(F.substring(token, 1, 3))


def warehouse(location: Column) -> Column:
    return F.split(location, "/")[0]


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("None"))


def fixed(col: Column, decimals: int = 3) -> Column:
    """A double rendered the same way everywhere, so hashes do not depend on float formatting."""
    return F.format_string(f"%.{decimals}f", col)


def line_fingerprint(case_no: Column, product_id: Column, qty: Column, ts: Column, lot: Column) -> Column:
    stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    parts = [_text(case_no), _text(product_id), _text(fixed(qty)), _text(stamp), _text(lot)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def alert_fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[_text(p) for p in parts])), 1, 14)


# Payload fields that identify a need, in key order.
KEY_FIELDS = ("origin", "destination", "location", "lot", "order", "picking", "model", "res_id", "team", "case_id")


def proposal_key(kind: Column, payload: dict[str, Column], title: Column, plan_kinds: tuple[str, ...]) -> Column:
    """kind | product | field=value…; the title hash stands in when nothing else tells two needs apart."""
    product = F.coalesce(payload["product_id"].cast("string"), F.lit("")) if "product_id" in payload else F.lit("")
    pairs = [
        F.when(present(payload[k].cast("string")), F.concat(F.lit(f"{k}="), payload[k].cast("string")))
        for k in KEY_FIELDS
        if k in payload
    ]
    anonymous = reduce(lambda a, b: a & b, [p.isNull() for p in pairs], ~kind.isin(*plan_kinds))
    hashed = F.when(anonymous, F.concat(F.lit("t="), F.substring(F.sha1(title), 1, 12)))
    return F.concat_ws("|", kind, product, *pairs, hashed)


def unit_decimals(unit: Column, precision: Column | None = None) -> Column:
    by_name = F.lit(None).cast("int")
    lowered = F.lower(F.trim(unit))
    for name, decimals in UNIT_DECIMALS.items():
        by_name = F.when(lowered == name, F.lit(decimals)).otherwise(by_name)
    named = F.coalesce(by_name, F.lit(0))
    return F.coalesce(precision, named) if precision is not None else named


def quantity_text(qty: Column, unit: Column) -> Column:
    """Quantity at its unit's precision with thousands separators, then the unit."""
    whole = F.format_number(qty, 0)
    shown = whole
    for decimals in sorted(set(UNIT_DECIMALS.values())):
        shown = F.when(unit_decimals(unit) == decimals, F.format_number(qty, decimals)).otherwise(shown)
    shown = F.when(F.abs(qty - F.rint(qty)) < 1e-9, whole).otherwise(shown)
    return F.concat_ws(" ", shown, blank_to_null(unit))


def proposal_title(kind: Column, qty: Column, unit: Column, product: Column, origin: Column, destination: Column,
                   lot: Column, buy_qty: Column | None = None, buy_unit: Column | None = None) -> Column:
    amount = quantity_text(qty, unit)
    unknown = F.lit("?")
    origin, destination = F.coalesce(blank_to_null(origin), unknown), F.coalesce(blank_to_null(destination), unknown)
    lot = F.coalesce(blank_to_null(lot), unknown)
    packs = F.lit("")
    if buy_qty is not None:
        packs = F.coalesce(F.concat(F.lit(" ("), quantity_text(buy_qty, buy_unit), F.lit(")")), F.lit(""))
    title = (
        F.when(kind == "transfer",
               F.concat(F.lit("Transfer "), amount, F.lit(" of "), product, F.lit(": "), origin, F.lit(" to "), destination))
        .when(kind == "purchase", F.concat(F.lit("Purchase request: "), amount, packs, F.lit(" of "), product))
        .when(kind == "quarantine",
              F.concat(F.lit("Quarantine "), amount, F.lit(" of lot "), lot, F.lit(": "), product, F.lit(" at "), origin))
        .when(kind == "scrap", F.concat(F.lit("Scrap "), amount, F.lit(" of lot "), lot, F.lit(": "), product))
    )
    return F.when(product.isNotNull() & qty.isNotNull(), title)


def contains_text(text: str, *columns: Column) -> Column:
    """Case-insensitive literal substring over any of the columns."""
    needle = text.strip().lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in columns])
