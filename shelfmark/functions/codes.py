"""Barcodes, packs, prices, dates and shipping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _s(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def digits(c) -> Column:
    return F.regexp_replace(_s(c), "[^0-9]", "")


def check_sum(body: Column) -> Column:
    """Weighted digit sum: 3 and 1 in turn from the right."""
    n = F.length(body)
    at = lambda i: body.substr(i, F.lit(1)).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda a, i: a + at(i) * F.when((n - i) % 2 == 0, 3).otherwise(1))


def check_digit(body: Column) -> Column:
    return ((10 - check_sum(body) % 10) % 10).cast("string")


def valid_gtin(c) -> Column:
    """8 to 14 digits whose last one checks the others."""
    d = _s(c)
    n = F.length(d)
    return F.when(d.rlike("^[0-9]{8,14}$"), check_digit(d.substr(F.lit(1), n - 1)) == F.right(d, F.lit(1))).otherwise(False)


def canonical_gtin(c) -> Column:
    """Without leading zeros."""
    return F.regexp_replace(digits(c), "^0+", "")


def gtin_variants(c) -> Column:
    """The code as read, without zeros, and padded to 12, 13 and 14 digits."""
    d, core = digits(c), canonical_gtin(c)
    padded = F.array(d, core, *[F.when(F.length(core) <= n, F.lpad(core, n, "0")) for n in (12, 13, 14)])
    return F.when(d == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(padded, lambda x: x.isNotNull() & (x != ""))))


def base_unit_variants(c) -> Column:
    """Codes of the single unit behind a case code with indicator 1 to 8."""
    once = lambda value, make: F.get(F.transform(F.array(value), make), 0)
    unit = lambda d: once(F.concat(F.lit("0"), d.substr(2, 12)), lambda body: F.concat(body, check_digit(body)))
    others = lambda d: F.filter(once(unit(d), gtin_variants), lambda v: v != d)
    ok = lambda d: (F.length(d) == 14) & valid_gtin(d) & ~d.substr(1, 1).isin("0", "9")
    return once(digits(c), lambda d: F.when(ok(d), others(d)).otherwise(F.array().cast("array<string>")))


def gs1_date(c) -> Column:
    """YYMMDD to a date; day 00 is the month's last; null when it is no date."""
    d = _s(c)
    month = F.try_to_date(F.concat(F.lit("20"), d.substr(1, 4), F.lit("01")), "yyyyMMdd")
    return F.when(d.rlike("^[0-9]{6}$"), F.when(d.substr(5, 2) == "00", F.last_day(month)).otherwise(F.try_to_date(F.concat(F.lit("20"), d), "yyyyMMdd")))


def parse_gs1(c) -> Column:
    """Gtin, lot and expiry of bracketed, link and separator-framed element strings.

    A bare string without separators gives its GTIN, and the expiry that may follow it at once."""
    raw = F.regexp_replace(_s(c), r"^\](?:C1|e0|d2|Q3)", "")
    gs = "\u001d"
    framed = raw.contains(gs)
    at = lambda ai, body: F.coalesce(
        F.nullif(F.regexp_extract(raw, rf"\({ai}\)({body})", 1), F.lit("")), F.nullif(F.regexp_extract(raw, rf"/{ai}/({body})", 1), F.lit(""))
    )
    gtin = F.coalesce(at("01", "[0-9]{14}"), F.nullif(F.regexp_extract(raw, "^01([0-9]{14})", 1), F.lit("")))
    rest = F.regexp_extract(raw, f"^01[0-9]{{14}}{gs}?(.*)$", 1)
    fixed = F.nullif(F.regexp_extract(rest, f"^(?:1[1235][0-9]{{6}}{gs}?)*17([0-9]{{6}})", 1), F.lit(""))
    later = F.nullif(F.regexp_extract(rest, f"{gs}17([0-9]{{6}})", 1), F.lit(""))
    lot_first = F.nullif(F.regexp_extract(rest, f"^(?:1[1-7][0-9]{{6}}{gs}?)*10([^{gs}]{{1,20}})", 1), F.lit(""))
    lot_later = F.nullif(F.regexp_extract(rest, f"{gs}10([^{gs}]{{1,20}})", 1), F.lit(""))
    lot = F.coalesce(at("10", "[^(/]{1,20}"), F.when(framed, F.coalesce(lot_first, lot_later)))
    return F.struct(gtin.alias("gtin"), lot.alias("lot"), gs1_date(F.coalesce(at("17", "[0-9]{6}"), fixed, F.when(framed, later))).alias("expiry"))


def parse_hibc(c) -> Column:
    """Labeller, product, lot and expiry of a health-industry code; null when it is none."""
    raw = F.regexp_replace(F.regexp_replace(F.trim(_s(c)), r"^\*+|\*+$", ""), r"\s+", "")
    body = raw.substr(F.lit(2), F.length(raw))
    lic, rest = body.substr(1, 4), body.substr(F.lit(5), F.length(body))
    slash = F.instr(rest, "/")
    primary = F.when(slash > 0, rest.substr(F.lit(1), slash - 1)).otherwise(rest)
    drop = F.when(slash > 0, 1).otherwise(2)
    pcn = primary.substr(F.lit(1), F.length(primary) - drop)
    second = F.when(slash > 0, rest.substr(slash + 1, F.length(rest))).otherwise("")
    dated = second.startswith("$$3")
    inner = lambda start: second.substr(F.lit(start), F.length(second) - start)
    lot = F.when(dated, inner(10)).when(second.startswith("$") & ~second.startswith("$$"), inner(2))
    ok = raw.startswith("+") & (F.length(body) >= 4) & (F.length(primary) > drop)
    return F.when(ok, F.struct(lic.alias("lic"), pcn.alias("pcn"), F.nullif(lot, F.lit("")).alias("lot"), gs1_date(F.when(dated, second.substr(4, 6))).alias("expiry")))


def half_up(c) -> Column:
    """Rounding of halves towards plus infinity."""
    return F.floor(c + 0.5).cast("long")


def unit_price_cents(price, qty) -> Column:
    """C10."""
    return F.when((price > 0) & (qty > 0), half_up(price / qty))


def comparable_price(unit, price, item_pack, offer_pack) -> Column:
    """C11: a unit price times the item's pack where the packs differ."""
    return F.when(unit.isNotNull() & item_pack.isNotNull() & ~item_pack.eqNullSafe(offer_pack), half_up(unit * item_pack)).otherwise(price)


def savings(paid, best, qty) -> Column:
    """C12."""
    return F.greatest(F.lit(0), half_up((paid - best) * qty))


def noisy_or(weights) -> Column:
    """Chance that at least one of several independent signals is right."""
    return 1 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - w))


def strength_band(p) -> Column:
    return F.when(p >= 0.8, "strong").when(p >= 0.45, "possible").when(p >= 0.3, "weak")


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """C14."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 3959 * F.asin(F.sqrt(a))


def ground_days(miles) -> Column:
    out = None
    for most, days in ((150, 1), (450, 2), (900, 3), (1500, 4), (2200, 5)):
        out = F.when(miles <= most, days) if out is None else out.when(miles <= most, days)
    return out.otherwise(6)


def add_business_days(start, days) -> Column:
    """The day that many working days after ``start``."""
    span = F.sequence(F.date_add(start, 1), F.date_add(start, days * 2 + 5))
    work = F.filter(span, lambda d: ~F.dayofweek(d).isin(1, 7))
    return F.when(days <= 0, start).otherwise(F.get(work, days - 1))


def shipping_cents(subtotal, free_threshold, flat, tiers) -> Column:
    """Free from the threshold on, else the highest tier reached, else the flat fee, else unknown."""
    reached = F.filter(F.array_sort(F.coalesce(tiers, F.array().cast("array<struct<min_subtotal_cents:bigint,flat_cents:bigint>>"))), lambda t: t["min_subtotal_cents"] <= subtotal)
    return F.when(free_threshold.isNotNull() & (subtotal >= free_threshold), F.lit(0).cast("long")).otherwise(F.coalesce(F.get(reached, F.size(reached) - 1)["flat_cents"], flat))


def lifecycle(pulled_at, expiration, as_of) -> Column:
    """Pulled, expired, expiring within 30 days, or active."""
    return F.when(pulled_at.isNotNull(), "pulled").when(expiration < as_of, "expired").when(expiration <= F.date_add(as_of, 30), "expiring").otherwise("active")


def attention_reason(identified, state, traced) -> Column:
    """C20: the first reason that holds."""
    return F.when(~identified, "unidentified").when(state == "expired", "expired").when(state == "expiring", "expiring").when(~traced, "missing_trace")


def clamp_int32(c) -> Column:
    """C22."""
    return F.least(F.greatest(c.cast("long"), F.lit(-(2**31))), F.lit(2**31 - 1)).cast("int")
