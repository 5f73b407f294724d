"""What is printed on packages and labels: dates, lots, catalog numbers of market places, places of postcodes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
#: First and last three-digit prefix of the postcodes of each state.
STATES = (
    (10, 27, "MA"), (28, 29, "RI"), (30, 38, "NH"), (39, 49, "ME"), (50, 59, "VT"), (60, 69, "CT"), (70, 89, "NJ"), (100, 149, "NY"),
    (150, 196, "PA"), (197, 199, "DE"), (200, 205, "DC"), (206, 219, "MD"), (220, 246, "VA"), (247, 268, "WV"), (270, 289, "NC"),
    (290, 299, "SC"), (300, 319, "GA"), (320, 349, "FL"), (350, 369, "AL"), (370, 385, "TN"), (386, 397, "MS"), (398, 399, "GA"),
    (400, 427, "KY"), (430, 459, "OH"), (460, 479, "IN"), (480, 499, "MI"), (500, 528, "IA"), (530, 549, "WI"), (550, 567, "MN"),
    (570, 577, "SD"), (580, 588, "ND"), (590, 599, "MT"), (600, 629, "IL"), (630, 658, "MO"), (660, 679, "KS"), (680, 693, "NE"),
    (700, 714, "LA"), (716, 729, "AR"), (730, 749, "OK"), (750, 799, "TX"), (800, 816, "CO"), (820, 831, "WY"), (832, 838, "ID"),
    (840, 847, "UT"), (850, 865, "AZ"), (870, 884, "NM"), (889, 898, "NV"), (900, 961, "CA"), (967, 968, "HI"), (970, 979, "OR"),
    (980, 994, "WA"), (995, 999, "AK"),
)

_BAR, _GAP = r"\s*[-/.]\s*", r"\s*[-/. ]\s*"
_YEAR, _TWO, _ONE, _NAME = r"(20\d{2})", r"(\d{2})", r"(\d{1,2})", r"([A-Z]{3,9})"
#: Shapes of dates in the order in which they are tried: a pattern, what its groups are (y year, m month, n month by
#: name, d day; a second reading where the first is no date), and whether it has a year of two digits.
SHAPES = (
    (_YEAR + _BAR + _ONE + _BAR + _ONE, ("ymd",), False),
    (_YEAR + _BAR + _ONE, ("ym",), False),
    (_ONE + _BAR + _ONE + _BAR + _YEAR, ("mdy", "dmy"), False),
    (_ONE + _BAR + _YEAR, ("my",), False),
    (_TWO + _BAR + _TWO + _BAR + _TWO, ("mdy", "dmy"), True),
    (_TWO + _BAR + _TWO, ("my",), True),
    (_ONE + _GAP + _NAME + _GAP + _YEAR, ("dny",), False),
    (_NAME + _GAP + _ONE + r"\s*[-/., ]\s*" + _YEAR, ("ndy",), False),
    (_NAME + _GAP + _YEAR, ("ny",), False),
    (_YEAR + _GAP + _NAME, ("yn",), False),
    (_ONE + _GAP + _NAME + _GAP + _TWO, ("dny",), True),
    (_NAME + _GAP + _TWO, ("ny",), True),
    (_YEAR + r"(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])", ("ymd",), False),
    (_YEAR + r"(0[1-9]|1[0-2])", ("ym",), False),
)
#: Letters that stand for digits in misread dates.
LOOKALIKES = ("OQILN|SBZG", "0011115826")


def _day(text: str, pattern: str, order: str, two: bool) -> str:
    """The ISO text of a date whose groups are in ``order``, as SQL; a month without a day means its last one."""
    part = lambda k: f"try_cast(regexp_extract({text}, r'{pattern}', {k + 1}) AS int)"
    where = {c: part(k) for k, c in enumerate(order)}
    if "n" in order:
        names = ", ".join(f"'{m}'" for m in MONTHS)
        where["m"] = f"array_position(array({names}), substr(regexp_extract({text}, r'{pattern}', {order.index('n') + 1}), 1, 3))"
    year = f"({where['y']} + 2000)" if two else where["y"]
    day = where.get("d", "0")
    last = f"day(last_day(make_date({year}, cast({where['m']} AS int), 1)))"
    return (
        f"CASE WHEN {year} BETWEEN 1990 AND 2099 AND {where['m']} BETWEEN 1 AND 12 AND {day} BETWEEN 0 AND 31"
        f" THEN format_string('%04d-%02d-%02d', {year}, cast({where['m']} AS int), CASE WHEN {day} > 0 THEN {day} ELSE {last} END) END"
    )


def _dated(text: str, short: bool) -> str:
    cases = []
    for body, orders, two in SHAPES:
        pattern = rf"\b{body}\b"
        if two and not short:
            continue
        found = f"coalesce({', '.join(_day(text, pattern, o, two) for o in orders)})"
        # a shape with a year of four digits decides; by name only if the name is a month's
        fits = f"regexp({text}, r'{pattern}')"
        if two:
            fits += f" AND {found} IS NOT NULL"
        elif "n" in orders[0]:
            fits += f" AND substr(regexp_extract({text}, r'{pattern}', {orders[0].index('n') + 1}), 1, 3) IN ({', '.join(repr(m) for m in MONTHS)})"
        cases.append(f"WHEN {fits} THEN {found}")
    return "CASE " + " ".join(cases) + " ELSE '' END"


def expiry(text: str, short: bool = False) -> Column:
    """The date (ISO text) that a printed date means, from an SQL expression; null if none.  A stroke that was read
    as punctuation is a 1, and where nothing else fits letters that look like digits are tried as digits; ``short``
    allows years of two digits, for texts that follow a word for expiry."""
    plain = f"regexp_replace(translate(upper(trim({text})), ';!:|', '1111'), r'\\s+', ' ')"
    again = f"translate(t, '{LOOKALIKES[0]}', '{LOOKALIKES[1]}')"
    retry = f"transform(array({again}), u -> CASE WHEN u <> t AND contains(t, '20') AND regexp(t, '[A-Z]') THEN {_dated('u', False)} ELSE '' END)[0]"
    return F.expr(f"nullif(transform(array({plain}), t -> transform(array({_dated('t', short)}), d -> CASE WHEN d = '' THEN {retry} ELSE d END)[0])[0], '')")


def gs1_expiry(text: str) -> Column:
    """YYMMDD as printed: years from 90 on are of the last century; a day 00 is the month's last."""
    year = f"try_cast(substr({text}, 1, 2) AS int)"
    full = f"concat(CASE WHEN {year} >= 90 THEN '19' ELSE '20' END, {text})"
    body = r"\b(\d{4})(\d{2})(\d{2})\b"
    return F.expr(f"CASE WHEN regexp({text}, r'^\\d{{6}}$') THEN {_day(full, body, 'ymd', False)} END")


def state_of_zip(zip_code) -> Column:
    """The state of a postcode by its first three digits."""
    prefix = F.regexp_extract(F.substring(F.trim(zip_code), 1, 3), r"^\d+", 0).try_cast("int")
    out = F.lit(None).cast("string")
    for low, high, state in STATES:
        out = F.when(prefix.between(low, high), state).otherwise(out)
    return out


def listing_id(url) -> Column:
    """what names a market place's listing in its URL: a ten-character number after its marker, digits before
    .html, a run of eight digits or more, else a digest of the URL without its query."""
    plain = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"^([A-Za-z]+://[^/]+)$", "$1/")
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    native = F.coalesce(found(url, r"/(?:dp|gp/product|gp/aw/d)/([A-Z0-9]{10})(?:[/?]|$)"), found(url, r"_(\d{6,})\.html"), found(plain, r"(\d{8,})"))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.coalesce(native, F.substring(F.sha1(plain), 1, 12)))
