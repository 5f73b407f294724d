"""Variant axes of product names, and labels, as column expressions.

AXES is a table: a row says where a value of an axis stands in a name.  One evaluator reads all rows.
SELECTORS says how an axis is shown and which goes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .text import plain_sql, strip_diacritics

# --- fixed values: words and patterns of the axes
COLORS = "black blue brown clear gold gray green grey orange pink purple red silver teal white yellow".split()
FLAVORS = "berry bubblegum cherry grape melon mint raspberry strawberry".split()
UNITS = "mm|cm|ml|cc|oz|gauge|ga|gr|kg|lb|in|l|%|g"
MEASURE_AXES = {"mm": "mm", "cm": "cm", "in": "in", "ga": "gauge|ga|g", "ml": "ml", "cc": "cc", "oz": "oz", "gr": "gr", "kg": "kg", "lb": "lb", "l": "l", "%": "%"}
PACK_WORDS = {"bx": "Box", "box": "Box", "pk": "Pack", "pkg": "Pack", "pack": "Pack", "cs": "Case", "case": "Case", "bg": "Bag", "bag": "Bag", "ea": "Each", "each": "Each"}
APPAREL = r"\b(?:masks?|gloves?|gowns?|bibs?|aprons?|drapes?|towels?|napkins?|scrubs?|face\s*shields?)\b"
CAD = r"\b(?:blocs?|milling\s+blocks?|cerec|cad\s*cam|planmill)\b"
CROWN = r"\bcrowns?\b|\b(?:primary|permanent|perm)\s+molar\b"
POINT = r"\b(?:paper\s+points?|absorbent\s+points?|gutta[\s-]?percha(?:\s+points?)?)\b"
DIAMOND_BUR = (r"\bdiamonds?\b", r"\b(?:burs?|hsb|striper|flame|round|taper|needle|cylinder|football|wheel|cone|pear|chamfer|inverted|fg)\b")
SUTURE, TETRIC = r"\bsutures?\b", (r"\btetric\b", r"\b(?:composite|powerfill|powerflow)\b")
LARGER = r"(?<!\b(?:xxx|xx|3x|2x|x|extra)[\s-]?)"
GRITS = (
    ("supercoarse", r"\bsuper\s*coarse\b"), ("superfine", r"\bsuper\s*fine\b"), ("extracoarse", r"\bextra\s*coarse\b"),
    ("extrafine", r"\bextra\s*fine\b"), ("coarse", r"\bcoarse\b"), ("medium", r"\bmedium\b"), ("fine", r"\bfine\b"),
)
GRIT_CODES = {"sf": "superfine", "sc": "supercoarse", "xf": "extrafine", "xc": "extracoarse", "c": "coarse", "f": "fine", "m": "medium"}


@dataclass(frozen=True)
class At:
    """Values of ``axis``: what ``find`` finds in ``field``, in names that fit all of ``where`` and not ``unless``.
    ``shape`` puts the found groups together; without groups it is the value itself."""

    axis: str
    find: str
    shape: str = "{1}"
    where: tuple[str, ...] = ()
    unless: str | None = None
    field: str = "low"
    last: bool = False


_NUMBER = r"(\d+(?:\.\d+)?)"
AXES: tuple[At, ...] = (
    *(At(a, rf"{_NUMBER}\s*(?:x\s*{_NUMBER}\s*)?(?:{u})\b") for a, u in MEASURE_AXES.items()),
    *(At(a, rf"\d+(?:\.\d+)?\s*x\s*{_NUMBER}\s*(?:{u})\b") for a, u in MEASURE_AXES.items()),
    *(At(f"{u}_dim", rf"{_NUMBER}\s*x\s*{_NUMBER}\s*{u}\b", "{1}x{2}") for u in ("mm", "cm", "in")),
    *(At(f"{u}_dim", rf"{_NUMBER}\s*{u}\s*x\s*{_NUMBER}\s*{u}\b", "{1}x{2}") for u in ("mm", "cm", "in")),
    *(At(f"bur_{side}", rf"{_NUMBER}\s*mm\s+{side}\b", where=(r"\b(?:burs?|diamonds?)\b",)) for side in ("diameter", "length")),
    At("shade", r"\b([a-d][1-7](?:\.5)?)(?:[bet])?\b"),
    At("shade", r"\b(?:x[\s-]?w[be]?|(?:extra|xtra)[\s-]?white)\b", "xw", unless=APPAREL),
    At("shade", r"\b(?:wb|whb|white)\b", "w", unless=APPAREL),
    At("shade", r"\biv([abw])\b", "iv{1}", where=TETRIC),
    At("excite_f_variant", r"\bdsc\b", "dsc", where=(r"\bexcite\b", r"\bf\b", r"\badhesive\b")),
    At("excite_f_variant", r"\bexcite\b", "regular", where=(r"\bf\b", r"\badhesive\b"), unless=r"\bdsc\b"),
    At("topical_fluoride_flavor", rf"\b({'|'.join(FLAVORS)})\b", where=(r"\b(?:fluoride|apf)\b", r"\bgels?\b"), unless=r"\bdye[\s-]?free\b"),
    At("topical_fluoride_flavor", rf"\b({'|'.join(f for f in FLAVORS if f != 'mint')})\b", where=(r"\b(?:fluoride|apf)\b", r"\bgels?\b", r"\bdye[\s-]?free\b")),
    At("topical_fluoride_flavor", r"\bmint\b", "dye_free_mint", where=(r"\b(?:fluoride|apf)\b", r"\bgels?\b", r"\bdye[\s-]?free\b")),
    *(At("cad_block_translucency", rf"\b(?:{t}|{word}\s+translucency)\b", t, where=(CAD,)) for t, word in (("ht", "high"), ("lt", "low"), ("mt", "medium"))),
    At("cad_block_size", r"\bsize\s*(\d{1,2}l?)\b", where=(CAD,)),
    At("cad_block_size", r"\b(\d{1,2}l?)\s+(?:[a-d][1-7](?:\.5)?|bl)\b", where=(CAD,)),
    *(At("color", rf"\b{c}\b", "gray" if c == "grey" else c) for c in COLORS),
    At("cotton_roll_style", r"\b(?:(?:econo|economy)\s+(?:cotton\s+)?rolls?|(?:cotton\s+)?rolls?\s+(?:econo|economy))\b", "econo"),
    At("cotton_roll_style", r"\bbraided\b", "braided", where=(r"\b(?:cotton\s+)?rolls?\b",)),
    At("cotton_roll_style", r"\bwrapped\b", "wrapped", where=(r"\b(?:cotton\s+)?rolls?\b",)),
    At("dim", r"\b(\d{1,2})\s*x\s*(\d{1,2})\b(?!\s*(?:mm|cm|ml|cc|oz|in|g|x|\.|/))", "{1}x{2}"),
    At("taper", r"(?:^|[^0-9.])\.(\d{2})\b", "0.{1}"),
    At("#", r"#\s?(\d+(?:/\d+)?)"),
    At("suture_size", r"\b(\d{1,2})\s*[-–/]\s*0\b", "{1}-0", where=(SUTURE,)),
    At("suture_length", r'\b(\d{1,2})\s*(?:"|\bin(?:ch(?:es)?)?\b)', where=(SUTURE,)),
    At("suture_needle", r"\b([a-z]{1,3})\s*-?\s*(\d{1,2}[a-z]?)\b", "{1}{2}", where=(SUTURE,)),
    At("needle_length", r"\b(short|long)\b", where=(r"\bneedles?\b",)),
    At("crown_size", r"\bsize\s*(00|0|[1-9])\b", where=(CROWN,)),
    At("crown_size", r"\b(?:[1-6])?(?:ur|ul|lr|ll)(00|0|[1-9])\b", where=(CROWN,)),
    At("crown_size", r"\b(00|0|[1-9])(?:ur|ul|lr|ll)\b", where=(CROWN,)),
    At("handpiece_model", r"\bz\s*[- ]?(\d{3,4})\s*([a-z]{1,3})\b", "z{1}{2}", where=(r"\bhandpieces?\b", r"\b(?:nsk|ti[\s-]?max)\b"), unless=r"\breplacement\s+parts?\b", last=True),
    At("unitek_crown_model", r"\b(9\d{5})\b", where=(r"\bunitek\b", r"\bcrowns?\b"), field="coded"),
    At("endo_point_material", r"\bpaper\s+points?\b|\babsorbent\s+points?\b", "paper"),
    At("endo_point_material", r"\bgutta[\s-]?percha\b", "gutta_percha"),
    At("endo_point_size", r"\b((?:f|sm|ml)[1-5])\b", where=(POINT,)),
    At("size", r"\b(?:(?:xxx|xx|3x|2x|x|extra)[\s-]?)small\b|\bxs\b", "XS"),
    At("size", LARGER + r"\bsmall\b", "S"),
    At("size", r"\b(?:(?:xxx|xx|3x|2x|x|extra)[\s-]?)?medium\b", "M"),
    At("size", LARGER + r"\blarge\b", "L"),
    At("size", r"\b(?:x|extra)[\s-]?large\b|\bxl\b", "XL"),
    At("size", r"\b(?:xx|2x)[\s-]?large\b|\bxxl\b|\b2xl\b", "2XL"),
    At("size", r"\b(?:xxx|3x)[\s-]?large\b|\bxxxl\b|\b3xl\b", "3XL"),
    At("wallshoulders_model", r"^((?:GS|WS)\d{4}[A-Z])$", where=(r"\bwall\s*shoulders\b", r"\bx[\s-]?ray\s+apron\s+hanger\b"), field="code"),
    At("pdt_instrument_model", r"(R\d{3}R?)$", where=(r"\b(?:pdt|paradise\s+dental|amazing\s+gracey)\b",), field="code"),
    At("tooth_arch_position", r"\b([ul][12][1-8])\b", where=(r"\brim\s*lock\b", r"\bimpression\b", r"\btrays?\b")),
    At("electrode_model", r"\br[-\s]?([cfl]\d{1,2})\b", where=(r"\belectrode\b", r"\brigid\b")),
    At("piezo_tip_model", r"\b((?:er|s|p)\d{1,2}r?)\b", where=(r"\bpiezo\b", r"\btips?\b")),
    At("bur_iso_number", r"\b(\d{2}-[a-z](?:/\d{2}-[a-z])?)\b", where=(r"\bcarbide\b", r"\bburs?\b", r"\bgoldies?\b")),
    # the first grit word counts; codes count where no word is
    *(At("diamond_bur_grit", find, g, where=DIAMOND_BUR, unless="|".join(f for _, f in GRITS[:k]) or None) for k, (g, find) in enumerate(GRITS)),
    *(At("diamond_bur_grit", rf"\b\d{{2,3}}[.\-]\d{{1,3}}{c}\b", g, where=DIAMOND_BUR, unless="|".join(f for _, f in GRITS)) for c, g in GRIT_CODES.items()),
)


@dataclass(frozen=True)
class Selector:
    """How an axis is shown.  ``order`` lists its values; without it numbers in the value decide."""

    priority: int
    label: str
    shown: str = "{}"
    order: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    pattern: str | None = None


SELECTORS: dict[str, Selector] = {
    "cotton_roll_style": Selector(1, "Style", "capital", ("braided", "econo", "wrapped"), ("econo", "economy", "braided", "wrapped")),
    "needle_length": Selector(2, "Length", "capital", ("short", "long"), ("short", "long")),
    "size": Selector(3, "Size", "size", ("XS", "S", "M", "L", "XL", "2XL", "3XL"), ("small", "medium", "large", "xs", "xl", "xxl", "xxxl", "2xl", "3xl", "extra")),
    "shade": Selector(4, "Shade", "upper", pattern=r"^[a-d][1-7](\.5)?$"),
    "taper": Selector(5, "Taper", "{} Taper"),
    "#": Selector(6, "Number", "#{}"),
    **{u: Selector(p, n, "{}%" if u == "%" else "{} " + u) for u, p, n in (
        ("mm", 7, "Length"), ("cm", 8, "Length"), ("in", 9, "Length"), ("ga", 10, "Gauge"), ("ml", 11, "Volume"), ("cc", 12, "Volume"), ("oz", 13, "Weight"),
        ("gr", 14, "Weight"), ("kg", 15, "Weight"), ("lb", 16, "Weight"), ("l", 17, "Volume"), ("%", 18, "Concentration"))},
    "tooth_arch_position": Selector(30, "Tray Position", "upper", pattern=r"^[ul][12][1-8]$"),
    "electrode_model": Selector(31, "Model", "upper", pattern=r"^[cfl]\d{1,2}$"),
    "piezo_tip_model": Selector(32, "Tip", "upper", pattern=r"^(?:er|s|p)\d{1,2}r?$"),
    "bur_iso_number": Selector(33, "ISO Number", "upper"),
    "color": Selector(40, "Color", "capital", tuple(COLORS), tuple(COLORS)),
}
SIZE_NAMES = {"XS": "X-Small", "S": "Small", "M": "Medium", "L": "Large", "XL": "X-Large", "2XL": "2X-Large", "3XL": "3X-Large"}


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _literal(pattern: str) -> str:
    return f"r'{pattern}'" if "'" not in pattern else f'r"{pattern}"'


def _values(a: At) -> str:
    """The array of values that one row of AXES finds in the fields of f."""
    text, find, none = f"f.{a.field}", _literal(a.find), "cast(array() AS array<string>)"
    if "{" not in a.shape:
        out = f"if(regexp({text}, {find}), array('{a.shape}'), {none})"
    elif "{2}" in a.shape:
        before, between = a.shape.split("{1}")
        middle = between.split("{2}")[0]
        out = f"zip_with(regexp_extract_all({text}, {find}, 1), regexp_extract_all({text}, {find}, 2), (x, y) -> concat('{before}', x, '{middle}', y))"
    else:
        before, after = a.shape.split("{1}")
        out = f"filter(regexp_extract_all({text}, {find}, 1), v -> v <> '')"
        if before or after:
            out = f"transform({out}, v -> concat('{before}', v, '{after}'))"
    if a.last:
        out = f"slice({out}, -1, 1)"
    named = "f.named" if a.field == "code" else "f.low"
    fits = [f"regexp({named}, {_literal(w)})" for w in a.where] + ([f"NOT regexp({named}, {_literal(a.unless)})"] if a.unless else [])
    return f"if({' AND '.join(fits)}, {out}, {none})" if fits else out


def axis_values(name: str, code: str = "''", raw_code: str = "''", brand: str = "''") -> Column:
    """Map of axis to its sorted distinct values, axes without a value left out.  The arguments are SQL
    expressions: ``code`` is the normalised code of the maker, ``raw_code`` the code as it stands.

    One SQL text over the fields, which are computed once a row."""
    low = f"lower({plain_sql(name)})"
    fields = f"named_struct('low', {low}, 'code', {code}, 'coded', concat_ws(' ', {raw_code}, {low}), 'named', concat_ws(' ', {low}, lower({brand})))"
    rows: dict[str, list[str]] = {}
    for a in AXES:
        rows.setdefault(a.axis, []).append(_values(a))
    clean = r"v -> regexp_replace(v, r'^0+(\d)', '$1')"
    entries = ", ".join(f"struct('{a}' AS k, array_sort(array_distinct(transform(concat({', '.join(vs)}), {clean}))) AS v)" for a, vs in rows.items())
    return F.expr(f"transform(array({fields}), f -> map_from_entries(filter(array({entries}), e -> size(e.v) > 0)))[0]")


def selector(values: Column) -> Column:
    """ER12: (axis, label, value) of the first axis by priority with exactly one value."""
    def first(found: Column) -> Column:
        out = None
        for a, x in sorted(SELECTORS.items(), key=lambda kv: kv[1].priority):
            hit = F.struct(F.lit(a).alias("axis"), F.lit(x.label).alias("label"), F.get(found[a], 0).alias("value"))
            out = F.when(F.size(found[a]) == 1, hit) if out is None else out.when(F.size(found[a]) == 1, hit)
        return out

    return F.get(F.transform(F.array(values), first), 0)  # the values are found once


def format_variant(axis: str, value: Column) -> Column:
    """(label, rank) of a value of an axis, shown and in the order of its selector."""
    x = SELECTORS.get(axis, Selector(99, axis, "{} " + axis))
    number = F.coalesce(F.regexp_extract(value, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
    shown = {
        "capital": lambda: F.initcap(value), "upper": lambda: F.upper(value),
        "size": lambda: F.coalesce(F.create_map(*[F.lit(t) for kv in SIZE_NAMES.items() for t in kv])[value], value),
    }.get(x.shown, lambda: F.concat(*[F.lit(t) for t in x.shown.split("{}")[:1]], value, F.lit(x.shown.split("{}")[-1])))
    rank = F.floor(number * 100 + 0.5).cast("int")
    if x.order:
        place = F.array_position(F.array(*map(F.lit, x.order)), value)
        rank = F.when(place > 0, place - 1).otherwise(99).cast("int")
    elif axis == "shade":
        rank = F.ascii(F.upper(value)) * 1000 + rank
    return F.struct(shown().alias("label"), rank.alias("rank"))


def is_strip_token(word: Column, axis: str | None = None) -> Column:
    """Whether a name word only says a value of an axis (of any selector without ``axis``)."""
    out = F.lit(False)
    for a, x in SELECTORS.items():
        if axis in (None, a):
            out = out | word.isin(list(x.words)) if x.words else out
            out = out | word.rlike(x.pattern) if x.pattern else out
    return out


def axes_conflict(a: Column, b: Column) -> Column:
    """whether two products have an axis in common whose values do not meet."""
    return F.exists(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: ~F.arrays_overlap(a[k], b[k]))


def axis_agreements(a: Column, b: Column) -> Column:
    """number of values that two products have in common, over all axes."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(shared, F.lit(0), lambda n, k: n + F.size(F.array_intersect(a[k], b[k])))


def bare_conflict(a: Column, b: Column) -> Column:
    """whether both have loose numbers, and none in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def pack_label(quantity, basis, base_unit, raw) -> Column:
    """how a pack is shown."""
    q = F.regexp_replace(quantity.cast("string"), r"\.0+$", "")
    word = F.initcap(basis)
    return (
        F.when(quantity.isNotNull() & base_unit.isNotNull() & (base_unit != "each"), F.concat_ws(" ", q, base_unit))
        .when(quantity.isNotNull() & basis.isin("box", "case", "pack"), F.concat(q, F.lit("/"), word))
        .otherwise(F.coalesce(F.nullif(normalize_pack_text(raw), F.lit("")), F.concat(q, F.lit("/Pack")), F.lit("")))
    )


def normalize_pack_text(raw) -> Column:
    out = F.coalesce(raw, F.lit(""))
    for short, full in PACK_WORDS.items():
        out = F.regexp_replace(out, rf"(?i)(\d+)\s*/\s*{short}\b\.?", f"$1/{full}")
    return out


def listing_name_differs(a, b) -> Column:
    """whether two names differ beyond pack words."""
    words = lambda c: F.filter(F.split(F.lower(strip_diacritics(c)), "[^a-z0-9.]+"), lambda w: (w != "") & ~w.rlike(r"^\d+$") & ~w.isin(list(PACK_WORDS)))
    return (F.size(F.array_except(words(a), words(b))) > 0) | (F.size(F.array_except(words(b), words(a))) > 0)


def identity_query(c) -> Column:
    """up to eight distinct words of letters."""
    words = _all(F.lower(strip_diacritics(c)), r"\b([a-z]{3,})\b")
    return F.array_join(F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin("lot", "exp", "ref", "the", "and", "for", "with"))), 1, 8), " ")


def catalog_refs(c) -> Column:
    """references after a marker, then codes by shape; five at most."""
    t = F.upper(F.coalesce(c, F.lit("")))
    marked = _all(t, r"\b(?:REF|CAT|ITEM|SKU)\.?\s*(?:NO\.?|#|:)?\s*([A-Z0-9][A-Z0-9-]{2,})")
    shaped = F.filter(_all(t, r"\b([A-Z]{1,4}-?[0-9]{3,}[A-Z]?)\b"), lambda w: F.length(w) >= 5)
    return F.slice(F.array_distinct(F.concat(marked, shaped)), 1, 5)


def lot_and_expiry(c) -> Column:
    """lot and expiry printed on a label, for the common shapes."""
    t = F.upper(F.coalesce(c, F.lit("")))
    lot = F.regexp_extract(t, r"\b(?:LOT|BATCH|LOTE|CH\.?-?B\.?)\s*(?:NO\.?|#|:)?\s*([A-Z0-9][A-Z0-9-]{2,})", 1)
    iso = F.regexp_extract(t, r"\b(?:EXP|EXPIRY|USE BY|CAD)[^0-9]{0,8}(20[0-9]{2}[-/.][01][0-9](?:[-/.][0-3][0-9])?)", 1)
    plain = F.regexp_replace(iso, "[/.]", "-")
    day = F.when(F.length(plain) == 7, F.last_day(F.try_to_date(F.concat(plain, F.lit("-01")), "yyyy-MM-dd"))).otherwise(F.try_to_date(plain, "yyyy-MM-dd"))
    return F.struct(F.nullif(lot, F.lit("")).alias("lot"), F.when(plain != "", day).alias("expiry"))


def decode_entities(c) -> Column:
    """named and numeric entities, spaces and a doubled variant suffix."""
    out = F.coalesce(c, F.lit(""))
    for name, char in (("nbsp", " "), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("reg", "®"), ("trade", "™"), ("deg", "°"), ("times", "×"), ("#39", "'"), ("#x27", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    out = F.trim(F.regexp_replace(out, r"[\s ]+", " "))
    return F.regexp_replace(out, r"(?i)( - [^-]{2,40})\1$", "$1")


def clean_product_name(c) -> Column:
    """decoded; a question mark where a symbol was lost becomes a space, and the spacing around it is put right (a
    name without one keeps its own); options after the last dash go if there are two or more, each of them in the
    name before it."""
    name = decode_entities(c)
    mended = F.trim(F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("?"), F.lit(" ")), r"\s+,", ","), r"\s{2,}", " "))
    name = F.when(F.contains(name, F.lit("?")), mended).otherwise(name)
    # what follows reads the name several times: it is bound to a name of its own
    return F.get(F.transform(F.array(name), _without_options), 0)


def _without_options(name: Column) -> Column:
    tail = F.substring_index(name, " - ", -1)
    head = F.trim(F.substring(name, F.lit(1), F.length(name) - F.length(tail) - 3))
    options = F.filter(F.transform(F.split(tail, " / "), F.trim), lambda o: o != "")
    redundant = F.contains(name, F.lit(" - ")) & (F.size(options) >= 2) & F.forall(options, lambda o: F.contains(F.lower(head), F.lower(o)))
    return F.when(redundant, head).otherwise(name)


def family_name(c) -> Column:
    """a name without measures, packs and trailing joints."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)\b\d+(?:\.\d+)?\s*(?:{UNITS.replace('|%', '')})\b|\b\d+\s*/\s*[a-z]+\b|#\s?\d+", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"[\s,;:-]+$", "")


def taxonomy(category, name, rules: list[tuple[str, list[str]]]) -> Column:
    """the department of (category, name): an alias that is the category scores 120, one inside it
    90, one inside the name 55; the first best rule wins."""
    cat, nm = F.lower(F.trim(F.coalesce(category, F.lit("")))), F.lower(F.coalesce(name, F.lit("")))
    scores = []
    for k, (department, words) in enumerate(rules):
        best = F.lit(0)
        for w in words:
            best = F.greatest(best, F.when(cat == w, 120).when(cat.contains(w), 90).when(nm.contains(w), 55).otherwise(0))
        scores.append(F.struct(best.alias("score"), F.lit(-k).alias("order"), F.lit(department).alias("department")))
    top = F.array_max(F.array(*scores))
    return F.when(top["score"] > 0, top["department"])
