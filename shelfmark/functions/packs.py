"""Pack sizes read off texts such as ``100/Box``, ``Case of 10`` or ``24 x 1.2 mL``.

A text is cut into tokens and each token becomes one sign, so the text has a shape: ``100/Box`` is
``1/A``.  A rule is a pattern over shapes; as a sign is a token, the place where it fits says which
numbers and which word it means.  The first rule of a list that fits gives the pack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# --- fixed values: the words of each sign.  Numbers are 1 (up to 3 digits), 4 (4 or 5), 9 (longer) and
# 0 (with decimals), times is x, "of" is o, any other word w; punctuation stands for itself.
SIGNS: dict[str, list[str]] = {
    "A": ["box", "bx"],
    "a": ["boxes"],
    "C": ["case", "cs", "carton"],
    "c": ["cases", "cartons"],
    "D": ["ctn"],
    "E": ["each", "ea", "unit", "units", "piece", "pieces", "pc", "pcs"],
    "F": ["pk"],
    "f": ["pack"],
    "G": ["pkg"],
    "g": ["pkgs"],
    "p": ["package"],
    "H": ["bag", "jar", "tub", "sleeve", "roll", "kit"],
    "h": ["packs", "pks", "packages", "bags", "jars", "tubs", "sleeves", "rolls", "kits"],
    "I": ["can", "cn", "bottle", "btl", "tube", "spool"],
    "i": ["cans", "bottles", "tubes", "spools"],
    "J": ["ct", "count"],
    "K": ["syringe"],
    "d": ["ml", "cc", "mg", "gm", "g", "oz"],
    "e": ["l", "kg", "gram", "grams"],
}
MEASURE_NAMES = {"gm": "g", "gram": "g", "grams": "g"}
BASIS = {"box": "Aa", "case": "CcD", "pack": "FfGgpHhIiJ", "each": "E"}

_TOKEN = r"\d+\.\d+|\d+|[x×](?=[0-9])|[a-z][a-z0-9]*|\S"
_N, _NUMBER = "[14]", "[140]"
_DOSED = rf"(?<![.]){_N}[-x]{_NUMBER}d"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def _sign(t: Column) -> Column:
    table = F.create_map(*[F.lit(x) for sign, words in SIGNS.items() for w in words for x in (w, sign)], F.lit("of"), F.lit("o"), F.lit("x"), F.lit("x"), F.lit("×"), F.lit("x"))
    number = F.when(t.contains("."), "0").when(F.length(t) <= 3, "1").when(F.length(t) <= 5, "4").otherwise("9")
    return F.when(t.rlike("^[0-9]"), number).otherwise(F.coalesce(table[t], F.when(t.rlike("^[a-z]"), "w").otherwise(t)))


@dataclass(frozen=True)
class Rule:
    """``shape`` where it fits; the pack is the product of the tokens ``factors`` places after its start, and
    ``word`` is the place of its unit.  Places below 0 count from the end of the fit."""

    kind: str
    shape: str
    factors: tuple[int, ...]
    word: int | None = None
    basis: str | None = None
    most: int | None = None


@dataclass(frozen=True)
class Read:
    """A text's tokens and shape."""

    tokens: Column
    shape: Column

    def fit(self, r: Rule) -> tuple[Column, Column]:
        """(quantity, unit word) where the rule fits, else null."""
        at = F.regexp_instr(self.shape, F.lit(r.shape))
        size = F.length(F.regexp_extract(self.shape, r.shape, 0))
        token = lambda k: F.try_element_at(self.tokens, F.nullif(at + (F.lit(k) if k >= 0 else size + k), F.lit(0)).cast("int"))
        quantity = token(r.factors[0]).try_cast("decimal(18,3)")
        for k in r.factors[1:]:
            quantity = (quantity * token(k).try_cast("decimal(18,3)")).cast("decimal(18,3)")
        good = (at > 0) & (quantity > 0)
        if r.most:
            good = good & (quantity <= r.most)
        return F.when(good, quantity), (token(r.word) if r.word is not None else F.lit(None).cast("string"))


def over(text: Column, make: Callable[[Read], Column]) -> Column:
    """``make`` of the text's tokens and shape, which are found once a row however often they are used."""
    bound = lambda tokens: F.get(F.transform(F.array(F.array_join(F.transform(tokens, _sign), "")), lambda shape: make(Read(tokens, shape))), 0)
    return F.get(F.transform(F.array(_tokens(text)), bound), 0)


#: How many units a listing has, for matching.
UNITS = (
    Rule("dosed", _DOSED, (0,)),
    Rule("slash", rf"{_N}/[ACFfGHIJK]", (0,)),
    Rule("package of", rf"[FGp][.]?o{_N}", (-1,)),
    Rule("package", r"[FGp][.]?1", (-1,)),
    Rule("nested", rf"[ACGfH]o{_N}xGo{_N}", (2, 6)),
    Rule("nested", rf"[ACGfH]o{_N}x{_N}", (2, 4)),
    Rule("of", rf"[ACfH]o{_N}", (2,)),
    Rule("product", rf"[(]{_N}x{_N}[)]", (1, 3)),
    Rule("last", rf"[(]{_N}[)]$", (1,)),
    Rule("count", rf"{_N}J", (0,)),
)
#: A case of inner packs, each with its number.
NESTED = Rule("nested", rf"{_N}/[A-Za-z]x{_N}/[AaCcD]", (0, 4), basis="case", most=1_000_000)
#: What a stored pack holds: the second only where a size is not a dimension.
STORED = (
    Rule("dosed", _DOSED, (0,), basis="pack", most=100_000),
    Rule("product", rf"(?<![.]){_N}x{_N}(?![.])", (0, 2), basis="case", most=100_000),
    Rule("slash", rf"{_N}/[AaCcDEFfGgpHhIiJ]", (0,), 2),
    Rule("of", rf"[ACcFfGgpHh][.]?o{_N}", (-1,), 0),
    Rule("of", rf"[Gg][.]?{_N}", (-1,), basis="pack"),
    Rule("unit", rf"{_N}[JFfA]", (0,), 1),
    Rule("measure", rf"(?<![.]){_NUMBER}[de]", (0,), 1, basis="each"),
)
#: How far each kind is trusted, by where it stands.
TRUST = {"pack_size": {"slash": 0.92, "of": 0.92, "product": 0.92, "unit": 0.85, None: 0.78}, "name": {"slash": 0.7, "of": 0.7, "unit": 0.6, None: 0.55}}


def parse_pack_quantity(pack: Column, name: Column) -> Column:
    """units in a pack, from the pack text, else from the name; null when neither says."""
    units = lambda read: F.coalesce(*[read.fit(r)[0] for r in UNITS])
    return F.coalesce(over(pack, units), over(name, units)).cast("int")


def basis_of(word: Column) -> Column:
    """The basis that a unit word stands for, or null."""
    return F.create_map(*[F.lit(x) for basis, signs in BASIS.items() for s in signs for w in SIGNS[s] for x in (w, basis)])[word]


def parse_pack(pack_size: Column, name: Column) -> Column:
    """Quantity, base unit, basis, confidence and source of a stored pack."""
    def options(texts: dict[str, Read]) -> Column:
        def option(source: str, rule: Rule, trust: float) -> Column:
            quantity, word = texts[source].fit(rule)
            unit = F.lit("each")
            if rule.kind == "measure":
                unit = F.coalesce(F.create_map(*[F.lit(x) for kv in MEASURE_NAMES.items() for x in kv])[word], word)
            made = F.struct(quantity.cast("decimal(12,3)").alias("pack_quantity"), unit.alias("base_unit"), (F.lit(rule.basis) if rule.basis else basis_of(word)).alias("basis"), F.lit(trust).alias("confidence"), F.lit(source).alias("source"))
            return F.when(quantity.isNotNull(), made)

        found = [option("pack_size", NESTED, 0.92), option("name", NESTED, 0.8)]
        for source, trust in TRUST.items():
            found += [option(source, r, trust.get(r.kind, trust[None])) for r in STORED if source == "pack_size" or r.kind != "product"]
        return F.coalesce(*found)

    return over(pack_size, lambda a: over(name, lambda b: options({"pack_size": a, "name": b})))
