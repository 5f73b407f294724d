"""Departments of products by a table of rules that the caller gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Scores of an alias that is the category, one inside it, the category pattern and the product pattern, the latter two
#: also where the category says nothing (fixed values).
ALIAS, INSIDE, CATEGORY, GENERIC_CATEGORY, PRODUCT, GENERIC_PRODUCT = 120, 90, 70, 25, 35, 55


@dataclass(frozen=True)
class Rule:
    """A department: names that mean it, a pattern for categories and one for all of a product's text, and
    (name, pattern) of its parts."""

    slug: str
    department: str
    aliases: tuple[str, ...]
    category: str
    product: str
    parts: tuple[tuple[str, str], ...] = ()


def key(text) -> Column:
    """Lower-case words; & is "and"."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))


def plain(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower().replace("&", "and")).split())


def classify(category, subcategory, name, rules: list[Rule], generic: tuple[str, ...] = ("general", "uncategorized")) -> Column:
    """(department, part, confidence) of the rule with the highest score, the first of equals; null without any."""
    said, joined = key(category), F.concat_ws(" ", F.nullif(category, F.lit("")), F.nullif(subcategory, F.lit("")))
    everything = F.concat_ws(" ", joined, F.nullif(name, F.lit("")))
    vague = said.isin("", *generic)
    scores = []
    for place, r in enumerate(rules):
        names = [plain(a) for a in r.aliases]
        inside = F.lit(False)
        for a in names:
            inside = inside | said.contains(a)
        score = F.when(said.isin(names), ALIAS).when(~vague & inside, INSIDE).otherwise(0)
        score = score + F.when(joined.rlike(f"(?i){r.category}"), F.when(vague, GENERIC_CATEGORY).otherwise(CATEGORY)).otherwise(0)
        score = score + F.when(everything.rlike(f"(?i){r.product}"), F.when(vague, GENERIC_PRODUCT).otherwise(PRODUCT)).otherwise(0)
        part = F.lit(r.department)
        for n, p in reversed(r.parts):
            part = F.when(everything.rlike(f"(?i){p}"), n).otherwise(part)
        scores.append(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(r.department).alias("department"), part.alias("part")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, F.struct(best["department"].alias("department"), best["part"].alias("part"), F.least(best["score"], F.lit(100)).alias("confidence")))


def display(category, rules: list[Rule], empty: str = "Other") -> Column:
    """F32: the department that a category names by its name, slug or an alias, else the category with capitals."""
    said = key(category)
    words = F.filter(F.split(F.trim(F.coalesce(category, F.lit(""))), r"\s+"), lambda w: w != "")
    shown = F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))), " ")
    out = F.when(F.size(words) == 0, F.lit(empty)).otherwise(shown)
    for r in reversed(rules):
        named = (said == plain(r.department)) | (F.replace(said, F.lit(" "), F.lit("-")) == r.slug) | said.isin([plain(a) for a in r.aliases])
        out = F.when(named, r.department).otherwise(out)
    return out
