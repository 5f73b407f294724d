"""Raw bytes and web leads: character sets and site classes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values
LEAD_WORDS = {"supplier": ["dental supply", "add to cart", "catalog", "distributor"], "manufacturer": ["manufacturer", "made by us", "our factory"], "practice": ["book an appointment", "our dentists", "patients"]}


def decode_pages(raw: DataFrame, body: str = "body", charset: str = "charset") -> DataFrame:
    """bytes to text: the named charset, else the page's own, else UTF-8; a UTF-8 text with replacement
    characters is read again as windows-1252 and that is kept if it has fewer."""
    import re

    meta = re.compile(rb"<meta[^>]+charset=[\"']?([A-Za-z0-9_-]+)", re.I)

    def one(data: bytes | None, named: str | None) -> str | None:
        if data is None:
            return None
        found = meta.search(data[:4096])
        name = named or (found and found.group(1).decode("ascii")) or "utf-8"
        try:
            text = data.decode(name, "replace")
        except LookupError:
            text = data.decode("utf-8", "replace")
        if "�" in text:
            other = data.decode("windows-1252", "replace")
            text = other if other.count("�") < text.count("�") else text
        return text

    rest = [c for c in raw.columns if c != body]

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[rest].assign(text=[one(b, n) for b, n in zip(pdf[body], pdf[charset], strict=True)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.select(*rest).schema.fields), "text string"])
    return raw.mapInPandas(per_batch, schema)


def classify_lead(c, words: dict[str, list[str]] = LEAD_WORDS) -> Column:
    """(kind, confidence) by the words of each kind that a site's text has."""
    low = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    hits = [F.struct(sum((low.contains(w).cast("int") for w in ws[1:]), low.contains(ws[0]).cast("int")).alias("hits"), F.lit(-k).alias("order"), F.lit(kind).alias("kind")) for k, (kind, ws) in enumerate(words.items())]
    top = F.array_max(F.array(*hits))
    return F.struct(F.when(top["hits"] > 0, top["kind"]).otherwise("unknown").alias("kind"), F.least(F.lit(100), top["hits"] * 30 + 10).alias("confidence"))
