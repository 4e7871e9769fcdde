"""Search profiles: the schema that a model's answer must meet, and the template that asks for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t

VERSION, MOST_SEARCHES = 1, 8
#: Letters that a text of a search may have.
LENGTHS = {"name": (2, 100), "rationale": (2, 300), "query": (2, 100)}


def read(text: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """struct(version, searches) of a stored profile, texts trimmed; null unless all of it meets the schema.

    extra: further fields of a search with their allowed values.
    """
    extra = extra or {}
    fields = [*LENGTHS, *extra]
    parsed = F.from_json(text, f"version int, searches array<struct<{','.join(f'{x}:string' for x in fields)}>>")
    trimmed = F.transform(parsed["searches"], lambda s: F.struct(*[F.regexp_replace(s[x], f"^{t.SPACE}+|{t.SPACE}+$", "").alias(x) for x in fields]))

    def good(s: Column) -> Column:
        ok = F.lit(True)
        for name, (least, most) in LENGTHS.items():
            ok = ok & F.coalesce(F.length(s[name]).between(least, most), F.lit(False))
        for name, allowed in extra.items():
            ok = ok & F.coalesce(s[name].isin(allowed), F.lit(False))
        return ok

    whole = F.coalesce((parsed["version"] == VERSION) & (F.size(trimmed) <= MOST_SEARCHES) & F.forall(trimmed, good), F.lit(False))
    return F.when(whole, F.struct(parsed["version"].alias("version"), trimmed.alias("searches")))


def template(platform: str, name: str, language: str, rules: tuple[str, ...] = ()) -> dict:
    """What a model is told of the profile it has to give for a platform."""
    return {
        "platform": platform,
        "version": VERSION,
        "purpose": f"Generate title searches for {name}.",
        "shape": {"version": VERSION, "searches": [{"name": "CV track", "rationale": "Direct CV evidence", "query": "role title"}]},
        "capabilities": {"max_searches": MOST_SEARCHES, "query_language": language},
        "rules": [f"Return at most {MOST_SEARCHES} searches.", "Use one concise role title per query.", *rules],
    }
