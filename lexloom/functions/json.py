"""Canonical JSON, digests over it, and JSON found in free text."""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batched


def _number(x: float) -> str:
    """The shortest text of a number, whole ones without a point, powers from 1e21 and below 1e-6; -0 is 0."""
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    if x == 0:
        return "0"
    sign, digits, power = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + power  # 0.digits * 10 ** point
    if point > 21 or point < -5:
        tail = "." + text[1:] if len(text) > 1 else ""
        out = f"{text[0]}{tail}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    elif point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"
    return "-" + out if sign else out


def canonical(value) -> str:
    """JSON text with keys in UTF-16 code-unit order, no spaces, and letters as they are."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int | float):
        return _number(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    raise TypeError(f"no JSON form for {type(value).__name__}")


@batched("string")
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null for null and for what is no JSON."""

    def one(x):
        try:
            return None if x is None else canonical(json.loads(x, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c))))
        except ValueError:
            return None

    return texts.map(one)


def digest(domain: str, *parts: Column) -> Column:
    """sha256 of the parts joined by NUL after a domain name; nulls count as the text null."""
    return F.sha2(F.concat_ws("\u0000", F.lit(domain), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256)


def unit_identity(platform: Column, filters: Column, tokens: Column, domain: str = "lexloom.unit.v1") -> Column:
    """Content address of a search: platform, canonical filters and sorted tokens; names and wording do not matter."""
    return digest(domain, platform, filters, F.to_json(F.array_sort(tokens)))


def listing_hash(title: Column, summary: Column, url: Column, published: Column, payload: Column, domain: str = "lexloom.listing.v1") -> Column:
    return digest(domain, title, F.coalesce(summary, F.lit("")), url, published, payload)


def content_hash(domain: str = "lexloom.content.v1", **fields: Column) -> Column:
    """Digest of all named fields in the order of their names; provenance is left out by not passing it."""
    parts = [x for name in sorted(fields) for x in (F.lit(name), fields[name])]
    return digest(domain, *parts)


def find_json(text: str | None) -> str | None:
    """JSON in a model's answer: the whole, else a fenced part, else the first balanced span that parses."""
    if text is None:
        return None

    def ok(x: str) -> str | None:
        try:
            json.loads(x)
        except ValueError:
            return None
        return x.strip()

    if (found := ok(text)) is not None:
        return found
    for k, part in enumerate(text.split("```")):
        if k % 2:
            head, _, body = part.partition("\n")
            for x in (body if head.strip().isalpha() else part, part):
                if x and (found := ok(x)) is not None:
                    return found
    for begin, letter in enumerate(text):
        if letter not in "{[":
            continue
        depth, quoted, skip = [], False, False
        for end in range(begin, len(text)):
            c = text[end]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth.append("}" if c == "{" else "]")
            elif c in "}]":
                if not depth or depth.pop() != c:
                    break
                if not depth:
                    if (found := ok(text[begin : end + 1])) is not None:
                        return found
                    break
    return None


@batched("string")
def extract_json(texts: pd.Series) -> pd.Series:
    return texts.map(find_json)


def path(value: Column, where: str, kind: str = "string") -> Column:
    """A typed value at a path of a VARIANT; null where it is missing or of another type."""
    return F.try_variant_get(value, where, kind)


def set_field(value: Column, name: str, new: Column) -> Column:
    """A map with one key replaced."""
    return F.map_concat(F.map_filter(value, lambda k, _: k != name), F.create_map(F.lit(name), new))


def drop_field(value: Column, name: str) -> Column:
    return F.map_filter(value, lambda k, _: k != name)
