"""Text scalars: cleaning, search keys, identities, redaction, hashing."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "[\u0300-\u036f]"  # combining marks that fall away


def _decomposed() -> dict[str, str]:
    """Every other character whose full canonical decomposition is an ASCII letter or digit and marks, and that in lower
    case. What decomposes to anything else is no part of a search key."""
    out = {}
    for code in range(128, sys.maxunicode + 1):
        if not unicodedata.decomposition(chr(code)):
            continue
        bare = re.sub(MARKS, "", unicodedata.normalize("NFD", chr(code)))
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            out[chr(code)] = bare.lower()
    return out


_FOLDED = _decomposed()
ACCENTS, PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())


def clean(text: Column, longest: int = 120) -> Column:
    return F.substring(F.btrim(F.regexp_replace(text, r"\s+", " ")), 1, longest)


def folded(text: Column) -> Column:
    """Lower case, decomposed, without combining marks; characters beyond ASCII cost a look-up only where there are any."""
    bare = F.regexp_replace(F.translate(text, ACCENTS, PLAIN), MARKS, "")
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(bare))


def search_key(text: Column) -> Column:
    return F.btrim(F.regexp_replace(folded(text), "[^a-z0-9]+", " "))


def country_name(code: Column) -> Column:
    return F.when(code == "CAN", "Canada").when(code == "USA", "United States America").otherwise("Mexico")


def city_text(name: Column, search_name: Column, region: Column, country: Column) -> Column:
    return search_key(F.concat_ws(" ", name, search_key(search_name), region, country, country_name(country)))


def city_identity(country: Column, region: Column, name: Column) -> Column:
    return F.concat_ws(":", country, region, name)


def name_tokens(name: Column) -> Column:
    """Distinct words of four or more letters and digits, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(search_key(name), " "), lambda w: F.length(w) >= 4)))


def shares_tokens(a: Column, b: Column) -> Column:
    """One set of name tokens, not empty, holds the other."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return some & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def concentration_label(v: Column, top: float = 250) -> Column:
    near = F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10)
    return F.when(v.isNull() | (v < 1), "<1").when(v >= top, f"{top:g}+").when(v < 10, near).otherwise(F.floor(v + 0.5).cast("string"))


def lon_lat_label(lon: Column, lat: Column) -> Column:
    side = lambda v, plus, minus: F.concat(F.format_string("%.2f", F.abs(v)), F.lit("° "), F.when(v >= 0, plus).otherwise(minus))
    return F.concat(side(lat, "N", "S"), F.lit(", "), side(lon, "E", "W"))


def country_of(code: Column, state: Column, identifier: Column) -> Column:
    """US, CA or MX from a country code, else a state code, else the identifier's shape; else null."""
    c, s = F.upper(F.btrim(F.coalesce(code, F.lit("")))), F.upper(F.btrim(F.coalesce(state, F.lit(""))))
    d = F.regexp_replace(identifier, "[^0-9]", "")
    shaped = ((F.length(d) == 12) & d.startswith("840")) | (F.length(d).isin(8, 9) & identifier.rlike(r"^[0-9]+(-[0-9]+)*$"))
    known = F.when(c.isin("US", "USA", "840"), "US").when(c.isin("CA", "CAN", "124"), "CA").when(c.isin("MX", "MEX", "484"), "MX")
    return F.coalesce(known, F.when(s == "CC", "CA").when(s == "MX", "MX").when(shaped, "US"))


def source_of(source: Column, identifier: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), F.substring_index(identifier, ":", 1))


def first_identifier(*ids: Column) -> Column:
    return F.coalesce(*[F.nullif(F.btrim(i, F.lit("{} ")), F.lit("")) for i in ids])


def redacted(text: Column) -> Column:
    """Values of key-like parameters and bearer tokens replaced."""
    text = F.regexp_replace(text, r"(?i)((?:api_?key|token|secret|password)=)[^&\s]+", "$1[REDACTED]")
    return F.regexp_replace(text, r"(?i)(bearer )[A-Za-z0-9._-]+", "$1[REDACTED]")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 20)


def asset_path(url: Column) -> Column:
    """Path of a content-addressed asset in a URL, without query and fragment; else null."""
    path = F.regexp_extract(url, r"(context/assets/[^?#]*)", 1)
    return F.when(path.rlike(r"^context/assets/[A-Za-z0-9._/-]+$"), path)


def list_signature(entries: Column) -> Column:
    """SHA-256 of an array of (id, name) structs in its order."""
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat_ws("\t", e["id"], e["name"])), "\n"), 256)


def url_leaves(json: Column) -> Column:
    """Values of all keys of a JSON document, at any depth, that are `url` or end with `Url`."""
    return F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]*Url|url)"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))


def safe_path(path: Column) -> Column:
    """A relative path of plain characters without empty, `.` or `..` parts."""
    plain = path.rlike(r"^[A-Za-z0-9._/-]+$") & ~path.startswith("/") & ~path.contains("//")
    return plain & ~F.exists(F.split(path, "/"), lambda p: p.isin(".", ".."))


def station_number(value: Column) -> Column:
    return value.rlike(r"^[0-9]{1,6}$")
