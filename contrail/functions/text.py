"""Text column expressions: fuzzy search, normalisation, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(s), "[^\\p{Alnum}]+"), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.coalesce(F.when(union > 0, F.size(F.array_intersect(x, y)) / union), F.lit(0.0))


def best_similarity(query: Column, *columns: Column) -> Column:
    return F.greatest(F.lit(0.0), *(F.coalesce(similarity(c, query), F.lit(0.0)) for c in columns))


def contains_any(query: str, *columns: Column) -> Column:
    """Case-insensitive substring in any of the columns; % and _ in the query are ordinary characters."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(query))), F.lit(False))
    return out


def keep_old_if_blank(new: Column, old: Column) -> Column:
    return F.coalesce(F.nullif(new, F.lit("")), old)


def normalized_callsign(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def callsign_changed(current: Column, new: Column) -> Column:
    """Both known, and different."""
    a, b = normalized_callsign(current), normalized_callsign(new)
    return F.coalesce(a != b, F.lit(False))


def learned_callsign(current: Column, new: Column) -> Column:
    return F.coalesce(normalized_callsign(current), normalized_callsign(new))


def is_us_registration(reg: Column) -> Column:
    """N and 1-5 digits, or 1-4 digits and a letter, or 1-3 digits and two letters; no I or O."""
    return F.coalesce(reg.rlike("^(?i)N([0-9]{1,5}|[0-9]{1,4}[A-HJ-NP-Z]|[0-9]{1,3}[A-HJ-NP-Z]{2})$"), F.lit(False))


def is_soaring_club(name: Column) -> Column:
    """Wide rule: soar, gliding, sailplane or glider in the name."""
    return F.coalesce(name.rlike("(?i)SOAR|GLIDING|SAILPLANE|GLIDER"), F.lit(False))


def is_soaring_club_on_load(name: Column) -> Column:
    return F.coalesce(name.rlike("(?i)soar|glider"), F.lit(False))


def hex_address(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 6, "0")


def from_hex(s: Column) -> Column:
    """Long of a hexadecimal string, null if it is not one."""
    return F.when(s.rlike("^[0-9A-Fa-f]+$"), F.conv(s, 16, 10).cast("long"))


def zip_code(z: Column) -> Column:
    digits = F.regexp_replace(z, "[^0-9]", "")
    return (
        F.when(F.length(digits) == 9, F.concat_ws("-", F.substring(digits, 1, 5), F.substring(digits, 6, 4)))
        .when(F.length(digits) == 5, digits)
        .otherwise(F.nullif(F.trim(z), F.lit("")))
    )


def joined_parts(*parts: Column) -> Column:
    """Non-empty parts with commas between."""
    return F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def display_name(model: Column, registration: Column, address_type: Column, address: Column) -> Column:
    model, registration = F.nullif(F.trim(model), F.lit("")), F.nullif(F.trim(registration), F.lit(""))
    return (
        F.when(model.isNotNull() & registration.isNotNull(), F.concat(model, F.lit(" ("), registration, F.lit(")")))
        .when(registration.isNotNull(), registration)
        .when(model.isNotNull(), model)
        .otherwise(F.concat_ws("-", F.upper(address_type), hex_address(address)))
    )


def title_case(s: Column) -> Column:
    """First letter of each part between spaces or hyphens."""
    return F.array_join(F.transform(F.split(F.initcap(F.lower(s)), "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000))), "-")


#: Company endings that names carry.
SUFFIXES = r"(,? (INCORPORATED|INC|CORPORATION|CORP|COMPANY|CO|LIMITED|LTD|LLC|GMBH|AG|SA|SPA|AIRCRAFT|MFG|MANUFACTURING)\.?)+$"


def normalized_manufacturer(name: Column, known: dict[str, str]) -> Column:
    """The canonical name of an exact match, else without THE and company endings, in title case."""
    upper = F.upper(F.trim(name))
    table = F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv)) if known else None
    stripped = F.trim(F.regexp_replace(F.regexp_replace(upper, "^THE ", ""), SUFFIXES, ""))
    plain = title_case(F.when(stripped == "", upper).otherwise(stripped))
    return F.coalesce(F.try_element_at(table, upper), plain) if table is not None else plain


def normalized_model(model: Column, known: dict[str, str]) -> Column:
    """A known manufacturer in front, longest first and at a word end, becomes its canonical name."""
    trimmed = F.trim(model)
    out = trimmed
    for name in sorted(known, key=len):
        rest = F.substring(trimmed, len(name) + 1, 1000)
        hit = F.startswith(F.upper(trimmed), F.lit(name)) & rest.rlike("^($|[ -])")
        out = F.when(
            hit,
            F.when(F.startswith(rest, F.lit("-")), F.concat(F.lit(known[name]), rest)).otherwise(
                F.trim(F.concat_ws(" ", F.lit(known[name]), F.ltrim(rest)))
            ),
        ).otherwise(out)
    return out
