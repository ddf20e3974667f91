"""Cleaners and keys over string columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accented letter -> plain letter, position by position.
ACCENTED = "áàâãäåāăąéèêëēėęěíìîïīįóòôõöōőúùûüūůűųçćčñńňýÿžźżšśťďřğ"
PLAIN = "aaaaaaaaaeeeeeeeeiiiiiiooooooouuuuuuuucccnnnyyzzzsstdrg"

SPACES = " \t\n\r\f\x0b"

# Known misspellings of place names -> official name.
PLACE_CROSSWALK = {
    "ALTO STA TERESINHA": "ALTO SANTA TEREZINHA",
    "SITIO DOS PINTOS SAO BRAS": "SITIO DOS PINTOS",
}

# Keys whose value must never be shown.
SENSITIVE_KEYS = (
    "minio_secret_key", "minio_access_key", "secret_key", "access_key",
    "aws_secret_access_key", "aws_access_key_id", "password", "passwd",
    "senha", "token", "authorization", "api_key", "apikey", "secret",
)
MASK = "***REDIGIDO***"

# Fixed values: (pattern, replacement) applied in this order.
MASK_RULES = (
    (r"(?i)\b(" + "|".join(SENSITIVE_KEYS) + r")\b(\"?\s*[:=]\s*\"?)([^\s,;}\"']+)", "$1$2" + MASK),
    (r"(?i)\b([a-z][a-z0-9+.\-]*://)[^/\s:@]+:[^/\s@]+@", "$1" + MASK + "@"),
    (r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", MASK),
    (r"\b\d{15}\b", MASK),
)


def _blank_to_null(c: Column) -> Column:
    trimmed = F.btrim(c.cast("string"), F.lit(SPACES))
    return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), trimmed)


def clean_code(c: Column) -> Column:
    """Trim, blank or 'nan' to null, '12.0' to '12'; never a number, leading zeros stay."""
    text = _blank_to_null(c)
    return F.when(text.endswith(".0"), F.regexp_replace(text, r"^(-?\d+)\.0$", "$1")).otherwise(text)


def clean_text(c: Column) -> Column:
    return F.upper(F.regexp_replace(clean_code(c), r"\s+", " "))


def disease_code_key(c: Column) -> Column:
    key = F.upper(F.regexp_replace(clean_code(c), r"[^A-Za-z0-9]", ""))
    return F.when(key != "", key)


def plain_lower(c: Column) -> Column:
    """Accent-free lower text; null becomes the empty string."""
    lowered = F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES)))
    return F.translate(lowered, ACCENTED, PLAIN)


def first_year_in(c: Column) -> Column:
    """First 19xx or 20xx anywhere in the text, else null."""
    return F.regexp_extract(c, r"((?:19|20)\d{2})", 1).try_cast("int")


def place_key(c: Column, crosswalk: dict[str, str] | None = None) -> Column:
    """Accent-free upper name without punctuation, then the known respellings."""
    upper = F.upper(plain_lower(c))
    key = F.regexp_replace(F.regexp_replace(upper, r"[^A-Z0-9 ]", " "), r"\s+", " ")
    key = F.trim(key)
    pairs = [F.lit(v) for kv in (crosswalk or PLACE_CROSSWALK).items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def mask_sensitive(c: Column) -> Column:
    for pattern, replacement in MASK_RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def names_signature(names: Column) -> Column:
    """'<count>-<first 12 hex of sha-256 over the |-joined names>' of an array column."""
    digest = F.sha2(F.array_join(names, "|").cast("binary"), 256)
    return F.concat(F.size(names).cast("string"), F.lit("-"), F.substring(digest, 1, 12))
