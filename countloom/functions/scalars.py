"""Column functions: canonical keys, locale numbers, digits, times, hashes. All stay on the JVM side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The time formats that published files use.
TIME_FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")


def locale_int(x: Column) -> Column:
    """``1.234`` as 1234; what is not a number is null. For the older rule wrap it in coalesce(..., 0)."""
    return F.replace(F.trim(x), F.lit("."), F.lit("")).try_cast("long")


def locale_float(x: Column) -> Column:
    """``99,16`` as 99.16; null otherwise."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def strict_int(x: Column) -> Column:
    return F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x).try_cast("long"))


def numeric_code(x: Column) -> Column:
    """a code as a number; blank or other text is fatal."""
    return F.when(F.trim(x).rlike("^[0-9]+$"), F.trim(x).try_cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a code: "), F.coalesce(x, F.lit("null")))).cast("long"))


def prefix_int(x: Column) -> Column:
    """Leading digits of a text as a number, 0 if there are none."""
    return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0))


def canonical_category(x: Column) -> Column:
    """Digits lose their leading zeros, other labels are trimmed and upper-cased."""
    t = F.trim(x)
    number = F.regexp_replace(t, "^0+(?=[0-9])", "")
    return F.when(t.rlike("^[0-9]+$"), number).otherwise(F.upper(t))


def accent_free(x: Column) -> Column:
    """A key that compares equal for letters with and without accents and in either case."""
    return F.collate(x, "UNICODE_CI_AI")


def plain_key(x: Column) -> Column:
    """Lower case without accents, as text: letters of the Latin blocks that decompose lose their marks."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))[0]) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.decomposition(chr(k)) and chr(k).lower() == chr(k) and "<" not in unicodedata.decomposition(chr(k))]
    return F.translate(F.lower(x), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def truthy(x: Column) -> Column:
    """F16: common words and digits for true, in either case; null is false."""
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "t", "yes", "y", "sim", "s"), F.lit(False))


def parse_time(x: Column) -> tuple[Column, Column]:
    """(time, whether it has seconds) from the first format that fits; null for none."""
    t = F.trim(x)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS]), t.rlike(r":[0-9]{2}:[0-9]{2}$")


def floor_time(unit: str, ts: str) -> Column:
    """Start of the minute, hour, ... as a time without a zone."""
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def region_of(name: Column, known: list[str]) -> Column:
    """a known region code that stands alone in a resource name, the first in the text."""
    return F.nullif(F.upper(F.regexp_extract(name, rf"(?i)(?:^|[_/\-.])({'|'.join(known)})(?=[_/\-.]|$)", 1)), F.lit(""))


# How published resources and files carry regions and units in their names.
FILE_REGION = r"BWEB_[12]T_([A-Z]{2})_"
UNIT_NAMES = (r"[-_/]([a-z]{2})[-_/]m?(\d{4,6})[-_/]z?(\d{1,4})[-_/]s?(\d{1,4})(?:[^0-9]|$)", r"p\d+-([a-z]{2})-m(\d+)-z(\d+)-s(\d+)")


def region_of_resource(name: Column, url: Column, known: list[str]) -> Column:
    """a known region code at the head of a resource's name, else in a known place of the file name of its address; null for none."""
    codes = "|".join(known)
    file = F.upper(F.url_decode(F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), "/"), -1)))
    found = [F.regexp_extract(F.upper(F.coalesce(name, F.lit(""))), rf"^\s*({codes})\s*[-_]", 1), F.regexp_extract(file, FILE_REGION, 1), F.regexp_extract(file, rf"_({codes})(?:_|\.)", 1)]
    return F.coalesce(*[F.when(x.isin(known), x) for x in found])


def unit_of_file(name: Column, known: list[str]) -> Column:
    """(region, area, zone, unit) from the name of a transmitted file, numbers without leading zeros; null fields for other names."""
    x = F.lower(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")))
    one = lambda p: F.when(x.rlike(p) & F.upper(F.regexp_extract(x, p, 1)).isin(known), F.struct(F.upper(F.regexp_extract(x, p, 1)).alias("region"), *[F.regexp_extract(x, p, k).cast("long").cast("string").alias(c) for k, c in ((2, "area"), (3, "zone"), (4, "unit"))]))
    return F.coalesce(*[one(p) for p in UNIT_NAMES])


def first_digit(n: Column) -> Column:
    return F.substring(F.abs(n).cast("string"), 1, 1)


def second_digit(n: Column) -> Column:
    return F.when(F.abs(n) >= 10, F.substring(F.abs(n).cast("string"), 2, 1))


def last_digit(n: Column) -> Column:
    return F.pmod(n, F.lit(10)).cast("long")


def safe_name(x: Column, most: int) -> Column:
    return F.left(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_"), F.lit(most))


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns as text, joined by a bar."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def crc_bucket(n: int, *columns: str) -> Column:
    """bucket of a key by CRC-32, the same as zlib's."""
    return F.pmod(F.crc32(F.encode(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), "UTF-8")), F.lit(n)).cast("int")


def hash_fold(n: int, *columns: str) -> Column:
    """The first byte of a key's SHA-256 modulo ``n``: a split that does not depend on order."""
    return F.pmod(F.conv(F.substring(row_hash(*columns), 1, 2), 16, 10).cast("int"), F.lit(n))


def margin_pp(a: Column, b: Column, n: Column) -> Column:
    """difference of two shares in percentage points; null for an empty total."""
    return F.try_divide(F.lit(100.0) * (a - b), n)


def nearest_count(share_of: Column, total: Column, n: Column) -> Column:
    """``n`` times share_of/total to the nearest integer, halves up, within 0 and ``n``; exact on integers."""
    return F.greatest(F.lit(0), F.least(n, F.floor((2 * share_of * n + total) / (2 * total)).cast("long")))
