"""Column expressions for ids, families, timestamps, splits, paths and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoview.functions.vectors import let

# The protocol's half-open UTC date ranges, in canonical split order.
SPLIT_RANGES = (
    ("train", "2019-08-01", "2020-02-01"),
    ("validation", "2020-02-01", "2020-04-01"),
    ("test", "2020-04-01", "2020-10-01"),
)
SPLIT_ORDER = ("train", "validation", "test")
SHA_PATTERN = "^[0-9a-f]{64}$"
CRC_PATTERN = "^[0-9a-f]{8}$"
# The spellings of mixed timestamps that a plain cast does not read, each
# behind its shape so that only the matching one is tried (a failed parse is slow).
MIXED_FORMATS = (
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "y/M/d H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/y H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/y H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}:\d{2}$", "d MMM y H:mm:ss"),
)
ISO_PATTERN = (r"^\d{4}-\d{2}-\d{2}"
               r"([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")


def normalize_id(col: Column) -> Column:
    return F.lower(F.trim(col))


def is_sha256(col: Column) -> Column:
    return F.coalesce(normalize_id(col).rlike(SHA_PATTERN), F.lit(False))


def valid_sha_or_null(col: Column) -> Column:
    return F.when(is_sha256(col), normalize_id(col))


def normalize_family(col: Column, lower: bool = False) -> Column:
    """Trimmed family, NULL when blank; a NULL family means a benign sample."""
    trimmed = F.nullif(F.trim(col), F.lit(""))
    return F.lower(trimmed) if lower else trimmed


def is_malware(col: Column) -> Column:
    return normalize_family(col).isNotNull()


def parse_mixed_timestamp(col: Column) -> Column:
    """First reading that succeeds, in UTC; unreadable text becomes NULL."""
    text = F.trim(col)
    # A cast would read bare years and times of day too, so it needs a full date first.
    cast = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp"))
    shaped = (F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)))
              for shape, form in MIXED_FORMATS)
    return F.coalesce(cast, *shaped)


def parse_iso_timestamp(col: Column) -> Column:
    """Strict ISO date or date-time (``Z`` or offset allowed), else NULL."""
    text = F.trim(col)
    return F.when(text.rlike(ISO_PATTERN), text.try_cast("timestamp"))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def assign_split(ts: Column, ranges: Sequence[tuple[str, str, str]] = SPLIT_RANGES) -> Column:
    """Half-open ranges; NULL timestamps are 'invalid', all others 'outside_protocol'."""
    def named(t: Column) -> Column:
        result = F.when(t.isNull(), F.lit("invalid"))
        for name, start, end in ranges:
            inside = (t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp"))
            result = result.when(inside, F.lit(name))
        return result.otherwise(F.lit("outside_protocol"))
    # A filter on the split is pushed below the parsing of the timestamp; bound once, the
    # parsing is not repeated for every bound of every range.
    return let(ts, named)


def in_splits(ts: Column, splits: Sequence[str],
              ranges: Sequence[tuple[str, str, str]] = SPLIT_RANGES) -> Column:
    """Plain range predicate for stored timestamps, which the scan can push down."""
    inside = F.lit(False)
    for name, start, end in ranges:
        if name in splits:
            inside = inside | ((ts >= F.lit(start)) & (ts < F.lit(end)))
    return inside


def normalize_split(col: Column) -> Column:
    """Canonical split name, NULL when the split is unknown."""
    text = F.lower(F.trim(col))
    text = F.when(text == "future_test", F.lit("test")).otherwise(text)
    return F.when(text.isin(*SPLIT_ORDER), text)


def split_rank(col: Column, order: Sequence[str] = SPLIT_ORDER) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in order)), col)


def integer_or_null(col: Column) -> Column:
    """Non-negative integral value below 2**63 given as text or number, else NULL."""
    text = F.trim(col.cast("string"))
    # Accepts 7, 7.0 and 7e2 but not 7.5, -1, NaN, true or anything above BIGINT.
    number = F.when(text.rlike(r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
                    text.try_cast("decimal(38,6)"))
    whole = F.when(F.floor(number) == number, number)
    return F.when((whole >= 0) & (whole <= F.lit("9223372036854775807").cast("decimal(38,6)")),
                  whole.cast("bigint"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def sha_from_filename(path: Column) -> Column:
    return F.regexp_replace(F.lower(base_name(path)), r"\.exe$", "")


def is_safe_relative(path: Column) -> Column:
    """False for empty or absolute paths and for any '..' part."""
    text = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (F.trim(text) == "") | text.rlike(r"^(/|[A-Za-z]:)") | \
        F.array_contains(F.split(text, "/"), "..")
    return F.coalesce(~bad, F.lit(False))


def resolve_path(root: str, path: Column) -> Column:
    return F.when(is_safe_relative(path),
                  F.concat_ws("/", F.lit(root.rstrip("/")),
                              F.replace(path, F.lit("\\"), F.lit("/"))))


def family_image_path(family: Column, sha: Column) -> Column:
    return F.concat_ws("/", family, F.concat(sha, F.lit(".png")))


def view_path(split: Column, month: Column, modality: Column, sha: Column) -> Column:
    suffix = F.when(modality == "sbsmi", F.lit(".png")).otherwise(F.lit(".npy"))
    return F.concat_ws("/", split, month, modality, F.concat(sha, suffix))


def report_path(split: Column, month: Column, modality: Column, sha: Column) -> Column:
    return F.concat_ws("/", F.lit("reports"), split, month, modality,
                       F.concat(sha, F.lit(".json")))


def hex_mod(sha: Column, n: int) -> Column:
    """``int(sha, 16) % n`` for a 64-digit hex id, by Horner's rule over 8-digit words."""
    if n < 1:
        raise ValueError("the number of shards must be at least 1")
    base = (1 << 32) % n
    rest = F.lit(0).cast("bigint")
    for word in range(8):
        digits = F.conv(F.substring(sha, 8 * word + 1, 8), 16, 10).cast("bigint")
        rest = F.pmod(rest * F.lit(base) + digits, F.lit(n).cast("bigint"))
    return rest


def percent_difference(current: Column, expected: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide((current - expected) * F.lit(100.0), expected), digits)


def unit_pixels(pixels: Column) -> Column:
    """0..255 pixels as [0, 1] doubles."""
    return F.transform(pixels, lambda p: p.cast("double") / F.lit(255.0))


def preview_pixels(pixels: Column) -> Column:
    """[0, 1] pixels as 0..255 integers, floored after clipping."""
    return F.transform(pixels, lambda p: F.floor(
        F.least(F.greatest(p.cast("double") * F.lit(255.0), F.lit(0.0)), F.lit(255.0))
    ).cast("int"))


def content_fingerprint(content: Column) -> dict[str, Column]:
    return {
        "content_sha256": F.sha2(content, 256),
        "content_crc32": F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0"),
        "content_size": F.octet_length(content).cast("bigint"),
    }


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the compact JSON of the columns in name order, NULLs kept."""
    ordered = [F.col(name) for name in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)
