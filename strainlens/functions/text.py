"""Header, label and identifier functions, all as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strainlens import constants as C


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _nonempty(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def normalise_value(col: Column) -> Column:
    """Outer spaces and braces off; null and placeholder words become Unknown."""
    bare = strip(F.regexp_replace(strip(col.cast("string")), r"^[{}]+|[{}]+$", ""))
    return F.when(col.isNull() | F.lower(bare).isin(C.MISSING_WORDS), F.lit(C.UNKNOWN)).otherwise(bare)


def normalise_country(col: Column) -> Column:
    value = normalise_value(col)
    for alias, full in C.COUNTRY_ALIASES.items():
        value = F.when(value == alias, F.lit(full)).otherwise(value)
    return value


# Header patterns of country and year.
COUNTRY_BRACED = r"META_COUNTRY=\{([^}]+)\}"
COUNTRY_BARE = r"META_COUNTRY=([^|;]+?)(?=\s+META_|$|[|;])"
YEAR_BRACED = r"META_YEAR=\{(\d{4})\}"
YEAR_BARE = r"META_YEAR=(\d{4})"
YEAR_WORD = r"\b(?:19|20)\d{2}\b"
YEAR_ISOLATED = r"(?<!\d)((?:19|20)\d{2})(?!\d)"


def _first_match(header: Column, patterns) -> Column:
    return F.coalesce(*[_nonempty(F.regexp_extract(header, p, 1)) for p in patterns])


def meta_country(header: Column) -> Column:
    return normalise_country(_first_match(header, [COUNTRY_BRACED, COUNTRY_BARE]))


def has_meta_country(header: Column) -> Column:
    return header.rlike(COUNTRY_BRACED) | header.rlike(COUNTRY_BARE)


def meta_year(header: Column) -> Column:
    return _first_match(header, [YEAR_BRACED, YEAR_BARE]).cast("int")


def has_meta_year(header: Column) -> Column:
    return header.rlike(YEAR_BRACED) | header.rlike(YEAR_BARE)


def slash_country(header: Column) -> Column:
    """Second '/' field of the first '|' field; placeholders are missing."""
    field = F.get(F.split(F.get(F.split(header, r"\|"), F.lit(0)), "/"), F.lit(1))
    bare = strip(field)
    return F.when(~F.lower(bare).isin(C.SLASH_PLACEHOLDERS), F.regexp_replace(bare, "_", " "))


def last_year(header: Column) -> Column:
    """Last four-digit year standing as a word, as text."""
    return F.try_element_at(F.regexp_extract_all(header, F.lit(YEAR_WORD), F.lit(0)), F.lit(-1))


def first_year(header: Column) -> Column:
    """First four-digit year not touching another digit, as text."""
    return _nonempty(F.regexp_extract(header, YEAR_ISOLATED, 1))


def named_country(header: Column, keywords: list[str] = C.COUNTRY_KEYWORDS) -> Column:
    """First keyword, in list order, found as a whole word; title form.

    One regex pass finds every keyword; the list position then decides.
    """
    plain = F.regexp_replace(F.lower(header), "_", " ")
    found = F.regexp_extract_all(plain, F.lit(r"\b(?:" + "|".join(keywords) + r")\b"), F.lit(0))
    place = F.array_min(F.transform(found, lambda k: F.array_position(_lit_array(keywords), k)))
    titles = _lit_array([k.title() for k in keywords])
    return F.when(F.size(found) > 0, F.try_element_at(titles, place.cast("int")))


def first_word(header: Column) -> Column:
    return F.get(F.split(strip(header), r"\s+"), F.lit(0))


# Class patterns per rule set, tried in order.
CLASS_PATTERNS = {
    "header": [r"(?i)DENV(\d)", r"(?i)hDenV(\d)"],
    "file": [r"(?i)DENV[\-_ ]?([1-4])", r"(?i)SEROTYPE[\-_ ]?([1-4])", r"(?i)TYPE[\-_ ]?([1-4])"],
    "word": [
        r"(?i)\bDENV[-_ ]?([1-4])\b",
        r"(?i)\bDEN[-_ ]?V[-_ ]?([1-4])\b",
        r"(?i)\bDENGUE[-_ ]?VIRUS[-_ ]?([1-4])\b",
        r"(?i)\bH?DENV([1-4])\b",
    ],
    "long": [
        r"(?i)\bDENV[-_ ]?([1-4])(?=$|[^A-Z0-9])",
        r"(?i)\bDENGUE[-_ ]?VIRUS[-_ ]?([1-4])(?=$|[^A-Z0-9])",
        r"(?i)\bSEROTYPE[:=_ -]*([1-4])(?=$|[^A-Z0-9])",
        r"(?i)\bSERO[:=_ -]*([1-4])(?=$|[^A-Z0-9])",
        r"(?i)\bTYPE[:=_ -]*([1-4])(?=$|[^A-Z0-9])",
        r"(?i)\bST[:=_ -]*([1-4])(?=$|[^A-Z0-9])",
        r"(?i)(?:^|[^A-Z0-9])D([1-4])(?:[^A-Z0-9]|$)",
    ],
}
# Pattern that turns a custom capture into a class digit.
CUSTOM_CLASS = r"(?i)(?:DENV|SEROTYPE|TYPE|ST)?[-_ :=]*([1-4])(?=$|[^A-Z0-9])"


def infer_class(text: Column, rules: str, custom: str | None = None, strict: bool = False) -> Column:
    """Class named in ``text`` under one of the rule sets, null when none.

    ``rules`` is a key of ``CLASS_PATTERNS`` or ``field`` (the first ``|``
    field must be a class).  ``custom`` is tried first in the long rule set;
    ``strict`` raises instead of returning null.
    """
    if rules == "field":
        head = F.get(F.split(text, r"\|"), F.lit(0))
        found = F.when(head.isin(C.CLASSES), head)
    else:
        digit = _first_match(text, CLASS_PATTERNS[rules])
        if custom is not None:
            group = 1 if "(" in custom.replace("(?", "") else 0
            hit = _nonempty(F.regexp_extract(text, f"(?i){custom}", group))
            digit = F.coalesce(_nonempty(F.regexp_extract(hit, CUSTOM_CLASS, 1)), digit)
        found = F.concat(F.lit("DENV"), digit)
    if strict:
        return F.when(found.isNotNull(), found).otherwise(
            F.raise_error(F.concat(F.lit("no class in "), F.coalesce(text, F.lit("null")))))
    return found


def class_conflict(header_class: Column, file_class: Column) -> Column:
    """The header names another class than the file; the file stays the label."""
    return F.coalesce(header_class != file_class, F.lit(False))


def normalise_id(col: Column) -> Column:
    return F.regexp_replace(strip(col), r"^>+", "")


def record_id(col: Column) -> Column:
    return F.regexp_replace(col, r"[^A-Za-z0-9_.:-]+", "_")


def safe_name(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r'[<>:"/\\|?*]', "_"), " ", "_")


def safe_filename(col: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(col, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.when(F.length(bare) == 0, "profile").otherwise(bare)


def fold_number(col: Column) -> Column:
    """First run of digits in a fold name, 9999 when there is none."""
    return F.coalesce(_nonempty(F.regexp_extract(col, r"(\d+)", 1)).cast("int"), F.lit(9999))


def pretty_fold(col: Column) -> Column:
    digits = _nonempty(F.regexp_extract(col, r"(?i)fold[_\s-]*(\d+)", 1))
    return F.coalesce(F.concat(F.lit("Fold "), digits), col)


def time_bin_order(col: Column, cutoff: int = C.CUTOFF_YEAR) -> Column:
    """Sort key of a time bin: before the cut-off first, Unknown last."""
    start = F.regexp_extract(col, r"^(\d+)", 1)
    return F.when(col == f"<{cutoff}", 0).when(col == C.UNKNOWN, 9999).otherwise(_nonempty(start).cast("int"))


def class_order(col: Column) -> Column:
    return F.coalesce(_nonempty(F.regexp_extract(col, r"([1-4])", 1)).cast("int"), F.lit(99))


def clean_region(col: Column) -> Column:
    """Region name from a file-like alias (suffixes off, lost quote restored)."""
    stem = F.regexp_replace(F.regexp_extract(strip(col), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"\.aln$", "")
    stem = F.when(stem.isin("5_UTR", "3_UTR"), F.regexp_replace(stem, "_", "'")).otherwise(stem)
    compact = F.regexp_replace(stem, "'", "")
    alias = _lit_array([r.replace("'", "") for r in C.REGIONS])
    place = F.array_position(alias, compact)
    return F.when(place > 0, F.element_at(_lit_array(C.REGIONS), F.greatest(place, F.lit(1)).cast("int"))).otherwise(stem)


def region_order(col: Column) -> Column:
    place = F.array_position(_lit_array(C.REGIONS), clean_region(col))
    return F.when(place > 0, place - 1).otherwise(999).cast("int")


def year_bin(year: Column) -> Column:
    """Fixed bins by decade."""
    return (
        F.when(year.isNull(), C.UNKNOWN).when(year < 2000, C.YEAR_BINS[0]).when(year <= 2009, C.YEAR_BINS[1])
        .when(year <= 2019, C.YEAR_BINS[2]).otherwise(C.YEAR_BINS[3])
    )


def time_bin(year: Column, max_year: Column, cutoff: int = C.CUTOFF_YEAR, width: int = C.BIN_YEARS) -> Column:
    """Bins of ``width`` years from the cut-off; the last ends at ``max_year``."""
    start = F.lit(cutoff) + F.floor((year - cutoff) / F.lit(width)) * width
    end = F.least(start + (width - 1), max_year)
    return (
        F.when(year.isNull(), C.UNKNOWN).when(year < cutoff, f"<{cutoff}")
        .otherwise(F.concat(start.cast("int"), F.lit("-"), end.cast("int")))
    )


def normalise_class_label(col: Column) -> Column:
    """``DENV-1``, ``DENV1`` and ``1.0`` all become ``1``; other text is kept."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(strip(col.cast("string"))), "DENV-", ""), "DENV", "")
    number = bare.try_cast("double")
    return F.coalesce(number.try_cast("bigint").cast("string"), strip(col.cast("string")))
