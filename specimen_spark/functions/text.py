"""Text columns: whitespace, ASCII folding, tokens, names of files."""

from __future__ import annotations

import functools
import mimetypes
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from specimen_spark.fixed_values import (
    DEFAULT_SUFFIX, IMAGE_SUFFIXES, SIMPLE_SUFFIXES, US_COUNTRY, US_COUNTRY_SPELLINGS,
)


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    Written out as plain nested expressions, repeated inputs grow the generated
    code until the JVM stops compiling it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Unicode white space, and the four separators that text splitting also drops.
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# What stands as it is from the last match on, then a run of white space that is not one plain space. Plain letters are
# passed over in one tight loop, and \G lets text without such a run be searched once, not once a character.
UNEVEN = rf"\G((?:[!-~]++|[ ](?!{WHITE})|(?!{WHITE})[^ -~])*+){WHITE}+"


def normalize_text(c) -> Column:
    """Null becomes blank; runs of Unicode white space become one space."""
    text = F.coalesce(as_column(c).cast("string"), F.lit(""))
    # The value appears once, so inputs of any size nest without ``let``, which is not compiled.
    return F.trim(F.regexp_replace(text, UNEVEN, "$1 "))


def blank_to_null(c) -> Column:
    """Normalised text, null when blank."""
    return F.nullif(normalize_text(c), F.lit(""))


def is_not_blank(c) -> Column:
    """Whether ``blank_to_null`` has a value: the search ends at the first character that is no white space."""
    return F.coalesce(as_column(c).cast("string"), F.lit("")).rlike(rf"(?s)(?!{WHITE}).")


def first_nonempty(*columns) -> Column:
    """First value that is neither null nor '' (empty arrays and maps: see ``nonempty_array``)."""
    return F.coalesce(*[F.nullif(as_column(c).cast("string"), F.lit("")) for c in columns])


def nonempty_array(c) -> Column:
    """The array or map, null when it has no element."""
    return F.when(F.size(as_column(c)) > 0, as_column(c))


@functools.lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str]:
    """Compatibility decompositions to ASCII, derived from the Unicode database.

    One-to-one folds go to ``translate``; folds to several characters go to a
    map literal, written as text with separators that no fold contains.
    """
    singles_from, singles_to, several = [], [], []
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        folded = unicodedata.normalize("NFKD", ch)
        if folded == ch:
            continue
        kept = "".join(x for x in folded if ord(x) < 128)
        if len(kept) == 1 and code < 0x10000:
            singles_from.append(ch)
            singles_to.append(kept)
        elif kept:
            several.append(f"{ch}\x02{kept}")
    return "".join(singles_from), "".join(singles_to), "\x01".join(several)


def ascii_text(c) -> Column:
    """Normalised text with accents and compatibility forms folded, other non-ASCII dropped."""
    return let(normalize_text(c), _folded)


def _folded(text: Column) -> Column:
    singles_from, singles_to, several = _fold_tables()
    non_ascii = r"[^\x00-\x7F]"
    table = F.str_to_map(F.lit(several), F.lit("\x01"), F.lit("\x02"))

    def fold_char(ch):
        return F.when(ch.rlike(non_ascii), F.coalesce(F.try_element_at(table, ch), F.lit(""))).otherwise(ch)

    def fold(text):
        return let(
            F.translate(text, singles_from, singles_to),
            lambda once: F.when(
                once.rlike(non_ascii), F.array_join(F.transform(F.split(once, ""), fold_char), "")
            ).otherwise(once),
        )

    return F.when(text.rlike(non_ascii), fold(text)).otherwise(text)


def alpha_tokens(text: Column) -> Column:
    """Array of the runs of ASCII letters and hyphens of a normalised text."""
    return F.regexp_extract_all(_folded(text), F.lit(r"([A-Za-z-]+)"), F.lit(1))


def tokenize_alpha(c) -> Column:
    return let(normalize_text(c), alpha_tokens)


def title_token(c) -> Column:
    token = as_column(c)
    return F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substr(token, F.lit(2))))


def parse_month(c) -> Column:
    return F.regexp_extract(normalize_text(c), r"(\d{4})-(\d{2})", 2)


def normalize_country(c) -> Column:
    def rename(text: Column) -> Column:
        lower = F.lower(text)
        known = lower.contains("united states") | lower.isin(*US_COUNTRY_SPELLINGS)
        return F.when(known, F.lit(US_COUNTRY)).otherwise(text)

    return let(normalize_text(c), rename)


def normalize_state(c) -> Column:
    return F.initcap(F.lower(normalize_text(c)))


def second_word(text: Column) -> Column:
    """Second of the words of a normalised text, blank when there is one only."""
    return F.when(text.contains(" "), F.substring_index(F.substring_index(text, " ", 2), " ", -1)).otherwise(F.lit(""))


def url_path(c) -> Column:
    """Path part of a URL, tolerant of text that is no valid URI."""
    path = F.regexp_extract(as_column(c), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def path_suffix(c) -> Column:
    """Lower-case file ending with its dot; leading dots of a file name do not start an ending."""
    name = F.regexp_replace(F.regexp_extract(as_column(c), r"([^/]*)$", 1), r"^\.+", "")
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def file_name(c) -> Column:
    return F.substring_index(as_column(c), "/", -1)


def file_stem(c) -> Column:
    return F.regexp_replace(file_name(c), r"(?<=[^.])\.[^.]*$", "")


@functools.lru_cache(maxsize=1)
def _media_type_suffixes() -> str:
    """Ending of each registered media type, from the standard registry shipped with Python."""
    registry = mimetypes.MimeTypes(filenames=())
    types = sorted(set(registry.types_map[True].values()))
    return "\x01".join(f"{t}\x02{registry.guess_extension(t)}" for t in types)


def guess_extension(url, content_type=None) -> Column:
    """Known image ending of the URL path, else the ending of the media type, else ``.jpg``."""
    known = _known_suffix(url, IMAGE_SUFFIXES, r"[^/.][^/]*?")
    if content_type is None:
        return F.coalesce(known, F.lit(DEFAULT_SUFFIX))
    table = F.str_to_map(F.lit(_media_type_suffixes()), F.lit("\x01"), F.lit("\x02"))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(as_column(content_type), F.lit("")), ";", 1)))
    return F.coalesce(known, F.try_element_at(table, kind), F.lit(DEFAULT_SUFFIX))


def _known_suffix(url, suffixes, before: str) -> Column:
    """Ending of the URL path when it is one of ``suffixes``, else null."""
    path = F.lower(url_path(F.coalesce(as_column(url), F.lit(""))))
    endings = "|".join(re.escape(s) for s in suffixes)
    return F.nullif(F.regexp_extract(path, f"{before}({endings})$", 1), F.lit(""))


def guess_extension_simple(url) -> Column:
    return F.coalesce(_known_suffix(url, SIMPLE_SUFFIXES, ""), F.lit(DEFAULT_SUFFIX))


def safe_filename(c) -> Column:
    text = F.regexp_replace(as_column(c), r"[^A-Za-z0-9._-]+", "_")
    text = F.regexp_replace(text, r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("file"))


def download_path(outdir: str, source, record_id, image_url, image_format) -> Column:
    """``<outdir>/<source>/<source>_<record>_<sha1[:12]><ending>``."""
    digest = F.substring(F.sha1(as_column(image_url)), 1, 12)
    stem = safe_filename(F.concat_ws("_", as_column(source), as_column(record_id), digest))
    return F.concat(
        F.lit(outdir.rstrip("/") + "/"), as_column(source), F.lit("/"), stem,
        guess_extension(image_url, image_format),
    )


def stable_name(occurrence_key, image_url) -> Column:
    return F.concat_ws("_", as_column(occurrence_key), F.substring(F.md5(as_column(image_url)), 1, 10))


def pad_index(c, width: int = 6) -> Column:
    """Zero-padded number that is never cut."""
    text = as_column(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def output_name(source, record_id, row_index) -> Column:
    """``<source>_<record>_<index>`` with stand-ins for blanks."""
    index = pad_index(row_index)
    return F.concat_ws(
        "_",
        F.coalesce(blank_to_null(source), F.lit("unknown")),
        F.coalesce(blank_to_null(record_id), F.concat(F.lit("row_"), index)),
        index,
    )


def source_index_from_path(c) -> Column:
    """Row index at the end of the file stem; null when there is none."""
    digits = F.regexp_extract(file_stem(c), r"_(\d{6,})$", 1)
    return digits.try_cast("bigint")
