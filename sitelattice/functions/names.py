"""File and folder names as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelattice.functions import constants as C
from sitelattice.functions import urls
from sitelattice.functions.urls import _text


def _trim_marks(value: Column) -> Column:
    return F.regexp_replace(value, r"^[. _-]+|[. _-]+$", "")


def sanitize_base(value) -> Column:
    """A name that any file system takes; ``file`` if nothing is left."""
    out = F.regexp_replace(_text(value), r'[/:\\?%*|"<>\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]', "-")
    out = _trim_marks(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), "-{2,}", "-"))
    return F.when(out == "", "file").otherwise(out)


def sanitize_extension(value) -> Column:
    return F.substring(F.regexp_replace(F.lower(_text(value)), "[^a-z0-9]+", ""), 1, 10)


def truncate_base(base, ext, suffix_length=0) -> Column:
    """The base cut so that it fits with its extension and suffix."""
    ext = _text(ext)
    room = F.greatest(F.lit(1), F.lit(C.MAX_FILENAME) - F.when(ext != "", F.length(ext) + 1).otherwise(0) - suffix_length)
    out = _trim_marks(F.substring(_text(base), F.lit(1), room))
    return F.when(out == "", "file").otherwise(out)


@F.pandas_udf(T.StringType())
def _nfc(value: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no such function."""
    return value.str.normalize("NFC")


def split_name(name) -> tuple[Column, Column]:
    """Last component of a name, without and with only its extension."""
    last = F.element_at(F.split(_text(name), "/"), -1)
    ext = F.regexp_extract(last, r"[^.]\.([^.\s]+)$", 1)
    return F.when(ext == "", last).otherwise(F.regexp_replace(last, r"\.[^.]+$", "")), ext


def sanitize_filename(name, compose: bool = False) -> Column:
    """A safe file name.  ``compose`` first brings letters to their composed form, which takes a pandas UDF."""
    base, ext = split_name(_nfc(_text(name)) if compose else name)
    ext = sanitize_extension(ext)
    base = truncate_base(sanitize_base(base), ext)
    return F.when(ext == "", base).otherwise(F.concat(base, F.lit("."), ext))


def numbered_name(base, ext, number: Column) -> Column:
    """The name of the ``number``-th file of one name: plain, then `` 2``, `` 3`` and so on."""
    suffix = F.when(number > 1, F.concat(F.lit(" "), number.cast("string"))).otherwise("")
    stem = F.concat(truncate_base(base, ext, F.length(suffix)), suffix)
    return F.when(_text(ext) == "", stem).otherwise(F.concat(stem, F.lit("."), _text(ext)))


def mime_extension(mime) -> Column:
    pairs = [F.lit(x) for pair in C.MIME_EXTENSIONS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(_text(mime)))


def preferred_filename(url, mime, fallback: str) -> Column:
    last = F.element_at(F.filter(F.split(urls.path(url), "/"), lambda p: p != ""), -1)
    base = F.regexp_replace(F.coalesce(last, F.lit("")), r"(?<=[^.])\.[^.]+$", "")
    base = F.coalesce(F.nullif(urls.percent_decode(base), F.lit("")), F.lit(fallback))
    ext = F.regexp_extract(F.coalesce(last, F.lit("")), r"[^.]\.([^./]+)$", 1)
    ext = F.coalesce(F.nullif(ext, F.lit("")), mime_extension(mime), F.lit("mp4" if fallback == "video" else "jpg"))
    return F.concat(base, F.lit("."), ext)


def source_directory(page, organize: bool = True) -> Column:
    """Folder of an asset below the media folder: the page's host and path, or nothing if not organised."""
    if not organize:
        return F.lit("")
    home = F.nullif(F.replace(urls.host(page), F.lit("www."), F.lit("")), F.lit(""))
    home = F.when(home.isNull(), "Unknown Source").otherwise(sanitize_base(home))
    parts = F.coalesce(urls.path_parts(page), F.array().cast("array<string>"))
    parts = F.when(F.size(parts) == 0, F.array(F.lit("Home"))).otherwise(F.transform(parts, sanitize_base))
    return F.concat_ws("/", home, F.array_join(parts, "/"))


def relative_path(file, folder) -> Column:
    prefix = F.concat(F.rtrim(_text(folder), F.lit("/")), F.lit("/"))
    return F.when(_text(file).startswith(prefix), F.substring(_text(file), F.length(prefix) + 1, F.length(_text(file)))).otherwise(F.element_at(F.split(_text(file), "/"), -1))


def studio_name(url) -> Column:
    """Folder of a site: the first label of its host, capitalised, and its path."""
    label = F.split(F.replace(F.lower(F.coalesce(urls.host(url), F.lit("portfolio"))), F.lit("www."), F.lit("")), r"\.")
    label = F.coalesce(F.try_element_at(F.filter(label, lambda x: x != ""), F.lit(1)), F.lit("portfolio"))
    shown = F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, F.lit(2), F.length(label)))
    return sanitize_base(F.concat_ws(" ", shown, F.array_join(urls.path_parts(url), " ")))


def studio_name_legacy(url) -> Column:
    """The older rule: the host's first label in lower case, no path."""
    label = F.split(F.replace(F.lower(F.coalesce(urls.host(url), F.lit("portfolio"))), F.lit("www."), F.lit("")), r"\.")
    return sanitize_base(F.coalesce(F.try_element_at(F.filter(label, lambda x: x != ""), F.lit(1)), F.lit("portfolio")))


def studio_name_classic(url) -> Column:
    """The classic rule: lower case, only letters, digits and ``._-``."""
    text = F.when(_text(url).startswith("http"), _text(url)).otherwise(F.concat(F.lit("https://"), _text(url)))
    label = F.substring_index(F.substring_index(F.replace(F.lower(F.regexp_extract(text, r"^[^:]+://([^/?#]*)", 1)), F.lit("www."), F.lit("")), ":", 1), ".", 1)
    out = F.regexp_replace(F.regexp_replace(label, "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "portfolio").otherwise(out)
