"""HTTP metadata as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelattice.functions import urls
from sitelattice.functions.urls import _text


def is_success(status) -> Column:
    return _text(status).between(200, 399)


def _blocks(headers) -> Column:
    """Header blocks of a response with redirects, the last first."""
    return F.reverse(F.split(_text(headers), "\r\n\r\n"))


def last_header(headers, name: str) -> Column:
    """A field's value in the last block that has it; the name's case does not matter."""
    lines = F.flatten(F.transform(_blocks(headers), lambda b: F.split(b, "\r\n|\n|\r")))
    fits = F.filter(lines, lambda x: F.contains(x, F.lit(":")) & (F.lower(F.trim(F.substring_index(x, ":", 1))) == name.lower()))
    return F.trim(F.regexp_replace(F.try_element_at(fits, F.lit(1)), "^[^:]*:", ""))


def last_status(headers) -> Column:
    """The status of the last block whose status line has one."""
    codes = F.transform(_blocks(headers), lambda b: F.try_element_at(F.filter(F.split(F.try_element_at(F.split(b, "\r\n|\n|\r"), F.lit(1)), " "), lambda p: p != ""), F.lit(2)).try_cast("int"))
    return F.try_element_at(F.filter(codes, lambda c: c.isNotNull()), F.lit(1))


def request_headers(url, referer) -> Column:
    """Referer, and Origin where the referer is on the asset's own host."""
    same = urls.host(url) == urls.host(referer)
    origin = F.when(same & urls.scheme(referer).isNotNull(), F.concat(urls.scheme(referer), F.lit("://"), urls.host(referer)))
    return F.struct(_text(referer).alias("referer"), origin.alias("origin"))


def decode_body(content) -> Column:
    """Bytes as UTF-8, else as ISO-8859-1."""
    raw = _text(content)
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def is_avif(url, mime) -> Column:
    return (urls.extension(url) == "avif") | F.coalesce(F.contains(F.lower(_text(mime)), F.lit("avif")), F.lit(False))
