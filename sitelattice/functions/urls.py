"""URL functions as Column expressions.

A URL is taken apart by the generic-syntax expression of RFC 3986, so that even
odd ones (templates in braces, missing hosts) have parts; nothing here leaves
whole-stage code generation for Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelattice.functions import constants as C

# the parts of RFC 3986's expression, each by the shortest expression that finds it
_SCHEME = r"^([^:/?#]+):"
_AUTHORITY = r"^(?:[^:/?#]+:)?//([^/?#]*)"
_HOST = r"^(?:[^:/?#]+:)?//(?:[^@/?#]*@)?([^/?#]*?)(?::\d*)?(?=[/?#]|$)"
_PATH = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _text(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(value) -> Column:
    """The text without white space and line ends around it."""
    return F.btrim(_text(value), F.lit(C.WHITE_SPACE))


def scheme(url) -> Column:
    return F.nullif(F.regexp_extract(_text(url), _SCHEME, 1), F.lit(""))


def host(url) -> Column:
    """Host without user and port; null if there is none."""
    return F.nullif(F.regexp_extract(_text(url), _HOST, 1), F.lit(""))


def path(url) -> Column:
    return F.regexp_extract(_text(url), _PATH, 1)


def query(url) -> Column:
    return F.nullif(F.regexp_extract(_text(url), _QUERY, 1), F.lit(""))


def extension(url) -> Column:
    """Lower-case extension of the last path component, empty if there is none."""
    last = F.element_at(F.split(path(url), "/"), -1)
    return F.lower(F.regexp_extract(last, r"[^.]\.([^./]+)$", 1))


def path_parts(url) -> Column:
    """Percent-decoded path components that are not empty."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    return F.transform(parts, percent_decode)


def percent_decode(value) -> Column:
    """Percent-decoding that keeps a plus sign and leaves a broken escape as it is."""
    text = _text(value)
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def origin(url) -> Column:
    return F.concat(F.coalesce(scheme(url), F.lit("https")), F.lit("://"), F.coalesce(host(url), F.lit("")))


def strip_fragment_and_query(url) -> Column:
    return F.regexp_replace(_text(url), r"[?#].*$", "")


_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…"}


def _numeric(base: int):
    def one(sofar, digits):
        found = F.concat(F.lit("&#" if base == 10 else "&#x"), digits, F.lit(";"))
        if base == 16:
            sofar = F.replace(sofar, F.concat(F.lit("&#X"), digits, F.lit(";")), found)
        return F.replace(sofar, found, F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32"))

    return one


def decode_entities(value) -> Column:
    """HTML character references: the common names and all numeric ones; ``&amp;`` is decoded last."""
    text = _text(value)
    out = text
    for name, char in _NAMED.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    for pattern, base in ((r"&#(\d{1,7});", 10), (r"&#[xX]([0-9A-Fa-f]{1,6});", 16)):
        numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern)))

        out = F.aggregate(numbers, out, _numeric(base))
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def _without_dots(p: Column) -> Column:
    """Path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(p, "/")
    first = F.array(F.lit("")).cast("array<string>")

    def step(done, part):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    walked = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), first, step)
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(ended, "/")).otherwise(p)


def resolve(reference, base) -> Column:
    """The absolute URL of a reference found on the page ``base`` (RFC 3986, section 5)."""
    return _let(F.struct(_text(reference).alias("r"), _text(base).alias("b")), _resolved)


def _resolved(pair: Column) -> Column:
    ref, base = pair["r"], pair["b"]
    bare, own = F.regexp_replace(base, "#.*$", ""), F.coalesce(scheme(base), F.lit("https"))
    root = F.concat(own, F.lit("://"), F.regexp_extract(base, _AUTHORITY, 1))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    whole = F.concat(F.when(ref.startswith("/"), F.lit("")).when(folder == "", F.lit("/")).otherwise(folder), path(ref))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(own, F.lit(":"), ref))
        .when(ref == "", bare)
        .when(ref.startswith("?"), F.concat(strip_fragment_and_query(base), ref))
        .when(ref.startswith("#"), F.concat(bare, ref))
        .otherwise(F.concat(root, _let(whole, _without_dots), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)))
    )


def next_image(url) -> Column:
    """The image behind a ``/_next/image`` address: its ``url`` parameter, decoded twice."""
    text = _text(url)
    inner = F.nullif(F.regexp_extract(text, r"^[^?#]*\?(?:[^#]*&)?url=([^&#]*)", 1), F.lit(""))
    return F.when(F.contains(text, F.lit("/_next/image")), F.coalesce(percent_decode(percent_decode(inner)), text)).otherwise(text)


def wix_original(url) -> Column:
    """A Wix media address without its resizing tail; the first of two patterns that fits counts."""
    text = _text(url)
    return F.coalesce(F.nullif(F.regexp_extract(text, C.WIX_ORIGINAL, 1), F.lit("")), F.nullif(F.regexp_extract(text, C.WIX_PLAIN, 1), F.lit("")), text)


def strip_cdn_query(url) -> Column:
    text = _text(url)
    fits = F.lit(False)
    for prefix in C.QUERYLESS_PREFIXES:
        fits = fits | text.startswith(prefix)
    return F.when(fits, F.regexp_replace(text, r"\?[^#]*", "")).otherwise(text)


def wordpress_original(url) -> Column:
    """An upload's address without the size in its name."""
    return F.regexp_replace(_text(url), C.WORDPRESS_SIZED, "$1$2$4")


def normalize(raw, base, classic: bool = False) -> Column:
    """A raw attribute value as an absolute, upgraded URL; null if it is empty or of no use.

    The classic variant resolves before it unwraps and leaves entities alone.
    """
    useless = rf"(?i)^(?:({'|'.join(C.REJECTED_SCHEMES)}):.*)?$" if not classic else rf"(?i)^({'|'.join(C.REJECTED_SCHEMES)}):"
    clean = strip(raw) if classic else decode_entities(strip(raw))

    def finish(text):
        full = next_image(resolve(text, base)) if classic else resolve(next_image(text), base)
        return F.when((_text(raw) != "") & ~text.rlike(useless), _let(_let(full, wix_original), strip_cdn_query))

    return _let(clean, finish)


def start_url(raw) -> Column:
    """A site's first address: https unless given, a bare host moved to its place, no fragment."""
    text = F.regexp_replace(_text(raw), "#.*$", "")
    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), text).when(text.startswith("//"), F.concat(F.lit("https:"), text)).otherwise(F.concat(F.lit("https://"), text))


def typed_url(raw, desktop: bool = False) -> Column:
    """An address as a person types it: https before it unless it begins with http."""
    text = strip(raw)
    if desktop:
        text = F.regexp_replace(text, r"^/+|/+$", "")
    return F.when(F.lower(text).startswith("http"), text).otherwise(F.concat(F.lit("https://"), text))


def is_page(url) -> Column:
    return ~extension(url).isin(*C.NON_PAGE_EXTENSIONS)


def internal_link(raw, page, site, strict_origin: bool = False, legacy: bool = False) -> Column:
    """The page address behind a link if it is on the site, another page, and not a file; else null.

    By default the origin is compared as a bare prefix; ``strict_origin`` asks for a
    whole one.  The ``legacy`` rule also passes over addresses with certain parts.
    """
    home = origin(site)

    def kept(full):
        same = origin(full) == home if strict_origin else full.startswith(home)
        wanted = ~F.lower(full).rlike("|".join(C.SKIPPED_LINK_PARTS)) if legacy else F.lit(True)
        return F.when(same & (full != _text(site)) & wanted & is_page(full), strip_fragment_and_query(full))

    return _let(normalize(raw, page), kept)


def is_size_parameter(name: Column) -> Column:
    return F.lower(name).isin(*C.SIZE_PARAMETERS)


def asset_path(p) -> Column:
    """A path without sizes: in the file name, or as width and height segments."""
    out = F.regexp_replace(_text(p), C.SIZED_FILE, "")
    return F.regexp_replace(F.regexp_replace(out, C.WIDTH_SEGMENT, "$1"), C.HEIGHT_SEGMENT, "$1")


def cargo_path(p) -> Column:
    text = _text(p)
    return F.when(text.rlike(C.CARGO_PATH), F.regexp_replace(text, C.CARGO_PATH, "/i/$1/$2")).otherwise(asset_path(text))


def _other_parameters(url) -> Column:
    """The query without its size parameters, by name."""
    sizes = "|".join(C.SIZE_PARAMETERS)
    rest = F.regexp_replace(F.regexp_extract(_text(url), _QUERY, 1), rf"(?i)(?<=^|&)(?:{sizes})(?:=[^&]*)?(?=&|$)", "")
    rest = F.regexp_replace(rest, "^&+|&+$|(?<=&)&+", "")
    ranked = F.sort_array(F.transform(F.split(rest, "&"), lambda i, n: F.struct(F.substring_index(i, "=", 1).alias("name"), n.alias("at"), i.alias("item"))))
    return F.when(F.contains(rest, F.lit("&")), F.array_join(F.transform(ranked, lambda r: r["item"]), "&")).otherwise(rest)


def canonical_key(url, cargo: bool = True) -> Column:
    """What all size variants of an asset have in common: host, size-free path, other parameters by name."""
    name = F.lower(F.regexp_extract(_text(url), _HOST, 1))
    p = F.when(name == "freight.cargo.site", cargo_path(path(url))).otherwise(asset_path(path(url))) if cargo else asset_path(path(url))
    return F.concat(F.coalesce(scheme(url), F.lit("https")), F.lit("://"), name, p, F.lit("?"), _other_parameters(url))


def _number(url, pattern: str, group: int = 1) -> Column:
    """A group of a pattern as a number; null, not an empty text, goes to the cast where nothing fits: failing casts are slow."""
    return F.nullif(F.regexp_extract(_text(url), pattern, group), F.lit("")).try_cast("long")


def _number_in_query(url, names: tuple[str, ...]) -> Column:
    """The first whole number that a parameter of one of the names has."""
    return _number(url, rf"^[^?#]*\?(?:[^#]*?&)?(?i:{'|'.join(names)})=([+-]?\d{{1,19}})(?=[&#]|$)")


def dimension(url, names: tuple[str, ...], pattern: str) -> Column:
    """A size parameter's number, else the first number that the pattern finds in the address."""
    return F.coalesce(_number_in_query(url, names), _number(url, pattern))


def safe_area(width: Column, height: Column) -> Column:
    """Width times height, no less than 0, an eighth of the largest number where that overflows."""
    return F.coalesce(F.try_multiply(F.greatest(width, F.lit(0).cast("long")), F.greatest(height, F.lit(0).cast("long"))), F.lit(C.MAX_INT // 8))


def promised_sizes(url) -> dict[str, Column]:
    """The sizes that an address names: width, height, and a pair of both."""
    pair = lambda i: F.coalesce(*(_number(url, p, i) for p in (C.PAIR_IN_FILE, C.PAIR_IN_QUERY)))
    return {
        "width": dimension(url, ("w", "width"), C.WIDTH_IN_URL), "height": dimension(url, ("h", "height"), C.HEIGHT_IN_URL),
        "pair_width": pair(1), "pair_height": pair(2), "original": F.contains(F.lower(_text(url)), F.lit("freight.cargo.site/t/original/")),
    }


def score_of_sizes(sizes: dict[str, Column], cargo: bool = True) -> Column:
    """How many pixels those are: of both parameters, of the pair, of a lone width or height."""
    width, height = sizes["width"], sizes["height"]
    score = (
        F.when(width.isNotNull() & height.isNotNull(), safe_area(width, height))
        .when(sizes["pair_width"].isNotNull(), safe_area(sizes["pair_width"], sizes["pair_height"]))
        .when(width.isNotNull(), safe_area(width, width))
        .when(height.isNotNull(), safe_area(height, height))
        .otherwise(F.lit(0).cast("long"))
    )
    return F.when(sizes["original"], F.lit(C.MAX_INT // 4)).otherwise(score) if cargo else score


def resolution_score(url, cargo: bool = True) -> Column:
    """How many pixels an address promises."""
    return score_of_sizes(promised_sizes(url), cargo)


def has_query(url) -> Column:
    return F.regexp_extract(_text(url), _QUERY, 1).rlike("[^&]")


def referer_priority(url) -> Column:
    """How telling a page is as an asset's source."""
    p = F.lower(path(url))
    last = F.lower(F.regexp_replace(F.element_at(F.filter(F.split(path(url), "/"), lambda x: x != ""), -1), r"(?<=[^.])\.[^.]*$", ""))
    last = F.when(F.regexp_replace(path(url), "/", "") == "", "").otherwise(last)
    return (
        F.when(F.contains(p, F.lit("{{")), F.lit(-(1 << 61)))
        .when(last.isin("rss", "feed", "stylesheet"), F.lit(-100))
        .when(~is_page(url), F.lit(-200))
        .when((p == "") | (p == "/"), F.lit(0))
        .otherwise(F.lit(100) + F.least(F.length(p), F.lit(200)))
        .cast("long")
    )


def is_skipped(url) -> Column:
    """Whether the classic variant passes an asset over: a telling word in its address, or an icon's extension."""
    text = F.lower(_text(url))
    return text.rlike("|".join(C.SKIPPED_KEYWORDS)) | text.rlike(r"\.(svg|ico)$")
