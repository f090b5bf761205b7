"""Lists, limits, formats and patterns that results depend on."""

# fixed values: file kinds
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "avif")
VIDEO_EXTENSIONS = ("mp4", "mov", "webm", "m4v", "ogv")
NON_PAGE_EXTENSIONS = (
    "css", "js", "json", "xml", "txt", "map", "pdf", "jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico",
    "mp4", "mov", "webm", "m4v", "ogv", "mp3", "wav", "zip",
)

# fixed values: hosts whose assets are addressed without a query, and names of size parameters
QUERYLESS_PREFIXES = ("https://www.datocms-assets.com/", "https://images.datocms-assets.com/", "https://images.ctfassets.net/", "https://cdn.sanity.io/")
SIZE_PARAMETERS = ("w", "width", "h", "height", "dpr", "q", "quality", "fit", "crop", "fm", "format", "auto", "rect", "resize", "sz", "s")
REJECTED_SCHEMES = ("data", "blob", "mailto", "tel", "javascript")

# fixed values: project pages
SLUG_PREFIXES = ("/work/", "/works/", "/projects/", "/case-studies/", "/case-study/", "/portfolio/")
NAVIGATION_SLUGS = (
    "about", "contact", "insights", "news", "blog", "privacy", "privacy-policy", "imprint", "legal", "careers", "jobs",
    "services", "service", "team", "product-design", "brands", "content", "code-of-conduct",
)
SKIPPED_KEYWORDS = ("favicon", "avatar", "1x1", "blank", "spacer", "logo", "icon")
SKIPPED_LINK_PARTS = ("/about", "/contact", "/privacy", "/legal", "/terms", "/policy", "/jobs", "/careers", "/feed", "/tag/", "/category/")

# fixed values: attributes
ASSET_ATTRIBUTES = ("src", "data-src", "data-lazy-src", "data-original", "poster")
SRCSET_ATTRIBUTES = ("srcset", "data-srcset")

# fixed values: patterns
CSS_URL = r"""(?i)url\(["']?(https://[^"')\s]+)["']?\)"""
WIX_SCAN = r"""(?i)https://static\.wixstatic\.com/media/[^\s"'<>]+"""
DATO_SCAN = r"""(?i)https://(?:www\.)?datocms-assets\.com/[^\s"'<>]+\.(?:jpg|jpeg|png|webp|avif|gif)"""
VIDEO_SCAN = r"""(?i)https://[^\s"'<>]+\.(?:mp4|mov|webm|m4v)"""
WIX_ORIGINAL = r"^(https://static\.wixstatic\.com/media/[^/]+~mv2\.[a-zA-Z]+)(?:/.*)?$"
WIX_PLAIN = r"^(https://static\.wixstatic\.com/media/[^/]+\.[a-zA-Z]{3,4})(?:/v1/.*)?$"
WORDPRESS_SIZED = r"(?i)^(https?://[^/]+/wp-content/uploads/\d{4}/\d{2}/)(.+?)(-\d+x\d+)(\.[a-z]+)$"
SIZED_FILE = r"-\d{2,5}x\d{2,5}(?=\.[a-zA-Z0-9]+$)"
WIDTH_SEGMENT = r"([/_-])w[_=-]?\d{2,5}([,_-]|/)"
HEIGHT_SEGMENT = r"([/_-])h[_=-]?\d{2,5}([,_-]|/)"
CARGO_PATH = r"^/(?:w/\d+|t/original)/i/([^/]+)/(.+)$"
WIDTH_IN_URL = r"(?i)(?:^|[?&/_,-])w(?:idth)?[_=-]?(\d{2,5})"
HEIGHT_IN_URL = r"(?i)(?:^|[?&/_,-])h(?:eight)?[_=-]?(\d{2,5})"
PAIR_IN_FILE = r"(?i)(\d{2,5})x(\d{2,5})(?=\.[a-z0-9]+(?:$|[?#]))"
PAIR_IN_QUERY = r"(?i)[?&](?:w|width)=(\d{2,5})[^\n]*?[?&](?:h|height)=(\d{2,5})"
SANITY_PROJECT = r'(?i)(?:"projectId"|projectId)\s*:\s*"([a-z0-9]+)"'
SANITY_DATASET = r'(?i)(?:"dataset"|dataset)\s*:\s*"([a-z0-9_-]+)"'
SANITY_IMAGE = r"(?i)(image-[a-f0-9]+-\d+x\d+-(?:jpg|jpeg|png|webp|gif|avif))"
SANITY_PARTS = r"(?i)^image-([a-f0-9]+)-(\d+x\d+)-([a-z0-9]+)$"
PROJECT_URL = r'(?is)"project_url"\s*:\s*"([^"]+)"'
SLUG = r'(?i)"slug"\s*:\s*"([a-z0-9][a-z0-9\-]+)"'
CLASSIC_WIX_SCAN = r"""https://static\.wixstatic\.com/media/[^"'\s]+"""
CLASSIC_DATO_SCAN = r"""(?i)https://(?:www\.)?datocms-assets\.com/[^\s"'<>&]+\.(?:jpg|jpeg|png|webp|avif|gif)"""
CLASSIC_VIDEO_SCAN = r"""(?i)https://[^\s"']+\.(?:mp4|mov|webm|m4v)"""
IMAGE_SOURCE = r"""(?is)<img\b[^>]*?\ssrc\s*=\s*["']([^"']+)["']"""
CARGO_HOST = "freight.cargo.site"
CARGO_ORIGINAL = r"""https://freight\.cargo\.site/t/original/[^"'\s<>]+\.(?:jpg|jpeg|png|gif|JPG|JPEG|PNG)"""
JSON_SCRIPT = r"""(?is)<script[^>]*\btype\s*=\s*["']text/json["'][^>]*>(.*?)</script>"""

# fixed values: white space, line ends included
WHITE_SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# fixed values: limits
MAX_PAGES, MAX_PAGES_CLASSIC = 100, 40
MIN_PIXELS, MIN_PIXELS_CLASSIC = 900, 1100
MAX_VIDEO_BYTES = 50 * 1024 * 1024
MAX_IMAGES = 200
MAX_IMAGES_RANGE = (1, 1000)
NEAR_BITS, NEAR_BITS_CLASSIC = 8, 12
MAX_FILENAME = 120
MAX_SLUGS, MAX_SLUGS_CLASSIC = 24, 12
LOG_KEPT, LOG_SHOWN, LOG_SHOWN_CLASSIC = 120, 12, 8
MAX_INT = (1 << 63) - 1

# fixed values: file name extension of a MIME type
MIME_EXTENSIONS = {
    "image/jpeg": "jpeg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/avif": "avif", "image/svg+xml": "svg",
    "video/mp4": "mp4", "video/quicktime": "mov", "video/webm": "webm", "video/x-m4v": "m4v", "text/html": "html", "application/pdf": "pdf",
}
