"""URLs, phones, handles, e-mails and HTML, as functions of single values and as columns."""

from __future__ import annotations

import ipaddress
import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, parse_qsl, quote, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that only track. All that begin with utm_ go as well.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "utm_name", "utm_cid", "utm_reader", "utm_referrer", "fbclid", "gclid", "dclid",
    "msclkid", "ttclid", "twclid", "yclid", "igshid", "igsh", "ref", "ref_src",
    "mc_cid", "mc_eid", "gclsrc", "wbraid", "gbraid", "si", "spm", "_ga", "_gl",
    "sc_cid", "campaign", "fb_action_ids", "fb_action_types",
)
#: Hosts whose subdomains are shops of their own.
SHOP_HOSTS = ("youcan.shop", "myshopify.com", "lightfunnels.com", "youcan.store")
#: Two-label public suffixes known here; every other suffix is taken as one label.
SUFFIXES = frozenset("com.dz org.dz net.dz gov.dz edu.dz co.uk org.uk com.tr com.br com.au co.jp myshopify.com youcan.shop youcan.store github.io blogspot.com".split())
URL_PATTERN = r"(?i)\bhttps?://[^\s<>\"')]+"
BARE_HOST = r"(?i)\b(?:[a-z0-9-]+\.)+(?:dz|com|shop|store|net|fr|io|co|org)\b(?:/[^\s<>\"')]*)?"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
BLOCKED_NETS = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4", "::1/128", "fc00::/7", "fe80::/10")]


def form_encoded(pairs: list[tuple[str, str]]) -> str:
    """Names and values as a browser writes a form: spaces as plus signs, all but letters, digits and ``*-._`` in percent."""
    coded = [[quote_plus(x, safe="*").replace("~", "%7E") for x in kv] for kv in pairs]
    return "&".join("=".join(kv) for kv in coded)


def canonical_url(url: str | None, base: str | None = None) -> str | None:
    """None for what isn't an http(s) URL. Port, user and fragment go, as do tracking parameters; the rest is sorted by name."""
    if url is None:
        return None
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        host = (parts.hostname or "").lower()
        if not host.isascii():
            host = host.encode("idna").decode()
    except (ValueError, UnicodeError):
        return None
    if parts.scheme.lower() not in ("http", "https") or not host or re.search(r"[\s<>^|%#]", host):
        return None
    host = host.removeprefix("www.")
    path = parts.path.replace("\\", "/")
    if "/." in path:
        path = urlsplit(urljoin("http://h/", path)).path
    path = re.sub("/{2,}", "/", quote(path, safe="!$%&'()*+,-./:;=@[]^_|~"))
    path = path.removesuffix("/") or "/"
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not (k.lower() in TRACKING or k.lower().startswith("utm_"))]
    query = form_encoded(sorted(kept, key=lambda kv: kv[0]))
    return f"{parts.scheme.lower()}://{host}{path}" + (f"?{query}" if query else "")


def resolve_url(href: str | None, base: str) -> str | None:
    return canonical_url(href, base)


def same_site(a: str | None, b: str | None) -> bool:
    """Whether two URLs have one host, ``www.`` aside."""
    x, y = (urlsplit(c).hostname if (c := canonical_url(u)) else None for u in (a, b))
    return x is not None and x == y


def same_registrable(a: str | None, b: str | None) -> bool:
    x, y = (registrable(urlsplit(c).hostname) if (c := canonical_url(u)) else None for u in (a, b))
    return x is not None and x == y


def shop_subdomain(host: str) -> bool:
    """Whether a host is a shop's own name below one of ``SHOP_HOSTS``."""
    return host.endswith(tuple(f".{root}" for root in SHOP_HOSTS))


def urls_of(text: str | None) -> list[str]:
    """Canonical URLs of a text in order, each once: written out ones first, then bare hosts as https."""
    found = [m[0] for p in (URL_PATTERN, BARE_HOST) for m in re.finditer(p, text or "")]
    made = (canonical_url(u if u.startswith("http") else f"https://{u}") for u in found)
    return list(dict.fromkeys(u for u in made if u))


@F.pandas_udf(T.ArrayType(T.StringType()))
def urls_udf(s: pd.Series) -> pd.Series:
    return s.map(urls_of)


def registrable(host: str | None) -> str | None:
    if not host:
        return None
    labels = host.split(".")
    keep = 3 if ".".join(labels[-2:]) in SUFFIXES else 2
    return ".".join(labels[-keep:])


@F.pandas_udf(T.StringType())
def canonical_url_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical_url, na_action="ignore")


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 24)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host == "", None).otherwise(F.regexp_replace(host, r"^www\.", ""))


def urls_in(text: Column) -> Column:
    """URLs as they are written out; ``urls_udf`` gives canonical ones, of bare hosts too."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(URL_PATTERN), 0))


def emails_in(text: Column) -> Column:
    found = F.when(text.contains("@"), F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL_PATTERN})")), F.lower))
    bad = lambda e: e.endswith("example.com") | e.contains("sentry") | e.startswith("noreply@")
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.coalesce(F.array_distinct(F.filter(found, lambda e: ~bad(e))), none)


LATIN_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")


def phone(text: Column, mobile: bool = False) -> Column:
    """A number of country code 213 as +213…; null if it isn't one. Numbering plans are approximated by length and first digit."""
    digits = F.translate(text, "٠١٢٣٤٥٦٧٨٩ ().-/ ", "0123456789")
    plain = F.regexp_replace(F.regexp_replace(digits, "^00", "+"), "^213", "+213")
    national = F.regexp_extract(plain, r"^(?:\+2130?|0)([567]\d{8}|[234]\d{7})$", 1)
    ok = national.rlike("^[567]") if mobile else national != ""
    return F.when(ok, F.concat(F.lit("+213"), national))


def phones_in(text: Column, mobile: bool = False) -> Column:
    found = F.regexp_extract_all(F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789"), F.lit(r"((?:\+|00)?(?:213[\s.-]?)?0?[2-7](?:[\s.-]?\d){7,8})(?!\d)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda p: phone(p, mobile)), lambda p: p.isNotNull()))


#: Hosts of the social networks, and first path parts that are no profiles.
NETWORK_HOSTS = {
    "facebook.com": "facebook", "fb.com": "facebook", "fb.me": "facebook", "m.facebook.com": "facebook", "web.facebook.com": "facebook",
    "instagram.com": "instagram", "instagr.am": "instagram", "tiktok.com": "tiktok", "vm.tiktok.com": "tiktok", "wa.me": "whatsapp",
    "api.whatsapp.com": "whatsapp", "chat.whatsapp.com": "whatsapp", "whatsapp.com": "whatsapp", "m.me": "messenger", "messenger.com": "messenger",
}
RESERVED = (
    "p", "reel", "reels", "explore", "stories", "tv", "about", "help", "privacy",
    "login", "sharer", "share", "watch", "marketplace", "groups", "photo", "posts",
    "search", "legal", "policies", "directory", "hashtag",
)
PROFILE = {"facebook": "https://www.facebook.com/", "instagram": "https://www.instagram.com/", "messenger": "https://m.me/", "tiktok": "https://www.tiktok.com/@", "whatsapp": "https://wa.me/"}
#: Where a text may hold profile links: network, pattern.
HANDLE_PATTERNS = [
    ("whatsapp", r"(?:https?://)?(?:api\.)?wa\.me/[^\s\"'<>)]+"),
    ("whatsapp", r"(?:https?://)?api\.whatsapp\.com/send\?[^\s\"'<>)]+"),
    ("messenger", r"(?:https?://)?(?:www\.)?m\.me/[^\s\"'<>)]+"),
    ("facebook", r"https?://(?:www\.|web\.|m\.)?facebook\.com/[^\s\"'<>)]+"),
    ("instagram", r"https?://(?:www\.)?instagram\.com/[^\s\"'<>)]+"),
    ("tiktok", r"https?://(?:www\.)?tiktok\.com/[^\s\"'<>)]+"),
]


def phone_of(text: str | None, mobile: bool = False) -> str | None:
    """As ``phone``, of a single value."""
    digits = re.sub(r"[ ().\-/\u00a0]", "", (text or "").translate(LATIN_DIGITS))
    plain = re.sub("^213", "+213", re.sub("^00", "+", digits))
    m = re.fullmatch(r"(?:\+2130?|0)([567]\d{8}|[234]\d{7})", plain)
    return f"+213{m[1]}" if m and (not mobile or m[1][0] in "567") else None


def handle(value: str | None, network: str | None = None) -> tuple[str, str] | None:
    """(network, value) of a profile URL, or of ``@name`` with a given network: a lower-case name, a number's
    digits, or a page number as ``page_id:…``. None for reserved paths, group invitations and other hosts."""
    text = (value or "").strip()
    if network and re.fullmatch(r"@?[\w.]{2,40}", text):
        return network, text.removeprefix("@").lower()
    url = canonical_url(text if text.startswith("http") else f"https://{text}") if text else None
    if url is None:
        return None
    parts = urlsplit(url)
    host, path = parts.hostname, [x for x in parts.path.split("/") if x]
    net = network or next((n for h, n in NETWORK_HOSTS.items() if host == h or host.endswith(f".{h}")), None)
    first = path[0] if path else ""
    if net == "whatsapp":
        asked = parse_qs(parts.query).get("phone", [""])[0]
        number = None if host == "chat.whatsapp.com" else phone_of(asked or (path[-1] if path else ""), mobile=True)
        return ("whatsapp", number) if number else None
    if net == "messenger" and (not first or first in RESERVED):
        number = re.search(r"\d{8,}", text)
        return ("messenger", number[0]) if number else None
    if net == "facebook" and first == "profile.php":
        number = parse_qs(parts.query).get("id", [""])[0]
        return ("facebook", f"page_id:{number}") if re.fullmatch(r"\d{5,}", number) else None
    if net == "facebook" and first in ("pages", "p"):
        return ("facebook", path[1].lower()) if len(path) > 1 else None
    name = first.lower() if net in ("facebook", "messenger") else first.removeprefix("@").lower()
    held = first if net in ("facebook", "messenger") else name
    return (net, name) if net and name and held not in RESERVED else None


def profile_url(network: str, value: str) -> str:
    if value.startswith("page_id:"):
        return f"https://www.facebook.com/profile.php?id={value[8:]}"
    return PROFILE[network] + value.replace("+", "")


def handles_in(text: str | None) -> list[tuple[str, str]]:
    """Profiles that a text links to, in the patterns' order, each once."""
    found = (handle(m[0], net) for net, p in HANDLE_PATTERNS for m in re.finditer(p, text or "", re.I))
    return list(dict.fromkeys(h for h in found if h))


@F.pandas_udf(T.StringType())
def handle_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: "/".join(h) if (h := handle(v)) else None, na_action="ignore")


def blocked_ip(ip: str | None) -> bool:
    """Private, local and reserved addresses, and what isn't an address."""
    try:
        found = ipaddress.ip_address((ip or "").strip("[]"))
    except ValueError:
        return True
    found = getattr(found, "ipv4_mapped", None) or found
    return any(found.version == n.version and found in n for n in BLOCKED_NETS)


def _rows(**fields: str) -> T.ArrayType:
    kinds = {"string": T.StringType(), "double": T.DoubleType()}
    return T.ArrayType(T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()]))


class _Page(HTMLParser):
    SILENT = ("script", "style", "noscript", "svg")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.heads, self.metas, self.links, self.body, self.scripts = [], [], [], [], [], []
        self.stack: list[str] = []
        self.marks: list[bool] = []  # whether each open element looks like a floating widget
        self.open_link: list | None = None

    @staticmethod
    def _mark(a: dict) -> bool:
        return bool(FLOATING.search(a.get("class") or "") or FLOATING.search(a.get("id") or ""))

    def _place(self, tag: str, a: dict) -> str | None:
        """Where an element is, by itself and its seven nearest ancestors; None if they don't say."""
        for t, floats in zip([tag, *self.stack[:-8:-1]], [self._mark(a), *self.marks[:-8:-1]], strict=True):
            if t in ("footer", "header") or floats:
                return t if t in ("footer", "header") else "floating"
        return None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("name") or a.get("property") or "").lower() in ("description", "og:title", "og:description"):
            self.metas.append(a.get("content") or "")
        elif tag == "a" and a.get("href"):
            self.open_link = [a["href"], a.get("aria-label") or "", self._place(tag, a)]
            self.links.append(self.open_link)
        if tag not in ("meta", "link", "br", "img", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"):
            self.stack.append(tag)
            self.marks.append(self._mark(a))

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                self.marks.pop()
            self.marks.pop()
        if tag == "a":
            self.open_link = None

    def handle_data(self, data):
        if any(t in self.SILENT for t in self.stack):
            self.scripts.append(data)
            return
        if "title" in self.stack:
            self.title.append(data)
            return
        if self.stack and self.stack[-1] in ("h1", "h2", "h3"):
            self.heads.append(data.strip())
        if self.open_link is not None:
            self.open_link[1] += data
        self.body.append(data)


def parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def corpus_of(page: _Page) -> str:
    products = [t for h, t, _ in page.links if re.search(r"/products?/|/produit", h)][:60]
    body = " ".join(" ".join(page.body).split())[:20_000]
    return "\n".join(x for x in ["".join(page.title).strip(), *page.metas, *page.heads[:25], *products, body] if x)[:120_000]


def text_corpus(html: str | None) -> str:
    """Title, descriptions, up to 25 headings, up to 60 product links and the body's first 20,000 characters."""
    return corpus_of(parsed(html))


#: How sure a channel is that a link names, and one that only the text names.
LINK_CONFIDENCE = {"whatsapp": 0.95, "messenger": 0.9, "instagram": 0.85, "facebook": 0.85, "tiktok": 0.8, "phone": 0.8, "email": 0.6}
TEXT_CONFIDENCE = {"phone": 0.7, "whatsapp": 0.7, "profile": 0.75, "email": 0.55}
FLOATING = re.compile("whatsapp|float|fixed|sticky|fab|chat-widget|crisp|tawk|pulse", re.I)
PHONE_IN_TEXT = re.compile(r"((?:\+|00)?(?:213[\s.-]?)?0?[2-7](?:[\s.-]?[0-9]){7,8})(?![0-9])")
MAIL_LINK = re.compile(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}")


def contacts_of(page: _Page, html: str) -> list[tuple[str, str, float, str]]:
    out: dict[tuple[str, str], tuple] = {}

    def add(kind: str, value: str, confidence: float, place: str) -> None:
        out.setdefault((kind, value), (kind, value, confidence, place))

    for href, _, where in page.links:
        at = html.find(f'href="{href}"')
        place = "body" if at < 0 else where or ("header" if at < 0.15 * len(html) else "body")
        if re.match(r"(https?:)?//(?:api\.)?wa\.me/", href, re.I) or re.search(r"api\.whatsapp\.com/send", href, re.I):
            number = re.search(r"(?:wa\.me/|phone=)(\+?[0-9]{8,15})", href)
            if number and (value := phone_of(number[1], mobile=True)):
                add("whatsapp", value, LINK_CONFIDENCE["whatsapp"], place)
        elif href[:7].lower() == "mailto:":
            mail = href[7:].split("?")[0].lower()
            if MAIL_LINK.fullmatch(mail):
                add("email", mail, LINK_CONFIDENCE["email"], place)
        elif href[:4].lower() == "tel:":
            if value := phone_of(re.sub("[^+0-9]", "", href[4:])):
                add("phone", value, LINK_CONFIDENCE["phone"], place)
        elif found := handle(href):
            add(found[0], found[1].removeprefix("page_id:"), LINK_CONFIDENCE[found[0]], place)
    text = " ".join(page.body)[:600_000] + "\n" + " ".join(page.scripts)[:200_000]
    for m in PHONE_IN_TEXT.finditer(text.translate(LATIN_DIGITS)):
        value = phone_of(re.sub(r"\s", "", m[1]))
        if value and ("whatsapp", value) not in out:
            add("phone", value, TEXT_CONFIDENCE["phone"], "body")
    for net, value in handles_in(text):
        add(net, value.removeprefix("page_id:"), TEXT_CONFIDENCE["whatsapp" if net == "whatsapp" else "profile"], "body")
    for m in re.finditer(EMAIL_PATTERN, text):
        mail = m[0].lower()
        if not (mail.endswith("example.com") or "sentry" in mail or mail.startswith("noreply@")):
            add("email", mail, TEXT_CONFIDENCE["email"], "body")
    return sorted(out.values(), key=lambda c: -c[2])


def contacts(html: str | None) -> list[tuple[str, str, float, str]]:
    """(kind, value, confidence, placement): links first, then text; each (kind, value) once, surest first."""
    return contacts_of(parsed(html), html or "")


CONTACT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("placement", T.StringType())])


def _contact_rows(found: list[tuple]) -> list[dict]:
    return [dict(zip(CONTACT.names, c, strict=True)) for c in found]


@F.pandas_udf(T.ArrayType(CONTACT))
def contacts_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda h: _contact_rows(contacts(h)))


@F.pandas_udf(T.StructType([T.StructField("corpus", T.StringType()), T.StructField("contacts", T.ArrayType(CONTACT))]))
def page_udf(s: pd.Series) -> pd.DataFrame:
    """A page's text corpus and contacts, parsed once."""
    pages = [(parsed(h), h or "") for h in s]
    return pd.DataFrame({"corpus": [corpus_of(p) for p, _ in pages], "contacts": [_contact_rows(contacts_of(p, h)) for p, h in pages]})


@F.pandas_udf(T.StringType())
def text_corpus_udf(s: pd.Series) -> pd.Series:
    return s.map(text_corpus)


@F.pandas_udf(_rows(href="string", label="string", placement="string"))
def anchors_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda h: [{"href": a, "label": " ".join(t.split()), "placement": p} for a, t, p in parsed(h).links])


#: Products that a catalogue is read for, prices of a page, and what a price may be.
CATALOG_CAP, PRICE_CAP, PRICE_LOW, PRICE_HIGH = 250, 400, 100, 500_000


def _number(text: Column) -> Column:
    """The number that begins a text once all but digits and points are taken out; null if there is none."""
    return F.regexp_extract(F.regexp_replace(text, "[^0-9.]", ""), r"^\d*\.?\d*", 0).try_cast("double")


def _latest(days: Column) -> Column:
    return F.array_max(F.filter(F.transform(days, lambda d: F.try_to_timestamp(d)), lambda t: t.isNotNull()))


def first_json_catalog(body: Column) -> Column:
    """A product list's JSON as (count, prices, currency, latest): every variant's price above 0 of the first 250 products."""
    kind = "struct<products:array<struct<updated_at:string,published_at:string,variants:array<struct<price:string>>>>>"
    items = F.from_json(body, kind)["products"]
    some = F.slice(items, 1, CATALOG_CAP)
    each = F.flatten(F.transform(some, lambda p: F.transform(F.coalesce(p["variants"], F.array().cast("array<struct<price:string>>")), lambda v: _number(v["price"]))))
    prices = F.filter(each, lambda x: x > 0)
    latest = _latest(F.transform(some, lambda p: F.coalesce(p["updated_at"], p["published_at"])))
    currency = F.when(F.size(prices) > 0, "DZD?")
    return F.when(items.isNotNull(), F.struct(F.size(items).alias("count"), prices.alias("prices"), currency.alias("currency"), latest.alias("latest")))


def woo_catalog(body: Column) -> Column:
    items = F.from_json(body, "array<struct<price:string,prices:struct<price:string,currency_code:string>,date_created:string,date_modified:string>>")
    some = F.slice(items, 1, CATALOG_CAP)
    prices = F.filter(F.transform(some, lambda p: _number(F.coalesce(p["prices"]["price"], p["price"]))), lambda x: x > 0)
    named = F.filter(F.transform(some, lambda p: p["prices"]["currency_code"]), lambda c: c.isNotNull())
    latest = _latest(F.transform(some, lambda p: F.coalesce(p["date_created"], p["date_modified"])))
    currency = F.when(F.size(named) > 0, F.element_at(named, -1))
    return F.when(items.isNotNull(), F.struct(F.size(items).alias("count"), prices.alias("prices"), currency.alias("currency"), latest.alias("latest")))


def sitemap_products(xml: Column, most: int | None = None) -> Column:
    locs = F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>([^<]+)</loc>"), 1), lambda u: F.trim(u))
    found = F.filter(locs, lambda u: u.rlike("(?i)/products?/|/produit/|/boutique/") & ~u.rlike(r"(?i)/products?\.json"))
    return F.slice(found, 1, most) if most else found


def sitemap_catalog(xml: Column) -> Column:
    """A sitemap's product links and last change as (count, prices, currency, latest)."""
    days = F.transform(F.regexp_extract_all(xml, F.lit(r"(?i)<lastmod>([^<]+)</lastmod>"), 1), lambda d: F.trim(d))
    none = F.array().cast("array<double>")
    return F.when(xml.isNotNull(), F.struct(F.size(sitemap_products(xml)).alias("count"), none.alias("prices"), F.lit(None).cast("string").alias("currency"), _latest(days).alias("latest")))


def html_prices(html: Column) -> Column:
    """Prices of a page that name the dinar, from 100 to 500,000, the first 400."""
    shown = F.regexp_extract_all(html, F.lit(r"(?i)(\d[\d\s.,]{1,12})\s*(?:dzd|da(?![A-Za-z0-9_])|دج|د\.ج|dinars?)"), 1)
    values = F.transform(shown, lambda x: _number(F.regexp_replace(F.regexp_replace(x, r"[\s.]", ""), "^([^,]*),", "$1.")))
    return F.slice(F.filter(values, lambda v: (v >= PRICE_LOW) & (v <= PRICE_HIGH)), 1, PRICE_CAP)


def html_catalog(html: Column) -> Column:
    prices = html_prices(html)
    return F.when(F.size(prices) > 0, F.struct(F.lit(None).cast("int").alias("count"), prices.alias("prices"), F.lit("DZD").alias("currency"), F.lit(None).cast("timestamp").alias("latest")))


CATALOG_FIELDS = ["product_count", "median_price", "currency", "latest"]


def merged_catalog(sources: dict[str, Column]) -> Column:
    """One catalogue of several ``(count, prices, currency, latest)``: field by field the first that is known, and
    the first source that has anything, in the order given; source ``none`` where none has."""
    field = {
        "product_count": [c["count"] for c in sources.values()],
        "median_price": [F.when(F.size(c["prices"]) > 0, array_median(c["prices"])) for c in sources.values()],
        "currency": [c["currency"] for c in sources.values()],
        "latest": [c["latest"] for c in sources.values()],
    }
    name = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in sources.items()), F.lit("none"))
    return F.struct(*(F.coalesce(*v).alias(k) for k, v in field.items()), name.alias("source"))


def freshness_days(latest: Column, now: Column) -> Column:
    """Days since a catalogue's last change, at least 0; null if unknown."""
    return F.when(latest.isNotNull(), F.greatest(F.lit(0.0), (now.cast("timestamp").cast("double") - latest.cast("timestamp").cast("double")) / 86400))


def array_median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2).otherwise(0.0)
