"""Candidate sources, and how candidates become leads."""

from __future__ import annotations

from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarind.functions import text as X
from tamarind.functions import web as U
from tamarind.operators.graph import connected_components
from tamarind.session import stage

#: Hosts and words that are no merchants' own shops.
MARKETPLACES = ["amazon.", "aliexpress.", "alibaba.", "ebay.", "temu.", "shein.", "jumia.", "olx.", "ouedkniss.", "facebook.", "instagram.", "tiktok.", "youtube.", "twitter.", "x.com", "linkedin.", "pinterest.", "wikipedia.", "reddit.", "yelp.", "tripadvisor.", "glovo.", "yassir.", "taobao.", "etsy.", "walmart."]
NEWS = ["news", "journal", "presse", "akhbar", "echoroukonline", "elwatan", "liberte", "tsa-algerie", "aps.dz", "dw.com", "bbc.", "cnn.", "forbes."]
CSV_ALIASES = {"url": ["url", "website", "site", "link"], "name": ["name", "shop", "title"], "phone": ["phone", "tel", "whatsapp"], "email": ["email", "mail"], "handle": ["handle", "instagram", "facebook"]}


def listed(host: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(host), p))


#: Shape of the handles that candidates carry.
HANDLES = T.ArrayType(T.StructType([T.StructField("network", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(HANDLES)
def handles_udf(s: pd.Series) -> pd.Series:
    """Profiles on the three networks that merchants are known by."""
    kept = ("facebook", "instagram", "tiktok")
    return s.map(lambda t: [{"network": n, "value": v.removeprefix("page_id:")} for n, v in U.handles_in(t) if n in kept])


def pasted(blobs: DataFrame, text: str = "text") -> DataFrame:
    """One candidate for each URL of a blob, bare hosts included, each with all its phones, e-mails and handles;
    one without URL if there is none. Its name is the text about the host."""
    t = F.col(text)
    rows = blobs.withColumns({"phones": U.phones_in(t), "emails": U.emails_in(t), "handles": handles_udf(t), "_u": U.urls_udf(t)})
    found = rows.withColumn("url", F.explode_outer("_u")).drop("_u")
    at = F.position(U.host_of(F.col("url")), F.lower(t))
    start = F.greatest(F.lit(1), at - 80)
    about = F.when(at > 0, F.substring(t, start, at + F.lit(120) - start))
    return found.withColumn("name", X.merchant_name_udf(about))


def added(spark: SparkSession, url: str | None = None, name: str | None = None, phones: list[str] = (), emails: list[str] = (), handles: list[tuple[str, str]] = ()) -> DataFrame:
    """A single candidate by hand."""
    row = (U.canonical_url(url), name, [p for p in map(U.phone_of, phones) if p], [e.lower() for e in emails], [tuple(h) for h in handles])
    return spark.createDataFrame([row], CANDIDATE)


def fixed_results(spark: SparkSession, items: list[tuple[str, str]]) -> DataFrame:
    """Search results ``(url, title)`` given as a list, for work without a network."""
    return filtered(spark.createDataFrame(items, "url string, title string"))


def social_pasted(blobs: DataFrame, text: str = "text") -> DataFrame:
    """Handles of a list parted by commas or lines; values without one are dropped."""
    rows = blobs.withColumn("value", F.explode(F.split(text, r"[\n,]")))
    return rows.withColumn("handle", U.handle_udf(F.trim("value"))).filter("handle is not null")


def ad_library_pasted(blobs: DataFrame, now: str, text: str = "text") -> DataFrame:
    value = F.trim(F.col("value"))
    rows = blobs.withColumn("value", F.explode(F.split(text, r"[\n,;]")))
    return rows.select(value.alias("value"), value.rlike(r"^\d{5,}$").alias("is_page_id"), U.handle_udf(value).alias("handle"), F.lit(now).cast("timestamp_ntz").alias("first_seen")).filter("is_page_id or handle is not null")


def parse_csv(content: str, delimiter: str = ",") -> tuple[list[dict], int]:
    """Rows by lower-cased header, and the number of ragged rows. Quotes group; a doubled quote is no escape."""
    lines = [x for x in content.splitlines() if x.strip()]
    if not lines:
        return [], 0
    header, rows, ragged = [h.strip().lower() for h in lines[0].split(delimiter)], [], 0
    for line in lines[1:]:
        cells, cell, quoted = [], [], False
        for c in line:
            if c == '"':
                quoted = not quoted
            elif c == delimiter and not quoted:
                cells.append("".join(cell).strip())
                cell = []
            else:
                cell.append(c)
        cells.append("".join(cell).strip())
        if len(cells) == len(header):
            rows.append(dict(zip(header, cells, strict=True)))
        else:
            ragged += 1
    return rows, ragged


def csv_imported(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Candidates of whole CSV files, their columns coalesced by alias; ragged rows are dropped."""
    names = list(CSV_ALIASES)

    def run(frames):
        for frame in frames:
            out = []
            for content in frame["content"]:
                for row in parse_csv(bytes(content).decode("utf-8", "replace"), delimiter)[0]:
                    out.append([next((row[a] for a in CSV_ALIASES[n] if row.get(a)), None) for n in names])
            yield pd.DataFrame(out, columns=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"{n} string" for n in names))


def directory_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(page_url, url, label)``: links of a directory page to other sites, each once, whose label has three
    characters or hints at a shop."""
    links = pages.select(F.col(url).alias("page_url"), F.explode(U.anchors_udf(F.col(html))).alias("a"))
    rows = links.select("page_url", U.canonical_url_udf("a.href").alias("url"), F.col("a.label").alias("label")).filter("url is not null")
    host = U.host_of(F.col("url"))
    hinted = listed(F.col("label"), LABEL_HINTS)
    kept = rows.filter((host != U.host_of(U.canonical_url_udf("page_url"))) & ~listed(host, MARKETPLACES) & ~listed(host, NEWS) & (hinted | (F.length("label") >= 3)))
    return kept.groupBy("page_url", "url").agg(F.min(F.substring("label", 1, 80)).alias("label"))


def filtered(results: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """``(url, title)`` with canonical URLs, each once, without marketplaces, news and excluded hosts."""
    rows = results.withColumn("url", U.canonical_url_udf("url")).filter("url is not null")
    host = U.host_of(F.col("url"))
    return rows.filter(~listed(host, MARKETPLACES) & ~listed(host, NEWS) & ~host.isin(*exclude)).groupBy("url").agg(F.min("title").alias("title"))


def search_results(responses: DataFrame, provider: str, column: str = "body") -> DataFrame:
    """``(url, title)`` of a provider's saved JSON responses, without marketplaces and news."""
    shapes = {
        "brave": ("struct<web:struct<results:array<struct<url:string,title:string>>>>", "b.web.results", "url"),
        "google_cse": ("struct<items:array<struct<link:string,title:string>>>", "b.items", "link"),
        "serper": ("struct<organic:array<struct<link:string,title:string>>>", "b.organic", "link"),
    }
    kind, place, field = shapes[provider]
    rows = responses.withColumn("b", F.from_json(column, kind)).select(F.explode(place).alias("r"))
    return filtered(rows.select(F.col(f"r.{field}").alias("url"), F.col("r.title").alias("title")))


def affordable(queries: DataFrame, budgets: dict[str, int], order: list[str]) -> DataFrame:
    """``(…, provider)``: the calls that each provider's budget allows, in order; spent before a call, not after."""
    plan = queries.sparkSession.createDataFrame(list(budgets.items()), "provider string, _units int")
    rows = queries.crossJoin(F.broadcast(plan))  # providers are a handful
    nth = F.row_number().over(Window.partitionBy("provider").orderBy(*order))
    return rows.withColumn("_n", nth).filter("_n <= _units").drop("_n", "_units")


def places(responses: DataFrame, column: str = "body", most: int = 10) -> DataFrame:
    """Candidates of saved places responses: site, name and phone of the first ten of each."""
    kind = "struct<places:array<struct<websiteUri:string,displayName:struct<text:string>,internationalPhoneNumber:string,nationalPhoneNumber:string>>>"
    rows = responses.select(F.explode(F.slice(F.from_json(column, kind)["places"], 1, most)).alias("r"))
    number = U.phone(F.coalesce("r.internationalPhoneNumber", "r.nationalPhoneNumber"))
    none = F.array().cast("array<string>")
    return rows.select(U.canonical_url_udf("r.websiteUri").alias("url"), F.col("r.displayName.text").alias("name"), F.when(number.isNotNull(), F.array(number)).otherwise(none).alias("phones"))


def ad_library(responses: DataFrame, now: str, column: str = "body") -> DataFrame:
    """Advertisers ``(page_id, name, ads, first_seen)`` of saved ad library responses; ads without a page are dropped.

    A response that is an error fails the query with the provider's message.
    """
    kind = "struct<error:struct<message:string>,data:array<struct<page_id:string,page_name:string,ad_delivery_start_time:string>>>"
    rows = responses.withColumn("b", F.from_json(column, kind))
    failed = F.raise_error(F.concat(F.lit("ad library: "), F.col("b.error.message"))).cast("array<struct<page_id:string,page_name:string,ad_delivery_start_time:string>>")
    ads = rows.select(F.explode(F.when(F.col("b.error").isNotNull(), failed).otherwise(F.col("b.data"))).alias("a")).select("a.*").filter("page_id is not null")
    first = F.coalesce(F.min(F.try_to_timestamp("ad_delivery_start_time")).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz"))
    return ads.groupBy("page_id").agg(F.max("page_name").alias("name"), F.count("*").alias("ads"), first.alias("first_seen"))


def generate_queries(spark: SparkSession, languages: list[str], places: DataFrame, terms: dict[str, list[str]], most: int | None = None, footprint: str | None = None, extra: list[str] = (), first_terms: int | None = None) -> DataFrame:
    """``(language, wilaya, term, query)``: every language's terms in every place, also with a platform's footprint, then
    extra ones; the first ``most`` in order, each query once. ``places (wilaya)`` and terms are small dimensions."""
    small = spark.createDataFrame([(i, k, j, t) for i, k in enumerate(languages) for j, t in enumerate(terms[k][:first_terms])], "_l int, language string, _t int, term string")
    tails = spark.createDataFrame([(0, "")] + ([(1, f" inurl:{footprint}")] if footprint else []), "_f int, _tail string")
    rows = places.select("wilaya").withColumn("_w", F.row_number().over(Window.orderBy("wilaya"))).crossJoin(F.broadcast(small)).crossJoin(F.broadcast(tails))
    made = rows.select("_l", "_w", "_t", "_f", "language", "wilaya", "term", F.concat(F.concat_ws(" ", "term", "wilaya"), F.col("_tail")).alias("query"))
    if extra:
        more = spark.createDataFrame([(len(languages), i, 0, 0, "fr", "all", "custom", q) for i, q in enumerate(extra)], made.schema)
        made = made.union(more)
    if most is not None:
        made = made.orderBy("_l", "_w", "_t", "_f").limit(most)
    return made.groupBy("query", "language").agg(F.min(F.struct("_l", "_w", "_t", "_f", "wilaya", "term")).alias("r")).select("language", "r.wilaya", "r.term", "query")


#: Where shops say how to reach them, hosts of link lists, and how a label hints at a shop.
CONTACT_PATHS = ["/contact", "/contact-us", "/pages/contact", "/a-propos", "/about", "/pages/about", "/nous-contacter", "/اتصل-بنا"]
LINK_IN_BIO_HOSTS = ["linktr.ee", "linktree.com", "bio.link", "taplink.cc", "beacons.ai", "linkin.bio", "msha.ke", "lnk.bio"]
LABEL_HINTS = ["boutique", "shop", "store", "متجر", "commander", "boutique en ligne", "paiement", "livraison", "cash on delivery", "cod", "الدفع عند الاستلام", "watch", "parfum"]
MOST_INTERNAL, MOST_BIO, FOLLOWED = 40, 3, 3


def crawl_targets(url: str, html: str | None) -> dict[str, list]:
    """Where a page leads: ``socials (network, value)``, ``bios`` and ``internal`` pages of the same registrable host, in order, each once."""
    socials, bios, internal = {}, {}, {}
    for href, *_ in U.parsed(html).links:
        to = U.canonical_url(href, url)
        if to is None:
            continue
        host, found = urlsplit(to).hostname, U.handle(to)
        if found and found[0] not in ("whatsapp", "messenger"):
            socials[found[0], found[1].removeprefix("page_id:")] = None
        elif any(h in host for h in LINK_IN_BIO_HOSTS):
            bios[to] = None
        elif U.same_registrable(to, url):
            internal[to] = None
    return {"socials": [{"network": n, "value": v} for n, v in socials], "bios": list(bios)[:MOST_BIO], "internal": list(internal)[:MOST_INTERNAL]}


TARGETS = T.StructType([T.StructField("socials", HANDLES), T.StructField("bios", T.ArrayType(T.StringType())), T.StructField("internal", T.ArrayType(T.StringType()))])


@F.pandas_udf(TARGETS)
def crawl_targets_udf(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([crawl_targets(u, h) for u, h in zip(url, html, strict=True)], columns=["socials", "bios", "internal"])


def crawl(start: DataFrame, pages: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(url, depth)`` of the pages visited, breadth first, and the ``(url, network, value, depth)`` of profiles found there.

    ``pages (url, html)`` are what fetching has brought. From a start page the crawl goes on to
    three contact paths, three internal pages, the sitemap and its link lists; from further
    pages to nothing more. One join for each level: nothing is walked page by page.
    """
    held = stage(pages.select(U.canonical_url_udf("url").alias("url"), "html").filter("url is not null").dropDuplicates(["url"]).withColumn("t", crawl_targets_udf("url", "html")).select("url", "t.*"), "crawl-pages")
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    base = F.regexp_replace("url", "/$", "")
    paths = F.transform(F.array(*map(F.lit, CONTACT_PATHS[:FOLLOWED])), lambda p: F.concat(base, p))
    front = start.select(U.canonical_url_udf("url").alias("url")).filter("url is not null").distinct().withColumn("depth", F.lit(0))
    seen, visited = front, front.join(held, "url")
    if depth > 0:
        onward = F.concat(paths, F.slice("internal", 1, FOLLOWED), F.array(F.concat(root, F.lit("/sitemap.xml"))), F.col("bios"))
        step = visited.select(F.explode(onward).alias("u")).select(U.canonical_url_udf("u").alias("url")).filter("url is not null").distinct()
        front = stage(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(1)), "crawl-front")
        seen, visited = seen.union(front), visited.union(front.join(held, "url"))
    social = visited.select("url", "depth", F.explode("socials").alias("s")).select("url", "depth", "s.network", "s.value")
    first = social.groupBy("network", "value").agg(F.min(F.struct("depth", "url")).alias("f")).select("f.url", "network", "value", "f.depth")
    return seen, first


def demo_population(spark: SparkSession, size: int, seed: int = 20260101) -> DataFrame:
    """Synthetic merchants; each value depends on the row's number and the seed alone."""
    h = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), h(k, len(xs)) + 1)
    return spark.range(size).select(
        "id", F.format_string("shop-%04d.dz", "id").alias("domain"), pick("p", ["shopify", "youcan", "woocommerce", "custom"]).alias("platform"),
        pick("c", ["fashion", "beauty", "kids", "auto"]).alias("category"), F.format_string("+2135%08d", h("t", 100_000_000)).alias("phone"), (h("n", 300) + 1).alias("products"),
    )


IDENTITY_ORDER = ["domain", "etld1", "whatsapp", "phone", "email", "facebook", "instagram", "tiktok", "handle"]


def upsert_candidates(spark: SparkSession, candidates: DataFrame, known: DataFrame | None) -> DataFrame:
    """``(seq, lead_id, is_new)``: candidates in order of ``seq`` meet leads by their identities.

    ``candidates (seq, identities array<struct<type,value>>)``, ``known (lead_id, type, value)``.
    A candidate joins the lead of its first known identity, in identity order, and brings along
    the identities that nobody has; else it makes a lead, named by its ``seq``. What one candidate
    brings the next ones meet, so the order matters: candidates that share no identity, even by way
    of others, don't touch, and each such component is folded by itself. Those without identities are skipped.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, IDENTITY_ORDER)), F.col("i.type")), F.lit(99))
    rows = candidates.select("seq", F.posexplode("identities").alias("n", "i")).select("seq", (place * 1000 + F.col("n")).alias("ord"), F.concat_ws(":", "i.type", "i.value").alias("ident"))
    rows = stage(rows.withColumn("node", F.xxhash64("ident")), "upsert-identities")
    first = rows.groupBy("seq").agg(F.min("node").alias("hub"))
    links = rows.join(first, "seq").select("node", "hub")
    old = known.select("lead_id", F.concat_ws(":", "type", "value").alias("ident")) if known is not None else spark.createDataFrame([], "lead_id long, ident string")
    old = old.withColumn("node", F.xxhash64("ident"))
    least = old.groupBy("lead_id").agg(F.min("node").alias("hub"))
    roots = connected_components(links.union(old.join(least, "lead_id").select("node", "hub")), "node", "hub")
    root = F.coalesce("root", "node").alias("component")
    mine = rows.join(roots, "node", "left").select(root, F.lit(1).alias("kind"), "seq", "ord", "ident", F.lit(None).cast("long").alias("lead_id"))
    theirs = old.join(roots, "node", "left").select(root, F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("ord"), "ident", "lead_id")
    every = mine.unionByName(theirs.join(mine.select("component").distinct(), "component", "left_semi"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        owner = {r.ident: int(r.lead_id) for r in group[group.kind == 0].sort_values("lead_id", ascending=False).itertuples()}
        out = []
        for seq, own in group[group.kind == 1].sort_values(["seq", "ord"]).groupby("seq"):
            lead = next((owner[i] for i in own.ident if i in owner), None)
            out.append((int(seq), int(seq) if lead is None else lead, lead is None))
            for i in own.ident:
                owner.setdefault(i, out[-1][1])
        return pd.DataFrame(out, columns=["seq", "lead_id", "is_new"])

    return every.groupBy("component").applyInPandas(fold, "seq long, lead_id long, is_new boolean")


#: Shape of a candidate.
CANDIDATE = "url string, name string, phones array<string>, emails array<string>, handles array<struct<network:string,value:string>>"
#: How sure an identity is, by its type.
IDENTITY_CONFIDENCE = {"domain": 0.85, "etld1": 0.6, "phone": 0.9, "email": 0.9, "handle": 0.8}


@F.pandas_udf(T.StringType())
def registrable_udf(s: pd.Series) -> pd.Series:
    return s.map(U.registrable, na_action="ignore")


def identities(candidates: DataFrame) -> Column:
    """A candidate's identities ``(type, value, confidence)``, in order: host, registrable host, phones (mobile ones as
    ``whatsapp``), e-mails, handles by network."""
    host = U.host_of(U.canonical_url_udf("url"))
    has = set(candidates.columns)
    one = lambda kind, value, sure: F.struct(kind.alias("type") if isinstance(kind, Column) else F.lit(kind).alias("type"), F.lower(value).alias("value"), F.lit(IDENTITY_CONFIDENCE[sure]).alias("confidence"))
    none = F.array().cast("array<struct<type:string,value:string,confidence:double>>")
    parts = [F.when(host.isNotNull(), F.array(one("domain", host, "domain"), one("etld1", registrable_udf(host), "etld1")))] if "url" in has else []
    if "phones" in has:
        mobile = lambda p: F.when(p.rlike(r"^\+213[567]"), "whatsapp").otherwise("phone")
        parts.append(F.transform(F.filter(F.transform("phones", lambda p: U.phone(p)), lambda p: p.isNotNull()), lambda p: one(mobile(p), p, "phone")))
    if "emails" in has:
        parts.append(F.transform("emails", lambda e: one("email", e, "email")))
    if "handles" in has:
        parts.append(F.transform("handles", lambda h: one(h["network"], h["value"], "handle")))
    return F.concat(*(F.coalesce(p, none) for p in parts))


def ingest(spark: SparkSession, candidates: DataFrame, known: DataFrame | None, source_id: str, now: str) -> dict[str, DataFrame]:
    """What ``candidates (seq, url, name, phones, emails, handles, annotations map<string,boolean>)`` of a source change.

    ``leads (seq, lead_id, is_new)``, ``observations (lead_id, key, value, confidence, source, observed_at)`` and ``audit``:
    an observation for each identity, for the URL, and for each annotation; those without identities are skipped.
    """
    rows = candidates.withColumn("identities", identities(candidates)).filter(F.size("identities") > 0)
    rows = stage(rows, "ingest-candidates")
    plain = F.transform("identities", lambda i: F.struct(i["type"].alias("type"), i["value"].alias("value")))
    leads = stage(upsert_candidates(spark, rows.select("seq", plain.alias("identities")), known), "ingest-leads")
    at = F.lit(now).cast("timestamp_ntz")
    note = lambda key, value, sure: F.struct(key.alias("key"), value.cast("string").alias("value"), F.lit(float(sure)).alias("confidence"))
    flags = F.col("annotations") if "annotations" in rows.columns else F.lit(None).cast("map<string,boolean>")
    named = F.transform(F.coalesce(F.map_entries(flags), F.array().cast("array<struct<key:string,value:boolean>>")), lambda e: note(F.when(e["key"] == "is_advertiser", "advertiser:flag").otherwise(F.concat(F.lit("annotation:"), e["key"])), e["value"], 0.9))
    seen = F.when(F.coalesce(flags["is_advertiser"], F.lit(False)), F.array(note(F.lit("advertiser:first_seen"), at, 0.9)))
    url = F.when(F.col("url").isNotNull(), F.array(note(F.lit("url:primary"), F.col("url"), 0.95)))
    none = F.array().cast("array<struct<key:string,value:string,confidence:double>>")
    own = F.transform("identities", lambda i: F.struct(F.concat(F.lit("identity:"), i["type"]).alias("key"), i["value"].alias("value"), i["confidence"].alias("confidence")))
    every = F.concat(own, F.coalesce(url, none), F.filter(named, lambda n: n["value"].isNotNull()), F.coalesce(seen, none))
    facts = rows.select("seq", F.explode(every).alias("o")).join(leads.select("seq", "lead_id"), "seq")
    return {
        "leads": leads,
        "observations": facts.select("lead_id", "o.*", F.lit(source_id).alias("source"), at.alias("observed_at")),
        "audit": leads.select(F.lit("engine").alias("actor"), F.lit("ingest").alias("action"), "lead_id", F.to_json(F.struct(F.lit(source_id).alias("source"), "seq")).alias("detail"), at.alias("at")),
    }


#: The sources by name: what reads each, whether it needs a network, and what a call costs.
REGISTRY = {
    "manual_paste": (pasted, False, 0), "manual_add": (added, False, 0), "social_paste": (social_pasted, False, 0), "csv_import": (csv_imported, False, 0), "ad_library_manual": (ad_library_pasted, False, 0),
    "directory_import": (directory_links, True, 1), "web_search": (search_results, True, 1), "google_places": (places, True, 1), "meta_ad_library": (ad_library, True, 1),
    "site_crawl_expansion": (crawl, True, 1), "demo_seed": (demo_population, False, 0),
}


def source(name: str):
    if name not in REGISTRY:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name][0]


def described(off: tuple[str, ...] = ("meta_ad_library",)) -> list[str]:
    """A line for each source; those in ``off`` have to be asked for."""
    return [f"{n} {'net' if net else 'off'} cost={cost} {'disabled' if n in off else 'enabled'}" for n, (_, net, cost) in REGISTRY.items()]
