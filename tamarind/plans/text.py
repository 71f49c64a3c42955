"""Text, web, resolution and messaging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarind.functions import messaging as M
from tamarind.functions import text as X
from tamarind.functions import web as U
from tamarind.operators import calibration, resolve
from tamarind.plans import tables as T
from tamarind.plans.tables import KEY_SQL
from tamarind.sources import readers

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, md5({KEY_SQL.format('text')}) AS key_md5 FROM documents")
def match_key(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.md5(X.match_key_of("text").cast("binary")).alias("key_md5"))


@query(f"SELECT doc_id, len(list_filter(string_split({KEY_SQL.format('text')}, ' '), lambda t: length(t) > 1 OR regexp_matches(t, '[0-9]'))) AS tokens FROM documents")
def tokens(spark, d):
    rows = T.read(spark, d, "documents").select("doc_id", X.match_key_of("text").alias("key"))
    return rows.select("doc_id", F.size(X.token_list(F.col("key"))).cast("long").alias("tokens"))


@query(r"""SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) / greatest(1, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g'))), 6) AS latin FROM documents""")
def language_shares(spark, d):
    _, latin = X.script_shares(F.col("text"))
    return T.read(spark, d, "documents").select("doc_id", F.round(latin, 6).alias("latin"))


_TRACK = " OR ".join(["starts_with(lower(p), 'utm_')", *(f"starts_with(lower(p), '{k}=')" for k in U.TRACKING)])


@query(rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) AS s, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS h,
regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT ({_TRACK}))) AS q FROM pages)
SELECT page_id, s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p""")
def canonical_url(spark, d):
    return T.read(spark, d, "pages").select("page_id", U.canonical_url_udf("url").alias("canonical"))


@query(r"""SELECT page_id, substr(sha256(url), 1, 24) AS hash, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages""")
def url_identity(spark, d):
    return T.read(spark, d, "pages").select("page_id", U.url_hash(F.col("url")).alias("hash"), U.host_of(F.col("url")).alias("host"))


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{U.EMAIL_PATTERN}'), lambda e: lower(e)),
lambda e: NOT ends_with(e, 'example.com') AND NOT contains(e, 'sentry') AND NOT starts_with(e, 'noreply@')))), ' ') AS emails FROM documents""")
def email_extract(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(U.emails_in(F.col("text"))), " ").alias("emails"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'https?://[^ \t\n\x0B\f\r<>"'']+'))), ' ') AS urls FROM documents""")
def url_extract(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(U.urls_in(F.col("text"))), " ").alias("urls"))


@query("SELECT page_id, len(regexp_extract_all(html, '<h1[ >]')) AS h1, len(regexp_extract_all(html, '<a [^>]*href=')) AS anchors FROM pages")
def anchor_counts(spark, d):
    html = F.col("html")
    return T.read(spark, d, "pages").select("page_id", F.regexp_count(html, F.lit("<h1[ >]")).cast("long").alias("h1"), F.size(U.anchors_udf(html)).cast("long").alias("anchors"))


@query()
def html_headings(spark, d):
    """Each page's text corpus: its length, and the first line."""
    rows = T.read(spark, d, "pages").select("page_id", U.text_corpus_udf("html").alias("corpus"))
    return rows.select("page_id", F.length("corpus").alias("n_chars"), F.split("corpus", "\n")[0].alias("title"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def json_props(spark, d):
    return T.read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def _names(spark, d):
    n = T.read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return n.withColumn("t", F.split("name", " "))


SIM = "2.0 * len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t)), 0.95 * len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name, list_distinct(string_split(p_name, ' ')) AS t FROM part)
SELECT a.name AS a, b.name AS b, round(greatest({SIM}), 6) AS similarity FROM n a JOIN n b ON a.name < b.name WHERE len(list_intersect(a.t, b.t)) > 0""")
def token_set_similarity(spark, d):
    """Names that share a word, joined on the word."""
    n = _names(spark, d)
    words = n.select("name", "t", F.explode(F.array_distinct("t")).alias("w"))
    a, b = (words.select(F.col("name").alias(x), F.col("t").alias(f"t_{x}"), "w") for x in "ab")
    pairs = a.join(b, "w").filter("a < b").drop("w").distinct()
    return pairs.select("a", "b", F.round(X.token_set_similarity(F.col("t_a"), F.col("t_b")), 6).alias("similarity"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name, list_distinct(string_split(p_name, ' ')) AS t FROM part)
SELECT a.name AS a, b.name AS b, jaro_winkler_similarity(a.name, b.name) >= 0.9 AS agree FROM n a JOIN n b ON a.name < b.name WHERE len(list_intersect(a.t, b.t)) > 0""")
def jaro_winkler_agree(spark, d):
    pairs = token_set_similarity(spark, d)
    return pairs.select("a", "b", (X.jaro_winkler_udf("a", "b") >= 0.9).alias("agree"))


RECORDS = """SELECT c_custkey AS id, c_name AS name, 'shop' || (c_custkey % (SELECT greatest(1, count(*) // 2) FROM customer)) || '.dz' AS domain,
CASE WHEN c_custkey % 3 > 0 THEN '+2135' || lpad((c_custkey % (SELECT greatest(1, count(*) // 4) FROM customer))::VARCHAR, 8, '0') END AS phone, c_nationkey::VARCHAR AS wilaya, c_mktsegment AS category FROM customer"""


def records(spark, d):
    """Customers as records: pairs share a made-up domain, some of fours a telephone number."""
    c = T.read(spark, d, "customer")
    n = c.count()
    half, quarter = max(1, n // 2), max(1, n // 4)
    phone = F.concat(F.lit("+2135"), F.lpad((F.col("c_custkey") % quarter).cast("string"), 8, "0"))
    none = F.array().cast("array<string>")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("shop"), F.col("c_custkey") % half, F.lit(".dz")).alias("domain"),
        F.when(F.col("c_custkey") % 3 > 0, F.array(phone)).otherwise(none).alias("phones"), none.alias("emails"), none.alias("handles"),
        F.col("c_nationkey").cast("string").alias("wilaya"), F.col("c_mktsegment").alias("category"),
    )


BLOCKS = f"SELECT id, 'domain:' || domain AS block FROM ({RECORDS}) UNION SELECT id, 'phone:' || phone FROM ({RECORDS}) WHERE phone IS NOT NULL UNION SELECT id, 'token:' || lower(name) FROM ({RECORDS})"
PAIRS = f"""SELECT a.id AS left_id, b.id AS right_id, string_agg(DISTINCT block, ' ' ORDER BY block) AS blockers FROM ({BLOCKS}) a JOIN ({BLOCKS}) b USING (block)
WHERE a.id < b.id AND block IN (SELECT block FROM ({BLOCKS}) GROUP BY block HAVING count(*) BETWEEN 2 AND 400) GROUP BY ALL"""


@query(PAIRS)
def blocking_pairs(spark, d):
    ready = resolve.prepared(records(spark, d))
    return resolve.candidate_pairs(resolve.block_keys(ready)).withColumn("blockers", F.array_join("blockers", " "))


def _w(field, agrees, given="true"):
    yes, no = resolve.weights(field)
    return f"CASE WHEN {given} THEN CASE WHEN {agrees} THEN {yes!r}::DOUBLE ELSE {no!r}::DOUBLE END ELSE 0 END"


_KEYED = "replace(lower({0}.name), '#', ' ')"
_NAME = f"jaro_winkler_similarity({_KEYED.format('l')}, {_KEYED.format('r')}) >= 0.9"
_PHONES = "l.phone IS NOT NULL AND r.phone IS NOT NULL"
FS = f"""WITH w AS (SELECT left_id, right_id, {_w('domain', 'l.domain = r.domain')} + {_w('phone', 'l.phone = r.phone', _PHONES)} + {_w('whatsapp', 'false', _PHONES)} + {_w('name', _NAME)}
+ CASE WHEN NOT ({_NAME}) AND (l.domain = r.domain OR coalesce(l.phone = r.phone, false)) THEN {max(-1.2, resolve.weights('name')[1] / 3)!r} ELSE 0 END + {_w('wilaya', 'l.wilaya = r.wilaya')} + {_w('category', 'l.category = r.category')} AS w,
l.domain <> r.domain OR ({_PHONES} AND l.phone <> r.phone) AS conflicting FROM ({PAIRS}) p JOIN ({RECORDS}) l ON l.id = left_id JOIN ({RECORDS}) r ON r.id = right_id),
q AS (SELECT *, 1 / (1 + exp(-(ln(0.05 / 0.95) + w * ln(2)))) AS p FROM w)
SELECT left_id, right_id, round(w, 6) AS weight, round(p, 6) AS posterior, conflicting, CASE WHEN p >= 0.97 AND NOT conflicting THEN 'auto_merge' WHEN p >= 0.6 THEN 'review' ELSE 'distinct' END AS decision FROM q"""


@query(FS)
def fs_decisions(spark, d):
    ready = resolve.prepared(records(spark, d))
    made = resolve.decide(resolve.candidate_pairs(resolve.block_keys(ready)), ready)
    return made.select("left_id", "right_id", F.round("weight", 6).alias("weight"), F.round("posterior", 6).alias("posterior"), "conflicting", "decision")


@query(f"""WITH RECURSIVE m AS MATERIALIZED (SELECT left_id AS a, right_id AS b FROM ({FS}) WHERE decision = 'auto_merge'), e AS MATERIALIZED (SELECT a, b FROM m UNION SELECT b, a FROM m),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen) SELECT id, min(seen) AS cluster_id FROM r GROUP BY id""")
def er_clusters(spark, d):
    return resolve.resolve(records(spark, d))[1]


@query(f"""WITH p AS (SELECT left_id, right_id FROM ({FS}) WHERE decision = 'auto_merge'), t AS (SELECT a.id AS left_id, b.id AS right_id FROM ({RECORDS}) a JOIN ({RECORDS}) b ON a.domain = b.domain AND a.id < b.id),
n AS (SELECT (SELECT count(*) FROM p SEMI JOIN t USING (left_id, right_id)) AS tp, (SELECT count(*) FROM p ANTI JOIN t USING (left_id, right_id)) AS fp, (SELECT count(*) FROM t ANTI JOIN p USING (left_id, right_id)) AS fn)
SELECT tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall FROM n""")
def er_precision_recall(spark, d):
    own = records(spark, d)
    made, _ = resolve.resolve(own)
    a, b = own.select("domain", F.col("id").alias("left_id")), own.select("domain", F.col("id").alias("right_id"))
    truth = a.join(b, "domain").filter("left_id < right_id")
    found = calibration.pair_quality(made.filter("decision = 'auto_merge'"), truth)
    return found.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(r"""SELECT conv_id, turn, text, len(regexp_extract_all(text, '[?？؟]')) AS questions, length(text) > 450 AS too_long,
turn = 0 AND regexp_matches(text, '(?i)https?://|www\.|wa\.me|bit\.ly|\.dz\b') AS has_url, len(regexp_extract_all(text, '\{[A-Za-z_]+\}')) > 0 AS unresolved FROM conversations""")
def message_lint(spark, d):
    c = T.read(spark, d, "conversations").select("conv_id", "turn", "text", X.match_key_of("text").alias("key"))
    errors, _ = M.lint(F.col("text"), F.col("key"), F.col("turn") == 0)
    has = lambda e: F.coalesce(F.array_contains("errors", e), F.lit(False))
    rows = c.withColumn("errors", errors)
    return rows.select("conv_id", "turn", "text", M.questions(F.col("text")).cast("long").alias("questions"), has("message too long").alias("too_long"), has("URL in first contact").alias("has_url"), has("unresolved slots").alias("unresolved"))


@query("SELECT id, 'Hello ' || name || ', we ship to ' || wilaya || ' {later}' AS body FROM (" + T.LEADS_SQL + ")")
def slot_render(spark, d):
    body = M.render(F.lit("Hello {name}, we ship to {Wilaya} {later}"), {"name": F.col("name"), "wilaya": F.col("wilaya")})
    return T.leads(spark, d).select("id", body.alias("body"))


@query("SELECT id, 'https://wa.me/2135' || lpad((id % 100000000)::VARCHAR, 8, '0') || '?text=Hello%20(' || replace(name, '#', '%23') || ')!%20it''s%20~' || id || '*' AS link FROM (" + T.LEADS_SQL + ")")
def wa_link(spark, d):
    phone = F.concat(F.lit("+2135"), F.lpad((F.col("id") % 100_000_000).cast("string"), 8, "0"))
    text = F.concat(F.lit("Hello ("), F.col("name"), F.lit(")! it's ~"), F.col("id").cast("string"), F.lit("*"))
    return T.leads(spark, d).select("id", M.wa_link(phone, text).alias("link"))


@query("SELECT id, '+2135' || lpad((id % 100000000)::VARCHAR, 8, '0') AS phone, CASE WHEN id % 2 = 0 THEN '+2135' || lpad((id % 100000000)::VARCHAR, 8, '0') END AS mobile FROM (" + T.LEADS_SQL + ")")
def phone_normalise(spark, d):
    digits = F.lpad((F.col("id") % 100_000_000).cast("string"), 8, "0")
    spelled = F.when(F.col("id") % 3 == 0, F.concat(F.lit("00213 5"), digits)).when(F.col("id") % 3 == 1, F.concat(F.lit("+213-5"), digits)).otherwise(F.concat(F.lit("05"), F.regexp_replace(digits, "(..)", "$1.")))
    fixed = F.concat(F.lit("021"), F.substring(digits, 1, 6))
    rows = T.leads(spark, d).select("id", U.phone(spelled).alias("phone"), U.phone(F.when(F.col("id") % 2 == 0, spelled).otherwise(fixed), mobile=True).alias("mobile"))
    return rows


@query("""SELECT l || ' ' || v || ' ' || w AS query, l AS language FROM (VALUES ('fr'), ('ar')) a(l), (VALUES ('vetements'), ('parfum'), ('telephone')) b(v), (SELECT n_name AS w FROM nation)""")
def query_cross_product(spark, d):
    places = T.read(spark, d, "nation").select(F.col("n_name").alias("wilaya"))
    made = readers.generate_queries(spark, ["fr", "ar"], places, {"fr": ["vetements", "parfum", "telephone"], "ar": ["vetements", "parfum", "telephone"]})
    return made.select(F.concat_ws(" ", "language", "term", "wilaya").alias("query"), "language")


@query("SELECT domain, min(id) AS id, count(*) AS n FROM (" + RECORDS + ") GROUP BY domain")
def upsert_leads(spark, d):
    """Customers as candidates of an empty store: the first of a domain makes the lead."""
    cand = records(spark, d).select(F.col("id").alias("seq"), F.array(F.struct(F.lit("domain").alias("type"), F.col("domain").alias("value"))).alias("identities"))
    done = readers.upsert_candidates(spark, cand, None)
    held = done.select("seq", "lead_id").join(records(spark, d).select(F.col("id").alias("seq"), "domain"), "seq")
    return held.groupBy("domain").agg(F.min("lead_id").alias("id"), F.count("*").alias("n"))
