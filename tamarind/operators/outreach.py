"""From pages and scores to a ranked work queue with drafted messages, and what outcomes change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.functions import fingerprints as P
from tamarind.functions import hashing as H
from tamarind.functions import numeric as N
from tamarind.functions import text as X
from tamarind.functions import web as U
from tamarind.functions.lexicons import WILAYAS
from tamarind.operators import evidence, ranking, templates
from tamarind.operators.temporal import OUTCOME_STATE
from tamarind.session import stage

def site_facts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", headers: str | None = None, catalog: str | None = None, now: Column | None = None) -> DataFrame:
    """One row of facts for each page: platform, ad scripts, contacts, language, market, catalogue, category and maturity.

    Python parses a page once (text, contacts); all rules run as expressions. ``catalog`` names a
    column as ``web.merged_catalog`` makes it, of what was found beside the page.
    """
    rules, names = P.platform_rules()
    look = {"html": F.col(html), "url": F.col(url)}
    for n in names:
        look[f"header:{n}"] = F.coalesce(F.col(headers)[n], F.lit("")) if headers else F.lit("")
    hits = evidence.rule_hits(pages, key, rules, look)
    platform = evidence.fuse_platform(hits, key, pages.select(key)).select(key, "platform", F.col("probability").alias("platform_probability"))
    ads = F.filter(F.array(*(F.when(F.col(html).rlike(f"(?i){p}"), F.lit(i)) for i, p, _ in P.AD_RULES)), lambda x: x.isNotNull())
    server = F.array(*(F.lit(i) for i, _, s in P.AD_RULES if s))
    shown = U.html_catalog(F.col(html))
    has = lambda p: F.coalesce(F.col(html).rlike(f"(?i){p}"), F.lit(False))
    rows = pages.select(
        key, U.canonical_url_udf(url).alias("canonical"), ads.alias("ad_tech"), U.page_udf(html).alias("_page"), has(P.CART).alias("cart"), has(P.CHECKOUT).alias("checkout"),
        U.merged_catalog({"html": shown}).alias("_shown"), *([F.col(catalog).alias("_catalog")] if catalog else []),
    )
    field = lambda c: F.coalesce(F.col(f"_catalog.{c}"), F.col(f"_shown.{c}")) if catalog else F.col(f"_shown.{c}")
    rows = rows.select("*", F.col("_page.corpus").alias("corpus"), F.col("_page.contacts").alias("contacts"), field("product_count").alias("products"), field("median_price").alias("median_price"), field("latest").alias("latest"))
    rows = rows.withColumn("key", X.match_key_of("corpus"))
    rows = X.with_language(rows, "corpus", "key").withColumns(
        {
            "cod_weight": P.cod_weight(F.col("key")), "currency": P.currency_of(F.col("corpus")), "wilayas": evidence.wilayas_in(F.col("key")),
            "server_side": F.arrays_overlap("ad_tech", server), "pixels": F.size(F.array_except("ad_tech", server)), "channels": F.array_distinct(F.transform("contacts", lambda c: c["kind"])),
            "phones": F.greatest(F.size(F.filter("contacts", lambda c: c["kind"].isin("phone", "whatsapp"))), F.size(U.phones_in(F.col("corpus")))),
            "dz_host": F.coalesce(F.endswith(U.host_of(F.col("canonical")), F.lit(".dz")), F.lit(False)),
        }
    )
    here, sells = evidence.market(
        {
            "dz_host": F.col("dz_host"), "cod_weight": F.col("cod_weight"), "dzd": F.coalesce(F.col("currency") == "DZD", F.lit(False)), "wilayas": F.size("wilayas"), "phones": F.col("phones"),
            "language": F.col("language"), "products": F.coalesce("products", F.lit(0)), "cart": F.col("cart"), "checkout": F.col("checkout"), "prices": F.col("median_price").isNotNull(),
        }
    )
    words = F.concat_ws(" ", "key", X.match_key_of(F.regexp_replace("canonical", "[-/.]", " ")))
    rows = evidence.categories(rows.withColumns({"p_market": here, "p_sells": sells, "_words": words}), evidence.lexicon_hits(F.col("_words")))
    rows = rows.join(platform, key).withColumn("products", F.col("products").cast("int"))
    fresh = U.freshness_days(F.col("latest"), now) if now is not None else F.lit(None).cast("double")
    rows = rows.withColumn("maturity", evidence.maturity(F.col("products"), fresh, F.col("pixels"), F.col("server_side"), F.size("channels"), F.col("platform")))
    return rows.select(
        key, "canonical", "platform", "platform_probability", "ad_tech", "pixels", "server_side", "contacts", "channels", "language", "cod_weight", "currency", "wilayas", "phones", "dz_host",
        "cart", "checkout", "products", "median_price", "p_market", "p_sells", "category", F.col("probability").alias("category_probability"), F.col("abstained").alias("category_abstained"),
        "maturity", F.length("corpus").alias("n_chars"),
    )


def signals(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, name, value, confidence)``: the facts as observations, one row each; what isn't known makes none."""
    row = lambda name, value, sure: F.struct(name.alias("name") if isinstance(name, Column) else F.lit(name).alias("name"), value.cast("string").alias("value"), N.clamp(sure, 0.0, 1.0).alias("confidence"))
    only = lambda test, made: F.when(F.coalesce(test, F.lit(False)), made)
    server = F.array(*(F.lit(i) for i, _, s in P.AD_RULES if s))
    places = F.size("wilayas")
    single = F.array(
        row(F.concat(F.lit("platform:"), "platform"), F.col("platform"), F.col("platform_probability")),
        only(F.col("cod_weight") > 0, row("market:cod", F.col("cod_weight"), F.col("p_market"))),
        only(F.col("currency") == "DZD", row("market:currency", F.col("currency"), F.lit(1.0))),
        only(places > 0, row("market:wilaya_coverage", places, F.least(F.lit(0.95), places / len(WILAYAS) * 3))),
        only(F.col("dz_host"), row("market:dz_tld", U.host_of(F.col("canonical")), F.lit(0.9))),
        row("market:p_market", F.round("p_market", 4), F.col("p_market")),
        only(F.col("products").isNotNull(), row("catalog:product_count", F.col("products"), F.lit(0.95))),
        only(F.col("median_price").isNotNull(), row("catalog:median_price", F.round("median_price").cast("long"), F.lit(0.8))),
        row(F.concat(F.lit("category:"), "category"), F.col("category"), F.col("category_probability")),
        row("language:dominant", F.col("language"), F.lit(0.8)),
        row("maturity:index", F.col("maturity"), F.lit(0.8)),
    )
    ways = F.transform("contacts", lambda c: row(F.concat(F.lit("contact:"), c["kind"]), c["value"], c["confidence"]))
    ads = F.transform("ad_tech", lambda a: row(F.concat(F.lit("adtech:"), a), a, F.when(F.array_contains(server, a), 0.8).otherwise(0.9)))
    every = F.filter(F.concat(single, ways, ads), lambda s: s.isNotNull())
    return facts.select(key, F.explode(every).alias("s")).select(key, "s.*").dropDuplicates([key, "name", "value"])


def qualified(facts: DataFrame, suppressed: Column, customer: Column, policy_ok: Column, floor: float = 0.0) -> DataFrame:
    """Adds ``qualified`` and ``reasons`` to site facts."""
    ok, why = evidence.gates(
        {"channels": F.col("channels"), "p_market": F.col("p_market"), "p_sells": F.col("p_sells"), "suppressed": suppressed, "customer": customer, "policy_ok": policy_ok, "maturity": F.col("maturity")}, floor
    )
    return facts.withColumns({"qualified": ok, "reasons": why})


#: How a platform is called, and what a category's goods are called, in messages.
PRODUCT_LABELS = {
    "fashion": "الملابس", "shoes": "الأحذية", "beauty": "العطور ومستحضرات التجميل", "phones_accessories": "أكسسوارات الهاتف", "electronics": "الإلكترونيات",
    "home_kitchen": "مستلزمات المنزل والمطبخ", "kids": "منتجات الأطفال", "auto": "أكسسوارات السيارات", "health_supplements": "المكملات الغذائية",
    "jewelry_watches": "المجوهرات والساعات", "other": "منتجك",
}


def product_label(category: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in PRODUCT_LABELS.items() for x in kv))
    return F.coalesce(labels[F.coalesce(category, F.lit("other"))], F.lit("منتجاتك"))


def work_queue(leads: DataFrame, n: int, weight: float = 0.75, variants: DataFrame | None = None, day: str = "2026-01-01") -> DataFrame:
    """The day's queue: a diverse batch of scored leads, each with template, variant, message and link, by rank.

    ``leads (id, name, score, sampled_p, platform, category, wilaya, channel, target, advertiser, products, language, has_whatsapp)``;
    with ``first`` (false: a follow-up) and ``policy`` (a policy code) where they are known: ``sendable`` then asks for ``ok``.
    """
    spark = leads.sparkSession
    leads = stage(leads, "queue-leads")  # scored once; the batch, its rest and its drafts all read it
    batch = ranking.daily_batch(leads, n, weight=weight)  # n rows: fits a broadcast
    chosen = leads.join(F.broadcast(batch), "id")
    first = F.col("first") if "first" in leads.columns else F.lit(True)
    template = templates.template_of(F.col("channel"), F.col("has_whatsapp"), F.col("advertiser"), F.col("platform"), F.col("products"), first)
    chosen = chosen.withColumns({"template_id": template, "product": product_label(F.col("category")), "platform_label": F.initcap("platform"), "_key": F.concat_ws(":", "id", F.lit(day))})
    picked = templates.choose_variants(chosen, templates.template_rows(spark) if variants is None else variants, "_key").drop("_key")
    made = templates.draft(picked, first)
    if "policy" in leads.columns:
        made = made.withColumn("sendable", F.col("sendable") & (F.col("policy") == "ok"))
    return made.withColumn("link", templates.outreach_link(F.col("channel"), F.col("target"), F.col("body"))).orderBy("rank")


def after_outcomes(outcomes: DataFrame, identities: DataFrame) -> dict[str, DataFrame]:
    """What a batch of outcomes ``(id, lead_id, stage, variant_id, channel, occurred_at)`` changes, as one frame for each relation."""
    ended = outcomes.filter(F.col("stage").isin("stop", "not_interested", "reported"))
    who = ended.select("lead_id", F.col("stage").alias("reason")).groupBy("lead_id").agg(F.min("reason").alias("reason"))
    leads = who.select(F.lit("lead").alias("type"), F.col("lead_id").cast("string").alias("value"), "reason")
    contacts = who.join(identities.filter(F.col("type").isin("phone", "email")), "lead_id").select("type", "value", "reason")
    wanted = F.create_map(*(F.lit(x) for kv in OUTCOME_STATE.items() for x in kv))
    positive = F.col("stage").isin("replied", "interested", "signed_up", "activated", "paid")
    return {
        "suppression": leads.union(contacts).distinct(),
        "variants": outcomes.filter("variant_id is not null").groupBy("variant_id").agg(F.count("*").alias("sends"), F.count_if(positive).alias("replies")),
        "targets": outcomes.select("id", "lead_id", wanted[F.col("stage")].alias("state")).filter("state is not null"),
        "throttle": outcomes.filter(F.col("stage").isin("blocked", "reported")).agg((F.max("occurred_at") + F.expr("INTERVAL '7' DAY")).alias("throttle_until")),
        "audit": outcomes.select("lead_id", F.lit("outcome").alias("action"), F.to_json(F.struct("id", "stage")).alias("detail"), F.col("occurred_at").alias("at")),
    }


def model_row(version_day: str, names: list[str], fit, metrics: dict, least: int = 30, calibrated_from: int = 200) -> dict:
    """A model version: below ``least`` rows the prior's means serve instead of the fit."""
    cold = fit is None or fit.rows < least
    beta = [m for _, m, _ in evidence.FEATURES] if cold else [float(b) for b in fit.beta]
    cov = [[(sd * sd if i == j else 0.0) for j in range(len(names))] for i, (_, _, sd) in enumerate(evidence.FEATURES[: len(names)])] if cold else fit.covariance.tolist()
    rows = 0 if fit is None else fit.rows
    return {"version": "reply-logistic-prior-v1" if cold else f"reply-logistic-{version_day}", "weights": dict(zip(names, beta, strict=False)), "covariance": cov, "n_observations": rows, "metrics": metrics, "calibrated": rows >= calibrated_from}


def simulate(sends: int = 1000, merchants: int = 400, refit: int = 50, seed: int = 20260101) -> dict:
    """Ranked against uniform outreach on synthetic merchants with hidden weights: replies, uplift and calibration."""
    import numpy as np

    rng = np.random.default_rng(seed)
    names = evidence.FEATURES
    prior, sd = np.array([m for _, m, _ in names]), np.array([s for _, _, s in names])
    hidden = prior + rng.normal(0, 0.3, len(prior))
    x = np.concatenate([np.ones((merchants, 1)), (rng.random((merchants, len(names) - 1)) < 0.4).astype(float)], axis=1)
    truth = 1 / (1 + np.exp(-np.clip(x @ hidden, -10, 10)))
    beta, cov, rows, labels, wins = prior.copy(), np.diag(sd**2), [], [], {"ranked": 0, "uniform": 0}
    said, was = [], []
    for k in range(sends):
        spread = np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", x, cov, x)))
        p = 1 / (1 + np.exp(-(x @ beta) / np.sqrt(1 + np.pi * spread**2 / 8)))
        pick = int(np.argmax(p + spread / np.sqrt(1 + k / 30) * p * (1 - p) + rng.random(merchants) * 1e-9))
        reply = bool(rng.random() < truth[pick])
        said.append(p[pick])
        was.append(reply)
        rows.append(x[pick])
        labels.append(reply)
        wins["ranked"] += reply
        wins["uniform"] += bool(rng.random() < truth[rng.integers(merchants)])
        if (k + 1) % refit == 0:
            a, y = np.array(rows), np.array(labels, float)
            for _ in range(15):
                q = 1 / (1 + np.exp(-a @ beta))
                curve = (a * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ a + np.diag(1 / sd**2)
                cov = np.linalg.inv(curve)
                beta = beta + cov @ (a.T @ (y - q) - (beta - prior) / sd**2)
    said, was = np.array(said), np.array(was, float)
    return {"sends": sends, "ranked": wins["ranked"], "uniform": wins["uniform"], "uplift": wins["ranked"] / max(1, wins["uniform"]), "brier": float(((said - was) ** 2).mean()), "regret": float((truth.max() - truth.mean()) * sends - wins["ranked"] + truth.mean() * sends)}


#: Chances down the funnel where no segment is known.
CHAIN = {"interested": 0.45, "signed_up": 0.35, "activated": 0.6, "paid": 0.35}


def with_funnel(leads: DataFrame, posteriors: DataFrame, segment: Column) -> DataFrame:
    """Adds ``p_interested``, ``p_signed_up``, ``p_activated`` and ``p_paid`` of each lead's segment from ``(segment, stage, mean)``.

    Where the segment has no row, the stage's own row (segment null) counts, else ``CHAIN``.
    """
    means = [F.max(F.when(F.col("stage") == s, F.col("mean"))).alias(f"p_{s}") for s in CHAIN]
    by = posteriors.groupBy(F.col("segment").alias("_segment")).agg(*means)
    rows = leads.withColumn("_segment", segment).join(by.filter("_segment is not null"), "_segment", "left")
    every = by.filter("_segment is null").select(*(F.col(f"p_{s}").alias(f"_all_{s}") for s in CHAIN)).limit(1)
    one = leads.sparkSession.range(1).join(F.broadcast(every), F.lit(True), "left").drop("id")  # one row in any case
    rows = rows.crossJoin(F.broadcast(one))
    filled = {f"p_{s}": F.coalesce(f"p_{s}", f"_all_{s}", F.lit(v)) for s, v in CHAIN.items()}
    return rows.withColumns(filled).drop("_segment", *(f"_all_{s}" for s in CHAIN))


def score(leads: DataFrame, beta, covariance, rows: int, seconds: Column, version: str = "reply-logistic-prior-v1") -> DataFrame:
    """Adds ``p_reply``, ``ucb``, ``ev``, ``priority`` and ``explanation`` to leads with a feature array ``x``.

    The chain down the funnel comes from the columns that ``with_funnel`` adds, else from ``CHAIN``.
    """
    from tamarind.operators.logistic import predict

    _, variance, p = predict(F.col("x"), beta, covariance)
    c = [F.col(f"p_{s}") if f"p_{s}" in leads.columns else F.lit(v) for s, v in CHAIN.items()]
    out = leads.withColumns({"p_reply": p, "_v": variance}).withColumn("ucb", N.ucb(F.col("p_reply"), F.col("_v"), F.lit(float(rows))))
    out = out.withColumn("ev", N.expected_value(F.col("p_reply"), *c)).withColumn("priority", N.priority(F.col("ev"), seconds))
    said = F.array(
        F.concat(F.lit("P(reply)="), H.fixed(F.col("p_reply"), 3), F.lit(f" via {version}"), F.lit("" if rows else " (cold start: priors)")),
        F.concat(F.lit("UCB="), H.fixed(F.col("ucb"), 3), F.lit(", s="), H.fixed(F.sqrt("_v"), 3)),
        F.concat(F.lit("funnel: "), *(x for s, v in zip(CHAIN, c, strict=True) for x in (F.lit(f"{s}="), H.fixed(v, 2), F.lit(" ")))),
        F.concat(F.lit("EV="), H.fixed(F.col("ev"), 2), F.lit(" effort="), H.fixed(seconds, 0), F.lit("s priority="), H.fixed(F.col("priority"), 4)),
    )
    return out.withColumn("explanation", said).drop("_v")
