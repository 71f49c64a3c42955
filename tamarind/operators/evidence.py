"""Evidence fusion, platform and ad-tech rules, categories, market model, maturity, gates and features."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.functions import numeric as N
from tamarind.functions.lexicons import category_phrases, wilaya_names

#: Share of each platform, in the order that settles ties.
PLATFORM_PRIORS = {
    "shopify": 0.28, "youcan": 0.09, "woocommerce": 0.13, "wordpress": 0.04, "prestashop": 0.03, "lightfunnels": 0.06, "wix": 0.05,
    "squarespace": 0.02, "webflow": 0.02, "magento": 0.01, "salla": 0.01, "zid": 0.01, "custom": 0.17, "none": 0.08,
}
CLUSTER_CAP, CUSTOM_LEAST, WORDPRESS_PENALTY = 4.5, 2.0, -2.3
#: How sophisticated a platform is, for the maturity index.
SOPHISTICATION = {
    "shopify": 1.0, "magento": 0.95, "lightfunnels": 0.85, "woocommerce": 0.8, "youcan": 0.75, "prestashop": 0.7, "squarespace": 0.7,
    "webflow": 0.65, "wix": 0.6, "zid": 0.6, "salla": 0.6, "custom": 0.45, "wordpress": 0.35, "none": 0.2,
}
#: Prior of each category; their phrases are in ``functions.lexicons``.
CATEGORY_PRIORS = {
    "fashion": 0.26, "shoes": 0.08, "beauty": 0.17, "phones_accessories": 0.12, "electronics": 0.07, "home_kitchen": 0.1, "kids": 0.07,
    "auto": 0.03, "health_supplements": 0.05, "jewelry_watches": 0.03, "other": 0.02,
}
HIT_LOG_RATIO, HIT_CAP = 4.763681, 3


def fuse(evidence: DataFrame, key: str, priors: dict[str, float], penalties: dict[str, float] | None = None, cap: float = CLUSTER_CAP, least: float = 0.55, margin: float = 0.10, keys: DataFrame | None = None) -> DataFrame:
    """``(key, best, probability, margin, entropy, abstained, probabilities, contributions)`` from ``(key, hypothesis, log_lr, cluster)``.

    Evidence of one cluster adds up to ``cap`` at most; a softmax over the log-odds gives the
    probabilities. Hypotheses are a fixed small list, so a row per key holds them all: no
    cross product. ``keys`` adds keys without evidence.
    """
    total = sum(priors.values())
    capped = evidence.groupBy(key, "hypothesis", "cluster").agg(F.sum("log_lr").alias("s")).select(key, "hypothesis", F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("s"))).alias("s"))
    by = capped.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("hypothesis") == h, F.col("s"))), F.lit(0.0)).alias(f"_{h}") for h in priors))
    if keys is not None:
        by = keys.select(key).distinct().join(by, key, "left").fillna(0.0, [f"_{h}" for h in priors])
    start = {h: math.log(p / total / (1 - p / total)) + (penalties or {}).get(h, 0.0) for h, p in priors.items()}
    rows = by.withColumn("contributions", F.array(*(F.col(f"_{h}") for h in priors)))
    rows = rows.withColumn("probabilities", N.softmax(F.array(*(F.lit(start[h]) + F.col(f"_{h}") for h in priors))))
    ranked = F.reverse(F.array_sort("probabilities"))
    names, p = F.array(*map(F.lit, priors)), F.col("probabilities")
    entropy = -F.aggregate(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumns({"probability": ranked[0], "margin": ranked[0] - ranked[1], "entropy": entropy, "best": F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))})
    rows = rows.withColumn("abstained", (F.col("probability") < least) | (F.col("margin") < margin))
    return rows.select(key, "best", "probability", "margin", "entropy", "abstained", "probabilities", "contributions")


def fuse_platform(evidence: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """``(key, platform, probability, abstained)``: thresholds 0.50 and 0.08; ``custom`` needs markup of its own."""
    found = fuse(evidence, key, PLATFORM_PRIORS, {"wordpress": WORDPRESS_PENALTY}, least=0.50, margin=0.08, keys=keys)
    names = list(PLATFORM_PRIORS)
    custom = F.col("contributions")[names.index("custom")]
    label = F.when((F.col("best") == "custom") & (custom < CUSTOM_LEAST), "none").when(F.col("abstained") & (F.col("best") != "custom"), "none").otherwise(F.col("best"))
    at = F.array_position(F.array(*map(F.lit, names)), F.col("platform")).cast("int")
    return found.withColumn("platform", label).select(key, "platform", F.element_at("probabilities", at).alias("probability"), "abstained")


def rule_hits(pages: DataFrame, key: str, rules: list[dict], columns: dict[str, Column]) -> DataFrame:
    """``(key, rule, hypothesis, log_lr, cluster, matched)`` for rules ``{id, where, pattern, hypothesis, log_lr, cluster}``.

    Patterns are literals of one projection, compiled once; pages are scanned once and not multiplied.
    """
    tests = []
    for r in rules:
        found = F.regexp_extract(columns[r["where"]], f"(?i){r['pattern']}", 0)
        tests.append(F.when(found != "", F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["hypothesis"]).alias("hypothesis"), F.lit(float(r["log_lr"])).alias("log_lr"), F.lit(r["cluster"]).alias("cluster"), F.substring(found, 1, 120).alias("matched"))))
    return pages.select(key, F.explode(F.filter(F.array(*tests), lambda h: h.isNotNull())).alias("h")).select(key, "h.*")


def lexicon_hits(key: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """How many different phrases of each list begin or end at a space in a match key, as an array; 0 for null.

    Spark has no search for many patterns at once, and hundreds of passes over a text cost more
    than sending it to Python: an Aho-Corasick automaton finds all phrases in one pass.
    """
    lists = [[p for p in dict.fromkeys(phrases) if len(p) >= 3] for phrases in (lexicon or category_phrases()).values()]

    @F.pandas_udf("array<int>")
    def hits(keys: pd.Series) -> pd.Series:
        import ahocorasick

        owners: dict[str, list[tuple[int, int]]] = {}
        for c, phrases in enumerate(lists):
            for k, p in enumerate(phrases):
                for form in (f" {p}", f"{p} "):
                    owners.setdefault(form, []).append((c, k))
        found = ahocorasick.Automaton()
        for form, own in owners.items():
            found.add_word(form, own)
        if owners:
            found.make_automaton()

        def count(key: str | None) -> list[int]:
            seen: set[tuple[int, int]] = set()
            for _, own in found.iter(f" {key} ") if owners and key is not None else ():
                seen.update(own)
            out = [0] * len(lists)
            for c, _ in seen:
                out[c] += 1
            return out

        return keys.map(count)

    return hits(key)


def wilayas_in(key: Column) -> Column:
    """Numbers of the provinces that a match key names."""
    names = wilaya_names()
    listed = F.from_json(F.lit(json.dumps([{"n": f" {n} ", "c": c} for n, c in names.items()], ensure_ascii=False)), "array<struct<n:string,c:int>>")
    return N.let(F.concat(F.lit(" "), key, F.lit(" ")), lambda t: F.array_distinct(F.transform(F.filter(listed, lambda n: F.contains(t, n["n"])), lambda n: n["c"])))


def sells_goods_guess(products: Column, cart: Column, cod: Column, categories: Column) -> Column:
    """P(sells goods) where no page was assessed, from whether such facts are known at all."""
    add = lambda x, w: F.when(F.coalesce(x, F.lit(False)), w).otherwise(0.0)
    return F.least(F.lit(0.95), 0.3 + add(products, 0.3) + add(cart, 0.15) + add(cod, 0.2) + add(categories > 0, 0.1))


def rule_confidence(log_lr: Column) -> Column:
    """How sure the strongest of a platform's rule hits is, as an aggregate."""
    return F.coalesce(F.max(N.sigmoid(log_lr)), F.lit(0.0))


def categories(df: DataFrame, hits: Column, priors: dict[str, float] = CATEGORY_PRIORS) -> DataFrame:
    """Naive Bayes over phrase counts, an array in the priors' order; adds ``probabilities`` in that order, ``category``, ``probability`` and ``abstained``."""
    counted = df.withColumn("_hits", hits)
    counted = counted.withColumns({f"_n_{c}": F.col("_hits")[i] for i, c in enumerate(priors)})
    scores = F.array(*(F.lit(math.log(p)) + F.least(F.col(f"_n_{c}"), F.lit(HIT_CAP)) * HIT_LOG_RATIO for c, p in priors.items()))
    rows = counted.withColumn("probabilities", N.softmax(scores)).withColumn("_ranked", F.reverse(F.array_sort("probabilities")))
    every = sum((F.col(f"_n_{c}") for c in priors), F.lit(0))
    best = F.element_at(F.array(*map(F.lit, priors)), F.array_position("probabilities", F.col("_ranked")[0]).cast("int"))
    unsure = (every == 0) | (F.col("_ranked")[0] < 0.35) | (F.col("_ranked")[0] - F.col("_ranked")[1] < 0.06)
    out = rows.withColumns({"category": best, "probability": F.col("_ranked")[0], "abstained": unsure})
    return out.drop("_ranked", "_hits", *(f"_n_{c}" for c in priors))


def market(c: dict[str, Column]) -> tuple[Column, Column]:
    """P(in the market) and P(sells) from dz_host, cod_weight, dzd, wilayas, phones, languages (ar_dz, fr, ar_msa), products, cart, checkout, prices."""
    flag = lambda x, w: F.when(x, w).otherwise(0.0)
    places = F.when(c["wilayas"] >= 5, F.least(F.lit(2.6), 1.1 + 0.09 * c["wilayas"])).when(c["wilayas"] >= 2, 0.9).otherwise(0.0)
    phones = F.when(c["phones"] >= 2, 2.4).when(c["phones"] == 1, 1.8).otherwise(0.0)
    here = (
        math.log(0.12 / 0.88) + flag(c["dz_host"], 1.7) + F.least(c["cod_weight"], F.lit(4.0)) + flag(c["dzd"], 2.1) + places + phones
        + flag(c["language"] == "ar_dz", 1.2) + flag(c["language"] == "fr", 0.4) + flag(c["language"] == "ar_msa", 0.6)
    )
    stock = F.when(c["products"] > 0, F.least(F.lit(3.4), 0.9 + F.log1p(c["products"]) / 2.2)).otherwise(0.0)
    sells = math.log(0.2 / 0.8) + stock + flag(c["cart"], 1.3) + flag(c["checkout"], 1.1) + flag(c["prices"], 0.9) + flag(c["cod_weight"] > 0, 1.2) + flag(c["dzd"], 0.8)
    return N.sigmoid(N.clamp(here, -8.0, 8.0)), N.sigmoid(N.clamp(sells, -8.0, 8.0))


def maturity(products: Column, fresh_days: Column, pixels: Column, server_side: Column, channels: Column, platform: Column) -> Column:
    share = {k: round(0.15 * v, 6) for k, v in SOPHISTICATION.items()}  # the decimal products, as half a tenth decides how the index is rounded
    stack = F.coalesce(F.create_map(*(F.lit(x) for kv in share.items() for x in kv))[platform], F.lit(0.03))
    catalog = N.clamp(F.log1p(F.coalesce(products, F.lit(0)).cast("double")) / math.log1p(300), 0.0, 1.0)
    fresh = F.coalesce(N.clamp(N.decay(fresh_days, 30.0), 0.0, 1.0), F.lit(0.35))
    track = N.clamp(pixels / 4.0, 0.0, 1.0) * F.when(server_side, 1.0).otherwise(0.85)
    raw = 0.3 * catalog + 0.2 * fresh + 0.2 * track + 0.15 * N.clamp(channels / 4.0, 0.0, 1.0) + stack
    return F.floor(N.clamp(raw, 0.0, 1.0) * 1000 + 0.5) / 10


#: The gates in their order, and least chances.
CONTACTABLE = ["whatsapp", "messenger", "instagram", "facebook", "email"]
LEAST_MARKET, LEAST_SELLS = 0.70, 0.60


def gates(c: dict[str, Column], floor: float = 0.0) -> tuple[Column, Column]:
    """Whether a lead qualifies, and the reasons against it in gate order, from channels (array), p_market, p_sells, suppressed, customer, policy_ok and maturity."""
    tests = [
        (F.arrays_overlap(c["channels"], F.array(*map(F.lit, CONTACTABLE))), "no contactable channel"),
        (c["p_market"] >= LEAST_MARKET, "outside the market"),
        (c["p_sells"] >= LEAST_SELLS, "does not sell goods"),
        (~c["suppressed"], "suppressed"),
        (~c["customer"], "already a customer"),
        (c["policy_ok"], "contact policy"),
        (c["maturity"] >= floor, "below the maturity floor"),
    ]
    against = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in tests)), lambda r: r.isNotNull())
    return F.size(against) == 0, F.when(F.size(against) == 0, F.array(F.lit("all hard gates passed"))).otherwise(against)


GATES = ["contactable_channel", "p_market", "p_sells_goods", "not_suppressed", "not_customer", "contact_policy", "maturity_floor"]


def gate_summary(reasons: Column) -> Column:
    """A line for each gate, in order, with whether it was passed, from the reasons of ``gates``."""
    against = ["no contactable channel", "outside the market", "does not sell goods", "suppressed", "already a customer", "contact policy", "below the maturity floor"]
    return F.concat_ws("\n", *(F.concat(F.when(F.array_contains(reasons, why), "✗ ").otherwise("✓ "), F.lit(g)) for g, why in zip(GATES, against, strict=True)))


#: Features in their order with prior mean and standard deviation.
FEATURES = [
    ("bias", math.log(0.12 / 0.88), 1.0), ("is_advertiser_fresh", 0.55, 0.5), ("log_ad_count", 0.1, 0.35), ("sells_cod", 0.85, 0.5),
    ("has_direct_whatsapp", 0.6, 0.5), ("has_messenger_or_ig", 0.15, 0.4), ("platform_shopify", 0.15, 0.4), ("platform_youcan", 0.3, 0.5),
    ("platform_woocommerce", 0.05, 0.4), ("platform_other", 0.0, 0.4), ("category_fashion", 0.2, 0.4), ("category_beauty", 0.25, 0.4),
    ("category_phones", 0.1, 0.4), ("category_other", 0.0, 0.4), ("maturity_index", -0.2, 0.4), ("log_catalog_size", 0.2, 0.35),
    ("pixel_meta", 0.35, 0.4), ("pixel_tiktok", 0.25, 0.4), ("language_arabic", 0.3, 0.4), ("language_french", -0.1, 0.4),
    ("channel_whatsapp", 0.5, 0.5), ("channel_social", -0.25, 0.4), ("hour_afternoon", 0.1, 0.3), ("hour_evening", 0.05, 0.3), ("sender_warmup", -0.3, 0.4),
]


def feature_array(c: dict[str, Column]) -> Column:
    """The features of ``FEATURES`` in order; whatever isn't finite is 0."""
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), 1.0).otherwise(0.0)
    social = c["channel"].isin("messenger", "instagram", "facebook")
    fresh = F.when(c["advertiser"], F.coalesce(N.decay(c["days_since_seen"], 21.0), F.lit(0.7))).otherwise(0.0)
    category = F.coalesce(c["category"], F.lit("other"))
    listed = ["fashion", "beauty", "phones_accessories"]
    platforms = ["shopify", "youcan", "woocommerce"]
    values = [
        F.lit(1.0), fresh, F.log1p(F.greatest(c["ad_count"], F.lit(0)).cast("double")), yes(c["sells_cod"]), yes(c["whatsapp"]), yes(~c["whatsapp"] & social),
        *(yes(c["platform"] == p) for p in platforms), yes(~c["platform"].isin(*platforms)), *(yes(category == k) for k in listed), yes(~category.isin(*listed)),
        N.clamp(c["maturity"] / 100.0, 0.0, 1.0), F.coalesce(N.clamp(F.log1p(F.greatest(c["products"], F.lit(0)).cast("double")) / math.log1p(300), 0.0, 1.0), F.lit(0.0)),
        yes(c["pixel_meta"]), yes(c["pixel_tiktok"]), yes(c["language"].isin("ar_dz", "ar_msa")), yes(c["language"] == "fr"), yes(c["channel"] == "whatsapp"), yes(social),
        yes((c["hour"] >= 11) & (c["hour"] < 16)), yes((c["hour"] >= 16) & (c["hour"] < 22)), N.clamp(c["warmup"], 0.0, 1.0),
    ]
    return F.array(*(N.finite_or(v.cast("double"), 0.0) for v in values))
