"""Message templates with variants by language, how one is chosen, and how a drafted message is handed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarind.functions import messaging as M
from tamarind.functions import numeric as N
from tamarind.functions.text import match_key_of
from tamarind.operators.bandit import draw

WRITTEN = ["whatsapp", "messenger", "instagram", "facebook"]
#: Template, stage, channels, and variants: language, successes and failures it starts with, our own wording.
#: Ids, stages, channels, languages and counts are fixed values; the wording is a parameter.
TEMPLATES = [
    ("first_contact.advertiser", "first_contact", WRITTEN, [
        ("ar_dz", 2, 3, "سلام {name}، شفت إشهار {product}. عندي أداة تأكد الطلبيات قبل الشحن. نجربوها؟"),
        ("ar_msa", 1, 3, "السلام عليكم {name}، رأيت إعلان {product}. لدينا أداة تؤكد الطلبات قبل الشحن. هل نجربها؟"),
        ("fr", 1, 4, "Bonjour {name}, j'ai vu votre annonce pour {product}. Un outil peut confirmer vos commandes avant l'envoi. On essaie ?"),
    ]),
    ("first_contact.messaging_only", "first_contact", WRITTEN[1:], [
        ("ar_dz", 2, 3, "سلام {name}، صفحتك و{product} مليحة. الطلبيات في الرسائل تتعب، نقدر نرتبهم. نوريلك؟"),
        ("ar_msa", 1, 3, "السلام عليكم {name}، صفحتكم و{product} جميلة. يمكن ترتيب طلبات الرسائل آليا. هل نريكم؟"),
        ("fr", 1, 4, "Bonjour {name}, votre page et {product} sont soignés. Vos commandes par message peuvent être rangées toutes seules. Je vous montre ?"),
    ]),
    ("first_contact.other_platform", "first_contact", [*WRITTEN, "email"], [
        ("ar_dz", 2, 3, "سلام {name}، متجرك على {platform} منظم. تأكدو الطلبيات بالتيليفون؟ كاين طريقة أسهل."),
        ("fr", 1, 3, "Bonjour {name}, votre boutique sur {platform} est claire. Confirmez-vous encore les commandes par téléphone ?"),
        ("ar_msa", 1, 4, "السلام عليكم {name}، متجركم على {platform} منظم. هل تؤكدون الطلبات هاتفيا؟"),
    ]),
    ("first_contact.new_small", "first_contact", WRITTEN, [
        ("ar_dz", 2, 4, "سلام {name}، ربي يوفقك في مشروعك. نعاونوا التجار الجدد باش يبداو. يهمك؟"),
        ("fr", 1, 4, "Bonjour {name}, bravo pour votre projet. Nous aidons les nouvelles boutiques à démarrer. Ça vous dit ?"),
    ]),
    ("followup.once", "followup", [*WRITTEN, "email"], [
        ("ar_dz", 1, 6, "سلام، نعاود نكتب مرة وحدة برك في حالة ما شفتش الرسالة. شكرا على وقتك."),
        ("fr", 1, 6, "Bonjour, un seul rappel au cas où mon message vous aurait échappé. Merci pour votre temps."),
    ]),
    ("reply.interested_link", "reply", [*WRITTEN, "email"], [
        ("ar_dz", 3, 1, "مليح، التسجيل هنا: {link} ونعاونك خطوة بخطوة."),
        ("fr", 2, 1, "Parfait, l'inscription est ici : {link} et je vous accompagne."),
    ]),
    ("post_signup.pro_gift", "post_signup", [*WRITTEN, "email"], [
        ("ar_dz", 3, 1, "شكرا على التسجيل، حلينالك شهر كامل باش تجرب كلش."),
        ("fr", 2, 1, "Merci pour votre inscription, un mois complet vous est offert pour tout essayer."),
    ]),
]
SHORT = {"ar_dz": "dz", "ar_msa": "msa", "fr": "fr"}
#: Share of choices made at random, and what a variant's rate is shrunk with.
EXPLORE, SHRINK = 0.1, 2
NO_PRODUCT, NO_PLATFORM = "منتجك", "متجرك"
KIND = "template_id string, stage string, channels array<string>, variant_id string, language string, successes double, failures double, body string, place int"


def template_rows(spark: SparkSession, templates: list = TEMPLATES) -> DataFrame:
    """A row for each variant, with its place in its template: a small dimension."""
    rows = [(t, stage, channels, f"{t}.{SHORT.get(lang, lang)}", lang, float(won), float(lost), body, i) for t, stage, channels, variants in templates for i, (lang, won, lost, body) in enumerate(variants)]
    return spark.createDataFrame(rows, KIND)


def with_outcomes(variants: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Variants with the successes and failures of ``(variant_id, sends, replies)`` added to what they start with."""
    rows = variants.join(outcomes.select("variant_id", "sends", "replies"), "variant_id", "left").fillna(0, ["sends", "replies"])
    more = {"successes": F.col("successes") + F.col("replies"), "failures": F.col("failures") + F.greatest(F.lit(0), F.col("sends") - F.col("replies"))}
    return rows.withColumns(more).drop("sends", "replies")


def variant_posteriors(variants: DataFrame, rate: Column) -> DataFrame:
    """Adds ``mean``: a variant's rate, shrunk towards the rate of all so that few sends can't lead."""
    s, f = F.col("successes"), F.col("failures")
    return variants.withColumn("mean", N.clamp((s + SHRINK * rate) / (s + f + SHRINK), 0.0, 1.0))


def template_of(channel: Column, has_whatsapp: Column, advertiser: Column, platform: Column, products: Column, first: Column | None = None) -> Column:
    """The template of a lead: of a first contact, or the one follow-up."""
    social = channel.isin("messenger", "instagram", "facebook")
    written = social | (channel == "whatsapp")
    storefront = (platform != "none") & (F.coalesce(products, F.lit(0)) > 0) & (written | (channel == "email"))
    found = (
        F.when(social & ~has_whatsapp, "first_contact.messaging_only").when(written & advertiser, "first_contact.advertiser").when(storefront, "first_contact.other_platform")
        .when(written, "first_contact.new_small").when(channel == "email", "first_contact.other_platform").otherwise("first_contact.advertiser")
    )
    return found if first is None else F.when(first, found).otherwise("followup.once")


def choose_variants(rows: DataFrame, variants: DataFrame, key: str, seed: int = 20260101) -> DataFrame:
    """``rows`` (with ``template_id`` and ``language``) with the chosen variant's ``variant_id``, its ``variant_language`` and ``template_body``.

    The variants of a lead's language stand for choice; for ``mixed`` those in the dialect and
    in French; else all of the template. Thompson sampling picks the greatest Beta sample, and
    one time in ten any at random. Draws depend on the lead and the variant alone.
    """
    v = F.broadcast(variants.select("template_id", "variant_id", F.col("language").alias("variant_language"), "successes", "failures", F.col("body").alias("template_body"), "place"))
    both = rows.join(v, "template_id")
    exact = (F.col("variant_language") == F.col("language")).cast("int")
    mixed = ((F.col("language") == "mixed") & F.col("variant_language").isin("ar_dz", "fr")).cast("int")
    fit = Window.partitionBy(key)
    any_exact, any_mixed = F.max(exact).over(fit), F.max(mixed).over(fit)
    open_ = both.withColumn("_open", F.when(any_exact == 1, exact == 1).when(any_mixed == 1, mixed == 1).otherwise(F.lit(True))).filter("_open")
    u = lambda tag, *more: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(tag), *more), F.lit(1_000_003)) + 0.5) / 1_000_003
    drawn = open_.withColumn("_sample", draw(F.col("successes") + 1, F.col("failures") + 1, F.concat_ws(":", key, "variant_id"), seed))
    score = F.when(u("explore") < EXPLORE, 2 + u("pick", F.col("variant_id"))).otherwise(F.col("_sample"))
    best = drawn.withColumn("_score", score).withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_score"), "place"))).filter("_k = 1")
    return best.drop("_open", "_sample", "_score", "_k", "place", "successes", "failures")


def draft(rows: DataFrame, first: Column | None = None) -> DataFrame:
    """Adds ``body``, ``errors``, ``warnings`` and ``sendable`` to rows with ``template_body`` and the slots name, product, platform and link."""
    given = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in rows.columns else F.lit(other)
    slots = {"name": given("name", ""), "product": given("product", NO_PRODUCT), "platform": given("platform_label", NO_PLATFORM), "link": given("signup_url", "")}
    filled = rows.withColumn("body", F.trim(M.render(F.col("template_body"), slots)))
    filled = filled.withColumn("_key", match_key_of("body"))
    errors, warnings = M.lint(F.col("body"), F.col("_key"), F.lit(True) if first is None else first)
    return filled.withColumns({"errors": errors, "warnings": warnings}).withColumn("sendable", F.size("errors") == 0).drop("_key")


def outreach_link(channel: Column, target: Column, body: Column) -> Column:
    """Where a person sends a message from: a chat link with the text, a mail, a number to call, or a profile to open."""
    return (
        F.when(channel == "whatsapp", M.wa_link(target, body))
        .when(channel == "email", F.concat(F.lit("mailto:"), target, F.lit("?body="), M.percent_encoded(body)))
        .when(channel == "phone", F.concat(F.lit("tel:"), target))
        .otherwise(M.profile_link(channel, target))
    )
