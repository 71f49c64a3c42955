"""Rule tables for storefront platforms, advertising scripts, cash-on-delivery phrases and currencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarind.functions.text import match_key

#: Fixed values: (id, where, header, pattern, hypothesis, log ratio, cluster). A header rule looks at that response header.
PLATFORM_RULES = [
    ("shopify.theme-js", "html", None, r"Shopify\.theme", "shopify", 4.2, "shopify-inline"),
    ("shopify.cdn", "html", None, r"cdn\.shopify\.com", "shopify", 3.2, "shopify-assets"),
    ("shopify.cdn-shop-path", "html", None, r"/cdn/shop/(?:files|products)", "shopify", 2.0, "shopify-assets"),
    ("shopify.myshopify-host", "html", None, r"myshopify\.com", "shopify", 3.0, "shopify-inline"),
    ("shopify.features", "html", None, r"shopify-features", "shopify", 2.6, "shopify-inline"),
    ("shopify.checkout-route", "html", None, r"/checkouts?/|shopify-section", "shopify", 1.9, "shopify-inline"),
    ("shopify.header-shopid", "header", "x-shopid", r".+", "shopify", 4.6, "shopify-header"),
    ("shopify.header-hat", "header", "x-sorting-hat-shopid", r".+", "shopify", 4.6, "shopify-header"),
    ("shopify.products-json", "url", None, r"/products\.json", "shopify", 3.4, "shopify-api"),
    ("woo.generator", "html", None, r"WooCommerce\s+[0-9]", "woocommerce", 4.6, "woo-generator"),
    ("woo.plugin-path", "html", None, r"wp-content/plugins/woocommerce", "woocommerce", 4.2, "woo-assets"),
    ("woo.body-class", "html", None, r'class="[^"]*(?<![A-Za-z0-9_])woocommerce(?![A-Za-z0-9_])', "woocommerce", 3.0, "woo-assets"),
    ("woo.ajax", "html", None, r"wc-ajax|wc_add_to_cart", "woocommerce", 2.6, "woo-assets"),
    ("woo.cart-fragment", "html", None, r"woocommerce-cart-fragments|woocommerce-mini-cart", "woocommerce", 2.4, "woo-assets"),
    ("woo.add-to-cart", "html", None, r"\?add-to-cart=", "woocommerce", 1.8, "woo-assets"),
    ("wp.generator", "html", None, r'name="generator" content="WordPress', "wordpress", 4.4, "wp-generator"),
    ("wp.assets", "html", None, r"wp-content/(?:themes|plugins)", "wordpress", 2.4, "wp-assets"),
    ("wp.api", "html", None, r"wp-json", "wordpress", 2.0, "wp-assets"),
    ("youcan.domain", "html", None, r"youcan\.shop|youcan\.store", "youcan", 3.6, "youcan-domain"),
    ("youcan.asset", "html", None, r"cdn\.youcan\.store|youcan-?cdn|youcanapp", "youcan", 3.4, "youcan-assets"),
    ("youcan.brand", "html", None, r"(?<![A-Za-z0-9_])YouCan(?![A-Za-z0-9_])|youcan\.shop", "youcan", 1.4, "youcan-brand"),
    ("lightfunnels.asset", "html", None, r"cdn\.lightfunnels\.com|lightfunnels\.com/(?:assets|static)", "lightfunnels", 3.4, "lf-assets"),
    ("lightfunnels.brand", "html", None, r"lightfunnels", "lightfunnels", 1.6, "lf-brand"),
    ("wix.cdn", "html", None, r"wixstatic\.com", "wix", 3.6, "wix-assets"),
    ("wix.parastorage", "html", None, r"static\.parastorage\.com", "wix", 3.0, "wix-assets"),
    ("wix.runtime", "html", None, r"_wixCIDX|wix-code|viewerModel", "wix", 2.6, "wix-inline"),
    ("wix.header", "header", "x-wix-request-id", r".+", "wix", 3.8, "wix-header"),
    ("sqs.cdn", "html", None, r"static1\.squarespace\.com|images\.squarespace-cdn\.com", "squarespace", 3.8, "sqs-assets"),
    ("sqs.block", "html", None, r"sqs-block|squarespace-cdn|sqsp-", "squarespace", 3.0, "sqs-assets"),
    ("sqs.brand", "html", None, r"squarespace", "squarespace", 1.4, "sqs-brand"),
    ("sqs.header", "header", "x-squarespace-dynamic", r".+", "squarespace", 3.6, "sqs-header"),
    ("wf.assets", "html", None, r"assets(?:-cdn|\.global)?\.website-files\.com|assets\.webflow\.com", "webflow", 3.6, "wf-assets"),
    ("wf.data-attrs", "html", None, r"data-wf-page|data-wf-site|data-wf-domain", "webflow", 3.0, "wf-inline"),
    ("wf.brand", "html", None, r"webflow", "webflow", 1.2, "wf-brand"),
    ("ps.brand", "html", None, r"prestashop", "prestashop", 2.8, "ps-brand"),
    ("ps.theme", "html", None, r"/themes/(?:classic|default-bootstrap)", "prestashop", 2.2, "ps-assets"),
    ("ps.params", "html", None, r"id_product=|controller=product|prestashop-", "prestashop", 2.4, "ps-inline"),
    ("ps.header", "header", "x-powered-by", r"PrestaShop", "prestashop", 3.4, "ps-header"),
    ("mage.static-version", "html", None, r"static/version\d+|Magento_[A-Z]", "magento", 3.2, "mage-assets"),
    ("mage.cookies", "html", None, r"mage/cookies|mage-init|requirejs", "magento", 2.2, "mage-inline"),
    ("mage.header", "header", "x-magento-tags", r".+", "magento", 3.8, "mage-header"),
    ("salla.domain", "html", None, r"salla\.sa|cdn\.salla\.sa|salla-", "salla", 3.4, "salla-assets"),
    ("zid.domain", "html", None, r"zid\.store|cdn\.zid\.store|zid-", "zid", 3.4, "zid-assets"),
    ("generic.cart", "html", None, "add to cart|ajouter au panier|اشتري الان|أضف إلى السلة|acheter maintenant", "custom", 2.4, "generic-store"),
    ("generic.checkout", "html", None, "/checkout|commander|طلب الآن|finaliser la commande", "custom", 2.0, "generic-store"),
    ("generic.cod-form", "html", None, "paiement a la livraison|الدفع عند الاستلام|nom complet|full name", "custom", 2.2, "generic-cod"),
]

#: Fixed values: (id, pattern, whether the hit happens on the server's side).
AD_RULES = [
    ("meta_pixel", r"""connect\.facebook\.net/[^"']*fbevents\.js|fbq\(\s*['"]init['"]""", False),
    ("meta_pixel_advanced", r"""fbq\(\s*['"]init['"]\s*,\s*['"][^'"]+['"]\s*,\s*\{""", False),
    ("meta_capi", r"""graph\.facebook\.com/v\d+\.\d+/[^"'/]+/events|capi|conversions[_ -]?api""", True),
    ("tiktok_pixel", r"analytics\.tiktok\.com|ttq\.load\(", False),
    ("tiktok_events", r"business-api\.tiktok\.com|events/v\d+/pixel", True),
    ("ga4", r"gtag/js\?id=G-[A-Z0-9]{6,}|G-[A-Z0-9]{8,}", False),
    ("gtm", r"googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]{5,}", False),
    ("snap_pixel", r"""sc-static\.net/scevent\.min\.js|snaptr\(\s*['"]init['"]""", False),
    ("google_ads", r"googleads\.g\.doubleclick\.net|AW-[0-9]{9,}", False),
    ("hotjar", r"static\.hotjar\.com", False),
    ("klaviyo", r"static\.klaviyo\.com|klaviyo\.js", False),
    ("crisp_chat", r"client\.crisp\.chat", False),
    ("tawk_chat", r"embed\.tawk\.to", False),
]

#: Fixed values: (language, phrase as a match key, weight). A phrase of two languages counts for both.
COD_PHRASES = [
    ("fr", "paiement a la livraison", 3.6),
    ("fr", "paiement a la reception", 3.0),
    ("fr", "payer a la livraison", 2.6),
    ("fr", "livraison a domicile", 1.6),
    ("fr", "livraison 58 wilayas", 2.4),
    ("fr", "livraison partout en algerie", 2.4),
    ("fr", "cash on delivery", 2.0),
    ("fr", "retour gratuit", 0.8),
    ("ar", "الدفع عند الاستلام", 3.8),
    ("ar", "الدفع عند التسليم", 3.2),
    ("ar", "الدفع في المنزل", 2.8),
    ("ar", "الخلاص عند الاستلام", 2.6),
    ("ar", "توصيل لكل الولايات", 2.6),
    ("ar", "التوصيل مجاني", 1.4),
    ("ar", "طلبيتك توصل", 1.4),
    ("en", "cash on delivery", 2.0),
    ("en", "cod available", 1.8),
    ("en", "delivery all over algeria", 2.2),
]

#: Fixed values: (pattern, currency, weight). Borders of words are written out: Java's own count Arabic letters as parts of words.
CURRENCIES = [
    (r"(?<![A-Za-z0-9_])dzd(?![A-Za-z0-9_])", "DZD", 2.2),
    (r"(?<![A-Za-z0-9_])da(?![A-Za-z0-9_])", "DZD", 1.1),
    ("dinars?", "DZD", 1.6),
    ("دج", "DZD", 2.2),
    (r"د\.?ج", "DZD", 2.0),
    ("دينار", "DZD", 1.8),
    (r"(?<![A-Za-z0-9_])eur(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])euros?(?![A-Za-z0-9_])", "EUR", 0.4),
]
#: What a shop's page says where one can put into a cart, and pay.
CART = "add to cart|ajouter au panier|اشتري الان|أضف إلى السلة"
CHECKOUT = "/checkout|commander|finaliser la commande|إتمام الطلب"


def cod_weight(key: Column) -> Column:
    """Summed weights of the phrases that a match key holds."""
    return sum((F.when(key.contains(match_key(p)), w).otherwise(0.0) for _, p, w in COD_PHRASES), F.lit(0.0))


def currency_of(text: Column) -> Column:
    """The currency whose mark weighs most; null without any."""
    found = F.array(*(F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(w).alias("w"), F.lit(c).alias("c"))) for p, c, w in CURRENCIES))
    return F.array_max(F.filter(found, lambda m: m.isNotNull()))["c"]


def platform_rules(headers: str = "headers") -> tuple[list[dict], list[str]]:
    """The rules as ``evidence.rule_hits`` takes them, and the headers that they look at."""
    rules = [{"id": i, "where": where if where != "header" else f"header:{name}", "pattern": p, "hypothesis": h, "log_lr": w, "cluster": c} for i, where, name, p, h, w, c in PLATFORM_RULES]
    return rules, sorted({name for _, where, name, *_ in PLATFORM_RULES if where == "header"})
