"""Templates, message checks and hand-off links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest message and link, words that block a message, and words that need a look.
MOST_CHARS, MOST_LINK = 450, 1900
BLOCKED = ["cliquez ici", "cliquer ici", "offre limitee", "offre exceptionnelle", "gratuit a 100", "100% gratuit", "argent facile", "gagnez de l argent", "اضغط هنا", "ربح مضمون", "اربح المال", "مجاني 100", "فرصه لن تتكرر"]
WARNED = ["gratuit", "promo", "urgent", "garanti", "exclusif", "مجان", "عرض خاص", "عاجل", "مضمون"]


def slot_names(body: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\{([A-Za-z_]+)\}"), 1), F.lower))


def render(body: Column, slots: dict[str, Column]) -> Column:
    """Known slots are filled in; a slot without a value stays."""
    for name, value in slots.items():
        body = F.regexp_replace(body, F.lit(rf"(?i)\{{{name}\}}"), F.regexp_replace(F.coalesce(value, F.lit(f"{{{name}}}")), r"([\\$])", r"\\$1"))
    return body


def questions(body: Column) -> Column:
    return F.regexp_count(body, F.lit("[?？؟]"))


def lint(body: Column, key: Column, first_contact: Column) -> tuple[Column, Column]:
    """Errors and warnings; ``key`` is the body's match key. Lengths count code points."""
    from tamarind.functions.text import match_key

    errors = [
        F.when(F.size(slot_names(body)) > 0, "unresolved slots"),
        F.when(F.length(body) > MOST_CHARS, "message too long"),
        F.when(first_contact & body.rlike(r"(?i)https?://|www\.|wa\.me|bit\.ly|\.dz(?![A-Za-z0-9_])"), "URL in first contact"),
        F.when(questions(body) > 1, "more than one question"),
        *(F.when(key.contains(match_key(t)), f"blocked: {t}") for t in BLOCKED),
    ]
    warnings = [*(F.when(key.contains(match_key(t)), f"check: {t}") for t in WARNED), F.when(body.rlike(r"(?i)(?<![A-Za-z0-9_])(?:free money|100%|garantie totale)(?![A-Za-z0-9_])"), "absolute claim")]
    given = lambda xs: F.array_distinct(F.filter(F.array(*xs), lambda x: x.isNotNull()))
    return given(errors), given(warnings)


def percent_encoded(text: Column) -> Column:
    """As a URI component: a space is %20, and !'()~ stay."""
    out = F.regexp_replace(F.url_encode(text), r"\+", "%20")
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def wa_link(phone: Column, text: Column) -> Column:
    """A chat link for an E.164 number; null without a number or where it gets too long."""
    url = F.concat(F.lit("https://wa.me/"), F.regexp_replace(phone, r"^\+", ""), F.lit("?text="), percent_encoded(text))
    return F.when(F.length(url) <= MOST_LINK, url)


def profile_link(channel: Column, handle: Column) -> Column:
    start = F.when(channel == "instagram", "https://www.instagram.com/").when(channel == "messenger", "https://m.me/").when(channel == "tiktok", "https://www.tiktok.com/@").otherwise("https://www.facebook.com/")
    return F.when(handle.rlike("^https?:"), handle).otherwise(F.concat(start, handle))


def contact_url(channel: Column, value: Column) -> Column:
    """Where a contact of a channel is reached."""
    return (
        F.when(channel == "whatsapp", F.concat(F.lit("https://wa.me/"), F.replace(value, F.lit("+"), F.lit(""))))
        .when(channel == "email", F.concat(F.lit("mailto:"), value))
        .when(channel == "phone", F.concat(F.lit("tel:"), value))
        .when(channel.isin("messenger", "instagram", "facebook", "tiktok"), profile_link(channel, value))
    )
