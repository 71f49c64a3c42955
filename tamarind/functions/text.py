"""Text normalisation, tokens, similarities and language shares."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarind.functions import numeric as N

#: Arabic letters that are written alike, Arabic digits, and signs that go.
ALIKE = {"آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ٲ": "ا", "ٳ": "ا", "ى": "ي", "ئ": "ي", "ؤ": "و", "ة": "ه"}
DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
DIACRITICS = re.compile("[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u08d3-\u08e1\u08e3-\u08ff\ufe70-\ufe7f\u0640]")
#: Punctuation that parts words; other marks stay.
PUNCTUATION = "،؛؟٪٫٬٭.,!?;:\"'`()[]{}<>/\\|*+=_~^%$#@&"
COMBINING = re.compile("[\u0300-\u036f\u064b-\u065f]+")
PLAIN_FORM = {ord(c): " " for c in PUNCTUATION} | DIGITS
ONE_LETTER = str.maketrans(ALIKE)
WHITE = re.compile("[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def _folded(text: str) -> str:
    """A match key before its spaces are joined."""
    if not text.isascii():
        x = DIACRITICS.sub("", unicodedata.normalize("NFKC", text)).translate(ONE_LETTER)
        text = unicodedata.normalize("NFD", x).replace("ß", "ss")
        text = COMBINING.sub("", text)
    return text.lower().translate(PLAIN_FORM)


def match_key(text: str | None) -> str | None:
    """The form in which names and phrases are compared: accents, case, Arabic variants and punctuation go."""
    return None if text is None else WHITE.sub(" ", _folded(text)).strip(" ")


def normalize_text(text: str | None) -> str | None:
    if text is None:
        return None
    x = DIACRITICS.sub("", unicodedata.normalize("NFKC", text))
    x = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", x)
    x = re.sub(r"[ \t\u00a0]+", " ", unicodedata.normalize("NFC", x))
    return re.sub(r"\n{3,}", "\n\n", x).strip()


def slugify(text: str | None) -> str | None:
    if text is None:
        return None
    x = COMBINING.sub("", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower())).replace("ß", "ss")
    return re.sub("[^a-z0-9\u0600-\u06ff]+", "-", x).strip("-")[:80]


def clean_merchant_name(text: str | None) -> str | None:
    """A shop's name without brackets and what follows a bar; at most 60 characters."""
    if text is None:
        return None
    x = re.sub(r"\[\s*|\s*\]", "", normalize_text(text))
    x = re.sub(r"[|–—]\s*(boutique|store|shop|dz|algerie)\s*$", "", x, flags=re.I)
    x = re.sub(r"\s*\|\s*.*$", "", x, flags=re.M)
    return re.sub(r"\s{2,}", " ", x).strip()[:60]


@F.pandas_udf(T.StringType())
def match_key_udf(s: pd.Series) -> pd.Series:
    return s.map(match_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_udf(s: pd.Series) -> pd.Series:
    return s.map(normalize_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def slug_udf(s: pd.Series) -> pd.Series:
    return s.map(slugify, na_action="ignore")


@F.pandas_udf(T.StringType())
def merchant_name_udf(s: pd.Series) -> pd.Series:
    return s.map(clean_merchant_name, na_action="ignore")


@lru_cache(maxsize=1)
def _latin() -> tuple[str, str, str]:
    """A class of Latin characters whose key form is one character whatever stands beside them, and their forms."""
    chars = [c for c in map(chr, range(0x180)) if len(_folded(c)) == 1]
    runs: list[list[int]] = []
    for code in sorted([*map(ord, chars), ord("ß")]):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    kept = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)
    changed = [c for c in chars if _folded(c) != c]
    return f"^[{kept}]*$", "".join(changed), "".join(map(_folded, changed))


def match_key_of(text: str | Column) -> Column:
    """``match_key`` as a column: Latin texts stay in the JVM, only others go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    plain, chars, forms = _latin()
    latin = text.rlike(plain)
    spaced = F.regexp_replace(F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), chars, forms), "[\\t-\\r ]+", " ")
    return F.when(text.isNull() | latin, F.trim(spaced)).otherwise(match_key_udf(F.when(~latin, text)))


def token_list(key: Column) -> Column:
    """Of a match key: tokens longer than one character, digits, and Arabic letters."""
    return F.filter(F.split(key, " "), lambda t: (F.length(t) > 1) | t.rlike(r"[0-9\x{0600}-\x{06FF}]"))


def token_set_similarity(a: Column, b: Column) -> Column:
    """The larger of Dice and 0.95 times containment, on token sets; 0 where one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(x, y)).cast("double")
    dice, contained = 2 * common / (F.size(x) + F.size(y)), 0.95 * common / F.least(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.greatest(dice, contained))


def jaro_winkler(a: str, b: str, boost: float = 0.1) -> float:
    """Always boosted by the common prefix, of four characters at most."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = np.zeros(len(b), bool), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (b[j] for j in np.flatnonzero(taken)), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * boost * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Words that mark a language, compared as they are with the tokens of match keys.
DIALECT_MARKERS_AR_DZ = [
    "واش", "راك", "راه", "راهم", "تاع", "بزاف", "شحال", "كاش", "خلاص", "بصح", "مليح",
    "نتا", "نحوس", "خاطر", "دوك", "ياخي", "درت", "تجي", "ماكاش", "برك", "زيد", "وليد",
    "حوس", "كيما", "هكاك", "شباب", "دير", "تشوف", "نجرب", "بالزاف", "سيرتو",
]
MARKERS_AR_MSA = [
    "الذي", "التي", "هذا", "هذه", "يمكن", "يوجد", "نحن", "يمكنك", "أيضا", "جدا",
    "الخدمة", "المنتجات", "العميل", "الطلبات", "بشكل", "حيث", "من خلال", "إلى",
]
MARKERS_FR = [
    "le", "la", "les", "des", "une", "vous", "nous", "avec", "pour", "est", "sur",
    "livraison", "paiement", "commande", "boutique", "prix", "produit", "gratuit",
    "client", "merci", "bonjour",
]
MARKERS_EN = [
    "the", "and", "you", "your", "with", "for", "shipping", "order", "store",
    "price", "product", "free", "thanks", "hello", "checkout",
]
MARKERS = {"ar_msa": MARKERS_AR_MSA, "ar_dz": DIALECT_MARKERS_AR_DZ, "fr": MARKERS_FR, "en": MARKERS_EN}
LANGUAGES = [*MARKERS, "mixed"]


def script_shares(text: Column) -> tuple[Column, Column]:
    """Shares of Arabic and of Latin letters among the characters that aren't white space."""
    n = F.length(F.regexp_replace(text, r"\s", "")).cast("double")
    arabic, latin = F.regexp_count(text, F.lit(r"[\x{0600}-\x{06FF}]")), F.regexp_count(text, F.lit(r"[A-Za-z\x{00C0}-\x{024F}]"))
    return F.when(n > 0, arabic / n).otherwise(0.0), F.when(n > 0, latin / n).otherwise(0.0)


def marker_hits(tokens: Column) -> dict[str, Column]:
    """How many different marker words of each language are among the tokens."""
    return {k: F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))) for k, words in MARKERS.items()}


def with_language(df: DataFrame, text: str, key: str) -> DataFrame:
    """Adds ``language_shares``, in the order of ``LANGUAGES``, and the dominant ``language``.

    Scores are the logarithm of a script's share plus weights of marker words; ``mixed`` has
    a score of its own. Ties go to the earlier language; mostly Arabic texts with more
    markers of the dialect than of the standard language are not called mixed.
    """
    arabic, latin = script_shares(F.col(text))
    rows = df.withColumns({"_arabic": arabic, "_latin": latin, "_tokens": F.array_distinct(token_list(F.col(key)))})
    rows = rows.withColumns({f"_m_{k}": v for k, v in marker_hits(F.col("_tokens")).items()})
    arabic, latin = F.col("_arabic"), F.col("_latin")
    msa, dz, fr, en = (F.col(f"_m_{k}") for k in MARKERS)
    if_ = lambda test, value: F.when(test, value).otherwise(0.0)
    logits = F.array(
        F.log(0.05 + arabic) + 0.9 * msa + if_(dz == 0, 0.4),
        F.log(0.05 + arabic) + 1.25 * dz,
        F.log(0.05 + latin) + 0.55 * fr + if_(fr > 0, 0.3),
        F.log(0.05 + latin) + 0.5 * en,
        0.25 + if_((arabic > 0.15) & (latin > 0.15), 2.4) + if_((dz > 1) & (fr > 1), 1.2),
    )
    rows = rows.withColumn("language_shares", N.softmax(logits))
    best = F.element_at(F.array(*map(F.lit, LANGUAGES)), F.array_position("language_shares", F.array_max("language_shares")).cast("int"))
    label = F.when((best == "mixed") & (arabic > 0.35) & (dz > msa), "ar_dz").otherwise(best)
    return rows.withColumn("language", label).drop("_arabic", "_latin", "_tokens", *(f"_m_{k}" for k in MARKERS))
