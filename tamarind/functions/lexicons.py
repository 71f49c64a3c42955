"""Word lists of categories and places, compared as match keys."""

from __future__ import annotations

#: Phrases of each category, by language.
CATEGORY_LEXICONS = {
    "fashion": {
        "ar": ["ملابس", "قميص", "قمصان", "فساتين", "فستان", "بنطال", "جينز", "تيشيرت", "حجاب", "عبايه", "جلابيه", "سويت شيرت", "بدله"],
        "fr": ["vetement", "vetements", "robe", "robes", "chemise", "jean", "pantalon", "manteau", "abaya", "hijab", "mode femme", "pret a porter"],
        "en": ["clothing", "dress", "shirt", "jeans", "hoodie", "fashion", "apparel", "abaya"],
    },
    "shoes": {
        "ar": ["احذيه", "حذا", "صباط", "صندل", "كعب", "سنيكرز", "جزمه"],
        "fr": ["chaussure", "chaussures", "basket", "baskets", "sandale", "escarpin", "bottes", "sneakers"],
        "en": ["shoes", "sneakers", "sandals", "boots", "heels"],
    },
    "beauty": {
        "ar": ["مكياج", "عطور", "عطر", "كريم", "سيروم", "ماسك", "شعر", "عنايه", "مسك", "روج", "احمر شفاه"],
        "fr": ["cosmetique", "parfum", "maquillage", "creme", "serum", "soin", "rouge a levres", "cheveux", "beaute"],
        "en": ["cosmetics", "perfume", "makeup", "skincare", "serum", "lipstick", "beauty"],
    },
    "phones_accessories": {
        "ar": ["هاتف", "هواتف", "سماعه", "شاحن", "غطاء هاتف", "كابل", "ايفون", "سامسونج", "شاشه هاتف"],
        "fr": ["telephone", "smartphone", "ecouteur", "ecouteurs", "chargeur", "coque", "cable", "iphone", "samsung", "accessoire telephone"],
        "en": ["phone", "smartphone", "earbuds", "charger", "phone case", "cable", "iphone", "samsung"],
    },
    "electronics": {
        "ar": ["الكترونيات", "تلفاز", "شاشه", "سماعات بلوتوث", "ساعه ذكيه", "طابعه", "كاميرا", "بلايستيشن"],
        "fr": ["electronique", "televiseur", "tv", "enceinte bluetooth", "montre connectee", "camera", "imprimante", "console"],
        "en": ["electronics", "tv", "bluetooth speaker", "smartwatch", "camera", "printer", "console"],
    },
    "home_kitchen": {
        "ar": ["منزل", "مطبخ", "ادوات مطبخ", "مقلايه", "طنجره", "مفارش", "سجاد", "ستائر", "خلاط", "منظفات"],
        "fr": ["maison", "cuisine", "ustensile", "poele", "casserole", "tapis", "rideaux", "mixeur", "menage"],
        "en": ["home", "kitchen", "cookware", "pan", "rug", "curtains", "blender", "household"],
    },
    "kids": {
        "ar": ["اطفال", "طفال", "العاب", "لعبه", "حفاظات", "ملابس اطفال", "عربه اطفال"],
        "fr": ["enfant", "enfants", "bebe", "jouet", "jouets", "couches", "poussette", "vetement bebe"],
        "en": ["kids", "baby", "toys", "stroller", "diapers", "children"],
    },
    "auto": {
        "ar": ["سيارات", "سياره", "قطع غيار", "اكسسوارات سياره", "زيت محرك", "اطارات"],
        "fr": ["auto", "automobile", "voiture", "piece auto", "accessoire voiture", "huile moteur", "pneus"],
        "en": ["auto", "car", "car parts", "car accessories", "motor oil", "tires"],
    },
    "health_supplements": {
        "ar": ["مكملات", "فيتامين", "بروتين", "حبوب", "دايت", "تنحيف", "صحه", "اعشاب"],
        "fr": ["complement alimentaire", "vitamine", "proteine", "minceur", "regime", "sante", "plantes"],
        "en": ["supplement", "vitamin", "protein", "weight loss", "health", "herbal"],
    },
    "jewelry_watches": {
        "ar": ["مجوهرات", "سلسله", "خاتم", "اسوره", "ساعه", "ذهب", "فضه", "اقراط"],
        "fr": ["bijou", "bijoux", "collier", "bague", "bracelet", "montre", "or", "argent", "boucles oreilles"],
        "en": ["jewelry", "necklace", "ring", "bracelet", "watch", "gold", "silver"],
    },
    "other": {
        "ar": ["منتجات", "متجر", "طلبات", "توصيل"],
        "fr": ["produit", "produits", "boutique", "commande", "livraison"],
        "en": ["product", "products", "store", "order", "shipping"],
    },
}

#: The provinces by official number, with their Latin and Arabic names.
WILAYAS = [
    (1, "Adrar", "أدرار"), (2, "Chlef", "الشلف"), (3, "Laghouat", "الأغواط"), (4, "Oum El Bouaghi", "أم البواقي"), (5, "Batna", "باتنة"), (6, "Béjaïa", "بجاية"),
    (7, "Biskra", "بسكرة"), (8, "Béchar", "بشار"), (9, "Blida", "البليدة"), (10, "Bouira", "البويرة"), (11, "Tamanrasset", "تمنراست"), (12, "Tébessa", "تبسة"),
    (13, "Tlemcen", "تلمسان"), (14, "Tiaret", "تيارت"), (15, "Tizi Ouzou", "تيزي وزو"), (16, "Alger", "الجزائر"), (17, "Djelfa", "الجلفة"), (18, "Jijel", "جيجل"),
    (19, "Sétif", "سطيف"), (20, "Saïda", "سعيدة"), (21, "Skikda", "سكيكدة"), (22, "Sidi Bel Abbès", "سيدي بلعباس"), (23, "Annaba", "عنابة"), (24, "Guelma", "قالمة"),
    (25, "Constantine", "قسنطينة"), (26, "Médéa", "المدية"), (27, "Mostaganem", "مستغانم"), (28, "M'Sila", "المسيلة"), (29, "Mascara", "معسكر"), (30, "Ouargla", "ورقلة"),
    (31, "Oran", "وهران"), (32, "El Bayadh", "البيض"), (33, "Illizi", "إليزي"), (34, "Bordj Bou Arreridj", "برج بوعريريج"), (35, "Boumerdès", "بومرداس"), (36, "El Tarf", "الطارف"),
    (37, "Tindouf", "تندوف"), (38, "Tissemsilt", "تيسمسيلت"), (39, "El Oued", "الوادي"), (40, "Khenchela", "خنشلة"), (41, "Souk Ahras", "سوق أهراس"), (42, "Tipaza", "تيبازة"),
    (43, "Mila", "ميلة"), (44, "Aïn Defla", "عين الدفلى"), (45, "Naâma", "النعامة"), (46, "Aïn Témouchent", "عين تموشنت"), (47, "Ghardaïa", "غرداية"), (48, "Relizane", "غليزان"),
    (49, "Timimoun", "تيميمون"), (50, "Bordj Badji Mokhtar", "برج باجي مختار"), (51, "Ouled Djellal", "أولاد جلال"), (52, "Béni Abbès", "بني عباس"), (53, "In Salah", "عين صالح"),
    (54, "In Guezzam", "عين قزام"), (55, "Touggourt", "تقرت"), (56, "Djanet", "جانت"), (57, "El M'Ghair", "المغير"), (58, "El Meniaa", "المنيعة"),
]
#: Other Latin spellings; every Latin name's own match key is one as well.
WILAYA_ALIASES = {
    "chelif": 2, "oum el bouagh": 4, "bgayet": 6, "vgayet": 6, "tamanghasset": 11, "algerie": 16, "msila": 28, "wahran": 31, "ouedsouf": 39, "elmeghair": 57, "menia": 58,
}


def category_phrases(least: int = 3) -> dict[str, list[str]]:
    """Each category's different phrases, as match keys of at least three characters."""
    from tamarind.functions.text import match_key

    found = {c: dict.fromkeys(match_key(p) for by in words.values() for p in by) for c, words in CATEGORY_LEXICONS.items()}
    return {c: [p for p in phrases if len(p) >= least] for c, phrases in found.items()}


def wilaya_names() -> dict[str, int]:
    """Every name of a province as a match key, with its number."""
    from tamarind.functions.text import match_key

    own = {match_key(n): code for code, *names in WILAYAS for n in names}
    return own | WILAYA_ALIASES
