"""Keyword lists and the expressions that apply them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"\W+"

# The keywords of each intent.  The order of the intents decides ties.
INTENT_KEYWORDS: dict[str, tuple[str, ...]] = {
    "disease": (
        "disease", "blight", "rust", "rot", "scab", "mold", "mildew", "spots", "yellow", "brown",
        "wilt", "infection", "fungus", "leaves", "leaf", "photo", "image", "upload", "scan",
        "detect", "sick", "infected", "dying", "पत्ती", "बीमारी", "रोग", "कीट", "rog", "bimari",
        "patti", "keeda",
    ),
    "price": (
        "price", "rate", "mandi", "market", "sell", "buy", "cost", "forecast", "predict", "trend",
        "dal", "quintal", "wholesale", "retail", "monsoon", "season", "कीमत", "दाम", "मंडी",
        "बाजार", "भाव", "बेचना", "kimat", "daam", "bazaar", "bhav", "bechna",
    ),
    "scheme": (
        "scheme", "yojana", "subsidy", "loan", "credit", "insurance", "pm-kisan", "pmfby", "kcc",
        "e-nam", "pmkisan", "government", "benefit", "apply", "registration", "eligibility",
        "sarkari", "sarkar", "labh", "avedan", "योजना", "सब्सिडी", "लाभ", "सरकार", "ऋण", "बीमा",
        "आवेदन",
    ),
    "pesticide": (
        "pesticide", "fertilizer", "spray", "urea", "dap", "npk", "insecticide", "herbicide",
        "fungicide", "weedicide", "dose", "dosage", "organic", "neem", "bio", "chemical",
        "nitrogen", "phosphorus", "potassium", "zinc", "application", "when to apply",
        "how to apply", "कीटनाशक", "खाद", "उर्वरक", "दवा", "छिड़काव", "dawai", "khad", "urvarak",
        "chhidkav", "kitanashak",
    ),
}

# Names looked for in a question, in the order they are tried.
COMMODITY_NAMES: tuple[str, ...] = (
    "wheat", "rice", "paddy", "tomato", "onion", "potato", "soybean", "cotton", "maize", "chilli",
    "gram", "mustard", "banana", "mango", "sugarcane", "groundnut", "jowar", "bajra", "ragi",
    "tur", "urad", "moong", "masoor",
)
CROP_NAMES: tuple[str, ...] = (
    "rice", "wheat", "tomato", "potato", "cotton", "soybean", "maize", "corn", "onion",
    "sugarcane", "grape", "chilli", "pepper", "apple", "banana", "mango",
)

# Where a question of each intent is answered.
INTENT_FEATURES: dict[str, str] = {
    "disease": "disease_tab",
    "price": "price_tab",
    "scheme": "scheme_tab",
    "pesticide": "pesticide_tab",
    "general": "general",
}


def _spaced(text: str) -> str:
    """A keyword as it looks in a text prepared by :func:`searchable`."""
    return f" {re.sub(NON_WORD, ' ', text).strip()} "


def searchable(text: str | Column, whole_word: bool = False) -> Column:
    """Lower-cased text; for whole words, single blanks around every word."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    if not whole_word:
        return text
    return F.concat(F.lit(" "), F.regexp_replace(text, f"(?U){NON_WORD}", " "), F.lit(" "))


def keyword_hits(text: Column, keywords: Sequence[str], whole_word: bool = False) -> Column:
    """How many of the keywords occur in a :func:`searchable` text."""
    wanted = [_spaced(k.lower()) if whole_word else k.lower() for k in keywords]
    found = F.filter(F.array(*map(F.lit, wanted)), lambda k: F.contains(text, k))
    return F.size(found)


def first_name(text: Column, names: Sequence[str]) -> Column:
    """First name of the ordered list in a :func:`searchable` text, capitalised; else null."""
    found = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(text, n))
    return F.initcap(F.get(found, F.lit(0)))
