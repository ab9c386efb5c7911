"""Numbers as text for readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import number_text

#: Language: group separator, decimal sign, whether a currency sign stands behind. Others are written as English.
_LOCALES = {"en": (",", ".", False), "de": (".", ",", True), "fr": (" ", ",", True), "es": (".", ",", True), "it": (".", ",", True), "ja": (",", ".", False), "hi": (",", ".", False)}
_CURRENCIES = {"USD": ("$", 2), "EUR": ("€", 2), "GBP": ("£", 2), "JPY": ("¥", 0), "CNY": ("CN¥", 2), "INR": ("₹", 2)}


def format_number(x: Column, locale: str, currency: str, least: int, most: int) -> Column:
    """Grouped digits with least to most decimals, ties to even; or an amount of a currency with its own decimals."""
    language = locale.split("-")[0].lower()
    group, point, behind = _LOCALES.get(language, _LOCALES["en"])
    sign = _CURRENCIES.get(currency)
    if currency and sign is None:
        sign = (currency, 2)
    if sign:
        least = most = sign[1]
    most = max(least, min(most, 20))
    shown = F.format_number(F.abs(x), most)
    if least < most:
        whole, rest = F.substring_index(shown, ".", 1), F.regexp_replace(F.regexp_extract(shown, r"\.([0-9]*)$", 1), f"(?<=^[0-9]{{{least},20}})0+$", "")
        shown = F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))
    if language == "hi":
        whole = F.replace(F.substring_index(shown, ".", 1), F.lit(","), F.lit(""))
        decimals = F.regexp_extract(shown, r"(\.[0-9]*)$", 1)
        shown = F.concat(F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{2})*[0-9]{3}$)", ","), decimals)
    shown = F.translate(shown, ",.", group + point)
    if sign:
        shown = F.concat(shown, F.lit(" " + sign[0])) if behind else F.concat(F.lit(sign[0]), shown)
    shown = F.when((x < 0) & shown.rlike("[1-9]"), F.concat(F.lit("-"), shown)).otherwise(shown)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), number_text(x)).otherwise(shown)
