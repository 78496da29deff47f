"""Salary text and currency expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Working units per year by pay period.
PER_YEAR = {"hour": 2080, "day": 260, "month": 12}
PAY_PERIODS = {"annual": 1, "monthly": 12, "fortnightly": 26, "weekly": 52, "hourly": 2080}
# Rates to the dollar used where no rate table is given.
RATES = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "CAD": 0.73, "AUD": 0.66, "SGD": 0.74, "AED": 0.27, "INR": 0.012}


def to_usd(amount: Column, currency: Column, rates: dict[str, float] = RATES) -> Column:
    """Dollars by a code table; unknown codes give null."""
    code = F.upper(F.trim(currency))
    out = F.lit(None).cast("double")
    for name, rate in rates.items():
        out = F.when(code == name, amount.cast("double") * F.lit(float(rate))).otherwise(out)
    return out


def round_half_up(x: Column) -> Column:
    """.5 goes towards plus infinity."""
    return F.floor(x + 0.5)


def parse_salary(c: Column) -> Column:
    """struct(min, max, currency, known) of free text.

    Mixed periods, more than one currency, no amount or more than two give an
    unknown salary.  Amounts are yearly; a reversed pair is swapped."""
    t = F.trim(c)
    low = F.lower(t)
    kinds = {"hour": r"\b(hour|hourly|hr)\b", "day": r"\b(day|daily)\b", "month": r"\b(month|monthly)\b", "year": r"\b(year|yearly|annual|annum)\b"}
    periods = sum((low.rlike(p).cast("int") for p in kinds.values()), F.lit(0))
    factor = F.lit(1.0)
    for name, n in PER_YEAR.items():
        factor = F.when(low.rlike(kinds[name]), float(n)).otherwise(factor)
    signs = {"EUR": t.contains("€") | low.contains("eur"), "GBP": t.contains("£") | low.contains("gbp"), "USD": t.contains("$") | low.contains("usd")}
    currencies = sum((s.cast("int") for s in signs.values()), F.lit(0))
    currency = F.when(signs["EUR"], "EUR").when(signs["GBP"], "GBP").when(signs["USD"], "USD")
    found = F.array_compact(F.transform(F.regexp_extract_all(t, F.lit(r"[$€£]?\s*\d+(?:[.,]\d+)*(?:\s*[kK])?"), F.lit(0)), _amount))
    yearly = F.transform(found, lambda x: round_half_up(x * factor).cast("double"))
    known = (F.length(t) > 0) & (periods <= 1) & (currencies <= 1) & F.size(found).between(1, 2)
    known = F.coalesce(known, F.lit(False))
    return F.struct(
        F.when(known, F.array_min(yearly)).alias("min"), F.when(known, F.array_max(yearly)).alias("max"),
        F.when(known & (currencies == 1), currency).alias("currency"), known.alias("known"))


def _amount(raw: Column) -> Column:
    token = F.regexp_replace(F.lower(raw), r"[$€£\s]", "")
    thousand = token.endswith("k")
    digits = F.regexp_replace(token, "k$", "")
    plain = F.when(digits.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(digits, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(digits, "^([^,]*),", "$1."))
    return plain.try_cast("double") * F.when(thousand, 1000.0).otherwise(1.0)
