"""Prices: parsing, discounts (three rules that differ on purpose), payment shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewell.functions.semantics import half_up, let, near_money

# Price cap and the patterns of prices and instalments.
PRICE_MAX = 100_000.0
PRICE = r"(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})"
INSTALMENT = r"(\d{1,2})\s*[xX]\s*(?:de\s*)?(?:R\$\s*)?(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})"
QUANTITY = r"(?i)(\d+(?:[.,]\d+)?)\s*(kg|g|ml|l|lt|un|und|unid|pack|pct|cx|fd)\b"


def parse_brl(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def to_number(x: Column) -> Column:
    """Text with or without R$; with a comma, points group thousands."""
    t = F.trim(F.regexp_replace(x, r"(?i)R\$", ""))
    t = F.when(F.contains(t, F.lit(",")), F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), "^([^,]*),", "$1.")).otherwise(t)
    plain = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(x.rlike(plain), x.try_cast("double")).otherwise(F.when(t.rlike(plain), t.try_cast("double")))  # most are a number as they stand


def money_ok(x: Column) -> Column:
    return F.coalesce((x > 0) & (x < PRICE_MAX), F.lit(False))


def extract_prices(x: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(PRICE), F.lit(1)), parse_brl), money_ok)


def discount_catalogue(original: Column, price: Column) -> Column:
    """Null where it is no discount; one place."""
    return F.when((original > 0) & (price < original), half_up((original - price) / original * 100, 1))


def discount_parser(original: Column, price: Column) -> Column:
    """0 where it is no discount; one place."""
    return F.when((original > 0) & (price < original), half_up((original - price) / original * 1000, 0) / 10).otherwise(F.lit(0.0))


def discount_guard(original: Column, price: Column) -> Column:
    """On whole cents, two places, 0 where it is no discount."""
    o, p = half_up(original * 100), half_up(price * 100)
    return F.when((o > 0) & (p < o), half_up((o - p) / o * 10000, 0) / 100).otherwise(F.lit(0.0))


def instalment_count(x: Column) -> Column:
    i = F.floor(x + 0.5)
    return F.when(i.between(2, 48), i.cast("int"))


def interest_free(flag: Column, text: Column) -> Column:
    return F.coalesce(flag, F.when(text.rlike(r"(?i)sem\s+juros"), F.lit(True)))


def payment_from_text(text: Column) -> Column:
    """struct(cash_price, installment_count, installment_amount, interest_free) told by a text."""
    part = lambda k: F.nullif(F.regexp_extract(text, INSTALMENT, k), F.lit(""))
    found = F.struct(parse_brl(part(2)).alias("amount"), instalment_count(part(1).try_cast("double")).alias("count"), extract_prices(text).alias("prices"), text.rlike(r"(?i)à\s*vista|a\s*vista").alias("at_once"))

    def told(k: Column) -> Column:
        amount = F.when(money_ok(k["amount"]), k["amount"])
        others = F.when(amount.isNotNull(), F.filter(k["prices"], lambda p: ~near_money(p, k["amount"]))).otherwise(k["prices"])
        larger = lambda o: F.when(amount.isNotNull(), F.filter(o, lambda p: p > k["amount"])).otherwise(o)
        some = k["at_once"] | (amount.isNotNull() & (F.size(k["prices"]) > 1))
        cash = F.when(some, let(others, lambda o: F.coalesce(F.get(larger(o), F.lit(0)), F.get(o, F.lit(0)))))
        return F.struct(cash.alias("cash_price"), F.when(amount.isNotNull(), k["count"]).alias("installment_count"), amount.alias("installment_amount"), interest_free(F.lit(None).cast("boolean"), text).alias("interest_free"))

    return let(found, told)


def shape_payment(price: Column, cash: Column, original: Column, count: Column, amount: Column, text: Column) -> Column:
    """struct(price, cash_price, original_price, installment_count, installment_amount); price null where none holds.

    Cash wins over count x amount, that over the price. An original price that only repeats the
    instalments, or lies below the price, is dropped.
    """
    ok = lambda x: F.when(money_ok(x), x)
    given = F.struct(price.alias("price"), cash.alias("cash"), original.alias("original"), F.when(count != 0, count).alias("n"), amount.alias("amount"), text.rlike(r"(?i)\bDE\b[\s\S]{0,80}\bPOR\b").alias("pair"))
    valid = lambda g: F.struct(ok(g["price"]).alias("price"), ok(g["cash"]).alias("cash"), ok(g["original"]).alias("original"), g["n"].alias("n"), ok(g["amount"]).alias("amount"), g["pair"].alias("pair"))

    def shaped(k: Column) -> Column:
        n, amt, org = k["n"], k["amount"], k["original"]
        both = n.isNotNull() & amt.isNotNull()

        def kept(p: Column) -> Column:
            fake = F.coalesce(~k["pair"] & (F.coalesce(near_money(org, n * amt), F.lit(False)) | F.coalesce(near_money(org, amt), F.lit(False))), F.lit(False)) | F.coalesce(org < p, F.lit(False))
            return F.struct(p.alias("price"), k["cash"].alias("cash_price"), F.when(~fake, org).alias("original_price"), F.when(both, n).alias("installment_count"), F.when(both, amt).alias("installment_amount"))

        return let(F.coalesce(k["cash"], F.when(both, half_up(n * amt, 2)), k["price"]), lambda p: let(ok(p), kept))

    return let(let(given, valid), shaped)


def public_payment() -> Column:
    """struct of the four stored payment fields."""
    return F.struct(*[F.col(c) for c in ("cash_price", "installment_count", "installment_amount", "installment_interest_free")])
