"""Page texts and extraction answers to offers. All but the closing of cut-off JSON are column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pricewell.functions import money, parse
from pricewell.functions.semantics import let
from pricewell.functions.text import dedupe_key, normalize_unit, sanitize_name, squeeze_space, strip_unknown, title_case
from pricewell.sources.scratch import dealt

# A pair of prices, a new price, instalment and cash lines, lines that are no name, and what a name sheds.
PAIR = r"(?i)DE\s*R?\$?\s*([\d.,]+)\s*POR\s*R?\$?\s*([\d.,]+)"
NEW_PRICE = r"(?i)POR\s*R?\$?\s*([\d.,]+)"
INSTALMENT_LINES = (r"(?i)^\d{1,2}\s*[xX]\b", r"(?i)^ou\s+\d{1,2}\s*[xX]")
CASH_OR_PARTS = r"(?i)\d{1,2}\s*[xX]\b|à\s*vista|a\s*vista"
NOISE_LINES = (r"^\d+%$", r"(?i)^(oferta|promo|leve|pague|validade|encarte|página)", r"(?i)^(DE|POR|R\$|A\s*PARTIR)?\s*R?\$?\s*\d{1,3}(?:\.\d{3})*,\d{2}$")
NAME_SHEDS = (money.PRICE, r"(?i)\bR\$\b", r"(?i)\b(DE|POR|A\s*PARTIR\.?)\b")
EVIDENCE = "struct<text:string,source:string,page:int>"
CONDITIONS = "array<struct<type:string,name:string,description:string,requirement:string>>"
JSON_OFFERS = (
    "confidence double, validFrom string, validUntil string, offers array<struct<name:string,brand:string,quantity:string,unit:string,price:string,originalPrice:string,cashPrice:string,"
    f"installmentCount:string,installmentAmount:string,installmentInterestFree:string,eligibility:string,conditions:{CONDITIONS},evidence:{EVIDENCE},confidence:string>>"
)


def clean_name(x: Column) -> Column:
    for pattern in NAME_SHEDS:
        x = F.regexp_replace(x, pattern, " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def noise_line(x: Column) -> Column:
    hit = F.length(x) < 2
    for pattern in NOISE_LINES:
        hit = hit | x.rlike(pattern)
    return hit


def _name_above(i: Column) -> Column:
    """The name above line ``i``: behind noise the nearest line, and up to two before it, until noise or a line of several prices."""
    low = F.greatest(i - 6, F.lit(0))
    is_noise, prices = lambda j: F.get("noise", j), lambda j: F.get("n_prices", j)
    good = lambda j: (j >= low) & ~is_noise(j) & (prices(j) < 2)
    size = lambda at: F.when(~good(at), 0).when(~F.coalesce(good(at - 1), F.lit(False)), 1).when(~F.coalesce(good(at - 2), F.lit(False)), 2).otherwise(3)
    lines = lambda at: let(size(at), lambda n: F.slice("lines", at - n + 2, n))
    parts = F.when(i > 0, let(F.array_max(F.filter(F.sequence(low, i - 1), lambda j: ~is_noise(j))), lines))
    return clean_name(F.coalesce(F.array_join(parts, " "), F.lit("")))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Offers of page texts (page_id, page_number, text, confidence).

    A line with POR that ends a DE ... POR pair, or that follows a line with DE, gives both prices; prices on other lines stand alone and
    weigh less. Names come from the line and the lines above. Of equal names on a page the first stays. Each pattern runs once a
    line; only lines with a price become rows, with the few lines around them.
    """
    lines = F.filter(F.transform(F.split(squeeze_space(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = dealt(pages).select("page_id", "page_number", lines.alias("lines"), F.coalesce("confidence", F.lit(0.5)).alias("conf"))
    p = p.withColumns({"noise": F.transform("lines", noise_line), "prices": F.transform("lines", money.extract_prices)})
    every = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1))  # a filter would be pushed down, and the lines with it
    p = p.withColumn("n_prices", F.transform("prices", lambda x: F.size(x)))
    line = lambda i: F.get("lines", i)
    near = lambda i, before, after: F.slice("lines", F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)) + after)
    joined = lambda i: F.array_join(near(i, 5, 2), " ")
    kind = lambda i: F.when(~line(i).rlike("(?i)POR"), 0).when(joined(i).rlike(PAIR), 1).when(line(i).rlike(NEW_PRICE) & (i > 0) & line(i - 1).rlike("(?i)DE"), 2).otherwise(0)
    p = p.withColumn("kind", F.transform(every, kind))
    parts = lambda i: line(i).rlike(INSTALMENT_LINES[0]) | line(i).rlike(INSTALMENT_LINES[1])
    taken = lambda i: (F.get("kind", i) > 0) | F.coalesce(F.get("kind", i + 1) > 0, F.lit(False))
    use = F.filter(every, lambda i: (F.get("kind", i) > 0) | (~taken(i) & (F.get("n_prices", i) > 0) & ~parts(i)))
    r = p.withColumn("i", F.explode(use))
    i = F.col("i")
    r = r.select(
        "page_id", "page_number", "i", F.get("kind", i).alias("kind"), line(i).alias("line"), F.get("prices", i).alias("ps"), _name_above(i).alias("above"),
        F.when(F.get("kind", i) == 1, joined(i)).alias("joined"), F.when(F.get("kind", i) == 2, line(i - 1)).alias("before"),
        F.array_join(F.when(F.get("kind", i) > 0, near(i, 5, 3)).otherwise(near(i, 4, 3)), "\n").alias("raw"),
        (F.col("conf") * F.when(F.get("kind", i) > 0, 1.0).when(F.exists("kind", lambda x: x > 0), 0.75).otherwise(0.85)).alias("confidence"),
    )
    part = lambda text, pattern, k: money.parse_brl(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")))
    ps = F.sort_array("ps", asc=False)
    high, low = F.get(ps, F.lit(0)), F.get(ps, F.lit(1))
    two = (F.size("ps") >= 2) & ~F.col("line").rlike(CASH_OR_PARTS)
    gap = two & (high / low >= 1.02)
    own = clean_name(F.col("line"))
    alone_name = F.when(F.length(own) < 3, F.col("above")).when(F.length("above") >= 3, clean_name(F.concat_ws(" ", "above", own))).otherwise(own)
    r = r.withColumns({
        "price": F.when(F.col("kind") == 1, part("joined", PAIR, 2)).when(F.col("kind") == 2, part("line", NEW_PRICE, 1)).when(gap, low).when(two, F.element_at("ps", -1)).otherwise(F.get("ps", F.lit(0))),
        "original": F.when(F.col("kind") == 1, part("joined", PAIR, 1)).when(F.col("kind") == 2, part("before", r"([\d.,]+)", 1)).when(gap, high),
        "name": F.when(F.col("kind") > 0, F.col("above")).otherwise(alone_name),
    })
    r = r.withColumn("name", F.substring("name", 1, 200))
    text = F.concat_ws("\n", "name", F.substring("raw", 1, 1000))
    r = r.withColumn("hay", text)
    r = r.withColumn("t", money.payment_from_text(F.col("hay")))
    r = r.withColumn("pay", money.shape_payment(F.col("price"), F.col("t.cash_price"), F.col("original"), F.col("t.installment_count"), F.col("t.installment_amount"), F.col("hay")))
    # no filter before the grouping: it would be pushed down, and every column's expression with it
    good = (F.length("name") >= 3) & ((F.col("kind") > 0) | ~F.col("name").rlike(r"^[\d\s.,/-]+$")) & F.col("pay.price").isNotNull()
    r = r.withColumn("good", good)
    first_of = F.when(F.col("kind") > 0, F.when(F.col("raw").rlike(money.QUANTITY), F.col("raw")).otherwise(F.col("name"))).otherwise(F.concat_ws("\n", "name", "line"))
    number, unit = (F.regexp_extract(first_of, money.QUANTITY, k) for k in (1, 2))
    none = F.lit(None)
    r = r.withColumn("hits", parse.eligibility_phrases(F.col("hay")))
    r = r.withColumn("e", parse.resolve_eligibility(F.col("hits.type"), none.cast("string"), none.cast("array<string>"), none.cast("double"), none.cast("string")))
    out = r.select(
        "page_id", "page_number", F.when(F.col("kind") > 0, 1).otherwise(2).alias("pass"), "i", "name", F.when(number != "", F.concat(number, F.lower(unit))).alias("quantity"),
        F.col("pay.price").alias("price"), F.col("pay.original_price").alias("original_price"), F.col("pay.cash_price").alias("cash_price"), F.col("pay.installment_count").alias("installment_count"), F.col("pay.installment_amount").alias("installment_amount"),
        F.col("t.interest_free").alias("interest_free"), F.when(F.col("pay.original_price").isNotNull(), money.discount_parser(F.col("pay.original_price"), F.col("pay.price"))).alias("discount_percentage"),
        F.col("e.type").alias("eligibility"), F.col("e.types").alias("conditions"), F.col("e.confidence").alias("eligibility_confidence"), F.get("hits", F.lit(0))["text"].alias("eligibility_evidence"), F.col("e.status").alias("eligibility_status"),
        F.substring("raw", 1, 1000).alias("raw_text"), "confidence", "good",
    )
    first = out.groupBy("page_id", F.lower("name").alias("_k")).agg(F.min_by(F.struct(*out.columns), F.when(F.col("good"), F.struct("pass", "i"))).alias("r"))
    return first.filter("r IS NOT NULL").select("r.*").drop("pass", "i", "good")


@F.pandas_udf(StringType())
def close_json(texts: pd.Series) -> pd.Series:
    """Brackets and strings that a cut-off answer leaves open are closed."""

    def close(text: str | None) -> str | None:
        if text is None:
            return None
        open_, quoted, escaped = [], False, False
        for c in text:
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c == '"':
                quoted = True
            elif c in "{[":
                open_.append("}" if c == "{" else "]")
            elif c in "}]" and open_:
                open_.pop()
        return text.rstrip().rstrip(",") + '"' * quoted + "".join(reversed(open_))

    return texts.map(close)


@F.pandas_udf(StringType())
def whole_records(texts: pd.Series) -> pd.Series:
    """A cut-off answer up to its last complete record, closed."""

    def cut(text: str | None) -> str | None:
        open_, quoted, escaped, best = [], False, False, None
        for k, c in enumerate(text or ""):
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c == '"':
                quoted = True
            elif c in "{[":
                open_.append("}" if c == "{" else "]")
            elif c in "}]" and open_:
                open_.pop()
                best = (k + 1, "".join(reversed(open_)))
        return text[: best[0]] + best[1] if best else None

    return texts.map(cut)


def parsed_answers(pages: DataFrame, column: str = "raw") -> DataFrame:
    """``pages`` with the answer ``j``: as it is if it is JSON, else mended, else cut off and closed.

    One pass: each text is tried in turn, and only what neither is nor can be mended to JSON reaches Python (all others go there as nulls).
    """
    good = lambda x: F.try_parse_json(x).isNotNull()
    p = pages.withColumn("_whole", good(F.col(column)))
    p = p.withColumn("_mended", F.when(~F.col("_whole"), parse.mend_json(F.col(column))))
    p = p.withColumn("_fits", good(F.col("_mended")))
    p = p.withColumn("_cut", F.when(~F.col("_whole") & ~F.col("_fits"), parse.unfenced(F.col(column))))
    p = p.withColumns({"_closed": close_json("_cut"), "_records": whole_records("_cut")})
    p = p.withColumn("_closed", F.when(F.col("_closed").isNotNull(), parse.mend_json(F.col("_closed"))))
    text = F.when(F.col("_whole"), F.col(column)).when(F.col("_fits"), F.col("_mended")).when(good(F.col("_closed")), F.col("_closed")).when(F.col("_records").isNotNull(), parse.mend_json(F.col("_records")))
    return p.withColumn("j", F.from_json(text, JSON_OFFERS)).drop("_whole", "_mended", "_fits", "_cut", "_closed", "_records")


def offers_from_json(pages: DataFrame, column: str = "raw") -> DataFrame:
    """Offers of extraction answers (page_id, page_number, raw): lenient JSON, guards, first of equals.

    With each offer stand its conditions and evidence (a phrase's, else the model's own), whether instalments are free of interest, the offer as JSON (``raw_text``) and the
    answer's own confidence.

    Names of under three characters or of digits alone and prices out of range are dropped. Cash wins over count times amount, that over the
    price. A missing confidence is 0.7. A cut-off answer keeps its complete records.
    """
    p = parsed_answers(dealt(pages), column).select("page_id", "page_number", F.col("j.validFrom").alias("valid_from"), F.col("j.validUntil").alias("valid_until"), F.col("j.confidence").alias("page_confidence"), F.posexplode("j.offers").alias("n", "o"))
    name = sanitize_name(F.coalesce(strip_unknown(F.col("o.name")), F.lit("")))
    p = p.withColumn("name", name)  # names that are none go with the grouping: a filter would be pushed down, and the name's expression with it
    blank = lambda c: F.coalesce(c, F.lit(""))
    cash_text = F.when(money.to_number(F.col("o.cashPrice")).isNotNull() & ~F.col("o.cashPrice").rlike(r"^[\d.]+$"), F.col("o.cashPrice"))
    p = p.withColumn("hay", F.concat_ws(" ", "name", blank(F.to_json("o.evidence")), blank(F.to_json("o.conditions")), blank(cash_text)))
    amount = money.to_number(F.col("o.installmentAmount"))
    count = money.instalment_count(F.trim("o.installmentCount").try_cast("double"))
    p = p.withColumn("pay", money.shape_payment(money.to_number(F.col("o.price")), money.to_number(F.col("o.cashPrice")), money.to_number(F.col("o.originalPrice")), count, amount, F.col("hay")))
    known = lambda t: F.when(t.isin(*parse.TYPE_RANK), t)
    told = F.col("o.confidence").try_cast("double")
    sure = F.when(told.isNotNull(), F.least(F.greatest(told, F.lit(0.0)), F.lit(1.0)))
    p = p.withColumns({"hits": parse.eligibility_phrases(F.col("hay")), "conditions": parse.unique_conditions(F.col("o.conditions")), "sure": sure})
    p = p.withColumn("e", parse.resolve_eligibility(F.col("hits.type"), known(F.col("o.eligibility")), F.col("conditions.type"), F.col("sure"), F.substring(F.trim("o.evidence.text"), 1, 400)))
    own = parse.evidence(F.col("o.evidence.text"), F.col("o.evidence.source"), F.col("o.evidence.page"), F.col("page_number"))
    ruled = F.size("hits") > 0
    first_hit = F.get("hits", F.lit(0))["text"]
    p = p.withColumn("own_evidence", own).withColumn("own_conditions", F.when(F.col("own_evidence").isNotNull(), F.col("conditions")).otherwise(F.array().cast(CONDITIONS)))
    none = F.lit(None).cast("string")
    by_rule = F.transform("hits", lambda h: F.struct(h["type"].alias("type"), none.alias("name"), h["text"].alias("description"), none.alias("requirement")))
    more = F.filter("own_conditions", lambda c: ~F.array_contains(F.col("hits.type"), c["type"]))
    alone = F.transform("e.types", lambda t: F.struct(t.alias("type"), none.alias("name"), none.alias("description"), none.alias("requirement")))
    p = p.withColumn("told_conditions", F.when(ruled, parse.unique_conditions(F.concat(by_rule, more))).when(F.size("own_conditions") > 0, F.col("own_conditions")).otherwise(alone))
    p = p.withColumn("evidence", F.when(ruled, F.struct(first_hit.alias("text"), F.lit("rules").alias("source"), F.col("page_number").alias("page"))).when((F.size("e.types") > 0) | (F.col("e.type") == "UNKNOWN"), F.col("own_evidence")))
    told_free = F.when(F.lower("o.installmentInterestFree") == "true", F.lit(True)).when(F.lower("o.installmentInterestFree") == "false", F.lit(False)).when(F.col("o.installmentInterestFree").rlike(r"(?i)sem\s+juros"), F.lit(True))
    out = p.select(
        "page_id", "page_number", "n", F.substring("name", 1, 200).alias("name"), title_case(strip_unknown(F.col("o.brand"))).alias("brand"), strip_unknown(F.col("o.quantity")).alias("quantity"), normalize_unit(strip_unknown(F.col("o.unit"))).alias("unit"),
        F.col("pay.price").alias("price"), F.col("pay.original_price").alias("original_price"), F.col("pay.cash_price").alias("cash_price"), F.col("pay.installment_count").alias("installment_count"), F.col("pay.installment_amount").alias("installment_amount"), money.interest_free(told_free, F.col("hay")).alias("interest_free"),
        F.when(F.col("pay.original_price").isNotNull(), money.discount_guard(F.col("pay.original_price"), F.col("pay.price"))).alias("discount_percentage"), F.coalesce(money.to_number(F.col("o.confidence")), F.lit(0.7)).alias("confidence"),
        F.col("e.type").alias("eligibility"), F.col("told_conditions").alias("conditions"), F.col("e.confidence").alias("eligibility_confidence"), F.col("e.status").alias("eligibility_status"), "evidence", "valid_from", "valid_until", "page_confidence", ((F.length("name") >= 3) & ~F.col("name").rlike(r"^\d+$") & F.col("pay.price").isNotNull()).alias("good"),
    )
    told = F.to_json(F.struct("name", "price", F.col("original_price").alias("originalPrice"), F.col("cash_price").alias("cashPrice"), F.col("installment_count").alias("installmentCount"), F.col("installment_amount").alias("installmentAmount"), "quantity", "brand", "eligibility", F.col("evidence.text").alias("evidence")))
    out = out.withColumn("raw_text", F.substring(F.regexp_replace(told, r"(:-?\d+)\.0([,}])", "$1$2"), 1, 1000))
    key = F.concat_ws("|", dedupe_key(F.col("name")), blank(dedupe_key(F.col("brand"))), blank(F.col("quantity")), blank(F.col("unit")))
    first = out.groupBy("page_id", "page_number", key.alias("_k")).agg(F.min_by(F.struct(*out.columns), F.when(F.col("good"), F.col("n"))).alias("r"))
    return first.filter("r IS NOT NULL").select("r.*").drop("n", "good")
