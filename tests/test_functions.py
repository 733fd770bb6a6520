"""Worked examples for column expressions, one row each."""

import pytest
from pyspark.sql import functions as F

from pricewell.functions import dates, geo, money, parse, semantics, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict(recursive=True)


def test_rounding_is_half_towards_plus_infinity(spark):
    r = one(spark, a=semantics.half_up(F.lit(-2.5)), b=semantics.half_up(F.lit(2.5)), c=semantics.half_up(F.lit(1.005), 1), d=semantics.spread_pct(F.lit(0.0), F.lit(5.0)), e=semantics.spread_pct(F.lit(0.0), F.lit(5.0), 0.0))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (-2.0, 3.0, 1.0, None, 0.0)


def test_numbers(spark):
    values = {"1,5": 1.5, "1.234,56": None, "1.5d": None, "NaN": None, " ": 0.0, "7": 7.0, "1,2,3": None}
    for k, v in values.items():
        assert one(spark, x=semantics.number_of(F.lit(k)))["x"] == v, k
    assert one(spark, a=money.to_number(F.lit("R$ 27,99")), b=money.to_number(F.lit("1.299,00")), c=money.parse_brl(F.lit("1.299,00")), d=money.to_number(F.lit("x"))) == {"a": 27.99, "b": 1299.0, "c": 1299.0, "d": None}


def test_validity_windows(spark):
    at, none = F.lit("2024-01-02").cast("timestamp"), F.lit(None).cast("timestamp")
    r = one(spark, a=semantics.valid_at(at, at, at), b=semantics.valid_at(at, none, none), c=semantics.valid_at(at, none, F.lit("2024-01-01").cast("timestamp")))
    assert list(r.values()) == [True, True, False]


def test_text(spark):
    lit = F.lit
    r = one(
        spark,
        norm=text.normalize(lit("  Açúcar-Cristal  5KG! ")),
        title=text.title_case(lit("SÃO luiz/loja-x")),
        slug=text.slug(lit("Pão de Açúcar")),
        unit=text.normalize_unit(lit("KG")),
        unit2=text.normalize_unit(lit("Litros")),
        unit3=text.normalize_unit(lit("dúzia")),
        key=text.match_key(lit("Arroz Camil"), lit(""), lit("1,5"), lit("kilo")),
        unknown=text.strip_unknown(lit(" N/A ")),
        name=text.sanitize_name(lit("Café®  (500g)")),
        dd=text.dedupe_key(lit("Arroz Camil 5 KG")),
        line=text.condition_line(F.array(lit(" a "), lit(""), lit("a"), lit("b"))),
        t=text.interpolate(lit("{{a}}/{{zz}}/{{b}}"), {"a": lit("x"), "b": lit(3)}),
        price=text.brl(lit(1234.5)),
        word=text.first_word(lit(" uno due")),
    )
    assert r == {"norm": "acucar cristal 5kg", "title": "São Luiz/Loja-X", "slug": "pao-de-acucar", "unit": "kg", "unit2": "l", "unit3": None, "key": "arroz camil|1.5|kg", "unknown": None, "name": "Café 500g", "dd": "arroz camil 5kg", "line": "a · b", "t": "x//3", "price": "R$ 1.234,50", "word": "uno"}


def test_matching(spark):
    lit = F.lit
    r = one(spark, a=text.tokens_match(lit("Arroz Tio João"), lit("joao arr")), b=text.tokens_match(lit("x"), lit("a")), c=text.tokens_match(lit(None).cast("string"), lit("ab")), d=text.name_divergence(lit("arroz camil"), lit("sabao em po")), e=text.name_divergence(lit("arroz camil"), lit("arroz tio")))
    assert r == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_three_discounts(spark):
    a, b = F.lit(34.9), F.lit(27.99)
    assert one(spark, x=money.discount_catalogue(a, b), y=money.discount_parser(a, b), z=money.discount_guard(a, b)) == {"x": 19.8, "y": 19.8, "z": 19.8}
    assert one(spark, x=money.discount_catalogue(b, a), y=money.discount_parser(b, a), z=money.discount_guard(b, a)) == {"x": None, "y": 0.0, "z": 0.0}


@pytest.mark.parametrize(
    ("price", "cash", "original", "n", "amount", "hay", "want"),
    [
        (80.5, 700.0, None, 10, 80.5, "", (700.0, None)),
        (80.5, None, None, 10, 80.5, "", (805.0, None)),
        (80.5, None, 805.0, 10, 80.5, "10x", (805.0, None)),
        (6.4, None, 9.8, None, None, "DE 9,80 POR 6,40", (6.4, 9.8)),
        (30.0, None, 20.0, None, None, "", (30.0, None)),
        (0.0, None, None, None, None, "", (None, None)),
    ],
)
def test_payment_shapes(spark, price, cash, original, n, amount, hay, want):
    d = lambda x: F.lit(x).cast("double")
    r = one(spark, p=money.shape_payment(d(price), d(cash), d(original), F.lit(n).cast("int"), d(amount), F.lit(hay)))["p"]
    assert (r["price"], r["original_price"]) == want


def test_payment_from_text(spark):
    r = one(spark, p=money.payment_from_text(F.lit("TV 1.899,00 à vista ou 10x de R$ 199,90 sem juros")))["p"]
    assert r == {"cash_price": 1899.0, "installment_count": 10, "installment_amount": 199.9, "interest_free": True}


def test_eligibility(spark):
    kinds = lambda s: [h["type"] for h in one(spark, h=parse.eligibility_phrases(F.lit(s)))["h"]]
    assert set(kinds("Preço exclusivo clube")) == {"LOYALTY_PROGRAM"}
    assert kinds("aceitamos cartão da loja e bandeiras Visa") == []
    assert kinds("leve 3 com cupom ABC") == ["COUPON_REQUIRED", "COUPON_REQUIRED", "QUANTITY_REQUIRED"]
    assert kinds("exclusivo") == ["UNKNOWN"] and kinds("") == []
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    text_ = lambda x: F.lit(x).cast("string")
    res = lambda rules, kind, kinds, conf, ev: parse.resolve_eligibility(arr(rules), text_(kind), arr(kinds), F.lit(conf).cast("double"), text_(ev))
    r = one(spark, a=res(["APP_ONLY"], "STORE_CARD", [], 0.99, "x"), b=res([], "STORE_CARD", [], 0.9, None), c=res([], "STORE_CARD", ["STORE_CARD"], None, "seen"), d=res([], None, [], None, None), e=res(["APP_ONLY"], "APP_ONLY", [], 0.97, "x"))
    got = {k: (v["type"], v["confidence"], v["status"]) for k, v in r.items()}
    assert got == {"a": ("APP_ONLY", 0.92, "ai_validated"), "b": ("UNKNOWN", 0.5, "review_required"), "c": ("STORE_CARD", 0.75, "review_required"), "d": ("ALL_CUSTOMERS", 0.91, "ai_validated"), "e": ("APP_ONLY", 0.97, "ai_validated")}


def test_stale_titles(spark):
    at = F.lit("2026-08-21 12:00:00").cast("timestamp")
    stale = lambda s: one(spark, x=parse.stale_title(F.lit(s), at))["x"]
    assert stale("Ofertas de 10/08 a 20/08") and stale("Encartes anteriores") and stale("Até 20.08.2026")
    assert not stale("Ofertas de 10/08 a 25/08") and not stale("Sem data") and not stale("10/08 até 30-08-2026")
    assert one(spark, a=parse.semantic(F.lit("click"), F.lit("Ver Encarte")), b=parse.semantic(F.lit("navigation"), F.lit("x")), c=parse.semantic(F.lit("click"), F.lit("x"))) == {"a": "OPEN_FLYERS", "b": "NAVIGATE", "c": None}


def test_urls_and_files(spark):
    k = lambda u: one(spark, k=parse.url_kind(F.lit(u)), i=parse.url_key(F.lit(u)), t=parse.url_title(F.lit(u)))
    assert k("http://a/b/Oferta-da_semana.pdf?x=1") == {"k": "pdf", "i": "http://a/b/Oferta-da_semana.pdf?x=1", "t": "Oferta Da Semana"}
    assert k("http://a/p?id=77#x")["i"] == "id:77" and k("http://a/p#item-3")["i"] == "http://a/p#item-3" and k("http://a/p#top")["i"] == "http://a/p"
    r = one(spark, a=parse.content_type(F.lit(b"\xff\xd8\xff\xe0")), b=parse.content_type(F.lit(b"%PDF-1.7")), c=parse.content_type(F.lit(b"zz")), d=parse.page_set(F.lit("1-3, 5,x,9-7")), e=parse.css_urls(F.lit("a{background:url('x.png')} b{c:url(y.png)}")), f=parse.dates_in(F.lit("de 01/02 a 03/02/2024")))
    assert r == {"a": "image/jpeg", "b": "application/pdf", "c": None, "d": [1, 2, 3, 5], "e": ["x.png", "y.png"], "f": ["01/02", "03/02/2024"]}


def test_validity_dates(spark):
    at = F.lit("2026-08-01 12:00:00").cast("timestamp")
    v = lambda s, until=False: one(spark, x=dates.parse_validity(F.lit(s), at, until=until).cast("string"))["x"]
    assert v("20/08/2026", True) == "2026-08-21 02:59:59"
    assert v("20/08", True) == v("20/08/26", True) == "2026-08-21 02:59:59"
    assert v("13/08/2026") == "2026-08-13 03:00:00"
    assert v("2026-08-13T10:00:00-03:00") == "2026-08-13 13:00:00"
    assert v("1786000000") == v("1786000000000") and v("nonsense") is None


def test_calendar(spark):
    d = F.lit("2024-03-15").cast("date")
    r = one(spark, a=dates.sunday_week(d).cast("string"), b=dates.year_start(d).cast("string"), c=dates.quarter_start(d).cast("string"), d=dates.heat_level(F.lit(9)), e=dates.heat_level(F.lit(-1)), f=dates.backoff_hours(F.lit(3)), g=dates.backoff_hours(F.lit(9)))
    assert r == {"a": "2024-03-10", "b": "2023-04-01", "c": "2024-01-01", "d": 4, "e": 0, "f": 4.0, "g": 8.0}
    z = one(spark, x=dates.days_until(F.lit("2024-01-01 02:00:00").cast("timestamp"), F.lit("2024-01-02 02:00:00").cast("timestamp"), "America/Fortaleza"))["x"]
    assert z == 1


def test_distance(spark):
    r = one(spark, a=geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), b=geo.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert abs(r["a"] - 20015.09) < 0.01 and r["b"] is None


def test_phrases_are_found_whatever_their_letters(spark):
    """Each phrase's word is looked for first; letters that match ASCII ones where case is ignored must not hide it."""
    assert len(parse._WORDS) == len(parse.PHRASES)
    texts = ["EXCLUSIVO CLUBE", "cliente clube", "preço clube", "programa de fidelidade", "CLIENTE CADASTRADO", "cliente ma\u0130s", "clube abc", "cartão da loja", "no cart\u00c3o da", "com cpf", "cpf na nota", "exclu\u017fivo no app", "\u017fo no app só no app", "com cupom", "cupom A12", "pagando com", "no p\u0131x", "leve 3", "a partir de 2", "na compra de", "nada"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse.eligibility_phrases(F.col("t"))["type"].alias("k"))
    for r in got.collect():
        want = [k for k, p in parse.PHRASES if spark.range(1).select(F.lit(r.t).rlike(f"(?iu){p}").alias("x")).first().x]
        assert set(want) == set(r.k), (r.t, want, r.k)


def test_unknown_words_and_numbers(spark):
    df = spark.createDataFrame([(" null ",), ("n/a",), ("nullx",), ("N.A",), ("",), (None,), ("-\u2028",), ("a null",), ("R$ 1.234,50",), ("12",), ("1e3",), (" 7 ",), ("x",)], "t string")
    got = {r.t: (r.u, r.n) for r in df.select("t", text.strip_unknown(F.col("t")).alias("u"), money.to_number(F.col("t")).alias("n")).collect()}
    assert got[" null "] == got["n/a"] == got["N.A"] == got[""] == got[None] == (None, None) and got["-\u2028"][0] is None
    assert (got["nullx"][0], got["a null"][0]) == ("nullx", "a null")
    assert [got[t][1] for t in ("R$ 1.234,50", "12", "1e3", " 7 ", "x")] == [1234.5, 12.0, 1000.0, 7.0, None]
