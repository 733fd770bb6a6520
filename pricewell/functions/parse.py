"""Texts to structured values: eligibility phrases, URLs, files, page ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewell.functions.dates import parse_validity
from pricewell.functions.semantics import let

# Eligibility types and the phrases that tell them, in the order in which they are reported.
PHRASES = (
    ("LOYALTY_PROGRAM", r"exclusiv[oa]\s+(para\s+)?(os\s+)?(clientes?\s+)?(do\s+)?clube"),
    ("LOYALTY_PROGRAM", r"cliente\s+clube"),
    ("LOYALTY_PROGRAM", r"pre[cç]o\s+(do\s+|exclusivo\s+)?clube"),
    ("LOYALTY_PROGRAM", r"programa\s+de\s+fidelidade"),
    ("LOYALTY_PROGRAM", r"cliente\s+cadastrad"),
    ("LOYALTY_PROGRAM", r"cliente\s+mais\b"),
    ("LOYALTY_PROGRAM", r"\bclube\s+[a-záàâãéêíóôõú]{3,}"),
    ("STORE_CARD", r"cart[aã]o\s+(da\s+loja|do\s+supermercado|atacad\w*)"),
    ("STORE_CARD", r"no\s+cart[aã]o\s+(da|do)\b"),
    ("CPF_REQUIRED", r"(pre[cç]o\s+)?(com|mediante|exclusiv[oa])\s+cpf"),
    ("CPF_REQUIRED", r"\bcpf\s+(na\s+nota|obrigat)"),
    ("APP_ONLY", r"exclusiv[oa]\s+(no\s+)?(app|aplicativo)"),
    ("APP_ONLY", r"(somente|s[oó]|apenas)\s+no\s+(app|aplicativo)"),
    ("COUPON_REQUIRED", r"(com|use\s+o|usando)\s+cupom"),
    ("COUPON_REQUIRED", r"\bcupom\s+[a-z0-9]{3,}"),
    ("PAYMENT_METHOD", r"pagando\s+com\b"),
    ("PAYMENT_METHOD", r"\bno\s+pix\b"),
    ("QUANTITY_REQUIRED", r"leve\s+\d+"),
    ("QUANTITY_REQUIRED", r"a\s+partir\s+de\s+\d+"),
    ("QUANTITY_REQUIRED", r"na\s+compra\s+de\b"),
)
UNKNOWN_HINT = r"exclusiv[oa]\b"
INSTITUTIONAL = r"aceitamos\s+cart|bandeiras|visa|mastercard|hipercard"
# A word that every text with the phrase holds, in the order of PHRASES.
_WORDS = ("clube", "clube", "clube", "fidelidade", "cadastrad", "mais", "clube", "cart", "cart", "cpf", "cpf", "exclusiv", "no", "cupom", "cupom", "pagando", "pix", "leve", "partir", "compra")
_TRIGGER = r"(?iu)clube|cliente|fidelidade|cart[aã]o|cpf|app|aplicativo|cupom|pagando|pix|leve|partir|compra|exclusiv"
# Which type leads when a text tells several.
TYPE_RANK = ("UNKNOWN", "QUANTITY_REQUIRED", "COUPON_REQUIRED", "APP_ONLY", "CPF_REQUIRED", "STORE_CARD", "PAYMENT_METHOD", "LOYALTY_PROGRAM", "ALL_CUSTOMERS")


def eligibility_phrases(text: Column) -> Column:
    """array(struct(type, text)) of the phrases in a text; a bare hint of exclusivity alone is UNKNOWN."""
    none = F.array().cast("array<struct<type:string,text:string>>")

    def hit(t: Column, kind: str, pattern: str) -> Column:
        use = t.rlike(f"(?iu){pattern}")
        if kind == "STORE_CARD":
            use = use & ~t.rlike(f"(?i){INSTITUTIONAL}")
        return F.when(use, F.struct(F.lit(kind).alias("type"), F.trim(F.regexp_extract(t, f"(?iu)({pattern})", 1)).alias("text")))

    def found(t: Column) -> Column:
        told = lambda h: F.concat_ws(":", h["type"], F.lower(h["text"]))
        # a plain search for the phrase's word comes first; four letters match ASCII ones where case is ignored and do not become them in lower case
        plain = F.lower(F.translate(t, "\u017f\u212a\u0131\u0130", "skii"))
        found_ = let(plain, lambda low: F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), hit(t, *p)) for w, p in zip(_WORDS, PHRASES, strict=True)]), lambda h: h.isNotNull()))
        some = let(found_, lambda hs: F.filter(hs, lambda h, i: F.array_position(F.transform(hs, told), told(h)) == i + 1))
        bare = F.when(t.rlike(f"(?i){UNKNOWN_HINT}"), F.array(F.struct(F.lit("UNKNOWN").alias("type"), F.trim(F.regexp_extract(t, f"(?i)({UNKNOWN_HINT})", 1)).alias("text")))).otherwise(none)
        return let(some, lambda s: F.when(F.size(s) > 0, s).otherwise(bare))

    # one pattern tells for most texts that no phrase can be there
    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), lambda t: F.when(t.rlike(_TRIGGER), found(t)).when(t.isNotNull(), none))


def primary_type(types: Column) -> Column:
    """The leading type of an array; ALL_CUSTOMERS if there is none."""
    return F.coalesce(F.get(F.array_intersect(F.array(*map(F.lit, TYPE_RANK)), types), F.lit(0)), F.lit("ALL_CUSTOMERS"))


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.9, "HIGH").when(x >= 0.7, "MEDIUM").otherwise("LOW")


def eligibility_status(x: Column) -> Column:
    return F.when(x >= 0.9, "ai_validated").otherwise("review_required")


def resolve_eligibility(rule_types: Column, ai_type: Column, ai_types: Column, ai_confidence: Column, ai_evidence: Column) -> Column:
    """struct(type, types, confidence, status) of an offer, from phrases and from a model's answer.

    Phrases win. The model's answer counts only with evidence; without it a single claim becomes UNKNOWN and
    conditions are dropped.
    """
    none = F.array().cast("array<string>")
    proven_, claims_ = F.coalesce(F.trim(ai_evidence) != "", F.lit(False)), ai_type.isNotNull() & (ai_type != "ALL_CUSTOMERS")
    given = F.struct((F.size(F.coalesce(rule_types, none)) > 0).alias("some"), proven_.alias("proven"), F.when(proven_, F.coalesce(ai_types, none)).otherwise(none).alias("own"), F.when(claims_ & ~proven_, F.when(F.size(F.coalesce(ai_types, none)) == 0, "UNKNOWN")).otherwise(ai_type).alias("kind"))

    def typed(g: Column) -> Column:
        some, proven, own, kind = g["some"], g["proven"], g["own"], g["kind"]
        claims = F.coalesce(kind != "ALL_CUSTOMERS", F.lit(False))
        types = F.when(some, F.array_union(rule_types, own)).when(proven & (F.size(own) > 0), F.array_distinct(own)).when(proven & claims, F.array(kind)).otherwise(none)
        return let(types, lambda ts: let(sure(g, claims, ts), lambda c: F.struct(final(kind, ts).alias("type"), ts.alias("types"), c.alias("confidence"), eligibility_status(c).alias("status"))))

    def final(kind: Column, types: Column) -> Column:
        return F.when(F.size(types) > 0, primary_type(types)).when(kind == "UNKNOWN", "UNKNOWN").otherwise("ALL_CUSTOMERS")

    def sure(g: Column, claims: Column, types: Column) -> Column:
        agrees = claims & F.array_contains(types, g["kind"]) & ai_confidence.isNotNull()
        conf = (
            F.when(g["some"], F.when(agrees, F.greatest(F.lit(0.92), ai_confidence)).otherwise(0.92))
            .when(g["proven"] & ((F.size(g["own"]) > 0) | claims), F.coalesce(ai_confidence, F.lit(0.75)))
            .when(g["kind"] == "UNKNOWN", F.coalesce(ai_confidence, F.lit(0.42)))
            .otherwise(F.coalesce(ai_confidence, F.lit(0.91)))
        )
        # no type and yet UNKNOWN: a claim without evidence
        return F.when((F.size(types) == 0) & F.coalesce(g["kind"] == "UNKNOWN", F.lit(False)), F.least(conf, F.lit(0.5))).otherwise(conf)

    return let(given, typed)


# Words that mark a listing as archived; a date in a title, and a range of two.
ARCHIVE = r"(?i)anteriores|arquiv|edi[cç][oõ]es?\s+passad|encartes?\s+antig"
_DATE = r"\d{1,2}\s*[./-]\s*\d{1,2}(?:\s*[./-]\s*\d{2,4})?"


def stale_title(title: Column, as_of: Column, zone: str = "America/Fortaleza") -> Column:
    """Whether a listing's title is of an archive, or its last date (a range's end, if there is a range) has passed."""
    ranged = F.regexp_extract(title, rf"(?i){_DATE}\s+a\s+({_DATE})", 1)
    last = F.when(ranged != "", ranged).otherwise(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(title, F.lit(f"({_DATE})"), F.lit(1))), -1))
    until = parse_validity(F.regexp_replace(F.regexp_replace(last, r"\s", ""), "[.-]", "/"), as_of, zone, until=True)
    return title.rlike(ARCHIVE) | F.coalesce(until < as_of, F.lit(False))


def semantic(kind: Column, text: Column) -> Column:
    """What a recorded step is for, by the words on it."""
    t = F.lower(text)
    return F.when(t.rlike("estado|uf|state"), "SELECT_STATE").when(t.rlike("cidade|city"), "SELECT_CITY").when(t.rlike("loja|store|filial"), "OPEN_STORE").when(t.rlike("encarte|flyer|catalog|oferta|promo"), "OPEN_FLYERS").when(kind == "navigation", "NAVIGATE")


def content_type(data: Column) -> Column:
    """File type by its first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("25504446"), "application/pdf")
    )


def url_kind(url: Column) -> Column:
    """pdf, page_image, media, policy or page."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return (
        F.when(path.rlike(r"\.pdf$"), "pdf")
        .when(path.rlike(r"\.(jpe?g|png|webp)$"), "page_image")
        .when(path.rlike(r"\.(mp4|mp3|gif|svg|css|js|woff2?)$"), "media")
        .when(path.rlike(r"(privacidade|privacy|termos|terms|cookies?|politica|policy)"), "policy")
        .otherwise("page")
    )


def url_key(url: Column) -> Column:
    """What identifies a document: its id parameter, or the URL without fragment (``#item-N`` stays)."""
    ident = F.regexp_extract(url, r"[?&]id=([^&#]+)", 1)
    item = F.regexp_extract(url, r"(#item-\d+)$", 1)
    return F.when(ident != "", F.concat(F.lit("id:"), ident)).otherwise(F.concat(F.regexp_replace(url, r"#.*$", ""), item))


def url_title(url: Column) -> Column:
    """Words of the last path segment, each with a capital."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]+?)(?:\.[a-zA-Z0-9]{1,5})?/?$", 1)
    return F.initcap(F.trim(F.regexp_replace(last, r"[-_+]+|%20", " ")))


def css_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""url\(\s*['"]?([^'")]+?)['"]?\s*\)"""), F.lit(1))


def page_set(x: Column) -> Column:
    """``1-3,5`` as a sorted array of page numbers; parts that are no range are skipped."""
    parts = F.filter(F.split(F.regexp_replace(x, r"\s", ""), ","), lambda p: p.rlike(r"^\d{1,6}(-\d{1,6})?$"))
    first = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    last = lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int")
    good = F.filter(parts, lambda p: first(p) <= last(p))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda p: F.sequence(first(p), last(p))))))


def dates_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d{1,2}/\d{1,2}(?:/\d{2,4})?)"), F.lit(1))


def unfenced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*\s*", ""), r"(?s)\s*```\s*$", "")


def mend_json(text: Column) -> Column:
    """Without code fences and trailing commas, cut to the outermost braces. For texts that are no JSON as they are."""
    inner = unfenced(text)
    cut = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(F.when(cut != "", cut).otherwise(inner), r",\s*([}\]])", "$1")


def unique_conditions(x: Column) -> Column:
    """Conditions of a known type other than ALL_CUSTOMERS, texts trimmed to 200 characters, the first of each type and name."""
    short = lambda c: F.nullif(F.substring(F.trim(c), 1, 200), F.lit(""))
    kinds = [t for t in TYPE_RANK if t != "ALL_CUSTOMERS"]
    known_ = F.transform(F.filter(F.coalesce(x, F.array().cast("array<struct<type:string,name:string,description:string,requirement:string>>")), lambda c: c["type"].isin(*kinds)), lambda c: F.struct(c["type"].alias("type"), short(c["name"]).alias("name"), short(c["description"]).alias("description"), short(c["requirement"]).alias("requirement")))
    key = lambda c: F.concat_ws(":", c["type"], F.lower(F.coalesce(c["name"], F.lit(""))))
    first = lambda known: F.when(F.size(known) < 2, known).otherwise(let(F.transform(known, key), lambda keys: F.filter(known, lambda c, i: F.array_position(keys, key(c)) == i + 1)))
    return let(known_, first)


def evidence(text: Column, source: Column, page: Column, default_page: Column) -> Column:
    """struct(text, source, page), or null without a text."""
    t, s = F.trim(text), F.trim(source)
    return F.when(F.coalesce(t, F.lit("")) != "", F.struct(F.substring(t, 1, 400).alias("text"), F.coalesce(F.nullif(F.substring(s, 1, 40), F.lit("")), F.lit("flyer")).alias("source"), F.coalesce(page, default_page).alias("page")))


# Words by which addresses of documents, pages, pictures and policies are known.
POLICY_WORDS = r"(?i)cookie|privacidade|privacy|lgpd|termos|pol[ií]tica"
SHOP_WORDS = r"(?i)productcluster|productsquery|productgallery|vtexcommercestable|sku"
FLYER_WORDS = r"(?i)/Flyer/\?id=|/Flyer/thumbnail|/flyer/|flipbook|/flip(/|\?|$)|api-middleware-flyer-services|flyer-services|/encartes?/|/folhetos?/|/jornais?/"
PICTURE_BAD = r"(?i)productcluster|productsquery|sku|icon|logo|sprite|favicon|avatar|pixel"
PICTURE_WORDS = r"(?i)jornal|encarte|oferta|flyer|catalog|folheto|flipbook|/pages?/|pagina|página|mercadapp|cloudfront|cdn"
APP_WORDS = r"(?i)\bapp\b|aplicativo|play\s*store|app\s*store|google\s*play|apple\s*store|ganhe\s+desconto"
DOWNLOAD_WORDS = r"(?i)ver\s*pdf|abrir\s*pdf|baixar(\s|$)|download|salvar(\s+pdf)?"
DOWNLOAD_FLYER = r"(?i)baixe.+(jornal|folheto|encarte|pdf|página|pagina)"
GENERIC_TITLE = r"(?i)^(ver\s+(o\s+)?(encarte|folheto|jornal)(\s+completo)?|baixar|download)$"


def policy_url(u: Column) -> Column:
    return u.rlike(POLICY_WORDS)


def junk_url(u: Column) -> Column:
    """Policies, jumps to a page's content, and the bare index of flyers."""
    fragment = F.regexp_extract(u, r"#(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*", ""), r"/+$", "")
    return policy_url(u) | fragment.rlike("(?i)content|main|primary|skip") | path.rlike("(?i)/encartes$")


def flyer_url(u: Column) -> Column:
    document = u.rlike(r"(?i)\.pdf(\?|#|$)")
    picture = u.rlike(r"(?i)\.(jpe?g|png|webp)(\?|#|$)")
    return u.rlike("(?i)^(https?://|/)") & ~junk_url(u) & ~u.rlike(SHOP_WORDS) & (document | (~picture & u.rlike(FLYER_WORDS)))


def page_image_url(u: Column) -> Column:
    return u.rlike("(?i)^https?://") & ~u.rlike(PICTURE_BAD) & u.rlike(r"(?i)\.(jpe?g|png|webp)(\?|$)") & u.rlike(PICTURE_WORDS)


def pdf_url(u: Column) -> Column:
    return F.coalesce(~policy_url(u) & (u.rlike(r"(?i)\.pdf(\?|#|$)") | u.rlike("(?i)^blob:.*pdf")), F.lit(False))


def download_button(text: Column, href: Column) -> Column:
    """Whether a control loads a flyer and not an app."""
    link = F.coalesce(href, F.lit(""))
    return ~F.concat_ws(" ", text, link).rlike(APP_WORDS) & (link.rlike(r"(?i)\.pdf(\?|$)") | text.rlike(DOWNLOAD_WORDS) | text.rlike(DOWNLOAD_FLYER))


def bare_page_image(url: Column, title: Column, pdf: Column, pages: Column) -> Column:
    """A lone picture of a page that was taken for a flyer."""
    n = F.coalesce(F.size(pages), F.lit(0))
    only = F.coalesce(page_image_url(F.get(pages, F.lit(0))) & (n == 1), F.lit(False))
    plain = ~F.coalesce(pdf, F.lit(False)) & (F.coalesce(title, F.lit("")) == "") & (n < 2)
    return plain & ~(flyer_url(url) & ~page_image_url(url)) & (page_image_url(url) | only)


def rich_document(url: Column, pdf: Column, pages: Column) -> Column:
    n = F.coalesce(F.size(pages), F.lit(0))
    one = F.coalesce((n == 1) & F.get(pages, F.lit(0)).rlike(r"(?i)\.(jpe?g|png|webp|pdf)(\?|$)"), F.lit(False))
    return F.coalesce(pdf, F.lit(False)) | url.rlike(r"(?i)\.pdf(\?|#|$)") | (n >= 2) | one


def placeholder_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s+", " ")).rlike(r"(?i)^item-\d+$")


def junk_title(title: Column) -> Column:
    """A call to act or a bare date, and no name of a flyer."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    return (t == "") | (~placeholder_title(t) & (t.rlike(GENERIC_TITLE) | t.rlike(r"(?i)^ver\s+encarte") | t.rlike(r"(?i)^de\s+\d{1,2}\s+a\s+\d")))


def page_source_rank(kind: Column, content_type: Column, url: Column) -> Column:
    """Which pages of a flyer are taken: captured files of type PDF, then addresses of PDFs, then other captures, then other addresses; null is none."""
    captured = kind == "capture"
    own = ~url.rlike("^(capture|blob)://?")
    return F.when(captured & F.coalesce(F.contains(content_type, F.lit("pdf")), F.lit(False)), 1).when(~captured & url.rlike(r"(?i)\.pdf(\?|#|$)") & own, 2).when(captured, 3).when(~captured & ~url.startswith("capture://"), 4)


def file_problem(data: Column, most_bytes: int = 50 << 20) -> Column:
    """Why a downloaded file is of no use, or null."""
    return F.when(F.octet_length(data) == 0, "empty").when(F.octet_length(data) > most_bytes, "too large").when(content_type(data).isNull(), "unknown type")


def allowed_host(url: Column, hosts: list[str]) -> Column:
    """https, and a host that is listed or lies below a listed one."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (host == h) | host.endswith(f".{h}")
    return (host != "") & hit


def extraction_outcome(available: Column, raw_count: Column, offer_count: Column, error: Column) -> Column:
    """struct(status, error) of one page's extraction."""
    lost = (offer_count == 0) & (F.coalesce(raw_count, offer_count) > 0)
    why = F.when(~available, F.lit("unavailable")).when(error.isNotNull(), error).when(lost, F.concat(F.lit("guard dropped "), raw_count.cast("string")))
    return F.struct(F.when(why.isNull(), "ok").otherwise("failed").alias("status"), why.alias("error"))


# What a recorded action becomes.
STEPS = {"navigation": "navigate", "click": "click", "change": "select", "input": "input", "scroll": "scroll", "scope": "select-scope"}


def recorded_step(kind: Column, given: Column, text: Column, selectors: Column) -> Column:
    """struct(type, semantic, selector, selectors), null for kinds that are no step."""
    table = F.create_map(*[F.lit(v) for kv in STEPS.items() for v in kv])
    own = F.array_distinct(F.filter(F.coalesce(selectors, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != "")))
    step = F.try_element_at(table, kind)
    return F.when(step.isNotNull(), F.struct(step.alias("type"), F.coalesce(given, semantic(kind, F.coalesce(text, F.lit("")))).alias("semantic"), F.get(own, F.lit(0)).alias("selector"), own.alias("selectors")))
