"""Text scalars as column expressions: folding, names, slugs, units, keys and search predicates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Accented Latin letters and what they fold to, from the Unicode tables."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folding()

# Unit aliases and the units that are known.
UNIT_ALIASES = {"lt": "l", "litro": "l", "litros": "l", "und": "un", "unid": "un", "unidade": "un", "unidades": "un", "kilo": "kg", "kilos": "kg", "kgs": "kg"}
UNITS = ("kg", "g", "l", "ml", "un", "cx", "pct", "pack", "fd")
# Words that stand for nothing.
UNKNOWN_WORDS = r"(?i)^(unknown|n/a|n\.a\.?|nao identificado|não identificado|null|none|-)$"


def fold(x: Column) -> Column:
    """Without accents: letters of the Latin blocks, and combining marks."""
    return F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), r"\p{M}", "")


def collated(x: Column, language: str = "pt") -> Column:
    """The text with a language's own order: accents, case and signs as its dictionaries have them."""
    return F.collate(x, language)


def normalize(x: Column) -> Column:
    """Folded, lower case, words of a-z and 0-9 with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(x)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def title_case(x: Column) -> Column:
    """Lower case with a capital at the start and after white space, slash or hyphen."""
    parts = F.split(F.lower(x), r"(?<=[\s/-])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def slug(x: Column, longest: int | None = None, default: str | None = None) -> Column:
    s = F.regexp_replace(F.regexp_replace(normalize(x), r"\s+", "-"), "^-|-$", "")
    if longest:
        s = F.substring(s, 1, longest)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default)) if default else s


def normalize_unit(x: Column) -> Column:
    u = F.trim(F.regexp_replace(F.lower(x), r"\.$", ""))
    table = F.create_map(*[F.lit(v) for kv in UNIT_ALIASES.items() for v in kv])
    mapped = F.coalesce(F.try_element_at(table, u), u)
    return F.when(mapped.isin(*UNITS), mapped)


def squeeze_space(x: Column) -> Column:
    """No carriage returns, single blanks, at most one empty line in a row."""
    y = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\r", ""), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(y, r"^\s+|\s+$", "")


def strip_unknown(x: Column) -> Column:
    """Trimmed, or null for blanks and words that say nothing."""
    return F.nullif(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), UNKNOWN_WORDS + r"[\s\S]*", ""), F.lit(""))


def sanitize_name(x: Column) -> Column:
    return squeeze_space(F.regexp_replace(x, r"[^\p{L}\p{N}\s\-/%.,+]", " "))


def dedupe_key(x: Column) -> Column:
    """Folded name in which a number and its unit are one word."""
    return F.regexp_replace(fold(F.lower(squeeze_space(x))), r"(\d+)\s+(kg|g|ml|l|un)\b", "$1$2")


def match_key(name: Column, brand: Column, quantity: Column, unit: Column) -> Column:
    """Normalised name, brand, quantity and unit with bars between; absent parts are skipped."""
    part = lambda x, y: F.when(x.isNotNull() & (x != ""), y)
    return F.concat_ws("|", normalize(name), part(brand, normalize(brand)), part(quantity, F.regexp_replace(quantity, "^([^,]*),", "$1.")), part(unit, normalize_unit(unit)))


def tokens(x: Column, least: int = 2) -> Column:
    return F.filter(F.split(normalize(x), " "), lambda t: F.length(t) >= least)


def tokens_match(hay: Column, query: Column) -> Column:
    """All query tokens are substrings of the normalised text; false without tokens."""
    t, h = tokens(query), normalize(hay)
    return F.coalesce((F.size(t) > 0) & F.forall(t, lambda x: F.contains(h, x)), F.lit(False))


def name_divergence(a: Column, b: Column, least: float = 0.35) -> Column:
    """Whether two names share too few tokens: overlap (repeats of the second count) over the longer length."""
    x, y = F.split(normalize(a), " "), F.split(normalize(b), " ")
    both = F.size(F.filter(y, lambda t: F.array_contains(x, t)))
    return both / F.greatest(F.size(x), F.size(y)) < least


def condition_line(parts: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")), " · ")


def group_key(product: Column, name: Column, brand: Column, quantity: Column) -> Column:
    blank = lambda x: F.coalesce(x, F.lit(""))
    return F.when(product.isNotNull(), F.concat(F.lit("c:"), product)).otherwise(F.concat(F.lit("t:"), blank(name), F.lit(":"), blank(brand), F.lit(":"), blank(quantity)))


def first_word(x: Column) -> Column:
    return F.get(F.split(F.trim(x), r"\s+"), 0)


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    """``{{key}}`` replaced by its value; unknown keys by nothing."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return F.regexp_replace(template, r"\{\{[^}]*\}\}", "")


def brl(x: Column) -> Column:
    """A price in reais: 1.234,56."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(x, 2), ",.", ".,"))


def worker_slug(name: Column) -> Column:
    """``wrk_`` and the folded name, 28 characters of it."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(fold(name)), r"[^a-z0-9]+", "_"), r"^_|_$", ""), 1, 28)
    return F.when(s.startswith("wrk_"), s).otherwise(F.concat(F.lit("wrk_"), F.coalesce(F.nullif(s, F.lit("")), F.lit("flow"))))


def compact(x: Column) -> Column:
    """1234 as 1.2k, from ten thousand on without a place; small whole numbers as they are."""
    k = x / 1000
    whole = F.format_number(F.floor(k + 0.5), 0)
    return F.when(x < 1000, x.cast("string")).otherwise(F.concat(F.when(k >= 10, F.replace(whole, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(F.format_number(F.floor(k * 10 + 0.5) / 10, 1), r"\.0$", "")), F.lit("k")))


def percent(x: Column) -> Column:
    return F.concat(F.replace(F.format_number(F.floor(x * 1000 + 0.5) / 10, 1), F.lit(","), F.lit("")), F.lit("%"))


def pack(quantity: Column, unit: Column) -> Column:
    """Quantity and unit, or the one that is there, or null."""
    q, u = (F.nullif(F.trim(c), F.lit("")) for c in (quantity, unit))
    return F.nullif(F.concat_ws(" ", q, u), F.lit(""))


def relative_label(minutes: Column) -> Column:
    """How long ago, from whole minutes."""
    hours = F.floor(minutes / 60)
    say = lambda n, unit: F.concat(F.lit("há "), n.cast("string"), F.lit(unit))
    return F.when(minutes.isNull(), "—").when(minutes < 1, "agora").when(minutes < 60, say(minutes, " min")).when(hours < 24, say(hours, "h")).otherwise(say(F.floor(hours / 24), "d"))


def duration_label(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    rest, minutes = (s % 60).cast("string"), F.floor(s / 60)
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "—").when(minutes == 0, F.concat(rest, F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), rest, F.lit("s")))


def expiry_pill(days: Column, over: Column) -> Column:
    """What a card says of a flyer that is not over: today, or in so many days."""
    return F.when(~over, F.when(days <= 0, "Expira hoje").otherwise(F.concat(F.lit("Expira em "), days.cast("string"), F.lit("d"))))


def clip(x: Column, most: int, mark: str = "") -> Column:
    """At most so many characters, with a mark where some are left out."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(mark))).otherwise(x)


def distance_label(km: Column) -> Column:
    return F.when(km.isNull(), "sem GPS").when(km < 1, F.concat(F.floor(km * 1000 + 0.5).cast("string"), F.lit(" m"))).otherwise(F.concat(F.regexp_replace(F.format_number(F.floor(km * 10 + 0.5) / 10, 1), r"\.", ","), F.lit(" km")))


def expiry_label(days: Column) -> Column:
    """What a card says about the days that are left."""
    return F.when(days.isNull(), "sem validade").when(days < 0, "expirado").when(days == 0, "vence hoje").when(days == 1, "vence amanhã").otherwise(F.concat(F.lit("vence em "), days.cast("string"), F.lit(" dias")))


def instalment_label(count: Column, amount: Column, interest_free: Column) -> Column:
    return F.concat(count.cast("string"), F.lit("x de "), brl(amount), F.when(interest_free, F.lit(" sem juros")).otherwise(F.lit("")))
