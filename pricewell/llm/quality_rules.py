"""Line-first quality rules.

Each line is judged by itself: punctuation (no closing mark at its end and no sentence within, symbols strewn over it), navigation
(items between separators, nothing but menu words) and boilerplate (shouting, stuttering, short lines with a stock phrase). Failing lines
go; a document that loses too large a share of its characters is
rejected. Beside the verdict stand the base counts of words, symbols, repeated lines and repeated
windows. All of it is one pass over the rows: nothing is shuffled.

Cases: null or empty text has no words, so the base rules reject it. Very long texts are counted
whole; hashed window positions are confirmed on word numbers, so a collision counts for nothing.
Each repeated row gets the same verdict. An empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.common import mix64, per_batch, texts

# Symbols and separators, closing marks, menu words, stock phrases.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = frozenset((b"|", b">", b"/", b"-", b"*", "»".encode(), "•".encode(), "·".encode()))
CLOSING = re.compile("(?:[.!?;:,\"')\\]{}]|…|”|’|»|。|！|？)$".encode())
SENTENCE = re.compile(rb"[.!?][\x20\x09-\x0D]")
MENU = (
    "home", "about", "contact", "contacts", "login", "logout", "register", "menu", "search", "sitemap", "help", "faq", "news", "blog", "cart", "account", "next", "previous", "back",
    "inicio", "contacto", "buscar", "ayuda", "entrar", "contato", "busca", "ajuda", "accueil", "connexion", "recherche", "aide", "startseite", "kontakt", "suche", "hilfe", "anmelden", "impressum",
)
STOCK_WORDS = 12  # a longer line that has a stock phrase may well be a sentence about it
STOCK_PHRASES = (
    "lorem ipsum", "all rights reserved", "terms of use", "terms of service", "privacy policy", "accept cookies", "accept all cookies", "enable javascript", "click here", "sign up for", "skip to content", "share on", "subscribe to", "follow us on", "read more",
    "todos los derechos reservados", "todos os direitos reservados", "tous droits réservés", "alle rechte vorbehalten", "política de privacidad", "política de privacidade", "politique de confidentialité", "datenschutzerklärung", "aceptar cookies", "aceitar cookies", "accepter les cookies", "cookies akzeptieren",
    "haga clic aquí", "clique aqui", "cliquez ici", "hier klicken", "términos de uso", "termos de uso", "conditions d'utilisation", "nutzungsbedingungen",
)
STOCK = re.compile("|".join(map(re.escape, STOCK_PHRASES)).encode())
_MENU = frozenset(w.encode() for w in MENU)


def symbol_count(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def line_fails(line: bytes, max_symbols: float = 0.25, max_separators: float = 0.15, max_stutter: float = 0.3, min_words: int = 5) -> str | None:
    """The first rule that the line breaks, or None. Lines without a word are not judged."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    separators = sum(w in SEPARATORS for w in words)
    if n >= min_words and separators > max_separators * n:
        return "navigation"
    symbols = symbol_count(line)
    if symbols > max_symbols * n and symbols > 1:
        return "punctuation"
    upper = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(line) - len(line.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    if n >= min_words and upper > lower:
        return "boilerplate"
    if line.count(b"!!") > max_symbols * n and n >= min_words:
        return "punctuation"
    if n >= min_words and sum(map(bytes.__eq__, words, words[1:])) > max_stutter * n:
        return "boilerplate"
    if n <= STOCK_WORDS and STOCK.search(line.lower()):
        return "boilerplate"
    if _MENU.issuperset(line.lower().split()):
        return "navigation"
    if n >= min_words and not CLOSING.search(words[-1]) and not SENTENCE.search(line):
        return "punctuation"
    return None


def repeated_window_words(ids: np.ndarray, width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        v = mix64(ids.astype(np.uint64))
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15 | 1) + v[k : k + n]
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0  # all hashes differ, so all windows do
    # exact: number the windows of 2, 4, ... words by doubling, then the rest by overlap
    names, size = ids.astype(np.int64), 1
    while size < width:
        step = min(size, width - size)
        a, b = names[: len(names) - step], names[step:]
        names = np.unique(a * np.int64(int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)
        size += step
    counts = np.bincount(names)
    twice = counts[names] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = symbol_count(text)
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_window_words(ids)


def clean_lines(text: bytes) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if line_fails(x) is None)


def _letters(text: bytes) -> int:
    return len(b"".join(text.split()))


def apply_rules(docs: DataFrame, max_lost: float = 0.5, min_words: int = 20, max_repeat: int = 30, cleaned: bool = False) -> DataFrame:
    """Base counts and verdict of each row; with ``cleaned`` also the text without failing lines.

    ``kept`` is false where the base rules fail or the lines removed hold more than
    ``max_lost`` of the text's bytes outside white space.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, kept_texts = [], []
        for text in texts(batch):
            n, chars, symbols, dup, repeat = base_counts(text)
            failed = n < min_words or 100 * repeat > max_repeat * n
            left = clean_lines(text)
            rows.append((n, chars, symbols, dup, repeat, failed, not failed and _letters(text) - _letters(left) <= max_lost * _letters(text)))
            kept_texts.append(left)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        columns = [pa.array(x, pa.int64() if k < 5 else pa.bool_()) for k, x in enumerate(zip(*rows, strict=True))]
        extra = [pa.array([x.decode("utf-8", "replace") for x in kept_texts])] if cleaned else []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *extra], ["doc_id", *names, *(["clean_text"] if cleaned else [])])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean" + (", clean_text string" if cleaned else "")
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
