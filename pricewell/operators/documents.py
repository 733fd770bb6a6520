"""Documents in nested JSON of unknown shape, and the merging of candidates from several sources."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.functions.parse import content_type

# Field names under which answers carry a document, its pages and nested lists.
DOCUMENT_KEYS = ("urlFinalDocument", "documentUrl", "pdfUrl", "flyerUrl", "url_document", "fileUrl", "downloadUrl")
PAGE_KEYS = ("images_urls", "imagesUrls", "pages", "pageUrls", "images", "urls", "files", "assets")
NESTED_KEYS = ("flyers", "encartes", "jornais")
FOUND = "array<struct<url:string,title:string,thumbnail:string,valid_from:string,valid_until:string,page_urls:array<string>,pdf:boolean>>"
_FILE = re.compile(r"\.(pdf|jpe?g|png|webp)(\?|$)", re.I)
_PDF = re.compile(r"\.pdf(\?|$)", re.I)


def _text(value: object) -> str | None:
    return value if isinstance(value, str) and value else None


def _pages(value: object) -> list[str]:
    items = value if isinstance(value, list) else []
    urls = (_text(x) or (_text(x.get("url")) if isinstance(x, dict) else None) for x in items)
    return [u for u in urls if u and _FILE.search(u)]


def _record(node: dict) -> dict | None:
    url = next((u for k in DOCUMENT_KEYS if (u := _text(node.get(k)))), None)
    own = _text(node.get("url"))
    url = url or (own if own and _PDF.search(own) else None)
    pages = next((p for k in PAGE_KEYS if (p := _pages(node.get(k)))), [])
    named = url or any(node.get(k) for k in ("id", "name", "title"))
    if not url and not (len(pages) > 1 or (pages and named)):
        return None
    validity = node["validity"] if isinstance(node.get("validity"), dict) else {}
    return {
        "url": url or pages[0], "title": _text(node.get("name")) or _text(node.get("title")), "thumbnail": _text(node.get("urlFinalDocumentThumbnail")) or _text(node.get("thumbnail")),
        "valid_from": _text(validity.get("initial")), "valid_until": _text(validity.get("final")), "page_urls": pages or None, "pdf": all(map(_PDF.search, pages)) if pages else bool(_PDF.search(url)),
    }


def walk(root: object, depth: int = 10, most: int = 81) -> list[dict]:
    """Documents of a JSON value, outermost first; a list under a nested key replaces its parent's other fields.

    Nothing deeper than ``depth`` counts and no more than ``most`` documents do; where either leaves something out, the last document says so (``cut``).
    """
    out, todo, cut = [], [(root, 0)], False
    while todo:
        node, level = todo.pop(0)
        if len(out) >= most or level > depth:
            cut = True
            if len(out) >= most:
                break
            continue
        if isinstance(node, list):
            todo[:0] = [(x, level + 1) for x in node]
        elif isinstance(node, str) and _PDF.search(node):
            out.append({"url": node, "pdf": True})
        elif isinstance(node, dict):
            found = _record(node)
            if found:
                out.append(found)
            inner = next((node[k] for k in NESTED_KEYS if isinstance(node.get(k), list)), None)
            if inner is not None:
                todo.insert(0, (inner, level + 1))
            elif not found:
                todo[:0] = [(v, level + 1) for v in node.values()]
    if out and cut:
        out[-1]["cut"] = True
    return out


def documents_in(answers: DataFrame, column: str = "body", depth: int = 10, most: int = 81) -> DataFrame:
    """Each answer's other columns with the documents in its JSON; text that is no JSON has none. ``cut``: depth or number left something out after this one.

    Recursion over unknown shapes has no SQL; the walk is one small function in an Arrow batch.
    """
    names = [f.split(":")[0].strip() for f in ("url", "title", "thumbnail", "valid_from", "valid_until", "page_urls", "pdf")]

    def one(text: str | None) -> list[dict]:
        try:
            return [{**{n: d.get(n) for n in names}, "cut": d.get("cut", False)} for d in walk(json.loads(text or ""), depth, most)]
        except ValueError:
            return []

    kind = T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in names[:5]), T.StructField("page_urls", T.ArrayType(T.StringType())), T.StructField("pdf", T.BooleanType()), T.StructField("cut", T.BooleanType())]))
    find = F.pandas_udf(lambda s: pd.Series([one(x) for x in s]), kind)
    return answers.withColumn("_d", F.explode(find(F.col(column)))).select(*[c for c in answers.columns if c != column], "_d.*")


def merge_candidates(sources: list[DataFrame], key: str) -> DataFrame:
    """One row for each key: page lists united, of other columns the first known value in the order of the sources."""
    both = None
    for n, df in enumerate(sources):
        df = df.withColumn("_s", F.lit(n))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_s", "page_urls")]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_s"))).alias(c) for c in rest]
    pages = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_s", F.coalesce("page_urls", F.array().cast("array<string>")).alias("p")))), lambda x: x["p"])))
    return both.groupBy(key).agg(*first, pages.alias("page_urls"))


# Answers of services that carry products or measurements, no documents.
OTHER_SERVICES = r"(?i)product|graphql|analytics|gtm|collect|hotjar|sentry"
RESPONSES = "url string, status int, content_type string, body string, seq long"


def recorded_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses of a crawl from files of JSON lines (url, status, content_type, base64 ``body``, seq); ``kind`` is what the bytes are, whatever the header says."""
    r = spark.read.schema(RESPONSES).json(path).withColumn("data", F.unbase64("body")).drop("body")
    return r.withColumn("kind", content_type(F.col("data")))


def harvest(responses: DataFrame) -> DataFrame:
    """(url, title, page_urls, pdf, source_url): documents that a crawl's responses (url, status, content_type, kind, data, seq) show, each once, the first seen.

    Of answers that are no error, PDF files are documents themselves and JSON is searched for them; images alone are none, nor are answers of other services. A document
    with pages is known by its address, the number of its pages and its title, another by its address.
    """
    told = F.lower(F.coalesce("content_type", F.lit("")))
    ok = responses.filter(F.col("status").between(200, 299)).withColumn("_told", told)
    file = F.contains("_told", F.lit("pdf")) | (F.col("kind") == "application/pdf") | (F.col("url").rlike(r"(?i)\.pdf(\?|$)") & F.contains("_told", F.lit("octet-stream")))
    ok = ok.withColumn("_file", F.coalesce(file, F.lit(False)))
    files = ok.filter("_file").select("url", F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<string>").alias("page_urls"), F.lit(True).alias("pdf"), F.lit(None).cast("string").alias("source_url"), "seq", F.lit(0).alias("n"))
    answers = ok.filter(~F.col("_file") & F.contains("_told", F.lit("json")) & ~F.contains("_told", F.lit("image/")) & ~F.col("url").rlike(OTHER_SERVICES))
    found = documents_in(answers.select(F.col("url").alias("source_url"), "seq", F.decode("data", "utf-8").alias("body")))
    found = found.withColumn("n", F.xxhash64("url", "title", "page_urls")).select("url", "title", "page_urls", "pdf", "source_url", "seq", "n")
    both = files.withColumn("n", F.col("n").cast("long")).unionByName(found)
    key = F.when(F.size("page_urls") > 0, F.concat_ws("|", "url", F.size("page_urls").cast("string"), F.coalesce("title", F.lit("")))).otherwise(F.col("url"))
    first = both.groupBy(key.alias("_k")).agg(F.min_by(F.struct("url", "title", "page_urls", "pdf", "source_url"), F.struct("seq", "n")).alias("r"))
    return first.select("r.*")
