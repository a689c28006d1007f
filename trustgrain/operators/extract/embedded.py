"""Reviews inside page state that scripts carry as JSON, and in JSON of unknown shape."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.text import clean_text, parse_rating, strip
from ...session import small_batches, written
from . import variants as V

# Where pages keep their state, and the keys under which reviews are found in it.
STATE_PREFIXES = (
    "window.__INITIAL_STATE__",
    "window.__NEXT_DATA__",
    "window.__data",
    "__PRELOADED_STATE__",
    "window.pageDataV4",
    "window.__STORE_STATE__",
    "window.__APOLLO_STATE__",
    "window.__myx",
)
STATE_SCRIPT_IDS = ("__next_data__", "jsonld", "productschema", "is_script")
TEXT_KEYS = (
    "reviewBody", "body", "text", "review_text", "reviewText", "comment", "description", "content", "review_comment",
    "reviewDescription", "value", "reviewContent",
)
RATING_KEYS = (
    "rating", "ratingValue", "stars", "star_rating", "starRating", "overall_rating", "overallRating", "score", "overall",
)

SCRIPT = r"(?is)<script([^>]*)>(.*?)</script>"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _states(scripts: pd.Series) -> pd.Series:
    """JSON values assigned to the known names. The decoder itself finds where a value ends."""
    decode = json.JSONDecoder().raw_decode
    names = [re.compile(re.escape(p) + r"\s*=\s*") for p in STATE_PREFIXES]

    def values(script: str | None) -> list[str]:
        out = []
        for name in names if script else ():
            at = name.search(script)
            if not at or script[at.end() : at.end() + 1] not in ("{", "["):
                continue
            try:
                end = decode(script, at.end())[1]
            except ValueError:
                continue
            except RecursionError:  # kept, so that it is reported as a document that cannot be read
                end = len(script)
            out.append(script[at.end() : end])
        return out

    return scripts.map(values)


def state_documents(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """JSON documents embedded in a page's scripts: ``(key, doc_no, doc)``, by one reading of the page."""
    small_batches(pages.sparkSession)
    tags = pages.select(
        key, F.posexplode(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(0))).alias("script_no", "tag")
    ).select(
        key,
        "script_no",
        F.regexp_extract("tag", SCRIPT, 2).alias("script"),
        F.lower(F.regexp_extract("tag", r"""(?is)^<script[^>]*\sid\s*=\s*["']?([^"'\s>]+)""", 1)).alias("script_id"),
    )
    named = F.col("script_id").isin(*STATE_SCRIPT_IDS)
    marked = F.lit(False)
    for prefix in STATE_PREFIXES:
        marked = marked | F.contains("script", F.lit(prefix))
    script = F.col("script")
    docs = F.when(named, F.array(F.trim(script))).otherwise(_states(F.when(~named, script)))
    found = tags.filter(named | marked).select(key, "script_no", F.posexplode(docs).alias("part_no", "doc"))
    return found.select(key, F.struct("script_no", "part_no").alias("doc_no"), "doc")


def _own_review(node: dict, min_text: int) -> tuple[str, str] | None:
    """Text and rating of one object, if it has both; rating text is judged later by the shared column function."""
    text = next((node[k] for k in TEXT_KEYS if isinstance(node.get(k), str) and len(node[k].strip()) >= min_text), None)
    if text is None:
        return None
    nested = node.get("reviewRating")
    marks = [nested.get("ratingValue")] if isinstance(nested, dict) else []
    marks += [node[k] for k in RATING_KEYS if not isinstance(node.get(k), (dict, list, type(None)))]
    for mark in marks:
        number = re.search(r"\d+(?:\.\d+)?", str(mark)) if mark is not None else None
        if number and float(number.group()) <= 5.0:
            return text, number.group()
    return None


def _reviews_in(data, min_text: int) -> list[dict]:
    """Reviews of one parsed document at any depth, each object before its members."""
    found = (_own_review(o, min_text) for o in _objects(data))
    return [{"text": own[0], "rating": own[1]} for own in found if own]


def _objects(data) -> Iterator[dict]:
    """All objects of a parsed document, each before its members."""
    waiting = [data]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            yield node
        members = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        waiting += [m for m in members if isinstance(m, (dict, list))][::-1]


#: Levels of a document that are opened in one pass over it; what lies deeper is stored and opened in further passes.
LEVELS = 8


def _opened(nodes: DataFrame) -> DataFrame:
    """Nodes with those that wait taken apart: objects stay as they are, members that are objects or lists wait in turn.

    Members of objects are in order of their names. A struct can be read out of objects only, whatever they hold, and a list
    of structs out of lists only; neither copies what is inside.
    """
    path, v, waits = F.col("path"), F.col("v"), F.col("waits")

    def shaped(x: Column, kind: str) -> Column:
        return V.get(x, type=kind).isNotNull()

    one, many = "struct<_:boolean>", "array<struct<_:boolean>>"
    members = F.coalesce(F.map_values(V.get(v, type="map<string,variant>")), V.get(v, type=V.LIST), F.array().cast(V.LIST))
    below = F.transform(members, lambda m, i: F.struct(F.concat(path, F.array(i)).alias("path"), m.alias("v"), F.lit(True).alias("waits")))
    below = F.filter(below, lambda n: shaped(n["v"], one) | shaped(n["v"], many))
    itself = F.array(F.struct(path, v, F.lit(False).alias("waits")))
    # Outer, so that no filter on the members is tested ahead, with the node taken apart twice.
    found = F.when(~waits, itself).when(shaped(v, one), F.concat(itself, below)).otherwise(below)
    return nodes.select("k", F.inline_outer(found)).filter(F.col("path").isNotNull())


def objects(documents: DataFrame, keys: list[str], read: Column, doc: str = "doc") -> DataFrame:
    """Every object of JSON documents, at any depth, as ``(k, path, found)``: ``k`` is the struct of ``keys``, ``path`` the
    places that lead to the object and ``found`` what ``read`` makes of its value ``v``.

    A document is opened level by level in the rows of the task that holds it, so that no level is sent over a shuffle with
    all that lies below it. Only what is read is stored, and what lies deeper than ``LEVELS``, for a pass of its own.
    """
    start = F.array().cast("array<int>").alias("path")
    nodes = documents.select(F.struct(*keys).alias("k"), start, V.parse(F.col(doc)).alias("v"), F.lit(True).alias("waits"))
    passes = []
    while not passes or not nodes.isEmpty():
        for _ in range(LEVELS):
            nodes = _opened(nodes)
        waits = F.col("waits")
        stored = written(nodes.select("k", "path", F.when(waits, F.col("v")).alias("v"), "waits", F.when(~waits, read).alias("found")), "objects")
        passes.append(stored.filter(~waits).select("k", "path", "found"))
        nodes = stored.filter(waits).select("k", "path", "v", "waits")
    return reduce(DataFrame.union, passes)


def deep_reviews(documents: DataFrame, keys: list[str], doc: str = "doc", min_text: int = 1) -> DataFrame:
    """Review-like objects anywhere in JSON documents: ``(*keys, pos, text, rating)``, each object before its members.

    Objects whose text has fewer than ``min_text`` characters are not reviews. Members of objects follow the order of
    their names, items of lists their own.
    """
    v = F.col("v")
    texts = F.array(*[V.string(v, k) for k in TEXT_KEYS])
    marks = F.array(V.scalar_text(v, "reviewRating", "ratingValue"), *[V.scalar_text(v, k) for k in RATING_KEYS])
    numbers = F.transform(marks, lambda m: F.nullif(F.regexp_extract(m, r"(\d+(?:\.\d+)?)", 1), F.lit("")))
    read = F.struct(
        F.get(F.filter(texts, lambda t: F.length(strip(t)) >= min_text), 0).alias("text"),
        F.get(F.filter(numbers, lambda n: n.try_cast("double") <= 5.0), 0).alias("rating"),
    )
    found = objects(documents, keys, read, doc).select("k", "path", "found.text", "found.rating")
    found = found.filter(F.col("text").isNotNull() & F.col("rating").isNotNull())
    pos = (F.row_number().over(Window.partitionBy("k").orderBy("path")) - 1).alias("pos")
    return found.select("k", pos, "text", "rating").select(
        *[F.col(f"k.{k}").alias(k) for k in keys], "pos", clean_text(F.col("text")).alias("text"), parse_rating(F.col("rating")).alias("rating")
    ).filter((F.col("text") != "") & F.col("rating").isNotNull())


def unreadable_documents(documents: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """Documents that ``deep_reviews`` cannot read, with the reason: ``(*keys, error)``."""
    why = F.when(F.coalesce(F.trim(doc), F.lit("")) == "", "not JSON: empty").otherwise("not JSON: malformed, or too deep or large for a value")
    return documents.filter(V.parse(F.col(doc)).isNull()).select(*keys, why.alias("error"))


def embedded_reviews(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Reviews in the state a page carries in its scripts, in page order."""
    documents = state_documents(pages, key, html)
    return deep_reviews(documents, [key, "doc_no"]).select(
        key, F.struct("doc_no.script_no", "doc_no.part_no", "pos").alias("pos"), "text", "rating"
    )
