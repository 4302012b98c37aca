"""Tags and attributes of HTML pages as column expressions.

A tag is told from text as a browser's tokenizer does it: attributes have double, single or no quotes, names count in
lower case, a `>` within quotes ends nothing, and what stands in comments, scripts and styles is no tag. Entities in
values are decoded, the named ones of HTML 4 and all numbers, if a semicolon ends them: `&copy=1` is part of a link.

A tag with over 500 attributes and blanks between them, or with a quote that nothing closes, is skipped: Java's regexes
recur for each of them.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A value: in double quotes, in single quotes, or bare.
_VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))"""
_NAME = r"[^\s/>=]++"
_INNER = rf"(?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:{_VALUE})?+)?+|=){{0,500}}+"
_ATTRIBUTE = rf"({_NAME})(?:\s*+=\s*+{_VALUE}?+)?+"
_HIDDEN = r"(?is)<!--.*?-->|(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>"


_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8}[0-9]{0,2});"


def decoded(value: Column) -> Column:
    """value without entities; unknown ones stay as they are."""
    names = {n: chr(c) for n, c in html.entities.name2codepoint.items()} | {"apos": "'"}
    known = F.map_from_arrays(F.lit(list(names)), F.lit(list(names.values())))

    def character(name: Column) -> Column:
        code = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int")
        sound = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        number = F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(name.startswith("#"), number).otherwise(F.coalesce(F.try_element_at(known, name), F.concat(F.lit("&"), name, F.lit(";"))))

    parts = F.arrays_zip(F.split(value, _ENTITY, -1).alias("text"), F.regexp_extract_all(value, F.lit(_ENTITY), F.lit(1)).alias("name"))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.when(p["name"].isNull(), "").otherwise(character(p["name"])))), "")
    return F.when(value.contains("&"), joined).otherwise(value)


def elements(page: Column, *tags: str) -> Column:
    """The page's elements of some kinds, in order: structs of tag and attrs (structs of name and value as written)."""
    visible = F.regexp_replace(page, _HIDDEN, "$1")
    tag = rf"(?i)<({'|'.join(tags)})(?=[\s/>])({_INNER})>"
    found = F.arrays_zip(F.regexp_extract_all(visible, F.lit(tag), F.lit(1)).alias("tag"), F.regexp_extract_all(visible, F.lit(tag), F.lit(2)).alias("inner"))

    def attrs(inner: Column) -> Column:
        part = lambda k: F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(k))
        rows = F.arrays_zip(part(1).alias("name"), part(2).alias("a"), part(3).alias("b"), part(4).alias("c"))
        return F.transform(rows, lambda r: F.struct(F.lower(r["name"]).alias("name"), F.concat(r["a"], r["b"], r["c"]).alias("value")))

    return F.transform(found, lambda x: F.struct(F.lower(x["tag"]).alias("tag"), attrs(x["inner"]).alias("attrs")))


def attribute(element: Column, name: str) -> Column:
    """Value of an element's attribute, as written; of repeated ones the first counts; null if it has none."""
    return F.get(F.filter(element["attrs"], lambda a: a["name"] == name), F.lit(0))["value"]


def attributes(page: Column, *tags: str) -> Column:
    """tag, name, value of every attribute of the page's elements of some kinds, decoded, in order."""
    return F.flatten(F.transform(elements(page, *tags), lambda e: F.transform(e["attrs"], lambda a: F.struct(e["tag"].alias("tag"), a["name"].alias("name"), decoded(a["value"]).alias("value")))))


def values_of(found: Column, tag: str, name: str) -> Column:
    """Values of an attribute of elements of one kind, decoded, in order; elements without it are left out."""
    of = F.transform(F.filter(found, lambda e: e["tag"] == tag), lambda e: attribute(e, name))
    return F.transform(F.filter(of, F.isnotnull), decoded)


def content_of(found: Column, name: str) -> Column:
    """Content of the first meta element with that property, decoded; null if there is none or it is empty."""
    first = F.get(F.filter(found, lambda e: (e["tag"] == "meta") & (attribute(e, "property") == name)), F.lit(0))
    return F.nullif(decoded(attribute(first, "content")), F.lit(""))
