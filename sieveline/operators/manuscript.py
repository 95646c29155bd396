"""Manuscripts: which outline section holds the limitations, lengths of parts, and Markdown from drafted parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.text import stripped

# The word for limitations, and headings that open with it.
LIMITS = "局限"
EXPLICIT = r"^(?:局限|研究局限|综述局限)"
# Headings and fields of a manuscript that brings none of its own.
TITLE, INTRODUCTION, LIMITATIONS, CONCLUSION = "文献综述", "引言", "局限", "结论"


def limitations_index(headings: Column) -> Column:
    """The place (from 0) of the last heading that opens with limitations, else of the last that names them; null where none does."""
    bare = F.transform(headings, lambda h: F.regexp_replace(stripped(F.coalesce(h, F.lit(""))), r"(?U)^\s*\d+[.、：:\s]*", ""))
    places = lambda test: F.filter(F.transform(bare, lambda h, i: F.when(test(h), i)), lambda i: i.isNotNull())
    named, explicit = places(lambda h: F.contains(h, F.lit(LIMITS))), places(lambda h: h.rlike(EXPLICIT))
    return F.coalesce(F.array_max(explicit), F.array_max(named))


def part_lengths(headings: Column, characters: Column) -> Column:
    """Places of the main sections (neither first nor last nor limitations), and the characters for the frame and for each of them."""
    n, limits = F.size(headings), F.coalesce(limitations_index(headings), F.lit(-1))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    main = F.filter(every, lambda i: (i != 0) & ((i != n - 1) | (n < 2)) & (i != limits))
    frame = F.greatest(F.lit(1500), F.floor(characters * 0.30)).cast("int")
    each = F.greatest(F.lit(400), F.floor(characters * 0.65 / F.greatest(F.size(main), F.lit(1)))).cast("int")
    return F.struct(main.alias("main"), frame.alias("frame"), each.alias("each"))


def heading_number(heading: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(heading, F.lit("")), r"(?U)^\s*(\d+)\b", 1), F.lit("")).cast("int")


def markdown(part: dict[str, Column]) -> Column:
    """A manuscript's Markdown with its front matter.

    ``part`` has title, abstract, keywords (array), introduction, sections
    (array of heading and body), conclusion, limitations and, optionally,
    introduction_heading, limitations_heading, conclusion_heading. Limitations
    stand before the first section with a higher number, else after all.
    Sections without a heading or body are left out.
    """
    text = lambda name, default="": stripped(F.coalesce(F.nullif(part.get(name, F.lit(None).cast("string")), F.lit("")), F.lit(default)))
    block = lambda heading, body: F.concat(F.lit("\n\n## "), heading, F.lit("\n\n"), body)
    keywords = F.filter(F.transform(F.coalesce(part["keywords"], F.array().cast("array<string>")), stripped), lambda k: F.coalesce(k, F.lit("")) != "")
    sections = F.transform(part["sections"], lambda s: F.struct(stripped(F.coalesce(s["heading"], F.lit(""))).alias("heading"), stripped(F.coalesce(s["body"], F.lit(""))).alias("body")))
    sections = F.coalesce(sections, F.array().cast("array<struct<heading:string,body:string>>"))
    limits, limits_heading = text("limitations"), text("limitations_heading", LIMITATIONS)
    own = heading_number(limits_heading)
    later = F.array_position(F.transform(sections, lambda s: F.coalesce(heading_number(s["heading"]) > own, F.lit(False))), F.lit(True)).cast("int")
    cut = F.when((limits != "") & (later > 0), later - 1).otherwise(F.size(sections))
    shown = lambda some: F.array_join(F.transform(F.filter(some, lambda s: (s["heading"] != "") & (s["body"] != "")), lambda s: block(s["heading"], s["body"])), "")
    front = F.concat(F.lit('---\ntitle: "'), F.regexp_replace(text("title", TITLE), '"', "'"), F.lit('"\nlang: "zh-CN"\nreference-section-title: "参考文献"\nlink-citations: true\n---\n\n## 摘要\n\n'), text("abstract"), F.lit("\n\n**关键词：** "), F.array_join(keywords, "；"))
    middle = F.concat(shown(F.slice(sections, F.lit(1), cut)), F.when(limits != "", block(limits_heading, limits)).otherwise(F.lit("")), shown(F.slice(sections, cut + 1, F.greatest(F.size(sections) - cut, F.lit(0)))))
    return F.concat(front, block(text("introduction_heading", INTRODUCTION), text("introduction")), middle, block(text("conclusion_heading", CONCLUSION), text("conclusion")), F.lit("\n"))
