"""Normal forms of identifiers, titles and phrases, and small text classifiers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that don't tell works apart.
TITLE_STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "the", "to", "with")
# Words of a licence that lets a text be processed privately.
LICENSE_MARKERS = ("creativecommons.org/licenses/", "creativecommons.org/publicdomain/", "cc by", "cc-by", "cc0", "creative commons", "public domain")
# Contact identifiers that can't be searched for.
CONTACTS = {
    "email": r"(?i)(?<![\w.+-])[\w.+-]+@[\w.-]+\.[a-z]{2,}(?![\w.-])",
    "mobile phone": r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)",
    "national id": r"(?<!\d)\d{17}[\dXx](?!\d)",
}
# Patterns of the parts of an article.
SECTION_SIGNALS = (
    r"(?i)\b(?:introduction|background|literature review)\b",
    r"(?i)\b(?:methods?|methodology|materials and methods|research design|data collection|data analysis)\b",
    r"(?i)\b(?:results?|findings?)\b",
    r"(?i)\b(?:discussion|conclusions?|implications?)\b",
    r"(?i)\b(?:references|bibliography)\b",
)
CITATION = "@([A-Za-z0-9_.:-]+)"
TOKEN = "([a-z0-9]+(?:-[a-z0-9]+)?)"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(stripped(text), F.lit(""))


def first_text(values: Column) -> Column:
    """The first entry of an array that isn't blank, stripped; null if there is none."""
    return F.get(F.filter(F.transform(values, stripped), lambda x: x.isNotNull() & (x != "")), 0)


def safe_int(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("int"), F.lit(0))


def normal_doi(doi: Column) -> Column:
    bare = F.regexp_replace(F.lower(stripped(doi)), r"^https?://(?:dx\.)?doi\.org/", "")
    bare = F.regexp_replace(bare, r"^doi:\s*", "")
    return F.nullif(F.regexp_replace(bare, r"[ .]+$", ""), F.lit(""))


def ascii_title(title: Column) -> Column:
    """The normal form of a title in ASCII."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def fold(t: str) -> str:
    """Decomposed and lower-cased, without combining marks."""
    plain = unicodedata.normalize("NFKD", t).lower()
    for c in set(plain):
        if unicodedata.combining(c):
            plain = plain.replace(c, "")
    return plain


def _folded(title: Column) -> Column:
    """Decomposed, without combining marks; only titles outside ASCII come here."""

    def folded(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: None if t is None else fold(t))

    folded.__annotations__ = {"titles": pd.Series, "return": pd.Series}
    return F.pandas_udf(folded, "string")(title)


def normal_title(title: Column) -> Column:
    """Decomposed, lower-cased, without marks, anything but a-z and 0-9 one space."""
    simple = title.rlike(r"^[\x00-\x7F]*$")
    return F.when(simple | title.isNull(), ascii_title(title)).otherwise(ascii_title(_folded(F.when(~simple, title))))


def normal_phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\W_]+", " "))


def phrase_occurs(phrase: str, normal_text: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), normal_text, F.lit(" ")), F.lit(f" {phrase} "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def canonical_key(doi: Column, pmid: Column, arxiv: Column, title: Column, year: Column) -> Column:
    """The first identifier there is, or the title's normal form and year."""
    some = lambda x: F.nullif(x, F.lit(""))
    named = F.concat(F.lit("title:"), F.coalesce(normal_title(title), F.lit("")), F.lit(":"), F.coalesce(year, F.lit(0)).cast("string"))
    return F.coalesce(F.concat(F.lit("doi:"), some(doi)), F.concat(F.lit("pmid:"), some(pmid)), F.concat(F.lit("arxiv:"), F.lower(some(arxiv))), named)


def citation_key(doi: Column, pmid: Column, arxiv: Column, title: Column, year: Column) -> Column:
    some = lambda x: F.nullif(x, F.lit(""))
    base = F.concat(F.coalesce(some(doi), some(pmid), some(arxiv), title), F.lit("|"), F.coalesce(year.cast("string"), F.lit("None")))
    return F.concat(F.lit("ref_"), F.substring(F.sha1(base.cast("binary")), 1, 10))


def identifier_keys(doi: Column, pmid: Column, arxiv: Column, source_ids: Column) -> Column:
    """Keys any of which makes two records one work."""
    some = lambda p, x: F.concat(F.lit(p), F.lower(F.nullif(x, F.lit(""))))
    own = F.array_compact(F.array(some("doi:", doi), some("pmid:", pmid), some("arxiv:", arxiv)))
    return F.array_distinct(F.concat(own, F.coalesce(F.transform(F.map_entries(source_ids), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), F.array().cast("array<string>"))))


def license_allows(license_: Column, pdf_url: Column) -> Column:
    value = F.lower(F.coalesce(license_, F.lit("")))
    marked = F.lit(False)
    for m in LICENSE_MARKERS:
        marked = marked | F.contains(value, F.lit(m))
    return marked & (F.coalesce(pdf_url, F.lit("")) != "")


def has_contact(text: Column) -> Column:
    found = F.lit(False)
    for p in CONTACTS.values():
        found = found | F.coalesce(text.rlike(p), F.lit(False))
    return found


def valid_url(url: Column) -> Column:
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def csl_type(work_type: Column) -> Column:
    kind = F.lower(F.coalesce(work_type, F.lit("")))
    has = lambda *words: kind.rlike("|".join(words))
    return F.when(has("book", "monograph"), "book").when(has("chapter"), "chapter").when(has("proceeding", "conference"), "paper-conference").when(has("thesis", "dissertation"), "thesis").when(has("report"), "report").otherwise("article-journal")


def csl_item(p: dict[str, Column]) -> Column:
    """A CSL record as JSON; fields without a value are left out."""
    return F.to_json(
        F.struct(
            p["citation_key"].alias("id"),
            csl_type(p["work_type"]).alias("type"),
            p["title"].alias("title"),
            F.transform(F.coalesce(p["authors"], F.array().cast("array<string>")), lambda a: F.struct(a.alias("literal"))).alias("author"),
            F.nullif(p["venue"], F.lit("")).alias("container-title"),
            F.when(p["year"] > 0, F.struct(F.array(F.array(p["year"])).alias("date-parts"))).alias("issued"),
            F.nullif(p["doi"], F.lit("")).alias("DOI"),
            F.nullif(p["landing_page_url"], F.lit("")).alias("URL"),
        )
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fulltext_reason(text: Column, pages: Column, abstract: Column) -> Column:
    """Why a text isn't a substantive article, or ``substantive_fulltext``."""
    flat = lambda t: stripped(F.regexp_replace(t, r"(?U)\s+", " "))
    whole = flat(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\[Page\s+\d+\]\s*", " "))

    def judged(body: Column, a: Column) -> Column:
        signals = sum((body.rlike(p).cast("int") for p in SECTION_SIGNALS), F.lit(0))
        n = F.length(body)
        return (
            F.when(n < 2000, "insufficient_extracted_text")
            .when((a >= 200) & (n < F.greatest(F.lit(2000), F.floor(a * 1.75))), "document_is_not_substantially_longer_than_abstract")
            .when(~((pages >= 4) & (n >= 6000)) & (signals < 2), "insufficient_fulltext_structure")
            .otherwise("substantive_fulltext")
        )

    bound = let(whole, lambda body: let(F.length(flat(F.coalesce(abstract, F.lit("")))), lambda a: judged(body, a)))
    return F.when(pages < 2, "single_page_document").otherwise(bound)


def token_estimate(text: Column) -> Column:
    words = F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.floor(words * 1.6), F.ceil(F.octet_length(text) / 2.5), F.lit(1))).cast("long")


def price(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Money for tokens at prices a million, rounded up to four places."""
    total = input_tokens.cast("decimal(18,0)") * input_price.cast("decimal(10,4)") + output_tokens.cast("decimal(18,0)") * output_price.cast("decimal(10,4)")
    return F.ceil(total / F.lit(1_000_000).cast("decimal(10,0)"), F.lit(4)).cast("decimal(18,4)")


def inverted_index(texts: DataFrame) -> DataFrame:
    """(doc_id, index) of each row of ``texts`` (doc_id, text): a map of word to its positions; null has none.

    A text is a row, so its index is made where the row is and no word is shuffled.
    """
    import pyarrow as pa

    kind = pa.map_(pa.string(), pa.list_(pa.int32()))

    def indexed(text: str | None) -> list[tuple[str, list[int]]] | None:
        if text is None:
            return None
        found: dict[str, list[int]] = {}
        for at, word in enumerate(w for w in text.replace("\n", " ").split(" ") if w):
            found.setdefault(word, []).append(at)
        return list(found.items())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for first in range(0, whole.num_rows, 100):
                part = whole.slice(first, 100)
                made = pa.array([indexed(t) for t in part.column("text").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), made], names=["doc_id", "index"])

    return texts.mapInArrow(batches, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, index map<string,array<int>>")


def decoded_index(index: Column) -> Column:
    """A text from a map of word to its positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: p["word"]), " ")


def group_id(task_id: Column) -> Column:
    """A task id without the mark of a single execution."""
    return F.when(F.contains(task_id, F.lit(":gh-")), F.substring_index(task_id, ":gh-", 1)).otherwise(F.substring_index(task_id, ":local-", 1))


def ordered_unique(values: Column) -> Column:
    """Distinct entries that aren't blank, stripped, in order of first sight; null gives none."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(values, stripped), lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def parsed_json(content: Column, schema: str) -> Column:
    """A JSON object out of an answer that may stand between code fences; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(stripped(content), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(bare, F.lit("{")), F.from_json(bare, schema))


def fragments(markdown: Column, limit: int = 3000) -> Column:
    """Paragraphs packed greedily into fragments of ``limit`` characters at most, where a paragraph allows it; a blank text is one fragment."""
    blank = F.lit("")
    parts = F.filter(F.transform(F.split(markdown, r"\n{2,}"), stripped), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), blank.alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        fits = (acc["open"] == "") | (F.length(joined) <= limit)
        return F.when(fits, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")))

    return F.aggregate(parts, start, step, lambda a: F.when(a["open"] == "", F.array(markdown)).otherwise(F.concat(a["done"], F.array(a["open"]))))


#: Several citations in one bracket, and one citation repeated in brackets side by side.
CLUSTER = r"\[((?:@[A-Za-z0-9_.:-]+)(?:;\s*@[A-Za-z0-9_.:-]+)+)\]"
REPEATED = r"\[@([A-Za-z0-9_.:-]+)\](?:\s*\[@\1\])+"
#: What a bare key reads as in prose.
THIS_STUDY = "该研究"


def cluster_unique(text: Column) -> Column:
    """Citations of one bracket only once, in order, and bracketed repeats side by side only once."""
    inside = F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(1))
    shown = F.transform(inside, lambda c: F.concat(F.lit("["), F.array_join(F.array_distinct(F.transform(F.split(c, ";"), stripped)), "; "), F.lit("]")))
    whole = F.array_join(F.transform(F.arrays_zip(F.split(text, CLUSTER, -1).alias("gap"), shown.alias("cluster")), lambda x: F.concat(x["gap"], F.coalesce(x["cluster"], F.lit("")))), "")
    return F.regexp_replace(F.when(text.rlike(CLUSTER), whole).otherwise(text), REPEATED, "[@$1]")


def rewritten_citations(text: Column, aliases: Column) -> Column:
    """Evidence identifiers replaced by citation keys, longest first; numbered cards of a key cut to it; bare keys reworded; repeats dropped.

    ``aliases`` is an array of structs (alias, key).
    """
    longest = lambda values: F.array_sort(values, lambda a, b: F.when(F.length(a) == F.length(b), F.when(a < b, -1).when(a > b, 1).otherwise(0)).otherwise(F.length(b) - F.length(a)))
    by_length = F.array_sort(aliases, lambda a, b: F.length(b["alias"]) - F.length(a["alias"]))
    swapped = F.aggregate(by_length, text, lambda t, a: F.replace(t, F.concat(F.lit("@"), a["alias"]), F.concat(F.lit("@"), a["key"])))

    def plain(t: Column, key: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), key, F.lit("\\E"))
        cut = F.regexp_replace(t, F.concat(F.lit("(?U)(@"), quoted, F.lit(r")_e\d+\b")), F.lit("$1"))
        return F.regexp_replace(cut, F.concat(F.lit("(?<![@A-Za-z0-9_.:-])"), quoted, F.lit("(?![A-Za-z0-9_.:-])")), F.lit(THIS_STUDY))

    return cluster_unique(F.aggregate(longest(F.array_distinct(F.transform(aliases, lambda a: a["key"]))), swapped, plain))


def unfinished(body: Column) -> Column:
    """Whether the last paragraph of a section stops before the end of a sentence."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\n\s*\n"), stripped), lambda p: p != "")
    last = F.coalesce(F.try_element_at(paragraphs, F.lit(-1)), F.lit(""))
    ending = F.regexp_replace(last, r"(?U)(?:\s*\[@[^\]]+\])+\s*$", "")
    ending = F.regexp_replace(ending, "(?U)[\\s”’\"'）)\\]】》〉」』*_`]+$", "")
    return ~ending.rlike("[。！？；：.!?;:…]$")
