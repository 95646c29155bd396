"""Papers from the JSON answers of bibliographic services.

``raw`` frames have (rank, item): the place of an item in its query's answer
and the item as JSON. Each parser returns the columns of ``FIELDS``, after those to be ``kept``.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import decoded_index, first_text, normal_doi, safe_int, stripped

FIELDS = {
    "record_id": "string", "title": "string", "abstract": "string", "year": "int", "publication_date": "string", "authors": "array<string>", "venue": "string", "work_type": "string",
    "doi": "string", "pmid": "string", "pmcid": "string", "arxiv_id": "string", "citation_count": "bigint", "influential_citation_count": "bigint", "source_names": "array<string>",
    "source_ids": "map<string,string>", "landing_page_url": "string", "open_access_pdf_url": "string", "open_access_license": "string", "topics": "array<string>", "source_relevance": "double", "referenced_work_ids": "array<string>",
}

CROSSREF = "struct<title: array<string>, DOI: string, author: array<struct<family: string, given: string>>, abstract: string, link: array<struct<`content-type`: string, URL: string>>, license: array<struct<URL: string>>, `container-title`: array<string>, type: string, `is-referenced-by-count`: string, URL: string, published: struct<`date-parts`: array<array<string>>>, `published-print`: struct<`date-parts`: array<array<string>>>, `published-online`: struct<`date-parts`: array<array<string>>>>"
SEMANTIC_SCHOLAR = "struct<title: string, paperId: string, externalIds: struct<DOI: string, PubMed: string, ArXiv: string>, authors: array<struct<name: string>>, openAccessPdf: struct<url: string>, fieldsOfStudy: array<string>, publicationTypes: array<string>, abstract: string, year: string, publicationDate: string, venue: string, citationCount: string, influentialCitationCount: string, url: string>"
EUROPE_PMC = "struct<title: string, id: string, source: string, authorList: struct<author: array<struct<fullName: string>>>, fullTextUrlList: struct<fullTextUrl: array<struct<documentStyle: string, availability: string, url: string>>>, license: string, pmcid: string, pmid: string, doi: string, abstractText: string, pubYear: string, firstPublicationDate: string, journalTitle: string, pubType: string, citedByCount: string, meshHeadingList: struct<meshHeading: array<string>>>"
OPENALEX = "struct<id: string, title: string, doi: string, publication_year: string, publication_date: string, type: string, cited_by_count: string, authorships: array<struct<author: struct<display_name: string>>>, topics: array<struct<display_name: string>>, referenced_works: array<string>, abstract_inverted_index: map<string,array<int>>, open_access: struct<oa_url: string>>"

def text(value: Column) -> Column:
    return F.nullif(stripped(value), F.lit(""))


def unescaped(value: Column) -> Column:
    """HTML entities decoded; only texts with an ampersand go to Python."""

    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else html.unescape(v))

    decode.__annotations__ = {"values": pd.Series, "return": pd.Series}
    marked = F.contains(value, F.lit("&"))
    return F.when(marked, F.pandas_udf(decode, "string")(F.when(marked, value))).otherwise(value)


def plain(markup: Column) -> Column:
    """Markup without tags and entities, white space collapsed."""
    return stripped(F.regexp_replace(unescaped(F.regexp_replace(markup, "<[^>]+>", " ")), r"(?U)\s+", " "))


def crossref_date(item: Column) -> Column:
    """(date, year) of the first of three dates that has numbers."""

    def one(name: str) -> Column:
        numbers = F.filter(F.transform(item[name]["date-parts"][0], safe_int), lambda n: n != 0)
        shown = F.array_join(F.transform(numbers, lambda n: F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))), "-")
        return F.when(F.size(numbers) > 0, F.struct(shown.alias("date"), F.get(numbers, 0).alias("year")))

    return F.coalesce(one("published"), one("published-print"), one("published-online"))


def finished(rows: DataFrame, columns: dict[str, Column], kept: tuple[str, ...]) -> DataFrame:
    made = rows.select(*kept, *[columns.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in FIELDS.items()])
    return made.where(F.col("title").isNotNull() & F.col("record_id").isNotNull())


def common(name: str, source_id: Column) -> dict[str, Column]:
    return {"source_names": F.array(F.lit(name)), "source_ids": F.create_map(F.lit(name), source_id), "source_relevance": 1.0 / (1.0 + F.col("__rank"))}


def crossref(raw: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    rows = raw.select(*kept, F.col("rank").alias("__rank"), F.from_json("item", CROSSREF).alias("i")).withColumn("d", crossref_date(F.col("i"))).withColumn("t", first_text(F.col("i.title")))
    i = F.col("i")
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("t"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    own = F.coalesce(text(i["DOI"]), slug)
    pdf = F.filter(F.transform(F.filter(i["link"], lambda x: F.contains(F.lower(F.coalesce(x["content-type"], F.lit(""))), F.lit("pdf"))), lambda x: text(x["URL"])), lambda u: u.isNotNull())
    names = F.transform(i["author"], lambda a: F.concat_ws(" ", text(a["given"]), text(a["family"])))
    return finished(rows, common("crossref", own) | {
        "record_id": F.concat(F.lit("crossref:"), own), "title": F.col("t"), "abstract": text(plain(text(i["abstract"]))), "year": F.col("d.year"), "publication_date": F.col("d.date"),
        "authors": F.coalesce(F.filter(names, lambda n: n != ""), F.array()), "venue": first_text(i["container-title"]), "work_type": text(i["type"]), "doi": normal_doi(i["DOI"]),
        "citation_count": safe_int(i["is-referenced-by-count"]), "landing_page_url": text(i["URL"]), "open_access_pdf_url": F.get(pdf, 0), "open_access_license": text(F.get(i["license"], 0)["URL"]), "topics": F.array(),
    }, kept)


def semantic_scholar(raw: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    rows = raw.select(*kept, F.col("rank").alias("__rank"), F.from_json("item", SEMANTIC_SCHOLAR).alias("i"))
    i = F.col("i")
    own = text(i["paperId"])
    return finished(rows, common("semantic_scholar", own) | {
        "record_id": F.concat(F.lit("semantic_scholar:"), own), "title": text(i["title"]), "abstract": text(i["abstract"]), "year": F.nullif(safe_int(i["year"]), F.lit(0)), "publication_date": text(i["publicationDate"]),
        "authors": F.coalesce(F.filter(F.transform(i["authors"], lambda a: text(a["name"])), lambda n: n.isNotNull()), F.array()), "venue": text(i["venue"]), "work_type": first_text(i["publicationTypes"]), "doi": normal_doi(i["externalIds"]["DOI"]),
        "pmid": text(i["externalIds"]["PubMed"]), "arxiv_id": text(i["externalIds"]["ArXiv"]), "citation_count": safe_int(i["citationCount"]), "influential_citation_count": safe_int(i["influentialCitationCount"]), "landing_page_url": text(i["url"]),
        "open_access_pdf_url": text(i["openAccessPdf"]["url"]), "topics": F.coalesce(F.filter(i["fieldsOfStudy"], lambda f: f != ""), F.array()),
    }, kept)


def europe_pmc(raw: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    rows = raw.select(*kept, F.col("rank").alias("__rank"), F.from_json("item", EUROPE_PMC).alias("i"))
    i = F.col("i")
    own, archive = text(i["id"]), F.coalesce(i["source"], F.lit("MED"))
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    pdf = F.filter(F.transform(F.filter(i["fullTextUrlList"]["fullTextUrl"], lambda u: (low(u["documentStyle"]) == "pdf") & low(u["availability"]).isin("open access", "free")), lambda u: text(u["url"])), lambda u: u.isNotNull())
    return finished(rows, common("europe_pmc", own) | {
        "record_id": F.concat(F.lit("europe_pmc:"), archive, F.lit(":"), own), "title": text(i["title"]), "abstract": text(i["abstractText"]), "year": F.nullif(safe_int(i["pubYear"]), F.lit(0)), "publication_date": text(i["firstPublicationDate"]),
        "authors": F.coalesce(F.filter(F.transform(i["authorList"]["author"], lambda a: text(a["fullName"])), lambda n: n.isNotNull()), F.array()), "venue": text(i["journalTitle"]), "work_type": text(i["pubType"]), "doi": normal_doi(i["doi"]), "pmid": text(i["pmid"]), "pmcid": text(i["pmcid"]),
        "citation_count": safe_int(i["citedByCount"]), "landing_page_url": F.concat(F.lit("https://europepmc.org/article/"), archive, F.lit("/"), own), "open_access_pdf_url": F.get(pdf, 0), "open_access_license": text(i["license"]), "topics": F.coalesce(i["meshHeadingList"]["meshHeading"], F.array()),
    }, kept)


def openalex(raw: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    rows = raw.select(*kept, F.col("rank").alias("__rank"), F.from_json("item", OPENALEX).alias("i"))
    i = F.col("i")
    own = text(i["id"])
    last = lambda u: F.element_at(F.split(u, "/"), -1)
    return finished(rows, common("openalex", own) | {
        "record_id": F.concat(F.lit("openalex:"), last(own)), "title": text(i["title"]), "abstract": text(decoded_index(i["abstract_inverted_index"])), "year": F.nullif(safe_int(i["publication_year"]), F.lit(0)), "publication_date": text(i["publication_date"]),
        "authors": F.coalesce(F.filter(F.transform(i["authorships"], lambda a: text(a["author"]["display_name"])), lambda n: n.isNotNull()), F.array()), "work_type": text(i["type"]), "doi": normal_doi(i["doi"]), "citation_count": safe_int(i["cited_by_count"]), "landing_page_url": own, "open_access_pdf_url": text(i["open_access"]["oa_url"]),
        "topics": F.coalesce(F.slice(F.transform(i["topics"], lambda t: t["display_name"]), 1, 10), F.array()), "referenced_work_ids": F.coalesce(F.transform(i["referenced_works"], last), F.array()),
    }, kept)


PARSERS = {"crossref": crossref, "semantic_scholar": semantic_scholar, "europe_pmc": europe_pmc, "openalex": openalex}
