"""Publication status from update notices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.paced import lookups

# Update types that are adverse, and the status they give.
ADVERSE_TERMS = {"retraction": "retracted", "withdrawal": "withdrawn", "expression-of-concern": "expression_of_concern"}
# Relations that are updates, in order.
RELATIONS = {"is-retracted-by": "retraction", "is-corrected-by": "correction", "is-updated-by": "update"}
MESSAGE = "struct<`update-to`: array<struct<type: string, DOI: string, label: string>>, relation: struct<" + ", ".join(f"`{k}`: array<struct<id: string>>" for k in RELATIONS) + ">>"


def updates(message: Column) -> Column:
    """Structs (type, doi, label): listed updates, then relations in order."""
    text = lambda x: F.coalesce(x, F.lit(""))
    none = F.array().cast("array<struct<type: string, doi: string, label: string>>")
    listed = F.coalesce(F.transform(F.filter(message["update-to"], lambda u: u.isNotNull()), lambda u: F.struct(F.lower(F.coalesce(F.nullif(u["type"], F.lit("")), F.lit("update"))).alias("type"), text(u["DOI"]).alias("doi"), text(u["label"]).alias("label"))), none)
    related = [_related(message, k, t, none) for k, t in RELATIONS.items()]
    return F.concat(listed, *related)


def _related(message: Column, name: str, kind: str, none: Column) -> Column:
    rows = F.filter(message["relation"][name], lambda r: r.isNotNull())
    return F.coalesce(F.transform(rows, lambda r: F.struct(F.lit(kind).alias("type"), F.coalesce(r["id"], F.lit("")).alias("doi"), F.lit(name).alias("label"))), none)


def status(found: Column, doi: Column, failed: Column) -> Column:
    """The first adverse update's status, else updated or no_adverse_update_found; without a DOI or an answer, why."""
    terms = F.create_map(*[F.lit(x) for kv in ADVERSE_TERMS.items() for x in kv])
    adverse = F.get(F.filter(F.transform(found, lambda u: terms[u["type"]]), lambda x: x.isNotNull()), 0)
    return F.when(F.coalesce(doi, F.lit("")) == "", "identifier_unavailable").when(failed, "check_failed").otherwise(F.coalesce(adverse, F.when(F.size(found) > 0, "updated").otherwise("no_adverse_update_found")))


def checked(papers: DataFrame, answers: DataFrame) -> DataFrame:
    """Papers with status, updates and flags from ``answers`` (doi, message as JSON; null: the lookup failed)."""
    got = papers.join(answers.select("doi", F.from_json("message", MESSAGE).alias("__m"), F.lit(True).alias("__got")).withColumn("__ok", F.col("__m").isNotNull()), "doi", "left")
    failed = ~F.coalesce("__ok", F.lit(False))
    found = F.when(~failed, updates(F.col("__m"))).otherwise(F.array().cast("array<struct<type: string, doi: string, label: string>>"))
    out = got.withColumn("publication_updates", found).withColumn("publication_status", status(F.col("publication_updates"), F.col("doi"), failed))
    s = F.col("publication_status")
    flag = F.when(s == "identifier_unavailable", "publication_update_check_limited").when(s == "check_failed", "publication_update_check_failed").when(s.isin(*set(ADVERSE_TERMS.values())), F.concat(F.lit("publication_status_"), s))
    flags = F.coalesce(F.col("quality_flags"), F.array().cast("array<string>")) if "quality_flags" in papers.columns else F.array().cast("array<string>")
    return out.withColumn("quality_flags", F.concat(flags, F.array_compact(F.array(flag)))).drop("__m", "__got", "__ok")


def unresolved(papers: DataFrame) -> DataFrame:
    return papers.where((F.coalesce("doi", F.lit("")) != "") & F.col("publication_status").isin("unchecked", "check_failed"))


def refreshed(papers: DataFrame, fetch: Callable[[str], str], **pace) -> DataFrame:
    """``papers``, those whose status is unresolved looked up at one rate (see ``paced.lookups``); ``fetch`` gives a DOI's message as JSON."""
    open_ = unresolved(papers)
    got = lookups(open_.select(F.col("doi").alias("key")), fetch, **pace)
    now = checked(open_, got.select(F.col("key").alias("doi"), F.col("answer").alias("message")))
    rest = papers.join(open_.select("record_id").distinct(), "record_id", "left_anti")
    return rest.unionByName(now, allowMissingColumns=True)
