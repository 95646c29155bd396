"""Seed files: evidence, papers and checkpoints of an earlier run."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.spec import SpecError, confined

CARD = "evidence_id string, record_id string, citation_key string, claim string, result string, evidence_type string, study_design string, population string, limitations array<string>, locator string, confidence string, fulltext_verified boolean"
PAPER = "record_id string, title string, abstract string, year int, publication_date string, authors array<string>, venue string, work_type string, doi string, pmid string, pmcid string, arxiv_id string, citation_count long, source_names array<string>, open_access_pdf_url string, open_access_license string, publication_status string"
LISTS = ("cards", "log", "papers", "evidence_digest_batches")


def read_seed(spark: SparkSession, base: str | Path, relative: str | None) -> dict:
    """cards and papers (DataFrames with ``ord``), log and digest (lists) and writing_checkpoints (mapping) of a seed file below ``base``.

    Without a file all are empty. A symbolic link, another root than a mapping
    or another form of a part is an error, as is a card or paper without its identifiers.
    """
    data: dict = {}
    if relative:
        confined(base, relative)
        path = Path(base, relative)
        if path.is_symlink() or not path.is_file():
            raise SpecError(f"no seed file {path.name}")
        data = json.loads(path.read_text(encoding="utf-8"))
        if not isinstance(data, dict):
            raise SpecError("a seed is a JSON object")
    if any(not isinstance(data.get(name) or [], list) for name in LISTS) or not isinstance(data.get("writing_checkpoints") or {}, dict):
        raise SpecError("parts of a seed are arrays, and its checkpoints an object")

    def table(name: str, schema: str, needed: tuple[str, ...]) -> DataFrame:
        rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(data.get(name) or [])], "ord long, item string")
        got = rows.select("ord", F.from_json("item", schema).alias("x")).select("ord", "x.*")
        whole = F.lit(True)
        for c in needed:
            whole = whole & F.col(c).isNotNull()
        return got.where(F.assert_true(whole, f"{name}: {', '.join(needed)} are needed").isNull())

    return {
        "cards": table("cards", CARD, ("evidence_id", "record_id", "claim")),
        "papers": table("papers", PAPER, ("record_id", "title")),
        "log": [x for x in data.get("log") or [] if isinstance(x, dict)],
        "digest": [x for x in data.get("evidence_digest_batches") or [] if isinstance(x, dict)],
        "writing_checkpoints": dict(data.get("writing_checkpoints") or {}),
    }


def without_seeded(papers: DataFrame, seeded: DataFrame, key: str = "canonical_key") -> DataFrame:
    """Papers whose key no seeded paper has."""
    return papers.join(seeded.select(key).distinct(), key, "left_anti")
