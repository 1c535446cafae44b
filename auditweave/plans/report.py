"""Exports: CSV and JSON through Spark's writers, and a page of HTML."""

from __future__ import annotations

import datetime
import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as F_
from ..operators import reviews as R
from .audit import Audit

# The columns of the exports.
FINDING_COLUMNS = ["finding_id", "kind", "severity", "confidence_label", "method", "sample_a", "sample_b", "split_a", "split_b", "class_a", "class_b",
    "distance", "similarity", "cross_split", "conflicting_label", "group_id", "review_decision", "review_note"]
REPAIR_COLUMNS = ["sample_id", "original_split", "proposed_split", "class", "group_id", "action", "reason"]
FINDING_FIELDS = ["kind", "severity", "confidence_label", "method", "sample_a", "sample_b", "split_a", "split_b", "class_a", "class_b", "distance",
    "similarity", "cross_split", "conflicting_label"]
#: Findings on the HTML page, which says how many there are.
SHOWN = 400
LIMITATIONS = ["Perceptual and embedding matches are candidates, not proof.", "Only what the enabled searches find is reported.",
    "The diagnostic classifier measures sensitivity to leaks, not a model's quality."]
RESPONSIBLE_USE = "Originals are never changed; review findings before acting on a manifest."


def findings_table(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    return F_.ordered(R.joined(findings, reviews)).withColumn("review_note", F.coalesce("review_note", F.lit(""))).select(*FINDING_COLUMNS)


def findings_json(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """A row for each finding in order, with its review as an object."""
    rows = F_.ordered(R.joined(findings, reviews))
    return rows.select(F.col("finding_id").alias("id"), *FINDING_FIELDS,
        F.struct(F.col("review_decision").alias("decision"), F.col("review_note").alias("note")).alias("review"))


def repair_table(entries: DataFrame) -> DataFrame:
    return entries.orderBy("idx").withColumn("class", F.col("label")).withColumn("group_id", F.coalesce("group_id", F.lit(""))).select(*REPAIR_COLUMNS)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def report(audit: Audit, name: str, created_at: str, evaluation: bool = True, job_id: str | None = None, findings_path: str | None = None) -> dict:
    """The parts of a report, with all findings in order. With findings_path these are written there as JSON by Spark, for audits whose
    findings a driver can't hold; the parts then name the path and have the first ones that the HTML page shows."""
    rows = findings_json(audit.findings, audit.decisions)
    total = audit.findings.count()
    if findings_path:
        write_json(rows, findings_path)
        rows = rows.limit(SHOWN)
    repair = audit.repair()
    summary = audit.summary()
    return {
        "report_version": 1, "generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat(),
        "audit": {"job_id": job_id, "dataset_name": name, "created_at": created_at, "dataset_fingerprint_sha256": summary["fingerprint"]},
        "configuration": vars(audit.config), "environment": {"spark": audit.spark.version, "random_seed": audit.config.seed, "embedding_backend": "classical"},
        "summary": summary, "evaluation": audit.evaluation().first().asDict() if evaluation else None,
        "repair_plan": {**repair.counts.first().asDict(), "delta": [r.asDict() for r in repair.delta.orderBy("split").collect()],
            "warnings": [r.warning for r in repair.warnings.collect()]},
        "findings": [r.asDict(recursive=True) for r in rows.collect()], "findings_total": total, "findings_path": findings_path,
        "limitations": LIMITATIONS, "responsible_use": RESPONSIBLE_USE,
    }


def to_json(parts: dict) -> str:
    return json.dumps(parts, indent=1, default=str)


def to_html(parts: dict) -> str:
    """A page with the score, its components and the first findings; all text is escaped."""
    e = lambda x: html.escape(str(x))
    row = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{e(c)}</{tag}>" for c in cells) + "</tr>"
    score, found = parts["summary"]["score"], parts["findings"][:SHOWN]
    columns = FINDING_FIELDS[:12]
    note = f"<p>Showing the first {len(found)} of {parts['findings_total']} findings.</p>" if parts["findings_total"] > len(found) else ""
    return "".join([
        f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{e(parts['audit']['dataset_name'])}</title></head><body>",
        f"<h1>{e(parts['audit']['dataset_name'])}</h1><p>Integrity score {e(score['score'])} / 100: {e(score['grade'])}</p>",
        "<table>" + row(["category", "affected", "penalty"], "th")
            + "".join(row([c["category"], c["affected_samples"], c["penalty"]]) for c in parts["summary"]["score_components"]) + "</table>",
        "<table>" + row(columns, "th") + "".join(row([f[c] for c in columns]) for f in found) + "</table>", note,
        "<ul>" + "".join(f"<li>{e(x)}</li>" for x in parts["limitations"]) + f"</ul><p>{e(parts['responsible_use'])}</p></body></html>",
    ])
