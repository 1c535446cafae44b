"""A whole audit as one graph of DataFrames over samples."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..operators import candidates as C
from ..operators import evaluation as E
from ..operators import findings as F_
from ..operators import inventory as I
from ..operators import repair as R
from ..operators import score as S
from ..operators.classes import Classes
from ..sources import archives, images
from ..storage import fresh_path, materialize


@dataclass
class Audit:
    """What an audit can tell of samples. Each part is planned when asked for; findings are written once and read by the rest."""

    samples: DataFrame
    config: M.AuditConfig = field(default_factory=M.AuditConfig)
    reviews: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.samples.sparkSession

    @cached_property
    def decisions(self) -> DataFrame:
        return self.reviews if self.reviews is not None else self.spark.createDataFrame([], M.REVIEWS)

    @cached_property
    def candidates(self) -> DataFrame:
        """The union of the searches that the configuration asks for."""
        c = self.config
        found = [
            *([C.exact_pairs(self.samples)] if c.enable_exact else []),
            *([C.hamming_pairs(self.samples, c.phash_threshold)] if c.enable_perceptual else []),
            *([self.similar] if c.enable_semantic else []),
        ]
        if not found:
            return self.spark.createDataFrame([], "a long, b long, method string, distance double, similarity double")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    @cached_property
    def pairs(self) -> DataFrame:
        """The findings without group ids. Repair and score read these: no components of all findings are sought for them, nor joined at each read."""
        return F_.build(self.samples, self.candidates, self.config.phash_strong_threshold, grouped=False)

    @cached_property
    def findings(self) -> DataFrame:
        return F_.with_groups(self.pairs)

    @cached_property
    def totals(self) -> DataFrame:
        return I.totals(self.samples)

    @cached_property
    def issues(self) -> DataFrame:
        return I.issues(self.samples)

    @cached_property
    def similar(self) -> DataFrame | None:
        """Embedding pairs, if the configuration asks for them; written once."""
        c = self.config
        return materialize(C.cosine_pairs(self.samples, c.semantic_top_k, c.semantic_threshold), "similar") if c.enable_semantic else None

    @cached_property
    def classes(self) -> Classes:
        """The findings by classes of equal content: counts, groups and score without a row for each pair."""
        c = self.config
        return Classes(self.samples, c.phash_threshold, c.phash_strong_threshold, self.similar, c.enable_exact, c.enable_perceptual)

    def score_components(self, excluded: DataFrame | None = None) -> DataFrame:
        """From the findings where they are known or some don't count, else from classes."""
        if excluded is None and "pairs" not in self.__dict__:
            return S.weighed(self.classes.affected(), self.totals)
        return S.components(self.pairs, self.totals, excluded)

    def score(self, excluded: DataFrame | None = None) -> DataFrame:
        return S.integrity(self.score_components(excluded))

    def repair(self, include_semantic: bool = False) -> Repair:
        """The plan; groups are tied and entries written once, whatever is asked of it."""
        if include_semantic not in self._repairs:
            self._repairs[include_semantic] = self._repair(include_semantic)
        return self._repairs[include_semantic]

    @cached_property
    def _repairs(self) -> dict[bool, Repair]:
        return {}

    @cached_property
    def verdicts(self) -> DataFrame:
        return R.verdicts(self.pairs, self.decisions)

    def _repair(self, include_semantic: bool) -> Repair:
        tied = R.members_of(self.verdicts, include_semantic)
        groups = materialize(R.plan_groups_of(self.samples, self.verdicts, tied), "groups")
        entries = materialize(R.manifest(self.samples, tied, groups), "entries")
        return Repair(groups, tied, entries, R.action_counts(entries), R.split_delta(self.samples, entries),
            R.warnings(self.samples, self.pairs, self.decisions, entries, include_semantic))

    def evaluation(self) -> DataFrame:
        return E.gap(self.samples, self.findings, self.decisions, self.config)

    def with_reviews(self, reviews: DataFrame) -> Audit:
        """The same evidence under other decisions: nothing is searched again."""
        other = Audit(self.samples, self.config, reviews)
        other.__dict__.update({k: v for k, v in self.__dict__.items() if k in ("pairs", "findings", "candidates", "similar", "classes", "totals", "issues")})
        return other

    def summary(self) -> dict:
        """Counts, score and inventory for a page or a report."""
        by = {"kind": dict.fromkeys(M.PAIR_KINDS, 0), "severity": dict.fromkeys(M.SEVERITIES, 0)}
        counts = self.pairs.groupBy("kind", "severity").agg(F.count("*").alias("n")) if "pairs" in self.__dict__ else self.classes.counts()
        for r in counts.collect():  # some rows of kinds and severities
            by["kind"][r.kind] += r.n
            by["severity"][r.severity] += r.n
        return {
            "totals": self.totals.first().asDict(), "counts": by["kind"], "severity_counts": by["severity"],
            "score": self.score().first().asDict(), "score_components": [r.asDict() for r in self.score_components().orderBy("position").collect()],
            "dataset_issues": [r.asDict() for r in self.issues.collect()], "fingerprint": I.fingerprint(self.samples).first()[0],
                "merkle_root": I.merkle_root(self.samples).first()[0],
        }


@dataclass
class Repair:
    groups: DataFrame
    tied: DataFrame
    entries: DataFrame
    counts: DataFrame
    delta: DataFrame
    warnings: DataFrame


def audit_folder(spark: SparkSession, root: str, config: M.AuditConfig | None = None, reviews: DataFrame | None = None) -> Audit:
    """Audits the image files below a folder that the cluster can read. Pictures are decoded once, whatever is asked of the audit."""
    files = archives.accepted(archives.folder_entries(spark, root))
    return Audit(materialize(images.samples(spark, root, files), "samples"), config or M.AuditConfig(), reviews)


def audit_archive(spark: SparkSession, path: str, config: M.AuditConfig | None = None, reviews: DataFrame | None = None,
    limits: M.Limits = M.Limits()) -> tuple[Audit, DataFrame]:
    """Audits the pictures in the archives under path; also what was rejected (path, reason). Members are read once, into the shared folder under
    names of our own, and decoded from there.

    Raises IngestError if the upload as a whole is refused."""
    folder = fresh_path(spark, "extracted")
    taken = archives.extract(archives.scan(archives.archive_entries(spark, path), limits), folder)
    samples = materialize(images.samples(spark, folder, archives.accepted(taken), limits=limits), "samples")
    return Audit(samples, config or M.AuditConfig(), reviews), archives.rejected(taken)


def capabilities() -> dict:
    """Limits, defaults and what searches there are."""
    limits, config = M.Limits(), M.AuditConfig()
    return {"limits": vars(limits), "defaults": {k: getattr(config, k) for k in config.__dataclass_fields__}, "methods": list(M.METHODS),
        "embedding_backend": "classical", "stages": [k for k, _ in M.STAGES]}
