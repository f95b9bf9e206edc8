"""The discovery run: eight phases over tables, each with its counts.

A phase names the tables it needs and those it gives. What it gives is written before the next phase starts. A phase
that fails is reported and gives nothing: tables of its own from an earlier run go, so that a later phase that needs
them is skipped instead of working on stale rows. Base tables (papers, queue) stay as they were.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import audit, expansion, gaps, merge, taxonomy
from corpusloom.sources.sinks import bundle_records
from corpusloom.workspace import materialise

Tables = dict[str, DataFrame]
BASE = ("papers", "queue")


@dataclass
class Phase:
    """``run`` makes the tables ``gives`` of those in ``needs``; the first one's rows are counted."""

    name: str
    run: Callable[[Tables], Tables]
    needs: tuple[str, ...]
    gives: tuple[str, ...]


@dataclass
class Run:
    tables: Tables
    stats: list[tuple] = field(default_factory=list)

    def phase(self, p: Phase) -> None:
        began, rows, error = time.time(), None, None
        lacking = [n for n in p.needs if n not in self.tables]
        if lacking:
            state, error = "skipped", f"needs {', '.join(lacking)}"
        else:
            try:
                new = {n: materialise(df, n) for n, df in p.run(self.tables).items()}
                self.tables = self.tables | new
                rows, state = new[p.gives[0]].count(), "done"
            except Exception as e:  # the report says what failed
                state, error = "failed", f"{type(e).__name__}: {str(e)[:200]}"
        if state != "done":
            self.tables = {n: df for n, df in self.tables.items() if n not in p.gives or n in BASE}
        self.stats.append((p.name, state, rows, round(time.time() - began, 3), error))

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stats, "phase string, state string, rows long, seconds double, error string")


def _import(t: Tables) -> Tables:
    """Rows (columns of papers) whose id is new."""
    new = t["rows"].select(*t["papers"].columns)
    return {"papers": t["papers"].unionByName(merge.insert_ignore(t["papers"], new, ["paper_id"], ["title"]))}


def _classify(t: Tables) -> Tables:
    """Scores of the papers' vectors against the nodes, and triage."""
    scores = taxonomy.node_scores(t["vectors"], t["nodes"], id_col="paper_id", least=0.25)
    return {"triaged": taxonomy.triage(taxonomy.facet_max(scores, "paper_id"), "paper_id"), "scores": scores}


def _expand(t: Tables) -> Tables:
    return {"queue": expansion.enqueue(t["queue"], t["citations"], t["papers"])}


def _acquire(t: Tables) -> Tables:
    return {"downloads": audit.download_candidates(t["papers"], t["files"]).select("paper_id", "doi")}


def _bundle(t: Tables) -> Tables:
    """Job bundles of the papers that triage sends on."""
    chosen = t["papers"].drop("triage_score", "triage_decision").join(t["triaged"].where("decision = 'send_to_eater'").select("paper_id", "triage_score", F.col("decision").alias("triage_decision")), "paper_id")
    kinds = {"authors": "array<string>", "year": "int", "triage_score": "double"}
    full = chosen.select("*", *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ("doi", "title", "authors", "year", "venue", "abstract", "pdf_path", "pdf_sha256") if c not in chosen.columns])
    return {"bundles": bundle_records(full)}


def _feedback(t: Tables) -> Tables:
    return {"follow_up": gaps.follow_up_queries(t["claims"])}


def _gaps(t: Tables) -> Tables:
    rolled = gaps.rolled_up(t["scores"], "paper_id")
    factors, outcomes = (t["taxonomy"].where((F.col("facet_id") == f) & (F.col("level") <= 2)) for f in ("environmental_factors", "outcomes"))
    papers = gaps.pair_evidence(rolled, factors, outcomes, "paper_id", "paper_count")
    cov = materialise(gaps.coverage(gaps.grid(factors, outcomes), papers, gaps.claim_evidence(t["claims"])), "coverage")
    return {"gaps": gaps.ranked_gaps(gaps.coverage_gaps(cov), gaps.mechanism_gaps(cov)), "coverage": cov}


def _target(t: Tables) -> Tables:
    """Cells to search for, of the gaps, theory and neural ones first."""
    known = t["cells"] if "cells" in t else t["gaps"].limit(0).select(F.col("gap_id").alias("cell_id"))
    return {"targets": gaps.select_cells(gaps.cells_from_gaps(t["gaps"], known))}


PHASES = [
    Phase("import", _import, ("papers", "rows"), ("papers",)), Phase("classify", _classify, ("vectors", "nodes"), ("triaged", "scores")), Phase("expand", _expand, ("queue", "citations", "papers"), ("queue",)),
    Phase("acquire", _acquire, ("papers", "files"), ("downloads",)), Phase("bundle", _bundle, ("papers", "triaged"), ("bundles",)), Phase("feedback", _feedback, ("claims",), ("follow_up",)),
    Phase("gaps", _gaps, ("scores", "taxonomy", "claims"), ("gaps", "coverage")), Phase("target", _target, ("gaps",), ("targets",)),
]


def discover(tables: Tables, *, extra: list[Phase] = ()) -> Run:
    """All phases in order; ``extra`` phases (downloads, extraction) come first."""
    run = Run(dict(tables))
    for p in [*extra, *PHASES]:
        run.phase(p)
    return run
