"""A staged ingest: extract, validate, match, transform and load, with a report per stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from leaguelens.operators.contracts import CONTRACTS, check_columns, check_rows, conform
from leaguelens.operators.store import TableStore, WriteResult


@dataclass
class StageReport:
    name: str
    status: str = "ok"
    warnings: list[str] = field(default_factory=list)


@dataclass
class Report:
    stages: list[StageReport] = field(default_factory=list)
    written: list[WriteResult] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(s.status == "ok" for s in self.stages)


class PipelineError(RuntimeError):
    """A stage failed; ``report`` says how far the run came."""

    def __init__(self, message: str, report: Report):
        super().__init__(message)
        self.report = report


def run_pipeline(extract: Callable[[], dict[str, DataFrame]], store: TableStore, sport: str = "", transform: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None, mode: str = "overwrite", dry_run: bool = False, strict: bool = True) -> Report:
    """Extract frames by entity, check them against their contracts, transform and write them.

    Tables of a sport get its prefix.  Football needs weekly stats to have scoring rules
    (``scoring guard``).  A failing stage raises with the report so far.
    """
    report = Report()
    frames: dict[str, DataFrame] = {}

    def stage(name: str, body: Callable[[StageReport], None]) -> None:
        entry = StageReport(name)
        report.stages.append(entry)
        try:
            body(entry)
        except Exception as error:
            entry.status = "failed"
            error.add_note(f"in stage {name}")
            raise PipelineError(f"{name}: {error}", report) from error

    def collect(_: StageReport) -> None:
        frames.update(extract())

    def check(entry: StageReport) -> None:
        for name in [n for n in frames if n in CONTRACTS]:
            problems = check_columns(frames[name], CONTRACTS[name], allow_extra=True)
            frames[name] = conform(frames[name], CONTRACTS[name])
            problems += check_rows(frames[name], CONTRACTS[name], allow_empty=True)
            if problems and strict:
                raise ValueError("; ".join(problems))
            entry.warnings += problems

    def guard(entry: StageReport) -> None:
        if sport == "nfl" and "player_stats_weekly" in frames and "scoring_rule" not in frames:
            entry.warnings.append("weekly stats without scoring rules")

    def change(_: StageReport) -> None:
        if transform:
            frames.update(transform(dict(frames)))

    def load(_: StageReport) -> None:
        report.written += store.persist(frames, mode, f"{sport}_" if sport else "", dry_run)

    for name, body in (("collect", collect), ("validate", check), ("scoring_guard", guard), ("transform", change), ("load", load)):
        stage(name, body)
    return report
