"""Extension points: named detectors (DataFrame to DataFrame), per-file checks, and their scheduling."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

FINDING = "path string, line int, rule_id string, severity string, detail string"


@dataclass
class Frame:
    """A detector over all files: what it needs, when it runs, and whether it is on."""

    id: str
    run: Callable[[DataFrame], DataFrame]
    priority: int = 999
    requires: tuple[str, ...] = ()
    enabled: bool = True


@dataclass
class Registry:
    frames: dict[str, Frame] = field(default_factory=dict)

    def register(self, frame: Frame) -> None:
        self.frames[frame.id] = frame

    def check(self, rule_id: str, severity: str, test: Callable[[str, str], Iterable[tuple[int, str]]], **options) -> None:
        """Registers a Python function (path, content) -> (line, detail) rows; it runs in Arrow batches."""

        def run(files: DataFrame) -> DataFrame:
            def batches(pdfs):
                import pandas as pd

                for pdf in pdfs:
                    rows = [(p, n, rule_id, severity, d) for p, c in zip(pdf["path"], pdf["content"]) for n, d in test(p, c or "")]
                    yield pd.DataFrame(rows, columns=["path", "line", "rule_id", "severity", "detail"])

            return files.select("path", "content").mapInPandas(batches, FINDING)

        self.register(Frame(rule_id, run, **options))

    def selected(self, chosen: Iterable[str] | None = None, disabled: Iterable[str] = (), allowed: Iterable[str] | None = None) -> list[Frame]:
        """Chosen (or all) frames that are on, not disabled, allowed, and whose requirements are selected too, by priority."""
        ids = set(self.frames if chosen is None else chosen) & {i for i, f in self.frames.items() if f.enabled} - set(disabled)
        if allowed is not None:
            ids &= set(allowed)
        while lost := {i for i in ids if not set(self.frames[i].requires) <= ids}:
            ids -= lost
        return sorted((self.frames[i] for i in ids), key=lambda f: (f.priority, f.id))

    def groups(self, **choice) -> list[list[str]]:
        """Ids by ascending priority; frames of a group can run together."""
        out: dict[int, list[str]] = {}
        for f in self.selected(**choice):
            out.setdefault(f.priority, []).append(f.id)
        return [out[p] for p in sorted(out)]

    def scan(self, files: DataFrame, **choice) -> DataFrame:
        parts = [f.run(files).select("path", "line", "rule_id", "severity", "detail") for f in self.selected(**choice)]
        return reduce(DataFrame.unionByName, parts)


def model_calls(n_files: int, level: str, n_frames: int) -> int:
    """What a dry run says of model calls: none, one or two a file by level, for each model frame (one at least)."""
    return n_files * {"basic": 0, "standard": 1, "deep": 2}[level] * max(n_frames, 1)
