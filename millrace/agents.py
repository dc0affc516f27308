"""Failures: what happened to a chunk, and what to do about it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

# What an out-of-memory failure says of itself, and the memory step.
OOM_WORDS = ("memoryerror", "oom", "out of memory", "killed")
MEM_STEP = 4096
NEAR = 0.9
ACTIONS = ("resplit", "retry_with", "skip", "report", "abort")


@dataclass
class FailureEvent:
    stage: str
    task_key: str
    params: dict = field(default_factory=dict)
    attempt: int = 0
    error: str = ""
    traceback: str = ""
    peak_mem_mb: float | None = None
    limit_mb: float | None = None
    members: list[dict] = field(default_factory=list)
    resources: dict = field(default_factory=dict)
    peers: dict = field(default_factory=dict)

    @property
    def near_oom(self) -> bool:
        return bool(self.peak_mem_mb and self.limit_mb and self.peak_mem_mb >= NEAR * self.limit_mb)

    @property
    def out_of_memory(self) -> bool:
        said = f"{self.error}\n{self.traceback}".lower()
        return self.near_oom or any(w in said for w in OOM_WORDS)


@dataclass
class Remediation:
    action: str
    diagnosis: str = ""
    fix: str = ""
    mem: int | None = None
    vcpu: int | None = None

    @classmethod
    def of(cls, d: dict) -> Remediation:
        if d.get("action") not in ACTIONS:
            raise ValueError(f"unknown action {d.get('action')!r}")
        return cls(**{k: d[k] for k in ("action", "diagnosis", "fix", "mem", "vcpu") if d.get(k) is not None})


def heuristic(event: FailureEvent, tools: Any = None) -> Remediation:
    """Split a packed chunk that ran out of memory, give a single one twice as much, report the rest."""
    if not event.out_of_memory:
        return Remediation("report", f"{event.task_key}: {event.error or 'failed'}")
    if len(event.members) > 1:
        return Remediation("resplit", f"{event.task_key} ran out of memory over {len(event.members)} members")
    mem = -(-2 * int(event.resources.get("mem") or MEM_STEP) // MEM_STEP) * MEM_STEP
    return Remediation("retry_with", f"{event.task_key} ran out of memory", mem=mem)


def first_object(text: str) -> dict | None:
    """The first JSON object in a text with other things around it."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            found = None
        if isinstance(found, dict):
            return found
        at = text.find("{", at + 1)
    return None


class DiagnosticTools:
    """Read-only views of a run for handlers."""

    def __init__(self, status: Any, pipe: Any) -> None:
        self.status, self.pipe = status, pipe

    def read_marker(self, key: str) -> dict | None:
        row = self.status.latest().get(key)
        return row if row and row["state"] == "success" else None

    def read_failure(self, key: str) -> dict | None:
        row = self.status.latest().get(key)
        return row if row and row["state"] == "failed" else None

    def list_failures(self) -> list[str]:
        return sorted(k for k, r in self.status.latest().items() if r["state"] == "failed")

    def peer_stats(self, stage: str) -> dict:
        peaks = [r["peak_mem_mb"] or 0.0 for r in self.status.latest().values() if r["stage"] == stage and r["state"] == "success"]
        return {"n": len(peaks), "max_peak_mem_mb": max(peaks, default=None)}

    def read_stage_source(self, stage: str) -> str:
        return self.pipe.stages[stage].source_text() if stage in self.pipe.stages else ""


Complete = Callable[[str], str]


class LLMFailureAgent:
    """Asks ``complete(prompt)`` for a remediation in JSON; anything else falls back to the heuristic."""

    def __init__(self, complete: Complete | None = None, notify: Callable[[str], None] | None = None) -> None:
        self.complete, self.notify = complete, notify

    def prompt(self, event: FailureEvent, tools: DiagnosticTools | None) -> str:
        code = tools.read_stage_source(event.stage) if tools else ""
        return f"A chunk of a data pipeline failed. Answer with one JSON object with the keys action (one of {', '.join(ACTIONS)}), diagnosis, fix, mem and vcpu.\n\nFailure:\n{json.dumps(event.__dict__, default=str, indent=1)}\n\nStage:\n{code}"

    def __call__(self, event: FailureEvent, tools: DiagnosticTools | None = None) -> Remediation:
        try:
            found = first_object(self.complete(self.prompt(event, tools))) if self.complete else None
            out = Remediation.of(found) if found else heuristic(event)
        except Exception:  # noqa: BLE001 - whatever the model or its transport does, the heuristic answers
            out = heuristic(event)
        if self.notify:
            self.notify(f"{event.task_key}: {out.action}: {out.diagnosis}")
        return out


class Investigator:
    """Answers questions about a run through ``complete``."""

    def __init__(self, status: Any, pipe: Any, complete: Complete | None = None) -> None:
        self.tools, self.pipe, self.complete = DiagnosticTools(status, pipe), pipe, complete

    def event(self, key: str) -> FailureEvent:
        row = self.tools.read_failure(key) or {}
        stage = key.split("/", 1)[0]
        return FailureEvent(stage, key, error=row.get("error") or "", traceback=row.get("traceback") or "", peak_mem_mb=row.get("peak_mem_mb"), limit_mb=row.get("limit_mb"), members=json.loads(row.get("chunk") or "{}").get("members", []), resources=self.pipe.stages[stage].resources(self.pipe.config) if stage in self.pipe.stages else {}, peers=self.tools.peer_stats(stage))

    def diagnose(self, key: str) -> dict:
        return LLMFailureAgent(self.complete)(self.event(key), self.tools).__dict__

    def ask(self, question: str, key: str | None = None) -> dict:
        about = json.dumps(self.event(key).__dict__, default=str) if key else json.dumps(self.tools.list_failures())
        return {"answer": self.complete(f"{question}\n\nContext:\n{about}") if self.complete else "no model is configured"}

    def check_run(self) -> dict:
        counts: dict[str, dict[str, int]] = {}
        for r in self.tools.status.latest().values():
            by = counts.setdefault(r["stage"], {})
            by[r["state"]] = by.get(r["state"], 0) + 1
        said = first_object(self.complete(f"Is this run healthy? Answer in JSON.\n{json.dumps(counts)}")) if self.complete else None
        return {"summary": counts, "failures": self.tools.list_failures(), "verdict": said}
