"""A record of what was launched, as JSON lines, and a Graphviz writer for it."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field


@dataclass
class Trace:
    """Events in order; written to the file named by GRIDLOOM_TRACE as they come, if set."""

    events: list[dict] = field(default_factory=list)
    path: str | None = field(default_factory=lambda: os.environ.get("GRIDLOOM_TRACE"))

    def add(self, kind: str, **facts: object) -> int:
        event = {"id": len(self.events), "kind": kind, "time": time.time(), **facts}
        self.events.append(event)
        if self.path:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps(event) + "\n")
        return event["id"]


def load(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


def to_dot(events: list[dict], start: int = 0, end: int | None = None, arrays: bool = True) -> str:
    """Events as a graph: an edge leads from each version of an array to what reads it."""
    lines = ["digraph plan {", "  rankdir=LR;"]
    made: dict[str, str] = {}
    for e in events:
        node = f"e{e['id']}"
        shown = start <= e["id"] and (end is None or e["id"] < end)
        if shown:
            lines.append(f'  {node} [shape=box,label="{e["kind"]} {e.get("name", "")}"];')
        for a in e.get("reads", []):
            if shown and a in made:
                lines.append(f"  {made[a]} -> {node};")
        for a in e.get("writes", []):
            if arrays and shown:
                lines.append(f'  "{a}@{node}" [shape=ellipse,label="{a}"];')
                lines.append(f'  {node} -> "{a}@{node}";')
                made[a] = f'"{a}@{node}"'
            elif shown:
                made[a] = node
    return "\n".join([*lines, "}"])
