"""Audit trail, replay script, and a routing loop with an injected chat client. A model routes; it never computes."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from providerfx.sources.io import write_json
from providerfx.tools import tools

PROMPT = "You route questions on provider profiling to tools. Inspect data before naming columns, call one tool at a time, and report only numbers that a tool returned."


@dataclass
class Event:
    tool: str
    asked: dict
    effective: dict
    status: str
    summary: dict
    latency_ms: int
    error: str | None = None
    at: float = field(default_factory=time.time)


@dataclass
class Trace:
    query: str
    model: str = ""
    prompt_sha256: str = hashlib.sha256(PROMPT.encode()).hexdigest()
    turns: int = 0
    exposed: dict | None = None
    events: list[Event] = field(default_factory=list)

    def save(self, path: str) -> None:
        write_json(asdict(self), path)


def summarise(result) -> dict:
    """Scalars and slopes of a result; sizes of the rest."""
    if not isinstance(result, dict):
        return {"status": "non_dict", "type": type(result).__name__}
    out = {}
    for k, v in result.items():
        if k == "beta" or not isinstance(v, (list, dict)):
            out[k] = v
        else:
            out[k + ("_length" if isinstance(v, list) else "_keys")] = len(v)
    return out


def call(spark: SparkSession, trace: Trace, name: str, **given) -> dict:
    """One traced tool call."""
    began = time.perf_counter()
    result = tools.dispatch(spark, name, **given)
    effective = tools.resolve_args(name, given, spark.sparkContext.defaultParallelism)[0]
    trace.events.append(Event(name, given, effective, result.get("status", "?"), summarise(result), int(1000 * (time.perf_counter() - began)), result.get("message")))
    return result


def write_repro(trace: Trace, path: str) -> None:
    """A script that runs the successful calls of a trace again and compares slopes and p-values."""
    calls = [(e.tool, e.effective, {k: e.summary.get(k) for k in ("beta", "p_value") if e.summary.get(k) is not None}) for e in trace.events if e.status == "ok"]
    lines = ["from pyspark.sql import SparkSession", "from providerfx.tools.tools import dispatch", "", "spark = SparkSession.builder.getOrCreate()", f"calls = {calls!r}", "for name, args, before in calls:", "    now = dispatch(spark, name, **args)", "    print(name, now['status'], {k: (v, now.get(k)) for k, v in before.items()})", ""]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


class Agent:
    """client(messages, tool_names) returns {"content": str} or {"tool": name, "args": dict}."""

    def __init__(self, spark: SparkSession, client, model: str = "", max_turns: int = 8):
        self.spark, self.client, self.model, self.max_turns = spark, client, model, max_turns

    def query(self, text: str, data_path: str | None = None, task: str | None = None) -> tuple[str, Trace]:
        trace, messages, seen = Trace(text, self.model), [{"role": "system", "content": PROMPT}, {"role": "user", "content": text}], None
        if data_path:
            seen = call(self.spark, trace, "inspect_data", data_path=data_path)
            messages.append({"role": "system", "content": json.dumps({"data_path": data_path, "mapping": seen.get("mapping")})})
        names, trace.exposed = tools.select_tools(seen, bool(data_path), task)
        for _ in range(self.max_turns):
            trace.turns += 1
            reply = self.client(messages, names)
            if not reply.get("tool"):
                return reply.get("content", ""), trace
            result = call(self.spark, trace, reply["tool"], **reply.get("args", {})) if reply["tool"] in names else tools.error("ToolNotOffered", f"{reply['tool']} is not offered here")
            messages.append({"role": "tool", "name": reply["tool"], "content": json.dumps(tools.compress_result(result), default=str)})
        return "no answer within the allowed turns", trace
