"""JSON-RPC over lines: tools that answer from a memory store."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO

from ..operators import extract, kg, topicgraph
from .memory import Memory, now

S, I, N = "string", "integer", "number"
PARSE, METHOD, INTERNAL = -32700, -32601, -32603


def rows(df) -> list[dict]:
    """Rows of an answer, which its limit or the question bounds."""
    return [r.asDict(recursive=True) for r in df.collect()]


def counted(name: str, items: list, **more) -> dict:
    return more | {"count": len(items), name: items}


class Server:
    def __init__(self, memory: Memory, prefix: str = "memory_", name: str = "loquat", version: str = "1"):
        self.memory, self.prefix, self.name, self.version = memory, prefix, name, version
        #: name: (handler, description, required and optional arguments with their types)
        self.tools: dict[str, tuple[Callable, str, dict, dict]] = {
            "status": (self.memory.status, "Counts of the store.", {}, {}),
            "list_domains": (self.domains, "All domains.", {}, {}),
            "list_topics": (self.topics, "Topics, of one domain if given.", {}, {"domain": S}),
            "search": (self.search, "Search the store.", {"query": S}, {"domain": S, "topic": S, "limit": I}),
            "check_duplicate": (self.duplicate, "Is the content stored already?", {"content": S}, {"threshold": N}),
            "add_chunk": (self.add, "Add a chunk.", {"domain": S, "topic": S, "content": S}, {"source_file": S, "added_by": S}),
            "delete_chunk": (self.delete, "Delete a chunk by id.", {"chunk_id": S}, {}),
            "kg_query": (self.kg_query, "Facts about an entity.", {"entity": S}, {"as_of": S, "direction": S}),
            "kg_add": (self.kg_add, "Add a fact.", {"subject": S, "predicate": S, "object": S}, {"valid_from": S, "source_ref": S, "source_closet": S}),
            "kg_invalidate": (self.kg_end, "End a fact.", {"subject": S, "predicate": S, "object": S}, {"ended": S}),
            "kg_timeline": (self.kg_timeline, "Facts by time.", {}, {"entity": S}),
            "kg_stats": (self.memory.kg_stats, "Counts of the knowledge graph.", {}, {}),
            "traverse": (self.traverse, "Topics near a topic.", {"start_room": S}, {"max_hops": I}),
            "find_links": (self.links, "Topics that join domains.", {}, {"domain_a": S, "domain_b": S}),
            "graph_stats": (self.graph_stats, "Counts of the topic graph.", {}, {}),
            "log_write": (self.log_write, "Write an agent's log entry.", {"agent_name": S, "entry": S, "topic": S}, {}),
            "log_read": (self.log_read, "Read an agent's log.", {"agent_name": S}, {"last_n": I}),
            "get_aaak_spec": (extract.spec, "The summary format.", {}, {}),
        }

    # tools

    def domains(self):
        found = sorted(r.domain for r in self.memory.chunks().select("domain").distinct().collect())
        return counted("domains", found)

    def topics(self, domain: str | None = None):
        found = sorted(r.topic for r in self.memory.chunks(domain).select("topic").distinct().collect())
        return counted("topics", found, domain=domain or "all")

    def search(self, query: str, domain: str | None = None, topic: str | None = None, limit: int = 5):
        return counted("results", rows(self.memory.search(query, domain, topic, limit).select("id", "domain", "topic", "category", "snippet", "score")), query=query)

    def duplicate(self, content: str, threshold: float = 0.9):
        return {"is_duplicate": self.memory.is_duplicate(content, threshold), "threshold": threshold}

    def add(self, domain: str, topic: str, content: str, source_file: str = "", added_by: str = "service"):
        return {"success": True, "chunk_id": self.memory.add_chunk(domain, topic, content, source_file, added_by), "domain": domain, "topic": topic}

    def delete(self, chunk_id: str):
        self.memory.delete_chunk(chunk_id)
        return {"success": True, "chunk_id": chunk_id}

    def kg_query(self, entity: str, as_of: str | None = None, direction: str = "both"):
        facts = kg.query_entity(self.memory.triples(), entity, as_of, direction)
        return counted("facts", rows(facts.select("subject", "predicate", "object", "valid_from", "valid_to", "confidence")), entity=entity, direction=direction)

    def kg_add(self, subject: str, predicate: str, object: str, valid_from: str | None = None, source_ref: str | None = None, source_closet: str | None = None):  # noqa: A002
        key = self.memory.add_fact(subject, predicate, object, valid_from, source_ref=source_ref or source_closet)
        return {"success": True, "triple_id": key, "subject": subject, "predicate": predicate, "object": object}

    def kg_end(self, subject: str, predicate: str, object: str, ended: str | None = None):  # noqa: A002
        self.memory.end_fact(subject, predicate, object, ended)
        return {"success": True, "subject": subject, "predicate": predicate, "object": object}

    def kg_timeline(self, entity: str | None = None):
        facts = kg.timeline(self.memory.triples(), entity)
        return counted("timeline", rows(facts.select("subject", "predicate", "object", "valid_from", "valid_to")), entity=entity or "all")

    def traverse(self, start_room: str, max_hops: int = 2):
        start = self.memory.spark.createDataFrame([(start_room,)], "start string")
        found = topicgraph.traverse_all(self.memory.nodes(), start, max_hops).orderBy("hops", "topic_key")
        return counted("topics", [{"topic": r["topic_key"], "domain": r["domain"], "hops": r["hops"]} for r in rows(found)], start_room=start_room, max_hops=max_hops)

    def links(self, domain_a: str | None = None, domain_b: str | None = None):
        found = [{"topic": r["topic_key"], "connected_domains": r["domains"]} for r in rows(topicgraph.links(self.memory.nodes(), domain_a, domain_b))]
        return counted("links", found, domain_a=domain_a, domain_b=domain_b)

    def graph_stats(self):
        n = self.memory.nodes()
        s = topicgraph.stats(n, topicgraph.edges(n)).first()
        return {"node_count": s.nodes, "edge_count": s.edges, "link_count": s.links, "domain_count": s.domains}

    def log_write(self, agent_name: str, entry: str, topic: str):
        return {"success": True, "chunk_id": self.memory.log_write(agent_name, entry, topic), "agent_name": agent_name, "topic": topic, "filed_at": now()}

    def log_read(self, agent_name: str, last_n: int = 10):
        found = self.memory.log_read(agent_name, last_n)
        return {"agent_name": agent_name, "count": len(found), "entries": "\n---\n".join(found) or f"No log entries found for {agent_name}."}

    # protocol

    def call(self, name: str, arguments: dict | None) -> dict:
        handler, _, required, optional = self.tools[name.removeprefix(self.prefix)]
        given = {k: v for k, v in (arguments or {}).items() if k in required | optional and v is not None}
        for k in required:
            if k not in given:
                raise ValueError(f"{k} is required")
        answer = handler(**given)
        return {"content": [{"type": "text", "text": answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False)}]}

    def describe(self) -> list[dict]:
        def schema(required: dict, optional: dict) -> dict:
            return {"type": "object", "properties": {k: {"type": t} for k, t in (required | optional).items()}, "required": list(required)}

        return [{"name": self.prefix + k, "description": d, "inputSchema": schema(r, o)} for k, (_, d, r, o) in self.tools.items()]

    def handle(self, line: str) -> dict | None:
        """Answer to one request line; None for notifications."""
        def failed(key, code: int, message: str) -> dict:
            return {"jsonrpc": "2.0", "id": None if key is None else str(key), "error": {"code": code, "message": message}}

        try:
            request = json.loads(line)
            if not isinstance(request, dict):
                raise ValueError
        except ValueError:
            return failed(None, PARSE, "Parse error")
        method, key, params = request.get("method") or "", request.get("id"), request.get("params") or {}
        if key is None and not method.startswith("initialize"):
            return None
        try:
            if method == "initialize":
                result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": self.name, "version": self.version}}
            elif method == "tools/list":
                result = {"tools": self.describe()}
            elif method == "tools/call" and params.get("name", "").removeprefix(self.prefix) not in self.tools:
                return failed(key, INTERNAL, f"Unknown tool: {params.get('name', '')}")
            elif method == "tools/call":
                result = self.call(params["name"], params.get("arguments"))
            else:
                return None if key is None else failed(key, METHOD, f"Method not found: {method}")
        except Exception as e:  # any failure of a tool is an answer, not the server's end
            return failed(key, INTERNAL, str(e))
        return {"jsonrpc": "2.0", "id": None if key is None else str(key), "result": result}

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        for line in lines:
            answer = self.handle(line) if line.strip() else None
            if answer is not None:
                out.write(json.dumps(answer, ensure_ascii=False) + "\n")
                out.flush()
