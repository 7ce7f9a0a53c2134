"""Files beside the store: configuration, the registry of names, two summaries.

They are small files of one user's folder, read and written on the driver."""

from __future__ import annotations

import json
import os

from ..operators.entities import assign_codes

CONFIG = {"store": "~/.loquat", "index": "~/.loquat/index", "embed": True}
REGISTRY = {"mode": "personal", "people": {}, "projects": [], "ambiguous_flags": []}


def _read(path: str) -> dict:
    """A JSON object; {} where the file is missing, damaged or something else."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except (FileNotFoundError, ValueError):
        return {}
    return held if isinstance(held, dict) else {}


def _write(path: str, value: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)


def load_config(path: str) -> dict:
    """The settings, with defaults for what is missing; a missing file is written."""
    held = _read(path)
    if not os.path.exists(path):
        _write(path, CONFIG)
    return CONFIG | {k: v for k, v in held.items() if v is not None}


def save_config(path: str, config: dict) -> None:
    _write(path, config)


def load_registry(path: str) -> dict:
    """People, projects and ambiguous names; a missing or damaged file is an empty registry."""
    held = _read(path)
    return held | {k: held[k] if isinstance(held.get(k), type(v)) else v for k, v in REGISTRY.items()}


def save_registry(path: str, registry: dict) -> None:
    _write(path, registry)


def edited(values: list[str], edits: str) -> list[str]:
    """A list after `+add,-remove` tokens, case folded; other tokens change nothing."""
    out = list(values)
    for token in (t.strip() for t in edits.split(",")):
        name = token[1:].strip()
        if token.startswith("+") and name and name.lower() not in map(str.lower, out):
            out.append(name)
        elif token.startswith("-"):
            out = [x for x in out if x.lower() != name.lower()]
    return out


def code_table(people: dict, projects: list[str]) -> str:
    """Names and their codes as two Markdown tables."""
    codes = assign_codes([*people, *(p for p in projects if p not in people)])
    lines = ["# Entity codes", "", "## People", "| Name | Code | Relationship |", "|------|------|-------------|"]
    lines += [f"| {n} | {codes[n]} | {e.get('relationship', '')} |" for n, e in people.items()]
    lines += ["", "## Projects", "| Name | Code |", "|------|------|", *(f"| {p} | {codes[p]} |" for p in projects)]
    return "\n".join(lines) + "\n"


def facts(registry: dict, domains: list[str]) -> str:
    return "\n".join([
        "# Critical facts", f"Mode: {registry['mode']}", f"Domains: {', '.join(domains)}",
        f"People: {', '.join(registry['people'])}", f"Projects: {', '.join(registry['projects'])}"]) + "\n"


def bootstrap(folder: str, registry: dict, domains: list[str]) -> None:
    """Write the code table and the facts into a store's folder."""
    os.makedirs(folder, exist_ok=True)
    for name, text in (("entity_codes.md", code_table(registry["people"], registry["projects"])), ("critical_facts.md", facts(registry, domains))):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
