"""Small files on the driver: texts, JSON and YAML, in UTF-8; folders are made as needed."""

from __future__ import annotations

import json
from pathlib import Path


def read_text(path: str) -> str:
    return Path(path).read_text("utf-8")


def write_text(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, "utf-8")


def read_json(path: str) -> object:
    return json.loads(read_text(path))


def write_json(path: str, value: object) -> None:
    write_text(path, json.dumps(value, indent=2, ensure_ascii=False, default=str))


def read_yaml(path: str) -> object:
    import yaml  # not among what this package needs

    return yaml.safe_load(read_text(path))


def write_yaml(path: str, value: object) -> None:
    """JSON is YAML too; plain maps and lists of scalars are written in block style."""
    write_text(path, "\n".join(_block(json.loads(json.dumps(value, default=str)), 0)) + "\n")


def _block(value: object, depth: int) -> list[str]:
    pad = "  " * depth
    if isinstance(value, dict) and value:
        out = []
        for k, v in value.items():
            inner = _block(v, depth + 1)
            out += [f"{pad}{json.dumps(k, ensure_ascii=False)}:", *inner] if isinstance(v, dict | list) and v else [f"{pad}{json.dumps(k, ensure_ascii=False)}: {inner[0].strip()}"]
        return out
    if isinstance(value, list) and value:
        out = []
        for v in value:
            inner = _block(v, depth + 1)
            out += [f"{pad}-", *inner] if isinstance(v, dict | list) and v else [f"{pad}- {inner[0].strip()}"]
        return out
    return [pad + json.dumps(value, ensure_ascii=False)]
