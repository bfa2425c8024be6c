"""Small JSON settings on the driver."""

from __future__ import annotations

import json
from pathlib import Path


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(settings: dict, path: str) -> None:
    Path(path).write_text(json.dumps(settings, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
