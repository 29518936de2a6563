"""Settings files: JSON, or the plain subset of YAML with nested keys and scalars; secrets from env files."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    collection: str = "points"
    dimensions: int = 384
    top_k: int = 8
    generator: str = "offline"
    embedding: str = "hash_v1"

    def __post_init__(self):
        if not 64 <= self.dimensions <= 4096 or not 1 <= self.top_k <= 100 or not self.collection.strip():
            raise ValueError("dimensions from 64 to 4096, top_k from 1 to 100, a collection")


def scalar(text: str):
    """A plain YAML scalar."""
    plain = text.strip()
    if plain[:1] in "\"'" and plain[-1:] == plain[:1] and len(plain) > 1:
        return plain[1:-1]
    if plain.lower() in ("null", "~", ""):
        return None
    if plain.lower() in ("true", "false"):
        return plain.lower() == "true"
    return int(plain) if re.fullmatch(r"-?\d+", plain) else float(plain) if re.fullmatch(r"-?\d+\.\d+", plain) else plain


def parse(text: str) -> dict:
    """The tree of a settings text; indentation nests, comments and blank lines are skipped."""
    if text.lstrip()[:1] == "{":
        return json.loads(text)
    root: dict = {}
    stack = [(-1, root)]
    for number, line in enumerate(text.splitlines(), 1):
        body = re.sub(r"\s+#.*$|^\s*#.*$", "", line)
        if not body.strip():
            continue
        key, colon, value = body.strip().partition(":")
        if not colon:
            raise ValueError(f"line {number}: a key and a colon are expected")
        indent = len(body) - len(body.lstrip())
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = scalar(value)
        else:
            stack.append((indent, stack[-1][1].setdefault(key.strip(), {})))
    return root


def load(path: str) -> Settings:
    return Settings(**parse(Path(path).read_text()))


def read_env(path: str) -> None:
    """Sets the variables of an env file that are not yet set; a missing file is none."""
    if Path(path).exists():
        for line in Path(path).read_text().splitlines():
            key, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and not key.startswith("#"):
                os.environ.setdefault(key.strip(), str(scalar(value) or ""))
