"""Configuration: settings from environment and a file, the map of parties, prompts of the stages."""

from __future__ import annotations

import json
import os
import string
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

# The stages that a bundle of prompts must hold.
STAGES = ["instruction", "fund_inventory", "base_date", "t_day", "transfer_amount", "settle_class", "order_type"]
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


@dataclass(frozen=True)
class Settings:
    """Every field may be set by an environment variable ORDERLOOM_<FIELD>, or in a file of NAME=value lines."""

    model: str = "rules"
    timeout: int = 120
    tries: int = 3
    backoff: float = 1.5
    chunk_chars: int = 12_000
    batch: int = 12
    only_pending: bool = False
    keep_handoff: bool = False


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines and those that begin with # are skipped, quotes around a value are dropped."""
    out: dict[str, str] = {}
    if os.path.isfile(path):
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and name.strip() and not name.startswith("#"):
                value = value.strip()
                out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def settings(env: Mapping[str, str] | None = None, path: str = ".env") -> Settings:
    """The shell's variables win over the file's; a value that doesn't fit its type is an error."""
    env = {**read_env_file(path), **(os.environ if env is None else env)}
    got: dict = {}
    for f in fields(Settings):
        raw = env.get(f"ORDERLOOM_{f.name.upper()}", "").strip()
        if not raw:
            continue
        if f.type == "bool":
            if raw.lower() not in TRUE + FALSE:
                raise ValueError(f"ORDERLOOM_{f.name.upper()}: no truth value: {raw}")
            got[f.name] = raw.lower() in TRUE
        else:
            got[f.name] = {"int": int, "float": float, "str": str}[f.type](raw)
    return Settings(**got)


def read_parties(path: str) -> tuple[list[tuple[str, list[str], list[str]]], list[str]]:
    """(the map for joins.resolve_party, what was left out) of a JSON list of {name, text_tokens, file_tokens}.

    A row without a name or without any token is left out and told; the others stand.
    """
    out, bad = [], []
    for i, row in enumerate(json.loads(Path(path).read_text(encoding="utf-8"))):
        tokens = [[str(t).strip().lower() for t in (row.get(k) or []) if str(t).strip()] if isinstance(row, dict) and isinstance(row.get(k) or [], list) else [] for k in ("text_tokens", "file_tokens")]
        name = str(row.get("name") or "").strip() if isinstance(row, dict) else ""
        if name and any(tokens):
            out.append((name, *tokens))
        else:
            bad.append(f"row {i + 1}: no name or no token")
    return out, bad


def read_prompts(path: str, required: tuple[str, ...] = ("document", "items"), optional: tuple[str, ...] = ("retry", "guidance")) -> dict[str, str]:
    """The stages' prompts of a JSON list of {stage, prompt}: all stages, none twice, each with the fields it needs and no others."""
    out: dict[str, str] = {}
    for row in json.loads(Path(path).read_text(encoding="utf-8")):
        stage, prompt = row["stage"], row["prompt"]
        if stage in out:
            raise ValueError(f"stage {stage} stands twice")
        named = {name for _, name, _, _ in string.Formatter().parse(prompt) if name}
        if missing := set(required) - named:
            raise ValueError(f"prompt of {stage} lacks {sorted(missing)}")
        if more := named - set(required) - set(optional):
            raise ValueError(f"prompt of {stage} has unknown fields {sorted(more)}")
        out[stage] = prompt
    if missing := set(STAGES) - set(out):
        raise ValueError(f"no prompt for {sorted(missing)}")
    return out


class Prompts:
    """Prompts that follow their file: read anew when it changes; a broken file leaves the last good ones in force."""

    def __init__(self, path: str):
        self.path, self.stamp, self.bundle, self.error = path, 0, {}, ""
        self.refresh()

    def refresh(self) -> dict[str, str]:
        try:
            stamp = os.stat(self.path).st_mtime_ns
            if stamp != self.stamp:
                self.bundle, self.stamp, self.error = read_prompts(self.path), stamp, ""
        except (OSError, ValueError, KeyError, TypeError) as e:
            self.error = str(e)
            if not self.bundle:
                raise
        return dict(self.bundle)
