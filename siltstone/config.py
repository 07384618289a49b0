"""Settings of the preparation: defaults, dotted lookup and validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

MODES = ("paragraph", "conversation", "dpo", "rl")
EXTRACT = ("both", "chosen", "rejected")


def nested(data: dict, path: str, default=None):
    """A value by its dotted path."""
    for part in path.split("."):
        if not isinstance(data, dict) or part not in data:
            return default
        data = data[part]
    return data


@dataclass(frozen=True)
class Preparation:
    mode: str = "paragraph"
    min_tokens: int = 50
    max_tokens: int = 512
    sample_share: float = 0.01
    sample_total: int | None = None
    quality_filter: bool = True
    user_role: str = "user"
    assistant_role: str = "assistant"
    content_field: str = "content"
    dpo_extract: str = "both"
    dpo_chosen: str = "chosen"
    dpo_rejected: str = "rejected"
    rl_prompt: str = "prompt"
    rl_solution: str = "solution"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.dpo_extract not in EXTRACT:
            raise ValueError(f"dpo_extract must be one of {EXTRACT}")
        if not 0 <= self.min_tokens <= self.max_tokens:
            raise ValueError("token bounds must rise from 0")
        if not 0 < self.sample_share <= 1 or (self.sample_total is not None and self.sample_total <= 0):
            raise ValueError("the sample must be a share within (0, 1] or a positive number")

    @classmethod
    def of(cls, data: dict, section: str = "chunking") -> Preparation:
        """From a section of nested settings; unknown names are an error."""
        given = nested(data, section, {})
        if unknown := given.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)

    @classmethod
    def read(cls, path: str, section: str = "chunking") -> Preparation:
        """From a JSON file, or a YAML file where a YAML library is installed."""
        with open(path, encoding="utf-8") as file:
            if path.endswith(".json"):
                return cls.of(json.load(file), section)
            import yaml

            return cls.of(yaml.safe_load(file) or {}, section)
