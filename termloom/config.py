"""Engine configuration and language profiles; both are passed explicitly."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class LanguageProfile:
    """What differs between scripts: token pattern, sentence marks, joiner of compounds, stop words."""

    name: str
    token: str
    sentence_marks: str
    joiner: str
    stop_words: tuple[str, ...] = ()


#: Words with letters and digits, hyphens inside.
LATIN = LanguageProfile("latin", r"\p{L}[\p{L}\p{N}\-]*[\p{L}\p{N}]", ".!?\n", " ", ("the", "and", "for", "que", "der", "die", "und", "les", "des", "los"))
#: Runs of katakana, of kanji, or of letters and digits.
JAPANESE = LanguageProfile("japanese", r"[ァ-ヴー]+|[一-龥]+|[A-Za-z][A-Za-z0-9\-]*[A-Za-z0-9]", "。！？\n", "")


@dataclass(frozen=True)
class EngineConfig:
    """Settings of the engine. Which provider answers and its credentials are the provider's own and come from the
    environment; nothing secret is a setting."""

    embedding_dim: int = 64
    batch_size: int = 100
    min_frequency: int = 2
    similarity_threshold: float = 0.7
    chunk_size: int = 4000
    overlap: int = 400
    profile: LanguageProfile = LATIN


PROFILES = {p.name: p for p in (LATIN, JAPANESE)}
#: Where a file has the settings: section and key.
KEYS = {"embedding_dim": ("embedding", "dim"), "batch_size": ("embedding", "batch_size"), "min_frequency": ("filters", "min_freq"), "similarity_threshold": ("evaluation", "threshold"), "chunk_size": ("chunks", "size"), "overlap": ("chunks", "overlap"), "profile": ("language", "profile")}


def parse_yaml(text: str) -> dict:
    """The part of YAML that settings need: keys with values, sections one level deep, comments."""
    out: dict = {}
    section = out
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"no key: {line}")
        value = value.strip().strip("\"'")
        if not line[0].isspace():
            section = out
            if not value:
                section = out.setdefault(key, {})
                continue
        section[key] = int(value) if re.fullmatch(r"-?\d+", value) else float(value) if re.fullmatch(r"-?\d*\.\d+", value) else {"true": True, "false": False}.get(value.lower(), value)
    return out


def load(path: str) -> EngineConfig:
    """Settings from a YAML file; what it leaves out keeps its default."""
    with open(path, encoding="utf-8") as f:
        held = parse_yaml(f.read())
    given = {name: held[section][key] for name, (section, key) in KEYS.items() if isinstance(held.get(section), dict) and key in held[section]}
    if "profile" in given:
        given["profile"] = PROFILES[given["profile"]]
    return EngineConfig(**given)


#: What a new project's file holds.
TEMPLATE = "embedding:\n  dim: 64\n  batch_size: 100\nfilters:\n  min_freq: 2\nevaluation:\n  threshold: 0.7\nchunks:\n  size: 4000\n  overlap: 400\nlanguage:\n  profile: latin\n"
