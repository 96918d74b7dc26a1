"""Engine options: typed, with the precedence file named by the environment, arguments, ``-c`` file, arguments again (SRC-15, SNK-11)."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

ENV = "QUILLON_CONFIG"


@dataclass(frozen=True)
class Options:
    lm_scale: float = 27.5
    transition_penalty: float = 0.0
    silence_penalty: float = 0.0
    beam: float = 200.0
    state_beam: float = 75.0
    end_state_beam: float = 50.0
    histogram_limit: int = 35_000
    state_limit: int = 160
    nbest_depth: int = 9
    max_clusters: int = 40
    min_variance: float = 0.01
    map_relevance: float = 10.0
    prune_nats: float = 7.0
    silence_run: int = 20
    compat: bool = False


def _typed(name: str, value) -> object:
    kind = {f.name: type(f.default) for f in fields(Options)}.get(name)
    if kind is None:
        raise KeyError(f"unknown option {name}")
    if kind is bool:
        if str(value).lower() not in ("true", "false", "1", "0", "on", "off"):
            raise ValueError(f"{name} is a flag, not {value!r}")
        return str(value).lower() in ("true", "1", "on")
    return kind(value)


def read_file(path: str) -> dict:
    """``name value`` lines or JSON; ``#`` starts a comment."""
    text = open(path, encoding="utf-8").read()
    if text.lstrip().startswith("{"):
        return json.loads(text)
    lines = (x.split("#")[0].split(None, 1) for x in text.splitlines())
    return {x[0]: x[1].strip() if len(x) > 1 else "true" for x in lines if x}


def parse_args(args: list[str]) -> tuple[dict, str | None]:
    found, file, i = {}, None, 0
    while i < len(args):
        name = args[i].lstrip("-").replace("-", "_")
        if args[i] == "-c":
            file = args[i + 1]
            i += 2
        elif i + 1 < len(args) and not args[i + 1].startswith("--"):
            found[name] = args[i + 1]
            i += 2
        else:
            found[name] = "true"
            i += 1
    return found, file


def load(args: list[str] = ()) -> Options:
    """Options by precedence; what comes later wins."""
    given, file = parse_args(list(args))
    merged: dict = {}
    if os.environ.get(ENV):
        merged |= read_file(os.environ[ENV])
    if file:
        merged |= read_file(file)
    merged |= given
    return replace(Options(), **{k: _typed(k, v) for k, v in merged.items()})


def template() -> str:
    """All options and their defaults as JSON."""
    return json.dumps(asdict(Options()), indent=2)
