"""Settings from a file of `key = value` lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.prefix import parse_text
from ..operators.leak import relationship_rows

MAX_WATCH, MAX_RELATIONS = 256, 4096


@dataclass
class Config:
    api_port: int = 8080
    mrt_file: str = ""
    replay_speed: float = 0.0
    live_enabled: bool = False
    live_host: str = ""
    live_prefix: str = ""
    vrp_file: str = ""
    alert_table: str = ""
    webhook_url: str = ""
    baseline_window: float = 300.0
    spike_window: float = 60.0
    spike_factor: float = 10.0
    spike_min: int = 20
    watch: list[tuple[str, int]] = field(default_factory=list)
    providers: list[tuple[int, int]] = field(default_factory=list)
    peers: list[tuple[int, int]] = field(default_factory=list)

    def relationships(self) -> list[tuple[int, int, str]]:
        return relationship_rows(self.providers, self.peers)


class ConfigError(ValueError):
    pass


def _number(kind):
    def read(text: str):
        try:
            return kind(text)
        except ValueError:
            return kind(0)

    return read


def _bool(text: str) -> bool:
    return text in ("true", "1", "yes")


def _pair(text: str) -> tuple[int, int]:
    a, b, *_ = [*text.split(), "", ""]
    if not (a.isdigit() and b.isdigit()):
        raise ConfigError(f"not two numbers: {text!r}")
    return int(a), int(b)


def _watch(text: str) -> tuple[str, int]:
    prefix, asn, *_ = [*text.split(), "", ""]
    if parse_text(prefix) is None:
        raise ConfigError(f"no prefix: {text!r}")
    return prefix, int(asn) if asn.isdigit() else 0


#: Keys of the file (fixed values) -> (field, reader).
KEYS = {
    "api_port": ("api_port", _number(int)), "mrt_file": ("mrt_file", str), "replay_speed": ("replay_speed", _number(float)), "rislive_enabled": ("live_enabled", _bool), "rislive_host": ("live_host", str),
    "rislive_prefix": ("live_prefix", str), "vrp_file": ("vrp_file", str), "alert_db": ("alert_table", str), "webhook_url": ("webhook_url", str), "baseline_window": ("baseline_window", _number(float)),
    "spike_window": ("spike_window", _number(float)), "spike_factor": ("spike_factor", _number(float)), "spike_min": ("spike_min", _number(int)),
}
#: Keys that may repeat -> (field, reader, how many at most).
LISTS = {"watch": ("watch", _watch, MAX_WATCH), "rel_provider": ("providers", _pair, MAX_RELATIONS), "rel_peer": ("peers", _pair, MAX_RELATIONS)}


def parse(text: str) -> Config:
    """Settings of a file's text; `#` begins a comment anywhere. Unknown keys and bad values raise ConfigError."""
    config = Config()
    for number, line in enumerate(text.splitlines(), 1):
        line = line.partition("#")[0].strip()
        if not line:
            continue
        key, equals, value = (s.strip() for s in line.partition("="))
        if not equals:
            raise ConfigError(f"line {number}: key = value is expected")
        if key in KEYS:
            name, read = KEYS[key]
            setattr(config, name, read(value))
        elif key in LISTS:
            name, read, most = LISTS[key]
            found = getattr(config, name)
            if len(found) == most:
                raise ConfigError(f"line {number}: too many of {key}")
            found.append(read(value))
        else:
            raise ConfigError(f"line {number}: unknown key {key}")
    return config


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
