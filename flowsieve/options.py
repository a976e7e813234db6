"""Job options: environment first, then a JSON file; unknown keys are ignored."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from typing import Any, Mapping

MICROS = 1_000_000


def _ints(text: str) -> list[int]:
    return [int(part) for part in text.split(",") if part.strip()]


def _words(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def _flag(text: str) -> bool:
    return text.strip().lower() in {"1", "true", "yes", "on"}


# how the text of an environment variable becomes a setting
_READERS = {
    "interfaces": _words, "include_icmp": _flag, "port_allowlist": _ints, "drop_link_local": _flag,
    "flow_idle_timeout": float, "flow_active_timeout": float, "block_honeypot_enabled": _flag,
    "honeypot_ports": _ints, "whitelist": _words, "alert_confidence": float,
    "block_confidence": float, "prevent_mode": _flag, "block_timeout": float, "blocks_path": str,
    "notify_channel": str, "notify_cooldown": float, "syn_flood_minimum": int,
    "hot_key_rows": int, "tick_seconds": float,
}


@dataclass(frozen=True)
class Options:
    # packet selection
    interfaces: list[str] = field(default_factory=lambda: ["lo", "wlan0"])
    include_icmp: bool = False
    port_allowlist: list[int] | None = None
    drop_link_local: bool = True
    # flow timeouts in seconds
    flow_idle_timeout: float = 60.0
    flow_active_timeout: float = 300.0
    # decoy ports
    block_honeypot_enabled: bool = True
    honeypot_ports: list[int] = field(default_factory=lambda: [2323])
    honeypot_require_ack: bool = False
    # policy
    whitelist: list[str] = field(default_factory=lambda: ["127.0.0.1"])
    alert_confidence: float = 0.50
    block_confidence: float = 0.90
    syn_flood_minimum: int = 100
    # enforcement
    prevent_mode: bool = False
    block_timeout: float = 3600.0  # 0 or less: permanent
    blocks_path: str | None = None
    # notifications
    notify_channel: str | None = None
    notify_cooldown: float = 10.0
    # skew control: a flow key (or notification channel) with more rows than this is
    # split over time ticks instead of being ordered in one task
    hot_key_rows: int = 200_000
    tick_seconds: float = 1.0

    @property
    def idle_us(self) -> int:
        return round(self.flow_idle_timeout * MICROS)

    @property
    def active_us(self) -> int:
        return round(self.flow_active_timeout * MICROS)

    @property
    def block_us(self) -> int:
        return round(self.block_timeout * MICROS)

    @property
    def cooldown_us(self) -> int:
        return max(0, round(self.notify_cooldown * MICROS))

    @property
    def tick_us(self) -> int:
        return max(1, round(self.tick_seconds * MICROS))

    def updated(self, values: Mapping[str, Any]) -> "Options":
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in known})

    @classmethod
    def load(cls, json_path: str | None = None, env_prefix: str = "FLOWSIEVE_",
             env: Mapping[str, str] | None = None) -> "Options":
        env = os.environ if env is None else env
        opts = cls()
        found = {name: read(env[env_prefix + name.upper()])
                 for name, read in _READERS.items() if env.get(env_prefix + name.upper())}
        opts = opts.updated(found)
        if json_path and os.path.exists(json_path):
            with open(json_path, encoding="utf-8") as handle:
                opts = opts.updated(json.load(handle))
        return opts
