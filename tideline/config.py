"""Scrape configuration: targets of static discovery, and durations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

try:
    import yaml
except ImportError:  # configurations can be given as loaded data
    yaml = None


@dataclass(frozen=True)
class Target:
    job: str
    url: str
    instance: str
    interval: int
    honor_labels: bool = False
    labels: tuple[tuple[str, str], ...] = ()


def duration_ms(text: str | int | float) -> int:
    """Milliseconds of 5ms, 1.5s, 2m or 1h (also d); a bare number is milliseconds."""
    m = re.fullmatch(r"([0-9.]+)\s*(ms|s|m|h|d)?", str(text).strip())
    if not m:
        raise ValueError(f"bad duration {text!r}")
    return round(float(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, None: 1}[m[2]])


def targets(config: dict | str) -> list[Target]:
    """Targets of global.scrape_interval and scrape_configs[]. Defaults: 15 s, http, port 80, /metrics."""
    if isinstance(config, str):
        if yaml is None:
            raise ImportError("reading YAML needs the yaml package; give the loaded data instead")
        config = yaml.safe_load(config)
    usual = duration_ms((config.get("global") or {}).get("scrape_interval", "15s"))
    out = []
    for job in config.get("scrape_configs", []):
        query = "&".join(f"{k}={x}" for k, v in (job.get("params") or {}).items() for x in (v if isinstance(v, list) else [v]))
        path = job.get("metrics_path", "/metrics") + (f"?{query}" if query else "")
        for group in job.get("static_configs", []):
            for t in group.get("targets", []):
                host = t if ":" in t else f"{t}:80"
                out.append(Target(job["job_name"], f"{job.get('scheme', 'http')}://{host}{path}", host, duration_ms(job["scrape_interval"]) if "scrape_interval" in job else usual, bool(job.get("honor_labels", False)), tuple(sorted((group.get("labels") or {}).items()))))
    return out


@dataclass
class Discovery:
    """Known targets by job; a new configuration of a job takes the old one's place as a whole."""

    by_job: dict[str, list[Target]] = field(default_factory=dict)

    def apply(self, config: dict | str) -> None:
        fresh: dict[str, list[Target]] = {}
        for t in targets(config):
            fresh.setdefault(t.job, []).append(t)
        self.by_job = fresh

    def due(self, now: int, last: dict[str, int]) -> list[Target]:
        """Targets whose interval has passed since their last scrape (by URL)."""
        return [t for ts in self.by_job.values() for t in ts if now - last.get(t.url, -(1 << 62)) >= t.interval]
