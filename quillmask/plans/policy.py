"""Routing, guards, configuration and the scope of a request, as columns and driver-side settings."""

from __future__ import annotations

import datetime
import ipaddress
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions import fixed

#: domains that are sent to all tasks at most (their names have 255 bytes at most)
SMALL = 100_000
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


@dataclass(frozen=True)
class Provider:
    domains: tuple[str, ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class Config:
    """Settings; None means unset, so that an override keeps what stands."""

    mode: str = "monitor"
    fail_mode: str | None = None
    listen_addr: str = "127.0.0.1"
    listen_port: int = 8787
    max_text_bytes: int = fixed.LARGEST_TEXT
    ttl: str | None = None
    scan_paths: tuple[str, ...] = fixed.SCAN_PATHS
    ca_name: str | None = None
    ca_validity_years: int = 10
    ca_key_algorithm: str = "ECDSA_P256"
    cert_cache_enabled: bool | None = None
    upstream_validation: str = "system"
    flow_inspector: bool | None = None
    log_level: str | None = None
    log_format: str | None = None
    log_output: str | None = None
    log_dir: str | None = None
    pii_logging: bool | None = None
    providers: dict[str, Provider] = field(default_factory=dict)

    def merged(self, **over) -> Config:
        """These settings with others on top; providers are added or replaced one by one."""
        over = {k: v for k, v in over.items() if v is not None}
        if "providers" in over:
            over["providers"] = {**self.providers, **over["providers"]}
        return replace(self, **over)

    def validate(self) -> list[str]:
        """What is wrong, in words; nothing if it is valid."""
        wrong = [] if self.mode in ("transparent", "monitor", "enforce") else [f"unknown mode {self.mode}"]
        if self.mode == "enforce" and self.fail_mode == "fail_open":
            wrong.append("enforce mode can't fail open")
        try:
            if not ipaddress.ip_address(self.listen_addr).is_loopback:
                wrong.append(f"{self.listen_addr} is no loopback address")
        except ValueError:
            wrong.append(f"bad address {self.listen_addr!r}")
        if not 0 < self.listen_port <= 65535:
            wrong.append(f"bad port {self.listen_port}")
        if (self.ttl or "") not in fixed.TTLS:
            wrong.append(f"unknown ttl {self.ttl}")
        if self.max_text_bytes < 0:
            wrong.append("negative size")
        if not all(self.scan_paths):
            wrong.append("empty scan path")
        if (self.log_output or "") not in ("", "stderr", "file", "both"):
            wrong.append(f"unknown output {self.log_output}")
        if self.upstream_validation not in ("system", "insecure"):
            wrong.append(f"unknown upstream validation {self.upstream_validation}")
        if self.ca_validity_years <= 0 or self.ca_key_algorithm != "ECDSA_P256":
            wrong.append("bad certificate settings")
        seen: dict[str, str] = {}
        for name, provider in sorted(self.providers.items()):
            if not name.strip():
                wrong.append("empty provider name")
            if not provider.enabled:
                continue
            if not provider.domains:
                wrong.append(f"provider {name} has no domains")
            for domain in map(str.strip, provider.domains):
                if not domain or any(c in domain for c in "/\\ :*"):
                    wrong.append(f"bad domain {domain!r}")
                elif domain.lower() in seen:
                    wrong.append(f"domain {domain} twice")
                seen[domain.lower()] = name
        return wrong

    def domains(self) -> list[str]:
        return sorted({d.lower() for p in self.providers.values() if p.enabled for d in p.domains})

    def fails(self) -> str:
        """What happens when a scan fails: closed when enforcing, else open, unless set."""
        return self.fail_mode or ("fail_closed" if self.mode == "enforce" else "fail_open")

    def ttl_hours(self) -> int:
        return fixed.TTLS[self.ttl or ""]

    def sweep_every(self) -> datetime.timedelta:
        """A seventh of the time to live, between an hour and a day."""
        hours = min(max(self.ttl_hours() / 7, 1), 24)
        return datetime.timedelta(hours=hours)


#: where a configuration file holds each setting
SETTINGS = {
    "mode": "agent.mode", "fail_mode": "agent.fail_mode", "listen_addr": "agent.listen_addr", "listen_port": "agent.listen_port", "ttl": "agent.vault.ttl", "scan_paths": "agent.monitor.scan_paths",
    "ca_name": "tls.ca_name", "ca_validity_years": "tls.ca_validity_years", "ca_key_algorithm": "tls.ca_key_algorithm", "cert_cache_enabled": "tls.cert_cache_enabled", "upstream_validation": "tls.upstream_validation",
    "flow_inspector": "debug.flow_inspector", "log_level": "logging.level", "log_format": "logging.format", "log_output": "logging.output", "log_dir": "logging.log_dir", "pii_logging": "logging.pii_logging",
}
REQUIRED = ("mode", "listen_addr", "listen_port", "ca_validity_years", "ca_key_algorithm", "upstream_validation")


def _settings(text: str) -> dict:
    """The settings that a YAML text gives; empty strings and lists, and the number 0, count as not given."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("configuration files need PyYAML") from e
    root, out = yaml.safe_load(text) or {}, {}
    for name, path in SETTINGS.items():
        value = root
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is not None and (isinstance(value, bool) or value not in ("", [], 0)):
            out[name] = tuple(value) if name == "scan_paths" else str(value) if name == "ttl" else value
    if providers := root.get("providers"):
        out["providers"] = {str(n): Provider(tuple((p or {}).get("domains") or ()), bool((p or {}).get("enabled", False))) for n, p in providers.items()}
    return out


def parse_config(text: str) -> Config:
    """A valid configuration from YAML; ValueError with all that is wrong."""
    given = _settings(text)
    return _checked(Config(**given), [f"{SETTINGS[n]} is required" for n in REQUIRED if n not in given])


def load_config(path: str, *overrides: str) -> Config:
    """A configuration file with override files on top of it, checked after each."""
    with open(path, encoding="utf-8") as f:
        config = parse_config(f.read())
    for other in overrides:
        with open(other, encoding="utf-8") as f:
            config = _checked(config.merged(**_settings(f.read())), [])
    return config


def _checked(config: Config, wrong: list[str]) -> Config:
    if wrong := wrong + config.validate():
        raise ValueError("; ".join(wrong))
    return config


def pac_script(domains: list[str], proxy: str) -> str:
    """A proxy auto-configuration that sends these domains and what is below them through a proxy."""
    tests = " || ".join(f'host === "{d}" || host.endsWith(".{d}")' for d in domains) or "false"
    return f'function FindProxyForURL(url, host) {{\n  host = host.toLowerCase();\n  if ({tests}) return "PROXY {proxy}";\n  return "DIRECT";\n}}\n'


def clean_host(host: Column) -> Column:
    """Lower case without port; empty if it holds anything but printable ASCII."""
    inner = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(host, ":[0-9]*$", ""))
    return F.when(host.isNull() | host.rlike("[^!-~]"), "").otherwise(F.lower(inner))


def route(hosts: DataFrame, providers: DataFrame, host_col: str = "host", fallback: str = "unknown") -> DataFrame:
    """hosts with provider and action: the provider of the longest of its (domain, provider) that is the host or a parent of it.

    A host is expanded into its own suffixes, so this is an equality join; the provider table is sent to all tasks
    only while it is small (counted).
    """
    labels = F.split(clean_host(F.col(host_col)), "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size("_l")), lambda k: F.array_join(F.slice("_l", k, F.size("_l")), "."))
    names = hosts.select(F.col(host_col).alias("_h"), labels.alias("_l")).distinct()
    table = providers.select(F.lower("domain").alias("_d"), "provider")
    table = F.broadcast(table) if table.count() <= SMALL else table
    best = names.select("_h", F.explode(parents).alias("_d")).join(table, "_d").groupBy("_h").agg(F.max_by("provider", F.struct(F.length("_d"), "provider")).alias("provider"))
    out = hosts.join(best, F.col(host_col).eqNullSafe(F.col("_h")), "left").drop("_h")
    return out.withColumn("action", F.when(F.col("provider").isNull(), "TUNNEL").otherwise("MITM")).withColumn("provider", F.coalesce("provider", F.lit(fallback)))


def scan_path(path: Column, paths: tuple[str, ...] = fixed.SCAN_PATHS) -> Column:
    """Whether any of the paths occurs, in either case."""
    return F.exists(F.array(*(F.lit(p.lower()) for p in paths)), lambda p: F.contains(F.lower(path), p))


def provider_path(path: Column, paths: tuple[str, ...] = fixed.PROVIDER_PATHS) -> Column:
    """Whether the path is one of these or below one."""
    low, out = F.lower(path), F.lit(False)
    for p in paths:
        out = out | (low == p) | low.startswith(p + "/")
    return out


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def content_action(content_type: Column) -> Column:
    kind = media_type(content_type)
    return F.when(kind.isNull() | (kind == ""), "skip").when(kind == "text/event-stream", "sse").when((kind == "application/json") | kind.startswith("text/"), "analyze").otherwise("skip")


def log_path(path: Column) -> Column:
    """At most LOG_PATH bytes, cut between characters."""
    bytes_ = F.substring(path.cast("binary"), 1, fixed.LOG_PATH + 3)
    whole = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(None).cast("string"), lambda a, k: F.coalesce(a, F.try_validate_utf8(F.substring(bytes_, F.lit(1), fixed.LOG_PATH - k).cast("string"))))
    return F.when(F.octet_length(path) <= fixed.LOG_PATH, path).otherwise(whole)


def event_type(name: Column) -> Column:
    """The printable ASCII of the first EVENT_TYPE bytes."""
    return F.regexp_replace(F.substring(name.cast("binary"), 1, fixed.EVENT_TYPE).cast("string"), "[^ -~]", "")


def conversation_scope(path: Column, fallback: Column) -> Column:
    """SHA-256 of the first UUID component of a path, lower case; else of the fallback, so that a replay gives the same."""
    found = F.regexp_extract(F.left(path, F.lit(2048)), f"(?:^|/)({UUID})(?:$|[/?#])", 1)
    bad = path.isNull() | path.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]") | (found == "")
    return F.sha2(F.when(bad, fallback).otherwise(F.lower(found)), 256)


def is_ai_domain(hosts: DataFrame, domains: DataFrame, host_col: str = "host", keep: bool = True) -> DataFrame:
    """hosts that are, or (keep=False) are not, one of the domains (column domain) or below one: a semi- or an anti-join."""
    parents = lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    names = hosts.select(F.col(host_col).alias("_h"), F.split(clean_host(F.col(host_col)), "\\.").alias("_l")).distinct().select("_h", F.explode(parents(F.col("_l"))).alias("_d"))
    table = domains.select(F.lower("domain").alias("_d")).distinct()
    found = names.join(F.broadcast(table) if table.count() <= SMALL else table, "_d").select("_h").distinct()
    return hosts.join(found, F.col(host_col).eqNullSafe(F.col("_h")), "left_semi" if keep else "left_anti")


def expired(created: Column, now: Column, ttl_hours: int) -> Column:
    """Older than the time to live; nothing expires at 0."""
    return F.lit(ttl_hours > 0) & (created + F.expr(f"INTERVAL {max(ttl_hours, 0)} HOURS") < now)
