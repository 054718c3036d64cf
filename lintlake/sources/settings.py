"""Settings from YAML, which fail closed on anything unknown."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.operators.findings import Exclusion

# Keys of a settings file, and the levels of a failing run.
_ROOT = frozenset(("schemaVersion", "minimumSeverity", "paths", "allowlists", "custom_rules", "rules", "exclude"))
_CUSTOM = frozenset(("id", "pillar", "severity", "confidence", "message", "scope", "pattern", "include_paths", "exclude_paths", "remediation"))
_LEVELS = ("none", "advisory", "warning", "error")
_PILLARS = frozenset("size complexity dead-code waste maintainability naming documentation modernisation security sensitive-data test-quality design".split())
_SCOPES = ("text", "rust-code", "comments")
_OPTIONS = {"naming.generic-function": "extraGenericNames", "naming.boolean-prefix": "predicatePrefixes", "naming.placeholder-identifier": "extraPlaceholders"}


@dataclass(frozen=True)
class Settings:
    """What a scan follows. `select` and `ignore` hold rule ids, pillars or dotted prefixes."""

    ignored_paths: tuple[str, ...] = ()
    select: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    unscored: tuple[str, ...] = ()
    thresholds: dict[str, tuple[float, str]] = field(default_factory=dict)
    exclusions: tuple[Exclusion, ...] = ()
    custom_rules: tuple[dict, ...] = ()
    minimum_severity: dict[str, str] = field(default_factory=dict)
    options: dict[str, tuple[str, ...]] = field(default_factory=dict)
    abbreviations: tuple[str, ...] | None = None

    def enabled(self) -> Column:
        """Whether a finding's rule is on: ignored and disabled rules are off, then only selected ones are on.

        `select` and `ignore` must hold rule ids here; the catalogue puts them in place of other selectors.
        """
        on = ~_listed((*self.ignore, *self.disabled))
        return on & _listed(self.select) if self.select else on


def _listed(ids: Sequence[str]) -> Column:
    return F.col("rule_id").isin(*ids) if ids else F.lit(False)


def _strings(value: object, where: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{where} must be a list of strings")
    return tuple(value)


def _known(table: dict, names: frozenset[str], where: str) -> None:
    if unknown := sorted(set(table) - names):
        raise ValueError(f"unknown key in {where}: {', '.join(unknown)}")


def confidence_name(value: float | None) -> str:
    """Numeric confidence as a name."""
    return "medium" if value is None or 0.5 <= value < 0.85 else "high" if value >= 0.85 else "low"


def _custom(own: dict) -> None:
    """A custom rule needs an id such as custom.two-words, a known pillar and severity, a message, and a pattern that compiles and matches no empty text."""
    where = f"custom_rules.{own.get('id')}"
    if not re.fullmatch(r"custom\.(?!-)[a-z0-9-]+(?<!-)", str(own.get("id") or "")):
        raise ValueError(f"{where}: the id must be custom. and lower-case words joined by hyphens")
    for key, values in (("pillar", _PILLARS), ("severity", _LEVELS[1:]), ("scope", _SCOPES)):
        if own.get(key, "text" if key == "scope" else None) not in values:
            raise ValueError(f"{where}.{key} must be one of {', '.join(sorted(values))}")
    if not own.get("message") or not own.get("pattern"):
        raise ValueError(f"{where} needs a message and a pattern")
    try:
        empty = re.search(own["pattern"], "")
    except re.error as error:
        raise ValueError(f"{where}.pattern: {error}") from error
    if empty:
        raise ValueError(f"{where}.pattern must not match an empty text")


def parse_settings(text: str) -> Settings:
    """Settings of a YAML text. Unknown keys, a missing schemaVersion and bad values are errors."""
    import yaml

    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise ValueError("settings must be a mapping")
    _known(data, _ROOT, "settings")
    version = data.get("schemaVersion")
    if not isinstance(version, str) or not re.fullmatch(r"v1|[\w-]+\.config\.v1", version):
        raise ValueError("schemaVersion is required and must be v1 or end in .config.v1")
    allowed = data.get("allowlists") or {}
    _known(allowed, frozenset(("acceptedAbbreviations",)), "allowlists")
    abbreviations = None if "acceptedAbbreviations" not in allowed else tuple(x.lower() for x in _strings(allowed["acceptedAbbreviations"], "allowlists.acceptedAbbreviations"))
    levels = data.get("minimumSeverity") or {}
    for name, level in levels.items():
        if level not in _LEVELS:
            raise ValueError(f"minimumSeverity.{name} must be one of {', '.join(_LEVELS)}")
    rules = dict(data.get("rules") or {})
    select, ignore, custom = (rules.pop(k, None) or [] for k in ("select", "ignore", "custom"))
    options: dict[str, tuple[str, ...]] = {}
    for name, own in rules.items():
        _known(own, frozenset(("enabled", "threshold", "severity", "options", "excludeFromScore")), f"rules.{name}")
        if ("threshold" in own) != ("severity" in own):
            raise ValueError(f"rules.{name}: threshold and severity go together")
        for key in ("enabled", "excludeFromScore"):
            if not isinstance(own.get(key, True), bool):
                raise ValueError(f"rules.{name}.{key} must be a boolean")
        for option, value in (own.get("options") or {}).items():
            if _OPTIONS.get(name) != option:
                raise ValueError(f"unknown option {option} of rules.{name}")
            options[name] = _strings(value, f"rules.{name}.options.{option}")
        if "threshold" in own and (own["severity"] not in _LEVELS[1:] or isinstance(own["threshold"], bool) or not isinstance(own["threshold"], int | float)):
            raise ValueError(f"rules.{name}: threshold must be a number and severity one of {', '.join(_LEVELS[1:])}")
    for own in data.get("custom_rules") or []:
        _known(own, _CUSTOM, "custom_rules")
        _custom(own)
    names = [own["id"] for own in data.get("custom_rules") or []]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"custom_rules: {', '.join(twice)} stands twice")
    exclusions = []
    for own in data.get("exclude") or []:
        _known(own, frozenset(("rule", "paths", "message_contains", "reason")), "exclude")
        names = own.get("rule") or []
        exclusions.append(Exclusion(tuple([names] if isinstance(names, str) else names), tuple(own.get("paths") or ()), own.get("message_contains"), own.get("reason", "")))
    off = [n for n, own in rules.items() if own.get("enabled") is False] + [f"custom.{n.removeprefix('custom.')}" for n, own in dict(custom or {}).items() if own.get("enabled") is False]
    return Settings(
        tuple((data.get("paths") or {}).get("ignore") or ()), tuple(select), tuple(ignore), tuple(off), tuple(n for n, own in rules.items() if own.get("excludeFromScore")),
        {n: (float(own["threshold"]), own["severity"]) for n, own in rules.items() if "threshold" in own}, tuple(exclusions), tuple(data.get("custom_rules") or ()), dict(levels), options, abbreviations,
    )
