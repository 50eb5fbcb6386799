"""Settings of linkage, parsing and surveys, as typed values with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class LinkConfig:
    """Thresholds of the staged linkage. The defaults suit catalogues of thousands of authors and books."""

    # Thresholds, scales and weights that results depend on.

    author_threshold: float = 0.80
    author_idf: bool = True
    author_idf_scale: float = 15.0
    author_boost: float = 0.3
    rare_idf: float = 3.5
    creator_fields: bool = True
    creator_idf: float = 4.5
    creator_weights: tuple[float, float] = (0.6, 0.4)
    title_threshold: float = 0.85
    title_idf: bool = True
    title_idf_scale: float = 20.0
    title_boost: float = 0.4
    combined_floor: float = 0.80
    title_floor: float = 0.90
    combined_weights: tuple[float, float] = (0.3, 0.7)
    combined_threshold: float = 0.94
    conversion_table: bool = True
    cull_author_tokens: bool = True


@dataclass(frozen=True)
class FieldBoilerplate:
    """When an n-gram of a field counts as boilerplate. strategy: ``full`` or ``freq_only``."""

    strategy: str = "full"
    min_doc_freq_pct: float = 5.0
    max_repeats_per_doc: float = 1.1


def field_defaults() -> dict[str, FieldBoilerplate]:
    # When an n-gram of these fields counts as boilerplate.
    return {
        "description": FieldBoilerplate("full", 2.0, 1.1),
        "creator": FieldBoilerplate("freq_only", 10.0),
        "subject": FieldBoilerplate("freq_only", 15.0),
    }


@dataclass(frozen=True)
class SurveyConfig:
    """Fields that ``fields`` doesn't name aren't looked through for boilerplate."""

    max_n: int = 4
    keep_abbrev_dots: bool = True
    fields: dict[str, FieldBoilerplate] = field(default_factory=field_defaults)
    composite_min_creators: int = 2
    max_desc_len: int = 250
    min_desc_tokens: int = 1


def from_mapping(cls: type, values: dict[str, Any]) -> Any:
    """A settings object from a flat mapping (as read from YAML); names it doesn't know are refused."""
    known = {f.name for f in fields(cls)}
    if extra := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return cls(**values)


def survey_settings(values: dict[str, Any]) -> SurveyConfig:
    """Settings of surveys and parsing from a file's sections ``survey``, ``boilerplate`` and ``parsing``.

    ``boilerplate.fields`` names the fields, each with what departs from its defaults. Older files have the two limits
    right below ``boilerplate``: these are the description's, and other fields keep their defaults. Keys of a section
    that surveys have no use for are left alone."""
    survey, parsing, boilerplate = (values.get(k) or {} for k in ("survey", "parsing", "boilerplate"))
    defaults = field_defaults()
    named = boilerplate.get("fields") or {}
    own = named or {"description": {"mode": "full", **{k: boilerplate[k] for k in ("min_doc_freq_pct", "max_repeats_per_doc") if k in boilerplate}}}
    made = {name: _boilerplate(given if isinstance(given, dict) else {}, defaults.get(name, FieldBoilerplate())) for name, given in own.items()}
    known = {f.name for f in fields(SurveyConfig)} - {"fields"}
    return SurveyConfig(**{k: v for part in (survey, parsing) for k, v in part.items() if k in known}, fields=made if named else {**defaults, **made})


def _boilerplate(given: dict[str, Any], default: FieldBoilerplate) -> FieldBoilerplate:
    strategy = str(given.get("mode", given.get("strategy", default.strategy)))
    if strategy not in ("full", "freq_only"):
        raise ValueError(f"unknown way to find boilerplate: {strategy}")
    return FieldBoilerplate(strategy, float(given.get("min_doc_freq_pct", default.min_doc_freq_pct)), float(given.get("max_repeats_per_doc", default.max_repeats_per_doc)))


def snapshot(settings: Any) -> dict[str, str]:
    """All values of a settings object as texts, for an audit trail."""
    return {f.name: str(getattr(settings, f.name)) for f in fields(settings)}


def read_yaml(path: str) -> dict[str, Any]:
    import yaml  # optional dependency

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_yaml(cls: type, path: str, section: str | None = None) -> Any:
    """A settings object from a YAML file or one of its sections."""
    values = read_yaml(path)
    return from_mapping(cls, values.get(section, {}) if section else values)
