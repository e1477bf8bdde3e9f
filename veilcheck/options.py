"""User-tunable parameters of a scan; every field ends up as a literal in the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import fixed_values as fv


@dataclass(frozen=True)
class ScanOptions:
    """Extra skip lists, extra placeholder words and severity thresholds.

    The defaults reproduce the built-in behaviour exactly.
    """

    extra_ignore: tuple[str, ...] = ()
    extra_skip_extensions: tuple[str, ...] = ()
    extra_skip_dirs: tuple[str, ...] = ()
    threshold_critical: int = field(default=fv.SEVERITY_THRESHOLDS["CRITICAL"])
    threshold_high: int = field(default=fv.SEVERITY_THRESHOLDS["HIGH"])
    threshold_medium: int = field(default=fv.SEVERITY_THRESHOLDS["MEDIUM"])

    @property
    def skip_extensions(self) -> list[str]:
        return [*fv.SKIP_EXTENSIONS, *(e.lower() for e in self.extra_skip_extensions)]

    @property
    def skip_dirs(self) -> list[str]:
        return [*fv.SKIP_DIRS, *self.extra_skip_dirs]

    @property
    def placeholders(self) -> list[str]:
        return [*fv.PLACEHOLDER_PATTERNS, *self.extra_ignore]


DEFAULT_OPTIONS = ScanOptions()
