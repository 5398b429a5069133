"""Configuration and the tables of a history."""

from __future__ import annotations

import difflib
import json
import sys
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame

from histolith.functions import vocabulary as V

# Least joint revisions and least Jaccard score of a coupled pair; when and how document-frequency caps are
# derived; bounds of the scan for workarounds.
MIN_SHARED, MIN_SCORE = 5, 0.30
AUTO_FROM, AUTO_DIVISOR, AUTO_LEAST = 50, 50, 3
SCAN_COMMITS, SCAN_LINES = 20, 4000


@dataclass(frozen=True)
class Config:
    """All knobs; a frozen value, so a run can't leak its settings into the next."""

    min_dir_depth: int = 2
    cluster_cap: int = 8
    split_oversized: bool = False
    module_prefix: str = ""
    file_df_max: int | None = None
    token_df_max: int | None = None
    dir_df_max: int | None = None
    auto_specificity: bool = True
    coupling_max_changeset: int = 30
    score_arch_threshold: int = 3
    score_borderline_threshold: int = 1
    detect_workarounds: bool = True
    extra_workaround_markers: tuple[str, ...] = ()
    source_roots: tuple[str, ...] | None = None
    extra_source_roots: tuple[str, ...] = ()
    stopwords: frozenset[str] = frozenset(V.STOPWORDS)
    generic_basenames: frozenset[str] = frozenset(V.GENERIC_BASENAMES)
    weights: dict[str, int] = field(default_factory=lambda: dict(V.WEIGHTS))

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Config:
        """``extra_*`` adds to a default, a bare key replaces it, ``weights`` is merged; unknown keys are warned of."""
        own = {f.name for f in fields(cls)} - {"module_prefix"}
        known = own | {"extra_stopwords", "extra_generic_basenames"}
        for key in sorted(raw.keys() - known):
            near = difflib.get_close_matches(key, sorted(known), n=1)
            print(f"warning: unknown config key {key!r}" + (f" — did you mean {near[0]!r}?" if near else ""), file=sys.stderr)
        made: dict[str, Any] = {k: v for k, v in raw.items() if k in own}
        for key, of in (("stopwords", frozenset), ("generic_basenames", frozenset), ("extra_workaround_markers", tuple), ("extra_source_roots", tuple)):
            if key in made:
                made[key] = of(made[key])
        if made.get("source_roots") is not None:
            made["source_roots"] = tuple(sorted(made["source_roots"]))
        base = cls()
        for key in ("stopwords", "generic_basenames"):
            if f"extra_{key}" in raw:
                made[key] = made.get(key, getattr(base, key)) | frozenset(raw[f"extra_{key}"])
        if "weights" in made:
            made["weights"] = base.weights | made["weights"]
        return replace(base, **made)

    @classmethod
    def from_file(cls, path: str | None) -> Config:
        if not path:
            return cls()
        with open(path) as f:
            return cls.from_dict(json.load(f))

    @property
    def roots(self) -> list[str]:
        return sorted({*(V.LEGACY_SOURCE_ROOTS if self.source_roots is None else self.source_roots), *self.extra_source_roots})

    @property
    def first_depth(self) -> int:
        """Least depth of a directory that binds two changes."""
        base = len([p for p in self.module_prefix.split("/") if p]) or 1
        return base + self.min_dir_depth - 1


@dataclass(frozen=True)
class History:
    """The tables of one or many repositories; every operator keeps ``repo`` as a key, so one plan serves all of them.

    commits(repo, sha, log_pos, author, date, parents, subject, body), newest ``log_pos`` lowest; changes(repo, sha, ord, status,
    path, old_path); diff_lines(repo, sha, path, ord, sign, content) or None.
    """

    commits: DataFrame
    changes: DataFrame
    diff_lines: DataFrame | None = None

    @property
    def plain(self) -> DataFrame:
        """Commits that aren't merges."""
        return self.commits.where("parents IS NULL OR size(parents) <= 1")
