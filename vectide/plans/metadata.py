"""Metadata of a selection over a full corpus, and the checksum of its memberships."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, fields

from vectide.errors import ContractError

#: Fixed values of the format.
VERSION, SELECTOR, POLICY = 1, "balanced_two_means_dpp", "intersection_with_existing_display_population"
MOST_WEIGHT = 50.0


@dataclass(frozen=True)
class SelectionRun:
    """Counts of the corpus and of the display are kept apart."""

    schema_version: int
    selector: str
    source_rows: int
    selected_rows: int
    display_rows: int
    display_selected_rows: int
    group_size: int
    keep_per_group: int
    quality_weight: float
    seed: int
    memberships_sha256: str
    display_policy: str

    def problems(self) -> list[str]:
        """Names of broken rules."""
        whole = {f.name: getattr(self, f.name) for f in fields(self) if f.name.endswith(("rows", "size", "group")) or f.name == "seed"}
        bad = [k for k, v in whole.items() if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v < 2**53]
        if bad:
            return bad
        w = self.quality_weight
        rules = {
            "schema_version": self.schema_version == VERSION, "selector": self.selector == SELECTOR, "display_policy": self.display_policy == POLICY,
            "group": 1 <= self.keep_per_group <= self.group_size, "quota": self.group_size > 0 and self.selected_rows == self.source_rows * self.keep_per_group // self.group_size and self.selected_rows > 0,
            "display": self.display_rows <= self.source_rows and self.display_selected_rows <= min(self.selected_rows, self.display_rows),
            "quality_weight": isinstance(w, (int, float)) and not isinstance(w, bool) and math.isfinite(w) and 0 <= w <= MOST_WEIGHT,
            "checksum": isinstance(self.memberships_sha256, str) and re.fullmatch("[a-f0-9]{64}", self.memberships_sha256) is not None,
        }
        return [k for k, ok in rules.items() if not ok]


def parse(value: object) -> SelectionRun:
    """A checked run of a mapping; extra keys are ignored."""
    names = [f.name for f in fields(SelectionRun)]
    if not isinstance(value, dict) or any(n not in value for n in names):
        raise ContractError("run metadata lacks fields")
    run = SelectionRun(**{n: value[n] for n in names})
    bad = run.problems()
    if bad:
        raise ContractError(f"run metadata: {', '.join(bad)}")
    return run


def verify(memberships: bytes, expected: str) -> None:
    if hashlib.sha256(memberships).hexdigest() != expected:
        raise ContractError("checksum of memberships differs")
