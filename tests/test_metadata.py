"""Run metadata: one that holds, and one broken field at a time."""

from __future__ import annotations

import hashlib

import pytest

from vectide.errors import ContractError
from vectide.plans import metadata

GOOD = {
    "schema_version": 1, "selector": metadata.SELECTOR, "source_rows": 21987613, "selected_rows": 2198761, "display_rows": 1800000, "display_selected_rows": 190000, "group_size": 1000,
    "keep_per_group": 100, "quality_weight": 0, "seed": 29, "memberships_sha256": "a" * 64, "display_policy": metadata.POLICY,
}


def test_valid_metadata() -> None:
    assert metadata.parse(GOOD).selected_rows == 2198761
    assert metadata.parse(GOOD | {"display_selected_rows": 0, "extra": 1}).display_selected_rows == 0


@pytest.mark.parametrize("field,value", [
    ("selected_rows", 2198762), ("display_selected_rows", 2198761), ("group_size", 0), ("source_rows", -1), ("keep_per_group", 1001), ("quality_weight", float("inf")), ("quality_weight", 51), ("quality_weight", "1"),
    ("memberships_sha256", "not-a-hash"), ("schema_version", 2), ("seed", 0.5), ("seed", True), ("display_policy", "all"), ("selector", "ranking"), ("display_rows", 21987614), ("source_rows", 2**60),
])
def test_broken_metadata(field: str, value: object) -> None:
    with pytest.raises(ContractError):
        metadata.parse(GOOD | {field: value})


def test_missing_fields_and_checksums() -> None:
    for bad in (None, [], {k: v for k, v in GOOD.items() if k != "seed"}):
        with pytest.raises(ContractError):
            metadata.parse(bad)
    metadata.verify(b"rows", hashlib.sha256(b"rows").hexdigest())
    with pytest.raises(ContractError):
        metadata.verify(b"rows", "0" * 64)
