"""Access policies on rows and columns, and universes of keys."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from .filters import with_bits
from .sets import members

TYPES = ("predicate", "row_limit", "bitmap", "column_mask", "package")


@dataclass(frozen=True)
class Policy:
    policy_id: str
    name: str = ""
    type: str = "package"
    predicate: str | None = None
    source_bitset: int | None = None
    bitset_column: str = "SOURCES_BITSET"
    masked_columns: tuple[str, ...] = ()
    mask_value: str = "***MASKED***"
    max_rows: int | None = None
    packages: tuple[str, ...] = ()
    operation: str = "union"
    enabled: bool = True
    priority: int = 0
    tier: str | None = None
    roles: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown policy type {self.type!r}")


def apply_policy(df: DataFrame, p: Policy, order: list[Column], universe: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows by predicate, bit set and universe first, then masks, then the row limit in ``order``."""
    if not p.enabled:
        return df
    if p.predicate:
        df = df.where(F.expr(p.predicate))
    if p.source_bitset is not None and p.bitset_column in df.columns:
        df = with_bits(df, p.bitset_column, p.source_bitset)
    if universe is not None:
        df = df.join(universe, key, "left_semi")
    if p.max_rows is not None:
        df = df.orderBy(*order).limit(p.max_rows)  # chosen before the mask hides what the order needs
    hidden = {c.lower() for c in p.masked_columns}
    return df.select(*[F.lit(p.mask_value).alias(c) if c.lower() in hidden else F.col(f"`{c}`") for c in df.columns])


def apply_policies(df: DataFrame, policies: list[Policy], order: list[Column]) -> DataFrame:
    """Enabled policies, highest priority first; all limits and masks after all row filters."""
    on = sorted((p for p in policies if p.enabled), key=lambda p: (-p.priority, p.policy_id))
    for p in on:
        df = apply_policy(df, replace(p, masked_columns=(), max_rows=None), order)
    limits = [p.max_rows for p in on if p.max_rows is not None]
    for p in [Policy("limits", max_rows=min(limits) if limits else None), *[Policy(p.policy_id, masked_columns=p.masked_columns, mask_value=p.mask_value) for p in on]]:
        df = apply_policy(df, p, order)
    return df


def universe_keys(memberships: list[DataFrame], key: str, operation: str) -> DataFrame:
    """The keys of an enabled policy's packages joined by its operation."""
    return members(memberships, key, operation)


class PolicyStore:
    """Policies as JSON files in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, policy_id: str) -> str:
        if not policy_id or "/" in policy_id or policy_id.startswith("."):
            raise ValueError(f"bad policy id {policy_id!r}")
        return f"{self.folder}/{policy_id}.json"

    def create(self, p: Policy) -> None:
        store.write_text(self.spark, self._path(p.policy_id), json.dumps(asdict(p)))

    def get(self, policy_id: str) -> Policy:
        d = json.loads(store.read_text(self.spark, self._path(policy_id)))
        return Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})

    def delete(self, policy_id: str) -> bool:
        return store.delete(self.spark, self._path(policy_id))

    def list(self, enabled_only: bool = False) -> list[Policy]:
        names = sorted(n for n in store.names(self.spark, self.folder) if n.endswith(".json"))
        found = [self.get(n[:-5]) for n in names]
        return [p for p in found if p.enabled or not enabled_only]
