"""What a package says about itself: selectors, lineage and revisions. Plain data, no Spark."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

OPERATORS = ("in", "not_in", "eq", "neq", "gt", "gte", "lt", "lte", "between")


class ModelError(ValueError):
    pass


@dataclass(frozen=True)
class Selector:
    """A statement on a column, as metadata: it filters rows only where it is asked to."""

    selector_id: str
    field: str
    operator: str
    values: Any
    code_system: str | None = None
    label: str | None = None
    is_exclusion: bool = False

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ModelError(f"unknown operator {self.operator!r}")
        if self.operator == "between" and (not isinstance(self.values, list | tuple) or len(self.values) != 2):
            raise ModelError("between takes two values")

    @property
    def list(self) -> list[Any]:
        return list(self.values) if isinstance(self.values, list | tuple) else [self.values]


@dataclass(frozen=True)
class Delta:
    """A change of one selector: add (with ``body``), remove (with the ``body`` that went) or modify a field."""

    action: str
    selector_id: str
    body: Selector | None = None
    field: str | None = None
    before: Any = None
    after: Any = None


@dataclass(frozen=True)
class Revision:
    number: int
    message: str = ""
    author: str = ""
    date: str = ""
    deltas: tuple[Delta, ...] = ()
    size: int | None = None
    origin: str | None = None  # the package that it was made in, for merged histories


@dataclass(frozen=True)
class Lineage:
    source_system: tuple[str, ...] = ()
    source_tables: tuple[str, ...] = ()
    query_hash: str | None = None
    extraction_date: str | None = None
    job_id: str | None = None
    parents: tuple[str, ...] = ()  # paths of the packages that this one was derived from
    operation: str | None = None


@dataclass(frozen=True)
class Definition:
    name: str
    description: str = ""
    revision: int = 1
    logic: str = "AND"
    selectors: tuple[Selector, ...] = ()
    lineage: Lineage = Lineage()
    history: tuple[Revision, ...] = ()
    primary_keys: tuple[str, ...] = ()
    created_at: str = ""
    created_by: str = ""

    def selector(self, selector_id: str) -> Selector | None:
        return next((s for s in self.selectors if s.selector_id == selector_id), None)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Definition:
        selector = lambda x: x and Selector(**{**x, "values": x["values"]})
        revision = lambda r: Revision(**{**r, "deltas": tuple(Delta(**{**x, "body": selector(x.get("body"))}) for x in r.get("deltas", ()))})
        line = dict(d.get("lineage") or {})
        if isinstance(line.get("source_system"), str):
            line["source_system"] = [line["source_system"]]
        line = {k: tuple(v) if isinstance(v, list) else v for k, v in line.items()}
        rest = {k: v for k, v in d.items() if k not in ("selectors", "history", "lineage", "primary_keys")}
        return cls(**rest, selectors=tuple(map(selector, d.get("selectors", ()))), history=tuple(map(revision, d.get("history", ()))), lineage=Lineage(**line), primary_keys=tuple(d.get("primary_keys", ())))


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")


def bump(d: Definition, message: str, author: str, size: int | None = None, deltas: Iterable[Delta] = ()) -> Definition:
    """The next revision, with the total number of rows after it."""
    entry = Revision(d.revision + 1, message, author, now(), tuple(deltas), size)
    return replace(d, revision=entry.number, history=(*d.history, entry))


def _changed(selectors: tuple[Selector, ...], delta: Delta, back: bool = False) -> tuple[Selector, ...]:
    action = {"add": "remove", "remove": "add"}.get(delta.action, delta.action) if back else delta.action
    there = any(s.selector_id == delta.selector_id for s in selectors)
    if action == "add":
        if not delta.body:
            raise ModelError(f"no body for {delta.selector_id!r}")
        if there:
            raise ModelError(f"selector {delta.selector_id!r} exists")
        return (*selectors, delta.body)
    if not there:
        raise ModelError(f"unknown selector {delta.selector_id!r}")
    if action == "remove":
        return tuple(s for s in selectors if s.selector_id != delta.selector_id)
    if action != "modify" or delta.field not in ("values", "operator", "is_exclusion", "label"):
        raise ModelError(f"can't {delta.action} {delta.field!r}")
    return tuple(replace(s, **{delta.field: delta.before if back else delta.after}) if s.selector_id == delta.selector_id else s for s in selectors)


def apply_revision(d: Definition, entry: Revision) -> Definition:
    """``d`` after ``entry``, which must be the next one."""
    if entry.number != d.revision + 1:
        raise ModelError(f"revision {entry.number} can't follow {d.revision}")
    selectors = d.selectors
    for delta in entry.deltas:
        selectors = _changed(selectors, delta)
    return replace(d, revision=entry.number, selectors=selectors, history=(*d.history, entry))


def selectors_at(d: Definition, number: int) -> tuple[Selector, ...]:
    """The selectors as they were after revision ``number``: later deltas undone, last one first."""
    if not 1 <= number <= d.revision:
        raise ModelError(f"revision must be from 1 to {d.revision}")
    selectors = d.selectors
    for entry in sorted((r for r in d.history if r.number > number and not r.origin), key=lambda r: -r.number):
        for delta in reversed(entry.deltas):
            selectors = _changed(selectors, delta, back=True)
    return selectors


def selector_changes(left: Iterable[Selector], right: Iterable[Selector]) -> dict[str, list]:
    """Selectors added, removed and modified (id, field, before, after) from left to right."""
    a, b = ({s.selector_id: s for s in x} for x in (left, right))
    fields = ("field", "operator", "values", "code_system", "label", "is_exclusion")
    same = lambda x, y: (list(x) if isinstance(x, tuple) else x) == (list(y) if isinstance(y, tuple) else y)
    return {
        "added": [b[i] for i in sorted(b.keys() - a.keys())],
        "removed": [a[i] for i in sorted(a.keys() - b.keys())],
        "modified": [(i, f, getattr(a[i], f), getattr(b[i], f)) for i in sorted(a.keys() & b.keys()) for f in fields if not same(getattr(a[i], f), getattr(b[i], f))],
    }


def diff_revisions(d: Definition, a: int, b: int) -> dict[str, list]:
    return selector_changes(selectors_at(d, a), selectors_at(d, b))


def annotated(d: Definition, *, name: str | None = None, description: str | None = None, add: Iterable[Selector] = (), remove: Iterable[str] = (), message: str = "Annotate", author: str = "", size: int | None = None) -> Definition:
    """Name, description and selectors changed as one revision; removals before additions, unknown ids are no-ops."""
    deltas, selectors = [], d.selectors
    for i in remove:
        if found := next((s for s in selectors if s.selector_id == i), None):
            deltas.append(Delta("remove", i, body=found))
            selectors = _changed(selectors, deltas[-1])
    for s in add:
        deltas.append(Delta("add", s.selector_id, body=s))
        selectors = _changed(selectors, deltas[-1])
    return bump(replace(d, name=name if name is not None else d.name, description=description if description is not None else d.description, selectors=selectors), message, author, size, deltas)


def merged(parts: list[tuple[str, Definition]], name: str, operation: str, message: str, author: str, size: int) -> Definition:
    """The definition of a package made from others: selectors by id (first wins), lineages joined, histories kept apart
    by origin, no primary keys, logic AND."""
    if not parts:
        raise ModelError("No input files")
    selectors: dict[str, Selector] = {}
    for _, d in parts:
        for s in d.selectors:
            selectors.setdefault(s.selector_id, s)
    flat = lambda f: tuple(dict.fromkeys(x for _, d in parts for x in getattr(d.lineage, f)))
    dates = [d.lineage.extraction_date for _, d in parts if d.lineage.extraction_date]
    history = sorted((replace(r, origin=r.origin or path) for path, d in parts for r in d.history), key=lambda r: (r.number, r.origin))
    number = max(d.revision for _, d in parts) + 1
    lineage = Lineage(flat("source_system"), flat("source_tables"), None, max(dates, default=None), None, tuple(p for p, _ in parts), operation)
    entry = Revision(number, message, author, now(), (), size)
    return Definition(name, "; ".join(dict.fromkeys(d.description for _, d in parts if d.description)), number, "AND", tuple(selectors.values()), lineage, (*history, entry), (), now(), author)
