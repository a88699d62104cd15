"""Matching schema: typed positional fields and score tiers, read from and written to XML or JSON."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree
from dataclasses import dataclass, field
from pathlib import Path
from xml.sax.saxutils import quoteattr

#: XML element of each kind of field, in the order in which names are claimed.
KINDS = ("databaseField", "idField", "authorsField", "idxNGramField", "exactField", "nGramField", "regExpField", "noCompField", "diceField")
STATUSES = ("REQUIRED", "MAX_SCORE", "DENY_DUP")
_TYPE_NAMES = {"noCompField": "NoCompField", "diceField": ""}


class SchemaError(ValueError):
    """A schema that can't be used."""


@dataclass(frozen=True)
class FieldSpec:
    kind: str
    name: str
    pos: int
    match: str = "REQUIRED"
    required: str | None = None
    min_score: float = 0.0
    pattern: str | None = None
    group: int = 1

    def __post_init__(self) -> None:
        if self.match not in STATUSES:
            raise SchemaError(f"{self.name}: unknown match {self.match!r}")
        if not self.name.strip() or self.pos < 0:
            raise SchemaError(f"field {self.name!r} needs a name and a position from 0 on")
        if not 0 <= self.min_score <= 1:
            raise SchemaError(f"{self.name}: minScore outside [0, 1]")
        if self.kind == "regExpField" and (not self.pattern or self.group <= 0):
            raise SchemaError(f"{self.name}: a pattern and a positive group number are needed")


@dataclass(frozen=True)
class Tier:
    min_value: float
    min_fields: int

    def __post_init__(self) -> None:
        if not 0 <= self.min_value <= 1 or self.min_fields < 0:
            raise SchemaError(f"score tier {self.min_value}, {self.min_fields} out of range")


@dataclass(frozen=True)
class MatchSchema:
    name: str
    fields: tuple[FieldSpec, ...]
    tiers: tuple[Tier, ...] = field(default_factory=tuple)
    #: Size of the grams of the indexed text, and whether its length counts only as exactly as one byte tells it.
    gram: int = 3
    rough_lengths: bool = False

    def __post_init__(self) -> None:
        if self.gram < 1:
            raise SchemaError("the size of grams must be positive")
        for kind in KINDS[:2] + KINDS[3:4]:
            if sum(f.kind == kind for f in self.fields) != 1:
                raise SchemaError(f"exactly one {kind} is needed")
        if not self.tiers:
            raise SchemaError("a score tier is needed")
        if len(self.fields) < 4:
            raise SchemaError("no field to check beside database, id and indexed text")
        at = [f.pos for f in self.fields]
        if sorted(at) != list(range(len(at))):
            raise SchemaError("positions must be 0, 1, 2, ... without gaps or repeats")
        places = {f.name: f.pos for f in self.fields}
        for f in self.fields:
            if f.required and places.get(f.required, f.pos) >= f.pos:
                raise SchemaError(f"{f.name}: required field {f.required!r} must stand before it")
        # Tiers from high to low; of equal values the first one stays.
        best: dict[float, Tier] = {}
        for t in self.tiers:
            best.setdefault(t.min_value, t)
        object.__setattr__(self, "tiers", tuple(sorted(best.values(), key=lambda t: -t.min_value)))
        object.__setattr__(self, "fields", tuple(sorted(self.fields, key=lambda f: f.pos)))

    def one(self, kind: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.kind == kind), None)

    @property
    def indexed(self) -> FieldSpec:
        return self.one("idxNGramField")

    @property
    def id(self) -> FieldSpec:
        return self.one("idField")

    @property
    def database(self) -> FieldSpec:
        return self.one("databaseField")

    @property
    def highest_tier(self) -> float:
        return self.tiers[0].min_value

    @property
    def lowest_tier(self) -> float:
        return self.tiers[-1].min_value

    @classmethod
    def from_xml(cls, name: str, xml: str) -> MatchSchema:
        try:
            root = ElementTree.fromstring(xml.strip())
        except ElementTree.ParseError as e:
            raise SchemaError(f"not well-formed: {e}") from e
        fields = []
        for kind in KINDS:
            found = list(root.iter(kind))
            for x in found[:1] if kind == "authorsField" else found:
                fixed = {"databaseField": "database", "idField": "id"}.get(kind)
                try:
                    fields.append(FieldSpec(
                        kind, fixed or x.get("name", ""), int(x.get("pos", "")), x.get("match") or "REQUIRED", x.get("requiredField") or None,
                        float(x.attrib["minScore"]) if kind in ("nGramField", "diceField") else 0.0,
                        x.get("pattern"), int(x.get("groupNum", "")) if kind == "regExpField" else 1,
                    ))
                except (ValueError, KeyError) as e:
                    raise SchemaError(f"{kind}: bad or missing attribute ({e})") from e
        try:
            tiers = [Tier(float(x.get("minValue", "")), int(x.get("minFields", ""))) for x in root.iter("score")]
        except ValueError as e:
            raise SchemaError(f"score: {e}") from e
        return cls(name, tuple(fields), tuple(tiers))

    @classmethod
    def from_file(cls, name: str, path: str, encoding: str = "utf-8") -> MatchSchema:
        return cls.from_xml(name, "\n".join(Path(path).read_text(encoding=encoding).splitlines()))

    def to_xml(self) -> str:
        rows = [f'<score minValue="{t.min_value}" minFields="{t.min_fields}"/>' for t in self.tiers]
        for kind in KINDS:
            for f in (f for f in self.fields if f.kind == kind):
                attributes = {"pos": f.pos}
                if kind not in KINDS[:2]:
                    attributes["name"] = f.name
                if f.required:
                    attributes["requiredField"] = f.required
                if kind in ("authorsField", "exactField", "nGramField", "regExpField", "diceField"):
                    attributes["match"] = f.match
                if kind in ("nGramField", "diceField"):
                    attributes["minScore"] = f.min_score
                if kind == "regExpField":
                    attributes |= {"pattern": f.pattern, "groupNum": f.group}
                rows.append(f"<{kind} {' '.join(f'{k}={quoteattr(str(v))}' for k, v in attributes.items())}/>")
        return "<config>\n\t" + "\n\t".join(rows) + "\n</config>"

    def to_json(self) -> str:
        return json.dumps({
            "name": self.name,
            "score": [{"minValue": str(t.min_value), "minFields": str(t.min_fields)} for t in self.tiers],
            "total": len(self.fields),
            "params": [{"pos": f.pos, "name": f.name, "type": _TYPE_NAMES.get(f.kind, f.kind), "requiredField": f.required or "null", "contentMatch": f.match.lower()} for f in self.fields],
        }, ensure_ascii=False)
