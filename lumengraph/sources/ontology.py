"""Entity and relation types with domains and ranges: look-ups, canonical names, validation of triples."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default types, their labels, and which relations hold between which types.
ENTITY_LABELS = {"Movie": "影片", "Person": "影人", "Company": "机构", "Award": "奖项", "Genre": "类型", "Character": "角色"}
RELATIONS = [
    ("directed", "执导", ["Person"], ["Movie"]),
    ("acted_in", "出演", ["Person"], ["Movie"]),
    ("wrote", "编剧", ["Person"], ["Movie"]),
    ("produced", "出品", ["Company"], ["Movie"]),
    ("won", "获奖", ["Person", "Movie"], ["Award"]),
    ("nominated", "提名", ["Person", "Movie"], ["Award"]),
    ("plays", "饰演", ["Person"], ["Character"]),
    ("appears_in", "角色出现于", ["Character"], ["Movie"]),
    ("adapted_from", "改编自", ["Movie"], ["Movie"]),
    ("sequel_of", "续作", ["Movie"], ["Movie"]),
    ("has_genre", "类型", ["Movie"], ["Genre"]),
]


@dataclass(frozen=True)
class RelationType:
    name: str
    label: str
    domain: tuple[str, ...]
    range: tuple[str, ...]


@dataclass(frozen=True)
class Ontology:
    entities: dict[str, str]
    relations: dict[str, RelationType] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.entities or not self.relations:
            raise ValueError("an ontology needs entity types and relation types")
        for r in self.relations.values():
            if not r.domain or not r.range:
                raise ValueError(f"{r.name} has no domain or no range")
            if unknown := {*r.domain, *r.range} - self.entities.keys():
                raise ValueError(f"{r.name} names undefined types: {', '.join(sorted(unknown))}")

    @classmethod
    def default(cls) -> Ontology:
        return cls(dict(ENTITY_LABELS), {n: RelationType(n, label, tuple(d), tuple(r)) for n, label, d, r in RELATIONS})

    @classmethod
    def from_dict(cls, spec: dict) -> Ontology:
        """{"entity_types": {name: {"label"}}, "relation_types": {name: {"label", "domain", "range"}}}."""
        relations = {n: RelationType(n, r.get("label", n), tuple(r.get("domain") or ()), tuple(r.get("range") or ())) for n, r in (spec.get("relation_types") or {}).items()}
        return cls({n: (e or {}).get("label", n) for n, e in (spec.get("entity_types") or {}).items()}, relations)

    def entity_type(self, text: str) -> str | None:
        """The type that a name or label stands for, in any case."""
        return _pick({**{v: k for k, v in self.entities.items()}, **{k: k for k in self.entities}}, text.strip())

    def relation_type(self, text: str) -> str | None:
        names = {**{r.label: n for n, r in self.relations.items()}, **{n: n for n in self.relations}}
        return _pick(names, text.strip()) or _pick(names, re.sub(r"[\s-]+", "_", text.strip()))

    def problem(self, head_type: str, relation: str, tail_type: str) -> str | None:
        """Why a triple of types isn't allowed, or None."""
        r = self.relations.get(relation)
        if r is None:
            return f"unknown relation {relation}"
        if head_type not in r.domain:
            return f"{relation} can't start at {head_type}"
        return None if tail_type in r.range else f"{relation} can't end at {tail_type}"

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.name, r.label, d, t) for r in self.relations.values() for d in r.domain for t in r.range]
        return spark.createDataFrame(rows, "type string, label string, head_type string, tail_type string")

    def violations(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """Edges whose endpoint types their relation doesn't allow."""
        kinds = nodes.select("id", F.col("type").alias("kind"))
        typed = edges.join(kinds.select(F.col("id").alias("head_id"), F.col("kind").alias("head_type")), "head_id").join(kinds.select(F.col("id").alias("tail_id"), F.col("kind").alias("tail_type")), "tail_id")
        return typed.join(F.broadcast(self.table(edges.sparkSession)), ["type", "head_type", "tail_type"], "left_anti")


def _pick(names: dict[str, str], text: str) -> str | None:
    return names.get(text) or {k.lower(): v for k, v in names.items()}.get(text.lower())
