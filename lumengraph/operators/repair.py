"""What repaired answers say and cite: search texts, citations, bounded negatives, sentences. The rounds are in ``gap_repair``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grammar import Plan

Edge = tuple[str, str, str]

# What a search for a missing edge says.
OF_ROLE = {"acted_in": "出演 主演", "directed": "执导 导演"}
OF_FILMS = {"acted_in": "参演 影片 片单", "directed": "执导 影片 片单"}
TOGETHER = {"cofilm": "{0} {1} 共同出演 电影", "director_actor": "{0} 执导 {1} 出演 电影"}
DIRECTORS, CAST, CAST_OF = "《{0}》 全部导演 执导", "《{0}》 演员 主演 配音", "{0} 执导 电影 演员 主演"


def prune_uncited(proof_edges: DataFrame, edge_chunks: DataFrame, used: DataFrame, key: str = "question_id") -> DataFrame:
    """Answers all of whose proof edges cite a used chunk, or have no evidence at all: (key, answer_id)."""
    cited = edge_chunks.join(used.select(key, "chunk_id", F.lit(True).alias("used")).distinct(), [key, "chunk_id"], "left")
    state = cited.groupBy(key, "edge_id").agg(F.bool_or(F.coalesce("used", F.lit(False))).alias("ok"))
    joined = proof_edges.join(state, [key, "edge_id"], "left")
    return joined.groupBy(key, "answer_id").agg(F.bool_and(F.coalesce("ok", F.lit(True))).alias("ok")).where("ok").select(key, "answer_id")


def bounded_negative(plan: Plan, subjects_films: dict[str, set[str] | None], record_chunks: dict[str, list[str]], asked: int, limit: int, current_corpus: bool) -> bool:
    """Whether "no, not in this corpus" may be said: a yes-no question about two people of whom the complete
    filmography records were read (None: not complete), without a common film, at least one search made,
    and all record chunks within the budget. It never claims more than the corpus."""
    if plan.kind != "cofilm" or not plan.boolean or not current_corpus or not asked:
        return False
    films = [subjects_films.get(s) for s in plan.subjects]
    cited = {c for s in plan.subjects for c in record_chunks.get(s, [])}
    return all(f is not None for f in films) and not (films[0] & films[1]) and 0 < len(cited) <= limit


def answer_text(plan: Plan, answers: dict[str, tuple[Edge, ...]], names: dict[str, str], negative: bool = False) -> str:
    """A deterministic sentence: answers in order of id, with their films where films are the proof."""
    if negative:
        return "在当前语料的完整片单中没有共同影片；这不排除语料之外的情况。"
    if not answers:
        return "没有找到完整的证据。"
    lines = []
    for a in sorted(answers):
        films = sorted({t for _, _, t in answers[a]} - {a})
        lines.append(names.get(a, a) + (f"（{'、'.join(names.get(f, f) for f in films)}）" if films and plan.target_type == "Person" and plan.kind != "directors" else ""))
    return "；".join(lines) + "。"
