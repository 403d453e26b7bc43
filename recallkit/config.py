"""Defaults of the engine: fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

RRF_K = 60
HALF_LIFE_DAYS = 30.0
RRF_WEIGHT, DECAY_WEIGHT, IMPORTANCE_WEIGHT = 0.5, 0.3, 0.2
TOP_K = 10
SEED_COUNT = 3
MAX_DEPTH = 5
MAX_HOPS = 50
DEDUP_TOP_K = 5
REPLACE_THRESHOLD = 0.90
MERGE_THRESHOLD = 0.85
SEMANTIC_THRESHOLD = 0.70
SEMANTIC_TOP_K = 10
ARCHIVE_THRESHOLD = 0.05
RETENTION_DAYS = 90
TURNS_PER_WINDOW = 5
MAX_CHUNK_CHARS = 3000
FREE_EDGE = "SUPERSEDES"
EDGE_TYPES = (
    "SEMANTICALLY_RELATED", "TEMPORAL_NEXT", "TEMPORAL_PREV", "SUPERSEDES", "REFERENCES", "CHUNK_NEXT", "CHUNK_PREV",
)
MEMORY_TYPES = ("episodic", "semantic", "procedural")
SOURCE_TYPES = ("conversation", "manual", "url")
TYPE_TAGS = {"semantic": "[🧠 Semantic]", "procedural": "[🕒 Procedural]", "episodic": "[📜 Episodic]"}
SORT_COLUMNS = (
    "id", "memory_type", "source_type", "semantic_relevance", "importance_score", "access_count",
    "last_accessed_at", "created_at", "updated_at", "archived_at", "project",
)


@dataclass(frozen=True)
class SearchStrategy:
    """Weights of the three sources (they sum to 1), depth of traversal, and whether time decays scores."""

    vector: float = 0.5
    keyword: float = 0.2
    graph: float = 0.3
    depth: int = 2
    time_decay: bool = True

    def __post_init__(self) -> None:
        if abs(self.vector + self.keyword + self.graph - 1.0) > 1e-6:
            raise ValueError("the weights of a strategy sum to 1")
        if min(self.vector, self.keyword, self.graph) < 0 or self.depth <= 0:
            raise ValueError("weights are not negative and the depth is positive")


@dataclass(frozen=True)
class ListFilter:
    """Predicates of a listing; ``archived``: None for active rows, True for archived ones, False for both."""

    project: str | None = None
    memory_type: str | None = None
    archived: bool | None = None
    tags: tuple[str, ...] = ()
    session_id: str | None = None
    min_importance: float | None = None
    created_after: str | None = None
    id_after: object | None = None
    archived_after: str | None = None
    order_by: str = "created_at DESC"
    limit: int | None = None
    offset: int | None = None
