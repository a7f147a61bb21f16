"""Every constant of the engine in one frozen object; fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """``as_of`` is the epoch second that counts as now, so that results can be had again."""

    as_of: int = 1_700_000_000
    rrf_k: int = 60
    rank_base: int = 0
    code_lookup_boost: float = 1.5
    confidence_weight: float = 0.5
    max_per_file: int = 3
    path_penalty: float = 0.8
    distance_weight: float = 0.5
    keyword_weight: float = 0.4
    recency_weight: float = 0.1
    half_life_seconds: int = 604_800
    keyword_scale: float = 5.0
    expansion_files: int = 3
    expansion_related: int = 2
    expansion_chunks: int = 2
    expansion_factor: float = 0.85
    fts_only_distance: float = 0.0
    top_k: int = 10
    max_tokens: int = 8_000
    recall_fts_limit: int = 100
    recall_vector_limit: int = 30
    recall_top: int = 50
    recall_shown: int = 7
    summary_pool: int = 10
    min_cosine: float = 0.55
    max_l2: float = 0.92
    turn_sentences: int = 3
    rollup_sentences: int = 5
    output_chars: int = 1_500
    input_chars: int = 4_000
    stored_chars: int = 5_000
    file_bytes: int = 2_097_152
    turn_days: int = 180
    decision_days: int = 365
    area_days: int = 180
    reply_tokens: int = 500
    default_confidence: float = 0.0

    def with_overrides(self, **values) -> Settings:
        """A copy with other values; unknown names and wrong types are refused."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        for name, value in values.items():
            if name not in kinds:
                raise KeyError(name)
            if not isinstance(value, kinds[name]) and not (kinds[name] is float and isinstance(value, int)):
                raise TypeError(f"{name} has to be {kinds[name].__name__}")
        return replace(self, **values)


SETTINGS = Settings()
BUCKETS = ("retrieval", "chunk_compression", "output_compression", "memory_recall", "grammar", "turn_summarization", "progressive_disclosure")
CHUNK_TYPES = ("function", "class", "module", "doc", "comment", "commit", "session", "decision")
EDGE_TYPES = ("calls", "imports", "defines", "modifies", "discussed_in", "decided")
#: Assumed share of a reply that each output level saves.
LEVEL_SHARE = {"off": 0.0, "lite": 0.25, "standard": 0.70, "max": 0.80}
#: Most characters of a chunk's fallback by compression level.
TRUNCATION = {"minimal": 100, "standard": 300, "full": 800}
