"""Settings of the engine, checked before they become literals in plans."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

STRATEGIES = ("recursive", "hierarchical", "semantic", "page", "code")
METHODS = ("hash", "vector", "dual")


@dataclass(frozen=True)
class Config:
    chunk_strategy: str = "recursive"
    chunk_min_words: int = 80
    chunk_max_words: int = 150
    chunk_overlap_sentences: int = 2
    min_chunk_words: int = 20
    max_chunk_words: int = 180
    hierarchical_small: int = 200
    hierarchical_large: int = 800
    semantic_threshold: float = 0.5
    strip_references: bool = True
    max_reference_pages: int = 15
    strip_urls: bool = True
    merge_small_chunks: bool = False
    hash_functions: tuple[str, ...] = ("fnv1a", "murmur3", "djb2")
    table_size_multiplier: float = 4.0
    target_load_factor: float = 0.35
    ngram_range: tuple[int, int] = (1, 4)
    max_concepts: int = 0
    concept_min_freq: int = 2
    embedding_enabled: bool = False
    embedding_backend: str = "local"
    embedding_model: str = "hashed-tfidf"
    embedding_dimension: int = 384
    embedding_batch_size: int = 32
    similarity_threshold: float = 0.6
    use_hnsw: bool = False
    retrieval_method: str = "hash"
    hash_weight: float = 0.6
    vector_weight: float = 0.4
    rerank_top_k: int = 20
    final_top_k: int = 5
    false_positive_penalty: float = 0.3
    context_gate_enabled: bool = True
    gate_min_chunks: int = 2
    gate_max_chunks: int = 7
    gate_relevance_threshold: float = 0.3
    prefetch_enabled: bool = True
    prefetch_cache_size: int = 10
    prefetch_predict_count: int = 3
    llm_backend: str = "none"
    llm_api_key: str | None = field(default=None, repr=False)
    llm_model: str | None = None
    llm_temperature: float = 0.3
    llm_max_tokens: int = 2048
    llm_base_url: str | None = None
    storage_path: str = "./textloom_data"
    cache_enabled: bool = True
    compress_on_save: bool = True
    parallel_ingest: bool = True
    max_workers: int = 4

    def validate(self) -> list[str]:
        """What is wrong with the settings; empty if nothing is."""
        rules = {
            "chunk_min_words must be >= 1": self.chunk_min_words >= 1,
            "chunk_max_words must be > chunk_min_words": self.chunk_max_words > self.chunk_min_words,
            "target_load_factor must be between 0 and 1": 0 < self.target_load_factor < 1,
            "final_top_k must be >= 1": self.final_top_k >= 1,
            "rerank_top_k must be >= final_top_k": self.rerank_top_k >= self.final_top_k,
            "embedding_dimension must be >= 1": not self.embedding_enabled or self.embedding_dimension >= 1,
            "llm_temperature must be between 0 and 2": 0 <= self.llm_temperature <= 2,
            "gate_min_chunks must be >= 1": self.gate_min_chunks >= 1,
            "gate_max_chunks must be >= gate_min_chunks": self.gate_max_chunks >= self.gate_min_chunks,
            "max_chunk_words must be > min_chunk_words": self.max_chunk_words > self.min_chunk_words,
            f"chunk_strategy must be one of {', '.join(STRATEGIES)}": self.chunk_strategy in STRATEGIES,
            f"retrieval_method must be one of {', '.join(METHODS)}": self.retrieval_method in METHODS,
        }
        return [message for message, holds in rules.items() if not holds]

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        """Settings from a mapping; names that are not settings are ignored."""
        known = {f.name for f in fields(cls)}
        tuples = {"hash_functions", "ngram_range"}
        return cls(**{k: tuple(v) if k in tuples else v for k, v in values.items() if k in known})
