"""Declared schemas of the store's tables, and settings."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass

CONTENT = "hash string, doc string, created_at timestamp"
COLLECTIONS = "name string, path string, pattern string, ignore_patterns array<string>, include_by_default boolean, update_command string, context map<string,string>"
DOCUMENTS = "id bigint, collection string, path string, title string, hash string, metadata string, active boolean, deleted_at timestamp, created_at timestamp, modified_at timestamp, source_uri string"
CHUNKS = "chunk_id bigint, content_hash string, seq int, pos int, len int, model string, section_path string, chunk_type string, language string, embedded_at timestamp, params string"
#: ``digest`` is the SHA-256 of the chunk's text: an equal text needs no second call of the model.
VECTORS = "chunk_id bigint, model string, embedding array<float>, digest string"
TOKENS = "chunk_id bigint, dl int, tokens array<string>"
POSTINGS = "term string, chunk_id bigint, positions array<int>, dl int, level int"
#: Counts of live chunks by term and level, as deltas; the empty term has the number of chunks and of their tokens.
STATISTICS = "term string, level int, n_docs bigint, n bigint"
COUNTED = "content_hash string"
DEAD = "chunk_id bigint"
INDEXED = "content_hash string, model string, params string, n_chunks bigint, embedded_at timestamp"
CACHE = "hash string, type string, result string, created_at timestamp, expires_at timestamp"
TABLES = {"content": CONTENT, "store_collections": COLLECTIONS, "documents": DOCUMENTS, "chunks": CHUNKS, "vectors": VECTORS, "tokens": TOKENS, "postings": POSTINGS, "indexed": INDEXED, "cache": CACHE, "statistics": STATISTICS, "counted": COUNTED, "dead": DEAD}
#: What names a row of each table: deletions are kept by it.
KEYS = {"content": "hash", "store_collections": "name", "documents": "id", "chunks": "chunk_id", "vectors": "chunk_id", "tokens": "chunk_id", "postings": "chunk_id", "indexed": "content_hash", "cache": "hash", "statistics": "term", "counted": "content_hash", "dead": "chunk_id"}
#: Tables whose rows are deltas: what they sum by, and what is summed. Putting parts together adds them up.
SUMMED = {"statistics": (["term", "level"], ["n_docs", "n"])}


@dataclass(frozen=True)
class Embedding:
    model: str = "hashing-64"
    dimensions: int = 64
    batch: int = 64


@dataclass(frozen=True)
class Chunking:
    target_chars: int = 2100
    overlap_chars: int = 225
    min_chars: int = 100


@dataclass(frozen=True)
class Search:
    default_count: int = 5
    bm25_threshold: float = 0.85
    bm25_gap: float = 0.15
    cache_ttl_hours: int = 24
    cache_evict_limit: int = 100
    rrf_k: int = 60
    candidates: int = 5  # of each source, for every result wanted
    rerank: int = 3
    probes: int = 0  # lists of the vector index that a search looks at, -1 for as many as its fitting took; 0 for exact distances to all vectors


@dataclass(frozen=True)
class Settings:
    embedding: Embedding = field(default_factory=Embedding)
    chunking: Chunking = field(default_factory=Chunking)
    search: Search = field(default_factory=Search)

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings from a JSON file, defaults where it says nothing; all defaults where there is no file."""
        given = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
        parts = {f.name: f.default_factory for f in fields(cls)}
        return cls(**{name: make(**given.get(name, {})) for name, make in parts.items()})

    def save(self, path: str) -> None:
        assert is_dataclass(self)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)
