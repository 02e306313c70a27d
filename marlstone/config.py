"""Settings of a corpus: where the docs and the index live."""

from __future__ import annotations

import os
from dataclasses import dataclass

# The defaults.
DEFAULT_DOCS_PATH = ".cache/xrpl-dev-portal"
DEFAULT_DB_PATH = ".rag/index"
DEFAULT_COLLECTION = "xrpl_docs"
SENTENCE_MODEL = "sentence-transformers/all-MiniLM-L6-v2"
OFFLINE_MODEL = "hashed-words-256"
# The same on every machine; the sentence model is chosen by name, and fails
# where its package is absent.
DEFAULT_MODEL = OFFLINE_MODEL


@dataclass(frozen=True)
class CorpusConfig:
    docs_path: str = DEFAULT_DOCS_PATH
    db_path: str = DEFAULT_DB_PATH
    collection_name: str = DEFAULT_COLLECTION
    embedding_model: str = DEFAULT_MODEL

    @classmethod
    def from_env(cls, env=os.environ) -> CorpusConfig:
        """Settings from MARLSTONE_DOCS_PATH, _DB_PATH, _COLLECTION, _EMBEDDING_MODEL."""
        return cls(
            env.get("MARLSTONE_DOCS_PATH", DEFAULT_DOCS_PATH),
            env.get("MARLSTONE_DB_PATH", DEFAULT_DB_PATH),
            env.get("MARLSTONE_COLLECTION", DEFAULT_COLLECTION),
            env.get("MARLSTONE_EMBEDDING_MODEL") or DEFAULT_MODEL,
        )

    def resolve(self, base: str | None = None) -> CorpusConfig:
        """Absolute paths; URIs such as hdfs:// stay as they are."""
        root = base or os.getcwd()
        place = lambda path: path if "://" in path else os.path.join(root, path)
        return CorpusConfig(
            place(self.docs_path), place(self.db_path), self.collection_name, self.embedding_model
        )
