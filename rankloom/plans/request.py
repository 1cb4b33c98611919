"""A search request: defaults, bounds and the rules between fields."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Names of models, retrievers for answers, and ways to make an answer.
MODELS = ("tfidf", "bm25", "distributed_bm25", "embedding", "biomedical_embedding", "hybrid_serial", "hybrid_parallel", "ltr", "rag", "agent")
RETRIEVERS = ("tfidf", "bm25", "embedding", "hybrid_serial", "hybrid_parallel")
GENERATION = ("extractive_offline", "local_llm")
CANDIDATE_MODELS = ("bm25", "tfidf", "embedding", "biomedical_embedding")
DATASETS = ("sample_dataset", "clinical_trials", "quora")
# Bounds of the numbers.
BOUNDS = {
    "top_k": (1, 1000), "bm25_k1": (1e-6, 100.0), "bm25_b": (0.0, 1.0), "candidate_count": (1, 10_000), "rrf_k": (1, 100_000),
    "num_shards": (1, 1024), "shard_top_k": (1, 100_000), "tfidf_weight": (0.0, 100.0), "bm25_weight": (0.0, 100.0),
    "embedding_weight": (0.0, 100.0), "biomedical_weight": (0.0, 100.0), "rag_context_docs": (1, 50), "rag_answer_sentences": (1, 10),
    "rag_llm_temperature": (0.0, 2.0), "rag_llm_max_tokens": (1, 4096),
    "feedback_docs": (1, 100), "expansion_terms": (1, 100), "snippet_length": (1, 5000), "max_personalization_terms": (1, 20),
}


@dataclass(frozen=True)
class SearchRequest:
    query: str
    dataset: str = "sample_dataset"
    model: str = "tfidf"
    user_id: str | None = None
    session_id: str | None = None
    top_k: int = 10
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    candidate_count: int = 1000
    rrf_k: int = 60
    num_shards: int | None = None
    shard_top_k: int | None = None
    tfidf_weight: float = 1.0
    bm25_weight: float = 1.0
    embedding_weight: float = 1.0
    biomedical_weight: float = 0.0
    ltr_candidate_models: tuple[str, ...] | list[str] | str | None = None
    include_biomedical: bool = False
    ltr_model_path: str | None = None
    rag_retriever_model: str = "hybrid_serial"
    rag_context_docs: int = 5
    rag_answer_sentences: int = 4
    include_sources: bool = True
    rag_generation_mode: str = "extractive_offline"
    rag_llm_provider: str = "ollama"
    rag_llm_model: str = "llama3.2:3b"
    rag_llm_base_url: str = "http://localhost:11434"
    rag_llm_temperature: float = 0.0
    rag_llm_max_tokens: int = 350
    use_query_refinement: bool = False
    feedback_docs: int = 3
    expansion_terms: int = 5
    use_spelling_correction: bool = False
    snippet_length: int = 500
    include_raw_text: bool = False
    use_personalization: bool = False
    max_personalization_terms: int = 3

    def __post_init__(self):
        if not isinstance(self.query, str) or not self.query.strip():
            raise ValueError("query is blank")
        put = lambda name, value: object.__setattr__(self, name, value)
        put("query", self.query.strip())
        for name, known in (("dataset", DATASETS), ("model", MODELS), ("rag_retriever_model", RETRIEVERS), ("rag_generation_mode", GENERATION)):
            put(name, str(getattr(self, name)).strip().lower())
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name}: {getattr(self, name)}")
        for name, (low, high) in BOUNDS.items():
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high):
                raise ValueError(f"{name} is not from {low} to {high}")
        for f in fields(self):
            if f.type == "bool" and not isinstance(getattr(self, f.name), bool):
                raise ValueError(f"{f.name} is no boolean")
        self._candidates(put)
        hybrid = self.model.startswith("hybrid") or (self.model == "rag" and self.rag_retriever_model.startswith("hybrid"))
        if hybrid and self.candidate_count < self.top_k:
            raise ValueError("candidate_count is below top_k")
        if self.include_raw_text and self.top_k > 50:
            raise ValueError("raw text needs top_k of 50 or less")
        medical = self.biomedical_weight or self.include_biomedical or self.model == "biomedical_embedding" or "biomedical_embedding" in self.ltr_candidate_models
        if medical and self.dataset != "clinical_trials":
            raise ValueError("biomedical vectors need clinical_trials")
        if self.model == "hybrid_parallel" and self.tfidf_weight + self.bm25_weight + self.embedding_weight + self.biomedical_weight <= 0:
            raise ValueError("all weights are 0")

    def _candidates(self, put) -> None:
        """A list or a comma string of models, each once; the three that every data set has by default."""
        asked = self.ltr_candidate_models
        names = asked.split(",") if isinstance(asked, str) else list(asked or ("bm25", "tfidf", "embedding"))
        names = list(dict.fromkeys(str(x).strip().lower() for x in names if str(x).strip()))
        if self.include_biomedical and "biomedical_embedding" not in names:
            names.append("biomedical_embedding")
        unknown = [x for x in names if x not in CANDIDATE_MODELS]
        if unknown or not names:
            raise ValueError(f"unknown candidate models: {unknown}")
        put("ltr_candidate_models", tuple(names))

    @classmethod
    def parse(cls, values: dict) -> SearchRequest:
        """A request from text or JSON values: numbers and booleans may be strings, blanks mean the default, unknown fields are an error."""
        kinds = {f.name: f.type for f in fields(cls)}
        unknown = sorted(set(values) - set(kinds))
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        return cls(**{k: coerced(k, v, kinds[k]) for k, v in values.items() if k == "query" or not (v is None or isinstance(v, str) and not v.strip())})

    @property
    def user(self) -> str | None:
        return self.user_id or self.session_id


def coerced(name: str, value, kind: str):
    """A value as the kind says; strings are read, anything that is not of the kind is an error."""
    if kind == "bool":
        known = {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}
        if isinstance(value, bool):
            return value
        if str(value).strip().lower() in known:
            return known[str(value).strip().lower()]
        raise ValueError(f"{name} is no boolean")
    if kind.startswith(("int", "float")):
        if isinstance(value, bool):
            raise ValueError(f"{name} is no number")
        try:
            number = float(value)
        except (TypeError, ValueError):
            raise ValueError(f"{name} is no number") from None
        if kind.startswith("float"):
            return number
        if number != int(number):
            raise ValueError(f"{name} is no whole number")
        return int(number)
    return value
