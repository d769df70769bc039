"""Parameters of scoring, selection and expansion."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TfIdf:
    ratio_threshold: float = 0.7
    keywords_boost: float = 2.0
    keywords_type: str = "weight"


@dataclass(frozen=True)
class LexRank:
    threshold: float | None = 0.065
    all_questions: bool = True

    def __post_init__(self) -> None:
        if self.threshold is not None and not (isinstance(self.threshold, float) and 0 <= self.threshold < 1):
            raise ValueError("threshold must be None or a float in [0, 1)")


@dataclass(frozen=True)
class KeywordRatio:
    keyword_threshold: float = 0.8
    word_threshold: float = 0.8


@dataclass(frozen=True)
class Fusion:
    tfidf: float = 4
    lexrank: float = 2
    keyword: float = 2
    mover: float = 3
    query: float = 3

    @property
    def total(self) -> float:
        return self.tfidf + self.lexrank + self.keyword + self.mover + self.query


@dataclass(frozen=True)
class Selection:
    limit: float = 5
    kind: str = "num"  # num, ratio or threshold
    score: str = "final"


@dataclass(frozen=True)
class Diversity:
    balance: float = 0.85
    sentences: int | float = 25  # a float is a share of the candidates
    duplicate: float = 0.9


@dataclass(frozen=True)
class Expansion:
    entity_weight: float = 2
    token_weight: float = 4
    ontology_decay: float = 0.3
    synset_decay: float = 0.2
    least_weight: float = 1
    categories: tuple[str, ...] = ("C", "D")
    word_threshold: float = 0.8
    entity_threshold: float = 0.7


@dataclass(frozen=True)
class Settings:
    tfidf: TfIdf = field(default_factory=TfIdf)
    lexrank: LexRank = field(default_factory=LexRank)
    keywords: KeywordRatio = field(default_factory=KeywordRatio)
    fusion: Fusion = field(default_factory=Fusion)
    single: Selection = field(default_factory=Selection)
    multi: Selection = field(default_factory=lambda: Selection(limit=10))
    diversity: Diversity = field(default_factory=Diversity)
    expansion: Expansion = field(default_factory=Expansion)
