"""Every parameter of the engine."""

from __future__ import annotations

from dataclasses import dataclass

EXPIRED_MARK = -1


@dataclass(frozen=True)
class Params:
    """threshold: least cosine of an article and a cluster's centroid. fusion: of two centroids; over 1 turns
    fusion off. open_hours: how long a cluster takes articles, from its creation. refit_growth: share by which the
    corpus may outgrow its vocabulary. component_cap: vectors of a component up to which one task assigns it; larger ones take
    a round of tasks for each window of articles, with the same result."""

    threshold: float = 0.75
    fusion: float = 0.85
    open_hours: int = 12
    min_outlets: int = 2
    embed_chars: int = 500
    entity_chars: int = 4000
    terms_per_outlet: int = 8
    refit_growth: float = 0.2
    notes_floor: int = 2
    notes_cap: int = 30
    max_unsynthesised_hours: int = 72
    max_attempts: int = 5
    extraction_floor: int = 500
    alert_cooldown_minutes: int = 60
    cycle_minutes: int = 15
    vector_batch: int = 32
    min_mentions: int = 2
    min_corpus: int = 20
    component_cap: int = 5000
    post_limit: int = 280
    post_url_weight: int = 23
    post_separators: int = 3
    min_hashtags: int = 2


DEFAULTS = Params()
