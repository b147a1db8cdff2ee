"""Decisions of routing models: what a model answers, read and checked, and a router to attach one.

A model is any callable from a query to its answer, so nothing here needs a network. Two forms of answer
are read: *scored* (`classifications.intent`, the best first, and entities with label and text) and
*plain* (an `intent` and spans by type), which counts as certain. Labels of entities that are not
known are left out, as newer models may have more; any other departure is a RuntimeError.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain

from factloom.operators.search import Result, Tier

#: What a query may intend.
INTENTS = ("lookup", "search", "analytical", "ambiguous")
#: Types of entities.
ENTITY_TYPES = ("emp_id", "customer_id", "ticket_id", "date", "department", "product")
#: Types whose spans are ids a lookup can ask for.
ID_TYPES = ("emp_id", "customer_id", "ticket_id", "product")


@dataclass(frozen=True)
class Decision:
    intent: str
    confidence: float
    entities: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        if self.intent not in INTENTS:
            raise ValueError(f"unknown intent {self.intent!r}")
        if not 0.0 <= self.confidence <= 1.0:
            raise ValueError(f"confidence {self.confidence} is not from 0 to 1")
        if odd := set(self.entities) - set(ENTITY_TYPES):
            raise ValueError(f"unknown entity types {sorted(odd)}")
        if not all(isinstance(s, str) and s for s in chain.from_iterable(self.entities.values())):
            raise ValueError("spans must be texts that are not empty")


def _need(value, kind: type, what: str):
    if not isinstance(value, kind):
        raise RuntimeError(f"a model's {what} must be a {kind.__name__}, not {type(value).__name__}")
    return value


def _decision(intent, confidence: float, pairs: list[tuple]) -> Decision:
    by: dict[str, list[str]] = {}
    for label, text in pairs:
        if label in ENTITY_TYPES and isinstance(text, str) and text:
            by.setdefault(label, []).append(text)
    try:
        return Decision(intent, confidence, by)
    except ValueError as e:
        raise RuntimeError(f"a model's answer is wrong: {e}") from e


def scored(answer) -> Decision:
    labels = _need(_need(_need(answer, dict, "answer").get("classifications"), dict, "classifications").get("intent"), list, "intents")
    if not labels:
        raise RuntimeError("a model's intents must not be empty")
    best = _need(labels[0], dict, "intent")
    if not {"label", "score"} <= set(best):
        raise RuntimeError("a model's intent must have label and score")
    if isinstance(best["score"], bool) or not isinstance(best["score"], (int, float)):
        raise RuntimeError("a model's score must be a number")
    found = answer.get("entities")
    items = [_need(e, dict, "entity") for e in _need([] if found is None else found, list, "entities")]
    return _decision(best["label"], float(best["score"]), [(e.get("label"), e.get("text")) for e in items])


def plain(answer) -> Decision:
    by = _need(_need(answer, dict, "answer").get("entities", {}), dict, "entities")
    known = [(k, _need(v, list, f"spans of {k}")) for k, v in by.items() if k in ENTITY_TYPES]
    return _decision(answer.get("intent"), 1.0, [(k, s) for k, v in known for s in v])


@dataclass(frozen=True)
class ModelRouter:
    """Asks one model, or one for the intent and another for the entities."""

    model: Callable[[str], dict]
    read: Callable[[dict], Decision] = scored
    entities: Callable[[str], dict] | None = None

    def classify(self, query: str) -> Decision:
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query must not be blank")
        out = self.read(self.model(query))
        if self.entities is None:
            return out
        return Decision(out.intent, out.confidence, plain({"intent": out.intent, "entities": self.entities(query)}).entities)


def router_tier(router: ModelRouter, exact: Tier, floor: float = 0.5) -> Tier:
    """A tier of the cascade: lookups go to `exact` with their ids, other intents to the tier for
    them. An intent less sure than `floor` is ambiguous."""

    def run(query: str) -> Result:
        d = router.classify(query)
        intent = d.intent if d.confidence >= floor else "ambiguous"
        said = {"intent": intent, "confidence": d.confidence, "entities": d.entities}
        ids = [s for t in ID_TYPES for s in d.entities.get(t, ())]
        if intent == "lookup" and ids:
            got = exact(" ".join(ids))
            return Result("router", got.relevance, got.hits, None if got.hits else "hybrid", extras=said)
        return Result("router", 0.0, [], "agentic" if intent == "analytical" else "hybrid", extras=said)

    return run
