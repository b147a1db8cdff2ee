"""Answers of routing models in both forms, made by rule from the vocabulary: every intent with every
type of entity is read, and every way to break the form is refused."""

from itertools import product

import pytest

from factloom.operators import routers
from factloom.operators.search import Result


def answer(intent, score, *found):
    """An answer of the scored form; found: (label, text)."""
    return {"classifications": {"intent": [{"label": intent, "score": score}]}, "entities": [{"label": t, "text": x} for t, x in found]}


@pytest.mark.parametrize("intent,kind", list(product(routers.INTENTS, routers.ENTITY_TYPES)))
def test_every_intent_with_every_type(intent, kind):
    spans = [f"{kind} {k}" for k in range(3)]
    one = routers.scored(answer(intent, 0.25, *((kind, s) for s in spans), ("a type of tomorrow", "ignored")))
    two = routers.plain({"intent": intent, "entities": {kind: spans, "a type of tomorrow": ["ignored"]}})
    assert (one.intent, one.confidence, one.entities) == (intent, 0.25, {kind: spans})
    assert (two.intent, two.confidence, two.entities) == (intent, 1.0, {kind: spans})


@pytest.mark.parametrize("span", [None, 0, 1.5, [], {}, ""])
def test_spans_that_are_no_text_are_left_out(span):
    assert routers.scored(answer("search", 0.5, ("date", span))).entities == {}
    assert routers.plain({"intent": "search", "entities": {"date": [span]}}).entities == {}


def broken():
    """Answers with one part missing or of another kind, by path."""
    for path in (("classifications",), ("classifications", "intent"), ("classifications", "intent", 0), ("classifications", "intent", 0, "label"), ("classifications", "intent", 0, "score")):
        for part in (None, "text", 7.5):
            whole = answer("search", 0.5)
            at = whole
            for step in path[:-1]:
                at = at[step]
            at[path[-1]] = part
            yield whole
    yield from (None, [], "text", answer("search", 0.5) | {"entities": "text"}, answer("search", 0.5) | {"entities": [1]})
    yield {"classifications": {"intent": []}}


@pytest.mark.parametrize("bad", list(broken()))
def test_broken_answers_are_refused(bad):
    with pytest.raises(RuntimeError):
        routers.scored(bad)


@pytest.mark.parametrize("bad", [None, [], "text", {}, {"intent": "text"}, {"intent": "search", "entities": 1}, {"intent": "search", "entities": {"date": 1}}])
def test_broken_plain_answers_are_refused(bad):
    with pytest.raises(RuntimeError):
        routers.plain(bad)


def test_a_router_finds_entities_with_a_second_model():
    router = routers.ModelRouter(lambda q: {"intent": "search"}, routers.plain, lambda q: {"product": q.split()})
    assert router.classify("left right").entities == {"product": ["left", "right"]}
    for blank in ("", " \t"):
        with pytest.raises(ValueError):
            router.classify(blank)


@pytest.mark.parametrize("floor,sure", [(0.2, True), (0.3, True), (0.4, False)])
def test_a_tier_asks_for_ids_where_the_model_is_sure(floor, sure):
    asked = []

    def exact(query):
        asked.append(query)
        return Result("exact", 0.75, [(query, 0.75)])

    tier = routers.router_tier(routers.ModelRouter(lambda q: answer("lookup", 0.3, ("product", "left"))), exact, floor=floor)
    got = tier("what is left")
    assert asked == (["left"] if sure else []) and (got.hits != []) == sure
    if not sure:
        assert got.extras["intent"] == "ambiguous" and got.route_to == "hybrid"
