"""Canonical vocabulary and the constants of the engine."""

from __future__ import annotations

#: The canonical node types.
NODE_TYPES = ("Person", "Organization", "Document", "Message", "Event", "Asset", "Topic")
#: The canonical relation types.
RELATION_TYPES = (
    "MEMBER_OF", "REPORTS_TO", "WORKS_ON", "OWNS", "AUTHORED", "SENT", "RECEIVED", "MENTIONS", "PART_OF", "PURCHASED", "ASSIGNED_TO", "TAGGED",
    "RELATED_TO", "SAME_AS",
)
#: Confidence of a fact, by rung.
RUNGS = {"human": 3, "exact": 2, "grounded": 1, "inferred": 0}
#: How a fact was extracted.
METHODS = ("direct_mapping", "llm_extraction", "rule_based", "human", "synthetic")
UNATTRIBUTED = "<unattributed>"
HUMAN_EDITS = "human_edits"
#: Attributes a preview is taken from, in order.
PREVIEW_KEYS = ("name", "title", "subject", "summary", "description", "customer_name")
HUB_DEGREE = 12
FANOUT = 25
SCAN_CAP = 400


def check_type(name: str, aliases: dict[str, str] | None = None) -> str:
    """The canonical node type of a name or alias; ValueError where there is none."""
    found = (aliases or {}).get(name, name)
    if found not in NODE_TYPES:
        raise ValueError(f"unknown node type {name!r}; known: {', '.join(NODE_TYPES)}")
    return found


def check_relation(name: str) -> str:
    if name not in RELATION_TYPES:
        raise ValueError(f"unknown relation type {name!r}; known: {', '.join(RELATION_TYPES)}")
    return name
