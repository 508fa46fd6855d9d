"""Terms of records, as TESTDATA.md defines them."""

from __future__ import annotations

from collections import Counter

EDGE_MARKS = ".,;:()\"'!?"  # fixed value: marks stripped from both ends of a piece


def edge_stripped_terms(text: str | None) -> list[str]:
    """Lower-cased white-space pieces without edge marks; empty pieces dropped."""
    if not text:
        return []
    return [t for p in text.lower().split() if (t := p.strip(EDGE_MARKS))]


def plain_terms(text: str | None) -> list[str]:
    """Lower-cased white-space pieces."""
    return text.lower().split() if text else []


def counts_from_map(entries) -> Counter:
    """Counts of a bag of words whose keys may still carry case and marks."""
    out: Counter = Counter()
    for key, n in entries or ():
        if key is not None and n is not None and n > 0:
            for term in edge_stripped_terms(key):
                out[term] += int(n)
    return out
