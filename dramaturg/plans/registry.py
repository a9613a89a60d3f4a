"""All queries by name, and the SQL that they equal."""

from __future__ import annotations

from dramaturg.plans import audits, chinese, corrections, evaluation, evidence, pools, prompts, relations, reports, samples, streams, texts, timeline

FLAGSHIP = "next_utterance_samples"


def merged(which: str) -> dict:
    """The dictionaries of all modules as one; a name may be given once."""
    out: dict = {}
    for module in (samples, evaluation, timeline, texts, corrections, relations, prompts, reports, evidence, pools, chinese, audits, streams):
        own = getattr(module, which)
        if out.keys() & own.keys():
            raise ValueError(f"{module.__name__} repeats {sorted(out.keys() & own.keys())}")
        out |= own
    return out


QUERIES, SQL = merged("QUERIES"), merged("SQL")
