"""The ordered fold over episodes: evidence expires, updates pass the gate, states read each other.

A data set is folded in one task: within an episode characters see what earlier ones of the same
data set became. Data sets are independent groups, each as large as its own cast and timeline.
Windows say all that reads one character only; this is for the rules that don't.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame

from dramaturg.operators.relations import FAMILY, ROLE_INVERSE, ROLE_PRIORITY, TIERS
from dramaturg.operators.state import GATES

# Words that don't tell one description from another.
STOP_WORDS = {
    "a", "an", "the", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "with", "as", "is", "are", "was", "were", "be", "been", "has", "have", "had", "his",
    "her", "their", "its", "this", "that", "these", "those", "from", "into", "about", "over", "under", "more", "most", "less", "than", "so", "such", "very", "often",
    "sometimes", "always", "never", "also", "still", "yet", "just", "only",
}
EXPIRY, RECENT_MEDIUM, KEPT_LENGTH, KEPT_WORDS, DECAY_AGE = 8, 20, 0.8, 0.5, 10
COUPLE = {r for roles in TIERS.values() for r in roles}

EVIDENCE = "dataset bigint, character bigint, ep int, event_id bigint, significance string, partner bigint, happening string"
PROPOSALS = (
    "dataset bigint, character bigint, ep int, proposal_id bigint, field string, resistance string, new_value string, merge_type string, cited array<bigint>"
)
LOG = "dataset bigint, character bigint, ep int, seq int, proposal_id bigint, field string, outcome string, version int, value string"


def words(text: str) -> set[str]:
    return set(re.findall(r"[a-z]{3,}", text.lower())) - STOP_WORDS


def recall(old: str, new: str) -> float:
    kept = words(old)
    return len(kept & words(new)) / len(kept) if kept and new else 1.0


def parsed(value: str) -> list[tuple[str, str]]:
    """``role is Name`` parts of a comma list; parts of another form have no name."""
    out = []
    for part in (p.strip() for p in re.split(r",(?![^()]*\))", value)):
        if part:
            m = re.match(r"(.+?)\s+(?:is|are)\s+([^(]+?)\s*(?:\(.*\))?$", part)
            out.append((m[1].lower(), m[2]) if m else (part, ""))
    return out


def written(entries: list[tuple[str, str]]) -> str:
    return ", ".join(f"{role} is {name}" if name else role for role, name in entries)


def former(role: str) -> bool:
    return role.startswith(("ex-", "former ", "late-"))


def romantic(role: str) -> bool:
    return not former(role) and (role in ROLE_INVERSE or any(role.startswith(r + " ") for r in ROLE_INVERSE))


def deduped(entries: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """One entry a name: the role of the highest priority, at the place of the first."""
    out: list[tuple[str, str]] = []
    at: dict[str, int] = {}
    for role, name in entries:
        if name and name in at:
            if ROLE_PRIORITY.get(role, 20) > ROLE_PRIORITY.get(out[at[name]][0], 20):
                out[at[name]] = (role, name)
            continue
        if name:
            at[name] = len(out)
        out.append((role, name))
    return out


class Timeline:
    """The states of one data set's characters while its episodes are folded.

    Evidence is looked up by pair and happening, or by id; time only goes forward, so what expires
    and what a character has seen lately are kept as queues. The fold takes time in proportion to
    the evidence and proposals.
    """

    def __init__(self, evidence: list[dict], cast: set):
        self.cast = {f"U{c}" for c in cast}
        self.evidence = {e["event_id"]: e | {"status": "active"} for e in evidence}
        ordered = sorted(self.evidence.values(), key=lambda e: (e["ep"], e["event_id"]))
        self.happened: dict = {}
        for e in ordered:
            self.happened.setdefault((frozenset((f"U{e['character']}", f"U{e['partner']}")), e["happening"]), []).append(e["ep"])
        medium = [e for e in ordered if e["significance"] == "medium"]
        self.to_come, self.to_expire, self.lately = deque(medium), deque(medium), {}
        self.persona: dict = {}
        self.version: dict = {}
        self.since: dict = {}

    def go_to(self, ep: int) -> None:
        """Medium evidence up to ``ep`` is seen, what is too old by then expires."""
        while self.to_come and self.to_come[0]["ep"] <= ep:
            e = self.to_come.popleft()
            self.lately.setdefault(e["character"], []).append(e)
        while self.to_expire and ep - self.to_expire[0]["ep"] > EXPIRY:
            e = self.to_expire.popleft()
            if e["status"] == "active":
                e["status"] = "expired"

    def citable(self, ids: list, character, ep: int, resistance: str) -> list:
        """Those of ``ids`` that are active evidence: all high, the latest medium. Harder fields may cite all high evidence of the past."""
        active = self.lately[character] = [e for e in self.lately.get(character, []) if e["status"] == "active"]
        medium = {e["event_id"] for e in active[-RECENT_MEDIUM:]}

        def may(i) -> bool:
            e = self.evidence.get(i)
            if e is None or e["character"] != character or e["ep"] > ep:
                return False
            return i in medium or (e["significance"] == "high" and (e["status"] == "active" or resistance != "low"))

        return [i for i in dict.fromkeys(ids) if may(i)]

    def told(self, a: str, b: str, happening: str, low: int, high: int) -> int | None:
        """The latest episode in a range in which evidence of either tells this of the two."""
        eps = self.happened.get((frozenset((a, b)), happening), [])
        at = bisect_right(eps, high)
        return eps[at - 1] if at and eps[at - 1] >= low else None

    def relationships(self, name: str) -> list[tuple[str, str]]:
        return parsed(self.persona.get((name, "relationships"), {}).get("value", ""))

    def guarded(self, me: str, old: list, new: list, ep: int) -> list[tuple[str, str]]:
        """The relationship guards, in their order: duplicates, dropped roles, uncorroborated, borrowed, unwarranted."""
        new = deduped(new)
        names = {n for _, n in new}
        for role, name in old:
            if name and name not in names and (role in FAMILY or role in COUPLE and self.told(me, name, "breakup", 0, ep) is None):
                new.append((role, name))
        before = {n: r for r, n in old}
        out = []
        for role, name in new:
            held = romantic(before.get(name, ""))
            if romantic(role) and name in self.cast and not held and self.told(me, name, "romance", ep - 2, ep + 2) is None:
                continue  # nothing tells of it
            if romantic(role) and not held and any(o != me and o != name and any(romantic(r) and n == name for r, n in self.relationships(o)) for o in self.cast):
                continue  # another's partner
            if former(role) and held and self.told(me, name, "breakup", ep - 2, ep + 2) is None:
                role = before[name]  # no breakup
            out.append((role, name))
        return out

    def decide(self, p: dict, ids: list) -> tuple[str, str | None]:
        """The first reason to reject a proposal that may cite ``ids`` and None, or ``accepted`` and the value to write."""
        character, ep, field, r = p["character"], p["ep"], p["field"], p["resistance"]
        me, now = f"U{character}", self.persona.get((f"U{character}", field))
        if not ids:
            return "no_evidence", None
        if r not in GATES:
            return "no_field", None
        cited = [self.evidence[i] for i in ids]
        high, medium = (sum(e["significance"] == s for e in cited) for s in ("high", "medium"))
        episodes, least_high, cooldown = GATES[r]
        enough = high >= 1 or medium >= 2 if r == "low" else len({e["ep"] for e in cited}) >= episodes and high >= least_high
        if not enough:
            return "threshold", None
        if now and now["at"] is not None and ep - now["at"] < cooldown:
            return "cooldown", None
        new, old = p["new_value"] or "", now["value"] if now else ""
        if not new.strip():
            return "empty", None
        if p["merge_type"] != "replacement" and old:
            if len(new) < KEPT_LENGTH * len(old):
                return "too_short", None
            if recall(old, new) < KEPT_WORDS:
                return "forgets", None
        if new.strip() == old.strip():
            return "no_change", None
        if field == "relationships":
            new = written(self.guarded(me, parsed(old), parsed(new), ep))
            if not new.strip() or new.strip() == old.strip():
                return "no_change", None
        return "accepted", new

    def write(self, name: str, field: str, value: str, ep: int, counted: bool = True) -> int:
        self.version[name] = self.version.get(name, 0) + 1
        kept = self.persona.get((name, field), {"count": 0, "at": None})
        self.persona[name, field] = {"value": value, "at": ep if counted else kept["at"], "count": kept["count"] + counted}
        if field == "relationships":
            now = {(n, romantic(r)) for r, n in parsed(value)}
            for key in [k for k in self.since if k[0] == name and (k[1], True) not in now]:
                del self.since[key]
            for n, is_romantic in now:
                if is_romantic:
                    self.since.setdefault((name, n), ep)
        return self.version[name]

    def auto_ex(self, name: str, ep: int) -> str | None:
        """Partners outside the cast with a breakup and no later or equal reconciliation become former ones."""
        old = self.relationships(name)
        new = []
        for role, partner in old:
            broke = self.told(name, partner, "breakup", 0, ep) if romantic(role) and partner not in self.cast else None
            over = broke is not None and broke > (self.told(name, partner, "reconciliation", 0, ep) or -1)
            new.append((f"ex-{role}", partner) if over else (role, partner))
        return written(new) if new != old else None

    def decay(self, name: str, ep: int) -> str | None:
        """Bonds inside the cast: listed as former by the other, or old and not returned."""
        old = self.relationships(name)
        new = []
        for role, partner in old:
            if romantic(role) and partner in self.cast:
                back = [r for r, n in self.relationships(partner) if n == name]
                unreturned = ep - self.since.get((name, partner), ep) >= DECAY_AGE and not any(map(romantic, back))
                if any(map(former, back)) or unreturned:
                    role = f"ex-{role}" if role in COUPLE else f"former {role}"
            new.append((role, partner))
        return written(new) if new != old else None


def folded(evidence: list[dict], proposals: list[dict]) -> list[tuple]:
    """The log of one data set: what became of each proposal, and what the passes rewrote."""
    line = Timeline(evidence, {r["character"] for r in [*evidence, *proposals]})
    at: dict = {}
    for p in sorted(proposals, key=lambda p: (p["ep"], p["character"], p["proposal_id"])):
        at.setdefault(p["ep"], []).append(p)
    log: list[tuple] = []
    names = sorted(line.cast, key=lambda n: (len(n), n))
    for ep in sorted({e["ep"] for e in evidence} | set(at)):
        line.go_to(ep)
        for p in at.get(ep, []):
            ids = line.citable(p["cited"], p["character"], ep, p["resistance"])
            outcome, value = line.decide(p, ids)
            version = None
            if value is not None:
                version = line.write(f"U{p['character']}", p["field"], value, ep)
                for i in ids:
                    line.evidence[i]["status"] = "consumed"
            log.append((p["character"], ep, len(log), p["proposal_id"], p["field"], outcome, version, value))
        for kind, rule in (("auto_ex", line.auto_ex), ("decay", line.decay)):
            changed = [(n, v) for n in names if (v := rule(n, ep)) is not None]
            for n, value in changed:
                log.append((int(n[1:]), ep, len(log), None, "relationships", kind, line.write(n, "relationships", value, ep, False), value))
    return log


def fold(evidence: DataFrame, proposals: DataFrame) -> DataFrame:
    """The log of all data sets (see ``EVIDENCE``, ``PROPOSALS`` and ``LOG`` for the columns).

    For each episode in order: medium evidence of more than eight episodes expires; proposals are
    decided and applied, character by character, and consume what they cite; broken bonds to
    others become former ones; then bonds inside the cast decay, all read before any is written.
    Rows without a data set, character or episode don't take part.
    """
    whole = "dataset is not null and character is not null and ep is not null"

    def run(key, told: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        facts, wishes = told.to_dict("records"), asked.to_dict("records")
        for p in wishes:
            p["cited"] = [int(i) for i in p["cited"]] if p["cited"] is not None else []
        rows = [(key[0], *r) for r in folded(facts, wishes)]
        out = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in LOG.split(",")])
        return out.astype({"proposal_id": "Int64", "version": "Int64"})

    left = evidence.filter(whole).groupBy("dataset")
    return left.cogroup(proposals.filter(whole).groupBy("dataset")).applyInPandas(run, LOG)
