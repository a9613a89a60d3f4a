"""What a summary says of two people, as Columns: breakup, reconciliation, engagement, marriage.

The names are the row's own. They are first put as marks in the lower-cased text (as Column
patterns, quoted), after which all patterns are constants that are compiled once. ``{x}`` and
``{y}`` in a pattern are the two in either order, ``{p}`` is one of them, a blank is white space.
Null or empty texts and names, and two equal names, are evidence of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of private use, in place of the first and the second name.
ONE, TWO = "\ue000", "\ue001"
_SENTENCE_ENDS = r"(?<=[.!?])\s+|;\s*"

# What sentences say in each case. Words of a bond and of its end.
_END = r"end(?:s|ed|ing)? (?:his|her|their|the) (?:relationship|romance|engagement|marriage)"
_OFF = r"call(?:ed|s)? (?:it (?:off|quits)|the relationship off)"
_DIVORCE = r"divorc(?:ed|es|ing)?"
_DUMP = r"dump(?:ed|s|ing)?"
_SPOUSE = r"(?:wife|husband|spouse)"
BREAKUP = [
    rf"{{x}} (?:broke up|broke it off|split up|{_OFF}|{_END}|{_DIVORCE}|{_DUMP}) (?:with )?{{y}}",
    rf"(?:broke up|broke it off|split up|splitting up|{_OFF}|{_END}|made the (?:difficult )?decision to end (?:his|her|their|the) (?:relationship|romance)) with {{p}}",
    rf"{{x}} and {{y}} (?:broke up|split up|{_DIVORCE}|are no longer (?:together|dating|a couple))\b",
    r"(?:their|the|her|his) (?:breakup|break-up|split) with {p}",
    r"{x} (?:walked out on|left) {y}",
    r"{x} experienc(?:e|ed|es|ing) (?:a|the) (?:\w+ )?(?:breakup|break-up) as {y}",
]
#: In one sentence with both: their bond ends, one of them goes, or one gives the other up.
BREAKUP_SENTENCE = [
    r"\bend of (?:their|the) (?:relationship|romance|engagement|marriage)\b", r"\bend(?:s|ed|ing)? (?:their|the) (?:relationship|romance|engagement|marriage)\b",
    r"\bdecide(?:s|d)? to (?:leave|move|take off|go)\b", r"\bis leaving for\b",
    r"(?:encourag(?:ing|ed|e|es)|forgav(?:e|ing)|forgiv(?:ing|en)|step(?:s|ped|ping)? aside for) (?:{w} ){{0,4}}to (?:pursue|be with|date) (?:{w} ){{0,2}}{p}",
]
#: Unless the bond is with somebody else, or the one goes to the other.
BREAKUP_DISCARD = [
    r"(?:breakup|break-up|split|relationship|romance) with (?!{p})[a-zà-ÿ]",
    r"\bto (?:be with|join|find|see|meet|reunite with) (?:[\w\s,]*?){p}",
]
RECONCILIATION = [
    r"{x} and {y} (?:get|got|are|have) (?:back together|reunit(?:ed|ing|e)|reconcil(?:ed|ing|e)|engaged|married|rekindl(?:ed|ing|e))\b",
    r"{x} (?:gets|got|getting) back together with {y}", r"{x} (?:reconcil(?:es|ed|ing)|reunit(?:es|ed|ing)|rekindl(?:es|ed|ing)) with {y}",
    r"{x} propos(?:es|ed|ing) to {y}", r"{x} marri(?:es|ed|ing) {y}", r"{x} and {y} (?:s ?)?wedding\b",
]
RECONCILIATION_SENTENCE = [
    r"\bgot back together\b", r"\bgetting back together\b", r"\bback together with\b", r"\breaffirm(?:s|ed|ing)? (?:his|her|their) commitment\b", r"\b(?:gets|getting|got) engaged\b",
    r"\bengagement\b", r"\bwedding day\b", r"\bgot married\b", r"\bmarried each other\b", r"\b(?:say|said|saying) (?:i do|their vows)\b", r"\bmove(?:s|d|ing)? in together\b", r"\btheir wedding\b",
]
ENGAGED = [
    r"{x} (?:and|&) {y} (?:got|are|are now|now are|have gotten|became) engaged\b", r"\bbecame? engaged to {p}", r"{x} pop(?:ped|s)? the question and {y} (?:said|say) yes\b",
    r"\b(?:his|her) engagement to {p}", r"\bengagement (?:of|between) {x} and {y}",
]
PROPOSED = [r"\bpropos(?:es?|ed|ing) to {p}", r"\bmarriage proposal from {p}", r"\bpropos(?:e|al) (?:to )?(?:him|her)\b"]
PROPOSAL_DISCARD = [
    r"\bnot ready\b", r"\bnot (?:really|actually|yet) engaged\b", r"\breject(?:ed|ing|s)?\b", r"\bturn(?:ed|s|ing)? down\b", r"\bdice roll\b", r"\bcontingent on\b",
    r"\bjok(?:e|ing|ed) about\b", r"\bpretend(?:ed|ing|s)? to\b", r"\bhypothetical(?:ly)?\b", r"\bfake (?:proposal|engagement)\b",
    r"\b(?:pressur(?:ed|ing|es)? (?:by {w} )?|force[ds]? |encourag(?:e|ed|ing) |told |plan(?:ning|s|ned)? |preparing |detailed plan |unable )to propos\w*\b",
    r"\b(?:think(?:ing|s)? about|consider(?:ing|s|ed)?) propos\w*\b", r"\b(?:did not|does not|doesn'?t|can'?t) propose\b",
]
ENGAGED_STATE = [
    r"\btheir engagement\b", r"\b(?:got|just got|finally got|have gotten) engaged\b", r"\b(?:are|are now|now are) engaged\b", r"\bbecame engaged\b", r"\bnewly engaged\b",
    r"\bannounce[ds]? (?:their|his|her) engagement to\b", r"\bsaid yes to (?:his|her|the) proposal\b", r"\baccept(?:s|ed|ing)? (?:his|her|the) proposal\b",
]
MARRIED = [
    r"{x} marri(?:es|ed|ing) {y}", r"{x} and {y} (?:got|are|are now|have) married\b", r"\bfirst dance as (?:a )?(?:newly )?married (?:couple|woman|man) with {p}",
    rf"\bbecom(?:es?|ing|e) {{p}}'s {_SPOUSE}\b", r"\b(?:his|her) marriage to {p}", r"\bmarried to {p}", rf"\b(?:his|her) {_SPOUSE} {{p}}",
]
MARRIED_SENTENCE = [r"\bmarri(?:es|ed|ing) (?:{p}|(?:him|her)\b)"]
MARRIED_DISCARD = [r"\b(?:did not|does not|doesn'?t|didn'?t) marry\b", r"\bplan(?:ning|ned|s)? to marry\b", r"\bpretend(?:ed|ing|s)? to\b"]
WEDDING = [
    r"\bhad (?:their|the) wedding ceremony\b", r"\b(?:their|the) wedding ceremony took place\b", r"\bfirst dance as (?:a )?(?:newly )?married (?:couple|woman|man)\b",
    rf"\bbecom(?:es?|ing|e) {{w}}(?:'s)? {_SPOUSE}\b", r"\bsaid (?:i do|their vows)\b", r"\bexchang(?:e|ed|ing) (?:their )?vows\b", r"\bjust married\b", r"\btied the knot\b",
]
WEDDING_DISCARD = [
    r"\bplan(?:ning|ned|s)? (?:their |the |a )?wedding\b", r"\bwedding (?:venue|date|location|invitations?|guest|caterer|cake|dress|toast|prep|preparations?)\b", r"\bmoved up\b",
    r"\b(?:fantasy|dream|upcoming) wedding\b", r"\bjok(?:e|ing|ed) about (?:a )?wedding\b", r"\bupcoming marriage\b", r"\b(?:before|prior to) (?:their|the) wedding\b", r"\bpretend(?:ed|ing|s)? to be (?:married|engaged)\b",
]
MARRIED_STATE = [
    r"\bgot married\b", r"\bare (?:now )?married\b", r"\bare now (?:husband and wife|a married couple)\b", r"\bmarried each other\b", r"\bnewly[\s-]wed\b", r"\bnewlyweds\b",
    r"\bnow (?:a married couple|husband and wife)\b", r"\bhoneymoon\b", r"\bnew marriage\b",
]
#: The narrow reading, which shields a bond from decay.
SETTLED = [r"\b(?:got married|married each other|(?:say|said|saying) (?:i do|their vows)|(?:their )?wedding day|move(?:s|d|ing)? in together)\b"]
#: Words that bind somebody to a partner, in a phrase "of them with the partner".
BOND = (
    r"(?:breakup|break-up|relationship|romance|date|dates|dating|kiss(?:es|ed|ing)?|engagement|fianc[ée]+|wedding|marriage|girlfriend|boyfriend|husband|wife|partner|"
    r"ex-(?:girlfriend|boyfriend|wife|husband|fianc[ée]+|partner))"
)
#: Said of the first about the second, who is the partner: the partner is the first one's.
OWNER = [
    r"{one}'s (?:{w} ){{0,4}}{two}", rf"{{one}} (?:{{w}} ){{{{0,4}}}}(?:through|after|before|despite|amid|over|about) (?:her|his|their|the) {BOND} (?:{{w}} ){{{{0,3}}}}with {{two}}",
    rf"{{one}}'s (?:{{w}} ){{{{0,3}}}}{BOND} (?:{{w}} ){{{{0,3}}}}with {{two}}", rf"{{one}} (?:{{w}} ){{{{0,5}}}}{BOND} (?:{{w}} ){{{{0,3}}}}with {{two}}", r"{one} and {two}", r"{two} and {one}",
]


def _pattern(patterns: list[str]) -> str:
    """One regular expression for all of them."""
    out = []
    for p in patterns:
        p = p.replace("{{", "\0").replace("}}", "\1")
        ways = [(ONE, TWO), (TWO, ONE)] if "{x}" in p else [(ONE, TWO)]
        for x, y in ways:
            q = p.replace("{x}", x).replace("{y}", y).replace("{one}", ONE).replace("{two}", TWO).replace("{p}", f"[{ONE}{TWO}]").replace("{w}", rf"[\w{ONE}{TWO}'-]+")
            out.append(q.replace("\0", "{").replace("\1", "}"))
    return "(?U)" + "|".join(f"(?:{q})" for q in out).replace(" ", r"\s+")


def first_name(name: Column) -> Column:
    return F.substring_index(F.trim(name), " ", 1)


def _quoted(name: Column) -> Column:
    """A pattern of the name as a word of its own, whatever signs are in it."""
    plain = F.replace(F.lower(F.trim(name)), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), plain, F.lit(r"\E(?![\p{L}\p{N}_])"))


def marked(text: Column, a: Column, b: Column) -> Column:
    """The lower-cased text with marks for the two names; null where there is nothing to look for."""
    known = (F.trim(a) != "") & (F.trim(b) != "") & (F.lower(F.trim(a)) != F.lower(F.trim(b)))
    # the longer name goes first, so that one that holds the other stays whole
    low = F.lower(text)
    put = lambda t, n, mark: F.regexp_replace(t, _quoted(n), F.lit(mark))
    both = F.when(F.length(F.trim(a)) >= F.length(F.trim(b)), put(put(low, a, ONE), b, TWO)).otherwise(put(put(low, b, TWO), a, ONE))
    return F.when(known, both)


def sentences(text: Column) -> Column:
    return F.split(text, _SENTENCE_ENDS)


def _both(text: Column) -> Column:
    return text.contains(ONE) & text.contains(TWO)


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike(_pattern(patterns))


def _sentence(text: Column, patterns: list[str], discard: list[str] | None = None) -> Column:
    """A sentence with both names that says one of the patterns and none of those to discard."""
    said = lambda s: _both(s) & _any(s, patterns) & (~_any(s, discard) if discard else F.lit(True))
    return F.exists(sentences(text), said)


def _told(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def has_breakup(text: Column, a: Column, b: Column) -> Column:
    """The two part: said of the pair anywhere, or in a sentence with both. ``a`` may be meant by a pronoun, ``b`` is named."""
    m = marked(text, a, b)
    return _told(m.contains(TWO) & (_any(m, BREAKUP) | _sentence(m, BREAKUP_SENTENCE, BREAKUP_DISCARD)))


def has_reconciliation(text: Column, a: Column, b: Column) -> Column:
    """The two come together (again), are engaged or married."""
    m = marked(text, a, b)
    return _told(m.contains(TWO) & (_any(m, RECONCILIATION) | _sentence(m, RECONCILIATION_SENTENCE)))


def has_engagement(text: Column, a: Column, b: Column) -> Column:
    """An engagement that is made: said of the pair, or a proposal that isn't only wished and a sentence with one of them in which it holds."""
    m = marked(text, first_name(a), first_name(b))
    holds = F.exists(sentences(m), lambda s: (s.contains(ONE) | s.contains(TWO)) & _any(s, ENGAGED_STATE))
    return _told(_both(m) & (_any(m, ENGAGED) | (_sentence(m, PROPOSED, PROPOSAL_DISCARD) & holds)))


def has_marriage(text: Column, a: Column, b: Column) -> Column:
    """A marriage that is made: said of the pair, in a sentence with both, or a wedding that isn't only planned and a state that follows from it."""
    m = marked(text, first_name(a), first_name(b))
    return _told(_both(m) & (_any(m, MARRIED) | _sentence(m, MARRIED_SENTENCE, MARRIED_DISCARD) | (_sentence(m, WEDDING, WEDDING_DISCARD) & _any(m, MARRIED_STATE))))


def has_settled(text: Column, a: Column, b: Column) -> Column:
    """The narrow reading of marriage: vows, a wedding day, a common home, in a sentence with both."""
    return _told(_sentence(marked(text, first_name(a), first_name(b)), SETTLED))


def owned_by(text: Column, other: Column, partner: Column) -> Column:
    """The text binds ``partner`` to ``other``: by a possessive, a bond with the partner, or as a pair."""
    m = marked(text, first_name(other), first_name(partner))
    return _told(_both(m) & _any(m, OWNER))


def names(text: Column, name: Column) -> Column:
    """The text has the name as a word, in upper or lower case."""
    return _told((F.trim(name) != "") & F.regexp_like(F.lower(text), _quoted(name)))
