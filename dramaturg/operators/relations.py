"""Relationships over narrative time as rows ``dataset, owner, ep, partner, role``: predicates and corrections.

A row says that in episode ``ep`` the owner's state lists the partner in a role. All joins are on
the data set and the two characters; corrections return the rows that then hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How specific and permanent a role is (the higher wins), any other role counts 20.
ROLE_PRIORITY = {
    "spouse": 100, "wife": 100, "husband": 100, "mother": 95, "father": 95, "fiancé": 90, "fiancee": 90, "fiance": 90, "son": 90, "daughter": 90,
    "twin sister": 88, "twin brother": 88, "brother": 85, "sister": 85, "grandmother": 82, "grandfather": 82, "boyfriend": 80, "girlfriend": 80, "partner": 75,
    "ex-spouse": 70, "ex-wife": 70, "ex-husband": 70, "ex-fiancé": 65, "ex-fiancee": 65, "ex-fiance": 65, "dating": 60, "dated": 55, "ex-boyfriend": 50,
    "ex-girlfriend": 50, "ex-partner": 45, "best friend": 40, "close friend": 35, "friend": 30,
}
# The role that the other side of a bond has.
ROLE_INVERSE = {
    "boyfriend": "girlfriend", "girlfriend": "boyfriend", "partner": "partner", "lover": "lover", "love interest": "love interest",
    "romantic interest": "romantic interest", "dating": "dating", "date": "date", "husband": "wife", "wife": "husband", "spouse": "spouse",
    "fiancé": "fiancée", "fiancée": "fiancé", "fiance": "fiancee", "fiancee": "fiance", "wife-to-be": "husband-to-be", "husband-to-be": "wife-to-be",
    "secret romantic encounter": "secret romantic encounter", "one-time encounter": "one-time encounter",
    "friend with romantic tension": "friend with romantic tension", "on-off girlfriend": "on-off boyfriend", "on-off boyfriend": "on-off girlfriend",
    "secret girlfriend": "secret boyfriend", "secret boyfriend": "secret girlfriend", "crush": "crush",
}
# Couple roles by tier.
TIERS = {1: ["boyfriend", "girlfriend", "partner", "dating"], 2: ["fiancé", "fiancée", "fiance", "fiancee"], 3: ["wife", "husband", "spouse"]}
FAMILY = ["mother", "father", "son", "daughter", "brother", "sister", "twin brother", "twin sister", "grandmother", "grandfather"]
# Roles that fade without evidence, those of them that need no return, those that fade to "former", and roles that never fade.
TRANSIENT = [
    "boyfriend", "girlfriend", "partner", "lover", "romantic interest", "date", "dating", "love interest", "secret romantic encounter", "secret girlfriend", "secret boyfriend", "one-time encounter",
    "former one-time encounter", "on-off girlfriend", "on-off boyfriend", "friend with romantic tension", "ex-romantic interest", "crush", "affair", "fling", "hookup", "seeing", "romantic partner",
]
ONE_SIDED = [
    "friend with romantic tension", "secret romantic encounter", "secret girlfriend", "secret boyfriend", "one-time encounter", "former one-time encounter", "crush", "affair", "fling", "hookup",
]
FADES_TO_FORMER = ["secret romantic encounter", "one-time encounter", "friend with romantic tension"]
PROTECTED = ["husband", "wife", "spouse", "fiancé", "fiance", "fiancée", "fiancee", "wife-to-be", "husband-to-be", "co-parent", "baby's father", "baby's mother"]
DOWNGRADED = ["girlfriend", "boyfriend", "partner", "fiancé", "fiancee", "fiance", "wife", "husband", "lover", "spouse"]
KEY = ["dataset", "owner", "ep", "partner"]


def role_priority(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLE_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(role))), F.lit(20))


def is_former(role: Column) -> Column:
    return F.lower(F.trim(role)).rlike("^(ex-|former |late-)")


def is_current_romantic(role: Column) -> Column:
    """One of the romantic roles, alone or with words after it, and not a former one."""
    names = "|".join(sorted(ROLE_INVERSE, key=len, reverse=True))
    return ~is_former(role) & F.lower(F.trim(role)).rlike(f"^({names})( |$)")


def couple_tier(role: Column) -> Column:
    """1 dating, 2 engaged, 3 married; 0 for anything else."""
    out = F.lit(0)
    for tier, roles in TIERS.items():
        out = F.when(F.lower(F.trim(role)).isin(roles), tier).otherwise(out)
    return out


def same_first_name(a: Column, b: Column) -> Column:
    first = lambda c: F.lower(F.substring_index(F.trim(c), " ", 1))
    return first(a) == first(b)


def is_bare_name(entry: Column) -> Column:
    """A capitalised name of one to three words and nothing else."""
    return F.trim(entry).rlike(r"^[A-Z][A-Za-zÀ-ÿ'-]*( [A-Z][A-Za-zÀ-ÿ'-]*){0,2}$")


def swapped(claims: DataFrame, *more: Column) -> DataFrame:
    """The claims seen from the other side: owner and partner change places."""
    return claims.select("dataset", "ep", F.col("partner").alias("owner"), F.col("owner").alias("partner"), *more)


def pointing_back(claims: DataFrame) -> DataFrame:
    """``claims`` with ``back_current`` and ``back_former``: how the partner lists the owner in the same episode."""
    back = swapped(claims, is_current_romantic(F.col("role")).alias("c"), is_former(F.col("role")).alias("f"))
    back = back.groupBy(*KEY).agg(F.max("c").alias("back_current"), F.max("f").alias("back_former"))
    return claims.join(back, KEY, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("back_current", "back_former")})


def most_specific(entries: DataFrame, by: list[str], place: str) -> DataFrame:
    """One entry a name: the role of the highest priority, the earlier place among equals."""
    order = Window.partitionBy(*by).orderBy(role_priority(F.col("role")).desc(), place, "role")
    return entries.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def prefer_former(entries: DataFrame, by: list[str], place: str) -> DataFrame:
    """One entry a name: a former role if there is one, else the earlier place."""
    order = Window.partitionBy(*by).orderBy(is_former(F.col("role")).desc(), place, "role")
    return entries.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def _latest(claims: DataFrame, events: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """The latest episode up to each claim's own with an event of each kind between owner and partner.

    Claims and events of a pair go through one window, so nothing is joined by range.
    """
    pair = ["dataset", F.least("owner", "partner").alias("_a"), F.greatest("owner", "partner").alias("_b")]
    told = events.select(*pair, "ep", F.lit(0).alias("_claim"), *[F.when(test, F.col("ep")).alias(f"last_{k}") for k, test in kinds.items()])
    asked = claims.select("*", *pair[1:], F.lit(1).alias("_claim"))
    w = Window.partitionBy("dataset", "_a", "_b").orderBy("ep", "_claim").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(told, allowMissingColumns=True)
    seen = both.withColumns({f"last_{k}": F.max(f"last_{k}").over(w) for k in kinds})
    return seen.filter("_claim = 1").select(*claims.columns, *[f"last_{k}" for k in kinds])


def auto_downgraded(claims: DataFrame, events: DataFrame, breakup: Column, reconciled: Column, cast: DataFrame | None = None) -> DataFrame:
    """Current couple claims become ``ex-`` where the pair's latest breakup has no later or equal reconciliation.

    Partners of the ``cast`` (``dataset, name``) are left to the rules between main characters.
    """
    found = _latest(claims, events, {"breakup": breakup, "reconciled": reconciled})
    over = F.lower(F.trim("role")).isin(DOWNGRADED) & (F.col("last_breakup") > F.coalesce("last_reconciled", F.lit(-1)))
    if cast is not None:
        found = found.join(cast.select("dataset", F.col("name").alias("partner"), F.lit(True).alias("_main")), ["dataset", "partner"], "left")
        over = over & F.col("_main").isNull()
    changed = F.coalesce(over, F.lit(False))
    return found.select(*KEY, F.when(changed, F.concat(F.lit("ex-"), "role")).otherwise(F.col("role")).alias("role"), changed.alias("downgraded"))


def placed(claims: DataFrame) -> DataFrame:
    """``dataset, owner, ep, at``: the place of each episode among those in which the owner has a state.

    Ordinals jump from season to season; what is next to each other is told by these places.
    """
    states = claims.select("dataset", "owner", "ep").distinct()
    return states.withColumn("at", F.row_number().over(Window.partitionBy("dataset", "owner").orderBy("ep")).cast("bigint"))


def _as_partner_saw(claims: DataFrame) -> DataFrame:
    """``claims`` with ``back_current`` and ``back_former`` by the partner's latest state up to the episode (false if there is none)."""
    asked = claims.select("dataset", F.col("partner").alias("_c"), "ep").distinct().withColumn("_state", F.lit(None).cast(claims.schema["ep"].dataType))
    states = claims.select("dataset", F.col("owner").alias("_c"), "ep").distinct().withColumn("_state", F.col("ep"))
    w = Window.partitionBy("dataset", "_c").orderBy("ep").rangeBetween(Window.unboundedPreceding, 0)
    known = asked.unionByName(states).withColumn("_last", F.max("_state").over(w)).filter(F.col("_state").isNull()).drop("_state")
    back = claims.groupBy(*KEY).agg(F.max(is_current_romantic(F.col("role")) | F.lower("role").isin(PROTECTED)).alias("back_current"), F.max(is_former(F.col("role"))).alias("back_former"))
    back = back.select("dataset", F.col("owner").alias("_c"), F.col("ep").alias("_last"), F.col("partner").alias("owner"), "back_current", "back_former")
    dated = claims.withColumn("_c", F.col("partner")).join(known, ["dataset", "_c", "ep"]).join(back, ["dataset", "_c", "_last", "owner"], "left")
    return dated.drop("_c", "_last").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("back_current", "back_former")})


def decayed(claims: DataFrame, cast: DataFrame, mentions: DataFrame, settled: DataFrame, age: int = 10, silent: int = 6) -> DataFrame:
    """Decay pass: claims rewritten to ``ex-`` or ``former `` with the ``rule`` that did it (null: none).

    Only roles that fade are touched, not those of spouses and the engaged, and none that the owner
    lists as a couple role in both neighbouring states. A partner of the ``cast`` (``dataset,
    name``), unless the role is one-sided, is asked: ``listed_as_ex`` where their latest state says
    so, ``not_returned`` where the role is at least ``age`` old and isn't returned. Others are
    ``forgotten`` if the owner's archive last named them more than ``silent`` ago (``mentions``:
    ``dataset, owner, partner, ep``; never named is no silence). Evidence of a marriage up to then
    (``settled``, the same columns) shields. Encounters become ``former ``, all else ``ex-``.
    """
    role = F.lower(F.trim("role"))
    fades = F.coalesce(~role.rlike("^(ex-|late-|former[ -])"), F.lit(False)) & ~role.rlike("^(" + "|".join(PROTECTED) + ")( |$)") & role.rlike("^(" + "|".join(TRANSIENT) + ")")
    since = Window.partitionBy("dataset", "owner", "partner", "role").orderBy("ep").rowsBetween(Window.unboundedPreceding, 0)
    rows = _as_partner_saw(claims).withColumn("_age", F.col("ep") - F.min("ep").over(since))
    rows = rows.join(cast.select("dataset", F.col("name").alias("partner"), F.lit(True).alias("_main")), ["dataset", "partner"], "left")
    # places of the owner's states with a couple role for the partner, before and after
    states = placed(claims)
    couple = claims.filter((couple_tier(F.col("role")) > 0)).select(*KEY).distinct().join(states, ["dataset", "owner", "ep"]).drop("ep")
    for side, step in (("_before", 1), ("_after", -1)):
        beside = couple.select("dataset", "owner", "partner", (F.col("at") + step).alias("at"), F.lit(True).alias(side))
        states_beside = states.join(beside, ["dataset", "owner", "at"]).drop("at")
        rows = rows.join(states_beside, KEY, "left")
    told = mentions.select("dataset", "owner", "partner", "ep", F.lit("seen").alias("_k")).unionByName(settled.select("dataset", "owner", "partner", "ep", F.lit("settled").alias("_k")))
    w = Window.partitionBy("dataset", "owner", "partner").orderBy("ep").rangeBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(told, allowMissingColumns=True)
    for kind in ("seen", "settled"):
        both = both.withColumn(f"_last_{kind}", F.max(F.when(F.col("_k") == kind, F.col("ep"))).over(w))
    main = F.col("_main").isNotNull() & (F.col("partner") != F.col("owner")) & ~role.isin(ONE_SIDED)
    rule = (
        F.when(~fades | (F.col("_before").isNotNull() & F.col("_after").isNotNull()) | F.col("_last_settled").isNotNull(), None)
        .when(main & F.col("back_former"), "listed_as_ex")
        .when(main & (F.col("_age") >= age) & ~F.col("back_current"), "not_returned")
        .when(~main & (F.col("ep") - F.col("_last_seen") > silent), "forgotten")
    )
    facts = both.filter(F.col("_k").isNull()).withColumn("rule", rule)
    prefix = F.when(role.isin(FADES_TO_FORMER), "former ").otherwise("ex-")
    return facts.select(*KEY, F.when(F.col("rule").isNotNull(), F.concat(prefix, "role")).otherwise(F.col("role")).alias("role"), "rule")


def _with_previous(claims: DataFrame) -> DataFrame:
    """``claims`` with ``old_role``: the role in the pair's previous row, null in its first."""
    return claims.withColumn("old_role", F.lag("role").over(Window.partitionBy("dataset", "owner", "partner").orderBy("ep")))


def unwarranted_ex(claims: DataFrame, events: DataFrame, breakup: Column, band: int = 2) -> DataFrame:
    """A romantic role that turns to a former one needs a breakup of the pair within ``band`` episodes; else it's taken back."""
    turned = _with_previous(claims).withColumn("_turned", is_former(F.col("role")) & F.coalesce(is_current_romantic(F.col("old_role")), F.lit(False)))
    told = events.filter(breakup).select("dataset", F.least("owner", "partner").alias("_a"), F.greatest("owner", "partner").alias("_b"), F.col("ep").alias("_at"))
    # each breakup is dealt to the episodes that it can warrant, so the join is on equality
    near = told.select("dataset", "_a", "_b", F.explode(F.sequence(F.col("_at") - band, F.col("_at") + band)).alias("ep")).distinct()
    asked = turned.withColumns({"_a": F.least("owner", "partner"), "_b": F.greatest("owner", "partner")})
    found = asked.join(near.withColumn("_warranted", F.lit(True)), ["dataset", "_a", "_b", "ep"], "left")
    strip = F.col("_turned") & F.col("_warranted").isNull()
    return found.select(*KEY, F.when(strip, F.col("old_role")).otherwise(F.col("role")).alias("role"), strip.alias("stripped"))


def borrowed(claims: DataFrame) -> DataFrame:
    """New romantic claims on a partner who isn't the owner's but another owner's: ``dataset, owner, ep, partner, lender``.

    A claim is new if the pair's previous row wasn't romantic. The lender held the partner in the
    episode before; of several the smallest is named.
    """
    own = _with_previous(claims)
    new = own.filter(is_current_romantic(F.col("role")) & ~F.coalesce(is_current_romantic(F.col("old_role")), F.lit(False)))
    held = claims.filter(is_current_romantic(F.col("role"))).select("dataset", "partner", (F.col("ep") + 1).alias("ep"), F.col("owner").alias("lender")).distinct()
    found = new.join(held, ["dataset", "partner", "ep"]).filter("lender <> owner")
    return found.groupBy(*KEY).agg(F.min("lender").alias("lender"))


def corroborated(claims: DataFrame, events: DataFrame, romantic: Column, band: int = 2) -> DataFrame:
    """Romantic claims need a romantic event of the pair within ``band`` episodes, unless held before; others go."""
    told = events.filter(romantic).select("dataset", F.least("owner", "partner").alias("_a"), F.greatest("owner", "partner").alias("_b"), F.col("ep").alias("_at"))
    near = told.select("dataset", "_a", "_b", F.explode(F.sequence(F.col("_at") - band, F.col("_at") + band)).alias("ep")).distinct()
    asked = _with_previous(claims).withColumns({"_a": F.least("owner", "partner"), "_b": F.greatest("owner", "partner")})
    found = asked.join(near.withColumn("_told", F.lit(True)), ["dataset", "_a", "_b", "ep"], "left")
    held = F.coalesce(is_current_romantic(F.col("old_role")), F.lit(False))
    return found.filter(~is_current_romantic(F.col("role")) | held | F.col("_told").isNotNull()).select(*KEY, "role")


def demoted(role: Column, tier: Column) -> Column:
    """The role brought down to a tier: married to engaged to dating; to ``close friend`` at 0."""
    now = couple_tier(role)
    lower = F.when(tier == 2, F.when(role == "wife", "fiancée").when(role == "husband", "fiancé").otherwise("fiancé"))
    lower = F.when(tier == 1, F.when(role.isin("wife", "fiancée", "fiancee"), "girlfriend").when(role.isin("husband", "fiancé", "fiance"), "boyfriend").otherwise("partner")).otherwise(lower)
    return F.when((now == 0) | (now <= tier), role).when(tier <= 0, "close friend").otherwise(lower)


def evidenced_tiers(claims: DataFrame, events: DataFrame, engaged: Column, married: Column) -> DataFrame:
    """Claims of a tier above what the pair's events up to then show are brought down to it.

    Dating needs no evidence; then tiers are aligned: of two sides in one episode the lower holds.
    """
    found = _latest(claims, events, {"engaged": engaged, "married": married})
    shown = F.when(F.col("last_married").isNotNull(), 3).when(F.col("last_engaged").isNotNull(), 2).otherwise(1)
    role = F.when(couple_tier(F.col("role")) > shown, demoted(F.col("role"), shown)).otherwise(F.col("role"))
    first = found.select(*KEY, role.alias("role")).withColumn("_t", couple_tier(F.col("role")))
    back = swapped(first, F.col("_t").alias("_back")).filter("_back > 0").groupBy(*KEY).agg(F.min("_back").alias("_back"))
    both = first.join(back, KEY, "left")
    lower = (F.col("_t") > 0) & (F.col("_back") < F.col("_t"))
    return both.select(*KEY, F.when(lower, demoted(F.col("role"), F.col("_back"))).otherwise(F.col("role")).alias("role"))


def stays(claims: DataFrame) -> DataFrame:
    """Runs of an owner's consecutive states that list a partner in one romantic role: ``dataset, owner, partner, role,
    start, stop, length, returned``; start and stop are places among the owner's states (see :func:`placed`)."""
    romantic = pointing_back(claims).filter(is_current_romantic(F.col("role"))).groupBy(*KEY, F.lower(F.trim("role")).alias("role")).agg(F.max("back_current").alias("returned"))
    run = ["dataset", "owner", "partner", "role"]
    at = romantic.join(placed(claims), ["dataset", "owner", "ep"])
    island = F.col("at") - F.row_number().over(Window.partitionBy(*run).orderBy("at"))
    return at.withColumn("_i", island).groupBy(*run, "_i").agg(
        F.min("at").alias("start"), F.max("at").alias("stop"), F.count(F.lit(1)).alias("length"), F.max("returned").alias("returned")
    ).drop("_i")


def _episodes(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """A row for each episode of a run, by the owner's own states."""
    return runs.withColumn("at", F.explode(F.sequence("start", "stop"))).join(placed(claims), ["dataset", "owner", "at"])


def short_stays(claims: DataFrame, longest: int = 3, window: int = 2) -> DataFrame:
    """Unreturned runs of at most ``longest`` states that correct themselves.

    In one of the owner's next ``window`` states the partner isn't listed in that role; a run that
    ends with the owner's last state counts as corrected.
    """
    runs = stays(claims).filter((F.col("length") <= longest) & ~F.col("returned")).drop("length", "returned")
    after = runs.withColumn("at", F.explode(F.sequence(F.col("stop") + 1, F.col("stop") + window))).join(placed(claims), ["dataset", "owner", "at"])
    listed = claims.select(*KEY, F.lower(F.trim("role")).alias("role"), F.lit(True).alias("_listed")).distinct()
    after = after.join(listed, [*KEY, "role"], "left")
    run = ["dataset", "owner", "partner", "role", "start", "stop"]
    held = after.groupBy(*run).agg(F.min(F.col("_listed").isNotNull()).alias("_held"))
    return runs.join(held, run, "left").filter(~F.coalesce("_held", F.lit(False))).select(*run)


def without_short_stays(claims: DataFrame, **how) -> DataFrame:
    """Claims of short stays become ``friend``."""
    demote = _episodes(short_stays(claims, **how), claims).select(*KEY, F.col("role").alias("_role")).distinct().withColumn("_demote", F.lit(True))
    out = claims.withColumn("_role", F.lower(F.trim("role"))).join(demote, [*KEY, "_role"], "left")
    return out.select(*KEY, F.when(F.col("_demote"), "friend").otherwise(F.col("role")).alias("role"))


def propagated(claims: DataFrame, least: int = 2) -> DataFrame:
    """Claims with those added that the other side of a run lacks.

    For each episode of a romantic run of at least ``least`` states the partner, if a state is there
    and lists the owner neither romantically nor as a former one, gets the inverse role; the
    partner's plain ``friend`` entry of the owner goes.
    """
    inverse = F.create_map(*[F.lit(x) for pair in ROLE_INVERSE.items() for x in pair])
    wanted = _episodes(stays(claims).filter(F.col("length") >= least), claims)
    wanted = wanted.select("dataset", "ep", F.col("partner").alias("owner"), F.col("owner").alias("partner"), F.try_element_at(inverse, F.col("role")).alias("role")).filter("role is not null")
    wanted = wanted.groupBy(*KEY).agg(F.max("role").alias("role"))
    states = claims.select("dataset", "owner", "ep").distinct()
    has = claims.filter(is_current_romantic(F.col("role")) | is_former(F.col("role"))).select(*KEY).distinct()
    added = wanted.join(states, ["dataset", "owner", "ep"], "left_semi").join(has, KEY, "left_anti").select(*KEY, "role")
    plain = F.col("role") == "friend"
    kept = claims.filter(~plain).unionByName(claims.filter(plain).join(added, KEY, "left_anti"))
    return kept.select(*KEY, "role").withColumn("added", F.lit(False)).unionByName(added.withColumn("added", F.lit(True)))


def restored(claims: DataFrame, ended: DataFrame) -> DataFrame:
    """Roles that the next state of the owner dropped are put back: family always, marital and couple ones unless ended.

    ``ended`` has ``dataset, owner, ep, partner`` of bonds that broke up to then. The next state is
    the owner's next episode with any claim.
    """
    states = claims.select("dataset", "owner", "ep").distinct()
    following = states.withColumn("_next", F.lead("ep").over(Window.partitionBy("dataset", "owner").orderBy("ep"))).filter("_next is not null")
    core = claims.filter(F.lower("role").isin(FAMILY) | (couple_tier(F.col("role")) > 0))
    expected = core.join(following, ["dataset", "owner", "ep"]).select("dataset", "owner", F.col("_next").alias("ep"), "partner", "role")
    missing = expected.join(claims.select(*KEY).distinct(), KEY, "left_anti")
    broke = ended.groupBy("dataset", "owner", "partner").agg(F.min("ep").alias("_broke"))
    missing = missing.join(broke, ["dataset", "owner", "partner"], "left").filter(F.lower("role").isin(FAMILY) | F.col("_broke").isNull() | (F.col("_broke") > F.col("ep")))
    return claims.select(*KEY, "role").withColumn("restored", F.lit(False)).unionByName(missing.select(*KEY, "role").withColumn("restored", F.lit(True)))


def gaps(claims: DataFrame, longest: int = 8, ahead: int = 3, broken: DataFrame | None = None) -> DataFrame:
    """Gaps in a bond that goes on: ``dataset, owner, partner, role, back_role, start, stop`` by places of the owner's states.

    A gap is at most ``longest`` of the owner's states in which neither side lists the other in a
    couple role. Before it the owner does, and the partner too if they have states of their own.
    Within ``ahead`` states from its end both (or the owner, of an outsider) list such a role of no
    lower tier again. ``broken`` (``dataset, a, b, ep``, the pair in order) are breakups: one after
    the state before the gap, up to the one after it, forbids filling.
    """
    couple = claims.withColumn("_t", couple_tier(F.col("role"))).filter("_t > 0").groupBy(*KEY).agg(F.min(F.struct(F.lower("role").alias("role"), F.col("_t").alias("tier"))).alias("own"))
    mains = claims.select("dataset", F.col("owner").alias("partner")).distinct().withColumn("_main", F.lit(True))
    back = swapped(couple, F.col("own").alias("back"))
    both = couple.join(back, KEY, "full").join(placed(claims), ["dataset", "owner", "ep"]).join(mains, ["dataset", "partner"], "left")
    w = Window.partitionBy("dataset", "owner", "partner").orderBy("at")
    main = F.col("_main").isNotNull()
    later = both.withColumns({f"_l{i}": F.lead(F.struct("at", "ep", "own", "back"), i).over(w) for i in range(1, ahead + 1)})
    first = F.col("_l1")
    found = later.filter(F.col("own").isNotNull() & (~main | F.col("back").isNotNull()) & (first["at"] - F.col("at")).between(2, longest + 1))

    def resumed(c: Column) -> Column:
        again = (c["at"] < first["at"] + ahead) & (c["own"]["tier"] >= F.col("own.tier"))
        return F.coalesce(again & (~main | (c["back"]["tier"] >= F.col("back.tier"))), F.lit(False))

    any_of = resumed(first)
    for i in range(2, ahead + 1):
        any_of = any_of | resumed(F.col(f"_l{i}"))
    found = found.filter(any_of)
    if broken is not None:
        pair = found.withColumns({"a": F.least("owner", "partner"), "b": F.greatest("owner", "partner"), "_from": F.col("ep"), "_to": first["ep"]})
        told = broken.groupBy("dataset", "a", "b").agg(F.sort_array(F.collect_set("ep")).alias("_eps"))
        pair = pair.join(told, ["dataset", "a", "b"], "left")
        found = pair.filter(~F.coalesce(F.exists("_eps", lambda e: (e > F.col("_from")) & (e <= F.col("_to"))), F.lit(False)))
    return found.select("dataset", "owner", "partner", F.col("own.role").alias("role"), F.when(main, F.col("back.role")).alias("back_role"), (F.col("at") + 1).alias("start"), (first["at"] - 1).alias("stop"))


def gap_filled(claims: DataFrame, longest: int = 8, ahead: int = 3, broken: DataFrame | None = None) -> DataFrame:
    """Claims with the roles of :func:`gaps` written into their episodes, on both sides where the other has a state.

    What else a side lists of the other there gives way. Where both sides' gaps name an episode, the
    one of the owner whose name comes first holds.
    """
    inside = _episodes(gaps(claims, longest, ahead, broken), claims)
    first = F.col("owner") < F.col("partner")
    own = inside.select(*KEY, "role", F.when(first, 1).otherwise(0).alias("_own"))
    other = inside.filter("back_role is not null").select("dataset", "ep", F.col("partner").alias("owner"), F.col("owner").alias("partner"), F.col("back_role").alias("role"), F.when(first, 1).otherwise(0).alias("_own"))
    states = claims.select("dataset", "owner", "ep").distinct()
    added = own.unionByName(other).join(states, ["dataset", "owner", "ep"], "left_semi").groupBy(*KEY).agg(F.max(F.struct("_own", "role"))["role"].alias("role"))
    same = claims.select(*KEY, F.lower("role").alias("role"))
    added = added.join(same, [*KEY, "role"], "left_anti")
    kept = claims.select(*KEY, "role").join(added, KEY, "left_anti")
    return kept.withColumn("filled", F.lit(False)).unionByName(added.select(*KEY, "role").withColumn("filled", F.lit(True)))


def normalised_entry(entry: Column) -> Column:
    """An entry of an old profile as singular ``role is Name`` texts: an array.

    ``friends are A and B`` becomes one for each; a bare name is a friend; ``engaged to X`` is a fiancé.
    """
    plural = r"^(friend|sister|brother|colleague|son|daughter|parent|neighbor|roommate)s\s+are\s+(.+)$"
    names = F.filter(F.split(F.regexp_extract(entry, plural, 2), r"\s*(?:,|&|\band\b)\s*"), lambda n: n != "")
    several = F.transform(names, lambda n: F.concat(F.regexp_extract(entry, plural, 1), F.lit(" is "), n))
    engaged = r"(?i)^(?:is\s+)?engaged\s+to\s+(.+)$"
    return (
        F.when(entry.rlike(plural), several)
        .when(entry.rlike(engaged), F.array(F.concat(F.lit("fiancé is "), F.regexp_extract(entry, engaged, 1))))
        .when(is_bare_name(entry), F.array(F.concat(F.lit("friend is "), F.trim(entry))))
        .otherwise(F.array(F.trim(entry)))
    )
