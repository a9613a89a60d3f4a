"""Changes of a bond held against the scenes that they cite.

Changes are ``dataset, owner, ep, partner, role`` with ``cited``, the ids of scenes; scenes are
``dataset, character, ep, scene_id, summary``, one archive a character. Names are first names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dramaturg.functions import pair_evidence as E

CHANGE = ["dataset", "owner", "ep", "partner", "role"]


def _cited(changes: DataFrame, scenes: DataFrame) -> DataFrame:
    """A row for each scene of the owner's archive that a change cites."""
    asked = changes.select(*CHANGE, F.explode(F.array_distinct("cited")).alias("scene_id"))
    own = scenes.select("dataset", F.col("character").alias("owner"), "scene_id", F.col("ep").alias("scene_ep"), "summary")
    return asked.join(own, ["dataset", "owner", "scene_id"])


def unwarranted_ex(changes: DataFrame, scenes: DataFrame, band: int = 2) -> DataFrame:
    """Changes to a former role with ``warranted``: a breakup of the two is told in a cited scene of the owner's
    archive, or in the partner's archive within ``band`` episodes of one.

    Episodes of the band are dealt out, so scenes of the partner are joined on equality. A change
    that cites nothing, or scenes that aren't there, isn't warranted.
    """
    cited = _cited(changes, scenes)
    told = E.has_breakup(F.col("summary"), F.col("owner"), F.col("partner"))
    own = cited.filter(told).select(CHANGE)
    near = cited.select(*CHANGE, F.explode(F.sequence(F.col("scene_ep") - band, F.col("scene_ep") + band)).alias("at")).distinct()
    theirs = scenes.select("dataset", F.col("character").alias("partner"), F.col("ep").alias("at"), "summary")
    other = near.join(theirs, ["dataset", "partner", "at"]).filter(told).select(CHANGE)
    found = own.unionByName(other).distinct().withColumn("warranted", F.lit(True))
    return changes.join(found, CHANGE, "left").withColumn("warranted", F.coalesce("warranted", F.lit(False)))


def borrowed_by_votes(changes: DataFrame, scenes: DataFrame, cast: DataFrame) -> DataFrame:
    """New bonds whose cited scenes give the partner to another main character: ``CHANGE, lender, votes, own_votes``.

    ``cast``: ``dataset, name`` of the main characters. Partners of the cast are skipped. Each cited
    scene that names the partner votes: for the first main character, by name, to whom it binds the
    partner, else for the owner if it names them, else not at all. Flagged is who gets more votes
    than the owner; of equals the first by name.
    """
    outside = changes.join(cast.withColumnRenamed("name", "partner"), ["dataset", "partner"], "left_anti")
    named = _cited(outside, scenes).filter(E.names(F.col("summary"), F.col("partner")))
    bound = E.owned_by(F.col("summary"), F.col("name"), F.col("partner"))
    others = named.join(cast, "dataset").filter((F.col("name") != F.col("owner")) & bound)
    lenders = others.groupBy(*CHANGE, "scene_id").agg(F.min("name").alias("lender"))
    voted = named.join(lenders, [*CHANGE, "scene_id"], "left")
    own = F.col("lender").isNull() & E.names(F.col("summary"), F.col("owner"))
    votes = voted.groupBy(*CHANGE, "lender").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("own"))
    top = votes.groupBy(*CHANGE).agg(F.max(F.when(F.col("lender").isNotNull(), F.col("n"))).alias("votes"), F.sum("own").alias("own_votes"))
    first = votes.join(top, CHANGE).filter(F.col("lender").isNotNull() & (F.col("n") == F.col("votes")) & (F.col("votes") > F.col("own_votes")))
    return first.groupBy(*CHANGE, "votes", "own_votes").agg(F.min("lender").alias("lender"))


def stripped(changes: DataFrame, flagged: DataFrame) -> DataFrame:
    """``changes`` without the flagged ones."""
    return changes.join(flagged.select(CHANGE), CHANGE, "left_anti")
