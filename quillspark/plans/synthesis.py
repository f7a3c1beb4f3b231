"""Candidates of an inventory: what two own, what nobody owns, what nobody consumes, and what a document says of itself untruly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import synthesis
from quillspark.operators.sections import self_claims
from quillspark.sources.files import numbered


@dataclass(frozen=True)
class Switches:
    """What a run leaves out, to see what it is worth."""

    polarity: bool = True
    object_identity: bool = True
    dataflow: bool = True
    claims: bool = True


def candidates(
    entries: DataFrame, deferrals: DataFrame, produced: DataFrame, consumed: DataFrame, read: DataFrame, sections: DataFrame | None = None, vectors: DataFrame | None = None,
    claims: DataFrame | None = None, heads: DataFrame | None = None, held: DataFrame | None = None, switches: Switches = Switches(),
) -> DataFrame:
    """(id, kind, key, status), numbered within a kind.

    entries: (slug, id, position, capability, action, owner, polarity). deferrals: (slug, id, position, capability, heading, to). produced, consumed: (slug, id,
    position, value). read: (slug, complete). sections: (slug, position, heading), for who defers. vectors: (label, embedding) of all labels, by
    which they are grouped; without them words are. claims, heads, held: as self_claims() takes them. Without polarity, entries that exclude an
    owner count as owning; without object identity, actions aren't told apart; without dataflow, outputs aren't looked for.
    """
    owned = entries.filter(F.col("polarity") != "excludes") if switches.polarity else entries
    dual = synthesis.dual_owners(owned, vectors, not switches.object_identity)
    out = dual.select(F.lit("D5").alias("kind"), F.concat_ws("/", "slug", "label", "action").alias("key"), F.lit("finding").alias("status"))
    gaps = synthesis.ownership_gaps(deferrals, owned, read, sections, vectors)
    out = out.unionByName(gaps.select(F.lit("D6").alias("kind"), F.concat_ws("/", "slug", "label", F.concat(F.lit("cycle: "), "cycle")).alias("key"), "status"))
    if switches.dataflow:
        lone = synthesis.unconsumed(produced, consumed, read, vectors)
        out = out.unionByName(lone.select(F.lit("D8").alias("kind"), F.concat_ws("/", "slug", "label").alias("key"), "status"))
    if switches.claims and claims is not None:
        said = self_claims(claims, heads, held, read).filter(~F.col("state").startswith("not checked") & (F.col("state") != "held"))
        out = out.unionByName(said.select(F.lit("D3").alias("kind"), F.col("id").cast("string").alias("key"), F.when(F.col("doubtful"), "doubtful").otherwise("finding").alias("status")))
    parts = None
    for kind in ("D3", "D5", "D6", "D8"):
        own = numbered(out.filter(F.col("kind") == kind), [F.col("key")], kind)
        parts = own if parts is None else parts.unionByName(own)
    return parts.select("id", "kind", "key", "status")
