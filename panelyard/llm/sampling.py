"""Bounded, deterministic samples of labelled documents to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash slots among which a group is thinned before its ids come to the driver.
SLOTS = 1 << 20


def sample_ids(labelled: DataFrame, group: str, per_group: int, total: int = 1 << 16) -> dict[object, list[int]]:
    """Ids of up to ``per_group`` documents of every group.

    labelled: doc_id and the group.  The choice is by a hash of the id, so it is the same on every
    run and does not depend on partitioning.  Two narrow passes: group sizes, then the thinned ids,
    about four times ``per_group`` of each group at most.  With very many groups each gives fewer
    documents, so that the sample stays near ``total``, but none is left out.
    """
    rows = labelled.filter(F.col("doc_id").isNotNull() & F.col(group).isNotNull()).select("doc_id", F.col(group).alias("g"))
    sizes = rows.groupBy("g").count().collect()
    if not sizes:
        return {}
    per_group = max(1, min(per_group, total // len(sizes)))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    kept = rows.sparkSession.createDataFrame([(r["g"], max(int(min(1.0, 4.0 * per_group / r["count"]) * SLOTS), 1)) for r in sizes], rows.select(F.col("g").alias("of"), F.lit(0).alias("below")).schema)
    thin = rows.join(F.broadcast(kept), F.col("g") == F.col("of")).filter(slot < F.col("below"))
    found: dict[object, list[tuple[int, int]]] = {}
    for r in thin.select("g", "doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect():
        found.setdefault(r["g"], []).append((r["h"] % SLOTS, r["doc_id"]))
    return {g: [i for _, i in sorted(found[g])[:per_group]] for g in sorted(found, key=str)}
