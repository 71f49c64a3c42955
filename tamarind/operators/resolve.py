"""Probabilistic entity resolution: blocking, pair weights, decisions and clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.functions import numeric as N
from tamarind.functions.text import jaro_winkler_udf, match_key_of, token_list, token_set_similarity
from tamarind.operators.graph import connected_components

#: Chance that a field agrees for the same and for different entities.
FIELDS = {
    "domain": (0.5445, 0.004), "phone": (0.396, 0.0012), "whatsapp": (0.3564, 0.0016), "email": (0.297, 0.0008),
    "handle": (0.4158, 0.0022), "name": (0.495, 0.28), "wilaya": (0.55, 0.16), "category": (0.6, 0.2),
}
AUTO, REVIEW, PRIOR, NAME_JARO, NAME_TOKENS, LARGEST_BLOCK = 0.97, 0.60, 0.05, 0.90, 0.85, 400
LISTS = ["phones", "emails", "handles"]


def weights(field: str) -> tuple[float, float]:
    m, u = FIELDS[field]
    return math.log2(m / u), math.log2((1 - m) / (1 - u))


def prepared(records: DataFrame) -> DataFrame:
    """Records ``(id, name, domain, phones, emails, handles, wilaya, category)`` with lower-cased identities and name keys."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    key = match_key_of("name")
    return records.select(
        "id", F.when(F.col("domain") != "", F.lower("domain")).alias("domain"), F.coalesce("phones", F.array().cast("array<string>")).alias("phones"),
        low(F.col("emails")).alias("emails"), low(F.col("handles")).alias("handles"), F.when(F.col("name") != "", key).alias("name_key"), F.lower("name").alias("name"),
        F.when(F.col("wilaya") != "", F.col("wilaya")).alias("wilaya"), F.when(F.col("category") != "", F.col("category")).alias("category"),
    )


def block_keys(records: DataFrame) -> DataFrame:
    """``(id, block)`` of prepared records: domains, identities, and raw name words of over three characters."""
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{tag}:"), x))
    words = F.filter(F.split(F.coalesce("name", F.lit("")), r"\s+"), lambda w: F.length(w) > 3)
    domain = F.when(F.col("domain").isNotNull(), F.array("domain")).otherwise(F.array().cast("array<string>"))
    every = F.concat(tagged("domain", domain), tagged("phone", F.col("phones")), tagged("email", F.col("emails")), tagged("handle", F.col("handles")), tagged("token", words))
    return records.select("id", F.explode(F.array_distinct(every)).alias("block"))


def candidate_pairs(blocks: DataFrame, largest: int = LARGEST_BLOCK) -> DataFrame:
    """``(left_id, right_id, blockers)``: pairs that share a block of 2 to ``largest`` records.

    The bound is part of the operator: it keeps a block's pairs, and so every task, bounded.
    """
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n").between(2, largest))
    held = blocks.join(sizes.select("block"), "block")
    left, right = held.select("block", F.col("id").alias("left_id")), held.select("block", F.col("id").alias("right_id"))
    pairs = left.join(right, "block").filter("left_id < right_id")
    return pairs.groupBy("left_id", "right_id").agg(F.array_sort(F.collect_set("block")).alias("blockers"))


def decide(pairs: DataFrame, records: DataFrame, auto: float = AUTO, review: float = REVIEW, prior: float = PRIOR) -> DataFrame:
    """Pairs with ``weight`` (bits), ``posterior``, ``matched_on``, ``conflicting`` and ``decision``."""
    tokens = records.withColumn("tokens", token_list(F.coalesce("name_key", F.lit(""))))
    side = lambda p: tokens.select(*(F.col(c).alias(f"{p}_{c}") for c in tokens.columns))
    rows = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    l, r = (lambda c: F.col(f"left_{c}")), (lambda c: F.col(f"right_{c}"))  # noqa: E741
    weight, matched = F.lit(0.0), []

    def add(field, given, agrees):
        nonlocal weight
        yes, no = weights(field)
        weight = weight + F.when(given, F.when(agrees, yes).otherwise(no)).otherwise(0.0)
        matched.append(F.when(given & agrees, F.lit(field)))

    domains, same_domain = l("domain").isNotNull() & r("domain").isNotNull(), l("domain").eqNullSafe(r("domain")) & l("domain").isNotNull()
    add("domain", domains, same_domain)
    shared = {c: F.size(F.array_intersect(l(c), r(c))) for c in LISTS}
    given = {c: (F.size(l(c)) > 0) & (F.size(r(c)) > 0) for c in LISTS}
    add("phone", given["phones"], shared["phones"] > 0)
    yes, no = weights("whatsapp")
    weight = weight + F.when(given["phones"], F.when(shared["phones"] > 1, yes).otherwise(no)).otherwise(0.0)
    add("email", given["emails"], shared["emails"] > 0)
    add("handle", given["handles"], shared["handles"] > 0)
    names = l("name_key").isNotNull() & r("name_key").isNotNull()
    agree = (jaro_winkler_udf(l("name_key"), r("name_key")) >= NAME_JARO) | (token_set_similarity(l("tokens"), r("tokens")) >= NAME_TOKENS)
    rows = rows.withColumn("_names", F.coalesce(agree, F.lit(False)))
    add("name", names, F.col("_names"))
    weight = weight + F.when(names & ~F.col("_names") & (same_domain | (shared["phones"] > 0)), max(-1.2, weights("name")[1] / 3)).otherwise(0.0)
    for c in ("wilaya", "category"):
        add(c, l(c).isNotNull() & r(c).isNotNull(), l(c) == r(c))
    conflict = domains & ~same_domain | given["phones"] & (shared["phones"] == 0)
    rows = rows.withColumn("weight", weight).withColumn("posterior", N.sigmoid(math.log(prior / (1 - prior)) + F.col("weight") * math.log(2)))
    decision = F.when((F.col("posterior") >= auto) & ~F.col("conflicting"), "auto_merge").when(F.col("posterior") >= review, "review").otherwise("distinct")
    out = rows.withColumns({"conflicting": conflict, "matched_on": F.filter(F.array(*matched), lambda x: x.isNotNull())}).withColumn("decision", decision)
    return out.select("left_id", "right_id", "blockers", "weight", "posterior", "matched_on", "conflicting", "decision")


def clusters(decisions: DataFrame) -> DataFrame:
    """``(id, cluster_id)`` of the records that auto-merge; the cluster's id is its least."""
    merged = decisions.filter("decision = 'auto_merge'")
    return connected_components(merged, "left_id", "right_id").select(F.col("node").alias("id"), F.col("root").alias("cluster_id"))


def resolve(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions, and clusters of the merged."""
    ready = prepared(records)
    made = decide(candidate_pairs(block_keys(ready)), ready)
    return made, clusters(made)
