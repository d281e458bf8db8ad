"""Problem 5: splits that keep related records together.

Records that share an entity, directly or through others, form one component (large-star small-star in
granary.operators.components); a hash of the component's identifier falls into proportional split ranges. A component
too large for a hash to keep the proportions is placed first, by the largest remaining quota; there are at most
1 / LARGE of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.components import connected_components, star_edges
from granary.session import durable

#: What a key says when it is not known, after case and all but letters and digits are removed.
NOT_KNOWN = (
    "", "na", "none", "null", "nil", "nan", "unknown", "notknown", "unk", "tbd", "tba", "tbc", "undefined", "und",
    "unspecified", "notspecified", "missing", "notavailable", "notapplicable", "empty", "blank", "pending", "nodata",
    "notgiven", "notset", "unset", "untitled", "inconnu", "ntakizwi", "haijulikani", "ntibizwi",
)
KEYS = ("content_key", "source_group_id", "source_document_id")
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Share of all ids from which a component is placed by quota and not by hash.
LARGE = 0.01


def plain_key(c: Column) -> Column:
    """A key without case and without all but letters and digits; null where it says nothing."""
    said = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when(~said.isin(*NOT_KNOWN), said)


def split_class(c: Column) -> Column:
    """train, validation or test of a spelled split; null for draft, null and anything else."""
    said = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return (
        F.when(said.isin("train", "experimental-train"), "train")
        .when(said.isin("validation", "experimental-validation"), "validation")
        .when(said == "benchmark-only", "test")
    )


def record_components(records: DataFrame, id_col: str = "id", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(id, group_id) of every id: the smallest id of its component, itself where it shares nothing.

    Two ids are linked where the same field agrees in plain_key. All deliveries of an id count. Null ids are left
    out, null and not-known keys link nothing, an empty table gives no rows.
    """
    rows = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[plain_key(F.col(k)).alias(f"k{n}") for n, k in enumerate(keys)])
    members = rows.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"k{n}").alias("key")) for n in range(len(keys))])).alias("e"))
    members = members.select("id", "e.field", "e.key").filter(F.col("key").isNotNull())
    found = connected_components(star_edges(members, "id", ["field", "key"]))
    ids = rows.select("id").distinct()
    return ids.join(found.select(F.col("node").alias("id"), F.col("component")), "id", "left").select("id", F.coalesce("component", "id").alias("group_id"))


def torn_groups(records: DataFrame) -> DataFrame:
    """(group_id, id) of every record of each group that has records in more than one split class."""
    groups = record_components(records)
    said = records.filter(F.col("id").isNotNull()).groupBy("id").agg(F.array_compact(F.collect_set(split_class(F.col("split")))).alias("classes"))
    both = durable(groups.join(said, "id", "left"))
    # Three flags per group, combined before the shuffle: a hot group is never gathered.
    seen = both.groupBy("group_id").agg(*[F.max(F.array_contains("classes", s).cast("int")).alias(s) for s in SPLITS])
    torn = seen.filter(F.col("train") + F.col("validation") + F.col("test") > 1).select("group_id")
    return both.select("group_id", "id").join(torn, "group_id", "left_semi")


def assign_splits(groups: DataFrame, proportions: dict[str, float] | None = None, seed: str = "granary") -> DataFrame:
    """(id, group_id, split): every group in one split, the ids near the given proportions.

    A component of more than LARGE of all ids is placed where the quota left is largest; at most 1 / LARGE such
    groups go to the driver. The hash ranges of the others follow the quotas left. The same rows always give the
    same splits.
    """
    shares = proportions or SPLITS
    groups = durable(groups)
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    total = groups.count()
    big = [(r[0], r[1]) for r in sizes.filter(F.col("n") > max(1, LARGE * total)).orderBy(F.desc("n"), "group_id").collect()]
    left = {s: p * total for s, p in shares.items()}
    placed: dict[str, str] = {}
    for group, n in big:
        at = max(left, key=lambda s: left[s])
        placed[group] = at
        left[at] -= n
    rest = sum(max(0.0, v) for v in left.values()) or 1.0
    unit = (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "group_id"), 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12)))
    by_hash, upto = None, 0.0
    names = list(shares)
    for s in names[:-1]:
        upto += max(0.0, left[s]) / rest
        by_hash = F.when(unit < upto, s) if by_hash is None else by_hash.when(unit < upto, s)
    by_hash = by_hash.otherwise(names[-1]) if by_hash is not None else F.lit(names[0])
    by_size = None
    for group, s in placed.items():
        by_size = F.when(F.col("group_id") == group, s) if by_size is None else by_size.when(F.col("group_id") == group, s)
    return groups.select("id", "group_id", (F.coalesce(by_size, by_hash) if by_size is not None else by_hash).alias("split"))
