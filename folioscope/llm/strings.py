"""Similar strings and groups of linked rows, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.plans.materialize import cut

#: Edits looked for from these lengths of the shorter string on; shorter strings have no near ones. Of two edits, all
#: count from TWO letters on; before, only two letters that changed places.
EDITS, TWO = {4: 1, 6: 2}, 7
_MOST = max(EDITS.values())


def _edits(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} >= {n} THEN {k}" for n, k in sorted(EDITS.items(), reverse=True)) + " ELSE -1 END"


def edits(length: Column) -> Column:
    """Edits that strings of this length may have, -1 if none is near them."""
    out = F.lit(-1)
    for least, k in sorted(EDITS.items()):
        out = F.when(length >= least, k).otherwise(out)
    return out


def is_near(a: Column, b: Column) -> Column:
    """Whether strings are within the edits of EDITS and TWO, by banded edit distance."""
    far, length = F.levenshtein(a, b, _MOST), F.least(F.length(a), F.length(b))
    swapped = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    return (far >= 0) & (far <= edits(length)) & ((far < 2) | (length >= TWO) | swapped)


def _indexed(word: str) -> str:
    """Keys (length, number, text) of the edits + 1 segments of a word."""
    n, k = f"length({word})", _edits(f"length({word})")
    start = f"((i * {n}) div ({k} + 1))"
    end = f"(((i + 1) * {n}) div ({k} + 1))"
    return f"CASE WHEN {k} >= 0 THEN transform(sequence(0, {k}), i -> concat_ws('|', {n}, i, substring({word}, {start} + 1, {end} - {start}))) END"


def _probed(word: str) -> str:
    """Keys of all words up to the allowed edits shorter that a substring of the word could be a segment of."""
    n = f"(length({word}) - d)"
    k = _edits(n)
    start, end = f"((i * {n}) div ({k} + 1))", f"(((i + 1) * {n}) div ({k} + 1))"
    at = f"({start} + o)"
    fits = f"{at} >= 0 AND {at} + {end} - {start} <= length({word}) AND abs(o) <= {k}"
    key = f"CASE WHEN {fits} THEN concat_ws('|', {n}, i, substring({word}, {at} + 1, {end} - {start})) END"
    inner = f"flatten(transform(sequence(0, greatest({k}, 0)), i -> transform(sequence(-{_MOST}, {_MOST}), o -> CASE WHEN d <= {k} THEN {key} END)))"
    return f"array_distinct(array_compact(flatten(transform(sequence(0, {_MOST}), d -> {inner}))))"


def segment_join(words: DataFrame, word: str = "word", scope: str | None = None, once: bool = True) -> DataFrame:
    """Pairs (a, b[, scope]), a < b, of distinct strings within EDITS of each other, of one scope; not ``once``: some twice.

    Of two strings within k edits, one of the k + 1 segments of the shorter stands unchanged in the other, shifted by k
    places at most; segments are looked up in an inverted index and candidates verified by banded edit distance. No
    pair is lost and no bucket capped. Null strings and those under the least length have no partners.
    """
    own = [F.col(scope).alias("scope")] if scope else []
    base = words.select(F.col(word).alias("w"), *own).where("w IS NOT NULL").distinct()
    extra = ["scope"] if scope else []
    index = base.select(F.col("w").alias("a"), *extra, F.explode(F.expr(_indexed("w"))).alias("key"))
    probe = base.select(F.col("w").alias("b"), *extra, F.explode(F.expr(_probed("w"))).alias("key"))
    met = probe.join(index, ["key", *extra]).where("a <> b")
    near = met.where(is_near(F.col("a"), F.col("b")))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *extra)
    return pairs.distinct() if once else pairs


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of edges (a, b): the least id that it hangs together with.

    Least labels spread along edges and labels jump to their own labels, until nothing changes; every round is
    written to the checkpoint folder, so the plan stays short and a lost executor costs one round.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = spread.select(F.col("id").alias("root"), F.col("root").alias("next"))
        spread = cut(spread.join(jump, "root", "left").select("id", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        labels = spread.select("id", "root")
        if spread.where("root <> old").isEmpty():
            return labels


#: Members of a group that one task pairs with the group, at most on average.
SLICE = 2000


def pairs(members: DataFrame, group: str, member: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of distinct members of each group: the form that pN_found asks for.

    A large group is cut into slices of its members by hash; each slice meets the whole group in a task of its own.
    """
    one = members.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g IS NOT NULL").distinct()
    one = one.withColumn("slices", (F.count("*").over(W.partitionBy("g")) / SLICE).cast("int") + 1)
    left = one.select("g", F.pmod(F.xxhash64("m"), "slices").alias("slice"), F.col("m").alias("doc_a"))
    right = one.select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices").cast("bigint") - 1)).alias("slice"), F.col("m").alias("doc_b"))
    return left.join(right, ["g", "slice"]).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
