"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of the mix; a source that would be
repeated more than `max_epochs` times is clamped there and the excess is dealt
to the others by weight, again and again until none is above. A source then
takes whole repetitions of all its documents and a seeded fraction of one more:
its documents in hash order up to the target, the last one in part or, with
`whole_documents`, rounded to a whole one.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.session import fresh, name, scratch, written

WORD = r"[^\x20\x09-\x0D]+"


def _targets(sizes: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """sizes (source, source_size) with target; one row per source, null last."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # over names of sources only
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    weighted = written(weighted.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    rest, weight, level = share * total, None, None
    while True:  # each round clamps at least one source more, or ends
        clamped = F.lit(False) if level is None else F.col("cap") < F.lit(level[0]) * F.col("weight") / F.lit(level[1])
        row = weighted.agg(
            F.sum(F.when(clamped, F.col("cap"))).alias("cap"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("weight"),
        ).first()
        rest, weight = share * total - (row["cap"] or 0.0), row["weight"]
        if not weight or level == (rest, weight):
            break
        level = (rest, weight)
    fill = F.col("cap") if not weight else F.least(
        F.col("cap"), F.lit(rest) * F.col("weight") / F.lit(weight)
    )
    return weighted.select("source", "source_size", fill.alias("target"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    whole_documents: bool = False,
) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted).

    Sources in code point order, null last, have the weights in turn; the mix
    has `share` times all words. Within a source, documents are taken in the
    order of a seeded hash of their id: those before the cut once more than the
    whole repetitions, the one at the cut in part. Rows that share an id (or
    have none) at the cut share its part evenly, rounded down. Null texts have no
    words and take none; a source without words has target 0. Reruns agree.
    whole_documents: no document is taken in part. Rows of one id (or none) are
    ordered by a hash of the text, and of rows with the same id and text at the
    cut as many are taken as come nearest to the target; one task orders these.
    A column of docs that has the name of a new one is replaced.
    """
    new = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c.lower() not in new]
    key, from_source, whole, cut_key, part, cut_size = fresh(docs, "key", "source", "whole", "cut_key", "part", "cut_size")
    size = F.coalesce(F.regexp_count(name(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), name(id_col).cast("string")))
    if whole_documents:
        hashed = F.concat(hashed, F.md5(F.coalesce(name(text_col), F.lit(""))))
    sized = docs.select(*map(name, keep), size.alias("size"), hashed.alias(key))
    with scratch(docs.sparkSession) as settle:
        small = docs.select(name(source_col).alias("source"), hashed.alias("key"), size.alias("size"))
        goal = settle(_cuts(written(small, "sizes"), list(weights), share, max_epochs), "cuts")
    goal = goal.select(
        F.col("source").alias(from_source), "source_size", "target", F.col("whole").alias(whole),
        F.col("cut_key").alias(cut_key), F.col("part").alias(part), F.col("cut_size").alias(cut_size),
    )
    joined = sized.join(goal, name(source_col).eqNullSafe(F.col(from_source)), "left")
    if whole_documents:
        return _rounded(joined, keep, key, from_source, whole, cut_key, part)
    extra = (
        F.when(F.col(cut_key).isNull(), F.lit(0))
        .when(F.col(key) < F.col(cut_key), F.col("size"))
        .when(F.col(key) == F.col(cut_key), F.floor(F.col("size") * F.col(part) / F.col(cut_size)))
        .otherwise(F.lit(0))
    )
    taken = (F.col(whole) * F.col("size") + extra).cast("long")
    return joined.select(*map(name, keep), "size", "source_size", "target", taken.alias("taken"))


def _cuts(small: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target, whole, cut_key, part, cut_size) of small (source, key, size): where each source's last repetition ends."""
    sizes = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = written(_targets(sizes, weights, share, max_epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("whole", whole.cast("long")).withColumn(
        "need", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    )
    # the cut: first the bucket of the hash that crosses the need, then the id within it; with about as many
    # buckets as ids in a bucket neither order is long
    digits = max(1, round(log(max(small.count(), 1), 16) / 2))
    bucket = F.substring("key", 1, digits)
    same = F.col("g.source").eqNullSafe(F.col("b.source"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = small.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    at = goal.alias("g").join(buckets.alias("b"), same).filter("before <= need and need < before + n")
    at = at.select("g.source", "need", "b.bucket", "before")
    within = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = small.alias("s").join(
        at.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")) & (bucket == F.col("t.bucket"))
    ).groupBy("s.source", "key", "need", "before").agg(F.sum("size").alias("n"))
    keys = keys.withColumn("done", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    cut = keys.filter("done <= need and need < done + n").select(
        "source", F.col("key").alias("cut_key"), (F.col("need") - F.col("done")).alias("part"), F.col("n").alias("cut_size")
    )
    return goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select(
        "g.source", "source_size", "target", "whole", "cut_key", "part", "cut_size"
    )


def _rounded(joined: DataFrame, keep: list[str], key: str, source: str, whole: str, cut_key: str, part: str) -> DataFrame:
    """The rows of mixed() with whole documents only; rows at a cut have the same id and text."""
    turn, more = fresh(joined, "turn", "more")
    at_cut = F.coalesce((F.col(key) == F.col(cut_key)) & (F.col("size") > 0), F.lit(False))
    order = Window.partitionBy(source, key).orderBy(F.xxhash64(*(name(c).cast("string") for c in keep)))
    cut = joined.filter(at_cut).withColumn(turn, F.row_number().over(order))
    cut = cut.withColumn(more, F.col(turn) <= F.round(F.col(part) / F.col("size"))).drop(turn)
    rest = joined.filter(~at_cut).withColumn(more, F.coalesce(F.col(key) < F.col(cut_key), F.lit(False)))
    taken = (F.col("size") * (F.col(whole) + F.col(more).cast("int"))).cast("long")
    return rest.union(cut).select(*map(name, keep), "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, with the columns of docs: each document as often as it is taken.

    A document that is taken k and a half times comes k times whole and once
    with its first words only, unless whole_documents is set. Options are those of mixed().
    """
    text = options.get("text_col", "text")
    found = mixed(docs, **options)
    times, copy, held = fresh(docs, "times", "copy", "held")
    # columns of docs that have the names of new ones come back as they were
    clash = [c for c in docs.columns if c.lower() in ("size", "source_size", "target", "taken")]
    if clash:
        found = mixed(docs.withColumn(held, F.struct(*map(name, clash))).drop(*clash), **options)
    size = F.greatest(F.col("size"), F.lit(1))
    whole, part = F.floor(F.col("taken") / size).cast("int"), F.pmod(F.col("taken"), size).cast("int")
    # empty texts take no words; they stay once rather than vanish
    many = F.when(F.col("size") == 0, F.lit(1)).otherwise(whole + (part > 0).cast("int"))
    counted = found.withColumn(times, many).filter(F.col(times) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    cut = (F.col("size") > 0) & (F.col(copy) > whole)
    words = F.slice(F.regexp_extract_all(name(text), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.greatest(part, F.lit(1)))
    shown = F.when(cut, F.array_join(words, "")).otherwise(name(text))
    value = lambda c: shown if c == text else F.col(held).getField(c) if c in clash else name(c)
    return copies.select(*[value(c).alias(c) for c in docs.columns])
