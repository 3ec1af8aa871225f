"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's terms are its lower-case words, weighted by their counts. Each
sample draws, from hashes of the term alone, two Gamma(2, 1) values and a uniform
one, and keeps the term of least transformed value together with the quantised
weight at which it was kept; two documents keep the same with a probability of
their generalised Jaccard similarity, sum of least over sum of greatest weights.
The samples are independent, so a fingerprint of 64 estimates with a standard deviation
of at most 1/16 whatever the length of the texts.

Rows are shuffled once, by range buckets of the id; the next document's text,
the terms, the samples and the next document's fingerprint are all found within
those partitions, for which each bucket also gets a copy of the row after its last.
What a term of some weight yields in all samples is the same in every document,
so it is computed once for all of a bucket.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.session import name

SAMPLES = 64  # of 16 bits
BUCKET_ROWS, MOST_BUCKETS = 500, 20_000
BLANK = r"[\x20\x09-\x0D]+"
OWN, EDITED, BOTH = 0, 1, 2  # whose term it is


def _bisect(bounds: list, value: Column) -> Column:
    """How many of the ordered bounds are at most value."""
    if not bounds:
        return F.lit(0)
    held = F.array(*map(F.lit, bounds))

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["low"] + state["high"]) / 2).cast("int")
        up = F.get(held, mid) <= value
        going = state["low"] < state["high"]
        return F.struct(
            F.when(going & up, mid + 1).otherwise(state["low"]).alias("low"),
            F.when(going & ~up, mid).otherwise(state["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(ceil(log2(len(bounds) + 1)) + 1))
    return F.aggregate(steps, start, halve)["low"]


def _followed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, row, extra, id, text, next): documents with the next one's text, by descending id.

    row numbers the rows of a bucket by content alone, so that a rerun numbers alike. Each bucket ends with a copy (extra) of the row that follows its last; ids
    that are null follow nothing.
    """
    spark = docs.sparkSession
    ids = docs.select(name(id_col).alias("id"))
    n = ids.filter("id IS NOT NULL").count()
    many = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    bounds: list = []
    if many > 1:
        cuts = [k / many for k in range(1, many)]
        bounds = sorted(set(ids.agg(F.percentile_approx("id", cuts, 20 * MOST_BUCKETS)).first()[0]))
    bucket = _bisect(bounds, F.col("id"))
    firsts = ids.filter("id IS NOT NULL").groupBy(bucket.alias("b")).agg(F.max("id").alias("first")).orderBy("b").collect()
    # at most MOST_BUCKETS rows: the first row of each bucket is also wanted in the bucket before it
    copies = [(row["first"], firsts[(k + 1) % len(firsts)]["b"]) for k, row in enumerate(firsts)]
    kind = docs.schema[id_col].dataType.simpleString()
    copied = spark.createDataFrame(copies, f"first {kind}, also int")
    lost = -1 - F.pmod(F.xxhash64("text"), F.lit(4096)).cast("int")
    rows = docs.select(name(id_col).alias("id"), F.coalesce(name(text_col), F.lit("")).alias("text")).withColumn(
        "own", F.when(F.col("id").isNull(), lost).otherwise(bucket)
    )
    rows = rows.join(F.broadcast(copied), F.col("id") == F.col("first"), "left")
    places = F.array(
        F.struct(F.col("own").alias("bucket"), F.lit(False).alias("extra")),
        F.struct(F.col("also").alias("bucket"), F.lit(True).alias("extra")),
    )
    dealt = rows.select("id", "text", F.explode(places).alias("at")).select("at.*", "id", "text")
    dealt = dealt.filter("bucket IS NOT NULL").repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("id"), F.xxhash64("text"))
    following = F.when(F.col("id").isNotNull(), F.lead("text").over(order))
    return dealt.withColumns({"next": following, "row": F.row_number().over(order)})


def _parts(text: Column, following: Column) -> tuple[Column, Column, Column]:
    """What a text and its edited text share at their start, and the rest of each: that of the edited text is the next document's."""
    third = F.floor(F.length(text) / 3).cast("int")
    rest = F.substring(text, F.length(text) - third + 1, third)
    return F.substring(text, F.lit(1), F.length(text) - third), rest, F.coalesce(F.substring(following, F.lit(1), third), rest)


def _uniform(bits: Column) -> Column:
    """A number within (0, 1) of the low 32 bits."""
    return (bits.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) / F.lit(4294967296.0)


def _sample(k: int) -> Column:
    """The least-value order and the 16-bit name of a term (h) kept in sample k at its weight (w), in one long.

    With r, c ~ Gamma(2, 1) and b uniform: t = floor(ln w / r + b), and the value's
    logarithm is ln c - r (t - b + 1). Its first 40 bits order, the last 16 name.
    """
    x = [F.xxhash64("h", F.lit(k), F.lit(part)) for part in range(3)]
    high = [_uniform(F.shiftrightunsigned(part, 32)) for part in x]
    r, lnc, b = -F.log(_uniform(x[0]) * high[0]), F.log(-F.log(_uniform(x[1]) * high[1])), _uniform(x[2])
    # most weights are 1, whose logarithm need not be taken
    t = F.when(F.col("w") == 1, F.lit(0).cast("long")).otherwise(F.floor(F.log("w") / r + b))
    value = lnc - r * (t - b + F.lit(1.0))
    order = F.floor((F.greatest(value, F.lit(-120.0)) + F.lit(120.0)) * F.lit(float(1 << 32))).cast("long")
    return F.shiftleft(order, 16).bitwiseOR(F.xxhash64("h", t).bitwiseAND(F.lit(0xFFFF)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1.0 if both have none, 0.0 if one has."""
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"]))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).otherwise(F.coalesce(same / F.size(a), F.lit(0.0)))


def _text(samples: Column, many: int) -> Column:
    """Four hex digits a sample; a text without terms shows as dashes."""
    shown = F.array_join(F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s)), 4, "0")), "")
    return F.coalesce(shown, F.lit("-" * 4 * many))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row.

    The edited text has the last floor(n_chars / 3) code points replaced by the
    first as many of the next document by descending id (after the last: the
    first). near_*: likeness of the document's fingerprint to its edited text's
    and to the next document's. Ids are numbers. Null texts are empty; two texts
    without words are alike. Rows of one id follow each other in one task. A row
    whose id is null has no next: its edited text is its text, near_next 0.
    """
    rows = _followed(docs, id_col, text_col)
    shared, rest, other = _parts(F.col("text"), F.col("next"))
    keys = ["bucket", "row"]
    # words of the shared start are cut once; its last word, which may go on in the rest, belongs to both rests
    cut = rows.select(*keys, F.split(shared, BLANK).alias("s"), rest.alias("t"), other.alias("u"))
    cut = cut.select(*keys, F.slice("s", F.lit(1), F.size("s") - 1).alias("s"), *(F.split(F.concat(F.get("s", F.size("s") - 1), c), BLANK).alias(c) for c in ("t", "u")))
    ends = F.size("s").alias("n"), (F.size("s") + F.size("t")).alias("m")
    terms = cut.select(*keys, *ends, F.posexplode(F.concat("s", "t", "u")).alias("pos", "word")).filter("word <> ''")
    own, edits = F.col("pos") < F.col("m"), (F.col("pos") < F.col("n")) | (F.col("pos") >= F.col("m"))
    terms = terms.select(*keys, F.xxhash64(F.lower("word")).alias("h"), own.cast("int").alias("own"), edits.cast("int").alias("edits"))
    weights = terms.groupBy(*keys, "h").agg(F.sum("own").alias("wo"), F.sum("edits").alias("we"))
    of = lambda which, w: F.struct(F.lit(which).alias("of"), F.col(w).alias("w"))
    entries = F.when(F.col("wo") == F.col("we"), F.array(of(BOTH, "wo"))).otherwise(F.array(of(OWN, "wo"), of(EDITED, "we")))
    entries = weights.select(*keys, "h", F.explode(entries).alias("x")).select(*keys, "h", "x.of", "x.w").filter("w > 0")
    # each term and weight of a bucket is drawn once, for all that have it there; draws made in a projection after the
    # grouping would be fused with the explode and made again for every element of at
    at, draws = F.collect_list(F.struct("row", "of")), F.array(*map(_sample, range(samples)))
    drawn = entries.groupBy("h", "w", "bucket").agg(at.alias("at"), draws.alias("x"))
    dealt = drawn.select("bucket", F.explode("at").alias("at"), "x").select("bucket", "at.row", "at.of", "x")
    least = dealt.groupBy(*keys, "of").agg(*(F.min(F.get("x", F.lit(k))).alias(f"m{k}") for k in range(samples)))
    least = least.select(*keys, "of", F.array(*(f"m{k}" for k in range(samples))).alias("m"))
    held = least.groupBy(*keys).agg(*(F.max(F.when(F.col("of") == k, F.col("m"))).alias(f"of{k}") for k in (OWN, EDITED, BOTH)))
    named = lambda c: F.transform(c, lambda x: x.bitwiseAND(F.lit(0xFFFF)).cast("int"))

    def joined(which: int) -> Column:
        ours, common = F.col(f"of{which}"), F.col(f"of{BOTH}")
        return named(F.coalesce(F.zip_with(ours, common, lambda x, y: F.least(x, y)), ours, common))

    prints = held.select(*keys, joined(OWN).alias("fo"), joined(EDITED).alias("fe"))
    shown = rows.select(
        *keys, "extra", "id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.concat(shared, other).cast("binary"), 256).alias("edited_sha256")
    )
    found = shown.join(prints, keys, "left")
    order = Window.partitionBy("bucket").orderBy("row")
    following = F.lead(F.struct("fo", "id")).over(order)  # null after the last, not where the next has no terms
    found = found.withColumn("following", following)
    follows = F.col("id").isNotNull() & F.col("following").isNotNull()
    return found.filter(~F.col("extra")).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", _text(F.col("fo"), samples).alias("fingerprint"),
        _text(F.col("fe"), samples).alias("edited_fingerprint"), likeness(F.col("fo"), F.col("fe")).alias("near_edited"),
        F.when(follows, likeness(F.col("fo"), F.col("following.fo"))).otherwise(F.lit(0.0)).alias("near_next"),
    )
