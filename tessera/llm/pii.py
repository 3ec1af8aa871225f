"""Personal data by base patterns and bootstrapped contexts, in DataFrame functions only.

Base patterns find emails, addresses, cards and phones, a fifth one long keys in
hexadecimal digits. These are the seeds. The whole words before and after them, alone,
in pairs and with the shape of what stands there, are lexical patterns;
identifier-shaped words elsewhere are instances of unknown kind. Patterns and
instances form a weighted bipartite graph that Spark scores in rounds until the
scores settle: a pattern by the share of all its occurrences in the corpus that
stand beside likely identifiers of a kind, an instance by its patterns.
Patterns of high confidence then add what stands beside them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.session import name, scratch, written

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = 4  # kinds of the base patterns
TOKEN = len(KINDS)  # the kind number of identifier-shaped words

# What the base kinds look like, written so that no text is scanned twice, long
# hexadecimal keys, and an identifier-shaped word: one with a digit or an at sign.
PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9]++(?:[ -][0-9]++)*+",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
]
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BLANK = r"[\x20\x09-\x0D]+"

SEEDS = 3  # distinct seeds that a pattern needs
LEAST, SURE = 0.1, 0.5  # scores to stay in the graph and to extract
SETTLED = 1e-3  # scores, which only rise, are settled when none rises by more
SENT = 500_000  # patterns that are sent to all tasks at most; more are joined after counting


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check that payment cards pass."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _matches(text: Column) -> Column:
    """Array of (kind, k, gap, hit): all matches of all patterns; positions follow from gaps and hits."""

    def of(kind: int, pattern: str) -> Column:
        zipped = F.arrays_zip(
            F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
        )
        shown = F.transform(
            zipped, lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.length(x["before"]).alias("gap"), x["hit"].alias("hit"))
        )
        return F.filter(shown, lambda x: x["hit"].isNotNull())

    found = [of(kind, pattern) for kind, pattern in enumerate(PATTERNS)]
    return F.when(text.rlike("[0-9@]"), F.concat(*found))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BLANK), lambda w: w != "")


def _around(text: Column) -> Column:
    """For each identifier-shaped word in turn: the two whole words before it and the two after it, null where there is none."""
    none = F.lit(None).cast("string")

    def shifted(w: Column) -> Column:
        n = F.size(w)
        zipped = F.arrays_zip(
            w.alias("w"), F.concat(F.array(none, none), w).alias("l2"), F.concat(F.array(none), w).alias("l1"),
            F.slice(w, F.lit(2), n).alias("r1"), F.slice(w, F.lit(3), n).alias("r2"),
        )
        return F.transform(F.filter(zipped, lambda x: x["w"].rlike("[0-9@]")), lambda x: F.struct(*(x[c].alias(c) for c in ("l2", "l1", "r1", "r2"))))

    # the words are an argument, so that they are split once
    return F.when(text.rlike("[0-9@]"), F.get(F.transform(F.array(_words(text)), shifted), F.lit(0)))


def _valid() -> Column:
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.col("hit").rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(F.col("kind") == 2, F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(F.col("kind") == 3, n.between(10, 15))
        .when(F.col("kind") == 4, F.col("hit").rlike("[0-9]") & F.col("hit").rlike("[a-fA-F]"))
        .otherwise(True)
    )


def _plausible(kind: Column, word: Column) -> Column:
    """Whether a word beside a pattern of a kind can be of that kind; what a base pattern would refuse by its digits is refused here too."""
    digits = F.regexp_replace(word, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when((kind == 1) & word.rlike("^[0-9.]+$"), word.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == 2, F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == 3, n.between(7, 15))
        .otherwise(True)
    )


def _shape(hit: Column) -> Column:
    """Letters as a, digits as 9, runs of either as one."""
    return F.regexp_replace(F.regexp_replace(hit, r"\p{L}+", "a"), r"[0-9]+", "9")


#: Patterns by number: what their hash is made of.
UNIGRAM, BIGRAM = 0, 1


def _hash(which: int, side: str, *parts: Column) -> Column:
    known = parts[0].isNotNull()
    for part in parts[1:]:
        known &= part.isNotNull()
    return F.when(known, F.xxhash64(F.lit(which), F.lit(side), *parts))


def _contexts() -> Column:
    """(p, by) of a mention's patterns: p names the pattern, by the words whose count is its total, null for those with a shape."""
    l1, l2, r1, r2 = (F.col(f"around.{c}") for c in ("l1", "l2", "r1", "r2"))
    shape = _shape(F.col("hit"))
    pair = lambda p, by: F.struct(p.alias("p"), by.alias("by"))
    none = F.lit(None).cast("long")
    found = F.array(
        pair(_hash(0, "left", l1), _hash(UNIGRAM, "", l1)),
        pair(_hash(1, "left", l2, l1), _hash(BIGRAM, "", l2, l1)),
        pair(_hash(0, "right", r1), _hash(UNIGRAM, "", r1)),
        pair(_hash(1, "right", r1, r2), _hash(BIGRAM, "", r1, r2)),
        pair(_hash(2, "left", l1, shape), none),
        pair(_hash(2, "right", r1, shape), none),
    )
    return F.filter(found, lambda x: x["p"].isNotNull())


def _totals(docs: DataFrame, text_col: str, edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(p, total): how often each pattern's words occur in all texts, or for one with a shape, how many mentions it has."""
    words = _words(F.coalesce(name(text_col), F.lit("")))
    pairs = docs.select(words.alias("w")).select(
        F.explode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.col("w")).alias("a"), F.col("w").alias("b"))).alias("x")
    )
    seen = pairs.filter("x.b IS NOT NULL").select(
        F.explode(F.array(_hash(UNIGRAM, "", F.col("x.b")), _hash(BIGRAM, "", F.col("x.a"), F.col("x.b")))).alias("by")
    ).filter("by IS NOT NULL")
    wanted = written(patterns.filter("by IS NOT NULL").select("by").distinct(), "wanted")
    if wanted.count() <= SENT:
        counts = seen.join(F.broadcast(wanted), "by", "left_semi").groupBy("by").agg(F.count("*").alias("total"))
    else:  # counted within the tasks first, so that frequent words are few rows
        counts = seen.groupBy("by").agg(F.count("*").alias("total")).join(wanted, "by", "left_semi")
    shaped = edges.join(patterns.filter("by IS NULL").select("p"), "p", "left_semi").groupBy("p").agg(F.sum("n").alias("total"))
    return patterns.join(counts, "by").select("p", "total").union(shaped)


def _discovered(docs: DataFrame, text_col: str, mentions: DataFrame) -> DataFrame | None:
    """(row, start, stop, kind) of words that confident patterns stand beside; None if no pattern has the seeds."""
    placed = mentions.select("row", "kind", "start", "stop", F.lower("hit").alias("i"), F.explode("contexts").alias("c"))
    placed = placed.select("row", "kind", "start", "stop", "i", "c.p", "c.by")
    edges = written(placed.groupBy("p", "i", "kind").agg(F.count("*").alias("n"), F.min("by").alias("by")), "edges")
    seeds = edges.filter(F.col("kind") < TOKEN).groupBy("p", "i").agg(F.min("by").alias("by"))
    seeds = seeds.groupBy("p").agg(F.count("*").alias("seeds"), F.min("by").alias("by"))
    patterns = written(seeds.filter(F.col("seeds") >= SEEDS).select("p", "by"), "patterns")
    if patterns.isEmpty():
        return None
    totals = written(_totals(docs, text_col, edges, patterns), "totals")
    graph = edges.join(totals, "p")
    # what can still reach LEAST: all mentions beside the pattern together
    alive = graph.groupBy("p").agg(F.sum("n").alias("n"), F.max("total").alias("total")).filter(F.col("n") >= LEAST * F.col("total"))
    graph = written(graph.join(written(alive.select("p"), "alive"), "p", "left_semi"), "graph")
    known = graph.filter(F.col("kind") < TOKEN).groupBy("p", "kind").agg(F.sum("n").alias("known"), F.max("total").alias("total"))
    known = written(known, "known")
    open_edges = graph.filter(F.col("kind") == TOKEN).select("p", "i", "n")
    scores = written(known.select("p", "kind", F.least(F.col("known") / F.col("total"), F.lit(1.0)).alias("score")), "scores")
    while True:
        # an instance is of a kind unless none of its patterns says so
        miss = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        instances = open_edges.join(scores, "p").groupBy("i", "kind").agg((1 - F.exp(miss)).alias("likely"))
        gained = open_edges.join(instances, "i").groupBy("p", "kind").agg(F.sum(F.col("n") * F.col("likely")).alias("gained"))
        share = F.least((F.col("known") + F.coalesce("gained", F.lit(0.0))) / F.col("total"), F.lit(1.0))
        before = scores.withColumnRenamed("score", "before")
        rated = known.join(gained, ["p", "kind"], "left").join(before, ["p", "kind"]).select("p", "kind", share.alias("score"), "before")
        rated = written(rated, "scores")
        scores = rated.select("p", "kind", "score")
        if (rated.agg(F.max(F.col("score") - F.col("before"))).first()[0] or 0.0) <= SETTLED:
            break
    sure = scores.filter(F.col("score") >= SURE).groupBy("p").agg(
        F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("of"), F.max("score").alias("score")
    )
    words = placed.filter(F.col("kind") == TOKEN).join(written(sure, "sure"), "p").filter(_plausible(F.col("of"), F.col("i")))
    return words.groupBy("row", "start", "stop").agg(F.min_by("of", F.struct(-F.col("score"), "of")).alias("kind"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, all, learned): spans as arrays of (start, kind, stop), ordered; one row per row of docs.

    Positions are code points, ends exclusive; kind is a place in KINDS. base has
    the base patterns' spans, all has those, long hexadecimal keys and the learned ones,
    which contexts discovered: words without the punctuation around them that can be of the kind (a card's digits
    pass their check, an address of digits has four parts up to 255, a phone has 7 to 15 digits). Null and empty texts
    have none. Ids may be null or repeat; each row has its own spans.
    """
    with scratch(docs.sparkSession) as keep:
        text = F.coalesce(name(text_col), F.lit(""))
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"), name(id_col).alias("id"), _matches(text).alias("found"), _around(text).alias("around")
        )
        rows = written(rows, "matches")  # fixes the row numbers
        hits = rows.filter("found IS NOT NULL").select("row", "around", F.explode("found").alias("x")).select(
            "row", "x.*", F.when(F.col("x.kind") == TOKEN, F.get("around", F.col("x.k"))).alias("around")
        )
        line = Window.partitionBy("row", "kind").orderBy("k")
        stop = F.sum(F.col("gap") + F.length("hit")).over(line.rowsBetween(Window.unboundedPreceding, 0))
        hits = hits.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("hit")).filter(_valid())
        # words that touch a seed are not for discovery; a seed stands beside what the words that it starts and ends in do
        is_seed = F.col("kind") < TOKEN
        by_start = Window.partitionBy("row").orderBy("start", F.desc("kind"))
        by_stop = Window.partitionBy("row").orderBy(F.desc("stop"), F.desc("kind"))
        so_far = (Window.unboundedPreceding, 0)
        first = F.last(F.when(~is_seed, F.col("around")), ignorenulls=True).over(by_start.rowsBetween(*so_far))
        last = F.last(F.when(~is_seed, F.col("around")), ignorenulls=True).over(by_stop.rowsBetween(*so_far))
        reach = F.max(F.when(is_seed, F.col("stop"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
        ahead = F.min(F.when(is_seed, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
        marked = hits.withColumns({"first": first, "last": last, "reach": reach, "ahead": ahead})
        free = is_seed | (
            (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("stop")) >= F.col("stop"))
        )
        around = F.struct("first.l2", "first.l1", "last.r1", "last.r2")
        bare = F.regexp_replace("hit", r"^[^\p{L}\p{N}@+]++", "")
        core = F.when(is_seed, F.col("hit")).otherwise(F.regexp_replace(bare, r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", ""))
        start = F.when(is_seed, F.col("start")).otherwise(F.col("stop") - F.length(bare))
        marked = marked.filter(free).select("row", "kind", start.alias("start"), core.alias("hit"), around.alias("around"))
        mentions = written(
            marked.select("row", "kind", "start", (F.col("start") + F.length("hit")).alias("stop"), "hit", _contexts().alias("contexts")), "mentions"
        )
        span = F.struct(F.col("start").cast("long").alias("start"), F.col("kind"), F.col("stop").cast("long").alias("stop"))
        spans = [mentions.filter(is_seed).select("row", span.alias("span"), (F.col("kind") < BASE).alias("base"), F.lit(False).alias("learned"))]
        more = _discovered(docs, text_col, mentions)
        if more is not None:
            spans.append(more.select("row", span.alias("span"), F.lit(False).alias("base"), F.lit(True).alias("learned")))
        grouped = reduce(DataFrame.union, spans).groupBy("row").agg(
            F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base"), F.array_sort(F.collect_list("span")).alias("all"),
            F.array_sort(F.collect_list(F.when(F.col("learned"), F.col("span")))).alias("learned"),
        )
        none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
        joined = rows.select("row", "id").join(grouped, "row", "left")
        return keep(
            joined.select(F.col("id").alias("doc_id"), *(F.coalesce(c, none).alias(c) for c in ("base", "all", "learned"))), "spans"
        )


def shown(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span's characters replaced by its kind in brackets; a span within an earlier one is part of it."""
    kinds = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        new = F.struct(
            F.concat(state["out"], before, F.lit("["), F.get(kinds, s["kind"]), F.lit("]")).alias("out"), s["stop"].alias("at")
        )
        return F.when(s["start"] >= state["at"], new).otherwise(
            F.struct(state["out"].alias("out"), F.greatest(state["at"], s["stop"]).alias("at"))
        )

    end = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(spans, start, step, end)
