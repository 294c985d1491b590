"""Benchmark decontamination by template windows, by built-in functions only.

A text becomes a template: numbers, names (capitals inside a sentence) and units after
numbers turn into typed placeholders, all else is lowered. Runs of ``window`` template
words are hashed and equi-joined with the windows of the benchmark. A document in which
enough windows of an item occur (they cover a share of its words, or a run of ``RUN`` words)
is held against the item's slots: where the item is laid over
the document, its values must each stand for one value of the document in nearly all slots, or most slots be unchanged. Equal
values make an exact copy, consistently changed ones a re-parameterised question; if the
values contradict each other in more slots wherever the item lies, there is no leak.

Items without telling windows (short ones, or mostly numbers and names) are looked for as a
whole: their words' sequence, in any case, is hashed and joined likewise. The first word of an
item also stands for itself where the document writes it as a name.

Documents' windows are generated in blocks, which carry the words that they span and no more, and joined in
one pass; only matches are shuffled, with the words of their windows, from which slots are judged. Ways in which an item lies over a document are
rows, not entries of one list, and equal ones count once, so a line that a document repeats costs
its repetitions and no more memory. The benchmark's windows are broadcast when their counted number is at most
``BROADCAST_ROWS``; beyond that hashes alone are shuffled, and words are fetched for what matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoflux.llm import exchange as ex
from annoflux.llm.storage import cut

WINDOW = 8
#: Share of an item's words (of those in telling windows) that the matched windows of a leak cover.
COVERAGE = 0.5
#: Words in a row that are a leak whatever their share of the item.
RUN = 13
#: Words other than placeholders that a window needs to tell anything.
SPOKEN = 4
BROADCAST_ROWS = 500_000
#: Windows that travel with one slice of a document's words.
BLOCK = 256
#: Share of slots that show their value's commonest meaning, or else the share that is unchanged, in a leak.
CONSISTENT = 0.9
UNCHANGED = 0.5

# Units that make a slot after a number.
UNITS = "mm cm m km mg g kg t ml l s sec seconds min minutes h hours days weeks months years percent dollars euros usd eur mph km/h kb mb gb °c °f inches feet miles pounds ounces".split()
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$"


def _worded(df: DataFrame) -> DataFrame:
    """Adds ``words`` (trimmed of punctuation, none empty) and ``template`` (the same places, canonical)."""
    raw = F.split(F.trim("text"), r"\s+")
    bare = df.withColumn("_raw", raw).withColumn("_core", F.transform("_raw", lambda x: F.regexp_replace(x, _EDGE, "")))
    before = F.concat(F.array(F.lit("")), F.slice("_raw", F.lit(1), F.size("_raw") - 1))
    placed = F.zip_with(
        F.col("_core"),
        before,
        lambda x, p: F.struct(
            x.alias("word"),
            F.when((x >= "0") & (x < ":"), "#number")
            .when(p.rlike("[0-9]$") & F.lower(x).isin(UNITS), "#unit")
            .when(x.rlike(r"^\p{Lu}") & p.rlike(r"[\p{L}\p{N},;)]$"), "#name")
            .otherwise(F.lower(x))
            .alias("as"),
        ),
    )
    solid = bare.withColumn("_placed", F.filter(placed, lambda s: s["word"] != ""))
    return solid.withColumns({"words": F.col("_placed.word"), "template": F.col("_placed.as")}).drop("_raw", "_core", "_placed")


def _chained(df: DataFrame, window: int) -> DataFrame:
    """Adds ``windows``: the hash of every run of ``window`` words, built from those of runs half as long."""
    return df.withColumn("_1", F.transform("template", lambda x: F.xxhash64(x))).transform(_joined, "_", window).withColumnRenamed(f"_{window}", "windows")


def _joined(df: DataFrame, prefix: str, window: int) -> DataFrame:
    """Adds column ``prefix`` + ``window``: hashes of runs of ``window`` places, from those of single places in ``prefix`` + 1."""
    length = 1
    while length < window:
        step = min(length, window - length)
        if f"{prefix}{length + step}" not in df.columns:
            level = F.col(f"{prefix}{length}")
            n = F.greatest(F.size(level) - step, F.lit(0))
            df = df.withColumn(f"{prefix}{length + step}", F.zip_with(F.slice(level, F.lit(1), n), F.slice(level, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)))
        length += step
    return df


def _spoken(df: DataFrame) -> DataFrame:
    """Adds ``w1``: the hash of every word in lower case."""
    return df.withColumn("w1", F.transform("words", lambda x: F.xxhash64(F.lower(x))))


def _covered(places: Column, window: int) -> Column:
    """Words that windows at ascending ``places`` cover."""
    start = F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(x - a["at"], F.lit(window))).alias("n")), lambda a: a["n"])


def _longest(places: Column, window: int) -> Column:
    """Words of the longest run of windows at ascending ``places``."""
    start = F.struct(F.lit(-2).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(x == a["at"] + 1, a["n"] + 1).otherwise(F.lit(window))
        return F.struct(x.alias("at"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    return F.aggregate(places, start, step, lambda a: a["best"])


def _blocks(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, k, uid, base, words, w): at most ``BLOCK`` windows with the words that they span, so that no later row carries a text."""
    n = F.size("windows")
    cuts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(BLOCK)))
    block = F.transform(
        cuts,
        lambda b: F.struct(
            b.alias("base"),
            F.slice("words", b + 1, F.lit(BLOCK + window - 1)).alias("words"),
            F.arrays_zip(F.slice("windows", b + 1, F.lit(BLOCK)).alias("hash"), F.slice(F.slice("w1", F.lit(1), n), b + 1, F.lit(BLOCK)).alias("word")).alias("w"),
        ),
    )
    # outer: else the optimiser tests the windows' number below all that makes them, and makes them twice
    return docs.select("doc_id", "k", "uid", F.explode_outer(block).alias("b")).select("doc_id", "k", "uid", "b.*").where("base IS NOT NULL")


def _matched(docs: DataFrame, needles: DataFrame, window: int, small: bool) -> DataFrame:
    """Windows of documents that are windows of items: the item's columns, shift and said (the window's words)."""
    blocks = _blocks(docs, window)
    here = F.transform(F.slice("words", F.col("j") + 1, window), lambda w: F.lower(w))
    item = [c for c in needles.columns if c not in ("hash", "first")]
    meant = F.col("first").isNull() | (F.col("first") == F.col("w.word"))
    if small:
        spread = blocks.select("doc_id", "k", "uid", "base", "words", F.posexplode_outer("w").alias("j", "w"))
        found = spread.join(F.broadcast(needles), F.col("w.hash") == F.col("hash")).where(meant)
    else:  # hashes alone meet the benchmark; words are fetched for what is found
        spread = blocks.select("k", "uid", "base", F.posexplode_outer("w").alias("j", "w"))
        found = spread.join(needles, F.col("w.hash") == F.col("hash")).where(meant).select("k", "uid", "base", "j", *item).distinct()
        found = found.join(blocks.select("doc_id", "k", "uid", "base", "words"), ["k", "uid", "base"])
    return found.select("doc_id", "k", "uid", *item, (F.col("base") + F.col("j") - F.col("item_at")).alias("shift"), here.alias("said"))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, item_at, hash, first, slots, n_windows, n_words) of each item's telling windows; slots: (place, kind, value).

    ``first`` is null, or the hash of the item's first word where the window has a name in its place. ``n_words``
    are the words that the windows cover.
    """
    items = _chained(_worded(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))), window)
    as_name = F.concat(F.array(F.lit("#name")), F.slice("template", F.lit(2), F.greatest(F.size("template") - 1, F.lit(0))))
    capital = F.get("words", F.lit(0)).rlike(r"^\p{Lu}") & ~F.get("template", F.lit(0)).startswith("#")
    turned = _chained(items.where(capital).withColumn("template", as_name).drop("windows", *[c for c in items.columns if c.startswith("_")]), window)
    turned = turned.select("item_id", F.lit(0).alias("item_at"), F.get("windows", F.lit(0)).alias("turned"))
    each = items.select("item_id", "words", "template", F.posexplode_outer("windows").alias("item_at", "hash")).where("hash IS NOT NULL")
    here = F.arrays_zip(F.slice("words", F.col("item_at") + 1, window).alias("word"), F.slice("template", F.col("item_at") + 1, window).alias("as"))
    slots = F.filter(
        F.transform(here, lambda s, j: F.struct((F.col("item_at") + j).alias("place"), s["as"].alias("kind"), F.lower(s["word"]).alias("value"))),
        lambda s: s["kind"].startswith("#"),
    )
    word = F.xxhash64(F.lower(F.get("words", F.lit(0))))
    telling = each.select("item_id", "item_at", "hash", word.alias("word"), slots.alias("slots")).where(F.size("slots") <= window - SPOKEN)
    counts = telling.groupBy("item_id").agg(F.count("*").alias("n_windows"), _covered(F.array_sort(F.collect_list("item_at")), window).alias("n_words"))
    both = F.array(F.struct("hash", F.lit(None).cast("long").alias("first")), F.struct(F.col("turned").alias("hash"), F.col("word").alias("first")))
    ways = telling.join(turned, ["item_id", "item_at"], "left").select("item_id", "item_at", "slots", F.explode(both).alias("way")).where("way.hash IS NOT NULL")
    return ways.select("item_id", "item_at", "way.hash", "way.first", "slots").join(counts, "item_id")


def whole_items(benchmark: DataFrame, telling: DataFrame) -> DataFrame:
    """(item_id, n, w1) of the items that have words and no telling window: number and hashes of their words."""
    items = _spoken(_worded(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))))
    return items.select("item_id", F.size("words").alias("n"), "w1").where("n > 0").join(telling.select("item_id").distinct(), "item_id", "left_anti")


def _found_whole(named: DataFrame, whole: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """Pairs of a document and an item whose words it has in a row, in any case; a row each, without places."""
    runs, needles = _spoken(_worded(named)), whole
    for n in lengths:
        runs, needles = _joined(runs, "w", n), _joined(needles, "w", n)
    different = lambda n: F.transform(F.array_distinct(f"w{n}"), lambda h: F.struct(F.lit(n).alias("n"), h.alias("hash")))
    key = F.concat(*[different(n) for n in lengths])
    found = runs.select("doc_id", "k", "uid", F.explode(key).alias("run")).select("doc_id", "k", "uid", "run.n", "run.hash")
    hashes = F.coalesce(*[F.when(F.col("n") == n, F.get(f"w{n}", F.lit(0))) for n in lengths])
    needles = needles.select("item_id", "n", hashes.alias("hash"))
    pairs = found.join(F.broadcast(needles) if small else needles, ["n", "hash"]).select("doc_id", "k", "uid", "item_id").distinct()
    one = F.lit(1).cast("long")
    return pairs.select("*", one.alias("n_windows"), one.alias("n_matched"), F.lit(1.0).alias("coverage"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs of a document and a benchmark item that it leaks.

    Returned, a row for each leaking row of ``docs`` and item: doc_id, item_id, n_matched (different windows of
    the item that occur), n_windows (of the item), coverage (the share of its words), n_slots and n_changed (placeholders, and those with
    another value than the item's), verdict (``exact``, ``near-exact`` for
    mostly unchanged slots of which some contradict, ``reparameterised``), k and uid (the row, as in exchange).
    An item found as a whole counts as one window.

    Null and empty texts leak nothing; items without words match nothing. Rows that repeat
    leak alike; a null doc_id stays null. Items that share a text are each reported. Other columns are ignored.
    """
    items = cut(benchmark_windows(benchmark, window))
    named = ex.named(docs)
    whole = cut(whole_items(benchmark, items))
    lengths = sorted(r.n for r in whole.select("n").distinct().collect())  # lengths of items, not items
    small = items.count() + whole.count() <= broadcast_rows
    needles = items.select("item_id", "item_at", "hash", "first", "n_windows", "n_words")
    pair = ["doc_id", "k", "uid", "item_id", "n_windows", "n_words"]
    matched = _matched(_spoken(_chained(_worded(named), window)), needles, window, small)
    # a way to lay the item over the document: places of the item with what the document says there; equal ways count once
    laid = matched.groupBy(*pair, "shift").agg(F.array_sort(F.collect_set(F.struct("item_at", "said"))).alias("places"))
    ways = cut(laid.groupBy(*pair, "places").agg(F.min("shift").alias("shift")))
    of_item = ways.select(*pair, _longest(F.col("places.item_at"), window).alias("run"), F.explode("places.item_at").alias("at")).groupBy(*pair).agg(F.array_sort(F.collect_set("at")).alias("ats"), F.max("run").alias("run"))
    pairs = (
        of_item.withColumn("covered", _covered(F.col("ats"), window))
        .where((F.col("covered") >= coverage * F.col("n_words")) | (F.col("run") >= RUN))
        .select("doc_id", "k", "uid", "item_id", "n_windows", F.size("ats").cast("long").alias("n_matched"), (F.col("covered") / F.col("n_words")).alias("coverage"))
    )
    if lengths:
        pairs = pairs.unionByName(_found_whole(named, whole, lengths, small))
    pairs = cut(pairs)
    # slots, only for pairs whose matched windows have any
    slotted = items.where(F.col("first").isNull() & (F.size("slots") > 0)).select("item_id", "item_at", F.explode("slots").alias("slot"))
    asked = (
        ways.join(pairs.select("k", "uid", "item_id"), ["k", "uid", "item_id"], "left_semi")
        .select("k", "uid", "item_id", "shift", F.explode("places").alias("p"))
        .select("k", "uid", "item_id", "shift", "p.item_at", "p.said")
        .join(slotted, ["item_id", "item_at"])
        .select("k", "uid", "item_id", "shift", "slot.kind", "slot.value", "slot.place", F.get("said", F.col("slot.place") - F.col("item_at")).alias("said"))
        .distinct()
    )
    by_meaning = asked.groupBy("k", "uid", "item_id", "shift", "kind", "value", "said").agg(F.count("*").alias("n"))
    by_value = by_meaning.groupBy("k", "uid", "item_id", "shift", "kind", "value").agg(
        F.sum("n").alias("n"), F.max("n").alias("agreed"), F.sum(F.when(F.col("said") != F.col("value"), F.col("n")).otherwise(0)).alias("changed")
    )
    laid = by_value.groupBy("k", "uid", "item_id", "shift").agg(F.sum("n").alias("n_slots"), F.sum("changed").alias("n_changed"), F.sum("agreed").alias("n_agreed"))
    agreed = F.col("n_agreed") == F.col("n_slots")
    kept = F.col("n_slots") - F.col("n_changed")
    leaked = (F.col("n_agreed") >= CONSISTENT * F.col("n_slots")) | (kept > UNCHANGED * F.col("n_slots"))
    # of the places where the item lies, the leaking one with most slots and fewest changes
    best = F.max(F.when(leaked, F.struct("n_slots", (-F.col("n_changed")).alias("kept"), "n_changed", (~agreed & (kept > UNCHANGED * F.col("n_slots"))).alias("near")))).alias("best")
    judged = laid.groupBy("k", "uid", "item_id").agg(best).withColumn("slotted", F.lit(True))
    out = pairs.join(judged, ["k", "uid", "item_id"], "left").where("slotted IS NULL OR best IS NOT NULL")
    n_changed = F.coalesce("best.n_changed", F.lit(0))
    return out.select(
        "doc_id",
        "item_id",
        "n_matched",
        "n_windows",
        "coverage",
        F.coalesce("best.n_slots", F.lit(0)).alias("n_slots"),
        n_changed.alias("n_changed"),
        F.when(F.col("best.near"), "near-exact").when(n_changed > 0, "reparameterised").otherwise("exact").alias("verdict"),
        "k",
        "uid",
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; null and empty texts leak nothing, repeated rows go or stay together."""
    own_k, own_uid = ex.free(docs, "k", "uid")
    found = leaks(docs, benchmark, **options).select(F.col("k").alias(own_k), F.col("uid").alias(own_uid)).distinct()
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(ex.LAST))
    uid = ex.uid_of(k, F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns({own_k: k, own_uid: uid}).join(found, [own_k, own_uid], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
