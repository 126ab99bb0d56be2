"""Benchmark passages in documents, verbatim or with other numbers, names and units.

Texts are canonicalised to templates: numbers, units and names become typed slots.
Windows of template words are joined by hash; what fills the slots on both sides
must then be consistent, one benchmark value standing for one document value
throughout the passage.  Everything is in DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import keep

WINDOW = 8
#: Words of a window that must not be slots, and words below which an item is too short to look for.
LEAST_PLAIN, LEAST_ITEM = 3, 3
#: Windows of the benchmark up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 500_000

UNITS = "kilometers?|kilometres?|meters?|metres?|miles?|inch(?:es)?|feet|km|cm|mm|kg|grams?|mg|lbs?|pounds?|tons?|liters?|litres?|ml|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?"
NUMBER, UNIT, NAME, FIRST = "0n", "0u", "0p", "0q"


def words(text: Column) -> Column:
    """Lower-case words; a slot's word starts with its type: 0n (number), 0u (unit) or 0p (name).

    A name is a capitalised word inside a sentence.  One at the start of a sentence
    may be a name, or any word: it starts with 0q.  No other word has a digit, so
    none starts like these.
    """
    numbers = F.regexp_replace(text, "(?<=\\d)[.,](?=\\d)", "")
    numbers = F.regexp_replace(numbers, "[$€£]\\x20?(?=\\d)", f" {UNIT} ")
    numbers = F.regexp_replace(numbers, f"(\\d)[\\x20-]?({UNITS})\\b", f"$1 {UNIT}$2")
    numbers = F.regexp_replace(numbers, f"(?<![\\p{{L}}\\d])(?!0[u])(\\d+)", f" {NUMBER}$1 ")
    marked = F.when(text.rlike("[0-9$€£]"), numbers).otherwise(text)
    marked = F.regexp_replace(marked, "(?<=[\\p{Ll}\\d,;]\\x20)(?=\\p{Lu}\\p{Ll})", NAME)
    marked = F.regexp_replace(marked, "(?<![\\p{L}\\p{N}])(?=\\p{Lu}\\p{Ll})", FIRST)
    return F.array_remove(F.split(F.lower(marked), "[^\\p{L}\\p{N}]+"), "")


def named(tokens: Column) -> Column:
    """Words with each first word of a sentence settled: a name if it is one elsewhere in
    the text, or starts several sentences and is never in lower case; else any word."""
    bare = lambda kind: F.transform(F.filter(tokens, lambda t: F.startswith(t, F.lit(kind))), lambda t: F.substring(t, 3, 1 << 30))

    def names(firsts: Column) -> Column:
        several = F.filter(firsts, lambda t, i: (i > 0) & (t == F.get(firsts, i - 1)))
        return F.array_union(F.array_intersect(firsts, bare(NAME)), F.array_except(several, tokens))

    def settled(known: Column) -> Column:
        # known names dealt by hash into about as many parts as a part has names: looking one up reads one part
        parts = F.greatest(F.ceil(F.sqrt(F.size(known))), F.lit(1)).cast("int")
        part = lambda t: F.pmod(F.hash(t), parts)
        dealt = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.filter(known, lambda t: part(t) == k))
        return F.get(F.transform(F.array(dealt), lambda of: F.transform(tokens, lambda t: F.when(~F.startswith(t, F.lit(FIRST)), t).otherwise(resolved(t, of, parts)))), F.lit(0))

    def resolved(token: Column, dealt: Column, parts: Column) -> Column:
        word = F.substring(token, 3, 1 << 30)
        return F.when(F.array_contains(F.get(dealt, F.pmod(F.hash(word), parts)), word), F.concat(F.lit(NAME), word)).otherwise(word)

    once = F.transform(F.array(F.array_sort(bare(FIRST))), names)
    return F.get(F.transform(once, settled), F.lit(0))


def _is_slot(word: Column) -> Column:
    return F.startswith(word, F.lit("0"))


def template(tokens: Column) -> Column:
    """A hash of each word, of its type alone for a slot."""
    return F.transform(tokens, lambda t: F.xxhash64(F.when(_is_slot(t), F.substring(t, 1, 2)).otherwise(t)))


def _windows(shape: Column, slots: Column, size: int) -> Column:
    """(at, size, window, slots) of each window of ``size`` words: its hash, and what fills its slots.

    ``slots`` has null for a word that is none, and is null itself if no word is one.
    """
    last = F.size(shape) - size + 1
    window = lambda i: [(i - 1).alias("at"), F.lit(size).alias("size"), F.xxhash64(F.lit(size), F.slice(shape, i, size)).alias("window")]
    filled = lambda i: F.filter(F.slice(slots, i, size), lambda t: t.isNotNull()).alias("slots")
    none = F.array().cast("array<string>").alias("slots")
    every = F.sequence(F.lit(1), last)
    made = F.when(slots.isNotNull(), F.transform(every, lambda i: F.struct(*window(i), filled(i)))).otherwise(F.transform(every, lambda i: F.struct(*window(i), none)))
    return F.when(last > 0, made).otherwise(F.from_json(F.lit("[]"), "array<struct<at:int,size:int,window:bigint,slots:array<string>>>"))


def leak_classes(docs: DataFrame, benchmark: DataFrame, least_words: int = 10, least_share: float = 0.3, enough_words: int = 25, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(held, passages): the stretches that rows of ``docs`` hold, and the benchmark passages in each class of stretches.

    A stretch is a row's windows that some item has too, cut where none starts for
    longer than the longest item.  Stretches of the same windows, slots and distances
    are one class, so that a sentence of many items in many documents is compared with
    its items once.  ``held`` (id_col, place, class) has each row's stretches, those
    without a passage included; ``passages`` (class, item_col, at, n_words, share, kind,
    slots) what the classes hold, ``at`` counted from where the stretch starts.

    Windows on one alignment of stretch and item are a run, which counts if its slots
    are consistent.  Runs of an item that stand no further apart than it is long are
    one passage (words put in or left out shift the alignment): ``n_words`` of its words
    lie in common windows, ``share`` of the item.  A passage counts with ``least_words``
    words (or all of a shorter item) and ``least_share``, or with ``enough_words``.
    ``kind`` is ``verbatim`` when all slots are equal too, else ``template``; ``slots``
    has the (item, document) pairs.

    Null and empty texts and items of fewer than LEAST_ITEM words match nothing; an
    item shorter than a window is looked for as a whole.  Equal items give a row
    each, as do passages that a document repeats; rows of equal id and text count
    once; a null id is an id.  Extra columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col("text")).alias("tokens")).distinct()
    # items of equal words are one, until the end
    items = keep(items.where(F.size("tokens") >= LEAST_ITEM).withColumn("of", F.min("item").over(Window.partitionBy("tokens"))), "items")
    equal = items.select(F.col("item").alias("each"), "of")
    items = items.where(F.col("item").eqNullSafe(F.col("of"))).select("item", "tokens", F.size("tokens").alias("item_size"))
    by_size = items.groupBy(F.least("item_size", F.lit(WINDOW)).alias("size")).agg(F.max("item_size").alias("longest")).orderBy("size").collect()  # at most WINDOW rows
    # an empty benchmark goes the same way, with windows that nothing joins
    sizes = [r["size"] for r in by_size] or [WINDOW]
    longest = max((r["longest"] for r in by_size), default=0)
    theirs = items.withColumn("size", F.least("item_size", F.lit(WINDOW))).select("item", "item_size", "size", "tokens", F.explode(F.expr("sequence(0, item_size - size)")).alias("item_at"))
    theirs = theirs.withColumn("tokens", F.slice("tokens", F.col("item_at") + 1, F.col("size")))
    # with each choice of the first words of sentences that are names: a document has settled on one
    theirs = theirs.withColumn("firsts", F.array_distinct(F.filter("tokens", lambda t: F.startswith(t, F.lit(FIRST)))))
    theirs = theirs.select("*", F.explode(F.expr("sequence(0, cast(pow(2, size(firsts)) as int) - 1)")).alias("choice"))
    chosen = lambda t: F.expr("choice").bitwiseAND(F.pow(F.lit(2), F.array_position("firsts", t) - 1).cast("int")) > 0
    settle = lambda t: F.when(~F.startswith(t, F.lit(FIRST)), t).otherwise(F.concat(F.when(chosen(t), F.lit(NAME)).otherwise(F.lit("")), F.substring(t, 3, 1 << 30)))
    theirs = theirs.withColumn("tokens", F.transform("tokens", settle))
    theirs = theirs.select("item", "item_size", "item_at", F.xxhash64("size", template(F.col("tokens"))).alias("window"), F.filter("tokens", _is_slot).alias("item_slots"), "size")
    theirs = keep(theirs.where(F.col("size") - F.size("item_slots") >= F.least(F.lit(LEAST_PLAIN), F.col("size"))).drop("size").distinct(), "windows")
    few = theirs.count() <= broadcast_windows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("tokens"))
    rows = rows.select("id", "row", named(F.col("tokens")).alias("tokens"))
    slots = F.when(F.exists("tokens", _is_slot), F.transform("tokens", lambda t: F.when(_is_slot(t), t)))
    rows = rows.select("id", "row", template(F.col("tokens")).alias("shape"), slots.alias("slots"))
    # a row has its window's hash and slots alone, whichever join moves it
    every = F.concat(*[_windows(F.col("shape"), F.col("slots"), size) for size in sizes])
    rows = rows.select("id", "row", F.explode(every).alias("w")).select("id", "row", "w.at", "w.size", "w.window", "w.slots")
    known = theirs.select("window").distinct()
    hits = keep(rows.join(F.broadcast(known) if few else known, "window", "left_semi"), "hits")
    along = Window.partitionBy("id", "row").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(along) > longest, F.lit(False))
    held = hits.withColumn("stretch", F.sum(apart.cast("int")).over(along)).groupBy("id", "row", "stretch").agg(F.min("at").alias("place"), F.array_sort(F.collect_set(F.struct("at", "size", "window", "slots"))).alias("hits"))
    held = held.withColumn("hits", F.transform("hits", lambda h: F.struct((h["at"] - F.col("place")).alias("at"), h["size"].alias("size"), h["window"].alias("window"), h["slots"].alias("slots"))))
    held = keep(held.select("id", "place", "hits", F.md5(F.to_json("hits").cast("binary")).alias("class")), "stretches")
    found = held.groupBy("class").agg(F.first("hits").alias("hits")).select("class", F.inline("hits"))
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    found = found.join(F.broadcast(theirs) if few else theirs, "window").select("class", "item", "item_size", "at", "item_at", "size", pairs.alias("pairs"))
    # a group has at most a row for each window of its item
    runs = found.groupBy("class", "item", (F.col("at") - F.col("item_at")).alias("line")).agg(
        F.max("item_size").alias("item_size"), F.min("at").alias("place"), F.array_sort(F.collect_set("item_at")).alias("at"), F.max("size").alias("size"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("slots")
    )
    steady = F.size(F.array_distinct(F.transform("slots", lambda p: p["item"]))) == F.size("slots")
    near = Window.partitionBy("class", "item").orderBy("place", "line")
    apart = F.coalesce(F.col("place") - F.lag("place").over(near) > F.col("item_size"), F.lit(True))
    runs = runs.where(steady).withColumn("passage", F.sum(apart.cast("int")).over(near))
    passages = runs.groupBy("class", "item", "passage").agg(
        F.max("item_size").alias("item_size"), F.min("place").alias("place"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.max("size").alias("size"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
    )
    covered = F.aggregate(
        F.col("at"), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.col("size"), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"],
    )
    passages = passages.withColumn("n_words", covered).withColumn("share", F.col("n_words") / F.col("item_size"))
    long = (F.col("n_words") >= F.least(F.lit(least_words), F.col("item_size"))) & (F.col("share") >= least_share) | (F.col("n_words") >= enough_words)
    kind = F.when(F.forall("slots", lambda p: p["item"] == p["doc"]), "verbatim").otherwise("template")
    passages = passages.where(long).join(equal, F.col("item").eqNullSafe(F.col("of")))
    passages = passages.select("class", F.col("each").alias(item_col), F.col("place").alias("at"), "n_words", F.round("share", 6).alias("share"), kind.alias("kind"), "slots")
    return held.select(F.col("id").alias(id_col), "place", "class").distinct(), keep(passages, "passages")


def leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 10, least_share: float = 0.3, enough_words: int = 25, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id_col, item_col, place, n_words, share, kind, slots): each row's benchmark passages, the first word at ``place``.

    Every row with every item it shares a passage with: where many items share a
    sentence that many documents hold, ``leaks_by_class`` says the same in fewer rows.
    """
    held, passages = leak_classes(docs, benchmark, least_words, least_share, enough_words, id_col, text_col, item_col, broadcast_windows)
    return held.join(passages, "class").select(id_col, item_col, (F.col("place") + F.col("at")).alias("place"), "n_words", "share", "kind", "slots")


def leaks_by_class(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **limits: float) -> DataFrame:
    """``leaks`` without multiplying the items of a class by its documents.

    Each row and stretch that holds a passage has one row here with the passage of most
    words (then of the largest share, the smallest item, the first place).  ``n_passages``
    says how many its class has, ``same_as`` whose rows list them all: the smallest id of
    the class (null if all are), where ``rank`` counts them from 1.
    """
    held, passages = leak_classes(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, **limits)
    of = Window.partitionBy("class")
    ranked = passages.withColumn("rank", F.row_number().over(of.orderBy(F.desc("n_words"), F.desc("share"), item_col, "at"))).withColumn("n_passages", F.count(F.lit(1)).over(of))
    first = held.groupBy("class").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), id_col, "place")).alias("first"))
    one = held.join(ranked.where("rank = 1"), "class")
    others = first.select("class", f"first.{id_col}", "first.place").join(ranked.where("rank > 1"), "class")
    made = one.unionByName(others).join(first.select("class", F.col(f"first.{id_col}").alias("same_as")), "class")
    return made.select(id_col, item_col, (F.col("place") + F.col("at")).alias("place"), "n_words", "share", "kind", "slots", "rank", "n_passages", "same_as", "class")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, in which no benchmark passage was found; rows with a null id stay."""
    held, passages = leak_classes(docs, benchmark, id_col=id_col, text_col=text_col)
    bad = held.join(passages.select("class").distinct(), "class", "left_semi").select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return docs.join(keep(bad, "leaking"), id_col, "left_anti").select(*docs.columns)
