"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact verification.

A document is contaminated by an item if the 5-word shingles of a window of the item's size have a weighted
Jaccard similarity (a shingle weighs its number of occurrences) of 0.8 or more to the item's. Steps:

1. Such a window lacks fewer than a fifth of the item's shingles, so of any G = floor(S / 5) + 1 of its S
   shingles it holds one. The G with the longest words are the item's gate. One pass over the texts compares the
   hash of every shingle of theirs to those of all gates; no window that qualifies is lost.
2. Windows of the item's size lie so that a gate's shingle stands where it stands in the item, give or take the
   words that the similarity leaves room for; at a text's ends they are cut. Only texts with a gate's shingle are
   read for them, and a window is for the item of its gate, so there are no pairs of all windows and all items.
3. Every window has a 64-bit SimHash. Fingerprints are cut into RADIUS + 1 blocks, and windows and their items
   are joined on equal blocks: within the radius, one block at least is equal.
4. The pairs within the radius are verified by the exact similarity of their bags of shingles.

All of it is DataFrame operations. Hashes of gates are broadcast while they are GATES or fewer, and joined by a
shuffle beyond that. No text is shuffled, unless the texts with a gate's shingle are too many for their numbers to
be broadcast. A SimHash counts in lanes of 15 bits; windows of more shingles are verified directly.

Edge cases: null and blank texts and items match nothing; an item of fewer than 5 words is one shingle; A-Z are
lower-cased; documents are rows, by a number that is written with them, so rows that repeat a doc_id or have none
are found, and kept, by their own texts; rows that repeat an item_id are several texts of one item; of windows of
one content and one similarity the first place counts; empty tables give an empty result; further columns are
ignored, or carried along by `keep_clean`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usage_trace.llm.common import ROW, ascii_lower, numbered, scratch, staged, words

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 22
#: Gates whose hashes are broadcast.
GATES = 1 << 20
LANE = (1 << 15) - 1


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Of an array of words that is a plain column (as it is read once for each shingle)."""
    return F.when(F.size(w) <= k, F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " ")))


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), bag (shingles)."""
    w = staged(benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0), "items")
    return w.select("item_id", F.size("w").alias("n"), shingles(F.col("w")).alias("bag")).distinct()


def gates(items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """item, n, at (of a shingle in its item), h (the shingle's), k (its words); item is unique to a text, as item_id need not be."""
    longest = F.array_max(F.transform(F.split("shingle", " "), F.length))
    each = items.select("item", "n", F.size("bag").alias("s"), F.posexplode("bag").alias("at", "shingle"))
    own = F.struct((-longest).alias("l"), "shingle", "at")
    few = F.floor(F.col("s") * F.lit(1 - similar) + 1e-9).cast("int") + 1
    picked = each.groupBy("item", "n", "s").agg(F.array_sort(F.collect_list(own)).alias("all")).select("item", "n", F.explode(F.slice("all", F.lit(1), few)).alias("g"))
    return picked.select("item", "n", "g.at", F.split("g.shingle", " ").alias("w")).select("item", "n", "at", F.size("w").alias("k"), "w").select("item", "n", "at", "k", _hash(F.col("w"), F.lit(1), SHINGLE).alias("h"))


def _hash(w: Column, i: Column, k: int) -> Column:
    """Of the k words from the i-th (from 1) on; a word beyond the end adds nothing."""
    return F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(k)])


def placed(rows: DataFrame, gate: DataFrame, similar: float = SIMILAR, most: int = GATES) -> DataFrame:
    """ROW, item, n, first (where a window begins, from 1; it may be before the text): all windows that a gate's shingle allows."""
    lengths = [r["k"] for r in gate.select("k").distinct().collect()]  # 5 at most
    few, slack = gate.count() <= most, (1 - similar) / (1 + similar)
    found = None
    for k in sorted(lengths):
        hashes = _let(words(ascii_lower(F.col("text"))), lambda t: F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: _hash(t, i, k))))  # noqa: B023
        own = gate.where(F.col("k") == k).select("item", "n", "at", "h")
        met = rows.select(ROW, F.posexplode(hashes).alias("p", "h")).join(F.broadcast(own) if few else own, "h")
        met = met.select(ROW, "item", "n", (F.col("p") + 1 - F.col("at")).alias("at"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"{ROW} long, item long, n int, first int")
    room = F.floor(F.greatest(F.lit(1), F.col("n") - (SHINGLE - 1)) * F.lit(slack)).cast("int")
    return found.distinct().select(ROW, "item", "n", F.explode(F.sequence(F.col("at") - room, F.col("at") + room)).alias("first")).distinct()


def windows(rows: DataFrame, gate: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """window, ROW, item, n, start, bag: distinct contents in each row, each with its first place."""
    places = staged(placed(rows, gate, similar).groupBy(ROW).agg(F.collect_list(F.struct("item", "n", "first")).alias("places")), "places")

    def cut(t: Column) -> Column:
        start, last = lambda x: F.greatest(F.lit(1), x["first"]), lambda x: F.least(F.size(t), x["first"] + x["n"] - 1)
        inside = F.filter("places", lambda x: last(x) >= start(x))
        return F.transform(inside, lambda x: F.struct(x["item"].alias("item"), x["n"].alias("n"), start(x).alias("start"), F.slice(t, start(x), last(x) - start(x) + 1).alias("w")))

    each = rows.join(places, ROW).select(ROW, F.explode(_let(words(ascii_lower(F.col("text"))), cut)).alias("x")).select(ROW, "x.*")
    made = each.groupBy(ROW, "item", "n", "w").agg(F.min("start").alias("start"))
    made = staged(made.withColumn("window", F.monotonically_increasing_id()), "windows")
    return made.select("window", ROW, "item", "n", "start", shingles(F.col("w")).alias("bag"))


def simhash(bags: DataFrame, key: list[str]) -> DataFrame:
    """key and fp for rows of key and bag: a bit is 1 if set in over half of the XXH64 of the shingles."""
    h = F.col("h")
    bit = lambda b: F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long"))
    lanes = [F.sum(reduce(Column.bitwiseOR, [F.shiftleft(bit(4 * j + i), 16 * i) for i in range(4)])).alias(f"l{j}") for j in range(16)]
    sums = bags.where(F.size("bag") <= LANE).select(*key, F.explode("bag").alias("s")).select(*key, F.xxhash64("s").alias("h")).groupBy(*key).agg(F.count("*").alias("m"), *lanes)
    one = lambda b: F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
    none = F.lit(0).cast("long")
    bits = [F.when(F.shiftright(f"l{b // 4}", 16 * (b % 4)).bitwiseAND(F.lit(0xFFFF).cast("long")) * 2 > F.col("m"), one(b)).otherwise(none) for b in range(64)]
    return sums.select(*key, reduce(Column.bitwiseOR, bits).alias("fp"))


def _blocks(radius: int) -> Column:
    """(number, value) of each block of fp."""
    ends = [64 * i // (radius + 1) for i in range(radius + 2)]
    cut = lambda a, b: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.explode(F.array(*[F.struct(F.lit(i).alias("b"), cut(a, b).alias("v")) for i, (a, b) in enumerate(zip(ends, ends[1:]))]))


def candidates(of_windows: DataFrame, of_items: DataFrame, radius: int = RADIUS, on: str = "n") -> DataFrame:
    """window, item: all pairs of rows of window, on, fp and item, on, fp that agree in on and whose fingerprints differ in radius bits or fewer."""
    key = lambda df: df.select("*", _blocks(radius).alias("k")).withColumn("key", F.struct(F.col(on).alias("on"), "k.b", "k.v"))
    left = key(of_windows).select("window", F.col("fp").alias("wfp"), "key")
    right = key(of_items).select("item", F.col("fp").alias("ifp"), "key")
    return left.join(right, "key").where(F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= radius).select("window", "item").distinct()


def contaminated_rows(rows: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """ROW, item_id, similarity (the best window's), start (its first word, from 0), for numbered rows of text."""
    items = staged(items_of(benchmark).withColumn("item", F.monotonically_increasing_id()), "bags")
    gate = staged(gates(items, similar), "gates")
    made = staged(windows(rows.where("text IS NOT NULL").select(ROW, "text"), gate, similar), "window-bags")
    pairs = candidates(simhash(made, ["window", "item"]), simhash(items, ["item"]), radius, "item")
    large = made.where(F.size("bag") > LANE).select("window", "item")
    pairs = staged(pairs.unionByName(large), "candidates")
    bag = lambda df, key, n: df.select(key, F.size("bag").alias(n), F.explode("bag").alias("s")).groupBy(key, n, "s").agg(F.count("*").alias(f"c_{key}"))
    shared = pairs.join(bag(made, "window", "nw"), "window").join(bag(items, "item", "ni"), ["item", "s"])
    both = shared.groupBy("window", "item", "nw", "ni").agg(F.sum(F.least("c_window", "c_item")).alias("m"))
    verified = both.select("window", "item", (F.col("m") / (F.col("nw") + F.col("ni") - F.col("m"))).alias("similarity")).where(F.col("similarity") >= similar)
    named = verified.join(made.select("window", ROW, "start"), "window").join(items.select("item", "item_id"), "item")
    best = F.max_by(F.struct("similarity", (F.col("start") - 1).alias("start")), F.struct("similarity", -F.col("start")))
    return named.groupBy(ROW, "item_id").agg(best.alias("best")).select(ROW, "item_id", "best.similarity", "best.start")


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start: a row for each document and item found in it."""
    rows = numbered(docs.select("doc_id", "text"))
    with scratch():
        found = staged(contaminated_rows(rows, benchmark, similar, radius), "found", outlives=True)
    return rows.select(ROW, "doc_id").join(found, ROW).select("doc_id", "item_id", "similarity", "start")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item."""
    rows = numbered(docs)
    with scratch():
        found = staged(contaminated_rows(rows, benchmark).select(ROW).distinct(), "found", outlives=True)
    return rows.join(found, ROW, "left_anti").select(*docs.columns)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
