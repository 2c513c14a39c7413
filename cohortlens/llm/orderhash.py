"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of `k` words. Each occurrence is numbered among the equal k-mers of the text, so repeats count, and hashed with its
number. Each of `bins` sketches has a permutation of its own, the hash less the sketch's share of the whole range (so one hash and one sort serve
all); the `pick` smallest of all k-mers under it are kept, put back into the order of the text, and hashed together. In a long text they lie in
the sketch's own bin, in a short one they come from the next bins, so it keeps an order, too. Two texts agree in a bin only if the same k-mers
come in the same order, so the share of agreeing bins falls with the edit distance.

All steps are array functions on one row: sorting brings equal k-mers together, and the lengths of their runs give the occurrence numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

K, PICK, BIN_BITS = 2, 2, 6
BUCKET_ROWS = 2000
MOST_BUCKETS = 1 << 16


def _runs(df: DataFrame, array: str, same: Callable[[Column], Column], out: str) -> DataFrame:
    """Adds `out`: the places (from 0) at which a new value of `same` begins in a sorted array."""
    n = F.size(array)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    begins = lambda j: (j == 0) | (same(F.get(array, j)) != same(F.get(array, j - 1)))
    return df.withColumn(out, F.filter(places, begins))


def sketch(df: DataFrame, text: str, out: str, k: int = K, pick: int = PICK, bin_bits: int = BIN_BITS) -> DataFrame:
    """Adds `out`: one string `bbhhhhhhhh` (bin and 32 bits of the tuple's hash, in hexadecimal digits) per bin, none without k-mers.

    Words are separated by space and 09 to 0D; a text of fewer than `k` words is one k-mer, a text without words has none. Null is empty.
    """
    names = {n: f"__{out}_{n}" for n in ("words", "w", "h", "s", "r", "o", "g", "b")}
    n = lambda name: F.col(names[name])
    split = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn(names["words"], split).withColumn(names["w"], F.transform(names["words"], lambda w: F.xxhash64(w)))
    size = F.size(names["w"])
    mers = n("w")
    for j in range(1, k):
        shorter = F.slice(mers, 1, F.greatest(size - j, F.lit(0)))
        mers = F.zip_with(shorter, F.slice(n("w"), j + 1, F.greatest(size - j, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    mers = F.when(size >= k, mers).when(size > 0, F.array(F.xxhash64(n("w")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(names["h"], mers)
    df = df.withColumn(names["s"], F.sort_array(F.transform(n("h"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = _runs(df, names["s"], lambda e: e["h"], names["r"])
    ends = lambda start, at, runs, whole: F.coalesce(F.get(runs, at + 1), F.size(whole)) - start
    number = F.flatten(F.transform(n("r"), lambda s, x: F.sequence(F.lit(0), ends(s, x, n("r"), n("s")) - 1)))
    df = df.withColumn(names["o"], number)
    df = df.withColumn(names["g"], F.sort_array(F.zip_with(
        n("s"), n("o"), lambda e, o: F.struct(F.xxhash64(e["h"], o).alias("g"), e["i"].alias("i"))
    )))
    # Equal first bits are next to each other, as the hashes are sorted.
    bin_of = lambda e: F.shiftright(e["g"], 64 - bin_bits)
    df = _runs(df, names["g"], bin_of, names["b"])

    of_bin = lambda start: bin_of(F.get(n("g"), start)) + (1 << (bin_bits - 1))
    # The first place of the sorted hashes that a sketch looks at: that of its own bin, or of the next one with k-mers; after the last the first.
    begins = F.flatten(F.transform(n("b"), lambda start, at: F.array_repeat(
        start, (of_bin(start) - F.coalesce(of_bin(F.get(n("b"), at - 1)), F.lit(-1))).cast("int")
    )))
    size = F.size(n("g"))
    last = F.lit((1 << bin_bits) - 1) - of_bin(F.get(n("b"), F.size(n("b")) - 1))
    begins = F.when(size > 0, F.concat(begins, F.array_repeat(F.lit(0), last.cast("int")))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(names["b"], begins)
    # Bound by a transform of one element: a column that only a lambda uses would be computed again for each sketch.
    whole = F.struct(F.concat(n("g"), F.slice(n("g"), 1, pick)).alias("e"), F.least(F.lit(pick), F.size(n("g"))).alias("take"))

    def signed(held: Column, start: Column, place: Column) -> Column:
        picked = F.transform(F.slice(held["e"], start + 1, held["take"]), lambda e: F.struct(e["i"].alias("i"), e["g"].alias("g")))
        ordered = F.transform(F.sort_array(picked), lambda e: e["g"])
        mark = F.xxhash64(ordered).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        return F.concat(F.lpad(F.lower(F.hex(place)), 2, "0"), F.lpad(F.lower(F.hex(mark)), 8, "0"))

    marks = F.transform(F.array(whole), lambda held: F.transform(n("b"), lambda start, place: signed(held, start, place)))
    return df.withColumn(out, F.get(marks, F.lit(0))).drop(*names.values())


def likeness(a: Column, b: Column) -> Column:
    """Bins that agree, over bins that either text uses; two texts without words are alike."""
    bins = lambda s: F.transform(s, lambda t: F.substring(t, 1, 2))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def with_next(rows: DataFrame, key: str, ties: list[str], carried: list[str], name: str) -> DataFrame:
    """Adds a struct `name` of `carried` from the next row by falling key; after the last row comes the first.

    Rows are cut into key ranges at quantiles that are keys themselves. The row of such a key opens its range, so it is sent as a guest
    to the range above as well, and the largest key to the lowest range: each range then knows its rows' neighbours. One shuffle.
    `key` must be a number and not null.
    """
    count = rows.count()
    parts = max(1, min(MOST_BUCKETS, -(-count // BUCKET_ROWS)))
    shares = [i / parts for i in range(1, parts)] + [1.0]
    found = rows.agg(F.percentile_approx(key, shares, max(10_000, 10 * parts)).alias("p"), F.max(key).alias("m")).first()
    bounds = sorted({*(found.p or []), found.m} - {None}) or [0]
    width = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    of = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    below = lambda values: F.size(F.filter(values, lambda x: x < F.col(key)))
    staged = rows.withColumn("__chunk", below(of([c[-1] for c in chunks])))
    staged = staged.withColumn("__in", F.get(F.array(*[of(c) for c in chunks]), F.col("__chunk")))
    staged = staged.withColumn("__range", F.col("__chunk") * width + below(F.col("__in")))
    opens = F.exists("__in", lambda x: x == F.col(key))
    above = F.pmod(F.col("__range") + 1, F.lit(len(bounds)))
    own = F.struct(F.col("__range").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(above.alias("at"), F.lit(True).alias("guest"))
    sent = staged.withColumn("__to", F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own))))
    flat = sent.select(*rows.columns, F.col("__to.at").alias("__at"), F.col("__to.guest").alias("__guest"))
    order = W.partitionBy("__at").orderBy("__guest", F.desc(key), *ties)
    return flat.withColumn(name, F.lead(F.struct(*carried)).over(order)).filter(~F.col("__guest")).drop("__at", "__guest")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike the first is to the second and to the next document's.

    The edited text has its last third (code points, rounded down) replaced by as many first code points of the next document by falling
    key, or all of them. Null keys come last, rows of one key by a hash of the text; null texts are empty. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    near = with_next(sketch(rows, "text", "mark"), "at", ["tie"], ["text", "mark"], "next")
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    cut = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), size - third), F.substring(F.col("next.text"), F.lit(1), third)))
    done = sketch(cut, "edited", "edited_mark")
    return done.select(
        F.col("id").alias(key), size.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.array_join("mark", "").alias("fingerprint"), F.array_join("edited_mark", "").alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next.mark")).alias("near_next"),
    )
