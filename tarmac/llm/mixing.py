"""Mixing sources to target weights with a multivariate-hypergeometric
splitting tree.

1. Targets: sources in code-point order (null last) weigh ``weights``,
   repeating, and share ``share`` times all words. A target stops at
   ``most`` times its source's size; the excess is reshared by weight until
   none is above. (One row per source; the level that the open sources share
   comes from running sums over them.)
2. Blocks: a document's hash places it in one of at most ``MAX_BLOCKS``
   blocks of its source; blocks in order are a random permutation. A source
   takes whole epochs of all its blocks, then blocks in order up to the
   block in which the target ends. That block is cut again by further bits of
   the hash, and in its last piece (about ``BLOCK_DOCS`` documents) those
   documents are chosen, largest first, that still fit.
3. Splitting tree: the numbers of drawn blocks per source (the exact quotas)
   are divided between the two halves of the output shards by multivariate
   hypergeometric draws, and so on down to single shards. Each shard then owns
   a range of every source's permuted block draws, disjoint from the others'.
4. Inside a shard, rows are shuffled by a hash.

All randomness is hashes of the seed, so reruns agree. What grows with the
documents is grouped by (source, block); per source at most MAX_BLOCKS rows
meet in one task. Rows per source go to the documents by broadcast while the
size of all of them, which is measured, is below ``BROADCAST_BYTES``; beyond
that by shuffle joins, whose hot keys have one row on the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import cut, word_count

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SHARDS, MAX_SHARDS = 64, 1 << 14    # powers of two
SHARD_WORDS = 1 << 27               # aimed size of a shard beyond SHARDS of them
MAX_BLOCKS = 1 << 14                # per source; with _BITS below 63 bits
BROADCAST_BYTES = 16 << 20          # of the rows per source
BLOCK_DOCS = 64
SEED = 20240607
_BITS = 48           # of the hash that orders documents


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, one row each) with number and target.

    Sources by ascending cap per weight: the running sums say at which level
    the shared rest would lie if exactly the sources before had stopped; the
    first source above that level is the first open one.
    """
    cap, weight = F.col("source_size").cast("double") * most, F.col("weight")
    numbered = (sources.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
                .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))))
    order = Window.orderBy(cap / weight, "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
             / F.sum(weight).over(after))
    levels = numbered.withColumn("level", level).withColumn("open", F.col("level") * weight < cap)
    shared = F.min(F.when(F.col("open"), F.struct((cap / weight).alias("at"), "number", "level"))).over(whole)["level"]
    return levels.select(*sources.columns, "number", F.when(F.col("open"), F.least(shared * weight, cap)).otherwise(cap).alias("target"))


def _blocks(docs_in: Column) -> Column:
    return F.least(F.greatest(F.ceil(docs_in / BLOCK_DOCS), F.lit(1)), F.lit(MAX_BLOCKS)).cast("long")


def _place(fraction: Column, blocks: Column) -> tuple[Column, Column]:
    """Block of a fraction in [0, 2^48), and the fraction inside the block."""
    scaled = fraction * blocks
    return F.shiftright(scaled, _BITS), scaled.bitwiseAND(F.lit((1 << _BITS) - 1))


def _ends(rows: DataFrame) -> DataFrame:
    """Of rows (number, block, size, left): per source the block in which the
    sum of sizes passes ``left``, its documents and what is left there.
    Without such a block, one behind the last."""
    upto = F.sum("words").over(Window.partitionBy("number").orderBy("block"))
    sums = (rows.groupBy("number", "block", "left").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
            .withColumn("upto", upto))
    end = F.min(F.when(F.col("upto") > F.col("left"), F.struct("block", "docs", (F.col("left") - F.col("upto") + F.col("words")).alias("left"))))
    return sums.groupBy("number").agg(end.alias("e"), F.max("block").alias("highest")).select(
        "number", F.coalesce("e.block", F.col("highest") + 1).alias("end"), F.coalesce("e.docs", F.lit(0)).alias("end_docs"),
        F.coalesce("e.left", F.lit(0.0)).alias("end_left"))


def _uniform(*what) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*what), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Inverse distribution function at ``u`` of the number of good ones among
    ``drawn`` of ``total``. Walks 12 standard deviations around the mode
    (less than 1e-15 of the mass lies outside) with the ratio of neighbours."""
    low = F.greatest(F.lit(0), drawn + good - total)
    high = F.least(drawn, good)
    mode = F.floor((drawn + 1).cast("double") * (good + 1) / (total + 2))
    var = drawn.cast("double") * good / F.greatest(total, F.lit(1)) * (1 - drawn.cast("double") / F.greatest(total, F.lit(1)))
    reach = F.ceil(F.sqrt(F.greatest(var, F.lit(0.0))) * 12) + 12
    first = F.greatest(low, F.least(mode, high) - reach).cast("long")
    last = F.least(high, F.greatest(mode, low) + reach).cast("long")
    start = F.struct(F.lit(1.0).alias("w"), F.array(F.lit(1.0)).alias("sums"))

    def further(s, k):
        w = s["w"] * (good - k + 1) * (drawn - k + 1) / (k * (total - good - drawn + k))
        return F.struct(w.alias("w"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + w)).alias("sums"))

    steps = F.when(last > first, F.sequence(first + 1, last)).otherwise(F.array().cast("array<long>"))
    sums = F.aggregate(steps, start, further)["sums"]
    return first + F.size(F.filter(sums, lambda x: x < u * F.element_at(sums, -1))).cast("long")


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(number, quota) rows to (shard, number, part): a binary tree over the
    shards, every node dividing its quotas between its halves by multivariate
    hypergeometric draws. Parts are exact: over the shards they sum to the
    quota, and shards differ by at most one block per level in total."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("number", "quota"))).alias("q")).select(
        F.lit(0).alias("shard"), F.transform("q", lambda x: x["number"].cast("long")).alias("numbers"),
        F.transform("q", lambda x: x["quota"].cast("long")).alias("here"))
    width = shards
    while width > 1:
        width //= 2
        total = F.aggregate("here", F.lit(0).cast("long"), lambda s, x: s + x)
        tree = tree.withColumn("total", total).withColumn("half", F.floor((F.col("total") + 1) / 2))

        def draw(s, x):
            part = hypergeometric(s["total"], x["quota"], s["half"], _uniform(F.lit(seed), F.lit(width), F.col("shard"), x["number"]))
            return F.struct((s["total"] - x["quota"]).alias("total"), (s["half"] - part).alias("half"),
                            F.concat(s["parts"], F.array(part)).alias("parts"))

        start = F.struct("total", F.col("half").cast("long").alias("half"), F.array().cast("array<long>").alias("parts"))
        pairs = F.zip_with("numbers", "here", lambda n, x: F.struct(n.alias("number"), x.alias("quota")))
        tree = tree.withColumn("left_part", F.aggregate(pairs, start, draw)["parts"])
        right = F.zip_with("here", "left_part", lambda x, y: x - y)
        tree = cut(tree.select("numbers", F.explode(F.array(
            F.struct(F.col("shard"), F.col("left_part").alias("here")),
            F.struct((F.col("shard") + width).alias("shard"), right.alias("here")))).alias("n")).select("numbers", "n.shard", "n.here"))
    return tree.select("shard", F.explode(F.arrays_zip("numbers", "here")).alias("x")).select(
        "shard", F.col("x.numbers").alias("number"), F.col("x.here").alias("part"))


def _per_source(sources: DataFrame, share: float) -> tuple[bool, int]:
    """Whether rows per source are small enough to broadcast, with up to
    2 * BLOCK_DOCS chosen documents of 32 bytes each; and the number of shards
    for the words of the mix. (One row reaches the driver.)"""
    row = sources.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce("source", F.lit("")))).alias("names"),
                      F.sum("source_size").alias("words")).first()
    small = row["n"] * (200 + 64 * BLOCK_DOCS) + (row["names"] or 0) <= BROADCAST_BYTES
    shards = SHARDS
    while shards < MAX_SHARDS and shards * SHARD_WORDS < share * (row["words"] or 0):
        shards *= 2
    return small, shards


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix's plan, one row per input row: ``id, source, size, source_size,
    target, draws, taken``. ``draws`` lists (epoch, shard) of every copy that
    the mix takes (empty: none), ``taken`` is their words. Without ``shards``
their number follows from the words of the mix.

    Null or empty texts have size 0 and null sources are a source of their
    own. Repeated rows (same id, source and size) share their decision. An
    empty table gives an empty plan.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), F.col("source"), F.col("size")), 64 - _BITS)
    units = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
                .withColumn("h", h))
    sources = targets(units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = cut(sources.withColumn("epochs", epochs).withColumn("blocks", _blocks(F.col("docs"))).withColumn(
        "left", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))))
    small, by_size = _per_source(sources, share)

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if small else rows

    s = sent(sources.withColumnRenamed("source", "of"))
    block, inner = _place(F.col("h"), F.col("blocks"))
    placed = (units.join(s, units.source.eqNullSafe(s["of"])).drop("of")
              .withColumn("block", block).withColumn("inner", inner))

    # the block in which a source's remainder ends, then the piece of that block
    first = cut(_ends(placed.select("number", "block", "size", "left")))
    ending = placed.drop("left").join(sent(first.withColumnRenamed("end_left", "left")), "number").where("block = end")
    piece, _ = _place(F.col("inner"), _blocks(F.col("end_docs")))
    ending = ending.withColumn("piece", piece)
    second = cut(_ends(ending.select("number", F.col("piece").alias("block"), "size", "left")))
    last = ending.select("number", "piece", "id", "size", "h").join(sent(second), "number").where("piece = end")
    fits = _fitting(last)
    ends = first.select("number", "end", "end_docs").join(
        second.select("number", F.col("end").alias("piece_end")), "number", "left").join(fits, "number", "left")

    # the tree over block quotas, and the draws that each shard owns
    quota = F.col("epochs") * F.col("blocks") + F.least(F.col("end") + F.when(F.col("end_docs") > 0, 1).otherwise(0), F.col("blocks"))
    quotas = sources.select("number", "blocks", "epochs").join(first, "number").withColumn("quota", quota)
    parts = split_quotas(quotas.select("number", "quota"), shards or by_size, seed)
    to = F.sum("part").over(Window.partitionBy("number").orderBy("shard"))
    owned = (parts.withColumn("to", to).where("part > 0")
             .select("number", "shard", F.explode(F.sequence(F.col("to") - F.col("part"), F.col("to") - 1)).alias("place")))
    permuted = Window.partitionBy("number").orderBy(F.xxhash64(F.lit(seed), F.col("number"), F.col("draw")), "draw")
    drawn = (quotas.where("quota > 0").select("number", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("draw"))
             .withColumn("place", F.row_number().over(permuted).cast("long") - 1)
             .join(owned, ["number", "place"])
             .groupBy("number", (F.col("draw") % F.col("blocks")).alias("block"))
             .agg(F.array_sort(F.collect_list(F.struct(F.floor(F.col("draw") / F.col("blocks")).alias("epoch"), "shard"))).alias("draws")))

    # back to the rows: a block's draws, without the remainder's where a row isn't in it
    here = F.when(F.col("block") != F.col("end"), F.lit(True)).when(F.col("piece") != F.col("piece_end"), F.col("piece") < F.col("piece_end")) \
        .otherwise(F.coalesce(F.array_contains("chosen", F.struct("id", "size")), F.lit(False)))
    draws = F.filter(F.coalesce(F.col("draws"), F.array().cast("array<struct<epoch:bigint,shard:int>>")),
                     lambda d: (d["epoch"] < F.col("epochs")) | F.col("here"))
    return (placed.drop("left", "docs", "h").join(sent(ends), "number", "left")
            .withColumn("piece", piece).withColumn("here", here)
            .join(drawn, ["number", "block"], "left")
            .withColumn("draws", draws)
            .select("id", "source", "size", "source_size", "target", "draws",
                    (F.col("size") * F.size("draws")).cast("long").alias("taken")))


def _fitting(last: DataFrame) -> DataFrame:
    """(number, chosen): of the piece in which a source's remainder ends, the
    (id, size) chosen largest first while they fit, then the smallest other
    one if that comes nearer to the target."""
    units = last.groupBy("number", "id", "size", "h", "end_left").agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
    start = F.struct(F.max("end_left").alias("left"), F.array().cast("array<struct<id:bigint,size:bigint>>").alias("chosen"),
                     F.lit(None).cast("struct<id:bigint,size:bigint>").alias("smallest"), F.lit(0).cast("long").alias("words"))

    def take(s, x):
        one = F.struct(x["id"].cast("long").alias("id"), x["size"].alias("size"))
        fits = x["words"] <= s["left"]
        return F.struct(F.when(fits, s["left"] - x["words"]).otherwise(s["left"]).alias("left"),
                        F.when(fits, F.concat(s["chosen"], F.array(one))).otherwise(s["chosen"]).alias("chosen"),
                        F.when(fits, s["smallest"]).otherwise(one).alias("smallest"),
                        F.when(fits, s["words"]).otherwise(x["words"]).alias("words"))

    def done(s):
        nearer = s["smallest"].isNotNull() & (s["words"] < s["left"] * 2)
        return F.when(nearer, F.concat(s["chosen"], F.array(s["smallest"]))).otherwise(s["chosen"])

    by_size = F.reverse(F.array_sort(F.collect_list(F.struct("words", "h", "id", "size"))))
    return (units.groupBy("number").agg(by_size.alias("units"), start.alias("start"))
            .select("number", F.aggregate("units", F.col("start"), take, done).alias("chosen")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    seed: int = SEED, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy taken, with
    ``mix_shard``; shards are partitions, shuffled inside.

    The plan comes back to the rows by id, source and size, so repeated rows
    get their plan once each. A column ``mix_shard`` of ``docs`` is replaced;
    all others keep their values, whatever their names.
    """
    pre = "mix_"
    while any(c.startswith(pre) for c in docs.columns):     # no column of the documents has a name of the plan's
        pre = f"_{pre}"
    plan = mix(docs, id_col, text_col, source_col, seed=seed, **options).where(F.size("draws") > 0)
    plan = plan.select(*[F.col(c).alias(pre + c) for c in ("id", "source", "size", "draws")]).dropDuplicates([pre + c for c in ("id", "source", "size")])
    rows = docs.withColumn(f"{pre}words", word_count(F.col(text_col)))
    out = (rows.join(plan, F.col(id_col).eqNullSafe(F.col(f"{pre}id")) & F.col(source_col).eqNullSafe(F.col(f"{pre}source"))
                     & (F.col(f"{pre}words") == F.col(f"{pre}size")))
           .withColumn(f"{pre}draw", F.explode(f"{pre}draws"))
           .withColumns({f"{pre}shard": F.col(f"{pre}draw.shard"), f"{pre}epoch": F.col(f"{pre}draw.epoch")}))
    order = F.xxhash64(F.lit(seed), F.col(f"{pre}shard"), F.col(f"{pre}epoch"), F.col(id_col))
    return (out.repartition(f"{pre}shard").sortWithinPartitions(f"{pre}shard", order, id_col)
            .select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix_shard"], F.col(f"{pre}shard").alias("mix_shard")))


def digest(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``id_col, size, source_size, target, taken, shards`` of the mix's plan;
    ``shards`` lists the shard of every copy, in order of epochs."""
    return mix(docs, id_col, **options).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken",
                                               F.transform("draws", lambda d: d["shard"]).alias("shards"))
