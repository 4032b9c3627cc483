"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sources get weights and targets (in words); a target above ``cap`` times its source's size is
   cut there and the excess shared out again.
2. A source's documents are permuted by a hash and cut into blocks of about ``block_docs``.  Its
   quota is a number of blocks: whole passes over all blocks and some blocks of one more, taken in
   order while they fit the target.  Of the first that does not fit, as many documents as do are
   taken; the words that are left go on to the blocks after it, until none has a document that fits.
3. The quotas are split among output shards by a binary tree: at each node the left half's share
   of every source is drawn from the multivariate hypergeometric distribution, source by source
   from conditional hypergeometrics.  Only counts go down the tree, so quotas stay exact.
4. Each shard draws its own stretch of every source's permuted blocks, disjoint from the others',
   and is shuffled locally by ``place``.

Only DataFrame functions are used; draws come from hashes of a seed, so reruns agree.  Documents
are shuffled by (source, block), which spreads a hot source.  One row for each source passes
through single tasks: the number of sources must fit there, the number of documents need not.

Defined results: a null or blank text has size 0 and is taken as often as its block; a null source
is a source of its own, last in order; equal rows are each kept and counted; if all sizes are 0 all
targets are 0 and nothing is taken.  An empty table gives an empty mix.  Further columns are kept,
whatever their names; a result whose name one of them has gets underscores added.  There are 64 shards,
and more for an input of more than 64 times ``SHARD_BLOCKS`` blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orisite.llm.common import WORD, checkpointed, free_names, let, quoted, within

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_DOCS, SHARDS, SHARD_BLOCKS, SEED = 256, 64, 1024, 7
RESULTS = ["mix_size", "mix_source_size", "mix_target", "mix_draws"]
#: Sources that are broadcast at most (a few MB).
BROADCAST_SOURCES = 50_000


def uniform(*parts: Column) -> Column:
    """A hash as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def sized(id_col: str, text_col: str, seed: int) -> list[Column]:
    """``source``, ``__size`` (words) and ``__key``, the hash that permutes the rows."""
    text = F.col(f"`{text_col}`")
    return [F.col("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
            F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("__key")]


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, rank, n_docs, source_size, target) from rows (source, __size)."""
    per = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)))
    per = per.withColumn("most", cap * F.col("source_size").cast("double"))
    # sources that reach their cap first come first; the level is that of the first which does not
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                         / F.sum("weight").over(after))
    free = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))
    per = per.withColumn("level", F.min(free).over(everything)["level"])
    target = F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most"))
    return per.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items, out of ``total`` of which ``good`` are marked, are marked:
    the inverse distribution function at ``u``.  Chances are summed within twelve standard
    deviations of the mode from ratios of neighbours, relative to the largest."""
    n, k, d = total.cast("double"), good.cast("double"), drawn.cast("double")
    sd = F.sqrt(F.greatest(F.try_divide(d * k * (n - k) * (n - d), n * n * F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)))
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    span = F.ceil(F.coalesce(sd, F.lit(0.0)) * 12) + 8
    low = F.greatest(F.greatest(F.lit(0), drawn - (total - good)), mode - span).cast("long")
    high = F.least(F.least(drawn, good), mode + span).cast("long")

    def step(s: Column, x: Column) -> Column:
        return s["l"] + F.ln((k - x + 1) * (d - x + 1) / (x * (n - k - d + x)))

    def pick(a: Column, b: Column) -> Column:
        xs = F.sequence(a + 1, b)
        zero = F.lit(0.0)
        top = F.aggregate(xs, F.struct(zero.alias("l"), zero.alias("v")), lambda s, x: let(
            step(s, x), lambda l: F.struct(l.alias("l"), F.greatest(s["v"], l).alias("v"))))["v"]

        def draw(top: Column) -> Column:
            all_ = F.aggregate(xs, F.struct(zero.alias("l"), F.exp(-top).alias("v")), lambda s, x: let(
                step(s, x), lambda l: F.struct(l.alias("l"), (s["v"] + F.exp(l - top)).alias("v"))))["v"]
            return let(all_ * u, lambda goal: F.coalesce(F.aggregate(
                xs, F.struct(zero.alias("l"), F.exp(-top).alias("v"), F.when(F.exp(-top) > goal, a).alias("x")),
                lambda s, x: let(step(s, x), lambda l: let(s["v"] + F.exp(l - top), lambda v: F.struct(
                    l.alias("l"), v.alias("v"), F.coalesce(s["x"], F.when(v > goal, x)).alias("x")))))["x"], b))

        return F.when(a >= b, a).otherwise(let(top, draw))

    return let(low, lambda a: let(high, lambda b: pick(a, b)))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, rank, n) from (rank, quota), with ranks 0, 1, ...: n blocks of the source for the
    shard.  A shard gets its share of all blocks, to one block."""
    root = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda s: s["quota"]).alias("counts"))
    level = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts",
                        F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("blocks"))
    for _ in range((shards - 1).bit_length()):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")

        def upto(shard: Column) -> Column:
            return F.floor(F.col("blocks") * shard / shards).cast("long")

        start = F.struct(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
                         (upto(mid) - upto(F.col("lo"))).alias("room"), F.array().cast("array<bigint>").alias("left"))
        numbered = F.transform("counts", lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        drawn = F.aggregate(numbered, start, lambda s, e: let(
            hypergeometric(s["total"], e["c"], s["room"], uniform(F.lit(seed), F.col("lo"), F.col("hi"), e["i"])),
            lambda x: F.struct((s["total"] - e["c"]).alias("total"), (s["room"] - x).alias("room"),
                               F.concat(s["left"], F.array(x)).alias("left"))))["left"]
        halves = let(drawn, lambda left: F.array(
            F.struct(F.col("lo").alias("lo"), mid.alias("hi"), left.alias("counts")),
            F.struct(mid.alias("lo"), F.col("hi").alias("hi"), F.zip_with("counts", left, lambda c, x: c - x).alias("counts"))))
        leaf = F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("counts").alias("counts")))
        level = level.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(leaf)).alias("n"), "blocks")
        level = level.select("n.lo", "n.hi", "n.counts", "blocks")
    return level.select(F.col("lo").alias("shard"), F.posexplode("counts").alias("rank", "n"))


def plan(rows: DataFrame, weights, cap: int, block_docs: int, shards: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks) for rows (source, __size, __key).  Blocks: (rank, block, fitting, draws):
    draws lists (pass, shard); of the pass after the whole ones only the rows with a key in
    ``fitting`` count, or all if that is null."""
    sources = checkpointed(source_targets(rows, weights, cap))
    share = F.try_divide("target", "source_size")
    sources = (sources.withColumn("passes", F.coalesce(F.floor(share), F.lit(0)).cast("int"))
               .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
               .withColumn("n_blocks", F.ceil(F.col("n_docs") / block_docs)))
    placed = in_blocks(rows, sources)
    order = Window.partitionBy("rank").orderBy("block")
    blocks = (placed.groupBy("rank", "block", "passes", "rest")
              .agg(F.sum("__size").alias("words"),
                   F.min(F.when(F.col("__size") > 0, F.col("__size"))).alias("least"))  # the least that takes words
              .withColumn("no", F.row_number().over(order) - 1)
              .withColumn("of", F.count("*").over(Window.partitionBy("rank"))))
    blocks = checkpointed(blocks)
    last = last_pass(placed, blocks)
    blocks = blocks.join(last, ["rank", "block"], "left").withColumn("n", F.col("passes") + F.col("at").isNotNull().cast("int"))
    if shards is None:
        shards = max(SHARDS, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // SHARD_BLOCKS))
    quotas = split_quotas(blocks.groupBy("rank").agg(F.sum("n").alias("quota")), shards, seed)
    to = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    slots = quotas.withColumn("to", to).where("n > 0").select(
        "rank", "shard", F.explode(F.sequence(F.col("to") - F.col("n"), F.col("to") - 1)).alias("slot"))
    # the slots of the last pass follow each other, though blocks are left out
    slot = F.col("pass").cast("long") * F.col("of") + F.when(F.col("pass") < F.col("passes"), F.col("no")).otherwise(F.col("at"))
    drawn = (blocks.where("n > 0").select("rank", "block", "passes", "no", "of", "at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pass"))
             .withColumn("slot", slot).join(slots, ["rank", "slot"])
             .groupBy("rank", "block").agg(F.collect_list(F.struct("pass", "shard")).alias("draws")))
    return sources, drawn.join(last.select("rank", "block", "fitting"), ["rank", "block"], "left")


def last_pass(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rank, block, at, fitting): the blocks of the pass after the whole ones, numbered in order, and of
    those that are cut the keys of the rows that fit.

    A round takes blocks in order while they fit and cuts the next one; sources that then have room
    for a document of a later block go another round, from there on."""
    room = blocks.groupBy("rank").agg(F.max("rest").alias("room")).where("room > 0").withColumn("after", F.lit(-1))
    run = F.sum("words").over(Window.partitionBy("rank").orderBy("no"))
    taken = []
    while True:
        free = blocks.join(room, "rank").where("no > after and least <= room")
        free = checkpointed(free.withColumn("spare", F.col("room") - (run - F.col("words"))).where("spare > 0")
                            .select("rank", "block", "no", "words", "spare"))
        cut = free.where("spare < words").select("rank", "block", "no", "spare")
        # at most one block of each source; equal rows have equal keys and go together
        filled = checkpointed(placed.join(F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut, ["rank", "block"])
                              .groupBy("rank", "block", "no", "spare", "__key").agg(F.sum("__size").alias("w"))
                              .groupBy("rank", "block", "no", "spare").agg(F.array_sort(F.collect_list(F.struct("__key", "w"))).alias("rows"))
                              .select("rank", "block", "no", fits(F.col("rows"), F.col("spare")).alias("f")))
        whole = free.where("spare >= words").select("rank", "block", "no", F.lit(None).cast("array<bigint>").alias("fitting"))
        taken.append(whole.unionByName(filled.select("rank", "block", "no", F.col("f.keys").alias("fitting"))))
        room = filled.select("rank", F.col("f.room").alias("room"), F.col("no").alias("after"))
        if blocks.join(room, "rank").where("no > after and least <= room").isEmpty():
            at = F.row_number().over(Window.partitionBy("rank").orderBy("no")) - 1
            return checkpointed(reduce(DataFrame.unionByName, taken).select("rank", "block", at.alias("at"), "fitting"))


def fits(rows: Column, room: Column) -> Column:
    """(room, keys): the keys of the rows (key, w) that are taken, in order, if they fit in what is left
    of ``room`` words, and what is left then."""
    start = F.struct(room.cast("double").alias("room"), F.array().cast("array<bigint>").alias("keys"))
    return F.aggregate(rows, start, lambda s, r: F.when(r["w"] <= s["room"], F.struct(
        (s["room"] - r["w"]).alias("room"), F.concat(s["keys"], F.array(r["__key"])).alias("keys"))).otherwise(s))


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with what their source has, and their block."""
    s = within(sources.withColumnRenamed("source", "__source"), sources.count(), BROADCAST_SOURCES)
    joined = rows.join(s, rows["source"].eqNullSafe(s["__source"])).drop("__source")
    return joined.withColumn("block", F.floor(uniform(F.lit(1), "__key") * F.col("n_blocks")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_docs: int = BLOCK_DOCS,
        shards: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) and, last, ``mix_size``, ``mix_source_size``,
    ``mix_target`` and ``mix_draws``, an array of (pass, shard, place): one entry each time that the
    mix takes the row.  Needs a column ``source``."""
    keep = docs.columns if keep is None else keep
    own = sized(id_col, text_col, seed)
    sources, blocks = plan(checkpointed(docs.select(*own)), weights, cap, block_docs, shards, seed)
    done = draw(docs.select(F.struct(*quoted(keep)).alias("__row"), *own), sources, blocks, seed)
    return done.select("__row.*", *(F.col(n).alias(free) for n, free in zip(RESULTS, free_names(RESULTS, keep))))


def draw(rows: DataFrame, sources: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    placed = in_blocks(rows, sources).join(blocks, ["rank", "block"], "left")
    fit = F.coalesce(F.array_contains("fitting", F.col("__key")), F.lit(True))
    taken = F.filter("draws", lambda d: (d["pass"] < F.col("passes")) | fit)
    draws = F.transform(F.coalesce(taken, F.array().cast("array<struct<pass:int,shard:int>>")), lambda d: F.struct(
        d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), d["shard"], d["pass"], "__key").alias("place")))
    return (placed.withColumn("mix_draws", draws)
            .withColumnsRenamed({"__size": "mix_size", "source_size": "mix_source_size", "target": "mix_target"}))


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """One row for each draw of a mix, with ``mix_pass``, ``mix_shard`` and ``mix_place`` in place of
    ``mix_draws``, in shards and shuffled."""
    *kept, draws = mixed.columns
    names = free_names(["mix_pass", "mix_shard", "mix_place"], kept)
    rows = mixed.select(F.struct(*quoted(kept)).alias("__row"), F.explode(f"`{draws}`").alias("__d"))
    rows = rows.repartition("__d.shard").sortWithinPartitions("__d.shard", "__d.place")
    return rows.select("__row.*", *(F.col(f"__d.{k}").alias(n) for k, n in zip(("pass", "shard", "place"), names)))
