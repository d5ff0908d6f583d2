"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks. How often the mix takes
each source's blocks follows from its target; whole rounds take every block, the
rest a random choice of them. The blocks that are taken are split among output
shards by a tree: each node draws its left child's quota of every source from
the multivariate hypergeometric law, exactly, and leaves draw disjoint ranges of
the permuted blocks. Documents are ordered within their shard by hash.

Only DataFrame functions are used. Only (source, block) sums and the tree's
quotas are gathered, never documents; one source may hold any share of the rows.

Nulls: a null text has size 0; a null source is a source of its own, after all
others; a null doc_id is a row like others. Rows that repeat are taken alike.
Sources whose documents are all empty have the target 0. An empty table gives an
empty result. Columns of the input with the names of outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.names import apart

#: The most that a source may be repeated.
REPEATS = 3
#: Documents for each block of a source, and the most blocks that a source has (a task sorts them).
BLOCK_DOCS, MOST_BLOCKS = 256, 1 << 16
#: Columns that mix() adds.
MADE = ("size", "source_size", "target", "taken", "copies", "place")


def n_words(text: str = "text") -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Rows (source, source_size) with their weight and target.

    Weights are 1, 2, 3, repeating, in the order of code points. A source is full
    if its share at the common rate would pass REPEATS times its size; sorted by
    that rate, the full ones come first, so running sums find the rate at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    by_rate = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_rate.rowsBetween(Window.unboundedPreceding, -1), by_rate.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = (
        w.withColumn("full", F.col("source_size") * REPEATS)
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0)))
        .withColumn("place", F.row_number().over(by_rate))
        .withColumn("rate", F.col("left") / F.sum("weight").over(after))
        .withColumn("open", F.col("rate") * F.col("weight") < F.col("full"))
    )
    # Rates hold as long as all sources before are full: so the first open one has the common rate.
    rate = F.min(F.when(F.col("open"), F.struct("place", "rate"))).over(everything)["rate"]
    return w.select("source", "source_size", "weight", F.least(F.col("full").cast("double"), F.coalesce(rate * F.col("weight"), F.col("full").cast("double"))).alias("target"))


def hypergeometric(good: str, total: str, draws: str, uniform: str) -> str:
    """SQL for how many of ``good`` among ``total`` are among ``draws`` of them, by inversion.

    Weights run from the mode to both sides by the ratio of neighbouring
    probabilities; all counts that could have a weight above 1e-300 are summed.
    """
    low, high = f"greatest(0L, {draws} - ({total} - {good}))", f"least({good}, {draws})"
    mode = f"cast(floor(({draws} + 1D) * ({good} + 1D) / ({total} + 2D)) as bigint)"
    width = f"cast(ceil(60 * sqrt(greatest(1D, {draws} * ({good} / ({total} + 1D)))) + 60) as bigint)"
    struct = f"named_struct('lo', greatest({low}, least({high}, {mode}) - {width}), 'hi', least({high}, greatest({low}, {mode}) + {width}), 'mode', least({high}, greatest({low}, {mode})))"
    up = f"(({good} - k + 1D) * ({draws} - k + 1D) / (k * ({total} - {good} - {draws} + k * 1D)))"
    ups = f"aggregate(sequence(r.mode, r.hi), array(named_struct('k', r.mode, 'w', 1D)), (a, k) -> if(k = r.mode, a, concat(a, array(named_struct('k', k, 'w', element_at(a, -1).w * {up})))))"
    down = f"((k + 1D) * ({total} - {good} - {draws} + k + 1D) / (({good} - k) * ({draws} - k * 1D)))"
    downs = f"aggregate(sequence(r.mode, r.lo), array(named_struct('k', r.mode, 'w', 1D)), (a, k) -> if(k = r.mode, a, concat(a, array(named_struct('k', k, 'w', element_at(a, -1).w * {down})))))"
    weights = f"transform(array({struct}), r -> concat(reverse(slice({downs}, 2, 1000000)), {ups}))[0]"
    return f"""transform(array({weights}), w -> aggregate(w, named_struct('left', {uniform} * aggregate(w, 0D, (s, x) -> s + x.w), 'k', w[0].k, 'done', false),
        (s, x) -> if(s.done, s, named_struct('left', s.left - x.w, 'k', x.k, 'done', s.left - x.w <= 0)), s -> s.k))[0]"""


def tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """Quotas (source, blocks) split among 2 ** depth shards: (shard, source, first, blocks).

    A node's rows are its sources' quotas, so a level adds rows, never columns. Every
    source is drawn given the ones before it: that is the multivariate law.
    """
    node = quotas.select(F.lit(0).alias("shard"), "source", F.lit(0).cast("long").alias("first"), F.col("blocks").cast("long").alias("blocks"))
    for level in range(depth):
        whole = node.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("\U0010ffff")).alias("o"), "source", "first", "blocks"))).alias("own"), F.sum("blocks").alias("total"))
        whole = whole.withColumn("half", F.expr("total div 2"))
        draw = hypergeometric("x.blocks", "s.total", "s.draws", f"((pmod(xxhash64({seed}L, {level}, shard, x.o), 4503599627370496L) + 0.5D) / 4503599627370496D)")
        step = f"""aggregate(own, named_struct('total', total, 'draws', half, 'out', cast(array() as array<struct<source:string,first:bigint,blocks:bigint,to:bigint>>)),
            (s, x) -> transform(array({draw}), d -> named_struct('total', s.total - x.blocks, 'draws', s.draws - d,
                'out', concat(s.out, array(named_struct('source', x.source, 'first', x.first, 'blocks', x.blocks, 'to', d)))))[0], s -> s.out)"""
        drawn = whole.select("shard", F.inline(F.expr(step)))
        sides = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("source"), F.col("first"), F.col("to").alias("blocks")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.col("source"), (F.col("first") + F.col("to")).alias("first"), (F.col("blocks") - F.col("to")).alias("blocks")),
        )
        node = drawn.select(F.inline(sides)).where("blocks > 0")
    return node


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with the size and a hash that deals and orders them."""
    return docs.withColumn("size", n_words()).withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "size"))


def decisions(docs: DataFrame, depth: int, seed: int) -> tuple[DataFrame, int]:
    """What happens to each (source, block), and the number of blocks of a source.

    Rows: source, block, source_size, target, rounds, shards (one for each time that
    the block is taken), cut: None, or the greatest hash that the last time takes.
    """
    narrow = _keyed(docs, seed).select("source", "__h", "size").checkpoint()
    n_blocks = min(MOST_BLOCKS, max(1, -(-narrow.count() // BLOCK_DOCS)))
    narrow = narrow.withColumn("block", F.pmod("__h", F.lit(n_blocks)))
    blocks = narrow.groupBy("source", "block").agg(F.sum("size").alias("words"))
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block")
    blocks = (
        blocks.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source")))
        .withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("extra", F.col("target") - F.col("rounds") * F.col("source_size") - F.col("before"))
        .withColumn("times", F.col("rounds") + (F.col("extra") > 0).cast("long"))
    ).checkpoint()
    # In the last block that is taken, documents go by hash until the target is met.
    last = blocks.where("extra > 0 and extra < words").select(F.col("source").alias("s"), F.col("block").alias("b"), "extra")
    inside = narrow.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    running = F.sum("size").over(Window.partitionBy("s", "b").orderBy("__h").rangeBetween(Window.unboundedPreceding, 0))
    cut = inside.withColumn("sum", running).groupBy("s", "b").agg(F.coalesce(F.max(F.when(F.col("sum") <= F.col("extra"), F.col("__h"))), F.lit(-(2**63))).alias("cut"))
    quotas = blocks.groupBy("source").agg(F.sum("times").alias("blocks")).where("blocks > 0")
    leaves = tree(quotas, depth, seed + 2).select("shard", F.col("source").alias("s"), "first", (F.col("first") + F.col("blocks")).alias("end"))
    units = blocks.where("times > 0").select("source", "block", F.explode(F.expr("transform(sequence(0L, times - 1), t -> t * n + rank)")).alias("unit"))
    dealt = units.join(leaves, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") >= F.col("first")) & (F.col("unit") < F.col("end")))
    dealt = dealt.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "shard"))), lambda x: x["shard"]).alias("shards"))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    out = blocks.join(dealt, on, "left").drop("s", "b").join(cut, on, "left").drop("s", "b")
    return out.select("source", "block", "source_size", "target", "rounds", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"), "cut"), n_blocks


def mix(docs: DataFrame, depth: int = 4, seed: int = 11) -> DataFrame:
    """docs with size, source_size, target, taken, and copies: a shard for each time it is taken.

    taken counts words, repeats included. Sorting a shard's copies by ``place`` shuffles it.
    """
    kept = [c for c in docs.columns if c.lower() not in MADE]
    safe, own = apart(docs.select(*kept), "doc_id", "text", "source")
    plan, n_blocks = decisions(safe, depth, seed)
    plan = plan.withColumnRenamed("source", "__s").withColumnRenamed("block", "__b").withColumnRenamed("cut", "__cut").withColumnRenamed("shards", "__shards").withColumnRenamed("rounds", "__rounds")
    keyed = _keyed(safe, seed).withColumn("__block", F.pmod("__h", F.lit(n_blocks)))
    out = keyed.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    whole = F.col("__cut").isNull() | (F.col("__h") <= F.col("__cut"))
    copies = F.when(whole, F.col("__shards")).otherwise(F.slice("__shards", F.lit(1), F.col("__rounds").cast("int")))
    out = out.withColumn("copies", copies)
    return out.select(*own, "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies", F.xxhash64(F.lit(seed + 3), "__h").alias("place"))


def mixed_rows(docs: DataFrame, depth: int = 4, seed: int = 11) -> DataFrame:
    """The mix itself: a row of docs for each time that it is taken, shuffled within shards."""
    safe, own = apart(docs, "doc_id", "text", "source")  # the input's columns stay, whatever their names
    out = mix(safe, depth, seed).withColumn("__shard", F.explode("copies"))
    place = F.xxhash64("place", "__shard")
    out = out.repartition("__shard", F.pmod(place, F.lit(64))).sortWithinPartitions("__shard", place)
    return out.select(*own)
