"""Blocks and chunks of files that are read by indentation (Python), by windows over their lines.

A block ends before the next line that is indented no deeper: the nearest smaller value. Such
a line lies no deeper than the line before it, and ends blocks of the levels between the two
alone, so it is put under just those levels; drops are paid for by the spaces of rises, and the
rows so made are at most the lines and the characters of a file. Under each level one sort
finds the line that ends a block. Blocks nest, so a block's container is the last one before it
that lies one level up in the running number of open blocks.

A path is a file: it names one row, and rows without a path take no part. A null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let

#: White space as both ends of a line or text lose it, and what a line of a definition begins with.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_DEFINES = r"(?U)^[\s\x1c-\x1f]*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def _lines(files: DataFrame) -> DataFrame:
    """path, at (from 1), width (a tab counts four), code, word (def, class or empty) and name of each line."""
    lines = files.where("path is not null").select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)).alias("at", "line"))
    width = F.length(F.replace(F.regexp_extract("line", "^[ \t]*", 0), F.lit("\t"), F.lit("    ")))
    return lines.select("path", (F.col("at") + 1).alias("at"), width.alias("width"), _stripped(F.col("line")).alias("code"), F.regexp_extract("line", _DEFINES, 1).alias("word"), F.regexp_extract("line", _DEFINES, 2).alias("name"))


def blocks(files: DataFrame) -> DataFrame:
    """path, kind, name, start_line, end_line of functions and classes; they begin at their decorators.

    A function's name carries its nearest container's. Comments and blank lines end nothing.
    """
    each = Window.partitionBy("path").orderBy("at")
    lines = _lines(files).withColumn("deco", F.col("code").startswith("@"))
    # A run of decorators of one width, and a definition right behind it.
    goes_on = F.coalesce(F.lag("deco").over(each) & (F.lag("width").over(each) == F.col("width")), F.lit(False))
    lines = lines.withColumn("on", goes_on).withColumn("run", F.last(F.when(F.col("deco") & ~F.col("on"), F.col("at")), ignorenulls=True).over(each))
    lines = lines.withColumn("start", F.when(F.col("on"), F.lag("run").over(each)).otherwise(F.col("at"))).where("code <> '' and not startswith(code, '#')")
    whole = Window.partitionBy("path")
    lines = lines.withColumns({
        "before": F.lag("at").over(each), "above": F.lag("width").over(each), "final": F.max("at").over(whole),
        "levels": F.collect_set(F.when(F.col("word") != "", F.col("width"))).over(whole),
    })
    opens = lines.where("word <> ''").select("path", F.col("width").alias("level"), "at", F.lit(1).alias("opens"), F.struct("word", "name", "start", "final").alias("d"), F.lit(None).cast("int").alias("before"))
    ends = F.explode(F.filter("levels", lambda v: (v >= F.col("width")) & (v <= F.col("above"))))
    closes = lines.where("width <= above").select("path", ends.alias("level"), "at", F.lit(0).alias("opens"), F.lit(None).cast(opens.schema["d"].dataType).alias("d"), "before")
    behind = Window.partitionBy("path", "level").orderBy(F.desc("at"), F.desc("opens")).rowsBetween(Window.unboundedPreceding, 0)
    found = opens.unionByName(closes).withColumn("close", F.last(F.when(F.col("opens") == 0, F.struct("at", "before")), ignorenulls=True).over(behind)).where("opens = 1")
    found = found.select("path", "at", "d.word", "d.name", "d.start", F.coalesce("close.before", "d.final").alias("end"), F.col("close.at").alias("until"))
    return _named(found)


def _named(found: DataFrame) -> DataFrame:
    """Blocks (path, at, word, name, start, end, until) with names of their containers."""
    steps = F.array(F.struct(F.col("at").alias("t"), F.lit(1).alias("step")), F.struct(F.col("until").alias("t"), F.lit(-1).alias("step")))
    events = found.select("*", F.inline(steps)).where("t is not null")
    running = Window.partitionBy("path").orderBy("t", "step")
    placed = events.withColumn("depth", F.sum("step").over(running)).where("step = 1")
    # Each block once among those of its depth, and once behind those of one less.
    roles = F.explode(F.array(F.struct(F.col("depth").alias("key"), F.lit(True).alias("holds")), F.struct((F.col("depth") - 1).alias("key"), F.lit(False).alias("holds"))))
    nearest = Window.partitionBy("path", "role.key").orderBy("at")
    around = F.last(F.when(F.col("role.holds"), F.col("name")), ignorenulls=True).over(nearest)
    out = placed.withColumn("role", roles).withColumn("around", around).where("not role.holds")
    is_class = F.col("word") == "class"
    name = F.when(is_class | F.col("around").isNull(), F.col("name")).otherwise(F.concat("around", F.lit("."), "name"))
    return out.select("path", F.when(is_class, "class").otherwise("function").alias("kind"), name.alias("name"), F.col("start").alias("start_line"), F.col("end").alias("end_line"))


def chunks(files: DataFrame, most: int = 80, overlap: int = 8) -> DataFrame:
    """path, start_line, end_line, symbol, is_gap, text: gaps, blocks and the blocks within them, each windowed.

    A gap carries the symbol that begins last before it; blank chunks are dropped.
    """
    step = max(most - overlap, 1)
    each = Window.partitionBy("path").orderBy("start_line")
    before = each.rowsBetween(Window.unboundedPreceding, -1)
    found = blocks(files).withColumn("symbol", F.concat("kind", F.lit(":"), "name"))
    found = found.withColumns({"reach": F.coalesce(F.max("end_line").over(before), F.lit(0)), "near": F.lag("symbol").over(each)})
    segment = lambda first, last, symbol, gap: F.struct(first.alias("first"), last.alias("last"), symbol.alias("symbol"), F.lit(gap).alias("gap"))
    own = segment(F.col("start_line"), F.col("end_line"), F.col("symbol"), False)
    gap = segment(F.col("reach") + 1, F.col("start_line") - 1, F.col("near"), True)
    made = found.groupBy("path").agg(F.flatten(F.collect_list(F.array(gap, own))).alias("segments"), F.max("end_line").alias("reach"), F.max_by("symbol", "start_line").alias("near"))

    def windows(lines: Column) -> Column:
        tail = segment(F.coalesce("reach", F.lit(0)) + 1, F.size(lines), F.col("near"), True)
        some = F.filter(F.concat(F.coalesce("segments", F.array().cast("array<struct<first:int,last:int,symbol:string,gap:boolean>>")), F.array(tail)), lambda s: s["first"] <= s["last"])
        many = lambda s: F.greatest(F.lit(0), F.ceil((s["last"] - s["first"] + 1 - most) / step)).cast("int")
        begin = lambda s, k: s["first"] + k * step
        end = lambda s, k: F.least(s["last"], begin(s, k) + most - 1)
        cut = lambda s, k: F.struct(begin(s, k).alias("start_line"), end(s, k).alias("end_line"), s["symbol"].alias("symbol"), s["gap"].alias("is_gap"), _stripped(F.array_join(F.slice(lines, begin(s, k), end(s, k) - begin(s, k) + 1), "\n")).alias("text"))
        return F.flatten(F.transform(some, lambda s: F.transform(F.sequence(F.lit(0), many(s)), lambda k: cut(s, k))))

    texts = files.where("path is not null").select("path", "text").join(made, "path", "left")
    return texts.select("path", F.inline(let(F.split(F.coalesce("text", F.lit("")), "\r?\n", -1), windows))).where("text <> ''")
