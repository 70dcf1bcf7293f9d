"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents make one stream of words, cut into blocks of BLOCK words. A source may fill as many slots as
its target needs. Each output shard draws how many of its slots each source gets (multinomial); what a source is drawn
beyond its quota goes to sources drawn too little. A slot of a source is its rank there; rank // blocks is the pass over
the source, rank % blocks goes through that pass's pseudorandom permutation to a block, and blocks meet slots by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.llm.common import stored

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 64
SHARD = 4096
CHUNKS = 4096
SEED = 20240229
ROUNDS = 8
WORD = "[^\\x20\\x09-\\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source, row, size: words of each row's text. ``row_col``, if given, tells rows apart."""
    row = F.col(row_col) if row_col else F.lit(None)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), row.cast("long").alias("row"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sid (place by code point, null last), source, source_size, target.

    Weighted shares of all sizes, none above ``cap`` times its source: that is min(cap * size, level * weight) for the
    one level that makes the targets add up. In order of cap * size / weight, the first k sources are capped, and the
    level is what the others share.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))  # a row a source
    own = per.withColumn("sid", F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    own = own.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("at", F.col("most") / F.col("w"))
    rising = everything.orderBy("at", "sid")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("all", F.sum("source_size").over(everything).cast("double")).withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the level of the first source that the sources before it, all capped, leave uncapped
    own = own.withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "sid", "level"))).over(everything)["level"])
    return own.select("sid", "source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def before(rows: DataFrame, key: str, order: str, value: str, width: int = 1024) -> DataFrame:
    """Adds ``_before``, the sum of ``value`` over the rows of ``key`` with a smaller ``order`` (an integer, one row each).

    Summed in two levels, so that a task reads only ``width`` rows, or a row for each ``width``.
    """
    own = rows.withColumn("_wide", F.expr(f"{order} div {width}"))
    wide = own.groupBy(key, "_wide").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = own.withColumn("_inner", F.coalesce(F.sum(value).over(Window.partitionBy(key, "_wide").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(wide.select(key, "_wide", "_base"), [key, "_wide"]).withColumn("_before", (F.col("_base") + F.col("_inner")).cast("long")).drop("_wide", "_base", "_inner")


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds sid, source_size, target and ``first``, the words before a document in its source's stream.

    A large source is summed in hashed chunks: the order of the stream is (chunk, doc_id, size).
    """
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select("doc_id", "row", sizes["source"], "size", "sid", "source_size", "target")
    chunks = max(CHUNKS, sizes.count() // 65536)  # so that a chunk stays small
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "sid"), F.lit(chunks)))
    earlier = Window.partitionBy("sid", "chunk").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("within", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    chunks = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("words")).withColumn("begin", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(chunks.select("sid", "chunk", "begin"), ["sid", "chunk"]).withColumn("first", (F.col("begin") + F.col("within")).cast("long")).drop("chunk", "begin", "within")


def quotas(sources: DataFrame, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """Adds ``blocks`` of a source and ``slots`` it may fill, at most ``cap`` for each block."""
    own = sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    return own.withColumn("slots", F.least(F.col("blocks") * cap, F.round(F.col("target") * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")))


def _spread(df: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """A row for each cell of ``width`` that [low, high) touches, so that intervals can be joined by equality."""
    return df.withColumn("cell", F.explode(F.sequence(F.expr(f"{low} div {width}"), F.expr(f"({high} - 1) div {width}"))))


def shard_draws(quota: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """sid, shard, first, n: the ranks [first, first + n) of a source go to a shard.

    Each slot of a shard draws a source with the odds of the quotas, so a shard's counts are multinomial. A source's
    draws count until its quota is full; later ones are dealt, in order of shards, to the sources that lack some.
    """
    spark = quota.sparkSession
    running = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    ends = quota.filter("slots > 0").withColumn("low", F.coalesce(F.sum("slots").over(running), F.lit(0)).cast("long")).withColumn("high", F.col("low") + F.col("slots"))
    total = ends.agg(F.max("high")).first()[0] or 0
    width = max(1, total // 4096)
    odds = _spread(ends.select("sid", "low", "high"), "low", "high", width)
    draws = spark.range(total).select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("u")).withColumn("cell", F.expr(f"u div {width}"))
    counts = draws.join(odds, (draws["cell"] == odds["cell"]) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).groupBy("sid", "shard").agg(F.count("*").alias("c"))
    filled = before(counts, "sid", "shard", "c").withColumnRenamed("_before", "first")
    filled = filled.join(quota.select("sid", "slots"), "sid").withColumn("n", F.greatest(F.lit(0), F.least("c", F.col("slots") - F.col("first"))).cast("long"))
    kept = filled.filter("n > 0").select("sid", "shard", "first", "n")
    over = filled.groupBy("shard").agg(F.sum(F.col("c") - F.col("n")).alias("m")).filter("m > 0")
    over = before(over.withColumn("_all", F.lit(0)), "_all", "shard", "m").withColumnRenamed("_before", "a").withColumn("b", F.col("a") + F.col("m"))
    lack = quota.join(kept.groupBy("sid").agg(F.sum("n").alias("has")), "sid", "left").withColumn("has", F.coalesce("has", F.lit(0))).withColumn("m", F.col("slots") - F.col("has")).filter("m > 0")
    lack = lack.withColumn("low", F.coalesce(F.sum("m").over(running), F.lit(0)).cast("long")).withColumn("high", F.col("low") + F.col("m")).select("sid", "has", "low", "high")
    cell = max(1, shard)
    left, right = _spread(over.select("shard", "a", "b"), "a", "b", cell), _spread(lack, "low", "high", cell)
    met = left.join(right, (left["cell"] == right["cell"]) & (F.col("a") < F.col("high")) & (F.col("low") < F.col("b"))).withColumn("from", F.greatest("a", "low")).withColumn("to", F.least("b", "high"))
    met = met.filter(left["cell"] == F.expr(f"from div {cell}"))  # once for each pair of intervals
    return kept.unionByName(met.select("sid", "shard", (F.col("has") + F.col("from") - F.col("low")).alias("first"), (F.col("to") - F.col("from")).alias("n")))


def permuted(x: Column, n: Column, key: list[Column], rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of [0, n) by swap-or-not rounds (Hoang, Morris and Rogaway 2012), keyed by ``key``."""

    def swap(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, i), n) - at, n)
        return F.when(F.xxhash64(*key, i, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, swap)


def slots(quota: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """sid, shard, rank, block: every slot of the mix and the block it holds."""
    tasks = int(quota.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = shard_draws(quota, shard, seed).join(quota.select("sid", "blocks"), "sid").repartition(tasks, "sid", "shard")  # a row becomes up to SHARD slots
    each = drawn.select("sid", "shard", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
    turn = F.expr("rank div blocks")
    return each.select("sid", "shard", "rank", permuted(F.pmod("rank", "blocks"), F.col("blocks"), [F.lit(seed), F.col("sid"), turn]).alias("block"))


def spans(docs: DataFrame, block: int = BLOCK, cap: int = CAP, shard: int = SHARD, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with their streams, and for each the spans of its words [begin, end) with how often the mix takes them."""
    sizes, _ = stored(sized(docs, id_col, text_col, source_col, row_col), "sizes")
    sources, _ = stored(targets(sizes, weights, cap), "sources")
    rows, _ = stored(streams(sizes, sources), "streams")
    times = slots(quotas(sources, block, cap), shard, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    pieces = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))))
    pieces = pieces.withColumn("begin", F.greatest(F.lit(0), F.col("block") * block - F.col("first"))).withColumn("end", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("first")))
    return rows, pieces.join(times, ["sid", "block"]).select("sid", "row", "first", "begin", "end", "times")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row: what the mix takes of it, repeats counted.

    Null texts have size 0 and taken 0; a null source is a source, the last one. Rows that repeat are rows each. No row
    is taken more than CAP times. An empty table gives no rows. Other columns are not read; reruns agree.
    """
    rows, pieces = spans(docs, **options)
    # of the rows with words, ``first`` tells those of a source apart
    taken = pieces.groupBy(F.col("sid").alias("_sid"), F.col("first").alias("_first")).agg(F.sum((F.col("end") - F.col("begin")) * F.col("times")).alias("taken"))
    own = rows.join(taken, (F.col("sid") == F.col("_sid")) & (F.col("first") == F.col("_first")) & (F.col("size") > 0), "left")
    return own.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix as rows of ``docs``: a row comes as often as its most repeated block is taken, the k-th time with the words taken k times or more.

    Words keep the white space that follows them. Rows of which nothing is taken, such as those without words, are not
    in the mix. ``chars_col``, if there, follows the text; other columns pass, whatever their names.
    """
    base, _ = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("_m_row")), "mix")
    own = base.select("_m_row", F.col("doc")[id_col].alias("doc_id"), F.col("doc")[text_col].cast("string").alias("text"), F.col("doc")[source_col].alias("source"))
    _, pieces = spans(own, row_col="_m_row", **options)
    taken = pieces.groupBy(F.col("row").alias("_m_row")).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "times"))).alias("_m_spans"), F.max("times").alias("_m_most"))  # a span for each 64 words of a text
    rows = base.join(taken, "_m_row").withColumn("_m_words", F.regexp_extract_all(F.col("doc")[text_col].cast("string"), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)))
    rows = rows.withColumn("_m_turn", F.explode(F.sequence(F.lit(1), F.col("_m_most").cast("int"))))
    own = F.transform(F.filter("_m_spans", lambda s: s["times"] >= F.col("_m_turn")), lambda s: F.array_join(F.slice("_m_words", (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")), ""))
    rows = rows.withColumn("_m_text", F.rtrim(F.array_join(own, "")))
    changed = {text_col: F.col("_m_text")}
    if chars_col in docs.columns:
        changed[chars_col] = F.length("_m_text").cast(docs.schema[chars_col].dataType)
    return rows.select(*(changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns))
