"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions alone.

A source's target is a multiple of its words: whole copies of every document are
certain, and a sample of fixed size in words fills the rest. A document's probability
of entering the sample grows with the root of its words; those that reach 1 are
certain, and the others' are rescaled. Documents are ranked by random odds over
inclusion odds, and taken in that order until the words are full. Those after the first
that does not fit are tried in the same order, and ever smaller ones fill what is left.

Sources may be of any size: no row is sent to its source. Ranks are cut into slices
whose word counts are pre-aggregated; only the documents of the one slice in which the
words run out are put in order. What each source needs besides is one row of numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import Scratch, small

#: Slices of a source's rank order.
SLICES = 4096
#: Inclusion probabilities are in proportion to this power of a document's words.
POWER = 0.5
#: Documents after the first that does not fit that are tried in rank order, and of each doubling of size in a round of filling.
NEXT, EACH = 256, 64

_KEY = ["src", "doc_id", "size", "nth"]


def words(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Target of each source: columns src, source_size, target.

    sizes: src (see source_key) and source_size, a row per source. Sources in order of
    src weigh weights in turn; together they share all words by weight; no target goes
    over cap times its source's words, and what is over goes to the others by weight.
    """
    order = W.orderBy("src")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    s = sizes.withColumn("w", weight).withColumn("c", F.col("source_size").cast("double") * cap)
    # sources by how early they reach their caps: the capped ones are a prefix
    by_fill = W.orderBy(F.col("c") / F.col("w"), "src")
    before, every = by_fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    s = s.withColumns({
        "total": F.sum(F.col("source_size").cast("double")).over(every),
        "w_rest": F.sum("w").over(by_fill.rowsBetween(0, W.unboundedFollowing)),
        "c_before": F.coalesce(F.sum("c").over(before), F.lit(0.0)),
    })
    s = s.withColumn("capped", F.col("c") * F.col("w_rest") <= F.col("w") * (F.col("total") - F.col("c_before")))
    s = s.withColumns({
        "c_all": F.sum(F.when(F.col("capped"), F.col("c")).otherwise(0.0)).over(every),
        "w_free": F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every),
    })
    free = (F.col("total") - F.col("c_all")) * F.col("w") / F.col("w_free")
    return s.select("src", "source_size", F.when(F.col("capped"), F.col("c")).otherwise(free).alias("target"))


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """doc_id, src, size, nth of every row; nth tells rows apart that agree in the others."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col)).alias("src"), words(F.col(text_col)).alias("size"))
    rows = rows.groupBy("doc_id", "src", "size").count()
    return rows.select("doc_id", "src", "size", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)).alias("nth"))


def _scales(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """src, scale: inclusion probabilities are scale times size ** POWER, at most 1, and their words add up to the room.

    Works on a count per source and document size. Without a row a source takes all that fits.
    """
    sizes = rows.join(sources.select("src", "room"), "src").where("size > 0 and size <= room").groupBy("src", "room", "size").agg(F.count("*").alias("k"))
    order = W.partitionBy("src").orderBy(F.desc("size"))
    held, weight = (F.col("size") * F.col("k")).cast("double"), F.pow(F.col("size").cast("double"), F.lit(POWER))
    longer = F.coalesce(F.sum(held).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    scale = (F.col("room") - longer) / F.sum(weight * held).over(order.rowsBetween(0, W.unboundedFollowing))
    return sizes.withColumn("scale", scale).where(F.col("scale") * weight < 1).groupBy("src").agg(F.max_by("scale", "size").alias("scale"))


def _ranked(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """rows (_KEY) with their source's plan, inclusion, and rank: odds over inclusion odds in [0, 1); null where never sampled."""
    out = rows.join(plan, "src")
    chance = F.when((F.col("size") <= 0) | (F.col("size") > F.col("room")), 0.0).when(F.col("scale").isNull(), 1.0)
    out = out.withColumn("inclusion", chance.otherwise(F.least(F.lit(1.0), F.col("scale") * F.pow(F.col("size").cast("double"), F.lit(POWER)))))
    u = uniform(F.concat_ws(".", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("nth").cast("string")), seed)
    odds = u / (1 - u) / (F.col("inclusion") / (1 - F.col("inclusion")))
    rank = F.when(F.col("inclusion") >= 1, 0.0).when(F.col("inclusion") > 0, odds / (1 + odds))
    return out.withColumn("rank", rank).withColumn("slice", F.floor(F.col("rank") * SLICES))


def _planned(rows: DataFrame, cap: float, weights: tuple[int, ...], seed: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The plan, a row for each source, and the documents of _KEY that are taken besides what the plan says.

    A source takes what ranks before its slice `cut`; of that slice, and at last, single documents.
    """
    sources = targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), cap, weights)
    size = F.col("source_size").cast("double")
    times = F.when(F.col("source_size") > 0, F.col("target") / size).otherwise(0.0)
    sources = scratch.write(sources.withColumn("certain", F.floor(times).cast("long")).withColumn("room", F.col("target") - F.col("certain") * size), "sources")
    plan = scratch.write(sources.join(_scales(rows, small(sources)), "src", "left"), "plan")

    ranked = _ranked(rows, small(plan), seed).where("rank is not null")
    slices = ranked.groupBy("src", "room", "slice").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("src").orderBy("slice"))
    cuts = slices.withColumn("upto", upto).withColumn("over", F.col("upto") > F.col("room"))
    # the first slice that does not fit whole, and the words of those before it
    cuts = cuts.groupBy("src").agg(F.min(F.when(F.col("over"), F.col("slice"))).alias("cut"), F.coalesce(F.max(F.when(~F.col("over"), F.col("upto"))), F.lit(0)).alias("before"))
    plan = scratch.write(plan.join(cuts, "src", "left").withColumn("cut", F.when(F.col("before").isNotNull(), F.coalesce("cut", F.lit(SLICES + 1)))), "cut-plan")

    of_cut = _ranked(rows, small(plan), seed).where("slice = cut")
    within = F.sum("size").over(W.partitionBy("src").orderBy("rank", "doc_id", "size", "nth").rowsBetween(W.unboundedPreceding, 0))
    taken = scratch.write(of_cut.withColumn("upto", F.col("before") + within).where("upto <= room").select(*_KEY), "taken")
    room = sources.select("src", "room").join(plan.select("src", "before"), "src").join(taken.groupBy("src").agg(F.sum("size").alias("more")), "src", "left")
    room = scratch.write(room.select("src", (F.col("room") - F.coalesce("before", F.lit(0)) - F.coalesce("more", F.lit(0))).alias("left")), "left")
    ranked = _ranked(rows, small(plan), seed).where("size > 0 and not coalesce(slice < cut, false)")

    def others(most) -> DataFrame:
        """Documents that no one has taken, no longer than `most`, with what is left."""
        return _without(ranked.join(small(room.where("left > 0")), "src").where(F.col("size") <= most), taken)

    def take(extra: DataFrame, name: str) -> bool:
        nonlocal taken, room
        extra = scratch.write(extra, name)
        if extra.isEmpty():
            return False
        taken = scratch.write(taken.unionByName(extra), "taken")
        got = extra.groupBy("src").agg(F.sum("size").alias("got"))
        room = scratch.write(room.join(got, "src", "left").select("src", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left")), "left")
        return True

    # past the document that did not fit: the next ones in rank order
    take(_filled(_first(others(F.col("left")), ["src"], NEXT), [F.col("rank"), F.col("doc_id"), F.col("size"), F.col("nth")]), "next")
    # the rest is filled with ever smaller ones, until none fits
    longest_first = [-F.col("size"), F.col("rank"), F.col("doc_id"), F.col("nth")]
    k = 0
    while take(_filled(_first(others(F.col("left")), ["src", F.length(F.bin("size"))], EACH), longest_first), f"fill-{k}"):
        k += 1
    # at last one more, where it comes nearer than nothing
    nearest = others(2 * F.col("left")).groupBy("src").agg(F.min(F.struct("size", F.coalesce("rank", F.lit(2.0)).alias("rank"), "doc_id", "nth")).alias("x"), F.first("left").alias("left"))
    take(nearest.where(F.col("x.size") < 2 * F.col("left")).select("src", "x.doc_id", "x.size", "x.nth"), "nearest")
    return plan, taken


def _first(rows: DataFrame, group: list, k: int) -> DataFrame:
    """The first k rows of each group in rank order; each task sends its own first k alone."""
    order = W.partitionBy(*group).orderBy("rank", "doc_id", "size", "nth")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)


def _filled(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Of a few documents of each source those (_KEY) that fit into what is left, tried one after the other."""
    each = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "doc_id", "size", "nth")
    lists = rows.groupBy("src", "left").agg(F.array_sort(F.collect_list(each)).alias("x"))
    nothing = F.slice(F.col("x"), 1, 0)
    fold = F.aggregate("x", F.struct(F.col("left").alias("left"), nothing.alias("got")), lambda a, d: F.when(d["size"] <= a["left"], F.struct((a["left"] - d["size"]).alias("left"), F.concat(a["got"], F.array(d)).alias("got"))).otherwise(a))
    return lists.select("src", F.explode(fold["got"]).alias("d")).select("src", "d.doc_id", "d.size", "d.nth")


def _same(a: str, b: str):
    return (F.col(f"{a}.src") == F.col(f"{b}.src")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.nth") == F.col(f"{b}.nth"))


def _without(rows: DataFrame, taken: DataFrame) -> DataFrame:
    return rows.alias("r").join(small(taken).alias("t"), _same("r", "t"), "left_anti")


def _copied(rows: DataFrame, plan: DataFrame, taken: DataFrame, seed: str) -> DataFrame:
    """rows (_KEY and others) with source_size, target, inclusion and copies; nothing is shuffled while plan and taken are small."""
    ranked = _ranked(rows, small(plan), seed)
    mark = small(taken).withColumn("extra", F.lit(True))
    found = ranked.alias("r").join(mark.alias("t"), _same("r", "t"), "left").select("r.*", "t.extra")
    once = F.coalesce(F.col("slice") < F.col("cut"), F.lit(False)) | F.coalesce("extra", F.lit(False))
    return found.withColumn("copies", F.col("certain") + once.cast("long")).select(*rows.columns, "source_size", "target", "inclusion", "copies")


def mix(docs: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """What the mix takes of each row of docs.

    Columns: doc_id, nth, src, size, source_size, target, inclusion, copies, taken.
    copies is the number of times the mix holds the document: the source's certain
    copies, and one more with probability `inclusion`; at most cap. taken is copies
    times size. A source's taken words miss its target by no
    more than half of its smallest document that has no more copies than its certain ones;
    where only longer documents than what is left remain, the last may be added whole,
    and the miss is no more than half of that.

    The order is a hash of id and seed: reruns agree. Rows of one id are told apart by
    nth, 0 but for repeated ids. Null texts have size 0, a null source is a source of
    its own, a null id is an id. Documents of size 0 come with their certain copies;
    those longer than what is left to sample are not sampled (inclusion 0), but one may be
    the last to be added. An empty table gives an empty table. Other columns, of any
    name, are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(_sizes(docs, id_col, source_col, text_col), "sizes")
    plan, taken = _planned(rows, cap, weights, seed, scratch)
    out = _copied(rows, plan, taken, seed).select("doc_id", "nth", "src", "size", "source_size", "target", "inclusion", "copies")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs itself, mixed: each row as often as the mix holds it, columns unchanged.

    Texts pass row by row; only rows that agree in id, source and size with another are
    brought together, to be numbered.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    rows = scratch.write(_sizes(docs, id_col, source_col, text_col), "sizes")
    plan, taken = _planned(rows, cap, weights, seed, scratch)
    own = {"doc_id": F.col(f"_row.{id_col}").cast("long"), "src": source_key(F.col(f"_row.{source_col}")), "size": words(F.col(f"_row.{text_col}"))}
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumns(own).withColumn("nth", F.lit(0))
    again = scratch.write(rows.where("nth = 1").select(*_KEY).withColumn("nth", F.lit(0)), "again")
    alone = keyed.alias("k").join(small(again).alias("g"), _same("k", "g"), "left_anti")
    # rows of one id, source and size: which is which does not matter
    several = keyed.alias("k").join(small(again).alias("g"), _same("k", "g"), "left_semi")
    number = F.row_number().over(W.partitionBy("doc_id", "src", "size").orderBy(F.xxhash64(F.col(f"_row.{text_col}")))) - 1
    mixed = _copied(alone.unionByName(several.withColumn("nth", number)), plan, taken, seed).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
