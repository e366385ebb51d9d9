"""Mixing sources to target weights, with exact word quotas per source and output shard.

Everything here is a DataFrame expression.

1. Sizes: words per document, summed per source.  Targets fill up by weight; what
   a source cannot give (more than ``MAX_REPEATS`` times its size) is shared again.
2. Documents of a source are permuted by the digest of their id and cut into blocks
   (a block is a digest prefix).  A target is some whole passes over the permuted
   blocks and a last pass that stops in one block, inside one document or, with
   ``whole``, at the end of it that is nearer.
3. A splitting tree deals the block copies to output shards: at every node an
   exact number goes left, drawn without replacement, so the counts per source
   follow the multivariate hypergeometric law.  Only counts go down the tree.
4. Each shard draws its quota as a disjoint stretch of the permuted block copies of
   a source, and orders what it got by a digest of its own.

The plan (sources x blocks) is small: a source has at most ``16 ** MAX_PREFIX`` blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARDS = 16
#: a block should hold about so many words
BLOCK_WORDS = 1 << 20
MAX_PREFIX = 3

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def digest(doc_id):
    """Where a document stands in its source's permutation; a null id has a place too."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target``: one row per source.

    ``sizes``: source, size.  Sources in code point order, null last, take the weights in
    turn.  A source is cut off when its share would exceed its limit; sources are
    taken in the order of limit per weight, where those cut off come first.
    All comparisons are between whole numbers.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = by.select(
        "source",
        "source_size",
        F.row_number().over(order).alias("_rank"),
        F.element_at(weights, (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("bigint").alias("weight"),
        (F.col("source_size") * MAX_REPEATS).alias("_limit"),
    )
    by_limit = Window.orderBy(F.col("_limit") / F.col("weight"), "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.select(
        "*",
        F.row_number().over(by_limit).alias("_at"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))).alias("_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
    )
    cut = F.col("weight") * F.col("_words") > F.col("_limit") * F.col("_weights")
    first = lambda c: F.min(F.when(~cut, F.struct("_at", c))).over(everything)[c]
    share = (F.col("weight") * first("_words")).cast("double") / first("_weights").cast("double")
    return left.select(
        "source", "source_size", "weight", F.when(cut, F.col("_limit").cast("double")).otherwise(share).alias("target")
    )


def _block_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, block, source_size, target, rest, before, copies``.

    ``before``: words of the source's blocks up to this one; ``rest``: words of the last
    pass; ``copies``: how often the block is used, a last part included.
    """
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    same = blocks["source"].eqNullSafe(targets["source"])
    joined = blocks.join(targets, same).select(blocks["*"], "source_size", "target")
    wanted = F.round("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("bigint")
    running = Window.partitionBy("source").orderBy("block")
    planned = joined.select(
        "*",
        passes.alias("passes"),
        (wanted - passes * F.col("source_size")).alias("rest"),
        (F.sum("block_size").over(running) - F.col("block_size")).alias("before"),
    )
    used = (F.col("before") < F.col("rest")).cast("bigint")
    return planned.withColumn("copies", F.col("passes") + used)


def _uniform(*parts):
    """A number in [0, 1) that depends on its parts only."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / float(1 << 53)


def split_quotas(counts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``name, shard, quota`` from ``name, n``: n things of each name dealt to the shards.

    Shards differ by one thing at most in all.  At each node the things are met in order
    of name, and each goes left with probability (left places still free) / (things still
    to come): a draw without replacement, exact in total.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = counts.filter("n > 0").withColumn("node", F.lit(0).cast("bigint"))
    for level in range(shards.bit_length() - 1):
        group = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("all"))
        total = F.aggregate("all", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])

        def deal(state, x):
            start = F.struct(
                state["todo"].alias("todo"), state["free"].alias("free"), F.lit(0).cast("bigint").alias("left")
            )

            def one(s, i):
                takes = _uniform(F.col("node"), F.lit(level), x["name"], i) * s["todo"] < s["free"]
                return F.struct(
                    (s["todo"] - 1).alias("todo"),
                    (s["free"] - takes.cast("bigint")).alias("free"),
                    (s["left"] + takes.cast("bigint")).alias("left"),
                )

            done = F.aggregate(F.sequence(F.lit(1).cast("bigint"), x["n"]), start, one)
            return F.transform(
                F.array(done),
                lambda d: F.struct(
                    d["todo"].alias("todo"),
                    d["free"].alias("free"),
                    F.concat(
                        state["out"],
                        F.array(F.struct(x["name"].alias("name"), d["left"].alias("left"), (x["n"] - d["left"]).alias("right"))),
                    ).alias("out"),
                ),
            )[0]

        zero = F.struct(
            total.alias("todo"),
            F.ceil(total / 2).cast("bigint").alias("free"),
            F.expr("cast(array() as array<struct<name: bigint, left: bigint, right: bigint>>)").alias("out"),
        )
        dealt = group.select("node", F.explode(F.aggregate("all", zero, deal)["out"]).alias("x"))
        sides = F.explode(
            F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("x.left").alias("n")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.col("x.right").alias("n")),
            )
        )
        nodes = dealt.select(F.col("x.name").alias("name"), sides.alias("s")).select("name", "s.node", "s.n").filter("n > 0")
    return nodes.select("name", F.col("node").cast("int").alias("shard"), F.col("n").alias("quota"))


def _shards_of_copies(plan: DataFrame, shards: int) -> DataFrame:
    """``source, block, shards``: the output shard of every copy of a block, in pass order."""
    copies = plan.filter("copies > 0").select(
        "source", "block", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("name"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("pass"),
    )
    quotas = split_quotas(copies.groupBy("name").agg(F.count("*").alias("n")), shards)
    ends = quotas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("q"))
    placed = copies.withColumn(
        "rank", F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("name", "block", "pass"), "block", "pass"))
    ).join(ends, "name")
    # the first shard whose stretch reaches the rank
    found = F.aggregate(
        "q",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(None).cast("int").alias("shard")),
        lambda s, x: F.struct(
            (s["end"] + x["quota"]).alias("end"),
            F.coalesce(s["shard"], F.when(F.col("rank") <= s["end"] + x["quota"], x["shard"])).alias("shard"),
        ),
    )["shard"]
    return placed.withColumn("shard", found).groupBy("source", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards")
    )


def mix_plan(docs: DataFrame, shards: int = SHARDS, whole: bool = False) -> DataFrame:
    """``doc_id, source, digest, size, source_size, target, last, shards``, one row per document.

    ``shards`` has the output shard of every use of the document, in order; all uses
    take the document whole but, when ``last`` is not null, the last one, which takes
    ``last`` words (fewer than the size, more than 0).  With ``whole`` no document is cut:
    the one in which a source's last pass stops is used in it when at least half of its
    words were wanted, so a source misses its target by half a document at most.

    A null text has size 0 and is not used; a null source is a source; a null id is like
    any id.  Documents with equal ids keep a fixed order by size.  An empty table gives
    no rows.  Reruns give the same plan.
    """
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest(F.col("doc_id")).alias("digest"))
    sized, _ = stored(narrow, "sizes")
    words = sized.agg(F.sum("size")).first()[0] or 0
    prefix = 0
    while prefix < MAX_PREFIX and words > BLOCK_WORDS * 16**prefix:
        prefix += 1
    sized = sized.withColumn("block", F.substring("digest", 1, prefix))
    plan, _ = stored(_block_plan(sized, source_targets(sized.select("source", "size"))), "blocks")
    uses = _shards_of_copies(plan, shards)
    same = plan["source"].eqNullSafe(uses["source"]) & (plan["block"] == uses["block"])
    plan = plan.join(uses, same, "left").select(plan["*"], F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    mine = plan.select(
        F.col("source").alias("_source"), F.col("block").alias("_block"),
        "block_size", "source_size", "target", "passes", "rest", "before", "shards",
    )
    found = sized.join(mine, sized["source"].eqNullSafe(F.col("_source")) & (sized["block"] == F.col("_block"))).drop("_source", "_block")
    # only the one block per source in which the last pass stops needs an order of its documents
    stops = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("block_size") > F.col("rest"))
    within = Window.partitionBy("source", "block").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "source", "digest", "size", "source_size", "target", "passes", "shards"]
    untouched = found.filter(~stops).select(*columns, F.lit(None).cast("bigint").alias("given"))
    partly = found.filter(stops).select(
        *columns,
        F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - (F.sum("size").over(within) - F.col("size")))).cast("bigint").alias("given"),
    )
    if whole:
        partly = partly.withColumn("given", F.when(F.col("given") * 2 >= F.col("size"), F.col("size")).otherwise(0).cast("bigint"))
    uses = F.when(F.col("size") == 0, F.array().cast("array<int>")).when(
        F.col("given") == 0, F.slice("shards", F.lit(1), F.col("passes").cast("int"))
    ).otherwise(F.col("shards"))
    last = F.when((F.col("given") > 0) & (F.col("given") < F.col("size")), F.col("given"))
    return untouched.unionByName(partly).select(*columns[:6], last.alias("last"), uses.alias("shards"))


def mix_report(docs: DataFrame, shards: int = SHARDS, whole: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: how many words of each document the mix takes."""
    taken = F.size("shards") * F.col("size") - F.coalesce(F.col("size") - F.col("last"), F.lit(0))
    return mix_plan(docs, shards, whole).select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed(docs: DataFrame, shards: int = SHARDS, whole: bool = False) -> DataFrame:
    """The documents of the mix: every row as often as it is used, shard by shard, shuffled inside.

    All columns stay; the text of a last, partly used document ends after the words it gives,
    or with ``whole`` it is used whole or not at all (see ``mix_plan``).
    Rows of one id and size are alike to the plan: each gets the plan of one of them.
    """
    # the row travels as one struct, so its column names can clash with nothing
    own = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"),
        word_count(F.col("text")).alias("words"), F.xxhash64("*").alias("hash"),
    )
    nth = Window.partitionBy("id", "from", "words").orderBy("hash")
    own = own.select("row", "id", "from", "words", F.row_number().over(nth).alias("nth"))
    alike = Window.partitionBy("doc_id", "source", "size").orderBy(
        F.size("shards").desc(), F.col("last").asc_nulls_first(), F.col("shards").cast("string")
    )
    plan = mix_plan(docs, shards, whole).select("doc_id", "source", "size", "last", "shards", F.row_number().over(alike).alias("at"))
    same = (
        F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source"))
        & (F.col("words") == F.col("size")) & (F.col("nth") == F.col("at"))
    )
    used = own.join(plan, same).select("row", "id", "last", F.size("shards").alias("n"), F.posexplode("shards").alias("use", "shard"))
    # up to the end of the last word given: what follows is cut off
    partly = F.col("last").isNotNull() & (F.col("use") == F.col("n") - 1)
    kept = first_words(F.col("row.text"), F.col("last"))
    text = F.when(partly, kept).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(partly, F.char_length(kept).cast(kind)).otherwise(F.col("row.n_chars")))
    order = F.xxhash64("shard", "id", "use")
    dealt = used.select(row.alias("row"), "shard", order.alias("order")).repartition(shards, "shard")
    return dealt.sortWithinPartitions("shard", "order").select("row.*")


def first_words(text, n):
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")
