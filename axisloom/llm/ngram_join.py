"""Exact near-copy groups: documents whose 5-word shingle sets have Jaccard 0.8 or more.

1. Shingles are 64-bit hashes in hash order.  Two linked sets share at least k shingles
   of their *extended prefixes* (the first n - ceil(0.8 n) + k).  k grows with the set, so
   a set needs k shingles in its prefix that other documents have too: corpus-wide
   document counts of prefix shingles (``lookup``) drop all sets that have fewer.
2. Equal sets become one class.
3. What is left of a prefix is put in order of rarity; its first tokens, all but k - 1,
   are indexed.  Classes that share an index token may be linked; connected classes
   form a family.
4. Families are verified exactly, in packs of small ones; a large one is cut into
   blocks and every pair of blocks is one task, so no task has more than two blocks.
   Tasks report how many documents each class is linked with and a spanning forest
   of the links, never all pairs.
5. Numbers of links are added up by class; components of the forests are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .components import components
from .lookup import with_counts
from .words import SPACE, Words, distinct_per_doc, doc_digest, range_hashes, slices, window_hashes

SHINGLE = 5
#: links have 100 * intersection >= PERCENT * union
PERCENT = 80
#: shingles that linked prefixes share at least, as a percentage of the smaller set
SHARE = 25
#: classes of a block
BLOCK = 1024
#: a table of so many bytes may be broadcast; it is counted first, and joined by shuffle beyond
MAX_BROADCAST_BYTES = 16 << 20
#: bytes of shingles in a pack of small families
PACK_BYTES = 4 << 20


def least_kept(n, percent: int = PERCENT):
    """The smallest intersection with a set of n that a link allows: ceil(percent n / 100)."""
    return -(-np.asarray(n, dtype=np.int64) * percent // 100)


def shared(n):
    """k for a set of n shingles."""
    return np.maximum(1, np.asarray(n, dtype=np.int64) * SHARE // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """(document, hash) of distinct shingles, sorted; short texts are one shingle."""
    words = Words(data, offsets, SPACE, lower=True)
    hashes, starts = window_hashes(words.hash, words.doc, size)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        first = words.first[short]
        whole = range_hashes(words.hash, first, first + words.count[short])
        return distinct_per_doc(np.concatenate((words.doc[starts], short)), np.concatenate((hashes, whole)))
    return distinct_per_doc(words.doc[starts], hashes)


def _sets(column):
    for a, b, data, offsets in slices(column):
        doc, hashes = shingle_sets(data, offsets)
        yield doc, hashes, np.searchsorted(doc, np.arange(b - a + 1))


def _prefix(n: np.ndarray) -> np.ndarray:
    return n - least_kept(n) + shared(n)


def _prefix_mask(bounds: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return np.arange(len(doc)) - bounds[doc] < _prefix(np.diff(bounds))[doc]


def shingled(docs: DataFrame) -> DataFrame:
    """``doc_id, n, d1, d2, tokens, index``: set size, set digest and, where links are possible,
    the set (sorted uint64, packed) and its index tokens."""

    def grams(docs: pa.Table):
        found = [hashes[_prefix_mask(bounds, doc)] for doc, hashes, bounds in _sets(docs.column("text"))]
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def use(docs: pa.Table, known: np.ndarray, totals: np.ndarray) -> pa.Table:
        size, d1, d2, tokens, index = [], [], [], [], []
        for doc, hashes, bounds in _sets(docs.column("text")):
            n = np.diff(bounds)
            size.append(n)
            for out, x in zip((d1, d2), doc_digest(doc, hashes, len(n))):
                out.append(x.view(np.int64))
            place = np.flatnonzero(_prefix_mask(bounds, doc))
            count = totals[np.searchsorted(known, hashes[place])]
            place, count = place[count > 1], count[count > 1]
            # by document, rarest first
            order = np.lexsort((hashes[place], count, doc[place]))
            place = place[order]
            ends = np.searchsorted(doc[place], np.arange(len(n) + 1))
            # a partner may be smaller, and its k with it
            needs = shared(least_kept(n))
            for d in range(len(n)):
                m = ends[d + 1] - ends[d]
                if n[d] and m >= needs[d]:
                    tokens.append(hashes[bounds[d] : bounds[d + 1]].tobytes())
                    index.append(hashes[place[ends[d] : ends[d] + m - needs[d] + 1]].view(np.int64))
                else:
                    tokens.append(None)
                    index.append(None)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n": pa.array(np.concatenate(size), pa.int64()),
                "d1": pa.array(np.concatenate(d1)),
                "d2": pa.array(np.concatenate(d2)),
                "tokens": pa.array(tokens, pa.binary()),
                "index": pa.array(index, pa.list_(pa.int64())),
            }
        )

    schema = "doc_id BIGINT, n BIGINT, d1 BIGINT, d2 BIGINT, tokens BINARY, index ARRAY<BIGINT>"
    return with_counts(docs, grams, use, schema, grams_per_byte=0.08)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over the tokens both sides have."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = max(1, (8 << 20) // (len(left) + len(right)))

    def places(sets):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(common, flat)
        at[at == len(common)] = 0
        good = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        return owner[good], at[good]

    (lo, la), (ro, ra) = places(left), places(right)
    for first in range(0, len(common), width):
        size = min(width, len(common) - first)
        blocks = []
        for owner, at, n in ((lo, la, len(left)), (ro, ra, len(right))):
            here = (at >= first) & (at < first + size)
            m = np.zeros((n, size), dtype=np.float32)
            m[owner[here], at[here] - first] = 1
            blocks.append(m)
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)


class Forest:
    """Union-find that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))


def _verify(pack: pa.Table) -> pa.Table:
    """Two kinds of rows: spanning links (u, v) of the families, or pair of blocks, in a pack,
    and per linked class (d1, d2, n) the number of documents in the classes it is linked with."""
    family = pack.column("family").to_numpy()
    side = pack.column("side").to_numpy()
    rep = pack.column("rep").to_numpy()
    size = pack.column("n").to_numpy()
    members = pack.column("docs").to_numpy()
    # a block that met no other block has its own task, where it counts
    lonely = pack.column("i")[0].as_py() != pack.column("j")[0].as_py()
    tokens = [np.frombuffer(t, "<u8") for t in pack.column("tokens").to_pylist()]
    order = np.lexsort((rep, side, family))
    starts = np.flatnonzero(np.diff(family[order], prepend=family[order[0]] - 1))
    us, vs = [], []
    partners = np.zeros(len(rep), dtype=np.int64)
    for rows in np.split(order, starts[1:]):
        sides = side[rows]
        two = sides[0] != sides[-1]
        if lonely and not two:
            continue
        a = rows[sides == sides[0]]
        b = rows[sides == sides[-1]]
        both = intersections([tokens[i] for i in a], [tokens[i] for i in b])
        union = size[a][:, None] + size[b][None, :] - both
        linked = 100 * both >= PERCENT * union
        if two:
            partners[b] += linked.T @ members[a]
        else:
            np.fill_diagonal(linked, False)
        partners[a] += linked @ members[b]
        x, y = np.nonzero(linked)
        both_sides = np.concatenate((a, b)) if two else a
        forest = Forest(len(both_sides))
        for i, j in zip(x.tolist(), (y + len(a) if two else y).tolist()):
            forest.link(i, j)
        us += [rep[both_sides[i]] for i, _ in forest.links]
        vs += [rep[both_sides[j]] for _, j in forest.links]
    some = np.flatnonzero(partners)
    no_link, no_class = pa.nulls(len(some), pa.int64()), pa.nulls(len(us), pa.int64())
    links = pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64()), "d1": no_class, "d2": no_class, "n": no_class, "partners": no_class})
    counts = {k: pack.column(k).take(pa.array(some)) for k in ("d1", "d2", "n")}
    return pa.concat_tables([links, pa.table({"u": no_link, "v": no_link, **counts, "partners": pa.array(partners[some])})])


def _families(index: DataFrame) -> DataFrame:
    """``rep, family, members`` of classes (rep, index) that share index tokens with others."""
    tokens, _ = stored(index.select("rep", F.explode("index").alias("token")), "index")
    hubs = tokens.groupBy("token").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).filter("m > 1")
    near = tokens.join(hubs, "token").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    found, _ = stored(components(near).select(F.col("node").alias("rep"), F.col("component").alias("family")), "families")
    return found.join(found.groupBy("family").agg(F.count("*").alias("members")), "family")


def _measured(table: DataFrame, row_bytes: int = 64) -> DataFrame:
    """The (stored) table, marked for broadcast when its size is known to be small."""
    return F.broadcast(table) if table.count() * row_bytes <= MAX_BROADCAST_BYTES else table


def _links(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Spanning links (u, v) between classes, and their numbers of partners, as ``_verify`` has
    them; the packed sets are dealt out once, by task."""
    keys = ["d1", "d2", "n"]
    reps = _measured(groups.select(*keys, F.col("rep").alias("doc_id")))
    # rows that repeat an id and a set are alike
    index = sets.select("doc_id", *keys, "index").join(reps, [*keys, "doc_id"], "left_semi")
    # an id may stand for several sets: each is a class, and the id joins them
    families = _families(index.select(F.col("doc_id").alias("rep"), "index"))
    placed, _ = stored(groups.join(families, "rep"), "placed")
    total = int(placed.agg(F.sum("n")).first()[0] or 0) * 8
    packs = max(1, -(-total // PACK_BYTES))
    own = sets.select("doc_id", *keys, "tokens").join(_measured(placed.withColumnRenamed("rep", "doc_id")), [*keys, "doc_id"])
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    b = F.when(F.col("members") > BLOCK, F.pmod(F.xxhash64("doc_id"), blocks)).cast("int")
    everything = own.select(
        "family", "members", "docs", "doc_id", *keys, "tokens", b.alias("b"),
        F.explode(F.when(F.col("members") > BLOCK, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(-1)))).alias("other"),
    )
    large = F.col("b").isNotNull()
    dealt = everything.select(
        F.when(large, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(packs))).alias("pack"),
        F.least("b", "other").alias("i"),
        F.greatest("b", "other").alias("j"),
        "docs",
        "family",
        F.coalesce("b", F.lit(-1)).alias("side"),
        F.col("doc_id").alias("rep"),
        *keys,
        "tokens",
    )
    schema = "u BIGINT, v BIGINT, d1 BIGINT, d2 BIGINT, n BIGINT, partners BIGINT"
    return dealt.groupBy("pack", "i", "j").applyInArrow(_verify, schema)


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` per row of docs (doc_id, text).

    Words are runs without white space, A-Z lower-cased.  A null text or one without
    words has an empty set and is linked with nothing.  Rows of one id count as one
    document.  A null id gets the component of an equal set, else null.

    ``n_links``: how many other documents the row is linked with directly, copies
    included.  An id with several sets counts once for each; rows with a null id are nobody's
    partner, and have the links of an equal set, or null where the component is null.
    """
    sets, _ = stored(shingled(docs), "shingles")
    keys = ["d1", "d2", "n"]
    possible = sets.filter("tokens IS NOT NULL")
    # by id first: a class of many copies is dealt out
    by_id = possible.filter("doc_id IS NOT NULL").groupBy(*keys, "doc_id").agg(F.lit(1).alias("once"))
    groups, _ = stored(by_id.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs")), "classes")
    found, _ = stored(_links(possible, groups), "links")
    links = found.filter("u IS NOT NULL").select("u", "v")
    counts = found.filter("partners IS NOT NULL").groupBy(*keys).agg(F.sum("partners").alias("partners"))
    linked = groups.join(counts, keys, "left").select(*keys, F.col("rep").alias("_rep"), "docs", F.coalesce("partners", F.lit(0)).alias("partners"))
    linked, _ = stored(linked, "linked")
    mates = possible.filter("doc_id IS NOT NULL").join(groups, keys).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found, _ = stored(components(links.unionAll(mates)), "groups")
    plain = sets.select("doc_id", *keys).join(linked, keys, "left")
    named = plain.withColumn("_node", F.coalesce("doc_id", "_rep")).join(found, F.col("_node") == F.col("node"), "left")
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    n_links = F.when(F.col("_node").isNotNull(), F.coalesce(F.col("docs") - own + F.col("partners"), F.lit(0)))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "_node").alias("component_id"), n_links.cast("bigint").alias("n_links")
    )


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest id, all columns as they were.

    Of rows that repeat this id, those whose text comes first stay one row; rows with a
    null id or without words belong to no group and stay.
    """
    groups = near_copy_groups(docs).filter("n_shingles > 0 AND doc_id IS NOT NULL")
    by_id = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("group"))
    odd = by_id.filter("rows > 1 OR group <> doc_id").select("doc_id", (F.col("group") == F.col("doc_id")).alias("stays"))
    # the row travels as one struct, so its column names can clash with nothing
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    marked = own.join(odd, F.col("id") == F.col("doc_id"), "left")
    plain = marked.filter("stays IS NULL").select("row.*")
    first = Window.partitionBy("id").orderBy(F.col("row.text").asc_nulls_last(), F.xxhash64("row"))
    once = marked.filter("stays").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return plain.unionAll(once.select("row.*"))
