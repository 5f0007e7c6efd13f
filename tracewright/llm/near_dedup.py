"""MinHash near-dedup by an inverted join over signature coordinates.

Every whole text becomes its set of distinct five-word shingles; documents with equal sets form a class, so copies cost
one entry. A class has ``SIGNATURE`` MinHash coordinates. Two sets with Jaccard 0.75 agree on 24 of 32 on average, and on
fewer than ``MATCHES`` = 10 with probability 3.4e-8, so pairs with at least MATCHES equal coordinates are the candidates.

Coordinate-value pairs (tokens) are ordered by rarity. Classes with MATCHES equal tokens share one among the rarest
``SIGNATURE - MATCHES + 1`` of each (prefix); tokens that no other class has need no posting, and common ones, such as those of a
passage in many documents, are mostly skipped. Posted classes meet per token:

1. In lists of fewer than ``SMALL`` classes all pairs meet, so at most SMALL / 2 for each posting.
2. In longer lists every class meets two pivots of the list, and what is linked so far is merged into components.
3. Members of a longer list that are still in different components then meet: those outside the list's largest component with each other and with
   those inside, in blocks of two parts of the list, which give nothing but links: equal tokens are counted, and full sets compared, bit by bit, at
   the pair's first common coordinate alone. No link between components is lost. A group of many near copies, whatever its outsiders, costs rows in
   proportion to its members; m outsiders of n members cost m n / PART rows.

Links are confirmed on the full sets, which are computed again for the posted classes alone.

Null and empty texts have no shingles and no links; texts of fewer words than a shingle have one, the whole sequence.
Repeated rows fall into one class. A null ``doc_id`` counts as the largest. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, bitmap_of, bounded_batches, hot_from, hot_join, in_bitmap, kept_rows, stage, text_key, tidy, unstage, with_row_id
from .words import SHINGLE, mixed, shingles

SIGNATURE, MATCHES, PERCENT = 32, 10, 75
#: Bits of the bitmap that names the rows whose full sets are needed; it only filters.
BITMAP_BITS = 1 << 22
#: Posting lists from this length on are long.
SMALL = 64
#: A longer list than this is cut into parts, two of which are compared at once.
PART = 2048
_A = np.array([xxhash.xxh3_64_intdigest(b"a%d" % i) | 1 for i in range(SIGNATURE)], dtype=np.uint64)[:, None]
_B = np.array([xxhash.xxh3_64_intdigest(b"b%d" % i) for i in range(SIGNATURE)], dtype=np.uint64)[:, None]
_TAGS = np.arange(SIGNATURE, dtype=np.uint64) << np.uint64(32)
_BLOCK = 4096
#: Gives the second pivot another order.
_MIX = 0x5DEECE66D


def signature(hashes: np.ndarray) -> list[int]:
    """For each of SIGNATURE random orders the smallest value, its upper half tagged with the order's number."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, mixed(hashes[None, i : i + _BLOCK] * _A + _B).min(axis=1))
    return ((least >> np.uint64(32)) | _TAGS).astype(np.int64).tolist()


def set_id(hashes: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype=np.int64)
    return int(digest[0]), int(digest[1])


_CLASS = ["set_a", "set_b", "n_shingles"]


def _scanned(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text_key, set id and signature of every row."""
    out_type = f"row_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, set_a long, set_b long, n_shingles long, signature array<long>"

    def run(batches):
        for batch in batches:
            out = []
            for row, doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(text)
                out.append((row, doc, key, *(set_id(own) if len(own) else (0, 0)), len(own), signature(own) if len(own) else []))
            yield arrow_batch(out, out_type)

    rows = with_row_id(docs.select("doc_id", text_key().alias("text_key"), "text"))
    return rows.select("row_id", "doc_id", "text_key", "text").mapInArrow(run, out_type)


def _full_sets(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """class_id, size, signature and full set of the posted classes, from a second scan."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(bitmap_of(posted.select(F.xxhash64("first_doc").alias("hash")), BITMAP_BITS))

    def run(batches):
        for batch in batches:
            wanted = in_bitmap(bitmap.value, batch.column(0).to_numpy())
            out = []
            for text in batch.column(1).filter(wanted).to_pylist():
                own = shingles(text)
                if len(own):
                    out.append((*set_id(own), len(own), own.view(np.int64).tolist()))
            yield arrow_batch(out, "set_a long, set_b long, n_shingles long, hashes array<long>")

    found = docs.select(F.xxhash64("doc_id").alias("hash"), "text").mapInArrow(run, "set_a long, set_b long, n_shingles long, hashes array<long>")
    return stage(posted.select("class_id", "signature", *_CLASS).join(found, _CLASS).dropDuplicates(["class_id"]).select("class_id", "n_shingles", "signature", "hashes"), "sets")


def _near(size_a: Column, size_b: Column) -> Column:
    return (size_a * 100 >= size_b * PERCENT) & (size_b * 100 >= size_a * PERCENT)


def _linked(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(f"hashes_{a}", f"hashes_{b}"))
    return 100 * both >= PERCENT * (F.col(f"size_{a}") + F.col(f"size_{b}") - both)


def _alike(a: str, b: str) -> Column:
    return F.size(F.array_intersect(f"signature_{a}", f"signature_{b}")) >= MATCHES


def _side(df: DataFrame, x: str, *more: str) -> DataFrame:
    return df.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"size_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more])


def _confirmed(pairs: DataFrame, posted: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those with enough equal tokens and, on the full sets, enough similarity."""
    close = pairs.join(_side(posted, "a", "signature"), "a").join(_side(posted, "b", "signature"), "b")
    close = stage(close.where(_near(F.col("size_a"), F.col("size_b")) & _alike("a", "b")).select("a", "b"), "close")
    full = close.join(_side(sets, "a", "hashes"), "a").join(_side(sets, "b", "hashes"), "b")
    return stage(full.where(_linked("a", "b")).select("a", "b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with edges (a, b); a component is named by its smallest node.

    Alternates large and small stars until nothing changes; all tables stay distributed.
    """
    star = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    seen = None
    while True:
        before = star
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "stars")
        unstage(before)
        state = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    own = star.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return own.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


@tidy
def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document row: row_id, doc_id, text_key, n_shingles, component, component_id, kept.

    ``component`` is the smallest class of the row's component, null for rows without words. ``component_id``, its smallest
    doc_id, can be null or belong to several components where ids are null or repeat.
    """
    bounded_batches(docs.sparkSession)
    scanned = stage(_scanned(docs), "signatures")
    own_classes = scanned.where("n_shingles > 0").groupBy(*_CLASS).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    classes = stage(own_classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    tokens = classes.select("class_id", F.explode("signature").alias("token"))
    shared = stage(tokens.groupBy("token").agg(F.count("*").alias("uses")).where("uses > 1").withColumn("n", F.col("uses")), "shared")
    n_classes = classes.count()
    ranked = hot_join(tokens, shared, ["token"], "n", n_classes * SIGNATURE).groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("uses", "token"))).alias("ranked"))
    # a class's own tokens come first in its prefix and need no posting
    places = F.size("ranked") - MATCHES + 1
    prefix = F.transform(F.slice("ranked", F.lit(1), F.greatest(places, F.lit(0))), lambda x: x["token"])
    posted = stage(ranked.where(places > 0).withColumn("prefix", prefix).drop("ranked").join(classes, "class_id"), "posted")
    sets = _full_sets(docs, posted)
    postings = stage(posted.select("class_id", "n_shingles", F.explode("prefix").alias("token")), "postings")
    lists = stage(postings.groupBy("token").agg(F.count("*").alias("n"), F.min("class_id").alias("first"), F.min(F.col("class_id").bitwiseXOR(F.lit(_MIX))).bitwiseXOR(F.lit(_MIX)).alias("second")).where("n > 1"), "lists")
    n_postings = postings.count()
    hot = F.broadcast(lists.where(F.col("n") >= hot_from(n_postings)).select("token"))  # HOT_SHARE at most; none of them is short
    short = postings.join(hot, "token", "left_anti").join(lists.where(F.col("n") < SMALL).select("token"), "token")
    members = short.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("class_id", "n_shingles"))).alias("members"))  # fewer than SMALL
    later = members.select(F.posexplode("members").alias("at", "one"), "members").select("one", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("two"))
    met = later.where(_near(F.col("one.n_shingles"), F.col("two.n_shingles"))).select(F.col("one.class_id").alias("a"), F.col("two.class_id").alias("b"))
    met = stage(met, "met")
    long_lists = stage(lists.where(F.col("n") >= SMALL), "long")
    for pivot in ("first", "second"):
        star = hot_join(postings.select("token", "class_id"), long_lists.select("token", "n", F.col(pivot).alias("pivot")), ["token"], "n", n_postings)
        met = met.unionByName(star.where("class_id <> pivot").select(F.least("class_id", "pivot").alias("a"), F.greatest("class_id", "pivot").alias("b")).distinct())
    links = _confirmed(met.distinct(), posted, sets)
    grouped = stage(components(links), "components")
    more = _left_over(postings.join(long_lists.select("token", "n"), "token"), posted, sets, grouped)
    if not more.isEmpty():
        grouped = stage(components(links.unionByName(more)), "components")
    first = classes.join(grouped.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    named = first.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    own = stage(first.join(named, "component").select(*_CLASS, "component", "component_id", "copies"), "named")
    in_class = hot_join(scanned.where("n_shingles > 0").drop("signature"), own, _CLASS, "copies", scanned.count())
    alone = scanned.where("n_shingles = 0").drop("signature").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return in_class.unionByName(alone).select("row_id", "doc_id", "text_key", "n_shingles", "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links_between(sizes: np.ndarray, groups: np.ndarray, tokens: np.ndarray, posted: np.ndarray, bits: np.ndarray, coordinate: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Positions (a, b), a in ``left`` and b in ``right``, of links between components, at their first common coordinate alone."""
    out, both = [], left is right
    for k, a in enumerate(left.tolist()):
        b = right[k + 1 :] if both else right
        b = b[(groups[b] != groups[a]) & (sizes[b] * 100 >= sizes[a] * PERCENT) & (sizes[a] * 100 >= sizes[b] * PERCENT)]
        if not len(b):
            continue
        equal = tokens[b] == tokens[a]
        first = (equal & posted[b] & posted[a]).argmax(axis=1)
        keep = (equal.sum(axis=1) >= MATCHES) & (first == coordinate)
        b = b[keep]
        common = np.bitwise_count(bits[b] & bits[a]).sum(axis=1, dtype=np.int64)
        out += [(a, x) for x in b[100 * common >= PERCENT * (sizes[a] + sizes[b] - common)].tolist()]
    return out


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between two parts of one posting list; a group has at most 2 * PART rows."""
    token, i, j = (x.as_py() for x in key)
    n = rows.num_rows
    column = lambda name: rows[name].combine_chunks()
    part, ids = column("part").to_numpy(), column("class_id").to_numpy()
    tokens = column("signature").flatten().to_numpy().reshape(n, SIGNATURE)
    prefix = column("prefix")
    posted = np.zeros((n, SIGNATURE), dtype=bool)
    posted[np.repeat(np.arange(n), prefix.value_lengths().to_numpy()), prefix.flatten().to_numpy() >> 32] = True
    # only shingles that two members share can be common: they get a bit
    hashes = column("hashes")
    owner = np.repeat(np.arange(n), hashes.value_lengths().to_numpy())
    _, slot, uses = np.unique(hashes.flatten().to_numpy(), return_inverse=True, return_counts=True)
    place = np.cumsum(uses > 1) - 1
    shared = uses[slot] > 1
    owner, place = owner[shared], place[slot[shared]]
    bits = np.zeros((n, int(place.max()) // 64 + 1 if len(place) else 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    left = np.flatnonzero(part == i)
    right = left if i == j else np.flatnonzero(part == j)
    found = _links_between(column("n_shingles").to_numpy(), column("component").to_numpy(), tokens, posted, bits, token >> 32, left, right)
    return pa.table({"a": pa.array([ids[a] for a, _ in found], pa.int64()), "b": pa.array([ids[b] for _, b in found], pa.int64())})


def _left_over(postings: DataFrame, posted: DataFrame, sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """Links between members of one long list (postings with its length ``n``) that are in different components.

    A list is dealt into parts of about PART members by hash, first those of all but its largest component, then those of the largest. Each two parts, and
    each part with itself, meet in a group of their own, unless both are of the largest component.
    """
    marked = postings.join(grouped.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    marked = stage(marked, "marked")
    shares = marked.groupBy("token", "component").agg(F.count("*").alias("m"))
    lists = shares.groupBy("token").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("components")).where("components > 1")
    parts = lambda m: F.ceil(m / PART).cast("int")
    lists = lists.select("token", "n", F.col("most.component").alias("main"), parts(F.col("n") - F.col("most.m")).alias("others"), parts(F.col("most.m")).alias("mains"))
    lists = stage(lists, "open")
    is_main = F.col("component") == F.col("main")
    slot = lambda count: F.pmod(F.xxhash64("class_id"), F.col(count)).cast("int")
    dealt = hot_join(marked.drop("n"), lists, ["token"], "n", marked.count())
    dealt = dealt.withColumn("part", F.when(is_main, F.col("others") + slot("mains")).otherwise(slot("others")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    dealt = dealt.select("token", "class_id", "n_shingles", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    rows = dealt.join(posted.select("class_id", "prefix", "signature"), "class_id").join(sets.select("class_id", "hashes"), "class_id")
    return stage(rows.groupBy("token", "i", "j").applyInArrow(_compare, "a long, b long").distinct(), "links")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of the smallest id, null ids last, and of these the first row."""
    groups = near_groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    first = groups.where("component is not null").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.row_id").alias("first_row"))
    kept = groups.join(first, F.col("row_id") == F.col("first_row"), "left")
    return kept_rows(docs, kept.select("doc_id", "text_key", (F.col("first_row").isNotNull() | (F.col("n_shingles") == 0)).alias("kept")))
