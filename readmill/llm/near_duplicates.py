"""Near-duplicate records with small edits: many universal hash minima, banding, verification.

1. Exact copies are put into classes by a 128-bit digest; only one representative goes on.
2. A record's signature holds, for each of `hashes` universal hash functions, the minimum over its q-grams with the
   place where it stands.  Every minimum is a band of one row: with edits spread over a short record few q-grams
   survive, so wider bands would lose links.  The shorter a record, the shorter its q-grams (`GRAMS`), so that a pair
   at the limit still shares some; a record a little above a step gives the minima of both lengths.
3. Representatives that share a band become a candidate pair, unless the places of the minimum or the lengths differ by
   more than the edits that are allowed: then the q-gram is not one that the edits left in place.
4. Candidates of over-full buckets must pass a signature of short q-grams and their places, whose bound refuses no near pair.
5. Candidates are verified by the edit distance with a bound, inside generated JVM code.

A q-gram that many records hold, such as an adapter, the core of a large family of edited copies or a low-complexity stretch,
makes over-full buckets.  Those are not thinned: buckets arrive sorted by place and are read as a stream, a bucket of more
than HOT records is dealt into blocks of SIDE, and every two blocks whose places come near enough are worked off in a task
of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions.flat import NONE, Rolling, flat, mix, symbol_values
from readmill.llm.components import connected_components
from readmill.plans.runtime import cut_lineage, digest, written

#: (least length, q) of records; the steps lie between the usual lengths of reads.
GRAMS = ((10, 5), (16, 7), (24, 9), (32, 10), (43, 11), (66, 12), (112, 13))
#: Records of a bucket beyond which its pairs are made in blocks; it decides where pairs are made, never which.
HOT = 40
#: Records of a block that an over-full bucket is dealt into.
SIDE = 2048
#: Rows of minima that a task sorts.
PART_ROWS = 1_000_000
#: Bits of a bucket's key; the place of the minimum and the length of the record follow it, each up to TOP.  All three are a positive number.
KEY_BITS, FIELD_BITS = 43, 10
TOP = (1 << FIELD_BITS) - 1
#: Length of the short q-grams for the lower bound of the edit distance, stretches of a record that they are told apart by, records compared at a time.
SHORT, SEGMENTS, ROWS = 4, 4, 64
#: Pairs that a task makes at a time.
BLOCK = 1 << 20


def record_grams(codes: np.ndarray, off: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(a q-gram's hash per position, whether one begins there)."""
    n, length = len(codes), np.diff(off)
    gram = np.zeros(n, np.uint64)
    if n >= q:
        gram[: n - q + 1] = Rolling(symbol_values(codes)).of(q)
    return gram, np.arange(n) + q <= np.repeat(off[1:], length)


def signatures(codes: np.ndarray, off: np.ndarray, q: int, hashes: int) -> np.ndarray:
    """(hashes x records) minima over the q-grams, with the place of the minimum in the low bits; all records must have a q-gram."""
    out = np.zeros((hashes, len(off) - 1), np.uint64)
    if not len(codes):
        return out
    gram, inside = record_grams(codes, off, q)
    place = np.minimum(np.arange(len(codes)) - np.repeat(off[:-1], np.diff(off)), TOP).astype(np.uint64)
    late = np.where(inside, place, NONE)
    rng = np.random.default_rng(20240229)
    high = gram >> np.uint64(32)
    for j in range(hashes):
        a, b = (int(x) | 1 for x in rng.integers(1, 1 << 62, 2))
        h = high * np.uint64(a) + np.uint64(b)
        h >>= np.uint64(FIELD_BITS)
        h <<= np.uint64(FIELD_BITS)
        h |= late
        out[j] = np.minimum.reduceat(h, off[:-1])
    return out


def gram_classes(length: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(q, records with q-grams of that length): two records within the limit always have a class together."""
    for k, (least, q) in enumerate(GRAMS):
        in_class = length >= least
        if k + 1 < len(GRAMS):
            # the longer one of a near pair may be beyond the step, as far as the shorter one allows
            in_class &= length * (100 - percent) < GRAMS[k + 1][0] * 100
        yield q, np.flatnonzero(in_class)


def bucket_keys(col: pa.Array, percent: int, hashes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(records, hashes x records of key, place and length) for every length of q-grams; keys differ between bands."""
    length = np.diff(flat(col)[1])
    for q, at in gram_classes(length, percent):
        if not len(at):
            continue
        sig = signatures(*flat(col.take(pa.array(at))), q, hashes)
        band = ((np.arange(hashes, dtype=np.uint64) + np.uint64(1000 * q)) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        key = mix((sig >> np.uint64(FIELD_BITS)) + band) >> np.uint64(64 - KEY_BITS)
        low = (sig & np.uint64(TOP)) << np.uint64(FIELD_BITS) | np.minimum(length[at], TOP).astype(np.uint64)
        yield at, key << np.uint64(2 * FIELD_BITS) | low


def _buckets(percent: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, keys in bucket_keys(b.column(1), percent, hashes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(ids[at], hashes))], names=["key", "id"]
                )

    return run


def _reach(packed: np.ndarray, percent: int) -> np.ndarray:
    """How far behind its own the place of a near record's minimum may lie; everything for a length or place that is cut off."""
    length, place = packed & np.uint64(TOP), packed >> np.uint64(FIELD_BITS) & np.uint64(TOP)
    far = length * np.uint64(percent) // np.uint64(100 - percent)
    return np.where((length * np.uint64(100) >= TOP * (100 - percent)) | (place + far >= TOP), np.uint64(TOP), place + far)


def _near_enough(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Places and lengths differ by no more than the edits that are allowed."""
    lx, ly = (v & np.uint64(TOP) for v in (x, y))
    px, py = ((v >> np.uint64(FIELD_BITS) & np.uint64(TOP)).astype(np.int64) for v in (x, y))
    most = (np.maximum(lx, ly) * np.uint64(percent) // np.uint64(100)).astype(np.int64)
    open_ = (np.maximum(lx, ly) == TOP) & (np.minimum(lx, ly) * np.uint64(100) >= TOP * (100 - percent))
    return open_ | (np.abs(px - py) <= most) & (np.abs(lx.astype(np.int64) - ly.astype(np.int64)) <= most)


MADE = ["a", "b", "block", "lo", "hi"]
MADE_SCHEMA = "a long, b long, block int, lo int, hi int"


def _made(a, b, block=None, lo=None, hi=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(len(b), pa.int64()) if a is None else pa.array(a), pa.array(b),
            *(pa.nulls(len(b), pa.int32()) if x is None else pa.array(np.full(len(b), x, np.int32)) for x in (block, lo, hi)),
        ],
        names=MADE,
    )


def _pairs(percent: int, hot: int, side: int):
    """Of sorted buckets: pairs (a, b); and of over-full ones members (a = id, b = key, block) and blocks (b = key, block, lo, hi)."""
    shift = np.uint64(2 * FIELD_BITS)

    def block_of(packed: np.ndarray, ids: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(ids), side):
            part = packed[a : a + side]
            key = np.full(len(part), part[0] >> shift, np.uint64).astype(np.int64)
            yield _made(ids[a : a + side], key, number)
            lo = int(part[0] >> np.uint64(FIELD_BITS) & np.uint64(TOP))
            yield _made(None, key[:1], number, lo, int(_reach(part, percent).max()))
            number += 1

    def small(packed: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of whole buckets."""
        key = packed >> shift
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(head, append=len(key))
        for h, n in zip(head[size > hot].tolist(), size[size > hot].tolist()):
            yield from block_of(packed[h : h + n], ids[h : h + n], 0)
        member = np.repeat((size > 1) & (size <= hot), size)
        at = np.flatnonzero(member)
        end = np.searchsorted(packed, key[at] << shift | _reach(packed[at], percent) << np.uint64(FIELD_BITS) | np.uint64(TOP), side="right")
        later = end - at - 1
        at, later = at[later > 0], later[later > 0]
        ends, done = np.cumsum(later), 0
        while done < len(at):
            base = ends[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
            c = later[done:to]
            left = np.repeat(at[done:to], c)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            near = _near_enough(packed[left], packed[right], percent)
            a, b = ids[left[near]], ids[right[near]]
            yield _made(np.minimum(a, b), np.maximum(a, b))
            done = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, ids, number = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for b in batches:
            packed = np.concatenate((packed, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            ids = np.concatenate((ids, b.column(1).to_numpy(zero_copy_only=False)))
            cut = int(np.searchsorted(packed, packed[-1] >> shift << shift)) if len(packed) else 0  # the last bucket may go on
            if cut:
                first = 0
                if number:  # the end of a bucket whose first blocks are out
                    first = int(np.searchsorted(packed, packed[0] | np.uint64((1 << 2 * FIELD_BITS) - 1), side="right"))
                    yield from block_of(packed[:first], ids[:first], number)
                    number = 0
                if cut > first:
                    yield from small(packed[first:cut], ids[first:cut])
                packed, ids = packed[cut:], ids[cut:]
            while len(packed) > side:
                yield from block_of(packed[:side], ids[:side], number)
                packed, ids, number = packed[side:], ids[side:], number + 1
        if len(packed) and number:
            yield from block_of(packed, ids, number)
        elif len(packed):
            yield from small(packed, ids)

    return run


# two bits a symbol, which tell the four bases and the four colours apart; other symbols that fall together only loosen the bound
_TWO_BITS = np.arange(256) & 3
_TWO_BITS[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def placed_grams(codes: np.ndarray, off: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(words x records) twice: the short q-grams that a record holds in each of SEGMENTS stretches of it, and those it holds there or within `slack` places.

    A q-gram that no edit touched stands in the other record at most as many places away as there are edits; an edit touches SHORT of them.
    """
    n, length = len(off) - 1, np.diff(off)
    own = np.zeros((n, SEGMENTS, 4**SHORT), bool)
    near = np.zeros((n, SEGMENTS, 4**SHORT), bool)
    if len(codes) >= SHORT:
        two = _TWO_BITS[codes & 255]
        gram = np.zeros(len(codes) - SHORT + 1, np.int64)
        for k in range(SHORT):
            gram = gram * 4 + two[k : k + len(gram)]
        owner = np.repeat(np.arange(n), length)[: len(gram)]
        at = np.flatnonzero(np.arange(len(gram)) + SHORT <= off[1:][owner])
        gram, owner = gram[at], owner[at]
        place = at - off[owner]
        size = max(1, -(-int(length.max()) // SEGMENTS))
        own[owner, np.minimum(place // size, SEGMENTS - 1), gram] = True
        low, high = np.maximum(place - slack, 0) // size, (place + slack) // size
        for k in range(int((high - low).max(initial=0)) + 1):
            near[owner, np.minimum(np.minimum(low + k, high), SEGMENTS - 1), gram] = True
    return tuple(np.ascontiguousarray(np.packbits(x.reshape(n, -1), axis=1).view(np.uint64).T) for x in (own, near))


def _cell(percent: int, hashes: int):
    """Pairs of two blocks of an over-full bucket, or of one block, that the lower bound lets through.

    A pair that shares several buckets comes from the one with the smallest key only.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, block, text = table["id"].to_numpy(), table["block"].to_numpy(), table["text"].combine_chunks()
        key = np.uint64(table["key"][0].as_py())
        codes, off = flat(text)
        length = np.diff(off)
        x, y = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        alone = block.min() == block.max()
        own, near_by = placed_grams(codes, off, int(length.max(initial=0)) * percent // 100)
        mine, others = own[:, x], ~near_by[:, y]
        left, right = [], []
        for a in range(0, len(x), ROWS):
            rows = x[a : a + ROWS]
            missing = np.zeros((len(rows), len(y)), np.uint16)
            for k in range(0, len(mine), 3):  # three words have fewer than 256 bits
                part = np.bitwise_count(mine[k, a : a + ROWS][:, None] & others[k][None, :])
                for one, other in zip(mine[k + 1 : k + 3], others[k + 1 : k + 3]):
                    part += np.bitwise_count(one[a : a + ROWS][:, None] & other[None, :])
                missing += part
            most = np.maximum(length[rows][:, None], length[y][None, :]) * percent // 100
            near = (missing <= SHORT * most) & (np.abs(length[rows][:, None] - length[y][None, :]) <= most)
            if alone:
                near &= ids[rows][:, None] < ids[y][None, :]
            i, j = np.nonzero(near)
            left.append(rows[i])
            right.append(y[j])
        i, j = np.concatenate(left), np.concatenate(right)
        if len(i):
            used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
            i, j = place[: len(i)], place[len(i) :]
            before = np.zeros(len(i), bool)
            for at, keys in bucket_keys(text.take(pa.array(used)), percent, hashes):
                where = np.full(len(used), -1)
                where[at] = np.arange(len(at))
                both = np.flatnonzero((where[i] >= 0) & (where[j] >= 0))
                for packed in keys:
                    u, v = packed[where[i[both]]], packed[where[j[both]]]
                    same = (u ^ v) >> np.uint64(2 * FIELD_BITS) == 0
                    before[both] |= same & (u >> np.uint64(2 * FIELD_BITS) < key) & _near_enough(u, v, percent)
            i, j = used[i[~before]], used[j[~before]]
        a, b = ids[i], ids[j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _block_pairs(made: DataFrame, reps: DataFrame, percent: int, hashes: int) -> DataFrame:
    """Candidates of the over-full buckets: blocks of a bucket whose places come near enough meet in one group of 2 * SIDE records at most."""
    members = made.filter("a is not null and block is not null").select(F.col("a").alias("id"), F.col("b").alias("key"), "block")
    blocks = made.filter("a is null").select(F.col("b").alias("key"), "block", "lo", "hi")
    other = blocks.select("key", F.col("block").alias("later"), F.col("lo").alias("lo_later"))
    cells = blocks.join(other.hint("merge"), "key").filter("block <= later and lo_later <= hi").select("key", F.col("block").alias("x"), F.col("later").alias("y"))
    sides = cells.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return (
        members.join(sides.hint("merge"), ["key", "block"])
        .join(reps.hint("merge"), "id")
        .select("key", "x", "y", "block", "id", "text")
        .groupBy("key", "x", "y")
        .applyInArrow(_cell(percent, hashes), "a long, b long")
    )


def within(a: Column, b: Column, percent: int) -> Column:
    """The edit distance of two texts is at most `percent` of the longer one's length."""
    most = (F.greatest(F.length(a), F.length(b)) * percent / 100).cast("int")
    return F.call_function("levenshtein", a, b, most) >= 0


def _verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that are near enough."""
    left = reps.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = reps.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    longer, shorter = F.greatest(F.length("text_a"), F.length("text_b")), F.least(F.length("text_a"), F.length("text_b"))
    return (
        pairs.join(left.hint("merge"), "a")
        .join(right.hint("merge"), "b")
        .filter((longer - shorter) * 100 <= longer * percent)
        .filter(within(F.col("text_a"), F.col("text_b"), percent))
        .select("a", "b")
    )


def classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(representatives: id, text) and (id, rep) of the other members of classes of equal texts."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    h1, h2 = digest(F.col("text"))
    src = src.withColumn("h1", h1).withColumn("h2", h2)
    reps = src.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.max("id").alias("_hi"), F.first("text").alias("text"))
    several = reps.filter("id < _hi").select("h1", "h2", F.col("id").alias("rep"))
    members = (
        src.select("id", "h1", "h2")
        .join(several.hint("merge"), ["h1", "h2"])
        .filter("id <> rep")
        .select("id", "rep")
        .distinct()
    )
    return reps.select("id", "text"), members


def near_links(df: DataFrame, id_col: str, text_col: str, percent: int = 10, hashes: int = 24) -> tuple[DataFrame, DataFrame]:
    """(links between representatives a < b of different texts, members (id, rep) of classes of equal texts).

    Two texts are linked if their edit distance is at most `percent` of the longer one's length, found with
    the recall of the hash minima (measured in the README), and never wrongly.  Rows with a null id or text
    take no part; rows that repeat an id and text count once.  Empty texts form a class of their own and
    have no link to others.  Texts shorter than 100 / percent symbols can only have equal partners; the lengths of the
    q-grams (GRAMS) are chosen for a limit of 10 %, for texts from 10 symbols on.
    """
    spark = df.sparkSession
    n = df.count()
    reps, members = classes(df, id_col, text_col)
    reps = written(reps)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * hashes // PART_ROWS))
    long_enough = reps.filter(F.length("text") * percent >= 100)
    buckets = long_enough.mapInArrow(_buckets(percent, hashes), "key long, id long")
    # a bucket is in one partition, which is read as a sorted stream
    made = written(
        buckets.repartition(parts, F.shiftright("key", 2 * FIELD_BITS))
        .sortWithinPartitions("key")
        .mapInArrow(_pairs(percent, HOT, SIDE), MADE_SCHEMA)
    )
    pairs = made.filter("block is null").select("a", "b")
    candidates = pairs.unionByName(_block_pairs(made, reps, percent, hashes)).filter("a < b").distinct()
    return _verified(candidates, reps, percent), members


#: Classes of equal texts up to this size are listed pair by pair; a larger one as pairs with its representative.
LISTED = 1000


def near_pairs(df: DataFrame, id_col: str, text_col: str, listed: int = LISTED, **kw: int) -> DataFrame:
    """(a, b), a < b: all pairs of ids whose texts are equal or near (see near_links).

    Links between representatives are carried over to all members of both classes.  Inside a class of more
    than `listed` equal texts, and for its links, the pairs go through the representative only: every member
    is paired with it, which names the class without listing its square.
    """
    links, members = near_links(df, id_col, text_col, **kw)
    links, members = cut_lineage(links), cut_lineage(members)
    size = members.groupBy("rep").count()
    small = members.join(size.filter(F.col("count") < listed).select("rep").hint("merge"), "rep", "left_semi")
    rest = small.select(F.col("rep").alias("a"), F.col("id").alias("a2"))
    own = members.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    inner = (
        small.alias("x")
        .join(small.alias("y").hint("merge"), F.col("x.rep") == F.col("y.rep"))
        .filter("x.id < y.id")
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    )

    def spread(pairs: DataFrame, side: str) -> DataFrame:
        more = pairs.join(
            rest.select(F.col("a").alias(side), F.col("a2")).hint("merge"), side
        ).withColumn(side, F.col("a2"))
        return pairs.unionByName(more.select("a", "b"))

    between = spread(spread(links, "a"), "b")
    return own.unionByName(inner).unionByName(between).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_groups(df: DataFrame, id_col: str, text_col: str, **kw: int) -> DataFrame:
    """(id, group_id, links): every row with an id and text, its component's smallest id, its number of near partners.

    A row without a partner is its own group.  `links` counts the partners of different text of the row's
    representative and the other copies of its text.
    """
    links, members = near_links(df, id_col, text_col, **kw)
    links, members = cut_lineage(links), cut_lineage(members)
    comp = connected_components(links, "a", "b").select(F.col("id").alias("rep"), F.col("component"))
    both = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    degree = both.groupBy("rep").agg(F.count("*").alias("near"))
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    ids = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t")).filter("id is not null and _t is not null").select("id").distinct()
    named = ids.join(members.hint("merge"), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return (
        named.join(comp.hint("merge"), "rep", "left")
        .join(degree.hint("merge"), "rep", "left")
        .join(copies.hint("merge"), "rep", "left")
        .select(
            "id",
            F.coalesce("component", "rep").alias("group_id"),
            (F.coalesce("near", F.lit(0)) + F.coalesce("copies", F.lit(0))).cast("long").alias("links"),
        )
    )
