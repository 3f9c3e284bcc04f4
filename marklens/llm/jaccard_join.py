"""N-gram Jaccard join: an exact metric-space join of documents by the sets of their word shingles.

Distance is d(A, B) = 1 - |A & B| / |A | B|, a metric; documents link within radius r = 1 - threshold.

Pivots. Nearly all documents lie at distance 1 from each other, so documents as first pivots would
send every document to every region. The first pivots are single shingles {t}: d(A, {t}) is
1 - 1/|A| if t is in A, else 1. A document's nearest pivots are thus its own shingles; ties are broken
by one order over all shingles (frequent ones last, then by hash), and its first one is its Voronoi
region.

Boundary windows. Take the first j shingles off A: d(A, A') = j / |A|. If B holds none of these, A & B
lies within A', and d(A, B) >= j / |A|. So A goes to the regions of its first floor(r |A|) + 1 pivots
and to no other: two linked documents meet in a region at least once. No link is lost, no candidate
list is cut.

Recursion. In each region all members are measured against one document; a region all of whose members then
are in one component is done (groups of near copies are). Of those still open, regions of a few members test
all pairs of different components; larger ones that share members form a group, the root cell of a recursion with documents as pivots:
a cell's members are measured against FANOUT of them, each goes to the Voronoi cell of its nearest pivot, and,
by the triangle inequality, also to each cell whose pivot is at most 2 r further than its nearest, and to no
other: if d(x, y) <= r and y's nearest pivot is p, then d(x, p) <= d(y, p) + r <= d(y, q) + r <= d(x, q) + 2 r for every
pivot q. Members within r of a pivot are in its component. Cells join recursively until they are small or hold
one component. A cell whose windows reach nearly everywhere (some child is hardly smaller) stays, and gets other
pivots as long as these join its components. What then is left, and small cells, are compared in blocks, by signatures
that bound the distance from below, each member outside of a cell's largest component with all others. Of the pairs that
these leave, a forest is tested exactly, then only what lies between components that are still apart. So work grows with
the square only of such near copies as link with none of their cell's pivots, and tested pairs of a group that links grow
with its members.

Documents with equal sets are one class from the start, named by 64 bits of a 128-bit key; classes whose names
would clash get others. "Frequent" is counted over all documents on each one's lowest 2 r |A| shingles, by place in a
map of fixed size. Which shingles are put last changes the regions' sizes, never the result.

Words are runs of other than ASCII white space, A-Z lower-cased; shingles are hashed to 64 bits.

Defined cases: a document without words (null, empty) has an empty set and links with nothing, also
not with other empty ones; with fewer words than a shingle, the whole sequence is one shingle; rows
with a null id link like others, but a component of such rows alone has a null component_id; repeated
rows are one class; very long texts are read whole; an empty table gives no rows; further columns pass through
:func:`one_per_component`, whatever their names, and are not looked at elsewhere. Of a component, the row with the
least id stays (null ids last, then the least set key, then the least text); rows are told apart by id and set key,
as ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

#: Occurrences from which a shingle is put last, if no more than FULL of the map's BITS places are then
#: set (else as many occurrences as it takes); members up to which a region tests all pairs.
RARE, BITS, FULL, SMALL = 2, 2**26, 0.2, 32
#: The map is made in so many pieces; occurrences from which a region's members are spread over SPREAD tasks, if at
#: most MOST_HOT places have as many (else as many occurrences as it takes).
PIECES, HOT, SPREAD, MOST_HOT = 512, 4096, 32, 2**18
#: Members of a block in which a cell is compared; pivots of a larger one; share of its members, or components, from
#: which a cell is hardly smaller; least bits of a set's signature.
BLOCK, FANOUT, HARDLY, LEAST_BITS = 1024, 8, 0.75, 2048
#: Regions that may be sent to all tasks. No effect on results.
FEW_SENT = 100_000
#: Bytes of text taken at once, sets remembered per task, places held back per task. No effect on results.
AT_ONCE, REMEMBERED, HELD = 500_000, 100_000, 1_000_000
#: Sets of a bucket, about: a reader holds up to 4,096 rows at once, so few of them keep its memory small; least and most buckets.
#: No effect on results.
BUCKET_SETS, LEAST_BUCKETS, MOST_BUCKETS = 1000, 8, 50_000
#: Most classes whose names clash: about n ** 2 / 2 ** 65 of n are expected.
MOST_CLASHES = 100_000
#: Fixed odd multipliers, one per word of a shingle.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[1]
    x = (x ^ (x >> np.uint64(29))) * ODD[2]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Hashes all words of a slice of texts at once: per word, the sum of its bytes' codes times powers
    of an odd number (by place in the word); then all shingles as sums over neighbouring words."""

    def __init__(self, words: int):
        self.words = words
        byte = np.arange(256)
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)  # A-Z only
        self.code = mixed_bits((byte.astype(np.uint64) + np.uint64(1)) * ODD[0])
        self.space = (byte == 32) | (byte >= 9) & (byte <= 13)
        self.power = np.cumprod(np.full(64, ODD[3]))

    def shingles(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's distinct shingle hashes, ascending."""
        texts = texts.fill_null("").cast(pa.large_string())
        limits = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        content = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[limits[0] : limits[-1]]
        limits = limits - limits[0]
        inside = ~self.space[content]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = limits[:-1][limits[:-1] < len(content)]
        begins[edge] = inside[edge]  # a word never goes on from one text into the next
        starts = np.flatnonzero(begins)
        if len(starts):
            place = np.arange(len(content)) - np.repeat(starts, np.diff(np.append(starts, len(content)))) if starts[0] == 0 else None
            if place is None:
                place = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(content)) - np.repeat(starts, np.diff(np.append(starts, len(content))))])
            place[~inside] = 0
            if (longest := int(place.max()) + 1) > len(self.power):
                self.power = np.cumprod(np.full(longest, ODD[3]))
            values = self.code[content] * self.power[place]
            values[~inside] = 0
            h = mixed_bits(np.add.reduceat(values, starts))
        else:
            h = np.empty(0, np.uint64)
        first = np.searchsorted(starts, limits)  # of each text's words
        k = self.words
        s = np.full(max(0, len(h) - k + 1), k, dtype=np.uint64)
        for i in range(k if len(s) else 0):
            s += h[i : len(h) - k + 1 + i] * ODD[i]
        s = mixed_bits(s).view(np.int64)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            if z - a >= k:
                mine = np.sort(s[a : z - k + 1])
                yield mine[np.append(True, mine[1:] != mine[:-1])]
            elif z > a:
                yield mixed_bits(np.array([(h[a:z] * ODD[: z - a]).sum() + np.uint64(z - a)])).view(np.int64)
            else:
                yield np.empty(0, np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def halves(keys: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


class Names:
    """A class's 64-bit name: the first half of its key, but for classes that would share it."""

    def __init__(self, other: dict[bytes, int]):
        self.other = other

    def __call__(self, key: bytes) -> int:
        name = self.other.get(key)
        return int.from_bytes(key[:8], "little", signed=True) if name is None else name


def other_names(classes: DataFrame) -> dict[bytes, int]:
    """Names of the classes whose first halves clash, different from each other and from all halves."""
    import xxhash

    clash = classes.groupBy("s1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("s1")
    keys = [np.array([r["s1"], r["s2"]], np.int64).tobytes() for r in classes.join(clash, "s1").select("s1", "s2").limit(MOST_CLASHES + 1).collect()]
    if len(keys) > MOST_CLASHES:
        raise ValueError(f"over {MOST_CLASHES} classes clash in 64 bits")
    salt = 0
    while keys:
        names = {k: int(np.array(xxhash.xxh3_64_intdigest(k, seed=salt), np.uint64).view(np.int64)) for k in keys}
        taken = classes.sparkSession.createDataFrame([(n,) for n in names.values()], "name long")
        if len(set(names.values())) == len(keys) and classes.join(F.broadcast(taken), F.expr("s1 = name"), "left_semi").isEmpty():  # MOST_CLASHES rows at most
            return names
        salt += 1
    return {}


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sets_of(batch: pa.RecordBatch, column: int, make: Shingler) -> Iterator[tuple[bytes, np.ndarray]]:
    """Key and shingles of each text."""
    for s in make.shingles(batch.column(column)):
        yield set_key(s), s


def is_fresh(key: bytes, shingles: np.ndarray, seen: set[bytes]) -> bool:
    """Whether this task has not had the set lately; not for empty sets."""
    if not len(shingles) or key in seen:
        return False
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(key)
    return True


def place_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) % np.uint64(BITS)).astype(np.uint32)


def packed(ascending: np.ndarray) -> bytes:
    """Ascending numbers as gaps, seven bits a byte."""
    gaps = np.diff(ascending.astype(np.int64), prepend=0)
    n = 1 + sum((gaps >= 1 << b).astype(np.int64) for b in (7, 14, 21, 28))
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for i in range(5):
        has = n > i
        out[at[has] + i] = (gaps[has] >> 7 * i & 127) | ((n[has] > i + 1).astype(np.int64) << 7)
    return out.tobytes()


def unpacked(content: bytes) -> np.ndarray:
    b = np.frombuffer(content, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    begins = np.append(0, np.flatnonzero(b < 128)[:-1] + 1)
    shift = 7 * (np.arange(len(b)) - np.repeat(begins, np.diff(np.append(begins, len(b)))))
    return np.cumsum(np.add.reduceat((b & 127).astype(np.int64) << shift, begins))


SURVEY = "doc_id long, n long, s1 long, s2 long, piece int, places binary"


def survey(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """In one pass: doc_id, set size and 128-bit key, a row per document; and rows of piece and packed places of the
    low shingles, about a byte for each."""
    size = BITS // PIECES

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(words), set()
        held, waiting = [], 0

        def counted() -> pa.RecordBatch:
            places = np.sort(np.concatenate([np.empty(0, np.uint32), *held]))
            limits = np.searchsorted(places, np.arange(PIECES + 1) * size)
            blobs = [(p, packed(places[a:z] - p * size)) for p, (a, z) in enumerate(zip(limits, limits[1:])) if z > a]
            none = pa.nulls(len(blobs), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 4 + [pa.array([p for p, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary())], names)

        names = ["doc_id", "n", "s1", "s2", "piece", "places"]
        for b in it:
            made = list(sets_of(b, 1, make))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for _, s in made], pa.int64()), *halves([k for k, _ in made]), pa.nulls(len(made), pa.int32()), pa.nulls(len(made), pa.binary())], names)
            for key, s in made:
                if is_fresh(key, s, seen):
                    held.append(place_of(s[: 2 * ((100 - percent) * len(s) // 100 + 1)]))
                    waiting += len(held[-1])
            if waiting >= HELD:
                yield counted()
                held, waiting = [], 0
        if waiting:
            yield counted()

    return common.in_batches(texts_of(docs), batches, SURVEY, AT_ONCE)


def frequency_maps(surveyed: DataFrame, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit map, of fixed size, of the shingles to put last, and the places, ascending, of those whose regions
    are spread. Shingles that share a place share its value: any function of the shingle makes a valid order."""
    size = BITS // PIECES

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(piece: int, counts: np.ndarray) -> pa.RecordBatch:
            power = np.frexp(counts.astype(np.float64))[1].astype(np.uint8)  # e if 2 ** (e - 1) <= count < 2 ** e
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([power.tobytes()], pa.binary()), pa.array([np.bincount(power, minlength=64).tolist()], pa.list_(pa.int64()))], ["piece", "power", "sizes"])

        now, counts = None, np.zeros(size, np.int64)  # pieces come one after the other
        for b in it:
            for piece, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if now is not None and piece != now:
                    yield ended(now, counts)
                    counts[:] = 0
                now = piece
                counts += np.bincount(unpacked(content), minlength=size)
        if now is not None:
            yield ended(now, counts)

    blobs = surveyed.where("piece IS NOT NULL").select("piece", "places").repartition("piece").sortWithinPartitions("piece")
    powers = common.written(blobs.mapInArrow(common.tidy(count), "piece int, power binary, sizes array<long>"))
    sizes = np.zeros(64, np.int64)
    for r in powers.select("sizes").collect():  # PIECES rows
        sizes += r["sizes"]
    from_power = np.cumsum(sizes[::-1])[::-1]  # places with this power or more
    least = lambda count, most: next(e for e in range(int(count).bit_length(), 64) if from_power[e] <= most)
    late, hot = least(rare, FULL * BITS), least(HOT, MOST_HOT)

    def flags(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            power = [np.frombuffer(p, np.uint8) for p in b.column(1).to_pylist()]
            columns = [pa.array([np.packbits(p >= late).tobytes() for p in power], pa.binary()), pa.array([np.flatnonzero(p >= hot).tolist() for p in power], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["piece", "late", "hot"])

    out, places = np.zeros(BITS // 8, np.uint8), [np.empty(0, np.int64)]
    for r in powers.mapInArrow(common.tidy(flags), "piece int, late binary, hot array<long>").collect():  # BITS / 8 bytes and MOST_HOT numbers in all
        out[r["piece"] * size // 8 : (r["piece"] + 1) * size // 8] = np.frombuffer(r["late"], np.uint8)
        places.append(np.array(r["hot"], np.int64) + r["piece"] * size)
    common.forget(powers)
    return out, np.sort(np.concatenate(places)).astype(np.uint32)


def regions(docs: DataFrame, words: int, percent: int, late: np.ndarray, hot: np.ndarray, name: Names) -> DataFrame:
    """t, k, n, part: pivot, class and set size of each region's members; part spreads large regions, else 0."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(words), set()
        for b in it:
            t, k, n, part = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
            for key, s in sets_of(b, 1, make):
                if not is_fresh(key, s, seen):
                    continue
                first = (100 - percent) * len(s) // 100 + 1
                at = place_of(s)
                last = (late[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                mine = np.concatenate([s[~last], s[last]])[:first]
                named = name(key)
                t.append(mine)
                k.append(np.full(len(mine), named, np.int64))
                n.append(np.full(len(mine), len(s), np.int32))
                part.append(np.where(np.isin(place_of(mine), hot), 1 + named % SPREAD, 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (t, k, n, part)], ["t", "k", "n", "part"])

    return common.in_batches(texts_of(docs), batches, "t long, k long, n int, part int", AT_ONCE)


def shared(members: DataFrame) -> DataFrame:
    """The members with company in their region, once each; those of spread regions all stay. Streams over rows
    sorted by region."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = None, False  # the last row so far, and whether it has gone out
        for b in it:
            t, k, n, part = (b.column(i).to_numpy() for i in range(4))
            if held is not None:
                t, k, n, part = (np.concatenate(x) for x in zip(held, (t, k, n, part)))
            if not len(t):
                continue
            new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))
            t, k, n, part = t[new], k[new], n[new], part[new]
            follows = t[1:] == t[:-1]
            company = np.append(False, follows) | np.append(follows, False) | (part > 0)
            gone = held is not None and sent
            out = company.copy()
            out[0] &= not gone
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (t, k, n)], ["t", "k", "n"])
            held, sent = (t[-1:], k[-1:], n[-1:], part[-1:]), bool(company[-1] or gone and len(t) == 1)

    return members.repartition("t", "part").sortWithinPartitions("t", "k").mapInArrow(common.tidy(batches), "t long, k long, n int")


def signature(shingles: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of shingles fall on it; about a bit per shingle. Two sets differ in at least as
    many shingles as their signatures differ in bits, also where one's halves are folded to the other's width."""
    width = max(LEAST_BITS, 1 << max(0, len(shingles) - 1).bit_length())
    at = ((shingles.view(np.uint64) >> np.uint64(20)) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(bool)).view(np.int64)


#: How many bits of two signatures differ at least: of equal width, or one twice as wide; else 0, which excludes nothing.
FOLDED = "zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p ^ q)"
COUNTED = "aggregate(zip_with({0}, {1}, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)"
DIFFER = (
    f"CASE WHEN size(s_a) = size(s_b) THEN {COUNTED.format('s_a', 's_b')}"
    f" WHEN size(s_a) = 2 * size(s_b) THEN {COUNTED.format(FOLDED.format('s_a', 's_b'), 's_b')}"
    f" WHEN 2 * size(s_a) = size(s_b) THEN {COUNTED.format('s_a', FOLDED.format('s_b', 's_a'))} ELSE 0 END"
)


def signatures_by_width(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per width in words: the rows' numbers and their signatures."""
    column = t.column("signature").combine_chunks()
    width = np.diff(column.offsets.to_numpy()) if len(t) else np.empty(0, np.int64)
    return {int(w): (at, column.take(pa.array(at)).flatten().to_numpy().view(np.uint64).reshape(len(at), -1)) for w in np.unique(width) for at in [np.flatnonzero(width == w)]}


def at_width(signatures: np.ndarray, width: int) -> np.ndarray:
    while signatures.shape[1] > width:
        half = signatures.shape[1] // 2
        signatures = signatures[:, :half] ^ signatures[:, half:]
    return signatures


def near_size(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: those of the pairs that link. First signatures go along with the pairs: pairs they exclude are further
    apart than the radius for certain; the others' whole sets are intersected."""
    sign = lambda name: sets.select(F.col("k").alias(name), F.col("n").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}"))
    near = pairs.select("a", "b").join(sign("b"), "b").join(sign("a"), "a").where(f"{100 + percent} * ({DIFFER}) <= {100 - percent} * (n_a + n_b)")
    near = common.written(near.select("a", "b"))
    out = exact(near, sets, percent)
    common.forget(near)
    return out


def exact(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, a written table: those of the pairs whose whole sets link."""
    one, two = sets.select(F.col("k").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("k").alias("b"), F.col("shingles").alias("y"))
    both = near.join(two, "b").join(one, "a").select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
    return common.counted(both.where(f"100 * i >= {percent} * (s - i)").select("a", "b"))


def ordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def class_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between classes, enough to connect every component and none that is not exact."""
    # per region, combined before the shuffle: how many members, and the one that the others are measured against; of two, the other one
    row = F.struct(F.xxhash64("k").alias("h"), "k", "n")
    of_region = members.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.min(row).alias("p"), F.max(row).alias("q"))
    of_region = common.written(of_region.where("m > 1").select("t", "m", F.col("p.k").alias("pk"), F.col("p.n").alias("pn"), F.col("q.k").alias("qk"), F.col("q.n").alias("qn")))
    several = of_region.where("m > 2").select("t", "m", "pk", "pn")
    many = common.written(members.join(common.sent_if_small(several, FEW_SENT), "t"))
    twos = ordered(of_region.where("m = 2 AND pk <> qk AND " + near_size("pn", "qn", percent)), "pk", "qk")
    stars = ordered(many.where("k <> pk AND " + near_size("n", "pn", percent)), "pk", "k")
    pairs = common.written(twos.unionByName(stars).distinct())
    links = linked(pairs, sets, percent)
    root = graph.components(links)
    named = many.join(root, F.expr("k = node"), "left_outer").select("t", "k", "n", "m", "pk", F.coalesce("root", "k").alias("c"))
    open_ = common.counted(named.groupBy("t").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("t"))
    rest = common.written(named.join(common.sent_if_small(open_), "t"))
    common.forget(of_region, pairs, many, root, open_)
    # a small region that its first pair of each member has not joined: the other pairs, of different components
    few = rest.where(f"m <= {SMALL} AND k <> pk")
    both = few.alias("x").join(few.alias("y"), F.expr("x.t = y.t AND x.k < y.k AND x.c <> y.c AND " + near_size("x.n", "y.n", percent)))
    pairs = common.counted(both.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct())
    if pairs.row_count:
        last = links, linked(pairs, sets, percent)
        links = common.written(last[0].unionByName(last[1]).distinct())
        common.forget(*last)
    common.forget(pairs)
    rest_, rest = rest, rest.where(f"m > {SMALL}")
    if rest.isEmpty():
        common.forget(rest_)
        return links
    # regions that share members form a group: its pairs are then looked at once, not once per region
    group = graph.components(rest.select(F.xxhash64("t", F.lit("region")).alias("a"), F.col("k").alias("b")))
    cells = rest.select("k", "c").distinct().join(group, F.expr("k = node")).select(F.col("root").alias("cell"), "k", "c", F.lit(True).alias("home"))
    cells = common.written(cells)
    common.forget(rest_, group)
    more = recursive_links(cells, sets, percent)
    all_ = common.written(links.unionByName(more).distinct())
    common.forget(links, more)
    return all_


def recursive_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cells: cell, k, c (known component), home -> a, b, a written table of links between members of a cell, see
    the module's recursion."""
    links = common.written(cells.select(F.col("k").alias("a"), F.col("k").alias("b")).where(F.lit(False)))
    idle = None  # cells that the last pivots neither cut nor joined
    while True:
        live = common.counted(cells.join(common.sent_if_small(summed(cells)), "cell"))
        common.forget(cells)
        if not live.row_count:
            common.forget(live)
            return links
        told = live if idle is None else live.join(common.sent_if_small(idle).withColumn("stuck", F.lit(True)), "cell", "left_outer")
        flat = F.expr(f"m <= {SMALL}" + " OR stuck IS NOT NULL" * (idle is not None))
        found = compared(told.where(flat), sets, percent)
        rest = common.written(told.where(~flat).select("cell", "k", "c", "home", "m", "comps", "top"))
        common.forget(live)
        cells, star, now_idle = split(rest, sets, percent)
        last = links, found, star, rest
        links = common.written(links.unionByName(found).unionByName(star).distinct())
        common.forget(*last)
        if idle is not None:
            common.forget(idle)
        idle = now_idle


def summed(cells: DataFrame) -> DataFrame:
    """cell, m, comps, top, written: members, components and the largest one of the cells that hold several."""
    sizes = cells.groupBy("cell", "c").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.groupBy("cell").agg(F.sum("size").alias("m"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("size", "c")).alias("top"))
    return common.counted(sizes.where("comps > 1").select("cell", "m", "comps", F.col("top.c").alias("top")))


def split(live: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of the recursion for cells of several components: the cells that follow, links of members with
    pivots, and those of the cells (cell) that this step neither cut nor joined by much."""
    r = (100 - percent) / 100
    slot = F.pmod(F.xxhash64("k", "cell"), F.lit(FANOUT)).cast("int")
    # pivots join components, so they lie outside of the largest one
    pivots = live.where("home AND c <> top").groupBy("cell", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("k", F.lit("pivot")).alias("h"), "k", "c")).alias("p"))
    pivots = pivots.select("cell", "slot", F.col("p.k").alias("pk"), F.col("p.c").alias("pc"))
    weight = live.join(sets.select("k", "n"), "k").groupBy("cell").agg(F.sum("n").alias("w"))
    parts = common.written(weight.select("cell", F.expr("int(ceil(w / 1e6))").alias("parts")))  # a part's sets fit a task
    members = live.join(parts, "cell").join(sets.select("k", "shingles"), "k").select("cell", F.expr("int(pmod(xxhash64(k, 2), parts))").alias("part"), "k", "c", "home", "shingles")
    pivots = pivots.join(parts, "cell").join(sets.select(F.col("k").alias("pk"), F.col("shingles").alias("ps")), "pk")
    pivots = pivots.select(F.col("cell").alias("pcell"), F.explode(F.expr("sequence(0, parts - 1)")).alias("ppart"), "slot", "pk", "pc", "ps")

    def measure(one: pa.Table, two: pa.Table) -> pa.Table:
        kinds = {"cell": pa.int64(), "k": pa.int64(), "c": pa.int64(), "home": pa.bool_(), "child": pa.int64(), "at_home": pa.bool_(), "pk": pa.int64(), "pc": pa.int64()}
        k, c, cell, home = (one.column(x).to_numpy() for x in ("k", "c", "cell", "home"))
        if not len(one) or not len(two):  # without a pivot at home all replicas stay as they are
            none = np.full(len(one), None)
            return pa.table({n: pa.array(x, t) for (n, t), x in zip(kinds.items(), (cell, k, c, home, cell, home, none, none))})
        shingles = one.column("shingles").combine_chunks()
        sizes = np.diff(shingles.offsets.to_numpy())
        flat = shingles.flatten().to_numpy()
        starts = np.append(0, np.cumsum(sizes)[:-1])
        two = two.sort_by("slot")
        sets_ = [p.values.to_numpy() for p in two.column("ps")]
        hits = np.array([np.add.reduceat(np.isin(flat, p), starts, dtype=np.int64) for p in sets_])
        whole = np.array([sizes + len(p) for p in sets_])
        near = 100 * hits >= percent * (whole - hits)
        d = 1 - hits / (whole - hits)
        first = d.argmin(0)
        pk, pc, of_slot = (two.column(x).to_numpy() for x in ("pk", "pc", "slot"))
        p, x = np.nonzero(d <= d[first, np.arange(len(one))] + 2 * r + 1e-9)
        child = mixed_bits(cell[x].view(np.uint64) * ODD[4] + of_slot[p].astype(np.uint64) + np.uint64(1)).view(np.int64)
        link = near[p, x] & (pk[p] != k[x])  # a pivot within r is always inside the window
        made = (cell[x], k[x], c[x], home[x], child, home[x] & (first[x] == p), pa.array(pk[p], mask=~link), pa.array(pc[p], mask=~link))
        return pa.table(dict(zip(kinds, made)))

    schema = "cell long, k long, c long, home boolean, child long, at_home boolean, pk long, pc long"
    made = common.written(members.groupBy("cell", "part").cogroup(pivots.groupBy("pcell", "ppart")).applyInArrow(measure, schema))
    star = common.written(ordered(made.where("pk IS NOT NULL"), "k", "pk").distinct())
    joined = graph.components(made.where("pk IS NOT NULL").select(F.col("c").alias("a"), F.col("pc").alias("b")))
    made_ = made.join(joined, F.expr("c = node"), "left_outer").select("cell", "k", F.coalesce("root", "c").alias("c"), "home", "child", "at_home")
    made_ = common.written(made_)
    # a cell is cut if no child is nearly as large; else it stays, and is stuck if its components hardly get fewer
    children = made_.groupBy("cell", "child").agg(F.count(F.lit(1)).alias("size"))
    widest = children.groupBy("cell").agg(F.max("size").alias("size"))
    comps = made_.groupBy("cell").agg(F.count_distinct("c").alias("now"))
    before = live.groupBy("cell").agg(F.first("m").alias("m"), F.first("comps").alias("comps"))
    fate = common.counted(before.join(widest, "cell").join(comps, "cell").select("cell", F.expr(f"size <= {HARDLY} * m").alias("cut"), F.expr(f"now > {HARDLY} * comps").alias("stuck")))
    decided = made_.join(common.sent_if_small(fate), "cell")
    cut = decided.where("cut").select(F.col("child").alias("cell"), "k", "c", F.col("at_home").alias("home"))
    kept = decided.where("NOT cut").select("cell", "k", "c", "home").distinct()
    cells = common.written(cut.unionByName(kept))
    idle = common.counted(fate.where("NOT cut AND stuck").select("cell"))
    common.forget(parts, made, joined, made_, fate)
    return cells, star, idle


def spanning(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of pairs of components, in their order: which join what no pair before them has joined."""
    names, place = np.unique(np.concatenate([one, two]), return_inverse=True)
    one, two, root, kept = place[: len(one)], place[len(one) :], np.arange(len(names)), []
    for at in range(0, len(one), 1024):
        x, y = one[at : at + 1024], two[at : at + 1024]
        for i in np.flatnonzero(root[x] != root[y]).tolist():
            if root[x[i]] != root[y[i]]:
                root[root == root[y[i]]] = root[x[i]]
                kept.append(at + i)
    return np.array(kept, np.int64)


def candidates(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """a, b, a written table: the pairs of different components in a cell, one of them at home there, that signatures don't exclude.
    The members outside of a cell's largest component meet all others, in blocks. forest: of each block, nearest pairs first, only
    those that join what no pair before them has joined, at most as many as members."""
    sizes = common.counted(members.where("c <> top").groupBy("cell").agg(F.count(F.lit(1)).alias("others"), F.first("m").alias("whole")))
    blocks = common.sent_if_small(sizes).select("cell", F.expr(f"ceil(whole / {BLOCK})").alias("blocks"), F.expr(f"ceil(others / {BLOCK})").alias("rests"))
    dealt = members.join(blocks, "cell")
    block = lambda count: F.expr(f"int(pmod(xxhash64(k, 1), {count}))")
    every = lambda count: F.explode(F.expr(f"sequence(0, int({count}) - 1)"))
    columns = ["cell", "k", "c", "home", "n", "signature"]
    rest = dealt.where("c <> top").select(*columns, block("rests").alias("x"), every("blocks").alias("y"))
    whole = dealt.select(*columns, every("rests").alias("x"), block("blocks").alias("y"))
    whole = whole.select(*(F.col(c).alias(f"other_{c}") for c in [*columns, "x", "y"]))

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.rename_columns([c.removeprefix("other_") for c in two.column_names])
        k1, k2, c1, c2, n1, n2, h1, h2 = (t.column(c).to_numpy() for c in ("k", "c", "n", "home") for t in (one, two))
        found = [np.empty((3, 0), np.int64)]
        for w1, (rows1, all1) in signatures_by_width(one).items():
            for w2, (rows2, s2) in signatures_by_width(two).items():
                s2 = at_width(s2, min(w1, w2))
                step = max(1, 2**21 // (s2.size + 1))
                for at in range(0, len(rows1), step):
                    i1 = rows1[at : at + step]
                    s1 = at_width(all1[at : at + step], min(w1, w2))
                    small, large = np.minimum(n1[i1, None], n2[rows2]).astype(np.int64), np.maximum(n1[i1, None], n2[rows2]).astype(np.int64)
                    may = (c1[i1, None] != c2[rows2]) & (h1[i1, None] | h2[rows2]) & (100 * small >= percent * large)
                    if may.any():
                        differ = np.bitwise_count(s1[:, None] ^ s2[None]).sum(2, dtype=np.int64)
                        i, j = np.nonzero(may & ((100 + percent) * differ <= (100 - percent) * (small + large)))
                        found.append(np.array([i1[i], rows2[j], 1000 * differ[i, j] // (small + large)[i, j]]))
        i, j, far = np.concatenate(found, axis=1)
        if forest:
            order = np.argsort(far, kind="stable")
            i, j = i[order], j[order]
            kept = spanning(c1[i], c2[j])
            i, j = i[kept], j[kept]
        pairs = np.sort(np.column_stack([k1[i], k2[j]]), axis=1)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    by = ["cell", "x", "y"]
    pairs = rest.groupBy(*by).cogroup(whole.groupBy(*(f"other_{c}" for c in by))).applyInArrow(compare, "a long, b long")
    pairs = common.counted(pairs.distinct())
    common.forget(sizes)
    return pairs


def compared(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, a written table: links of different components of a cell, enough to connect what all its links connect.

    Each block's forest of candidates is tested first. If all of it links, so does nothing else that was apart; else
    the candidates between what is then still apart are tested as well. So a group of many links has few pairs tested."""
    members = common.written(live.select("cell", "k", "c", "home", "m", "top").join(sets.select("k", "n", "signature"), "k"))
    pairs = candidates(members, percent, forest=True)
    links = exact(pairs, sets, percent)
    if pairs.row_count > links.row_count:
        root = graph.components(links.unionByName(members.select(F.col("k").alias("a"), F.col("c").alias("b"))))
        now = members.join(root, F.expr("k = node"), "left_outer").select("cell", "k", F.coalesce("root", "c").alias("c"), "home", "n", "signature")
        sums = summed(now)
        apart = common.written(now.join(common.sent_if_small(sums), "cell"))
        common.forget(root, sums)
        left = candidates(apart, percent, forest=False)
        more = exact(left.join(pairs, ["a", "b"], "left_anti"), sets, percent)
        last = links, more, left, apart
        links = common.written(links.unionByName(more))
        common.forget(*last)
    common.forget(members, pairs)
    return links


def rooted_classes(docs: DataFrame, words: int, percent: int, rare: int) -> tuple[DataFrame, DataFrame]:
    """The survey, and s1, s2, least, root: each class's least doc_id and its component."""
    surveyed = common.written(survey(docs, words, percent))
    table = surveyed.where("piece IS NULL").select("doc_id", "n", "s1", "s2")
    classes = common.written(table.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least")))
    other = other_names(classes)
    name = Names(other)
    late, hot = frequency_maps(surveyed, rare)
    members = common.written(shared(regions(docs, words, percent, late, hot, name)))
    named = classes.withColumn("k", F.col("s1"))
    if other:
        renamed = classes.sparkSession.createDataFrame([(*np.frombuffer(k, np.int64).tolist(), n) for k, n in other.items()], "s1 long, s2 long, other long")
        named = classes.join(F.broadcast(renamed), ["s1", "s2"], "left_outer").select("s1", "s2", "least", F.coalesce("other", "s1").alias("k"))  # MOST_CLASHES rows at most
    # sets of the documents that share a region with another, one document per class
    active = common.counted(named.join(members.select("k").distinct(), "k").select("k", F.col("least").alias("rep")))
    reps = common.counted(active.where("rep IS NOT NULL").select("rep"))
    chosen = texts_of(docs).join(common.sent_if_small(reps), F.expr("doc_id = rep"), "left_semi")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Shingler(words), set()
        for b in it:
            made = [(name(k), s) for k, s in sets_of(b, 1, make) if is_fresh(k, s, seen)]
            columns = [pa.array([k for k, _ in made], pa.int64()), pa.array([len(s) for _, s in made], pa.int32()), pa.array([s for _, s in made], pa.list_(pa.int64())), pa.array([signature(s) for _, s in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "n", "shingles", "signature"])

    # classes of rows with null ids alone have no document to be found by: those rows' sets are compared
    nameless = texts_of(docs).where("doc_id IS NULL")
    found = common.in_batches(chosen.unionByName(nameless), batches, "k long, n int, shingles array<long>, signature array<long>", AT_ONCE)
    # every step joins with the sets: buckets spare them further shuffles
    sets = common.bucketed(found, active, "k", min(MOST_BUCKETS, max(LEAST_BUCKETS, active.row_count // BUCKET_SETS)))
    links = class_links(members, sets, percent)
    root = graph.components(links)
    out = common.written(named.join(root, F.expr("k = node"), "left_outer").select("s1", "s2", "least", F.coalesce("root", "k").alias("root")))
    common.forget(classes, members, active, reps, sets, links, root)
    return surveyed, out


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), links' sets at percent or more."""
    surveyed, named = rooted_classes(docs, words, percent, rare)
    table = surveyed.where("piece IS NULL").select("doc_id", "n", "s1", "s2")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "component_id")
    out = table.join(named, F.expr("n > 0 AND s1 = c1 AND s2 = c2"), "left_outer")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, but for all rows of a component save its least one."""
    surveyed, named = rooted_classes(docs, words, percent, RARE)
    table = surveyed.where("n > 0").select("doc_id", "s1", "s2")
    stays = F.min(F.struct(F.col("least").isNull().alias("nameless"), "least", "s1", "s2")).alias("stays")
    roots = named.join(named.groupBy("root").agg(stays), "root").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "stays")
    found = table.join(roots, F.expr("s1 = c1 AND s2 = c2"))
    first = F.expr("doc_id <=> stays.least AND s1 = stays.s1 AND s2 = stays.s2").alias("first")
    # per id and set key: whether its rows go, or how many of them would stay; those that stay alone need no mention
    keys = found.groupBy("doc_id", "s1", "s2", first).agg(F.count(F.lit(1)).alias("rows")).where("NOT first OR rows > 1")
    keys = common.counted(keys.select("doc_id", "s1", "s2", "first"))
    common.forget(surveyed, named)
    keyed, s1, s2 = with_keys(docs, words)
    same = F.expr(f"CAST(l.doc_id AS BIGINT) <=> r.doc_id AND l.`{s1}` = r.s1 AND l.`{s2}` = r.s2")
    rest = keyed.alias("l").join(common.sent_if_small(keys).alias("r"), same, "left_anti").select(*common.all_of(docs))
    repeated = keys.where("first").alias("r")
    if repeated.isEmpty():
        return rest
    some = keyed.alias("l").join(common.sent_if_small(repeated), same, "left_semi")
    return rest.unionByName(common.one_each(some, ["doc_id", s1, s2], docs))


def with_keys(docs: DataFrame, words: int) -> tuple[DataFrame, str, str]:
    """docs, all columns, with their set keys in two more, and the names of these."""
    at = docs.columns.index("text")
    names = [common.fresh(docs, "key_1"), common.fresh(docs, "key_2")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, *halves([k for k, _ in sets_of(b, at, make)])], [*b.schema.names, *names])

    return common.in_batches(docs, batches, T.StructType([*docs.schema, *(T.StructField(n, T.LongType()) for n in names)]), AT_ONCE), *names


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))
