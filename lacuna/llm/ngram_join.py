"""N-gram Jaccard join: parity sketches, pigeonhole, verification.

A document is its set of distinct word n-grams, as 64-bit hashes. Its parity sketch has a bit for each value that a hash may have in a piece: every
n-gram flips one bit of one piece (the upper half of the hash chooses the piece, the lower half the bit). The Hamming distance of two
sketches is at most the symmetric difference of the sets. Sets with Jaccard similarity of at least t differ in at most D = (a + b)(1 - t)/(1 + t)
n-grams. Sizes fall into bands so that similar sets are in the same or in neighbouring bands; for each band the sketch has more than D + 1
pieces. By the pigeonhole principle two similar sets differ in at most D pieces, so that they meet in a bucket (an equal piece of the same band).

Pieces without a set bit are no keys where a set has more than D others: at least one of these agrees with any similar set. Sets that have fewer
use their empty pieces too. If either of two similar sets has more than D non-empty pieces, they share one of these; if neither has, both use all.

Sketches are sparse: a piece is kept as a 64-bit hash of its set bits, and the whole sketch folded (XORed) to a few bits per n-gram, which still bounds the
difference from below; pairs that are too far by it are dropped without reading texts. What is left is verified on the texts, n-gram by n-gram.

Equal sets are one node (equal size and 128-bit hash); a task keeps the first of a group of copies only. Groups are never expanded into all pairs: every
set is compared with one leader of its buckets (the set with most shared buckets: an original shares pieces with each of its copies); verified links
give components. Only buckets that still hold several components are then compared in full, block by block in numpy (blocks of BLOCK
sets, so that memory stays bounded; buckets with the same members count once): first each block gives no more pairs than join its
components, then, when these are verified, all pairs that are still apart and that sketches don't exclude. No link is lost: any two similar sets share
a bucket, and either they are in one component already or the last step verifies them. Joins whose keys may be hot (copies, leaders,
roots) go by spread_join.

Defined results: null and empty texts and texts without words have no n-grams and are linked with nothing (their component is their own id); fewer than n
words make one n-gram; a null id is linked with nothing (its component is null); rows that share an id are one document for links, all
their sets; ties in the choice of a representative go to the smallest id; extra columns aren't read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, spread_join, stored

LEAST_BITS, BLOCK, PIECE_BYTES = 256, 512, 1 << 18
#: Bits of the filter of fetched texts: FILTER_PER_ROW for each wanted one, at most FILTER_BITS (64 MB), beyond which it only lets more rows through.
FILTER_PER_ROW, FILTER_BITS = 16, 1 << 29
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _STEP, _HALF = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
SET = ["s1", "s2", "n_shingles"]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, as many as a piece of text has bytes."""
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE_BYTES, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in at most PIECE_BYTES bytes, and where they begin."""
    x = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(x) + 2, np.int8)
    word[1:-1] = (x != 32) & ((x < 9) | (x > 13))
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64, out=sums[1:])
        return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _STEP), begin


def _long(raw: bytes) -> np.ndarray:
    """Hashes of the words of a long text, which is cut at white space. A word of more than PIECE_BYTES bytes is cut too, and its parts' hashes are made one."""
    out, at, inside = [], 0, False
    while at < len(raw):
        end = at + PIECE_BYTES
        split = end < len(raw)
        if split:
            blank = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end, split = (end, True) if blank < 0 else (blank + 1, False)
        words, begin = _words(raw[at:end])
        if inside and len(words) and begin[0] == 0:
            with np.errstate(over="ignore"):
                out[-1] = _mixed(out[-1] * _STEP + words[:1])
            words = words[1:]
        out += [words[:-1], words[-1:]] if split and len(words) else [words]
        at, inside = end, split
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words, or of all words where there are fewer."""
    k = min(n, len(words))
    x = np.full(len(words) - k + 1 if k else 0, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            x = _mixed(x * _STEP + words[i : len(words) - k + 1 + i])
    return x


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def hashes_of(texts: Sequence[str | None], n: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of the n-grams of its words (A-Z lower-cased). Short texts are worked out together."""
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    out: list = [None] * len(raws)
    group: list[int] = []

    def flush() -> None:
        starts = np.cumsum([0] + [len(raws[i]) + 1 for i in group])
        words, begin = _words(b"\n".join(raws[i] for i in group))
        bounds, grams = np.searchsorted(begin, starts).tolist(), _grams(words, n) if len(words) >= n else None
        for i, s, e in zip(group, bounds, bounds[1:], strict=False):
            out[i] = _distinct(grams[s : e - n + 1] if e - s >= n else _grams(words[s:e], n))
        group.clear()

    size = 0
    for i, raw in enumerate(raws):
        if len(raw) >= PIECE_BYTES:
            out[i] = _distinct(_grams(_long(raw), n))
            continue
        if size + len(raw) + 1 > PIECE_BYTES and group:
            flush()
            size = 0
        group.append(i)
        size += len(raw) + 1
    if group:
        flush()
    return out


def hashes(text: str | None, n: int = 3) -> np.ndarray:
    return hashes_of([text], n)[0]


@functools.lru_cache(maxsize=None)
def bands(num: int, den: int, top: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size of each band, most differences of similar sets whose smaller one is in the band, pieces of the band's sketches; 0 where such
    sets are equal). There are some more pieces than differences and one, so that few sets have too many empty ones."""
    starts = [1]
    while starts[-1] < top:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * den // num + 1))
    last = [s - 1 for s in starts[1:]]
    allowed = [(a + a * den // num) * (den - num) // (den + num) for a in last]
    return np.array(starts, np.int64), np.array(allowed, np.int64), np.array([(d + 1) * 23 // 20 + 2 if d else 0 for d in allowed], np.int64)


def keys(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """The bucket keys of a set: the pieces of its sketches for its own band and the band below."""
    out = []
    starts, allowed, pieces = bands(num, den)
    band = int(np.searchsorted(starts, len(h), "right")) - 1 if len(h) else 0
    with np.errstate(over="ignore"):
        bits = _mixed((h & np.uint64(0xFFFFFFFF)) + _STEP)  # a bit's hash; two n-grams on one bit cancel out, as they do in the sketch
        for b in (band, band - 1):
            m = int(pieces[b]) if b >= 0 and len(h) else 0
            if m:
                piece = ((h >> _HALF) * np.uint64(m)) >> _HALF  # ascends with h
                at = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
                xor = np.zeros(m, np.uint64)
                xor[piece[at].astype(np.int64)] = np.bitwise_xor.reduceat(bits, at)
                used = np.flatnonzero(xor)
                if len(used) <= allowed[b]:
                    used = np.arange(m)
                out.append(_mixed(_mixed(xor[used] + np.uint64(b) * _STEP) + used.astype(np.uint64) * _M1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(h: np.ndarray) -> bytes:
    """The parity sketch folded to four bits per n-gram or more (a power of two, LEAST_BITS at least): few differences fall on one bit."""
    bits = max(LEAST_BITS, 1 << (4 * len(h) - 1).bit_length())
    counts = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits (size bytes): halves XORed, as a bit's number is the hash modulo the bits."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, size // 8), axis=0)


def profiles(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, two hashes of the set, its sketch, and its keys where the task sees the set for the first time
    (nulls without n-grams or id)."""

    def make(batches):
        seen: set[tuple[int, int, int]] = set()
        for x in batches:
            sizes, one, two, bits, found = [], [], [], [], []
            for key, h in zip(x["doc_id"].to_pylist(), hashes_of(x["text"].to_pylist(), n), strict=True):
                sizes.append(len(h))
                if key is None or not len(h):
                    for c in (one, two, bits, found):
                        c.append(None)
                    continue
                with np.errstate(over="ignore"):
                    mark = (int(h.sum(dtype=np.uint64).astype(np.int64)), int(_mixed(h + _STEP).sum(dtype=np.uint64).astype(np.int64)), len(h))
                one.append(mark[0])
                two.append(mark[1])
                bits.append(sketch(h))
                found.append(None if mark in seen else keys(h, num, den).view(np.int64))
                seen.add(mark)
            yield {"doc_id": x["doc_id"], "th": x["th"], "n_shingles": sizes, "s1": one, "s2": two, "sketch": bits, "keys": found}

    make.whole = True
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return map_arrow(rows, make, "doc_id long, th long, n_shingles long, s1 long, s2 long, sketch binary, keys array<long>")


def shared_buckets(base: DataFrame) -> DataFrame:
    """(key, s1) of buckets with two sets or more: one shuffle of the keys; sorted runs are read as a stream."""

    def runs(batches):
        last, held, open_run = None, None, False  # the last row so far, whether its run has been emitted
        for x in batches:
            k, d = x["key"].to_numpy(), x["s1"].to_numpy()
            new = np.ones(len(k), bool)  # copies that several tasks have seen count once
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            if len(k):
                new[0] = last is None or k[0] != last or d[0] != held
            k, d = k[new], d[new]
            if not len(k):
                continue
            same = np.concatenate(([last is not None and k[0] == last], k[1:] == k[:-1]))
            follows = np.concatenate((same[1:], [False]))
            keep = same | follows
            out_k, out_d = k[keep], d[keep]
            if same[0] and not open_run:
                out_k, out_d = np.concatenate(([last], out_k)), np.concatenate(([held], out_d))
            open_run = bool(same[-1])
            last, held = k[-1], d[-1]
            yield {"key": out_k, "s1": out_d}

    runs.whole = True
    rows = base.filter("keys is not null").select(F.explode("keys").alias("key"), "s1")
    return map_arrow(rows.repartition("key").sortWithinPartitions("key", "s1"), runs, "key long, s1 long")


def grams(text: str | None, n: int) -> set:
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the representatives' ids, of pairs (ra, ha, rb, hb: ids and text hashes) whose texts are similar enough."""

    def make(x):
        last, mine, ok = None, None, []
        for p, q in zip(x["ta"].to_pylist(), x["tb"].to_pylist(), strict=True):
            if last is None or p != last:
                last, mine = p, grams(p, n)
            other = grams(q, n)
            both = len(mine & other)
            ok.append(both > 0 and den * both >= num * (len(mine) + len(other) - both))
        import pyarrow as pa

        mask = pa.array(ok, pa.bool_())
        return {"a": x["ra"].filter(mask), "b": x["rb"].filter(mask)}

    pairs = stored(pairs, "pairs")
    total = pairs.count()
    wanted = pairs.select(F.inline(F.array(F.struct(F.col("ra").alias("doc_id"), F.col("ha").alias("th")), F.struct(F.col("rb").alias("doc_id"), F.col("hb").alias("th")))))
    texts = likely(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), wanted, 2 * total)
    texts = stored(texts.groupBy("doc_id", "th").agg(F.first("text").alias("text")), "texts")
    rows = pairs
    for side in "ba":
        # a hot leader's text is at most about HOT_SHARE times as long as an average one: that many documents are of about its size
        on = [f"r{side}", f"h{side}"]
        rows = spread_join(rows, texts.toDF(*on, f"t{side}"), on, pairs.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), total)
    return map_arrow(rows.select("ra", "rb", "ta", "tb"), make, "a long, b long").distinct()


def likely(rows: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """rows whose (doc_id, th) may be among the wanted ones, by a filter of a bounded number of bits, so that the join that follows
    shuffles little else."""
    bits = min(FILTER_BITS, 1 << max(15, (FILTER_PER_ROW * n_wanted).bit_length()))
    h = F.pmod(F.xxhash64("doc_id", "th"), F.lit(bits))
    maps = wanted.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    place = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("byte__ & (1 << place__)") > 0
    found = rows.withColumn("bucket", F.bitmap_bucket_number(h)).join(F.broadcast(maps), "bucket")
    return found.withColumns({"byte__": byte, "place__": (place % 8).cast("int")}).filter(hit).select(*rows.columns)


def close_enough(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of sets, those that sizes and sketches don't exclude, with the representatives."""

    def make(x):
        import pyarrow as pa

        size = (x["na"].to_numpy() + x["nb"].to_numpy()) * (den - num) // (den + num)
        far = []
        for p, q in zip(x["ka"].to_pylist(), x["kb"].to_pylist(), strict=True):
            least = min(len(p), len(q))
            far.append(int(np.bitwise_count(folded(p, least) ^ folded(q, least)).sum()))
        mask = pa.array(np.array(far, np.int64) <= size)
        return {c: x[c].filter(mask) for c in ("ra", "ha", "rb", "hb")}

    total = pairs.count()
    rows = pairs
    for side in "ba":
        facts = sets.select("set_no", "n_shingles", "sketch", "rep", "th").toDF(side, f"n{side}", f"k{side}", f"r{side}", f"h{side}")
        rows = spread_join(rows, facts, [side], pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")), total)
    rows = rows.filter(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    return map_arrow(rows.select("na", "nb", "ka", "kb", "ra", "ha", "rb", "hb"), make, "ra long, ha long, rb long, hb long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node reachable. Large-star and small-star steps by turns;
    each round is written to the shared folder."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = spread_join(both, least.select("u", "m"), ["u"], least, 2 * now.count())
        large = large.select(F.when(F.col("v") > F.col("u"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        # after the large star a node has few neighbours below it: no window is hot
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        after = small.select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).filter("u <> v")
        after = stored(after.distinct(), "links")
        # done when each node has one link downwards, and none that has one is the lower end of another
        ends = after.select(F.inline(F.array(F.struct("u", F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))))
        ends = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if ends.filter("down > 1 or down = 1 and up = 1").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = after


def compared_in_full(rows: DataFrame, sets: DataFrame, num: int, den: int, every: bool, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of sets of different components within buckets (key, set_no, root, n: members) that sizes and sketches don't exclude: every
    one, or for each pair of blocks only so many as join its components."""

    def make(batches):
        def pairs(group):
            ids, roots, blocks, sizes, raw = (np.concatenate(c) for c in zip(*group, strict=True))
            least, up = min(map(len, raw)), {}

            def joined(x, y):
                x, y = (top(z) for z in (x, y))
                up[max(x, y)] = min(x, y)
                return x != y

            def top(x):
                while up.get(x, x) != x:
                    x = up[x]
                return x

            bits = np.stack([folded(x, least) for x in raw])
            rows_ = max(1, (1 << 22) // (least * len(ids)))  # at most about 4 MB at a time
            for i in range(0, len(ids), rows_):
                j = slice(i, i + rows_)
                far = np.bitwise_count(bits[j, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
                hit = (far <= (sizes[j, None] + sizes[None]) * (den - num) // (den + num)) & (roots[j, None] != roots[None]) & (ids[j, None] < ids[None])
                hit &= den * np.minimum(sizes[j, None], sizes[None]) >= num * np.maximum(sizes[j, None], sizes[None])
                if len(set(blocks.tolist())) > 1:
                    hit &= blocks[j, None] != blocks[None]  # pairs within a block have a group of their own
                p, q = np.nonzero(hit)
                if not every and len(p):
                    _, first = np.unique(np.stack([roots[j][p], roots[q]]), axis=1, return_index=True)
                    first = np.array([k for k in first.tolist() if joined(roots[j][p[k]], roots[q[k]])], np.int64)
                    p, q = p[first], q[first]
                yield ids[j][p], ids[q]

        at, group = None, []
        for x in batches:
            marks = list(zip(*(x[c].to_pylist() for c in ("key", "i", "j")), strict=True))
            columns = [x[c].to_numpy() for c in ("set_no", "root", "r", "n_shingles")] + [np.array([*x["sketch"].to_pylist(), None], object)[:-1]]
            edge = [i for i in range(len(marks)) if i == 0 or marks[i] != marks[i - 1]] + [len(marks)]
            a, b = [], []
            for s, e in zip(edge, edge[1:], strict=False):
                if marks[s] != at:
                    for p, q in pairs(group) if group else ():
                        a.append(p), b.append(q)
                    at, group = marks[s], []
                group.append([c[s:e] for c in columns])
            yield {"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []}
        for p, q in pairs(group) if group else ():
            yield {"a": p, "b": q}

    make.whole = True
    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("r", F.pmod(F.xxhash64("set_no"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"), "set_no", "root", "r")
    full = dealt.join(sets.select("set_no", "n_shingles", "sketch"), "set_no")
    return map_arrow(full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), make, "a long, b long").distinct()


def by_id(base: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of sets that share an id."""
    place = F.struct(*SET)
    several = stored(base.groupBy("doc_id").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo < hi").select("doc_id"), "shared-ids")
    if several.isEmpty():
        return sets.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    ids = base.select("doc_id", *SET).join(several, "doc_id", "left_semi").distinct()
    ids = stored(ids.join(sets.select(*SET, "rep"), SET).select("doc_id", F.col("rep").alias("b")), "sets-of-ids")
    first = ids.groupBy("doc_id").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n"))
    return spread_join(ids, first.select("doc_id", "a"), ["doc_id"], first, ids.count()).filter("a < b").select("a", "b")


def linked(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    base = stored(profiles(docs, n, num, den), "profiles")
    known = base.filter("s1 is not null")
    sets = known.groupBy(*SET).agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    # numbered once, as it is written; what follows reads these numbers
    sets = stored(sets.select(F.monotonically_increasing_id().alias("set_no"), *SET, F.col("first.doc_id").alias("rep"), F.col("first.th").alias("th"), "copies", "sketch"), "sets")
    members = stored(shared_buckets(base).join(sets.select("s1", "set_no"), "s1").select("key", "set_no"), "members")
    place = F.struct((-F.col("degree")).alias("c"), F.col("set_no").alias("a"))
    ranked = members.join(members.groupBy("set_no").agg(F.count(F.lit(1)).alias("degree")), "set_no").select("key", "set_no", place.alias("place"))
    lead = ranked.groupBy("key").agg(F.min("place").alias("lead"), F.min("set_no").alias("low"), F.max("set_no").alias("top"), F.bit_xor(F.xxhash64("set_no")).alias("bag"), F.count(F.lit(1)).alias("n")).filter("low < top")
    lead = stored(lead.groupBy("lead", "low", "top", "bag", "n").agg(F.min("key").alias("key")), "leaders")  # buckets with the same members count once
    led = stored(spread_join(members, lead.select("key", "lead"), ["key"], lead, members.count()), "led")
    # each set is compared with one leader only; what that leaves apart comes below
    tested = led.filter("set_no <> lead.a").groupBy(F.col("set_no").alias("b")).agg(F.min("lead").alias("lead"))
    tested = stored(tested.select(F.least("b", "lead.a").alias("a"), F.greatest("b", "lead.a").alias("b")).distinct(), "tested")
    links = stored(verified(close_enough(tested, sets, num, den), docs, n, num, den).unionByName(by_id(known, sets)), "verified")
    roots = stored(components(links), "roots")
    for every in (False, True):
        # what is still apart in a shared bucket
        nodes = sets.select("set_no", F.col("rep").alias("node")).join(roots, "node", "left").select("set_no", F.coalesce("root", "node").alias("root"))
        apart = stored(led.select("key", "set_no").join(nodes, "set_no"), "apart")
        several = stored(apart.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count(F.lit(1)).alias("n")).filter("p < q").select("key", "n"), "several")
        if several.isEmpty():
            break
        more = stored(compared_in_full(spread_join(apart, several, ["key"], several, apart.count()), sets, num, den, every).join(tested, ["a", "b"], "left_anti"), "more")
        if more.isEmpty():
            continue
        further = stored(verified(close_enough(more, sets, num, den), docs, n, num, den), "further")
        if not further.isEmpty():
            links, tested = links.unionByName(further), tested.unionByName(more)
            roots = stored(components(links), "roots")
    # by set, not by row: then one join of the rows, in which copies may be hot
    found = sets.select(*SET, F.col("rep").alias("node")).join(roots, "node", "left").select(*SET, F.coalesce("root", "node").alias("component_id"))
    rows = base.select("doc_id", *SET)
    out = spread_join(rows.filter("s1 is not null"), found, SET, sets.select(*SET, F.col("copies").alias("n")), rows.count()).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.filter("s1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s.doc_id, g, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, g) AS k FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS df FROM s GROUP BY g) USING (g)),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id
      WHERE 10 * (x.k - 1) <= x.n AND 10 * (y.k - 1) <= y.n AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)),
e AS (SELECT a, b FROM (SELECT a, b, count(*) AS i FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b)
      JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 90 * (p.n + q.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT u.b, t.root FROM t JOIN u ON u.a = t.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM t GROUP BY doc_id) r USING (doc_id)
"""
