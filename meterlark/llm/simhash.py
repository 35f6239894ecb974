"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant within ``radius // 2`` bits of both, so
every fingerprint emits its whole ball of that half radius and equal variants meet. The ball of a
64-bit fingerprint at radius 2 has 2,081 members; to keep the shuffle small, what travels is the
fingerprint with each *prefix* of a variant (1 + b + b(b-1)/2 rows for b prefix bits), and the task
that owns a prefix emits the variants that start with it and sorts them in memory. b grows with the
number of fingerprints, so a task's share of variants stays the same at every size. A prefix that more
than ``GROUP_PRINTS`` fingerprints are near is dealt out again by ``SPLIT_BITS`` more bits, as often as it
takes, so crowded fingerprints are no large group either; inside a task shares are cut by further bits.

Fingerprints that share a variant at half the radius are within the radius of each other (triangle
inequality), so a run of m of them is linked by m - 1 links to its smallest, not by all pairs.
Equal fingerprints meet as one row.

Defined results: null text counts as empty; a text without words has fingerprint zero and links
like any other; fewer words than a shingle form one shingle; ties cannot occur (a bit needs over
half); repeated rows share a fingerprint; null doc_id is ignored by the smallest-id rule; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import UPPER, bound_batches, counted_side, discard, fresh_names, materialise, partitions, spread_join, used_worker
from meterlark.llm.components import connected_components

BITS = 64
#: Variants of a prefix that a task owns, about: repeated links inside it don't leave the task.
PREFIX_VARIANTS = 8_000_000
#: Fingerprints near one prefix that a task takes; more are dealt out by so many further bits.
GROUP_PRINTS, SPLIT_BITS = 500_000, 4
#: Variants that a task holds at once; more are subdivided by another prefix bit.
TASK_VARIANTS = 1_000_000
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def fingerprint_of(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text (unsigned)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    hashed = xxhash.xxh64_intdigest
    digests = np.fromiter(
        [hashed(line[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = digests[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """SimHash as a signed long (same 64 bits)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint_of(x, shingle, seed) for x in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks over the low ``bits`` bits with at most ``most`` ones."""
    one = [np.uint64(1) << np.uint64(i) for i in range(bits)]
    layers = [np.zeros(1, np.uint64)]
    if most >= 1:
        layers.append(np.array(one, np.uint64))
    if most >= 2:
        i, j = np.triu_indices(bits, 1)
        layers.append(np.array(one, np.uint64)[i] | np.array(one, np.uint64)[j] if bits > 1 else np.zeros(0, np.uint64))
    if most > 2:
        raise ValueError("radius over 5 is not supported")
    return np.concatenate(layers)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shuffled(prints: np.ndarray, turn: int) -> np.ndarray:
    """Keys that put fingerprints in an order of their own for each ``turn``; 0 is their own order."""
    if not turn:
        return prints
    mixed = (prints ^ np.uint64(turn * 0xD1B54A32D192ED03 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ mixed >> np.uint64(29)


def _distinct(u: np.ndarray, v: np.ndarray, radius: int) -> np.ndarray:
    """Distinct pairs, each verified to lie within ``radius``."""
    by = np.lexsort((v, u))
    u, v = u[by], v[by]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)] & (_ones(u ^ v) <= radius)
    return np.stack([u[new], v[new]], axis=1)


def links_of_prefix(
    prints: np.ndarray, prefix: int, bits: int, half: int, limit: int = TASK_VARIANTS, turn: int = 0, chains: bool = False
) -> np.ndarray:
    """Star links (u, v) among fingerprints that share a variant starting with ``prefix``.

    A star's centre is its run's least fingerprint, in an order of its own for each ``turn``. With
    ``chains`` the run's members are also linked in that order.
    """
    shift = np.uint64(BITS - bits)
    differ = _ones((prints >> shift) ^ np.uint64(prefix)) if bits else np.zeros(len(prints), np.uint8)
    prints, differ = prints[differ <= half], differ[differ <= half]
    if len(prints) < 2:
        return np.zeros((0, 2), np.uint64)
    rest = BITS - bits
    ball = [sum(math.comb(rest, k) for k in range(half - j + 1)) for j in range(half + 1)]
    if sum(ball[j] * int((differ == j).sum()) for j in range(half + 1)) > limit and rest > 8:
        both = np.concatenate([links_of_prefix(prints, prefix << 1 | bit, bits + 1, half, limit, turn, chains) for bit in (0, 1)])
        return _distinct(both[:, 0], both[:, 1], 2 * half)
    low = (np.uint64(1) << shift) - np.uint64(1) if rest < BITS else ~np.uint64(0)
    variants, owners = [], []
    for j in range(half + 1):
        own = np.flatnonzero(differ == j)
        if len(own):
            flips = _flips(rest, half - j)
            variants.append(((prints[own] & low)[:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(flips)))
    every, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.sort(every)
    shared = order[1:][order[1:] == order[:-1]]
    if not len(shared):
        return np.zeros((0, 2), np.uint64)
    shared = np.unique(shared)
    # A small bitmap screens the variants before the exact look-up.
    spread = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
    seen = np.zeros(1 << 22, bool)
    seen[spread(shared)] = True
    some = np.flatnonzero(seen[spread(every)])
    at = np.minimum(np.searchsorted(shared, every[some]), len(shared) - 1)
    exact = shared[at] == every[some]
    run, who = at[exact], prints[owner[some[exact]]]
    by = np.lexsort((_shuffled(who, turn), run))
    run, who = run[by], who[by]
    first = np.r_[True, run[1:] != run[:-1]]
    least = who[np.flatnonzero(first)[np.cumsum(first) - 1]]
    if chains:
        near = np.flatnonzero(~first[1:])
        who, least = np.concatenate([who, who[near]]), np.concatenate([least, who[near + 1]])
    who, least = np.maximum(who, least), np.minimum(who, least)
    del run, every, owner
    return _distinct(who[who != least], least[who != least], 2 * half)


def forest(links: np.ndarray, turn: int = 0) -> np.ndarray:
    """One link from each end to its component's first fingerprint: as few links as keep what is connected."""
    if not len(links):
        return links
    nodes, ends = np.unique(links, return_inverse=True)
    place = np.empty(len(nodes), np.int64)
    place[np.argsort(_shuffled(nodes, turn), kind="stable")] = np.arange(len(nodes))
    u, v = place[ends.reshape(links.shape)].T
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (label == before).all():
            break
    by_place = np.empty(len(nodes), np.uint64)
    by_place[place] = nodes
    a, b = by_place, by_place[label]
    return np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[a != b]


def nearest(links: np.ndarray) -> np.ndarray:
    """Each end's link to the closest fingerprint it is linked with."""
    if not len(links):
        return links
    a, b = np.concatenate([links, links[:, ::-1]]).T
    by = np.lexsort((b, _ones(a ^ b), a))
    a, b = a[by], b[by]
    first = np.r_[True, a[1:] != a[:-1]]
    return np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[first]


def near_links(prints: DataFrame, radius: int = 4, bits: int | None = None, turn: int = 0, closest: bool = False) -> DataFrame:
    """Links (u, v) between distinct fingerprints in column ``fp`` within ``radius`` bits.

    The links span every component; pairs inside a run of one variant are implied by its star, and
    what a task has linked leaves it as a forest. With ``closest`` each fingerprint's closest link
    comes along.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    if bits is None:
        n = max(1, prints.count())
        ball = sum(math.comb(BITS, k) for k in range(half + 1))
        bits = min(24, max(5, math.ceil(math.log2(max(2, n * ball / PREFIX_VARIANTS)))))
    top = lambda b: F.shiftrightunsigned("fp", BITS - b)
    masks = [int(m) for m in _flips(bits, min(half, 2))]
    flipped = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: top(bits).bitwiseXOR(m.cast("long")))
    sent = prints.select("fp", F.explode(flipped).alias("prefix"))
    dealt, now = [], bits
    while now < BITS:
        heavy = sent.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_PRINTS).select("prefix")
        heavy = materialise(heavy, "heavy")
        if heavy.isEmpty():
            break
        heavy = counted_side(heavy)
        dealt.append(sent.join(heavy, "prefix", "left_anti").withColumn("bits", F.lit(now)))
        more = min(SPLIT_BITS, BITS - now)
        longer = F.transform(F.sequence(F.lit(0), F.lit((1 << more) - 1)), lambda x: F.shiftleft("prefix", more).bitwiseOR(x.cast("long")))
        now += more
        sent = sent.join(heavy, "prefix", "left_semi").select("fp", F.explode(longer).alias("prefix"))
        sent = materialise(sent.filter(F.bit_count(F.col("prefix").bitwiseXOR(top(now))) <= half), "crowded")
    sent = reduce(DataFrame.unionByName, dealt, sent.withColumn("bits", F.lit(now)))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        used_worker()
        own = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        links = links_of_prefix(np.unique(own), int(key[1]), int(key[0]), half, turn=turn, chains=closest)
        found = forest(links, turn)
        if closest:
            found = np.unique(np.concatenate([found, nearest(links)]), axis=0)
        return pd.DataFrame({"u": found[:, 0].view(np.int64), "v": found[:, 1].view(np.int64)})

    return sent.groupBy("bits", "prefix").applyInPandas(meet, "u long, v long")


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    rows = materialise(docs.select("doc_id", fingerprint(F.col("text"), shingle, seed).alias("fp")), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    parts = connected_components(materialise(near_links(prints.select("fp"), radius), "near"))
    linked = materialise(prints.join(parts, prints.fp == parts.node).select("fp", "least", "component"), "linked")
    least = materialise(linked.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    named = spread_join(linked.select("fp", "component"), least, ["component"]).select("fp", "component_id")
    # fingerprints of one row that are linked to none are their own components
    alone = prints.filter("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    named = materialise(named.unionByName(alone), "named")
    return spread_join(rows, named, ["fp"], "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def hex_print(fp: Column) -> Column:
    """The fingerprint's 64 bits as 16 hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Texts whose shingles are counted to tell common ones from rare ones, about, and how many are kept.
SAMPLE_TEXTS, COMMON = 8_000, 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's k-word shingles, sorted (fewer words: one of all)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    hashed = xxhash.xxh64_intdigest
    digests = np.fromiter(map(hashed, words), np.uint64, len(words))
    n, k = max(1, len(words) - k + 1), min(k, len(words))
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = _mixed(out * _ODD + digests[j : j + n])
    return np.unique(out)


def prefix_of(shingles: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first |x| - ceil(similarity * |x|) + 1 shingles, those outside ``common`` first, then by ``rank``.

    Any two sets that are ``similarity`` alike (Jaccard) have a shingle of these in common, whatever
    the order is, as long as it is one for all texts.
    """
    most = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    if not len(common):
        return shingles[:most]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    late = np.where(common[at] == shingles, rank[at], -1)
    return shingles[np.lexsort((shingles, late))[:most]]


def simhash_of(shingles: np.ndarray) -> int:
    """SimHash of a set of shingles (unsigned)."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 65536):
        part = np.ascontiguousarray(shingles[at : at + 65536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.uint64)[0])


#: Bits of the parities that travel with each shingle of a text, the same number for all texts.
SKETCH = 512


def parity_of(shingles: np.ndarray, bits: int | None = None) -> bytes:
    """Bits that each shingle flips by its hash: ``bits``, or about four a shingle, a power of two of them."""
    bits = bits or 1 << min(20, max(8, (2 * len(shingles)).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has, from their parities."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three sampled texts or more, sorted, and their ranks by count. They only set an order."""
    share = min(1.0, SAMPLE_TEXTS / max(1, docs.count()))
    drawn = docs.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 40)) < int(share * (1 << 40))).select("text")

    def count(batches):
        for pdf in batches:
            used_worker()
            sets = [shingle_set(x, k) for x in pdf["text"].drop_duplicates()]
            values, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pd.DataFrame({"s": values.view(np.int64), "n": n})

    counted = drawn.mapInPandas(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter("n > 2")
    found = counted.orderBy(F.desc("n"), "s").limit(COMMON).toPandas()
    values = found["s"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(values)
    return values[by], len(by) - by


#: Each star of texts that share a shingle has this many centres, each least in an order of its own.
CENTRES = 3
#: Texts of a run that are compared with all others at once.
BLOCK = 1_024
#: Pairs whose sketches are compared at once.
COMPARED = 1 << 16


def _runs(batches) -> pd.DataFrame | None:
    """A task's rows, in order of ``s`` and ``text_key``, repeats dropped, runs of one left out."""
    import pyarrow as pa

    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    rows = pa.Table.from_batches(held)
    names = rows.column_names
    rows = {n: rows.column(n).to_numpy() for n in names}
    by = np.lexsort((rows["text_key"], rows["s"]))
    rows = {n: x[by] for n, x in rows.items()}
    s, key = rows["s"], rows["text_key"]
    new = np.r_[True, (s[1:] != s[:-1]) | (key[1:] != key[:-1])]
    rows = {n: x[new] for n, x in rows.items()}
    same = rows["s"][1:] == rows["s"][:-1]
    some = np.r_[False, same] | np.r_[same, False]
    return pd.DataFrame({n: x[some] for n, x in rows.items()})


def stars_of_runs(batches):
    """Rows whose shingle is shared, with the run's centres c0, c1, ..."""
    import pyarrow as pa

    rows = _runs(batches)
    used_worker()
    if rows is None or not len(rows):
        return
    s, key = rows["s"].to_numpy(), rows["text_key"].to_numpy(np.int64).view(np.uint64)
    first = np.r_[True, s[1:] != s[:-1]]
    run = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    for turn in range(CENTRES):
        by = np.lexsort((_shuffled(key, turn + 1), run))
        rows[f"c{turn}"] = key[by][starts][run].view(np.int64)
    yield from pa.Table.from_pandas(rows, preserve_index=False).to_batches(65536)


def _pairs_of_runs(similarity: float):
    def pairs(batches):
        """All pairs of texts of one shingle in different components that can be ``similarity`` alike.

        Sizes and places rule pairs out first, then sketches: the number of bits that differ is a lower bound
        of the number of shingles that do.
        """
        import pyarrow as pa

        rows = _runs(batches)
        used_worker()
        if rows is None or not len(rows):
            return
        s, key, part, place = (rows[n].to_numpy() for n in ("s", "text_key", "part", "place"))
        n, at = (place >> 32).astype(np.float64), (place & 0xFFFFFFFF).astype(np.float64)
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        found, size = [], 0

        def out():
            every = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(every[:, 0].copy()), pa.array(every[:, 1].copy())], ["u", "v"])

        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(s)]):
            if (part[a:b] == part[a]).all():
                continue
            for c in range(a, b, BLOCK):
                x, y = np.arange(c, min(b, c + BLOCK))[:, None], np.arange(c, b)[None, :]
                need = similarity / (1 + similarity) * (n[x] + n[y]) - 1e-6
                # Of the shared shingles the first in order is this one, or the pair meets at that one too.
                can = (x < y) & (part[x] != part[y]) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= need)
                i, j = np.nonzero(can)
                most = (1 - similarity) / (1 + similarity) * (n[c + i] + n[c + j]) + 1e-6
                near = np.zeros(len(i), bool)
                for t in range(0, len(i), COMPARED):
                    k = slice(t, t + COMPARED)
                    near[k] = np.bitwise_count(sketch[c + i[k]] ^ sketch[c + j[k]]).sum(axis=1) <= most[k]
                i, j = i[near], j[near]
                if len(i):
                    u, v = key[c + i], key[c + j]
                    found.append(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1))
                    size += len(i)
            if size > 500_000:
                yield out()
                found, size = [], 0
        if found:
            yield out()

    return pairs


def alike(docs: DataFrame, pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of text keys, a written table, whose sets of shingles are ``similarity`` alike.

    ``texts`` (text_key, key, n, parity) rules out pairs whose parities prove that they differ too much; the
    sets themselves decide on the others.
    """

    @F.pandas_udf("boolean")
    def can(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
        used_worker()
        return pd.Series([differ_at_least(x, y) <= z for x, y, z in zip(a, b, most)], dtype=bool)

    side = lambda key, n, parity: texts.select(F.col("text_key").alias(key), F.col("n").alias(n), F.col("parity").alias(parity))
    both = pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v")
    both = both.filter(F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9)
    most = (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("m")) + 1e-6
    pairs = materialise(both.filter(can("a", "b", most)).select("u", "v"), "possible")

    @F.pandas_udf("array<long>")
    def set_of(texts: pd.Series) -> pd.Series:
        used_worker()
        return pd.Series([shingle_set(x, k).view(np.int64) for x in texts])

    asked = pairs.select(F.col("u").alias("text_key")).unionByName(pairs.select(F.col("v").alias("text_key"))).distinct()
    asked = counted_side(materialise(texts.select("text_key", "key").join(asked, "text_key", "left_semi"), "asked"))
    held = docs.select(_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(asked, "key")
    sets = materialise(held.dropDuplicates(["text_key"]).select("text_key", set_of("text").alias("s")), "shingles")
    both = pairs.join(sets.select(F.col("text_key").alias("u"), F.col("s").alias("a")), "u").join(
        sets.select(F.col("text_key").alias("v"), F.col("s").alias("b")), "v"
    )
    common = F.size(F.array_intersect("a", "b"))
    kept = both.withColumn("n", common).filter(F.col("n") >= similarity * (F.size("a") + F.size("b") - F.col("n")) - 1e-9)
    links = materialise(kept.select("u", "v"), "verified")
    discard(sets)
    return links


def _key() -> Column:
    """A text's 128-bit name: no two texts are taken for one."""
    return F.md5(F.coalesce("text", F.lit("")))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))


def ball_pairs(texts: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs (u, v) of ``texts`` (text_key, fp, a written table) that ball hashing links, or equal fingerprints do."""
    prints = materialise(texts.groupBy("fp").agg(F.min("text_key").alias("first"), F.count("*").alias("n")), "prints")
    links = materialise(near_links(prints.select("fp"), radius, closest=True).distinct(), "near")
    named = lambda fp, key: prints.select(F.col("fp").alias(fp), F.col("first").alias(key))
    near = _ordered(links.join(named("u", "a"), "u").join(named("v", "b"), "v"), "a", "b")
    several = materialise(prints.filter("n > 1").select("fp", "first"), "several")
    return near.unionByName(_ordered(spread_join(texts.select("text_key", "fp"), several, ["fp"]), "text_key", "first"))


def near_copy_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key, text_key) and verified links (u, v) between text keys, a long for each text.

    The links connect exactly what all pairs of texts with ``similarity`` (Jaccard of the sets of
    shingles) connect. Ball hashing of the sets' SimHashes proposes the closest pairs first, and most
    groups of near copies are connected by these alone. It finds no pair for certain, so an exact way
    follows: two such sets share one of their first shingles in any common order (prefix filter; the
    rare come first), so texts meet by those. Each run of a shingle proposes links to a few centres; what
    both proposed is verified; then every pair that meets, is not connected yet and can be alike by its
    sizes and places is verified too.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))

    @F.pandas_udf("n int, p array<long>, parity binary, sketch binary, fp long")
    def prefix(texts: pd.Series) -> pd.DataFrame:
        used_worker()
        sets = [shingle_set(x, shingle) for x in texts]
        firsts = [prefix_of(x, similarity, *held.value).view(np.int64) for x in sets]
        prints = np.fromiter(map(simhash_of, sets), np.uint64, len(sets)).view(np.int64)
        parities = {"parity": [parity_of(x) for x in sets], "sketch": [parity_of(x, SKETCH) for x in sets]}
        return pd.DataFrame({"n": [len(x) for x in sets], "p": firsts, **parities, "fp": prints})

    rows = docs.select("doc_id", _key().alias("key"), F.monotonically_increasing_id().alias("row"), prefix(F.coalesce("text", F.lit(""))).alias("_p"))
    rows = materialise(rows.select("doc_id", "key", "row", "_p.*"), "prefixes")
    copies = rows.groupBy("key").agg(F.min("row").alias("_first"), F.count("*").alias("_copies")).filter("_copies > 1")
    copies = materialise(copies.select("key", "_first"), "copies")
    keyed = lambda *names: spread_join(rows.select("key", "row", *names), copies, ["key"], "left").withColumn("text_key", F.coalesce("_first", "row"))
    ids = materialise(keyed("doc_id").select("doc_id", "key", "text_key"), "ids")
    texts = keyed("n", "p", "parity", "sketch", "fp").filter("text_key = row")
    sent = texts.select("text_key", "n", F.posexplode("p").alias("at", "s"))
    sent = sent.select("text_key", "s", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("place"))
    centres = [f"c{k}" for k in range(CENTRES)]
    met = sent.repartition(partitions(docs.sparkSession), "s").mapInArrow(
        stars_of_runs, "text_key long, s long, place long, " + ", ".join(f"{c} long" for c in centres)
    )
    met = materialise(met, "met")
    texts = materialise(texts.select("text_key", "key", "n", "parity", "sketch", "fp"), "texts")
    discard(rows)
    stars = met.select("text_key", *centres).distinct().select("text_key", F.explode(F.array(*centres)).alias("_c"))
    pairs = materialise(_ordered(stars, "text_key", "_c").unionByName(ball_pairs(texts)).distinct(), "pairs")
    links = alike(docs, pairs, texts, shingle, similarity)
    parts = materialise(connected_components(links).withColumnRenamed("node", "text_key"), "parts")
    parted = texts.select("text_key", "sketch").join(parts, "text_key", "left")
    named = met.select("text_key", "s", "place").join(parted, "text_key")
    named = named.select("text_key", "s", "place", "sketch", F.coalesce("component", "text_key").alias("part"))
    more = named.repartition(partitions(docs.sparkSession), "s").mapInArrow(_pairs_of_runs(similarity), "u long, v long")
    more = materialise(more.distinct().join(pairs, ["u", "v"], "left_anti"), "pairs")
    discard(met)
    return ids, links.unionByName(alike(docs, more, texts, shingle, similarity))


def keep_one_of_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns of any name, with one document left of each group of near copies.

    Groups are components of ``near_copy_links``; equal texts are one, and a null text is an empty one. The
    row with the smallest (doc_id, text hash) stays, a null id first; of exact repeats of it, one.
    """
    rows, links = near_copy_links(docs, shingle, similarity)
    parts = connected_components(materialise(links, "verified"))
    copies = rows.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1").select("text_key", F.col("text_key").alias("part"))
    linked = parts.select(F.col("node").alias("text_key"), F.col("component").alias("part"))
    grouped = materialise(linked.unionByName(copies.join(linked, "text_key", "left_anti")), "grouped")
    named = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "key", "text_key")
    members = materialise(spread_join(named, grouped, ["text_key"]).groupBy("part", "id", "key").agg(F.count("*").alias("n")), "members")
    first = materialise(members.groupBy("part").agg(F.min(F.struct("id", "key")).alias("first")), "first")
    judged = materialise(spread_join(members, first, ["part"]).withColumn("stays", F.struct("id", "key") == F.col("first")), "judged")
    (name,) = fresh_names(docs, "_near")
    by = [f"{name}_id", f"{name}_key"]
    side = lambda condition: counted_side(
        materialise(judged.filter(condition).select(F.col("id").alias(by[0]), F.col("key").alias(by[1])), "side")
    )
    keyed = docs.withColumns({by[0]: F.coalesce("doc_id", F.lit(-(1 << 63))), by[1]: _key()})
    left = keyed.join(side("not stays"), by, "left_anti")
    repeated = side("stays and n > 1")
    if not repeated.isEmpty():
        left = left.join(repeated, by, "left_anti").unionByName(left.join(repeated, by, "left_semi").dropDuplicates(by))
    return left.select(*docs.columns)
