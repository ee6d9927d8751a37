"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets of shingles that are similar enough differ in few shingles, H at most.
All sets of a size band hash their shingles into the same m segments; if a set's
segments could be given tolerances whose sum is over H, at least one segment
differs by less than its tolerance.  Tolerance 1 is met by equal segments, 2 also
by segments that are one deletion apart; so a set indexes its segments' contents
and, where the band's allocation says so, their one-deletion neighbourhoods.  The
allocation (how many segments, how many with deletions) is the cheapest in
signatures that leaves sets enough tolerance although empty segments, which are met
everywhere, are passed over.  A set that a chance layout leaves short of it also
indexes the next layout of the band, and so on until one serves: of two similar sets, the
one that stops first has the tolerance in a layout that both index.  Candidates whose bucket counts already differ too
much are dropped; every other one is verified on the exact sets.

Similar sets share more signatures than one; a node therefore leaves out as many of
its commonest signatures as it can spare (text that many documents have in common).

Equal sets are one node.  For components, a bucket of equal signatures isn't
expanded into pairs: nodes are linked to bucket pivots first, and afterwards the nodes of
a bucket that are in different components are compared by their sketches, block by
block; only pairs that may be links leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adega.llm.common import arrow_trimmed, free_name, kept_by_process, one_by_one, removed, stored, stored_at
from adega.llm.components import connected_components

_U = np.uint64
#: layouts of a band that a set may need: reached only if hashing is broken
LAYOUTS = 100
#: equal signatures within one batch beyond which they count as shared at once
LOCAL_RUN = 32
#: nodes of a bucket that are compared in one place
BLOCK = 256
#: buckets of a sketch, a power of two
SKETCH = 256
#: what a word has
WORD = r"[^\x20\x09-\x0D]"
#: words whose hashes a worker keeps
WORDS = 20_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs of characters other than blanks, A-Z in lower case.  A text with
    fewer words has its whole sequence as one shingle; without words: none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(parts)
    if not n:
        return np.zeros(0, _U)
    hashes = np.fromiter(map(kept_by_process("word hashes", _WordHashes).__getitem__, parts), _U, n)
    k = min(words, n)
    out = np.full(n - k + 1, k, _U)
    for j in range(k):
        out ^= hashes[j: n - k + 1 + j]
        out *= _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return np.unique(_mix(out))


def set_key(shingles: np.ndarray) -> int | None:
    """A set's node id (signed 64-bit); none for the empty set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


@dataclass(frozen=True)
class Band:
    """Sizes ``low`` to ``high``; smaller sets from ``reach`` on also belong to it."""

    index: int
    low: int
    high: int
    reach: int
    differ: int  # H
    segments: int  # m
    deletions: int  # segments that have one-deletion neighbourhoods: the first ones


def _allocate(reach: int, high: int, differ: int) -> tuple[int, int]:
    """(segments, deletions) of a band: the fewest signatures such that the tolerance
    lost to segments that are empty, or too small for a deletion, stays within the
    slack by six standard deviations; if none does, the allocation that comes closest."""
    if differ <= 1:
        return 1, differ  # one segment, the whole set: it can't be too small
    best, closest = None, None
    for m in range(max(1, (differ + 2) // 2), int(1.3 * differ) + 8):
        none = (1 - 1 / m) ** reach if m > 1 else 0.0  # probability of an empty segment, and of one shingle
        one = none * reach / (m - 1) if m > 1 else 0.0
        if best and m > best[0]:
            break  # costs more however few deletions
        for q in sorted({0, m // 4, m // 2, m}):
            mean = q * (2 * none + one) + (m - q) * none
            spread = (q * (4 * none + one) + (m - q) * none) ** 0.5
            slack = m + q - (differ + 1)
            if slack < 0:
                continue
            cost = m + q * high / m
            if slack >= mean + 6 * spread and (best is None or cost < best[0]):
                best = (cost, m, q)
            margin = (slack - mean) / (spread + 1e-9)
            if closest is None or margin > closest[0]:
                closest = (margin, m, q)
    return (best or closest)[1:]


@lru_cache(maxsize=64)
def _bands(num: int, den: int, upto: int) -> tuple[Band, ...]:
    out, low = [], 1
    while low <= upto:
        high = low * den // num  # a partner is in the same band or in a neighbouring one
        reach = -(-low * num // den)
        differ = 2 * high * (den - num) // (den + num)
        out.append(Band(len(out), low, high, reach, differ, *_allocate(reach, high, differ)))
        low = high + 1
    return tuple(out)


def bands_of(size: int, num: int, den: int) -> list[Band]:
    """The set's own band, and the next if a partner of the set can be in it."""
    bands = _bands(num, den, 1 << max(10, (size * den // num).bit_length() + 1))
    k = next(b.index for b in bands if size <= b.high)
    own = [bands[k]] if bands[k].differ else []
    return own + ([bands[k + 1]] if size * den // num >= bands[k + 1].low and bands[k + 1].differ else [])


def spare_signatures(size: int, filled: int, band: Band, num: int, den: int) -> int:
    """How many signatures a set may leave out of a band without segment deletions.

    A link of the set differs in at most D shingles, so at least ``c = filled - D``
    of its segments are equal to the partner's.  If each side leaves out its
    ``c - 1`` commonest signatures at most, in one order for all sets, the rarest of the equal
    ones stays on both sides: at least c - 1 equal ones are commoner."""
    if band.deletions:
        return 0
    partner = min(band.high, size * den // num)
    return max(0, filled - (den - num) * (size + partner) // (den + num) - 1)


def signatures(shingles: np.ndarray, band: Band, layout: int = 0) -> tuple[np.ndarray, bool]:
    """Signatures of a set in a layout of a band, and whether its tolerances cover the
    band's H.  One set of a pair with enough tolerance suffices to find the pair."""
    m, q = band.segments, band.deletions
    salt = _U((band.index + (layout << 10)) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    spread = _mix(shingles ^ salt)
    segment = (spread % _U(m)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, spread = segment[order], _mix(spread[order] + _U(1))
    count = np.bincount(segment, minlength=m)
    at = np.cumsum(count) - count
    filled = np.flatnonzero(count)
    total = np.zeros(m, _U)
    total[filled] = np.add.reduceat(spread, at[filled])
    place = _mix(np.arange(m, dtype=_U) + salt)
    out = [total[filled] ^ place[filled]]  # an empty segment is met everywhere: it is passed over
    tolerance = len(filled)
    if q:
        apart = (segment < q) & (count[segment] > 1)
        out.append((total[segment[apart]] - spread[apart]) ^ place[segment[apart]])
        tolerance += int((count[:q] > 1).sum())
    return _mix(np.concatenate(out)), tolerance > band.differ


def all_signatures(shingles: np.ndarray, band: Band, num: int, den: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in a band, in as many layouts as it needs, and how many it may
    leave out (none if it needs several).

    About one random set in a thousand needs a second layout; each further one fails
    as seldom, independently."""
    out, enough = [], False
    while not enough:
        if len(out) == LAYOUTS:
            raise RuntimeError(f"a set of {len(shingles)} shingles is short of tolerance in {LAYOUTS} layouts of its band")
        got, enough = signatures(shingles, band, len(out))
        out.append(got)
    return (out[0], spare_signatures(len(shingles), len(out[0]), band, num, den)) if len(out) == 1 else (np.concatenate(out), 0)


def sketch(shingles: np.ndarray) -> bytes:
    """Shingles per bucket of the hash's first bits, 255 at most: two sets differ in as many shingles as their
    sketches at least."""
    return np.minimum(np.bincount((shingles >> _U(65 - SKETCH.bit_length())).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def _keys(docs: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """``doc_id, n_shingles, key, sketch`` per row."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):  # texts become Python strings one at a time, sets go at once
            rows = []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), words)
                rows.append((len(s), set_key(s), sketch(s)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "n_shingles", "key", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        keys, "doc_id long, n_shingles long, key long, sketch binary")


def _shared_signatures(docs: DataFrame, text: str, words: int, num: int, den: int) -> DataFrame:
    """``sig, key, info`` of all signatures that at least two nodes have;
    ``info`` is the band and how many signatures the node may leave out in it.

    Signatures travel in lots as binary arrays, dealt by bits of the signature; a
    signature that a lot holds many times is known to be shared and only one of
    its nodes travels on, so a common signature sends an entry per lot at most.  A task
    sorts one deal at a time, about a sixteenth of its rows."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = 16 * width

    def lot(sigs: list, keys: list, infos: list) -> Iterator[tuple]:
        sig, key, info = np.concatenate(sigs), np.concatenate(keys), np.concatenate(infos)
        order = np.argsort(sig, kind="stable")
        sig, key, info = sig[order], key[order], info[order]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        run = np.diff(np.append(first, len(sig)))
        many = np.repeat(run > LOCAL_RUN, run)
        keep = ~many
        keep[first] = True
        for known, mask in ((True, many), (False, keep)):
            s, k, i = sig[mask], key[mask], info[mask]
            deal = (s % _U(deals)).astype(np.int64)
            order = np.argsort(deal, kind="stable")
            deal, s, k, i = deal[order], s[order], k[order], i[order]
            cut = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1]])) if len(deal) else []
            for a, b in zip(cut, np.append(cut[1:], len(deal))):
                yield deal[a], known, s[a:b].tobytes(), k[a:b].tobytes(), i[a:b].tobytes()

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"deal": pa.int64(), "known": pa.bool_(), "sigs": pa.binary(), "keys": pa.binary(), "infos": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            seen, sigs, keys, infos, held = set(), [], [], [], 0
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), words)
                key = set_key(s)
                if key is None or key in seen:
                    continue
                seen.add(key)
                for band in bands_of(len(s), num, den):
                    got, spare = all_signatures(s, band, num, den)
                    sigs.append(got)
                    keys.append(np.full(len(got), key, np.int64))
                    infos.append(np.full(len(got), band.index << 20 | min(spare, (1 << 20) - 1), np.int32))
                    held += len(got)
                if held > 1 << 18:
                    yield frame(list(lot(sigs, keys, infos)))
                    sigs, keys, infos, held = [], [], [], 0
            if sigs:
                yield frame(list(lot(sigs, keys, infos)))

    def met(sigs: list, keys: list, infos: list) -> pd.DataFrame:
        """The signatures of a deal that several nodes have."""
        sig, key, info = np.concatenate(sigs), np.concatenate(keys), np.concatenate(infos)
        order = np.lexsort((key, sig))
        sig, key, info = sig[order], key[order], info[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key, info = sig[new], key[new], info[new]
        same = np.zeros(len(sig) + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        rows = same[1:] | same[:-1]
        return pd.DataFrame({"sig": sig[rows], "key": key[rows], "info": info[rows]})

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sigs, keys, infos = None, [], [], []
        for batch in one_by_one(batches):
            for deal, known, s, k, i in zip(batch["deal"], batch["known"], batch["sigs"], batch["keys"], batch["infos"]):
                s, k, i = np.frombuffer(s, np.int64), np.frombuffer(k, np.int64), np.frombuffer(i, np.int32)
                if known:
                    yield pd.DataFrame({"sig": s, "key": k, "info": i})
                    continue
                if deal != now and sigs:
                    yield met(sigs, keys, infos)
                    sigs, keys, infos = [], [], []
                now = deal
                sigs.append(s)
                keys.append(k)
                infos.append(i)
        if sigs:
            yield met(sigs, keys, infos)

    dealt = docs.select(F.col(text).alias("text")).mapInArrow(index, "deal long, known boolean, sigs binary, keys binary, infos binary")
    return dealt.repartition(width, "deal").sortWithinPartitions("deal").mapInPandas(shared, "sig long, key long, info int").distinct()


def _without_common(rows: DataFrame) -> DataFrame:
    """``sig, key``: each node leaves out the commonest signatures it can spare in each band."""
    counts = rows.groupBy("sig").agg(F.count("*").alias("n"))
    by_band = Window.partitionBy("key", F.shiftright("info", 20)).orderBy(F.desc("n"), "sig")
    return (rows.join(counts, "sig").withColumn("place", F.row_number().over(by_band))
            .where(F.col("place") > F.col("info").bitwiseAND((1 << 20) - 1)).select("sig", "key"))


def _met(left: DataFrame) -> DataFrame:
    """``sig, key, degree`` of the signatures that still have several nodes; ``degree`` is
    the number of rows that a node meets in them."""
    counts = left.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    met = left.join(counts, "sig")
    degrees = met.groupBy("key").agg(F.sum("n").alias("degree"))
    return met.select("sig", "key").join(degrees, "key")


def _bucket_pairs(rows: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``(a, b)``, the smaller key first, of a bucket's nodes (``sig, n, key, root``, ``n`` the
    bucket's rows) that are in different components and whose sizes and sketches leave
    room for a link.

    A bucket is cut into blocks of about ``BLOCK`` nodes by a hash of the key, and each two
    blocks meet in one place, wherever that is: a node goes to as many places as its bucket has
    blocks, and only pairs that pass leave them."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = (rows.withColumn("blocks", blocks).withColumn("own", own)
              .join(sketches, "key")
              .select("sig", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "key", "root", "n_shingles", "sketch")
              .select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "root", "n_shingles", "sketch"))

    def meet(group: list[np.ndarray], apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, key, root, size, counts = group
        low = own == own.min()
        left, right = (np.flatnonzero(low), np.flatnonzero(~low)) if apart else (np.arange(len(key)),) * 2
        for at, i in enumerate(left):
            j = right if apart else right[at + 1:]
            j = j[root[j] != root[i]]
            both, gap = size[j] + size[i], np.abs(size[j] - size[i])
            fits = (den + num) * gap <= (den - num) * both
            j, both = j[fits], both[fits]
            if len(j):
                differ = np.abs(counts[j] - counts[i]).sum(axis=1)
                j = j[(den + num) * differ <= (den - num) * both]
                yield np.minimum(key[j], key[i]), np.maximum(key[j], key[i])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("own", "key", "root", "n_shingles")
        held: list[np.ndarray] | None = None  # rows of the place that the last batch ended in
        at: tuple | None = None

        def out(group: list[np.ndarray], place: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
            return list(meet(group, place[1] != place[2])) if len(group[0]) > 1 else []

        def frame(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in one_by_one(batches):
            if not batch.num_rows:
                continue
            place = [batch.column(c).to_numpy() for c in ("sig", "i", "j")]
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            columns.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16))
            new = np.flatnonzero(np.logical_or.reduce([np.diff(p) != 0 for p in place])) + 1
            found = []
            for a, b in zip([0, *new], [*new, batch.num_rows]):
                here, group = tuple(int(p[a]) for p in place), [c[a:b] for c in columns]
                if here == at:
                    held = [np.concatenate(x) for x in zip(held, group)]
                else:
                    found += out(held, at) if at is not None else []
                    held, at = group, here
            if found:
                yield frame(found)
        if at is not None and (found := out(held, at)):
            yield frame(found)

    return placed.repartition(width, "sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(pairs, "a long, b long")


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and sketches leave room for a link."""
    @F.pandas_udf("boolean")
    def room(na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, SKETCH).astype(np.int64) for x in (sa, sb))
        na, nb = na.to_numpy(np.int64), nb.to_numpy(np.int64)
        apart = np.maximum(np.abs(a - b).sum(axis=1), np.abs(na - nb))
        return pd.Series((den + num) * apart <= (den - num) * (na + nb))

    side = lambda x: sketches.select(F.col("key").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(room("na", "nb", "sa", "sb")).select(*pairs.columns)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets are similar enough."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.zeros(0, _U)
        for batch in one_by_one(batches):  # texts become Python strings one at a time
            good = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
                if a != last:
                    last, pivot = a, shingle_set(ta.as_py(), words)
                other = shingle_set(tb.as_py(), words)
                inter = len(np.intersect1d(pivot, other, assume_unique=True))
                good.append(den * inter >= num * (len(pivot) + len(other) - inter))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(check, "a long, b long")


def similar_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5,
                       threshold: tuple[int, int] = (80, 100), every_link: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id
    reachable by links (itself included).  Two documents link if
    ``den * intersection >= num * union`` of their shingle sets, ``threshold`` being
    ``(num, den)``.

    Null, empty and blank texts have no shingles and link with nothing.  Equal
    sets always link.  Repeated rows link with each other.  A null doc_id takes
    part; it is no component's name unless the component has no other id.  Only
    the two named columns are read.  An empty table gives no rows.  With
    ``every_link`` all candidate pairs are verified, not only those that decide the
    components; the result is the same."""
    slim = stored(_keys(docs, text, doc_id, words), "join-keys")
    links = stored(similar_links(docs, slim, text, doc_id, words, threshold, every_link), "join-links")
    roots = connected_components(links)
    named = slim.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5,
                  threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one row of each component of :func:`similar_components`: that of
    the smallest doc_id (of equal ids, the smallest set key; of equal rows, any one).
    Rows without shingles belong to no group and stay.  All columns are kept."""
    slim = stored(_keys(docs, text, doc_id, words), "join-keys")
    links = stored(similar_links(docs, slim, text, doc_id, words, threshold), "join-links")
    nodes = slim.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    named = nodes.join(connected_components(links).withColumnRenamed("node", "key"), "key", "left")
    key, chosen_id, chosen_key = (free_name(docs, f"join_{n}") for n in ("key", "chosen_id", "chosen_key"))
    chosen = named.groupBy(F.coalesce("root", "key").alias("root")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first"))
    chosen = chosen.select(F.col("first.doc_id").alias(chosen_id), F.col("first.key").alias(chosen_key))

    @F.arrow_udf("long")
    def keys(texts: pa.Array) -> pa.Array:
        arrow_trimmed()
        return pa.array([set_key(shingle_set(t.as_py(), words)) for t in texts], pa.int64())

    # a text has a set if it has a word: rows without one needn't pass through Python
    worded = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    # (called non-deterministic, or the optimiser calls it again in the filters that a join infers)
    keyed = docs.where(worded).withColumn(key, keys.asNondeterministic()(F.col(text)))
    # a key names one set, so it is the join's key; rows of that set with other ids go
    met = keyed.join(chosen, F.col(key) == F.col(chosen_key)).where(
        F.col(doc_id).cast("long").eqNullSafe(F.col(chosen_id)))
    kept = met.dropDuplicates([key]).select(*docs.columns)
    return kept.unionByName(docs.where(~worded))


def similar_links(docs: DataFrame, slim: DataFrame, text: str, doc_id: str, words: int, threshold: tuple[int, int],
                  every_link: bool = False) -> DataFrame:
    """Verified links ``(a, b)`` between nodes (keys of distinct sets), enough for the
    components, or all of them with ``every_link``."""
    num, den = threshold
    spark = docs.sparkSession
    signed, signed_at = stored_at(_shared_signatures(docs, text, words, num, den), "join-signatures")
    left, left_at = stored_at(_without_common(signed), "join-left")
    removed(spark, signed_at)
    shared = stored(_met(left), "join-shared")
    removed(spark, left_at)
    sketches = slim.where("key is not null").groupBy("key").agg(F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    # the texts of nodes that can be asked for, one document each
    nodes = slim.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    texts = stored(_texts(docs, nodes.join(shared.select("key").distinct(), "key"), text, doc_id, words), "join-texts")

    found = tried = state_at = None
    if not every_link:
        state = shared.withColumn("root", F.col("key"))
        for turn in range(2):
            # a bucket's pivot is the node that meets most others (an original, among its edited
            # copies); of several pivots, a node takes the one it met most often
            pivot = state.groupBy("sig").agg(F.max(F.struct("degree", "key", "root")).alias("p"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
            met = state.join(pivot, "sig").where("root <> p.root").groupBy(F.col("p.key").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("n"))
            met = _possible(met, sketches, num, den)
            if tried is not None:
                met = met.join(tried.withColumn("old", F.lit(True)), ["a", "b"], "left_anti")
            best = met.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best"))
            pick = stored(best.select(F.col("best.a").alias("a"), "b"), "join-picks")
            tried = pick if tried is None else tried.unionByName(pick)
            got = stored(_verified(pick, texts, words, num, den), "join-found")
            found = got if found is None else found.unionByName(got)
            roots = stored(connected_components(found), "join-roots")
            before = state_at
            state, state_at = stored_at(shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "join-state")
            if before:
                removed(spark, before)
    else:
        state = shared.withColumn("root", F.col("key"))
    # buckets that still hold several components
    open_ = state.groupBy("sig").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("sig", "n")
    rest = _bucket_pairs(stored(state.join(open_, "sig").select("sig", "n", "key", "root"), "join-open"), sketches, num, den).distinct()
    if tried is not None:
        rest = rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    rest = stored(rest, "join-rest")
    last = _verified(rest, texts, words, num, den)
    return last if found is None else found.unionByName(last)


def _texts(docs: DataFrame, reps: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """``key, text`` of the nodes' documents (an id may name several rows: the key tells)."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            same = [set_key(shingle_set(t.as_py(), words)) == k.as_py() for t, k in zip(batch.column("text"), batch.column("key"))]
            yield batch.filter(pa.array(same, pa.bool_())).select(["key", "text"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.join(reps, F.col("id").eqNullSafe(F.col("doc_id"))).select("key", "text").mapInArrow(
        keyed, "key long, text string").dropDuplicates(["key"])
