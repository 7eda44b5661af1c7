"""Hierarchical Pitman-Yor language model: seating sampled by Gibbs, contexts backing off to shared parents.

A word's context is the word before it. The restaurant of a word has that of the
word's last two bytes as parent, this one that of the last byte, and those share
the root. Everything about one word (its dishes in all restaurants) lies in one
bucket. Endings are at most 2^16 + 2^8 + 3 whatever the corpus, so their totals
travel as a small table; totals of the words before are added up by parts of
those words, and every bucket gets the ones that it asks for.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, release, text_bytes, unsigned_crc32, utf8
from .shards import gathered, pack, unpack, word_hashes, word_table

SHARD_BYTES, BUCKET_BYTES, PART_BYTES = 8 << 20, 24 << 20, 128 << 20
#: Shards whose rows of one bucket meet in one task.
GROUP = 1024
#: Bits of a hash in the number of a word before; its ending stands above them.
HASH_BITS = 47
#: The end of a text, as a word's hash; no word holds a blank.
END = word_hashes([b" end"])[0]
#: Restaurants: two-byte endings (0: start of a text), then one-byte endings, then the root.
START, LAST, ROOT = 0, 65537, 65537 + 257
#: Concentration at every level; rounds that are discarded, rounds that are averaged, sweeps of a round.
THETA, BURN, SAMPLES, SWEEPS = 1.0, 2, 3, 4
#: Dishes that a sweep draws anew: they are drawn side by side, so not all at once.
SHARE = 0.5
#: Customers up to which a dish's tables are drawn exactly, and cells of a matrix of chances.
EXACT, TILE = 96, 1 << 20
SEED = 11


def endings(words: list[bytes]) -> np.ndarray:
    """The restaurant that follows each word: its last byte, then the one before."""
    return np.array([w[-1] << 8 | (w[-2] if len(w) > 1 else 0) for w in words], np.int64) + 1


def parent(ctx: np.ndarray) -> np.ndarray:
    """The one-byte restaurant of a two-byte one."""
    return np.where(ctx == START, LAST + 256, LAST + ((ctx - 1) >> 8))


def befores_of(words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """A number for each word as a context, in the order of endings; the start of a text is zero."""
    low = hashes & np.uint64((1 << HASH_BITS) - 1)
    return endings(words).astype(np.uint64) << np.uint64(HASH_BITS) | low


def ending_of(before: np.ndarray) -> np.ndarray:
    """The two-byte restaurant above that of a word before."""
    return (before >> np.uint64(HASH_BITS)).astype(np.int64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def shard_tables(texts: list, held: np.ndarray) -> dict:
    """Counts of (word, word before, text) of one shard, sorted by the word's hash and then by the word before."""
    words, ids, sizes = word_table(d.lower().split() for d in utf8(texts))
    hashes = word_hashes(words) if words else np.zeros(0, np.uint64)
    befores = np.append(befores_of(words, hashes), np.uint64(START))
    hashes = np.append(hashes, END)
    order, before_order = np.argsort(hashes), np.argsort(befores)
    place, before_place = np.empty((2, len(order)), np.int64)
    place[order] = before_place[before_order] = np.arange(len(order))
    # Put an end after every text; the end of one text and the start of the next have one number.
    ends = np.cumsum(sizes + 1) - 1
    row = np.full(len(ids) + len(sizes), len(words), np.int64)
    inside = np.ones(len(row), bool)
    inside[ends] = False
    row[inside] = ids
    before = before_place[np.append(len(words), row)[: len(row)]]
    pair, owner = place[row] * len(order) + before, np.repeat(np.arange(len(sizes)), sizes + 1)
    if len(order) ** 2 * len(sizes) < 2**63:
        pair, owner = np.divmod(np.sort(pair * len(sizes) + owner), max(1, len(sizes)))
    else:
        by_pair = np.argsort(pair, kind="stable")
        pair, owner = pair[by_pair], owner[by_pair]
    first = runs(pair, owner)
    times = np.diff(np.append(first, len(pair)))
    pair, doc = pair[first], owner[first]
    head = runs(pair)
    learnt = np.concatenate([[0], np.cumsum(np.where(held[doc], 0, times))])
    edges = np.append(head, len(pair))
    word, before = np.divmod(pair[head], len(order))
    befores = befores[before_order]
    return {
        "words": hashes[order], "word": word, "befores": befores, "before": before, "ctx": ending_of(befores)[before],
        "count": np.diff(learnt[edges]), "texts": np.diff(edges), "doc": doc, "times": times, "tokens": sizes + 1,
    }


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as steps, byte by byte of all of them."""
    steps = np.diff(values, prepend=np.uint64(0))
    how = zlib.compressobj(1, strategy=zlib.Z_RLE)  # hashes repeat no strings
    return how.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes()) + how.flush()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


REQUEST = (
    "shard long, bucket int, g int, n_docs long, words binary, size binary, befores binary, before binary, count binary, "
    "texts binary, doc binary, times binary, ids binary, held binary, tokens binary"
)


def requests(docs: DataFrame, buckets: int, groups: int, learnable, scored: bool) -> DataFrame:
    """Per shard, what it has by buckets of words: counts to learn, or texts to be scored (and one row, bucket -1, about them)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        for rows in gathered(batches, lambda r: len(r[1] or "") + 100, SHARD_BYTES):
            held = np.array([r[2] for r in rows], bool)
            t = shard_tables([r[1] for r in rows], held)
            shard, g = part << 32 | number, (part + number) % groups
            number += 1
            ids = "\n".join("" if pd.isna(r[0]) else str(int(r[0])) for r in rows).encode()
            out = [(shard, -1, g, len(rows), *[None] * 8, ids, held.tobytes(), pack(t["tokens"]))] if scored else []
            bucket = ((t["words"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            word_edges = np.searchsorted(bucket, np.arange(buckets + 1))
            entry_edges = np.searchsorted(t["word"], word_edges)
            posting = np.concatenate([[0], np.cumsum(t["texts"])])
            size = np.bincount(t["word"], minlength=len(t["words"]))
            for b in range(buckets):
                (w0, w1), (e0, e1) = word_edges[b : b + 2], entry_edges[b : b + 2]
                if w0 == w1:
                    continue
                p0, p1 = posting[e0], posting[e1]
                met, before = np.unique(t["before"][e0:e1], return_inverse=True)
                pairs = pack_sorted(t["words"][w0:w1]), pack(size[w0:w1]), pack_sorted(t["befores"][met]), pack(before)
                texts = [None, pack(t["texts"][e0:e1]), pack(t["doc"][p0:p1]), pack(t["times"][p0:p1])]
                out.append((shard, b, g, len(rows), *pairs, *(texts if scored else [pack(t["count"][e0:e1]), None, None, None]), None, None, None))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in REQUEST.split(", ")])

    return docs.select("doc_id", "text", (~learnable).alias("held")).mapInPandas(run, REQUEST)


SEATS = ["words", "size_", "befores", "before", "count_"]
SEATS_SCHEMA = "bucket int, " + ", ".join(f"{n} binary" for n in SEATS)


def combined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Training counts of one bucket, added up over rows of (words, size, words before, count).

    Words before stay also where nothing is learnt, because scores ask for them.
    """
    def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        every, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *lists]), return_inverse=True)
        return every, np.split(place, np.cumsum([len(x) for x in lists])[:-1])

    words, words_at = merged([unpack_sorted(w) for w in rows["words"]])
    befores, befores_at = merged([unpack_sorted(b) for b in rows["befores"]])
    number, before, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w, size, at, b, n in zip(words_at, rows["size_"], befores_at, rows["before"], rows["count_"]):
        n = unpack(n)
        learnt = n > 0
        number.append(np.repeat(w, unpack(size))[learnt])
        before.append(at[unpack(b)[learnt]])
        count.append(n[learnt])
    number, before, count = np.concatenate(number), np.concatenate(before), np.concatenate(count)
    known = np.bincount(number, minlength=len(words)) > 0
    words, number = words[known], (np.cumsum(known) - 1)[number]
    key_ = number << 32 | before
    order = np.argsort(key_)
    key_, count = key_[order], count[order]
    first = runs(key_)
    count = np.add.reduceat(count, first) if len(first) else count
    key_ = key_[first]
    size = np.bincount(key_ >> 32, minlength=len(words))
    out = [pack_sorted(words), pack(size), pack_sorted(befores), pack(key_ & 0xFFFFFFFF), pack(count)]
    return pd.DataFrame([[int(key[0]), *out]], columns=["bucket", *SEATS])


class Seating:
    """Tables of one bucket's words in all restaurants, with the counts that follow from them.

    Dishes stand by word and then by context, so those with one parent stand together.
    """

    def __init__(self, words: np.ndarray, size: np.ndarray, ctx2: np.ndarray, c2: np.ndarray, t2=None, t1=None, t0=None):
        self.words, self.size, self.ctx2, self.c2 = words, size, ctx2, c2
        self.word2 = np.repeat(np.arange(len(words)), size)
        up = parent(ctx2)
        new = np.ones(len(up), bool)
        new[1:] = (up[1:] != up[:-1]) | (self.word2[1:] != self.word2[:-1])
        self.up1 = np.cumsum(new) - 1
        self.word1, self.ctx1 = self.word2[new], up[new]
        # Without tables every dish is on one.
        self.t2 = np.ones(len(c2), np.int64) if t2 is None else t2
        self.t1 = np.ones(len(self.word1), np.int64) if t1 is None else t1
        self.t0 = np.ones(len(words), np.int64) if t0 is None else t0

    @property
    def c1(self) -> np.ndarray:
        return np.bincount(self.up1, self.t2, len(self.t1)).astype(np.int64)

    @property
    def c0(self) -> np.ndarray:
        return np.bincount(self.word1, self.t1, len(self.t0)).astype(np.int64)

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers and tables per restaurant."""
        at = np.concatenate([self.ctx2, self.ctx1, np.full(len(self.t0), ROOT)])
        customers = np.bincount(at, np.concatenate([self.c2, self.c1, self.c0]), ROOT + 1)
        tables = np.bincount(at, np.concatenate([self.t2, self.t1, self.t0]), ROOT + 1)
        ctx = np.flatnonzero(tables)
        return ctx, customers[ctx].astype(np.int64), tables[ctx].astype(np.int64)

    def root(self, m: dict) -> np.ndarray:
        """Probability of each word at the root."""
        spare = (THETA + m["d"][0] * m["T"][ROOT]) * m["base"]
        return (self.c0 - m["d"][0] * self.t0 + spare) / (m["C"][ROOT] + THETA)

    def middle(self, m: dict, p0: np.ndarray) -> np.ndarray:
        u = self.ctx1
        own = self.c1 - m["d"][1] * self.t1
        return (own + (THETA + m["d"][1] * m["T"][u]) * p0[self.word1]) / (m["C"][u] + THETA)

    def sweep(self, m: dict, rng: np.random.Generator) -> None:
        """Gibbs by dishes: all customers of a dish leave and are seated again, from the leaves to the root.

        The tables of a dish are drawn given all its customers and what its
        parent holds besides. A parent's customers are its children's tables.
        """
        (d0, d1, d2), (s0, s1, s2) = m["d"][:3], m["stirling"][:3]
        p0 = self.root(m)
        c1, c0, up, root = self.c1, self.c0, self.ctx1[self.up1], np.full(len(self.t1), ROOT)
        middle = Above(c1[self.up1], self.t1[self.up1], d1, m["C"][up], (THETA + d1 * m["T"][up]) * p0[self.word1][self.up1])
        spare = (THETA + d0 * m["T"][ROOT]) * m["base"]
        top = Above(c0[self.word1], self.t0[self.word1], d0, m["C"][root], np.full(len(root), spare))
        self.t2 = seated(self.c2, self.t2, m["T"][self.ctx2], d2, s2, middle, rng)
        self.t1 = seated(self.c1, self.t1, m["T"][self.ctx1], d1, s1, top, rng)
        # The root draws its dishes from all words alike: as if from a restaurant where nobody sits.
        zero = np.zeros(len(self.t0))
        self.t0 = seated(self.c0, self.t0, np.full(len(zero), m["T"][ROOT]), d0, s0, Above(zero, zero, 0.0, zero, zero + THETA * m["base"], True), rng)


class Leaves(Seating):
    """A bucket's words in the restaurants of the words before, too.

    These stand by word, ending and word before, so those with one parent stand together.
    """

    def __init__(self, words: np.ndarray, size: np.ndarray, befores: np.ndarray, before: np.ndarray, c3: np.ndarray):
        self.size3, self.befores, self.before, self.c3 = size, befores, before.astype(np.int32), c3.astype(np.int32)
        word, ctx = np.repeat(np.arange(len(words)), size), ending_of(befores)[before]
        head = runs(word, ctx)
        new = np.zeros(len(ctx), np.int32)
        new[head] = 1
        self.up2 = np.cumsum(new, dtype=np.int32) - 1
        self.t3 = np.ones(len(c3), np.int32)
        self.several = np.flatnonzero(c3 > 1)
        super().__init__(words, np.bincount(word[head], minlength=len(words)), ctx[head], np.bincount(self.up2, minlength=len(head)))

    def seated(self, t3: np.ndarray, t2: np.ndarray, t1: np.ndarray, t0: np.ndarray) -> Leaves:
        """These dishes with other tables; ``t3`` is of dishes with two customers or more, others have one."""
        out = copy.copy(self)
        out.t3 = np.ones(len(self.c3), np.int32)
        out.t3[self.several] = t3
        out.c2 = np.bincount(self.up2, out.t3, len(t2)).astype(np.int64)
        out.t2, out.t1, out.t0 = t2, t1, t0
        return out

    def tables(self) -> list[bytes]:
        return [pack(t) for t in (self.t3[self.several], self.t2, self.t1, self.t0)]

    def of_befores(self, values: np.ndarray) -> np.ndarray:
        """Sums over this bucket's dishes for each word before."""
        return np.bincount(self.before, values, len(self.befores)).astype(np.int64)

    def sweep(self, m: dict, rng: np.random.Generator) -> None:
        """Seats the words before anew, and then what is above them."""
        d2, own = m["d"][2], self.several
        up = self.up2[own]
        u = self.ctx2[up]
        spare = (THETA + d2 * m["T"][u]) * self.middle(m, self.root(m))[self.up1[up]]
        above = Above(self.c2[up], self.t2[up], d2, m["C"][u], spare)
        self.t3[own] = seated(self.c3[own].astype(np.int64), self.t3[own].astype(np.int64), m["T3"][self.before[own]], m["d"][3], m["stirling"][3], above, rng)
        self.c2 = np.bincount(self.up2, self.t3, len(self.t2)).astype(np.int64)
        super().sweep(m, rng)


class Above:
    """What the parent restaurants hold of the dishes: customers, tables, all customers, and the weight of a new table.

    A fixed one gives every table the same chance.
    """

    def __init__(self, c, t, d: float, total, spare, fixed: bool = False):
        self.c, self.t, self.d, self.total, self.spare, self.fixed = c, t, d, total, spare, fixed

    def chance(self, own: np.ndarray, without: np.ndarray, j: np.ndarray | int = 0) -> np.ndarray:
        """Of one more table, when ``without`` of a dish's customers are gone and j are back."""
        if self.fixed:
            return self.spare[own] / THETA
        c = self.c[own] - without
        rest = np.maximum(c + j - self.d * np.minimum(self.t[own], np.maximum(c, 0)), 0)
        return (rest + self.spare[own]) / (np.maximum(self.total[own] - without, 0) + j + THETA)


def stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of discount ``d``, up to ``EXACT`` customers."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    for c in range(2, EXACT + 1):
        with np.errstate(divide="ignore"):
            stay = out[c - 1] + np.log(np.maximum(c - 1 - d * t, 0))
        out[c] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c - 1, :-1]]))
    return out


def seated(c: np.ndarray, t: np.ndarray, tables: np.ndarray, d: float, log_s: np.ndarray, above: Above, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers, a random half drawn anew; ``tables`` are all tables of their restaurants.

    Up to ``EXACT`` customers all tables of a dish are taken away, here and
    above. There are then t with a chance in proportion to S(c, t) times what
    each table weighs, which grows with those before it. Of more customers, all
    leave and return in parts of a sixteenth: one is alone with a chance of
    d (t - 1) / c and returns alone with one of a / (a + c - d t), where a is the
    weight of a table, so both are binomial draws.
    """
    t = np.where(c > EXACT, np.clip(t, 1, c), np.minimum(np.maximum(t, 1), c))
    out = t.copy()
    now = rng.random(len(c)) < SHARE
    order = np.flatnonzero(now & (c > 1) & (c <= EXACT))
    order = order[np.argsort(c[order], kind="stable")]
    edges = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for count, (begin, end) in enumerate(zip(edges, edges[1:]), 2):
        step = max(1, TILE // count)
        for at in range(begin, end, step):
            own = order[at : min(end, at + step)][:, None]
            j = np.arange(count)
            weight = (THETA + d * (np.maximum(tables[own] - t[own], 0) + j)) * above.chance(own, t[own], j)
            log_p = log_s[count, 1 : count + 1] + np.log(np.maximum(weight, 1e-300)).cumsum(axis=1)
            upto = np.exp(log_p - log_p.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[own[:, 0]] = 1 + (upto < rng.random((len(own), 1)) * upto[:, -1:]).sum(axis=1)
    large = np.flatnonzero(now & (c > EXACT))
    if len(large):
        n, tables_now = c[large], t[large]
        weight = (THETA + d * tables[large]) * above.chance(large, np.zeros(len(large), np.int64))
        part = -(-n // 16)
        for _ in range(16):
            gone = rng.binomial(part, np.clip(d * (tables_now - 1) / n, 0, 1))
            back = rng.binomial(part, np.clip(weight / (weight + n - d * tables_now), 0, 1))
            tables_now = np.clip(tables_now - gone + back, 1, n)
        out[large] = tables_now
    return out


def as_leaves(row) -> Leaves:
    return Leaves(unpack_sorted(row.words), unpack(row.size_), unpack_sorted(row.befores), unpack(row.before), unpack(row.count_))


def parts_of(befores: np.ndarray, parts: int) -> dict[int, np.ndarray]:
    """Places of the words before whose totals are added up in each part."""
    top = (befores >> np.uint64(HASH_BITS - 31)) & np.uint64((1 << 31) - 1)
    part = (top * np.uint64(parts)) >> np.uint64(31)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    return {p: order[s:e] for p, (s, e) in enumerate(zip(edges, edges[1:])) if s < e}


#: Rows of a state: tables of a bucket (part -1), totals of endings and levels (part -2), and tables by word before, in parts.
TABLES, TOTALS = -1, -2
CELLS = ["a", "b", "c", "d"]
STATE_SCHEMA = "bucket int, part int, " + ", ".join(f"{n} binary" for n in CELLS)


def as_rows(bucket: int, s: Leaves, parts: int) -> pd.DataFrame:
    ctx, customers, tables = s.totals()
    # How often counts of one and two occur on each level, the number of words and that of tokens.
    levels = [x for c in (s.c0, s.c1, s.c2, s.c3) for x in ((c == 1).sum(), (c == 2).sum())]
    levels = np.array([*levels, len(s.words), s.c3.sum()], np.int64)
    out = [(bucket, TABLES, *s.tables()), (bucket, TOTALS, pack(ctx), pack(customers), pack(tables), pack(levels))]
    held = s.of_befores(s.t3)
    out += [(bucket, part, pack(held[own]), None, None, None) for part, own in parts_of(s.befores, parts).items()]
    return pd.DataFrame(out, columns=["bucket", "part", *CELLS])


def measures(state: DataFrame) -> dict:
    """Totals of the restaurants of endings, words and discounts: a table as large as the number of endings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({"ctx": unpack(row.a), "x": unpack(row.b), "y": unpack(row.c)})
                levels = unpack(row.d)
                yield pd.DataFrame({"ctx": -1 - np.arange(5), "x": levels[::2], "y": levels[1::2]})

    rows = state.filter(F.col("part") == TOTALS).mapInPandas(run, "ctx long, x long, y long").groupBy("ctx").agg(F.sum("x"), F.sum("y")).collect()
    got = {r[0]: (r[1], r[2]) for r in rows}
    customers, tables = np.zeros(ROOT + 1), np.zeros(ROOT + 1)
    for ctx, (a, b) in got.items():
        if ctx >= 0:
            customers[ctx], tables[ctx] = a, b
    d = []
    for level in range(4):
        one, two = got.get(-1 - level, (0, 0))
        d.append(float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95)))
    words, tokens = got.get(-5, (0, 0))
    return {"C": customers, "T": tables, "d": d, "stirling": [stirling(x) for x in d], "words": words, "base": 1.0 / (words + 1), "tokens": tokens}


def routes(seats: DataFrame, parts: int) -> DataFrame:
    """``part, bucket, place, total``: where a bucket's words before stand in a part, and how often each is before a word at all."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                s = as_leaves(row)
                count = s.of_befores(s.c3)
                for part, own in parts_of(s.befores, parts).items():
                    yield pd.DataFrame([(part, row.bucket, pack_sorted(s.befores[own]), pack(count[own]))], columns=["part", "bucket", "befores", "count"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack_sorted(b) for b in rows["befores"]]
        _, place = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(c) for c in rows["count"]])).astype(np.int64)
        place = np.split(place, np.cumsum([len(x) for x in lists])[:-1])
        out = rows[["part", "bucket"]].copy()
        out["place"] = [pack_sorted(p.astype(np.uint64)) for p in place]
        out["total"] = [pack(total[p]) for p in place]
        return out

    pieces = seats.mapInPandas(split, "part int, bucket int, befores binary, count binary")
    return pieces.groupBy("part").applyInPandas(add, "part int, bucket int, place binary, total binary")


def totals(state: DataFrame, ways: DataFrame) -> DataFrame:
    """Rows of a bucket and part: customers (a) and tables (b) of its words before, over all buckets."""

    def add(key: tuple, rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(rows["bucket"], rows["a"]))
        place = [unpack_sorted(p).astype(np.int64) for p in ways["place"]]
        tables = np.concatenate([unpack(own[b]) for b in ways["bucket"]])
        total = np.bincount(np.concatenate(place), tables).astype(np.int64)
        out = ways[["bucket", "part"]].copy()
        out["a"], out["b"], out["c"], out["d"] = ways["total"], [pack(total[p]) for p in place], None, None
        return out

    held = state.filter("part >= 0")
    return held.groupBy("part").cogroup(ways.groupBy("part")).applyInPandas(add, STATE_SCHEMA)


def opened(s: Leaves, rows: pd.DataFrame, parts: int) -> tuple[Leaves, dict]:
    """A bucket with the tables, and the totals of its words before, that ``rows`` tell."""
    of = parts_of(s.befores, parts)
    customers, tables = np.zeros((2, len(s.befores)))
    for row in rows.itertuples(index=False):
        if row.part == TABLES:
            s = s.seated(*[unpack(getattr(row, c)) for c in CELLS])
        else:
            own = of[row.part]
            customers[own], tables[own] = unpack(row.a), unpack(row.b)
    return s, {"C3": customers, "T3": tables}


def swept(number: int, model: dict, parts: int) -> Callable:
    """A round of sweeps of one bucket."""

    def run(key: tuple, seat: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        s, own = opened(as_leaves(next(seat.itertuples(index=False))), rows, parts)
        rng = np.random.default_rng([SEED, number, int(key[0])])
        for _ in range(SWEEPS):
            s.sweep(model | own, rng)
        return as_rows(int(key[0]), s, parts)

    return run


def rounds(seats: DataFrame, parts: int) -> list[tuple[DataFrame, dict]]:
    """Tables and totals after each averaged round, each with the totals of endings."""

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield as_rows(row.bucket, as_leaves(row), parts)

    ways = kept(routes(seats, parts))
    state = kept(seats.mapInPandas(begin, STATE_SCHEMA))
    release(seats.sparkSession)
    samples = []
    model = measures(state)
    for number in range(BURN + SAMPLES):
        told = state.filter(F.col("part") == TABLES).unionByName(totals(state, ways))
        state = kept(seats.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(swept(number, model, parts), STATE_SCHEMA))
        release(seats.sparkSession)
        model = measures(state) | {"d": model["d"], "stirling": model["stirling"]}
        if number >= BURN:
            samples.append((state.filter(F.col("part") == TABLES).unionByName(totals(state, ways)), model))
    return samples


class Predictions:
    """Averaged probabilities of one bucket's words after any ending."""

    def __init__(self, samples: list[tuple[Seating, dict]]):
        self.samples, first = samples, samples[0][0]
        self.words = first.words
        self.key2, self.key1 = first.word2 << 20 | first.ctx2, first.word1 << 20 | (first.ctx1 - LAST)
        self.p0 = [s.root(m) for s, m in samples]
        self.p1 = [s.middle(m, p0) for (s, m), p0 in zip(samples, self.p0)]
        both = zip(samples, self.p1)
        self.p2 = [self.lower(s.c2 - m["d"][2] * s.t2, m, 2, s.ctx2, p1[s.up1]) for (s, m), p1 in both]

    @staticmethod
    def lower(own: np.ndarray | float, m: dict, level: int, ctx: np.ndarray, above: np.ndarray) -> np.ndarray:
        return (own + (THETA + m["d"][level] * m["T"][ctx]) * above) / (m["C"][ctx] + THETA)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words given by hash, and which are known."""
        return self.seek(self.words, words, np.ones(len(words), bool))

    @staticmethod
    def seek(keys: np.ndarray, wanted: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, known & (keys[at] == wanted)

    def each(self, word: np.ndarray, known: np.ndarray, ctx: np.ndarray) -> Iterator[np.ndarray]:
        """Per sample, the probability of each (word, ending); ``word`` counts only where ``known``."""
        up = parent(ctx)
        at2, hit2 = self.seek(self.key2, word << 20 | ctx, known)
        at1, hit1 = self.seek(self.key1, word << 20 | (up - LAST), known)
        for (_, m), p0, p1, p2 in zip(self.samples, self.p0, self.p1, self.p2):
            spare = (THETA + m["d"][0] * m["T"][ROOT]) * m["base"] / (m["C"][ROOT] + THETA)
            p = np.full(len(ctx), spare)
            p[known] = p0[word[known]]
            p = self.lower(0.0, m, 1, up, p)
            p[hit1] = p1[at1[hit1]]
            p = self.lower(0.0, m, 2, ctx, p)
            p[hit2] = p2[at2[hit2]]
            yield p

    def of(self, word: np.ndarray, known: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        return sum(self.each(word, known, ctx)) / len(self.samples)


class WordPredictions(Predictions):
    """Averaged probabilities of one bucket's words after any word."""

    def __init__(self, samples: list[tuple[Leaves, dict]]):
        super().__init__(samples)
        first = samples[0][0]
        word = np.repeat(np.arange(len(first.words)), first.size3)
        self.befores, self.key3 = first.befores, word << 32 | first.before
        self.total = np.bincount(word, first.c3, len(first.words))
        both = zip(samples, self.p2)
        self.p3 = sum(self.leaf(s.c3 - m["d"][3] * s.t3, m, s.before, p2[s.up2]) for (s, m), p2 in both) / len(samples)

    @staticmethod
    def leaf(own: np.ndarray | float, m: dict, before: np.ndarray, above: np.ndarray) -> np.ndarray:
        return (own + (THETA + m["d"][3] * m["T3"][before]) * above) / (m["C3"][before] + THETA)

    def after(self, word: np.ndarray, known: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Probability of each word after a word of ``befores``; ``word`` counts only where ``known``."""
        at, hit = self.seek(self.key3, word << 32 | before, known)
        out = np.zeros(len(word))
        out[hit] = self.p3[at[hit]]
        rest = np.flatnonzero(~hit)
        word, known, before = word[rest], known[rest], before[rest]
        for (_, m), p in zip(self.samples, self.each(word, known, ending_of(self.befores[before]))):
            out[rest] += self.leaf(0.0, m, before, p) / len(self.samples)
        return out


def score(docs: DataFrame, learnable=None) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) under a model of the rows that are ``learnable``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10). Null, empty and blank texts are the end token alone; repeated
    rows count and are scored each; missing ids are learned from unless the rule
    says otherwise; other columns are ignored. With nothing to learn from every
    token has the base probability 1. An empty table gives an empty result.

    Words are told apart by 64-bit hashes. Each shard of texts sends its counts
    by buckets of words; a bucket seats them, and later adds up its part of the
    scores of each shard's texts. No text is shuffled.
    """
    if learnable is None:
        learnable = F.coalesce(F.pmod(unsigned_crc32(F.col("doc_id")), F.lit(7)) != 2, F.lit(True))
    size = text_bytes(docs)
    buckets, parts, groups = (max(least, -(-size // of)) for least, of in ((4, BUCKET_BYTES), (4, PART_BYTES), (1, GROUP * SHARD_BYTES)))
    sent = requests(docs, buckets, groups, learnable, scored=False)
    counts = sent.select(
        "bucket", "g", "words", F.col("size").alias("size_"), "befores", "before", F.col("count").alias("count_")
    )
    partial = counts.groupBy("bucket", "g").applyInPandas(combined, SEATS_SCHEMA) if groups > 1 else counts.drop("g")
    seats = kept(partial.groupBy("bucket").applyInPandas(combined, SEATS_SCHEMA))
    del counts, partial
    release(docs.sparkSession)
    samples = rounds(seats, parts)
    models = [m for _, m in samples]
    tokens, words = models[0]["tokens"], models[0]["words"]
    told = seats.withColumns({"sample": F.lit(-1), "part": F.lit(TOTALS)} | {c: F.lit(None).cast("binary") for c in CELLS})
    for i, (rows, _) in enumerate(samples):
        told = told.unionByName(rows.withColumn("sample", F.lit(i)), allowMissingColumns=True)
    told = told.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def part(key: tuple, asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """This bucket's part of the scores of every text that it touches; rows about texts pass."""
        about = ["n_docs", "ids", "held", "tokens"]
        if key[0] < 0:
            asked["touched"] = asked["sums"] = None
            return asked[["shard", "bucket", "touched", "sums", *about]]
        out = []
        s = as_leaves(next(told[told["sample"] < 0].itertuples(index=False)))
        states = []
        for i, m in enumerate(models):
            seating, own = opened(s, told[told["sample"] == i], parts)
            states.append((seating, m | own))
        model = WordPredictions(states)
        for r in asked.itertuples(index=False):
            size, texts = unpack(r.size), unpack(r.texts)
            before = np.searchsorted(model.befores, unpack_sorted(r.befores))[unpack(r.before)]
            word, known = model.find(unpack_sorted(r.words))
            total = np.zeros(len(word))
            total[known] = model.total[word[known]]
            p = np.log10(model.after(np.repeat(word, size), np.repeat(known, size), before))
            base = np.log10((total + 1) / (tokens + words + 1))
            doc, times = unpack(r.doc), unpack(r.times, np.float64)
            word_of = np.repeat(np.repeat(np.arange(len(word)), size), texts)
            weights = [np.repeat(p, texts), base[word_of], known[word_of]]
            touched = np.flatnonzero(np.bincount(doc, minlength=r.n_docs))
            sums = np.concatenate([np.bincount(doc, times * w, r.n_docs)[touched] for w in weights])
            out.append((r.shard, r.bucket, pack(touched), sums.tobytes(), *[None] * 4))
        return pd.DataFrame(out, columns=["shard", "bucket", "touched", "sums", *about])

    asked = requests(docs, buckets, groups, learnable, scored=True).drop("count").groupBy("bucket", "g")
    sums = asked.cogroup(told.groupBy("bucket", "g")).applyInPandas(
        part, "shard long, bucket int, touched binary, sums binary, n_docs long, ids binary, held binary, tokens binary"
    )

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        r = rows.iloc[0]
        total = np.zeros((3, int(r["n_docs"])))
        for touched, s in zip(rows["touched"][1:], rows["sums"][1:]):
            total[:, unpack(touched)] += np.frombuffer(s, np.float64).reshape(3, -1)
        scores, base, known = total
        ids = [int(x) if x else None for x in r["ids"].decode().split("\n")]
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "held_out": np.frombuffer(r["held"], bool), "n_tokens": unpack(r["tokens"]),
            "n_known": np.rint(known).astype(np.int64), "train_tokens": tokens, "base_score": base, "score": scores,
        })

    return sums.groupBy("shard").applyInPandas(
        add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
