"""Operators on documents against brute force, on real and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from askwell.llm import bm25, lang_id, mixing, packing, pii, pitman_yor, quality, simhash, suffix_dedup

from .tables import documents, empty, odd


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def both(spark):
    return [documents(spark), odd(spark)]


def ordered(rows):
    return sorted(rows, key=repr)


# 1


def test_language_id_accuracy_and_odd_rows(spark):
    got = lang_id.identify(documents(spark))
    rows = pairs(got.join(documents(spark).select("doc_id", "lang", "text"), "doc_id"), "doc_id", "held_out", "lang_pred", "score", "lang", "text")
    held = [r for r in rows if r[1] and any(c.isalpha() for c in r[5])]
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert sum(r[2] == r[4] for r in held) >= 0.95 * len(held)
    assert all(0 <= r[3] <= 1 for r in rows)
    strange = pairs(lang_id.identify(odd(spark)), "doc_id", "lang_pred", "score")
    assert len(strange) == 14
    assert {r[1:] for r in strange if r[0] in (3, 4, 5, 11)} == {("und", 0.0)}
    assert all(r[1] != "und" for r in strange if r[0] in (1, 2, 6, 8, 9))
    assert lang_id.identify(empty(spark)).count() == 0


def test_network_learns_two_alphabets():
    texts = ["abab baba abba"] * 30 + ["xyxy yxyx xyyx"] * 30
    codes = np.concatenate([lang_id.windows(t.encode()) for t in texts])
    network = lang_id.Network(2)
    network.train(codes, np.repeat([0, 1], 30))
    assert (network.predict(codes).argmax(1) == np.repeat([0, 1], 30)).all()


# 2


def brute_bm25(docs, queries, k):
    bags = [(i, Counter((t or "").encode().lower().split())) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    mean = sum(sizes) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, text in set(queries):
        found = []
        for (i, bag), size in zip(bags, sizes):
            s = 0.0
            for w, n in Counter((text or "").encode().lower().split()).items():
                if w in bag:
                    idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                    s += n * idf * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * size / mean))
            if s > 0 and i is not None:
                found.append((-round(s, 8), i))
        out += [(q, rank + 1, i, round(-s, 5)) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return ordered(out)


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("size", [1000, 1 << 25])
def test_bm25_equals_exhaustive(spark, monkeypatch, which, size):
    monkeypatch.setattr(bm25, "SHARD_BYTES", size)
    docs = both(spark)[which]
    asked = docs.filter("doc_id is not null and doc_id % 20 < 3" if which == 0 else "doc_id is not null")
    got = bm25.top_k(docs, asked.withColumnRenamed("doc_id", "query_id"), 7)
    rows = ordered((q, r, d, round(s, 5)) for q, r, d, s in pairs(got, "query_id", "rank", "doc_id", "score"))
    assert rows == brute_bm25(pairs(docs, "doc_id", "text"), pairs(asked, "doc_id", "text"), 7)


def test_bm25_empty(spark):
    docs = empty(spark)
    assert bm25.top_k(docs, docs.withColumnRenamed("doc_id", "query_id")).count() == 0


# 3


def test_pii_keeps_identity_type_and_format(spark):
    texts = [
        "Write to Ann.Lee7@Mail.example.com or ann.lee7@mail.example.com, call +1 (702) 555-0742 or 702-555-0742.",
        "ann.lee7@mail.example.com bob@x.org 10.1.200.7 4111 1111 1111 1111 4111111111111111 123-45-6789",
        'token = "2ABC3FF2CA8FB1E4C565A0EB63815530A948BDDE" 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde',
        "Mrs. Mary Smith met Mr. Smith and Mr Jones; госпожа Анна Петрова. Version 2.0 of 1.2.3, year 2024.",
        "Nothing here, at all: 12 of 345.", None, "",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, surrogate string")
    got = {r.doc_id: (r.text, r.n_replaced, r.surrogate) for r in pii.replace_entities(df).collect()}
    assert got[4] == (texts[4], 0, "x") and got[5] == (None, 0, "x") and got[6] == ("", 0, "x")
    assert [got[i][1] for i in range(4)] == [4, 6, 2, 4]
    mails = re.findall(r"\S+@[\w.]+\w", got[0][0])
    assert len({m.lower() for m in mails}) == 1 and mails[0].lower() != "ann.lee7@mail.example.com" and mails[1] in got[1][0]
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.com", mails[1])
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}\.$", got[0][0])
    cards = re.search(r"((?:\d{4} ){3}\d{4}) (\d{16})", got[1][0])
    digits = [int(c) for c in cards[2]]
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111"
    assert sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r" [1-9]\d\.[1-9]\.[12]\d\d\.[1-9] ", got[1][0]) and re.search(r" \d{3}-\d{2}-\d{4}$", got[1][0])
    secret = re.findall(r"[0-9a-fA-F]{40}", got[2][0])
    assert secret[0] == secret[1].upper() and secret[1] != "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
    names = re.fullmatch(
        r"Mrs\. (\w+) (\w+) met Mr\. (\w+) and Mr (\w+); госпожа (\w+) (\w+)\. Version 2\.0 of 1\.2\.3, year 2024\.", got[3][0]
    )
    assert names[1] in pii.GIVEN["female", "latin"] and names[2] == names[3] != names[4] and "Smith" not in got[3][0]
    assert names[5] in pii.GIVEN["female", "cyrillic"] and re.fullmatch("[А-я]+", names[6])


def test_pii_distinct_entities_stay_distinct(spark):
    df = spark.range(2500).selectExpr("id as doc_id", "concat('at ', id div 50, '.', id % 50 % 9, '.1.1 or u', id, '@a.de') as text")
    got = pii.replace_entities(df).collect()
    real = {m for i in range(2500) for m in (f"{i // 50}.{i % 50 % 9}.1.1", f"u{i}@a.de")}
    found = {m for r in got for m in re.findall(r"[\d.]{7,}|\S+@\S+", r.text)}
    assert len(found) == len(real) and not found & real


def test_pii_odd_rows(spark):
    got = pii.replace_entities(odd(spark))
    assert ordered(pairs(got.drop("n_replaced"), "*")) == ordered(pairs(odd(spark), "*"))
    assert pii.replace_entities(empty(spark)).count() == 0


# 4


def sizes_of(rows):
    return Counter({s: 0 for s in {r[1] for r in rows}}) + Counter()


@pytest.mark.parametrize("which", [0, 1])
def test_mix_meets_targets(spark, which):
    docs = both(spark)[which]
    rows = pairs(docs, "doc_id", "source", "text")
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        above = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not above:
            break
        full |= above
    target = {s: 2 * size[s] if s in full else weight[s] * level for s in names}
    got = pairs(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken")
    assert len(got) == len(rows)
    assert ordered((r[0], r[1], r[2], round(r[3], 3)) for r in got) == ordered(
        (i, len((t or "").encode().split()), size[s], round(target[s], 3)) for i, s, t in rows
    )
    assert all(0 <= r[4] <= 2 * r[1] for r in got)
    taken = Counter()
    for r in got:
        taken[round(r[3], 3), r[2]] += r[4]
    for (aim, of), words in taken.items():
        same = sum(1 for s in names if size[s] == of and round(target[s], 3) == aim)
        assert abs(words - aim * same) <= 3 * mixing.BLOCK * same
    assert ordered(got) == ordered(pairs(mixing.mix(docs.repartition(5)), "doc_id", "size", "source_size", "target", "taken"))


def test_mixed_texts_hold_what_is_taken(spark):
    docs = documents(spark)
    taken = {r[0]: r[1] for r in pairs(mixing.mix(docs), "doc_id", "taken")}
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for i, t, n in pairs(mixed, "doc_id", "text", "n_chars"):
        words[i] += len(t.encode().split())
        assert n == len(t)
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_texts(empty(spark)).count() == 0


def test_seats_are_the_highest_quotients(spark):
    share = [503, 211, 211, 97, 13, 5, 1]
    for house in (1, 3, 10, 57, 1000):
        rows = spark.createDataFrame([(0, i, s, house, 10**6) for i, s in enumerate(share)], "h int, __row int, s int, __seats int, b int")
        got = dict(pairs(mixing.seats(rows, ["h"], "s", "b", "n"), "__row", "n"))
        best = sorted(((s / (2 * k - 1), -i) for i, s in enumerate(share) for k in range(1, house + 1)), reverse=True)[:house]
        assert got == {i: sum(1 for _, j in best if -j == i) for i in range(len(share))}


# 5


@pytest.mark.parametrize("which", [0, 1])
def test_packing(spark, which):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    tokenizer.encode_special_tokens = True
    docs = both(spark)[which]
    expect = []
    for i, text in pairs(docs, "doc_id", "text"):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expect.append((i, p, at, len(part), zlib.crc32(part.tobytes())))
    got = pairs(packing.pack(docs), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert ordered(r[:5] for r in got) == ordered(expect)
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * sum(r[3] for r in got) / 4096 + 2
    assert packing.pack(empty(spark)).count() == 0


# 6


def brute_dedup(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in order]
    for i, x in data:
        for p in range(len(x) - 49):
            first.setdefault(x[p : p + 50], i)
    for (i, x), (raw, _) in zip(data, order):
        gone = np.zeros(len(x) + 1, int)
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < i:
                gone[p] += 1
                gone[p + 50] -= 1
        cover = np.cumsum(gone)[: len(x)] > 0
        edges = np.diff(np.concatenate([[0], cover.astype(int)]))
        left = np.frombuffer(x, np.uint8)[~cover].tobytes()
        out.append((raw, len(x), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("which", [0, 1])
def test_suffix_dedup_equals_brute_force(spark, which):
    docs = both(spark)[which]
    got = suffix_dedup.dedup(docs, 200_000, 100_000)
    assert ordered(pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_dedup(pairs(docs, "doc_id", "text"))


def test_suffix_dedup_planted_and_empty(spark):
    line = "a line that stands in nearly every document of the table, word for word; "
    rows = [(i, "".join(f"{i}-{j} own words here " for j in range(i % 5 + 1)) + line * (1 + i % 3) + "x" * (40 + i)) for i in range(60)]
    rows += [(100 + i, "ab" * (24 + i)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(pairs(suffix_dedup.dedup(df), "*")) == brute_dedup(rows)
    assert suffix_dedup.dedup(empty(spark)).count() == 0


# 7


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


@pytest.mark.parametrize("which", [0, 1])
def test_quality_statistics_and_verdict(spark, which):
    docs = both(spark)[which]
    got = pairs(quality.judge(docs), "doc_id", *quality.STATS, "base_failed", "kept")
    assert ordered(r[:-1] for r in got) == ordered((i, *brute_stats(t)) for i, t in pairs(docs, "doc_id", "text"))
    assert not any(r[-1] and r[-2] for r in got)
    kept = quality.keep_sound(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1] for r in got)
    assert quality.judge(empty(spark)).count() == 0 and quality.keep_sound(empty(spark)).count() == 0


def test_quality_rejects_outliers_only(spark):
    clean = [(i, " ".join(f"w{(i * j) % 997}ord" for j in range(1, 120 + i % 40)), "en", "s") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{(i * j) % 997}###" for j in range(1, 150)), "en", "s") for i in range(40)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    got = dict(pairs(quality.judge(df), "doc_id", "kept"))
    failed = {r[0] for r in clean if brute_stats(r[1])[-1]}
    assert all(got[r[0]] or r[0] in failed for r in clean) and not any(got[r[0]] for r in junk)


# 8


def test_pitman_yor_base_counts_and_held_out(spark):
    docs = documents(spark)
    rows = pairs(docs, "doc_id", "text")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*(t or "").encode().lower().split(), b" end"] for i, t in rows}
    count = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    got = pairs(pitman_yor.score(docs), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert len(got) == len(rows)
    better = 0
    for i, h, size, known, train, base, score in got:
        assert (h, size, known, train) == (held[i], len(tokens[i]), sum(w in count for w in tokens[i]), n)
        assert base == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i]), rel=1e-9)
        assert score < 0
        better += (score - base) if h else 0
    assert better > 0  # over all held-out texts the model is better than the base


def test_pitman_yor_odd_rows(spark):
    got = pairs(pitman_yor.score(odd(spark)), "doc_id", "n_tokens", "n_known", "score")
    assert len(got) == 14 and {r[1] for r in got if r[0] in (3, 4, 5)} == {1}
    assert all(math.isfinite(r[3]) and r[3] <= 0 for r in got)
    assert pitman_yor.score(empty(spark)).count() == 0


def test_pitman_yor_is_a_distribution():
    """Over the known words and one unknown, probabilities add up to one in every context."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 40) % 60) for _ in range(30)]
    t = pitman_yor.shard_tables(texts, np.zeros(30, bool))
    s = pitman_yor.Seating(t["words"], np.bincount(t["word"], minlength=len(t["words"])), t["ctx"], t["count"])

    def model():
        ctx, c, k = s.totals()
        full, tables = np.zeros(pitman_yor.ROOT + 1), np.zeros(pitman_yor.ROOT + 1)
        full[ctx], tables[ctx] = c, k
        d = [0.5, 0.6, 0.7]
        return {"C": full, "T": tables, "d": d, "stirling": [pitman_yor.stirling(x) for x in d], "base": 1 / (len(s.words) + 1)}

    for _ in range(5):
        s.sweep(model(), rng)
        assert (s.t2 >= 1).all() and (s.t2 <= s.c2).all() and (s.t1 <= s.c1).all() and (s.t0 <= s.c0).all()
    n = len(s.words)
    for ctx in [0, int(s.ctx2[3]), 40000]:
        every = pitman_yor.Predictions([(s, model())])
        p = every.of(np.append(np.arange(n), 0), np.append(np.ones(n, bool), False), np.full(n + 1, ctx))
        assert p.sum() == pytest.approx(1.0, abs=1e-9) and (p > 0).all()


def fixed(n, weight, d):
    """A parent that gives every table the same chance."""
    zero = np.zeros(n)
    return pitman_yor.Above(zero, zero, 0.0, zero, zero + weight, True)


def test_tables_against_enumeration():
    """Of all seatings of five customers of a dish, by their weights, how often there are so many tables."""
    d, weight, c = 0.4, 0.7, 5

    def seatings(n):
        if n == 0:
            yield [], 1.0
            return
        for sizes, w in seatings(n - 1):
            for i, s in enumerate(sizes):
                yield [*sizes[:i], s + 1, *sizes[i + 1 :]], w * (s - d)
            yield [*sizes, 1], w * weight * (1 + d * len(sizes))

    every = [(len(s), w) for s, w in seatings(c)]
    total = sum(w for _, w in every)
    table, rng = pitman_yor.stirling(d), np.random.default_rng(3)
    drawn = pitman_yor.seated(np.full(200_000, c), np.ones(200_000, int), np.ones(200_000), d, table, fixed(200_000, weight, d), rng)
    for _ in range(20):
        drawn = pitman_yor.seated(np.full(200_000, c), drawn, np.ones(200_000), d, table, fixed(200_000, weight, d), rng)
    for t in range(1, c + 1):
        assert (drawn == t).mean() == pytest.approx(sum(w for n, w in every if n == t) / total, abs=0.006)


def test_tables_of_many_customers(monkeypatch):
    """The passes beyond the exact table against the exact numbers of so many customers."""
    d, c = 0.6, 500
    monkeypatch.setattr(pitman_yor, "EXACT", c)
    log_s = pitman_yor.stirling(d)
    monkeypatch.setattr(pitman_yor, "EXACT", 96)
    rng = np.random.default_rng(4)
    for weight in (0.05, 1.0, 20.0):
        log_p = log_s[c, 1:] + np.arange(1, c + 1) * np.log(weight)
        p = np.exp(log_p - log_p.max())
        want = (p * np.arange(1, c + 1)).sum() / p.sum()
        t = np.ones(400, int)
        for _ in range(20):
            t = pitman_yor.seated(np.full(400, c), t, np.zeros(400), d, log_s, fixed(400, weight, d), rng)
        assert t.mean() == pytest.approx(want, rel=0.12, abs=0.15)


class Plain:
    """One customer at a time, with every table of every restaurant."""

    def __init__(self, tokens, d, base, seed):
        self.d, self.base, self.rng = d, base, np.random.default_rng(seed)
        self.tables, self.c, self.t = {}, Counter(), Counter()  # by (restaurant, word), by restaurant
        self.tokens = tokens
        for ctx, word in tokens:
            self.add(2, ctx, word)

    @staticmethod
    def up(level, ctx):
        return int(pitman_yor.parent(np.array([ctx]))[0]) if level == 2 else pitman_yor.ROOT

    def p(self, level, ctx, word):
        above = self.base if level == 0 else self.p(level - 1, self.up(level, ctx), word)
        own = self.tables.get((ctx, word), [])
        return (sum(own) - self.d[level] * len(own) + (1.0 + self.d[level] * self.t[ctx]) * above) / (self.c[ctx] + 1.0)

    def add(self, level, ctx, word):
        own = self.tables.setdefault((ctx, word), [])
        above = self.base if level == 0 else self.p(level - 1, self.up(level, ctx), word)
        weights = np.array([n - self.d[level] for n in own] + [(1.0 + self.d[level] * self.t[ctx]) * above])
        at = int(self.rng.choice(len(weights), p=weights / weights.sum()))
        self.c[ctx] += 1
        if at < len(own):
            own[at] += 1
            return
        own.append(1)
        self.t[ctx] += 1
        if level:
            self.add(level - 1, self.up(level, ctx), word)

    def remove(self, level, ctx, word):
        own = self.tables[ctx, word]
        at = int(self.rng.choice(len(own), p=np.array(own) / sum(own)))
        self.c[ctx] -= 1
        own[at] -= 1
        if not own[at]:
            own.pop(at)
            self.t[ctx] -= 1
            if level:
                self.remove(level - 1, self.up(level, ctx), word)

    def sweep(self):
        for ctx, word in self.tokens:
            self.remove(2, ctx, word)
            self.add(2, ctx, word)


def test_pitman_yor_against_a_plain_sampler():
    """Averaged probabilities agree with those of a sampler that moves one customer at a time."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x) % 9}{'ab'[int(x) % 2]}" for x in rng.zipf(1.4, 30)) for _ in range(30)]
    t = pitman_yor.shard_tables(texts, np.zeros(30, bool))
    s = pitman_yor.Seating(t["words"], np.bincount(t["word"], minlength=len(t["words"])), t["ctx"], t["count"])
    d, n = [0.4, 0.5, 0.6], len(s.words)
    samples = []
    for number in range(200):
        ctx, c, k = s.totals()
        full, tables = np.zeros(pitman_yor.ROOT + 1), np.zeros(pitman_yor.ROOT + 1)
        full[ctx], tables[ctx] = c, k
        model = {"C": full, "T": tables, "d": d, "stirling": [pitman_yor.stirling(x) for x in d], "base": 1 / (n + 1)}
        if number >= 20:
            kept = pitman_yor.Seating(s.words, s.size, s.ctx2, s.c2, s.t2, s.t1, s.t0)
            samples.append((kept, model))
        s.sweep(model, rng)
    asked = np.repeat(np.arange(n), 4), np.tile(np.array([0, int(s.ctx2[0]), int(s.ctx2[-1]), 40000]), n)
    ours = pitman_yor.Predictions(samples).of(asked[0], np.ones(len(asked[0]), bool), asked[1])
    tokens = [(int(c), int(w)) for w, c, times in zip(s.word2, s.ctx2, s.c2) for _ in range(times)]
    plain, theirs = Plain(tokens, d, 1 / (n + 1), 6), np.zeros(len(ours))
    for number in range(170):
        plain.sweep()
        if number >= 20:
            theirs += [plain.p(2, int(c), int(w)) / 150 for w, c in zip(*asked)]
    seen = np.array([int(c) in {x for x, _ in tokens} for c in asked[1]])
    # Dishes drawn side by side leave a small bias for a word that rules its parents.
    assert np.abs(np.log(ours[seen] / theirs[seen])).mean() < 0.15
    tables = [np.mean([getattr(s, name).sum() for s, _ in samples]) for name in ("t2", "t1", "t0")]
    plain_tables = [sum(len(own) for (ctx, _), own in plain.tables.items() if low <= ctx <= high) for low, high in
                    ((0, pitman_yor.LAST - 1), (pitman_yor.LAST, pitman_yor.ROOT - 1), (pitman_yor.ROOT, pitman_yor.ROOT))]
    assert tables == pytest.approx(plain_tables, rel=0.15)


# 9


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("which", [0, 1])
def test_simhash_classes(spark, which):
    docs = both(spark)[which]
    rows = [(i, brute_print(t)) for i, t in pairs(docs, "doc_id", "text")]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    expect = ordered((i, f"{h:016x}", least.get(find(a))) for a, (i, h) in enumerate(rows))
    assert ordered(pairs(simhash.near_classes(docs), "doc_id", "fingerprint", "component_id")) == expect
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and one.count() == len({find(a) for a in range(len(rows))})
    assert simhash.near_classes(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def test_simhash_index_and_cells_find_every_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]))
    near = [(a, b) for a in range(len(values)) for b in range(a) if int(values[a] ^ values[b]).bit_count() <= 4]
    levels = simhash.build_index(values[np.argsort(simhash.gray_rank(values))])
    got = sum(len(a) for a, _ in simhash.linked_pairs(levels, None, 4))
    assert got == len(near)
    monkeypatch.setattr(simhash, "CELL", 3)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in simhash.near_links(df).collect()]
    labels = simhash.local_forest(len(values), *np.array(near).T)
    where = {int(v): i for i, v in enumerate(values)}
    mine = simhash.local_forest(len(values), *np.array([(where[int(a)], where[int(b)]) for a, b in links]).T)
    assert (labels == mine).all()
