"""Turn tries, byte-level BPE and ranked lexical search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken

from askwell.llm import byte_bpe, lexical, queries, turn_trie

from .tables import SF, documents, empty, odd
from .test_corpus import ordered, pairs

# 11


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()[:16]
            own[c].append(((t is not None, t or 0, digest), (role, text)))
    own = {c: [v for _, v in sorted(turns, key=lambda z: z[0])] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * words
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(out)


def odd_turns(spark):
    rng, rows = random.Random(5), []
    for c in [*range(-25, 45), 10**12, 10**12 + 7, None]:
        for t in range(rng.randrange(6)):
            rows.append((c, rng.choice([None, t, t, t, 0]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "a  b\n", "", None, "x" * 3000])))
    rows += [(20, 3, "user", "again")] * 3 + [(60, t, "user", f"long {t % 3}") for t in range(40)] + [(61, t, "user", f"long {t % 3}") for t in range(50)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(3)


@pytest.mark.parametrize("sizes", [(1024, 1 << 18), (3, 20), (5, 7)])
def test_trie_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(turn_trie, "SEGMENT", sizes[0])
    monkeypatch.setattr(turn_trie, "SHARD_TURNS", sizes[1])
    for turns in (odd_turns(spark), spark.read.parquet(f"{SF}/conversations.parquet")):
        want = brute_trie(pairs(turns, "conv_id", "turn", "role", "text"))
        assert ordered(map(tuple, turn_trie.prefix_trie(turns).collect())) == want
    assert turn_trie.prefix_trie(odd_turns(spark).limit(0)).count() == 0


def test_ids_of_many_ends_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "CHUNK_BITS", 2)
    rows = [(c, 0, "user", "same") for c in range(-70, 400, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert ordered(map(tuple, turn_trie.prefix_trie(turns).collect())) == brute_trie(rows)


def test_ternary_tree_is_balanced_and_has_a_node_per_prefix():
    rng = random.Random(2)
    sequences = sorted({tuple(rng.randrange(300) for _ in range(rng.randrange(4))) for _ in range(2000)})
    trie = turn_trie.TernaryTrie()
    paths = trie.insert_all([list(s) for s in sequences])
    prefixes = {s[:d] for s in sequences for d in range(1, len(s) + 1)}
    assert len(trie.turn) == len(prefixes) == len({node for p in paths for node in p})
    assert all(trie.up[i] < i for i in range(len(trie.up)))
    height, open_ = 0, [(trie.first, 1)]
    while open_:
        node, h = open_.pop()
        height = max(height, h)
        open_ += [(side[node], h + 1) for side in (trie.low, trie.high) if side[node] >= 0]
    assert height <= 2 * math.log2(300)


# 12


def library(path=None):
    ranks = byte_bpe.load(path or byte_bpe.vocabulary()).ranks
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark):
    known = library()
    for docs in (documents(spark), odd(spark)):
        want = []
        for i, text in pairs(docs, "doc_id", "text"):
            ids = known.encode_ordinary(text or "")
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        assert ordered(map(tuple, byte_bpe.digest(docs).collect())) == ordered(want)
        back = byte_bpe.decode(byte_bpe.encode(docs))
        assert "ids" in back.columns and set(docs.columns) <= set(back.columns)
        for r in back.select("text", "ids", "bytes").collect():
            assert r.ids == known.encode_ordinary(r.text or "") and bytes(r.bytes).decode() == (r.text or "")
    assert byte_bpe.digest(empty(spark)).count() == 0 and byte_bpe.encode(empty(spark)).count() == 0


def test_bpe_of_long_pieces_and_windows(monkeypatch):
    known, ours, split = library(), byte_bpe.load(byte_bpe.vocabulary()), byte_bpe.compiled(byte_bpe.pattern())
    rng = random.Random(1)
    texts = ["a" * 5000, "ab" * 300, " " * 999, "\n" * 700 + "x", "=" * 9999, "é" * 2000, "　\x85\x1c 's 'S", "x" * 600_000, "the end. " * 80_000]
    texts += ["".join(rng.choice("abtheing nto" if k % 2 else "abtheingnto") for _ in range(rng.randrange(2000))) for k in range(60)]
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(byte_bpe, "PIECES", 1000)
    for text, (n, ids, back) in zip(texts, byte_bpe.digests(texts, ours, split)):
        want = known.encode_ordinary(text)
        assert n == len(want) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert back == hashlib.sha256(text.encode()).hexdigest()


def test_every_character(monkeypatch):
    known, ours, split = library(), byte_bpe.load(byte_bpe.vocabulary()), byte_bpe.compiled(byte_bpe.pattern())
    text = "".join(f"a{chr(c)}1{chr(c)} " for c in [*range(0x3100), *range(0xFE00, 0x10200), *range(0x1F300, 0x1F700), 0xE0001, 0x10FFFF])
    assert ours.encode(split.findall(text))[0].tolist() == known.encode_ordinary(text)


def test_hashed_pairs():
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(0, 2**34, 50_000))
    table = byte_bpe.PairTable(key >> 17, key & 0x1FFFF, np.arange(len(key)))
    assert (table.find(key >> 17, key & 0x1FFFF) == np.arange(len(key))).all()
    other = np.setdiff1d(rng.integers(0, 2**34, 50_000), key)
    assert (table.find(other >> 17, other & 0x1FFFF) == byte_bpe.NONE).all()


# 13


def brute_rank(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        if item is None:
            continue
        asked, found = set(terms(text)), []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // max(total, 1)
            score = sum(int(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in asked if t in bag)
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return ordered(out)


def planned(got):
    return ordered(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize("sizes", [(16 << 20, 256, 512, 256), (20_000, 3, 12, 3)])
def test_search_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("SHARD_BYTES", "SHORT", "WIDE", "QUERIES"), sizes):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical, "BLOCK", 4 if sizes[1] == 3 else 64)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    strange = spark.createDataFrame(
        [(1, "alpha1 BETA2 gamma", 0), (1, "É é word upper", 1), (2, None, 2), (3, " .,", 3), (None, "alpha1", 4), (4, "zzz", 5), (5, "upper UPPER 文字 1", 6)] * 2,
        "item_id long, text string, doc_id long",
    )
    for docs, asked, k in ((documents(spark), items, 50), (odd(spark), strange, 3), (documents(spark), items.limit(0), 50)):
        got = lexical.rank(docs.repartition(3), asked, k)
        assert planned(got) == brute_rank(pairs(docs, "doc_id", "text"), pairs(asked, "item_id", "text"), k)
    assert lexical.rank(empty(spark), items).count() == 0


def test_blocks_of_other_topics_are_skipped():
    rng = random.Random(0)
    topics = [[f"t{t}w{i}" for i in range(40)] for t in range(8)]
    texts = [" ".join(["common"] * 3 + rng.choices(topics[n % 8], k=rng.randrange(30, 60))) for n in range(4000)]
    bags = [Counter(t.split()) for t in texts]
    total, df = sum(sum(b.values()) for b in bags), Counter(t for b in bags for t in b)
    index = lexical.index_shard(list(map(str, range(4000))), texts, 4000, total)
    row = type("Row", (), {c: lexical.pack(index[c]) for c in lexical.PACKED})
    row.terms, row.ids, row.summaries = index["terms"].view(np.int64), index["ids"].tobytes(), index["summaries"]
    shard = lexical.Shard(row)
    words = ["common", *topics[3][:5]]
    terms = lexical.word_hashes([w.encode() for w in words]).view(np.int64)
    weights = np.array([int(1000 * math.log(8002 / (2 * df[w] + 1))) for w in words])
    q, d, s = shard.top(np.zeros(len(words), np.int64), terms, weights, np.zeros(1, np.int64), 10)
    want = [(-s, i) for _, _, i, s in brute_rank(list(enumerate(texts)), [(0, " ".join(words))], 10)]
    assert sorted(zip((-s).tolist(), shard.ids[d].tolist())) == sorted(want)
    assert shard.passed > shard.opened


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_ranked_lexical"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert ordered(map(tuple, got.select(*names).collect())) == ordered(cursor.fetchall())
