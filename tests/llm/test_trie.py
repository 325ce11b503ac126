"""The prefix trie against a plain one: nulls, ties, missing heads, long and equal conversations, negative ids."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string, depth string, n int"


def plain(rows):
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            mark = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            said.setdefault(conv, []).append((turn is not None, turn or 0, mark, (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in said.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids, below = Counter(), {}
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node in sorted(members, key=len, reverse=True):
        leaves, saved = below.setdefault(node, [0, 0])
        leaves += not kids[node]
        saved += (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below[node] = [leaves, saved]
        if node:
            up = below.setdefault(node[:-1], [0, 0])
            up[0] += leaves
            up[1] += saved
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), kids[node], *below[node], digest))
    return Counter(out)


def some_rows(seed):
    rng = random.Random(seed)
    texts = ["yes", "no", "héllo 漢", "", None, "x" * 300]
    rows = []
    for c in [*range(120), *range(-12, 0), 10**12, 10**12 + 3, 7_000_001]:
        if c % 5 == 0 and rng.random() < 0.3:
            continue  # no conversation to take a head from
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None]), rng.choice(texts)))
    for c in (200, 201, 205, 210, 211):  # long ones, equal up to their ends
        rows += [(c, t, "user", f"turn {t}") for t in range(60 - c % 4)]
    rows += [(500, t, "user", f"deep {t}") for t in range(400)]
    rows += rows[10:14] + [(None, 1, "user", "nowhere"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS).repartition(5)
    return Counter(tuple(r) for r in trie.prefix_trie(df).collect())


def test_trie_equals_plain(spark):
    rows = some_rows(3)
    assert got(spark, rows) == plain(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_ROWS", 16)
    rows = some_rows(4)
    assert got(spark, rows) == plain(rows)


def test_no_conversations(spark):
    assert got(spark, []) == Counter()


def random_depths(rng, n):
    depth, out = 0, []
    for i in range(n):
        depth = 0 if i == 0 else rng.randint(max(1, depth - rng.choice([0, 1, 5])), depth + 1)
        out.append(depth)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 2, 60, 3000])
def test_find_close(n):
    depth = random_depths(random.Random(n), n)
    parens = trie.Parentheses(depth, True)
    close = parens.find_close()
    assert int(parens.opens.sum()) == n
    for i in range(n):
        after = [j for j in range(i + 1, n) if depth[j] <= depth[i]]
        assert parens.opened[close[i]] == (after[0] if after else n)
        leaves = sum(1 for j in range(i, after[0] if after else n) if j + 1 == n or depth[j + 1] <= depth[j])
        assert parens.leaf_pairs[close[i]] - parens.leaf_pairs[parens.at[i]] == leaves
    assert (close == len(parens.excess)).sum() == len([i for i in range(n) if all(depth[j] > depth[i] for j in range(i + 1, n)) and i < n - 1])


@pytest.mark.parametrize("shard", [1, 3, 17, 100])
def test_shared_spines_merge(shard):
    rng = random.Random(shard)
    depth = random_depths(rng, 400)
    leaf = np.append(depth[1:] <= depth[:-1], True).astype(np.int64)
    saved = np.array([rng.randint(0, 9) for _ in depth])
    items = np.stack([np.arange(400), np.ones(400, np.int64), depth, leaf, saved, np.ones(400, np.int64)], axis=1)
    found, level = {}, 0
    while len(items):
        final = level > 0 and len(items) <= max(shard, 40)
        on = []
        for at in range(0, len(items), len(items) if final else max(shard, 3 * level)):
            done, rest, _ = trie._shard(items[at : at + (len(items) if final else max(shard, 3 * level))], level, final)
            found.update({r[0]: (r[3], r[4]) for r in done.tolist()})
            on.append(rest)
        items, level = np.concatenate(on), level + 1
        assert level < 400
    for i in range(400):
        stop = next((j for j in range(i + 1, 400) if depth[j] <= depth[i]), 400)
        assert found[i] == (leaf[i:stop].sum(), saved[i:stop].sum())
