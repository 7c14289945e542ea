"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from sitewise.llm import turn_trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("size", T.StringType()), T.StructField("seq", T.StringType())])


def rows(seed: int = 4, n: int = 180) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for c in range(n):
        if c % 17 == 5:
            continue                                                        # an absent parent, absent children
        for t in range(rng.choice((1, 2, 3, 5, 9, 14))):
            text = rng.choice(("yes", "no", "Ünï 漢字", "", None, "x" * 300)) if t < 3 else f"turn {rng.randrange(4)}"
            out.append((c, t, rng.choice(("user", None, "")) if t == 1 else "user", text))
    for c in range(400, 460):                                               # equal conversations, some very long ones
        out += [(c, t, "u", f"same {t}") for t in range(40 if c % 20 else 75)]
    out += [(-7, 0, "u", "negative"), (-10, None, "u", "first"), (-10, 0, "u", "second"), (None, 0, "u", "nobody's"),
            (1000, 0, "u", "y" * 2_000_000), (1001, 0, "us", "er"), (1002, 0, "user", "")]
    return [(*r, "z", "q") for r in out]


def brute(table: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, t, role, text, *_ in table:
        if c is not None:
            own[c].append(((t is not None, t or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    seqs = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - c % 5, [])[:h] + seq[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[:d - 1]].add(seq[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, found in members.items():
        own_saved = (len(found) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own_saved
            leaves[node[:d]] += node not in kids
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]) if k in kids else 0, leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k)).encode()).hexdigest())
                  for k, m in members.items())


def result(df) -> list[tuple]:
    assert df.columns == list(turn_trie.COLUMNS) and all(t == "bigint" for _, t in df.dtypes[:-1])
    return sorted(tuple(r) for r in df.collect())


def order(table: list[tuple]) -> list[tuple]:
    return sorted(table, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, *r[3:]))


@pytest.mark.parametrize("shard,at_once", [(1 << 16, 1 << 13), (300, 3), (7, 1)])
def test_equals_brute_force(spark, monkeypatch, shard, at_once):
    monkeypatch.setattr(turn_trie, "SHARD", shard)
    monkeypatch.setattr(turn_trie, "IDS_AT_ONCE", at_once)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    assert order(result(turn_trie.trie(turn_trie.rebuilt(df)))) == order(brute(rows()))


def test_no_conversations(spark):
    for table in ([], [(None, 0, "u", "t", "", "")]):
        assert result(turn_trie.trie(turn_trie.rebuilt(spark.createDataFrame(table, SCHEMA)))) == []


def test_repeated_rows_are_turns(spark):
    table = [(3, 0, "u", "a", "", "")] * 2 + [(4, 0, "u", "a", "", "")]
    got = turn_trie.trie(turn_trie.sequences(spark.createDataFrame(table, SCHEMA)))
    assert [r[:7] for r in order(result(got))] == [(3, 0, None, 2, 1, 1, 1), (3, 1, 3, 2, 1, 1, 1), (3, 2, 3, 1, 0, 1, 0)]
