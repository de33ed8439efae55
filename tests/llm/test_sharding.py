import hashlib
from collections import Counter

import pytest

from shelfscope.llm import sharding
from tests.llm.support import ROWS, edge_docs, rows_of

NAMES = tuple(f"s{i}" for i in range(7))


def by_turns(shards, size):
    """The table, claimed slot by slot from full preference lists."""
    import xxhash

    lists = []
    for s in shards:
        o = xxhash.xxh3_64_intdigest(s, seed=1) % size
        k = 1 + xxhash.xxh3_64_intdigest(s, seed=2) % (size - 1)
        lists.append([(o + j * k) % size for j in range(size)])
    taken = {}
    while len(taken) < size:
        for i, prefer in enumerate(lists):
            if len(taken) < size:
                taken[next(x for x in prefer if x not in taken)] = i
    return [taken[i] for i in range(size)]


def test_table_is_that_of_turns():
    assert sharding.lookup(NAMES, 101).tolist() == by_turns(NAMES, 101)


def test_shares_are_even_and_removal_moves_little():
    full, less = sharding.lookup(NAMES, 1009), sharding.lookup(NAMES[:-1], 1009)
    n = Counter(full.tolist())
    assert max(n.values()) - min(n.values()) <= 1
    stayed = sum(a == b for a, b in zip(full, less) if a != 6)
    assert stayed > 0.75 * (1009 - n[6])


def test_bad_tables_are_refused():
    for shards, size in ((NAMES, 100), ((), 101), (("a", "a"), 101), (tuple("abcd"), 3)):
        with pytest.raises(ValueError):
            sharding.lookup(shards, size)


def test_place_edge_rows(spark):
    got = rows_of(sharding.place(edge_docs(spark), "doc_id", NAMES, 101), "doc_id", "slot", "shard")
    table = by_turns(NAMES, 101)
    want = []
    for i, _ in ROWS:
        k = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % 101
        want.append((i, k, NAMES[table[k]]))
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert sharding.place(edge_docs(spark, []), "doc_id").count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    sharding.write_shards(edge_docs(spark).drop("shard", "slot"), "doc_id", f"{tmp_path}/out", NAMES, 101, 2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(ROWS)
