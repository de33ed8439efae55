import base64
import hashlib

import numpy as np
import tiktoken

from shelfscope.llm import byte_bpe, common
from tests.llm.support import ROWS, edge_docs, rows_of, small, small_texts

COLUMNS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
PATH, PATTERN = byte_bpe.default_tokenizer()


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODING = library()


def brute(docs):
    out = []
    for i, t in docs:
        ids = np.array(ENCODING.encode_ordinary(t or ""), "<u4")
        out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edge_rows_and_small_tables(spark):
    for docs, rows in ((edge_docs(spark), ROWS), (small(spark, "documents"), list(small_texts(spark).items()))):
        got = byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(docs)))
        assert rows_of(got, *COLUMNS) == brute(rows)
        assert rows_of(byte_bpe.round_trip(docs), *COLUMNS) == brute(rows)


def test_empty_table(spark):
    assert byte_bpe.round_trip(edge_docs(spark, [])).count() == 0
    assert byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(edge_docs(spark, [])))).count() == 0


def test_hard_pieces():
    bpe = byte_bpe.Bpe(PATH, PATTERN)
    texts = ["a" * 3000, "é" * 700, "=" * 4001, "xqz" * 900, "abab" * 120, "<|endoftext|>", "\r\n\t  \n x", "ﬀ漢字\U0001F600" * 300,
             "".join(map(chr, range(33, 1200))), " " * 700 + "x", "Donaudampfschifffahrtsgesellschaft" * 20, ""]
    ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode([t.encode() for t in texts])]
    assert [x.tolist() for x in ids] == [ENCODING.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids) == [t.encode() for t in texts]


def test_both_queries_agree():
    bpe = byte_bpe.Bpe(PATH, PATTERN)
    pieces = sorted({w for t in ("Überraschungsei naïveté 日本語テキスト zzzzyx antidisestablishmentarianism",) for w in t.split()})
    bpe.learn(pieces)
    one = [bpe.known[p] for p in pieces]
    bpe.known.clear()
    bpe._contract(byte_bpe.CONTRACT_LONG, [(p, p.encode()) for p in pieces])
    assert all(bpe.known[p] == x for p, x in zip(pieces, one) if len(x) > 4)


def test_other_tokenizer_file(spark):
    import public_tokenizers as P

    docs = edge_docs(spark, [(1, "Other ranks, same query.")])
    ids = byte_bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = byte_bpe.decoded(ids, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()
    assert bytes(got["decoded"]).decode() == "Other ranks, same query."


def test_each_slice_spells_its_own_distinct_runs():
    bpe = byte_bpe.Bpe(PATH, PATTERN)
    for texts in (["one two one two one", "two zzyzx"], ["three", "", "one zzyzx"]):
        runs = bpe.runs([t.encode() for t in texts])
        assert bpe.latest == {r for text in runs for r in text}
        assert bpe.spell(runs) == [t.encode() for t in texts]


def test_other_operators_drop_what_a_worker_keeps():
    byte_bpe._loaded(*byte_bpe.default_tokenizer())
    assert list(common.released(lambda batches: batches)([1, 2])) == [1, 2]
    assert byte_bpe._loaded.cache_info().currsize == 0


def test_lean_bounds_give_the_same_runs_and_hold_less():
    texts = [" ".join(f"w{i * j % 9973}x{i}" for j in range(400)).encode() for i in range(60)]
    lean, wide = byte_bpe.Bpe(PATH, PATTERN, byte_bpe.LEAN._replace(room=4_000, new=300)), byte_bpe.Bpe(PATH, PATTERN)
    for s in range(0, len(texts), 4):
        runs = lean.runs(texts[s:s + 4])
        assert runs == wide.runs(texts[s:s + 4]) and lean.spell(runs) == texts[s:s + 4]
        assert len(lean.known) + len(lean.older) <= 4_000 and len(lean.spelled) <= 2_000
    assert len(wide.known) > 4_000
    assert byte_bpe.LEAN.room < byte_bpe.Bounds().room and byte_bpe.LEAN.slice_bytes < byte_bpe.Bounds().slice_bytes


def test_round_trip_of_workers_that_keep_nothing(spark):
    docs = edge_docs(spark, ROWS)
    columns = "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    assert rows_of(byte_bpe.round_trip(docs, keep=False), *columns) == rows_of(byte_bpe.round_trip(docs), *columns)
