"""Small tables with every awkward case, and brute-force forms of the contracts."""

import hashlib
import random
import re
import zlib

from tests.conftest import SMALL

#: Columns of the caller whose names clash with those that the operators use inside.
CLASH = ("key", "version", "score", "block", "kind", "words", "fp", "sig", "n", "slot", "shard", "spans", "terms", "class",
         "__id", "__c", "label", "y", "vec")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "a", "en", "os", "ly")) for _ in range(n))


BASE = prose(1, 60)
ROWS = [
    (1, BASE), (2, BASE + " tail"), (3, prose(3, 60)), (None, prose(4, 30)), (None, None), (5, None), (6, ""),
    (7, " \n\t \x0b\n"), (8, "one two"), (9, "one two"), (10, BASE), (10, BASE), (11, prose(11, 20_000)),
    (12, "x" * 50_000), (13, "\U0001F600 漢字 é́ " * 20), (14, prose(14, 12) + "\n" + prose(14, 12) + "\n\n" + prose(15, 8)),
    (15, "A@b.co, a.b+c@x-y.org 10.0.0.255 10.0.0.256 4111 1111 1111 1111 +1 (555) 123-4567 " + prose(16, 55)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark, rows=ROWS):
    data = [(i, t, None if i == 3 else "en", "s", None if t is None else len(t)) + (None,) * len(CLASH) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA + "".join(f", `{c}` string" for c in CLASH))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def small(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def small_texts(spark):
    return {r["doc_id"]: r["text"] for r in small(spark, "documents").select("doc_id", "text").collect()}


def fold(doc_id, k):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % k


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
