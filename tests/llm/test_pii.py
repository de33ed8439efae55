import re

from shelfscope.llm import pii
from tests.llm.support import ROWS, edge_docs, rows_of, sha, small, small_texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
HARD = [
    (1, "a@b.c_d@e.f a@b.c.d@e.f x@y z@z. @q.r a@b..c p@q.r@s.t"), (2, "1.2.3.4.5.6.7.8 256.1.1.1 00255.0.0.1 1..2.3.4 9.9.9"),
    (3, "4111111111111111 4111-1111 1111-1111 41111111111111112 5500 0000 0000 0004  378282246310005 4111  1111"),
    (4, "+1 (555) 123-4567 +12 +1+23456789 +1-2.3(4)5 6 7 8 9 +123456789012345678 ++49 30 901820"),
    (5, "é@ü.de \U0001F600 a@b.co 漢+1 555 123 4567漢"), (6, "1" * 3000 + " " + "a.b" * 2000 + "@" + "x." * 2000),
    (7, "mail me: a@b.co\ncall +1 555 123 4567\n10.0.0.1 10.0.0.2"), (8, "11111111111111111111111111@x.y 4111 1111 1111 1111@z.w"),
]


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        odd, even = d[-1::-2], d[-2::-2]
        return 13 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def brute(docs):
    out = []
    for i, t in docs:
        s = spans(t)
        out.append((i, *(sum(x[0] == k for x in s) for k in PATTERNS), sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))))
    return sorted(out, key=repr)


def test_edge_rows(spark):
    for rows in (ROWS, HARD):
        assert rows_of(pii.digests(edge_docs(spark, rows)), *COLUMNS) == brute(rows)


def test_small_tables(spark):
    got = pii.digests(small(spark, "documents")).cache()
    assert rows_of(got, *COLUMNS) == brute(small_texts(spark).items())
    texts = small_texts(spark)
    for r in got.collect():  # all spans begin with the base spans
        assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in spans(texts[r["doc_id"]])))


def disclosing():
    """40 lines with an address after 'reach', which occurs nowhere else; 'seldom' in half."""
    rows = [(i, f"plain words stand here number {'abc'[i % 3]}\nand reach {'seldom' if i % 2 else 'plain'} user{i}@mail.org now\nlast line")
            for i in range(40)]
    return rows + [(100 + i, "\n".join(["plain words and now stand"] * 20)) for i in range(40)]


def test_disclosing_terms(spark):
    rows = disclosing()
    docs = edge_docs(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in pii.digests(docs).select("doc_id", "spans").collect()}
    for i, text in rows:
        names = [text[int(a):int(b)] for k, a, b in (x.split(":") for x in got[i].split(",") if x) if k == "term"]
        assert names == ([] if i >= 100 else ["reach", "seldom"] if i % 2 else ["reach"])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[1] == "plain words stand here number b\nand   [EMAIL] now\nlast line"
    assert clean[100] == rows[40][1]


def test_terms_of_a_value_and_everywhere(spark):
    """A name above its number, in two texts only; 'reach' in lines and texts without an address."""
    rows = [*disclosing(), (200, "call us\nOrtrud Zwick\n+1 555 123 4567 plain"), (201, "now Ortrud\n\n+1 (555) 123-4567 words"),
            (202, "words of Ortrud alone\nand now"), (203, "plain reach stand"), (None, "null reach")]
    rows += [(300 + i, "call us now, plain words") for i in range(20)]
    docs = edge_docs(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in pii.digests(docs).select("doc_id", "spans").collect()}
    assert got[202] == "term:9:15" and got[203] == "term:6:11" and got[None] == "term:5:10"
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert "Ortrud" not in clean[200] + clean[201] + clean[202] and "reach" not in clean[203] + clean[None]
    assert clean[203] == "plain  stand" and clean[300] == rows[-1][1] and "Zwick" in clean[200]


def test_sanitised_edge_rows(spark):
    docs = edge_docs(spark, ROWS + HARD)
    got = pii.sanitised(docs)
    assert got.columns == docs.columns
    texts = [r["text"] for r in got.collect()]
    assert len(texts) == len(ROWS + HARD)
    assert all(not spans(t) or "[" in t for t in texts)
    by_id = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by_id[7] == "mail me: [EMAIL]\ncall [PHONE]\n[IP] [IP]" and by_id[5] == "é@ü.de \U0001F600 [EMAIL] 漢[PHONE]漢"


def test_empty_table(spark):
    assert pii.digests(edge_docs(spark, [])).count() == 0
    assert pii.sanitised(edge_docs(spark, [])).count() == 0


def test_plan_is_native(spark):
    plan = pii.digests(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_word_rows_in_many_parts(spark, monkeypatch):
    docs = edge_docs(spark, disclosing())
    want = rows_of(pii.digests(docs), *COLUMNS, "spans")
    monkeypatch.setattr(pii, "WORDS_BYTES", 200)
    assert rows_of(pii.digests(docs), *COLUMNS, "spans") == want
