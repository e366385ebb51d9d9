"""Vector codes, personal data and spelling variants on odd and small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from axisloom.llm import privacy, spelling, vector_codes
from axisloom.llm.queries import SQL

# --- vector codes ---------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    """(vec_id, code, error) with Python ints, every entry tried; and the codebooks."""
    ints = [(i, [int(np.floor(float(v) * 256)) for v in x]) for i, x, _ in rows]
    n = len(ints[0][1]) // parts
    cut = lambda x, p: x[p * n : (p + 1) * n]
    first = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x, p) for _, x in first] for p in range(parts)]
    sq = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    near = lambda x, p: min((sq(cut(x, p), b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            took = {}
            for _, x in ints:
                took.setdefault(near(x, p)[1], []).append(cut(x, p))
            for e, xs in took.items():
                new[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        books = new
    out = []
    for i, x in ints:
        best = [near(x, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, parts STRING, code INT, n INT"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("scale", [1.0, 1e7, 1e30])
def test_vector_codes(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(v) for v in (rng.integers(-3, 4, 8) / 64 if i % 3 else rng.standard_normal(8)) * scale], [None, 1, 2][i % 3]) for i in range(150)]
    rows += [rows[9], rows[9], (None, rows[4][1], 1)]  # repeated rows, a null id
    bad = [(900, None, 1), (901, [], 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("inf")] * 8, 1), (904, [None] + [0.0] * 7, 1), (905, [0.5] * 6, 1), (906, [0.5] * 12, 1)]
    got = vector_codes.vector_codes(vectors(spark, rows + bad), parts=4, entries=8).toPandas()
    want, sha = brute_codes(rows, 4, 8, 2)
    limit = lambda v: min(v, (1 << 63) - 1)
    none = lambda v: None if v != v else int(v)
    assert sorted(((none(r.vec_id), r.code, r.error) for r in got.itertuples()), key=repr) == sorted(((i, c, limit(e)) for i, c, e in want), key=repr)
    assert set(got.codebooks_sha256) == {sha}
    label = Counter()
    for (_, _, lab), (_, _, e) in zip(rows, want):
        label[lab] += limit(e)
    assert set(got.label_error) == {limit(v) for v in label.values()}


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.vector_codes(none).count() == 0
    one = vectors(spark, [(5, [0.1] * 16, None)])
    assert vector_codes.vector_codes(one).first().asDict() | {"codebooks_sha256": ""} == {"vec_id": 5, "code": "00" * 16, "error": 0, "label_error": 0, "codebooks_sha256": ""}


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    book = rng.integers(-200, 200, (64, 4))
    x = np.concatenate((book[rng.integers(0, 64, 400)] + rng.integers(-9, 9, (400, 4)), book))
    pivots = vector_codes.choose_pivots(book, 4)
    roots = np.stack([vector_codes.fine_root(vector_codes.squares(x, p)) for p in pivots], axis=1)
    entry, low, evaluated = vector_codes.nearest(x, roots, book, pivots)
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == d.argmin(axis=1)).all() and (low == d.min(axis=1)).all()
    assert evaluated < len(x) * 16  # of 64


# --- personal data ----------------------------------------------------------------


def text_rows(spark, rows):
    data = [(d, t, "s", "x", 3, None) for d, t in rows]
    return spark.createDataFrame(data, "doc_id BIGINT, text STRING, source STRING, hash STRING, row INT, email STRING").repartition(3)


def private_rows():
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mé", "su") for b in ("ri", "to", "ña") for c in ("n", "x", "da", "vu")]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, some(rng.randrange(5, 60))) for i in range(60)]
    for i in range(60, 70):  # an entity with a word that stands nowhere else, and one that stands everywhere
        rows.append((i, f"{some(12)} Quibblewort {some(3)} ann.b@mail.example.org {rng.choice(words)} karin {some(20)}"))
    rows += [(70, rows[60][1]), (70, rows[60][1]), (None, rows[61][1]), (71, None), (72, ""), (73, "é " * 5000 + "10.0.0.300 1.2.3.4.5.6.7.8 +1 (22) 333-4444-5")]
    rows += [
        (74, "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890 a@b.c_d@e.f @x.y a@b@c.de"),
        (75, "+49 (30) 1234567 +1234 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7; 00000255.1.1.1 4111 1111 1111 1111"),
        (76, "x" * 30_000 + "@" + "y" * 30_000 + " " + "1 " * 20_000),
        (77, "+" * 500 + "+1.2.3.4.5.6.7.8 ann.b@mail.example.org4111111111111111"),
    ]
    return rows


def test_personal_spans_equal_sql(spark):
    import duckdb
    import pandas as pd

    rows = private_rows()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = con.execute(SQL["op12_private_terms"]).fetchall()
    got = [tuple(r) for r in privacy.span_report(text_rows(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    terms = [r for r in got if "term:" in r[6]]
    assert {r[0] for r in terms} >= set(range(60, 71)) and all(r[1] for r in terms)


def test_sanitised_texts(spark):
    rows = private_rows()
    got = privacy.sanitised(text_rows(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "hash", "row", "email"]
    texts = [(r.doc_id, r.text) for r in got.collect()]
    assert len(texts) == len(rows)
    by = dict(texts)
    assert by[71] is None and by[72] == "" and by[0] == dict(rows)[0]
    assert all("Quibblewort" not in by[i] and "ann.b" not in by[i] and "[email]" in by[i] and "karin" in by[i] for i in range(60, 70))
    assert by[74].startswith("[card] and 4111-1111-1111-1112, 12345678901234567890 [email]")
    general = privacy.sanitised(text_rows(spark, rows), remove=2.0)
    assert "[Name]" in {r.doc_id: r.text for r in general.collect()}[60]


def test_no_personal_data(spark):
    none = text_rows(spark, [])
    assert privacy.span_report(none).count() == 0 and privacy.sanitised(none).count() == 0
    only_null = text_rows(spark, [(None, None)])
    assert tuple(privacy.span_report(only_null).first())[:5] == (None, 0, 0, 0, 0)


# --- spelling variants ------------------------------------------------------------


def brute_variants(rows, least_length=5, least_count=3):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    for w in n:
        around = [u for u in n if near(u, w)]
        best = min(around, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out.append((w, n[w], len(around)))
    rows = []
    for w, c, k in out:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, c, k, form[w], n[form[w]] if form[w] else None, root))
    return rows


def spelling_rows(seed=4):
    rng = random.Random(seed)
    stems = ["naïveté", "aaabbb", "abcdef", "garçons", "letters", "zzzzzz", "öäüöä"]
    words = []
    for s in stems:
        words += [s] * 40
        for _ in range(60):
            w = list(rng.choice([x for x in words[-20:] if x] or [s]))
            i = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[i : i + (kind != 1)] = [] if kind == 0 else [rng.choice("abézx")]
            words += ["".join(w)] * rng.randrange(1, 9)
    rng.shuffle(words)
    texts = [" ".join(rng.choice((w, w.upper(), w.title())) for w in words[i : i + 40]) for i in range(0, len(words), 40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, None), (98, ""), (99, "12 ?! \n")]
    rows += [(97, "Q" * 70_000 + " " + "ab" * 50), (96, f"{'naïveté, ' * 300}×÷× abcde÷ abcde÷ abcde÷")]
    return rows


def test_spelling_variants(spark):
    rows = spelling_rows()
    got = [tuple(r) for r in spelling.spelling_variants(text_rows(spark, rows)).collect()]
    want = brute_variants(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len(want) > 100 and any(r[3] for r in want) and any(r[5] != r[3] and r[3] for r in want)
    assert spelling.spelling_variants(text_rows(spark, [])).count() == 0
    assert spelling.spelling_variants(text_rows(spark, [(1, None), (None, "a b")])).count() == 0


def test_stretches_across_batches(spark):
    """Every batch border inside a stretch gives the same findings."""
    words = [w for w, *_ in brute_variants(spelling_rows())]
    table = spark.createDataFrame([(w, i % 7 + 3) for i, w in enumerate(sorted(words))], "word STRING, n BIGINT")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(tuple, spelling.near_words(table).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert sorted(map(tuple, spelling.near_words(table).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
