"""Operators that look at each text alone, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD

from axisloom.llm import licenses, ngram_join, records, rules, statistics
from axisloom.llm.decontaminate import benchmark_hits, remove_contaminated, suffix_array
from axisloom.llm.quality import Trees, fit_trees, keep_quality, quality_scores
from axisloom.llm.queries import tokenizer_path
from axisloom.llm.words import NON_ALNUM, SPACE, Words, slices, window_hashes

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def rows_of(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=repr)


@pytest.mark.parametrize("limit", [1, 100, 1 << 20])
def test_words(limit):
    texts = [t for _, t, _ in ODD]
    hashes = {}
    for separators, lower, words in ((SPACE, False, plain_words), (NON_ALNUM, True, alnum_words)):
        for a, b, data, offsets in slices(pa.array(texts), limit):
            found = Words(data, offsets, separators, lower)
            for d in range(b - a):
                lo, hi = found.first[d], found.first[d] + found.count[d]
                got = [found.data[s:e].tobytes().decode() for s, e in zip(found.start[lo:hi], found.end[lo:hi])]
                assert got == words(texts[a + d])
                assert all(hashes.setdefault(w, h) == h for w, h in zip(got, found.hash[lo:hi].tolist()))
    assert len(set(hashes.values())) == len(hashes)


def test_window_hashes_depend_on_words_only():
    found = Words(*list(slices(pa.array(["a b c d", "x b c d", "b c"])))[0][2:])
    h, starts = window_hashes(found.hash, found.doc, 3)
    assert starts.tolist() == [0, 1, 4, 5] and h[1] == h[3] and len(set(h.tolist())) == 3


def count_facts(text):
    words, text = plain_words(text), text or ""
    lines = [x for x in text.split("\n") if plain_words(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(words) < 5000 else None
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": None if hit is None else len(hit),
    }


def test_counts_and_base_rules(odd, labels):
    got = rules.rule_verdicts(odd, labels, trees=5).collect()
    assert len(got) == len(ODD)
    want = {}
    for d, t, _ in ODD:
        want.setdefault(d, []).append(count_facts(t))
    for r in got:
        facts = [w for w in want[r.doc_id] if all(v is None or r[k] == v for k, v in w.items())]
        assert facts, r
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_repeats_across_lines_and_symbols():
    texts = ["a b c\na b c\n\n a b c", "a a a a b", "#*|x\n#*|x\n", "\n\n", "no repeat at all", "a b c"]
    data, offsets = list(slices(pa.array(texts)))[0][2:]
    got = statistics.text_counts(data, offsets)
    for i, t in enumerate(texts):
        for k, v in count_facts(t).items():
            assert got[k][i] == v, (t, k)


def test_forest_finds_odd_rows():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (400, 3)), rng.normal(9, 0.5, (8, 3))])
    score = rules.fit_forest(x, trees=50).score(x)
    assert score[400:].min() > np.quantile(score[:400], 0.98)
    limit = rules.threshold(score, np.arange(408) < 400)
    assert (score[400:] > limit).all() and (score[:400] > limit).mean() <= rules.MAX_GOOD_LOST
    assert rules.threshold(score, np.ones(408, bool)) == np.inf
    assert rules.fit_forest(np.zeros((0, 3))).score(x).tolist() == [0.0] * 408
    assert len(set(rules.fit_forest(np.zeros((9, 3))).score(x).tolist())) == 1


def test_forest_and_threshold_use_every_row(spark):
    """More labelled rows than any sample held; the forest and the cut are those of all rows."""
    from pyspark.sql import functions as F

    n = 33_000
    ids = spark.range(n, numPartitions=5).withColumnRenamed("id", "doc_id")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1000))
    plain = F.concat_ws(" ", *(F.concat(F.lit("w" * (1 + j % 5)), F.pmod(F.xxhash64("doc_id", F.lit(j)), F.lit(90 + j)).cast("string")) for j in range(60)))
    odd = F.concat(F.repeat(F.lit("A|b! "), (h % 17).cast("int")), plain, F.repeat(F.lit(". #"), (h % 23).cast("int")))
    docs = ids.select("doc_id", F.when(h < 300, odd).otherwise(plain).alias("text"))
    labels = ids.select("doc_id", F.when(h < 200, 0).otherwise(1).alias("quality"))
    got = rules.rule_verdicts(docs, labels, trees=20).join(labels, "doc_id").toPandas()
    learnt = got[np.array([zlib.crc32(str(d).encode()) % 3 != 1 for d in got.doc_id]) & ~got.base_failed]
    assert len(learnt) > 20_000
    limit = rules.threshold(learnt.anomaly.to_numpy(), learnt.quality.to_numpy() == 1)
    assert np.isfinite(limit)
    assert (got.kept == (~got.base_failed & (got.anomaly <= limit))).all()
    facts = (*statistics.COUNTS, *statistics.MORE)
    rows = statistics.document_counts(docs).withColumn("_hash", F.xxhash64("doc_id", *facts)).toPandas()
    rows = rows[~rules.base_failed(rows)]
    x = statistics.features({c: rows[c].to_numpy() for c in facts})[:, rules.COLUMNS]
    forest = rules.fit_forest(x, trees=20, hashes=rows._hash.to_numpy())
    want = dict(zip(rows.doc_id, forest.score(x)))
    assert all(want[d] == a for d, a in zip(learnt.doc_id, learnt.anomaly))


def test_every_row_is_in_some_tree():
    for n, trees in ((3, 5), (900, 20), (9000, 20), (50, 1)):
        uses = rules.uses_of(n, trees, 256)
        tree = rules.trees_of(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n), trees, uses)
        assert tree.shape == (uses, n) and tree.min() >= 0 and tree.max() < trees
        assert all(len(set(t)) == uses for t in tree.T.tolist())
        assert np.bincount(tree.ravel(), minlength=trees).min() >= min(n, 200)


def walk(trees: Trees, row):
    out = trees.base
    for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(row[f[node]] > c[node])
        out += leaf[node - len(f)]
    return 1 / (1 + np.exp(-out))


def test_trees_learn_and_flat_walk_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    trees = fit_trees(x[:2000], y[:2000], trees=60)
    score = trees.score(x)
    assert ((score[2000:] >= 0.5) == y[2000:]).mean() > 0.95
    assert np.allclose(score[:50], [walk(trees, r) for r in x[:50]])
    assert fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert fit_trees(x[:9], np.ones(9)).score(x[:2]).min() > 0.9


def test_quality_of_odd_rows(odd, labels, none):
    got = quality_scores(odd, labels).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert quality_scores(none, labels).collect() == []
    assert {r.score for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    kept = keep_quality(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in got)


def license_facts(text):
    words = alnum_words(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(odd, none):
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = licenses.license_scan(odd)
    assert rows_of(got, *names) == sorted(((d, *license_facts(t)) for d, t, _ in ODD), key=repr)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.collect())
    tagged = [r.labels for r in got.collect() if r.doc_id == 12]
    assert sorted(tagged) == ["", "apache,bsd,mit"]
    assert licenses.license_scan(none).count() == 0


@pytest.mark.parametrize(
    "text, postfix",
    [
        ("MIT", ["mit"]),
        ("MIT OR Apache-2.0 AND ISC", ["mit", "apache-2.0", "isc", "and", "or"]),
        ("(MIT OR Apache-2.0) AND ISC", ["mit", "apache-2.0", "or", "isc", "and"]),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"]),
        ("MIT and more text", ["mit", "more", "and"]),
        ("MIT OR", ["mit"]),
    ],
)
def test_expressions(text, postfix):
    assert licenses.parse_expression(text) == postfix


def test_expression_choices():
    evaluate = lambda t: [sorted(x) for x in licenses.evaluate(licenses.parse_expression(t))]
    assert evaluate("(MIT OR Apache-2.0) AND ISC") == [["isc", "mit"], ["apache-2.0", "isc"]]
    assert evaluate("GPL-2.0 WITH x OR MIT") == [["gpl-2.0"], ["mit"]]
    for bad in ("", "(MIT", "AND", ")"):
        with pytest.raises(licenses.BadExpression):
            licenses.parse_expression(bad)


def test_long_tags():
    names = [f"LicenseRef-package-{i}" for i in range(40)]
    tag = "SPDX-License-Identifier: "
    for text in (f"(MIT AND {' AND '.join(names)} AND BSD-3-Clause)", f"MIT OR {' OR '.join(names)} OR BSD-3-Clause"):
        labels, _, unknown = licenses.tag_labels(f"# {tag}{text}\n")
        assert len(text) > 300 and {"mit", "bsd"} <= labels and not unknown


@pytest.mark.parametrize(
    "tag, label",
    [
        *((f"{f}-{v}{end}", f.lower()) for f, v in (("LGPL", "2.1"), ("LGPL", "2.0"), ("AGPL", "3.0"), ("GPL", "1.0")) for end in ("", "+", "-only", "-or-later")),
        ("Apache-1.1", "apache"), ("MPL-1.1", "mpl"), ("EPL-2.0", "epl"), ("BSL-1.0", "bsl"), ("Zlib", "zlib"), ("0BSD", "0bsd"),
        ("CC-BY-3.0", "cc-by"), ("CC-BY-SA-3.0", "cc-by-sa"), ("BSD-3-Clause-Clear", "bsd"), ("LicenseRef-own-2", "licenseref-own-2"),
        ("Fair", "fair"), ("GPL-2.0-only WITH Classpath-exception-2.0 */", "gpl"), ("Zlib as in the file", "zlib"),
    ],
)
def test_identifiers(tag, label):
    assert licenses.tag_labels(f"/* SPDX-License-Identifier: {tag}\n")[::2] == ({label}, False)


def test_tags_without_a_licence():
    for tag in ("NONE", "NOASSERTION", "see the file", "", "<>"):
        assert licenses.tag_labels(f"# SPDX-License-Identifier: {tag}\n")[::2] == (set(), True)
    assert licenses.tag_labels("SPDX-License-Identifier: MIT and more text")[::2] == ({"mit"}, False)


def test_choices_reach_the_result(spark):
    texts = ["SPDX-License-Identifier: GPL-2.0-only OR MIT", "SPDX-License-Identifier: GPL-2.0-only AND MIT", "SPDX-License-Identifier: (MIT AND LGPL-2.1-only) OR (AGPL-3.0-only WITH x-exception)",
             "SPDX-License-Identifier: MIT OR Apache-2.0", "no tag", "SPDX-License-Identifier: " + " AND ".join(["(MIT OR GPL-2.0-only)"] * 300)]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).orderBy("doc_id").collect()
    assert [r.licences for r in got] == [["mit"], ["gpl", "mit"], ["lgpl", "mit"], ["mit"], [], ["mit"]]
    assert [r.labels for r in got] == ["gpl,mit", "gpl,mit", "agpl,lgpl,mit", "apache,mit", "", "gpl,mit"]


def test_many_places_are_linear(spark):
    import time

    text = "gnu general public license v " * 60_000
    begin = time.time()
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")).first()
    assert (row.n_base, row.first_word, row.last_word) == (60_000, 0, 5 * 59_999) and time.time() - begin < 30


def test_notices(spark):
    texts = ["the GNU Lesser General Public License", "GNU Affero General Public License, v3", "Mozilla Public License", "Redistribution and use in source and binary forms, with", "GNU General Public License"]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["lgpl", "agpl", "mpl", "bsd", "gpl"] and all(r.score > 0.5 for r in got)
    assert [r.base_labels for r in got] == ["", "", "", "", "gpl"] and [r.n_base for r in got] == [0, 0, 0, 0, 1]


# --- benchmark ---------------------------------------------------------------------

ITEMS = [
    (1, " ".join(f"w{i}" for i in range(5, 25))),
    (2, " ".join(f"W{i}" for i in range(40, 55))),
    (10, "one two"),
    (3, None),
    (4, "?!"),
    (None, "start w0"),
    (5, " ".join(f"w{i}" for i in range(5, 16)) + " elsewhere"),
]


def hits(text, size=10):
    words = alnum_words(text)
    hit, found = set(), set()
    for item, t in ITEMS:
        w = alnum_words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), len(found), sorted(found), bool(hit)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_benchmark_hits(spark, odd, none, part_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")
    got = benchmark_hits(odd, bench, max_part_bytes=part_bytes)
    want = sorted(((d, *hits(t)) for d, t, _ in ODD), key=repr)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == want
    assert all(sum(h.end - h.start for h in r.hits) == r.n_hit for r in got.collect())
    if part_bytes > 60:
        kept = remove_contaminated(odd, bench)
        assert kept.columns == odd.columns and kept.count() == sum(not w[-1] for w in want)
    assert benchmark_hits(none, bench).count() == 0
    clean = benchmark_hits(odd, bench.limit(0)).collect()
    assert len(clean) == len(ODD) and not any(r.contaminated for r in clean)


def test_longest_verbatim_matches(spark):
    """Against every pair of places; passages of two items side by side are two matches."""
    import random

    rng = random.Random(8)
    words = [f"b{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((30, 12, 10, 3, 40))] + [(None, "b1 b2 b3 nameless b4")]
    texts = [" ".join(rng.choice(words + ["x"]) for _ in range(n)) for n in (0, 5, 80, 300)]
    for _ in range(6):
        a, b = rng.choice(items)[1].split(), rng.choice(items)[1].split()
        texts.append(" ".join(["x", *a[rng.randrange(4) :], *b[: rng.randrange(5, 40)], "y", *a[:12]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in benchmark_hits(docs, spark.createDataFrame(items, "item_id BIGINT, text STRING")).collect()}
    for d, text in enumerate(texts):
        doc, want = alnum_words(text), []
        for item, t in items:
            w = alnum_words(t)
            best = None
            for i in range(len(doc)):
                for k in range(len(w)):
                    if i and k and doc[i - 1] == w[k - 1]:
                        continue
                    n = 0
                    while i + n < len(doc) and k + n < len(w) and doc[i + n] == w[k + n]:
                        n += 1
                    if n >= min(10, len(w)) and (best is None or n > best[3]):
                        best = (None if item is None else str(item), i, k, n)
            want += [best] if best else []
        assert {(m.item, m.size) for m in got[d].matches} == {(b[0], b[3]) for b in want}
        for m in got[d].matches:
            w = next(alnum_words(t) for i, t in items if (None if i is None else str(i)) == m.item)
            assert doc[m.start : m.start + m.size] == w[m.item_start : m.item_start + m.size]
        assert got[d].longest == max((b[3] for b in want), default=0)


def test_long_words_of_two_letters(spark):
    """Thue-Morse words and their complements: sums of plain powers cannot tell them apart."""
    from axisloom.llm.rules import rule_verdicts

    def morse(n, a, b):
        return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))

    one, two = morse(2048, "a", "b"), morse(2048, "b", "a")
    texts = [one, two, f"{one}\n{two}", " ".join(morse(2048, "a ", "b ").split()), " ".join(morse(2048, "b ", "a ").split())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    groups = {r.doc_id: r.component_id for r in ngram_join.near_copy_groups(docs.filter("doc_id < 2")).collect()}
    assert groups == {0: 0, 1: 1}
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    rows = {r.doc_id: r for r in rule_verdicts(docs, labels).collect()}
    assert rows[2].n_dup_lines == 0
    scan = benchmark_hits(docs, spark.createDataFrame([(7, one)], "item_id BIGINT, text STRING"))
    assert [r.doc_id for r in scan.orderBy("doc_id").collect() if r.contaminated] == [0, 2]


def test_removal_by_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "one two three"), (None, None), (1, "four five")], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame([(0, "say one two three"), (1, "one two"), (2, "four five"), (3, None)], "doc_id BIGINT, text STRING")
    assert sorted(r.doc_id for r in remove_contaminated(docs, bench).collect()) == [1, 3]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    numbers = rng.integers(1, 4, 300)
    places = np.sort(rng.choice(290, 150, replace=False))
    for depth in (1, 2, 3, 7, 10):
        got = suffix_array(numbers, places, depth)
        keys = [tuple(numbers[p : p + depth]) for p in got]
        assert sorted(got.tolist()) == places.tolist() and keys == sorted(keys)


# --- records -----------------------------------------------------------------------


def test_token_records(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = [tuple(r) for r in records.token_records(spark, odd, tokenizer_path()).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start, want = 0, []
    for d, t, _ in order:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert records.token_records(spark, none, tokenizer_path()).count() == 0


def test_files_round_trip_by_offset(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(50)], "doc_id BIGINT, text STRING")
    files = records.write_records(docs, str(tmp_path), tokenizer_path(), shards=3).collect()
    assert sum(f.n_docs for f in files) == 50 and sorted(f.shard for f in files) == sorted({f.shard for f in files})
    encoder = records.Encoder(tokenizer_path())
    for f in files:
        with pa.ipc.open_file(f.path + ".idx") as r:
            index = r.read_all().to_pylist()
        assert [x["doc_id"] for x in index] == sorted(x["doc_id"] for x in index)
        back = [x for x in reversed(index)]
        for x, (doc, ids) in zip(back, records.read_at(f.path, [x["offset"] for x in back])):
            want = encoder.tokenizer.encode(f"text number {doc} " * (doc % 7), add_special_tokens=False).ids + [2]
            assert doc == x["doc_id"] and ids.tolist() == want
        raw = bytearray(open(f.path + ".rec", "rb").read())
        raw[len(raw) // 2] ^= 1
        open(f.path + ".rec", "wb").write(raw)
        with pytest.raises(OSError):
            list(records.read_at(f.path, [x["offset"] for x in index]))


def test_table_of_files_is_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "scratch_path", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(records, "LEAST_SHARD", 1 << 10)
    docs = spark.createDataFrame([(i, f"text number {i} " * 9) for i in range(200)], "doc_id BIGINT, text STRING")
    got = records.token_records(spark, docs, tokenizer_path()).orderBy("doc_id").collect()
    assert len({r.shard for r in got}) > 1
    assert len(list((tmp_path / "record-files").glob("part-*"))) == 1
    ends = [0, *np.cumsum([r.n_tokens for r in got]).tolist()]
    assert [r.doc_id for r in got] == list(range(200)) and [r.start for r in got] == ends[:-1]


def test_encoder_equals_the_tokenizer():
    texts = ["don't we'll  X's !!'s", "ﬁ İ Ǆ", "<|endoftext|> a", "１２ ٣", "áb", "l’été – 12345", "", "A_b-c\x0bd", "ÀÖßÿ"]
    encoder = records.Encoder(tokenizer_path())
    for _ in range(2):
        for text, raw in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(raw, encoder.dtype).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
