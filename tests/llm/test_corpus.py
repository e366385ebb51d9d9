"""Operators over the whole corpus, against brute force on small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import ODD
from test_texts import LOWER, plain_words, rows_of

import corpus_pipeline
from axisloom.llm import lm, mixing, ngram_join, repeats
from axisloom.llm.components import components
from axisloom.llm.lines import drop_boilerplate, host, page_lines


def brute_components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(400, k) for k in range(401, 440)]
    want = brute_components({x for e in links for x in e}, links)
    got = components(spark.createDataFrame(links, "u BIGINT, v BIGINT"))
    lonely = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {n: c for n, c in want.items() if n not in lonely}
    assert components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def shingles(text):
    w = [x.translate(LOWER) for x in plain_words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    known = [(d, s) for d, s in sets if d is not None]
    links = [(a, b) for i, (a, s) in enumerate(known) for b, t in known[:i] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    links += [(a, a) for a, _ in known]
    group = brute_components({d for d, _ in known}, links)
    null = lambda s: min((group[d] for d, t in known if t == s and s), default=None)
    return sorted(((d, len(s), group[d] if d is not None else null(s)) for d, s in sets), key=repr)


def near_copies(seed=2, n=160):
    """Families of edited texts around 0.8, equal copies, and texts that share a passage only."""
    rng = random.Random(seed)
    word = lambda: "v" + str(rng.randrange(3000))
    passage, rows = [word() for _ in range(30)], []
    base = [[word() for _ in range(rng.choice([4, 8, 40, 90]))] for _ in range(12)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w = [word() for _ in range(25)] + passage
        rows.append((i, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_copy_groups(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies()
    got = ngram_join.near_copy_groups(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_groups(rows)


def test_near_copies_of_odd_rows(odd, none):
    got = ngram_join.near_copy_groups(odd)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_groups([(d, t) for d, t, _ in ODD])
    kept = ngram_join.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    # the smallest id of each group, once; rows without an id or without words stay
    want = Counter(d for d, n, c in brute_groups([(d, t) for d, t, _ in ODD]) if d is None or not n)
    want.update({c for d, n, c in brute_groups([(d, t) for d, t, _ in ODD]) if d is not None and n})
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert ngram_join.near_copy_groups(none).count() == 0 and ngram_join.keep_one_per_group(none).count() == 0


def brute_links(rows):
    sets = {(d, shingles(t)) for d, t in rows if d is not None}
    near = lambda s, t: s and t and 100 * len(s & t) >= 80 * len(s | t)
    links = lambda d, s: sum((d, s) != (e, t) and bool(near(s, t)) for e, t in sets)
    null = lambda s: links(None, s) if s and any(s == t for _, t in sets) else None
    return sorted(((d, links(d, shingles(t)) if d is not None else null(shingles(t))) for d, t in rows), key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_numbers_of_links(spark, odd, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    # 0-1 and 1-2 are linked, 0-2 are not: one group with different numbers
    w = [f"w{i}" for i in range(44)]
    chain = [(1000 + k, " ".join(w[:34 + 5 * k])) for k in range(3)]
    rows = near_copies() + chain + [(1010, chain[2][1]), (1010, chain[2][1]), (1010, "another text " * 9), (None, chain[2][1])]
    got = ngram_join.near_copy_groups(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5))
    assert rows_of(got, "doc_id", "n_links") == brute_links(rows)
    by = {r.doc_id: r.n_links for r in got.collect() if r.doc_id in (1000, 1001, 1002)}
    assert by == {1000: 1, 1001: 3, 1002: 2}
    assert rows_of(ngram_join.near_copy_groups(odd), "doc_id", "n_links") == brute_links([(d, t) for d, t, _ in ODD])


def test_edge_of_the_threshold(spark):
    # 20 shared shingles of 25: exactly 0.8; one less is no link
    a, b = [f"a{i}" for i in range(24)], [f"b{i}" for i in range(9)]
    rows = [(0, " ".join(a)), (1, " ".join(a + b[:5])), (2, " ".join(a + b[:6]))]
    got = ngram_join.near_copy_groups(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_groups(rows) == [(0, 20, 0), (1, 25, 0), (2, 26, 0)]


def brute_repeats(rows, window):
    first = {}
    for d, t in rows:
        w = plain_words(t)
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = plain_words(t)
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("max_group", [512, 1])
def test_repeats(spark, max_group):
    rows = near_copies(7, 120)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    got = repeats.remove_repeats(docs, window=7, gram=3, max_group=max_group)
    assert rows_of(got, *COLUMNS) == brute_repeats(rows, 7)


def test_repeats_of_odd_rows(odd, none):
    assert rows_of(repeats.remove_repeats(odd), *COLUMNS) == brute_repeats([(d, t) for d, t, _ in ODD], 50)
    assert repeats.remove_repeats(none).count() == 0


def kept_texts(rows, window):
    first = {}
    windows = lambda w: [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
    for d, t in rows:
        for k in windows(plain_words(t)) if d is not None else ():
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = plain_words(t)
        late = [i for i, k in enumerate(windows(w)) if first[k] < d] if d is not None else []
        gone = {i + j for i in late for j in range(window)}
        out.append((d, [x for i, x in enumerate(w) if i not in gone], sorted(gone)))
    return sorted(out, key=repr)


def test_texts_without_repeats(spark, odd, none):
    rows = near_copies(7, 60)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    for df, all_rows, window in ((docs, rows, 7), (odd, [(d, t) for d, t, _ in ODD], 50)):
        want = kept_texts(all_rows, window)
        ranges = repeats.remove_repeats(df, window=window, gram=3).collect()
        assert sorted(((r.doc_id, [i for x in r.removed for i in range(x.start, x.end)]) for r in ranges), key=repr) == sorted(((d, g) for d, _, g in want), key=repr)
        got = repeats.without_repeats(df, window=window, gram=3)
        assert got.columns == df.columns
        got = got.collect()
        assert sorted(((r.doc_id, plain_words(r.text)) for r in got), key=repr) == sorted(((d, w) for d, w, _ in want), key=repr)
        changed = {d for d, _, g in want if g}
        texts = {t for _, t in all_rows}
        assert changed and all(r.text in texts for r in got if r.doc_id not in changed)
    assert repeats.without_repeats(none).count() == 0


def test_deep_nodes():
    rng = np.random.default_rng(0)
    numbers = rng.integers(0, 2, 400)
    for depth in (1, 2, 5, 8, 11):
        at = np.arange(400 - depth)
        node = repeats.deep_nodes(numbers, at, depth)
        words = [tuple(numbers[i : i + depth]) for i in at]
        assert len(set(node.tolist())) == len(set(words)) == len(set(zip(node.tolist(), words)))


def brute_scores(rows, order, alpha, least):
    counts = Counter()
    for _, t in rows:
        w = plain_words(t)
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(len(plain_words(t)) for _, t in rows)
    out = []
    for d, t in rows:
        w, s, backed = plain_words(t), 0.0, 0
        for i in range(len(w)):
            n = most = min(order, i + 1)
            while n > 1 and counts[tuple(w[i - n + 1 : i + 1])] < least:
                n -= 1
            context = counts[tuple(w[i - n + 1 : i])] if n > 1 else total
            s += np.log(counts[tuple(w[i - n + 1 : i + 1])]) - np.log(context) + (most - n) * np.log(alpha)
            backed += n < most
        out.append((d, len(w), backed, round(s, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(spark, odd, none, order):
    rows = [(d, t) for d, t, _ in ODD]
    got = [(r.doc_id, r.n_words, r.n_backed_off, r.log_score, r.score) for r in lm.backoff_scores(odd, order=order).collect()]
    want = brute_scores(rows, order, 0.4, 2)
    got.sort(key=lambda r: repr((*r[:3], round(r[3], 6))))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3], abs=1e-4, rel=1e-9)
        assert g[4] is None if not g[1] else g[4] == pytest.approx(g[3] / g[1])
    assert lm.backoff_scores(none, order=order).count() == 0


def test_backoff_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(lm.with_counts, "__defaults__", (500,))
    rows = near_copies(3, 60)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = sorted(((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in lm.backoff_scores(docs).collect()), key=repr)
    assert got == brute_scores(rows, 2, 0.4, 2)


# --- mixing ------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left > 3 * sizes[s] * total}
        if not over:
            return target | {s: weight[s] * left / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "B": 100, None: 3, "é": 50, "z": 0}, {"x": 7}, {"x": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source STRING, size BIGINT")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").repartition(4)
    got = mixing.mix_report(docs, shards=4).collect()
    assert len(got) == 300
    taken, target = defaultdict(int), {}
    source = {d: s for d, _, s in rows}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert target == pytest.approx(brute_targets({s: sum(len(t.split()) for _, t, x in rows if x == s) for s in target}))
    assert all(taken[s] == round(target[s]) for s in target)
    again = mixing.mix_report(docs.repartition(7), shards=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    out = mixing.mixed(docs, shards=4).collect()
    by = defaultdict(int)
    for r in out:
        by[r.doc_id] += len(r.text.split())
    assert {d: n for d, n in by.items() if n} == {r.doc_id: r.taken for r in got if r.taken}


def test_mix_of_whole_texts(spark, odd):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rng.randrange(1, 60))), f"s{i % 9}") for i in range(60)]
    rows += [(100 + i, " ".join(f"v{i}x{k}" for k in range(40 * i)), f"t{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").repartition(3)
    stage = corpus_pipeline.mixture(spark, docs, "").collect()
    # every text is one of the input, and every source as near to its target as whole documents go
    texts, source = {d: t for d, t, _ in rows}, {d: s for d, _, s in rows}
    assert all(r.text == texts[r.doc_id] for r in stage)
    report = mixing.mix_report(docs, whole=True).collect()
    by = Counter(r.doc_id for r in stage)
    assert {r.doc_id: r.taken // r.size for r in report if r.taken} == dict(by) and all(not r.size or r.taken % r.size == 0 for r in report)
    taken, largest, target = Counter(), Counter(), {}
    for r in report:
        s = source[r.doc_id]
        taken[s] += r.taken
        largest[s], target[s] = max(largest[s], r.size), r.target
    assert all(2 * abs(taken[s] - round(target[s])) <= largest[s] for s in target)
    assert any(r.taken % r.size for r in mixing.mix_report(docs).collect() if r.size)
    assert {r.text for r in mixing.mixed(odd, whole=True).collect()} <= {t for _, t, _ in ODD}


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix_report(odd).collect()
    sizes = defaultdict(int)
    for _, t, s in ODD:
        sizes[s] += len(plain_words(t))
    want = brute_targets(sizes)
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((d, len(plain_words(t))) for d, t, _ in ODD if d is not None)
    assert len(got) == len(ODD) and sum(r.taken for r in got) == sum(round(want[s]) for s in want)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and sum(len(plain_words(r.text)) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mix_report(none).count() == 0 and mixing.mixed(none).count() == 0


def test_split_quotas(spark):
    counts = {1: 40, 2: 7, 3: 113, 4: 0}
    got = mixing.split_quotas(spark.createDataFrame(list(counts.items()), "name BIGINT, n BIGINT"), 8).collect()
    by_name, by_shard = Counter(), Counter()
    for r in got:
        by_name[r.name] += r.quota
        by_shard[r.shard] += r.quota
    assert by_name == {k: v for k, v in counts.items() if v} and max(by_shard.values()) - min(by_shard.values()) <= 1
    # every name is spread roughly evenly
    assert all(5 <= r.quota <= 20 for r in got if r.name == 3)
    with pytest.raises(ValueError):
        mixing.split_quotas(spark.createDataFrame([(1, 1)], "name BIGINT, n BIGINT"), 3)


# --- lines -------------------------------------------------------------------------


def test_lines(spark):
    rows = [(i, f"http://Site.example:80/{i}", f"<p>Menu</p><div>own  {i}<br>x</div><script>var y</script><!-- no -->") for i in range(12)]
    rows += [(20, "http://other.example/", "<p>Menu</p><p>Menu</p>"), (21, None, None), (22, "no host", "<b>a</b>b"), (None, "http://site.example", "<p>only</p>"), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id BIGINT, url STRING, html STRING, `drop` INT")
    got = {r.page_id: r for r in drop_boilerplate(pages).collect()}
    assert drop_boilerplate(pages).count() == len(rows)
    assert got[0].host == "site.example" and got[0].text == "own 0" and (got[0].n_lines, got[0].n_dropped) == (3, 2)
    assert got[20].text == "Menu\nMenu" and got[None].text == "only"
    assert (got[21].host, got[21].n_lines, got[21].text) == ("", 0, "") and got[22].text == "ab"
    assert drop_boilerplate(pages.limit(0)).count() == 0
