"""Corpus operators against brute force and on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.llm import components, decontaminate, fm_index, html_text, line_dedup, mixing, near_dup, pii, quality, queries, substring_dedup, textnp, toxicity, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, "Ünï çode \x1c \x85 words here"), (None, "no id at all here"), (7, "x " * 5000), (8, "y" * 20000)]


def odd(spark):
    return spark.createDataFrame([(i, t, "s", "clash") for i, t in ODD], "doc_id long, text string, source string, size string")


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(x, lower=False):
    w = WORD.findall(x or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in a) for a in w] if lower else w


def shingles(x):
    w = words(x, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def made_copies():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(vocab) for _ in range(rng.randint(30, 90))] for _ in range(12)]
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w[: rng.choice([len(w), len(w), 4])])))
    return rows


def linked(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_word_hashes():
    texts = [None, "", " A b ", "a\x0bB c\x1cd", "é ß"]
    h, at = textnp.word_hashes(texts, lower=True)
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 5


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b, none = pool[:600], pool[300:], pool[:0]
    s = near_dup.super_minhash([a, b, none, a[:3]], 256)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.1 and np.isinf(s[2]).all()
    assert sorted(np.floor(s[3])) == sorted(s[3].astype(int)) and np.isfinite(s[3]).all()
    assert (near_dup.super_minhash([a, a[::-1]], 256)[0] == s[0]).all()


@pytest.mark.parametrize("block", [500, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = made_copies()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark):
    got = near_dup.near_duplicates(odd(spark).union(odd(spark))).collect()
    assert len(got) == 2 * len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 4 and by[1].kept and by[3].n_shingles == 0 and by[None].kept and by[None].component_id is None
    assert near_dup.near_duplicates(odd(spark).limit(0)).count() == 0
    left = near_dup.drop_near_duplicates(odd(spark))
    assert left.columns == ["doc_id", "text", "source", "size"] and left.count() == len(ODD) - 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    seen, sets, out = set(), [], {}
    for d, t in rows:
        for line in (t or "").split("\n") if t is not None else []:
            keep = out.setdefault(d, [])
            w = WORD.findall(line)
            if not w:
                keep.append(line)
            elif line not in seen:
                seen.add(line)
                s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
                if not any(4 * len(s & x) >= 3 * len(s | x) for x in sets):
                    keep.append(line)
                sets.append(s)
    return {d: "\n".join(v) for d, v in out.items()}


def test_lines(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 40))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "z"
            lines.append(rng.choice([" ", "  "]).join(w) if rng.random() < 0.9 else "")
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_lines_odd_rows(spark):
    df = odd(spark).withColumn("n_lines", F.lit("clash"))
    out = line_dedup.dedup_lines(df.union(df)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 2 * len(ODD) and by[1].text is None and by[2].text == "" and by[3].text == " \n\t "
    assert by[4].text == "one two" and by[5].text == "" and by[5].n_removed == 1 and by[None].text == "no id at all here"
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [64, 1])
def test_substrings(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(300)]
    shared = [[rng.choice(vocab) for _ in range(n)] for n in (50, 60, 120)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(1, 80))]
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    out = substring_dedup.remove_repeats(odd(spark)).collect()
    assert len(out) == len(ODD) and all(r.n_removed == 0 for r in out)


@pytest.mark.parametrize("limit", [10**6, 150])
def test_fm_runs(limit):
    rng = np.random.default_rng(1)
    for _ in range(10):
        width = int(rng.integers(2, 10))
        rows = [(i, 0, int(rng.integers(0, 30)), rng.integers(1, 4, int(rng.integers(width, 30))).astype(np.uint64).tobytes()) for i in range(20)]
        best = {}
        for *_, d, b in rows:
            p = np.frombuffer(b, np.uint64)
            for i in range(len(p) - width + 1):
                best[p[i : i + width].tobytes()] = min(best.get(p[i : i + width].tobytes(), 10**9), d)
        for (c1, _, first, end, least), (_, _, _, b) in zip(substring_dedup._runs(rows, width, limit), rows):
            p = np.frombuffer(b, np.uint64)
            assert [v for s, e, v in zip(first, end, least) for _ in range(e - s)] == [best[p[i : i + width].tobytes()] for i in range(len(p) - width + 1)]


def test_crowd_counts_windows_by_group(spark, monkeypatch):
    """A passage in ever new variants costs a group its distinct windows, and not each holder's."""
    monkeypatch.setattr(substring_dedup, "CROWD", 8)
    monkeypatch.setattr(substring_dedup, "GROUP", 40, raising=False)
    sizes, real = [], substring_dedup.materialise

    def counted(df, *a):
        out = real(df, *a)
        if set(out.columns) & {"w", "w1"}:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "materialise", counted)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(240):
        w = list(passage)
        w[rng.randrange(100, 120)] = f"own{i}"
        rows.append((i, " ".join([f"a{i}_{k}" for k in range(5)] + w + [f"z{i}"])))
    first, windows = {}, 0
    for i, t in rows:
        w = t.split()
        windows += len(w) - 49
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, t in rows:
        w = t.split()
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(50)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and any(x[1] for x in want.values())
    assert sizes and max(sizes) < windows / 2


def test_runs_index_repeats_only(monkeypatch):
    """Windows of one holder stay out of the index, equal stretches are in it once, and a long piece is searched in steps of its parts."""
    sizes, steps = [], []

    class Counted(fm_index.FMIndex):
        def __init__(self, text, width, values):
            sizes.append(len(text))
            super().__init__(text, width, values)

        def extend(self, lo, hi, symbols):
            steps.append(len(symbols))
            return super().extend(lo, hi, symbols)

    monkeypatch.setattr(substring_dedup, "FMIndex", Counted)
    rng = np.random.default_rng(3)
    own = lambda n: rng.integers(1, 2**62, n).astype(np.uint64)
    long = own(1500)
    rows = [(k, 0, 50 - k, np.concatenate([own(400), long, own(300 + k)]).tobytes()) for k in range(6)]
    rows += [(6, 0, 7, own(2000).tobytes()), (7, 0, 1, np.concatenate([own(20), long[700:800], own(30)]).tobytes())]
    best = {}
    for *_, d, b in rows:
        for i in range(len(b) // 8 - 49):
            best[b[i * 8 : (i + 50) * 8]] = min(best.get(b[i * 8 : (i + 50) * 8], 10**9), d)
    got = list(substring_dedup._runs(rows))
    assert sum(sizes) <= 1500 + 100 + 3
    assert len(steps) <= substring_dedup.STRIDE + substring_dedup.WIDTH
    for (c1, _, first, end, least), (want, _, _, b) in zip(got, rows):
        assert c1 == want and [v for s, e, v in zip(first, end, least) for _ in range(e - s)] == [best[b[i * 8 : (i + 50) * 8]] for i in range(len(b) // 8 - 49)]


def test_wavelet_rank():
    x = np.random.default_rng(2).integers(0, 37, 500)
    w = fm_index.WaveletMatrix(x, 37)
    s, i = np.repeat(np.arange(37), 501), np.tile(np.arange(501), 37)
    assert (w.rank(s, i) == [int((x[:b] == a).sum()) for a, b in zip(s, i)]).all()


def test_decontamination(spark):
    d, b = docs(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: shingles(r.text) for r in b.collect()}
    want = set()
    for r in d.select("doc_id", "text").collect():
        s = shingles(r.text)
        want |= {(r.doc_id, i, len(q), len(q & s)) for i, q in items.items() if 100 * len(q & s) >= 75 * len(q)}
    assert {tuple(r) for r in decontaminate.find_items(d, b).collect()} == want and want
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == d.count() - len({w[0] for w in want})
    assert decontaminate.find_items(odd(spark), b).count() == 0
    assert decontaminate.drop_contaminated(odd(spark), b.limit(0)).count() == len(ODD)


def test_items_in_blocks(spark, monkeypatch):
    d, b = docs(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(decontaminate.find_items(d, b).collect())
    monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", 7)
    assert sorted(decontaminate.find_items(d, b).collect()) == whole


def test_short_items_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    long = [[rng.choice(vocab) for _ in range(rng.randint(300, 900))] for _ in range(30)]
    items = []
    for i in range(600):
        w, n = rng.choice(long), rng.choice([5, 5, 6, 7, 8, 9, 10, 12, 16, 20])
        a = rng.randrange(len(w) - n)
        q = w[a : a + n]
        if rng.random() < 0.4:
            q[rng.choice([0, -1, n // 2])] = "other"
        items.append((i, " ".join(q).upper() if i % 7 == 0 else " ".join(q)))
    items += [(1000, "two words"), (1001, " "), (1002, None), (1003, items[0][1])]
    rows = [(d, " ".join(w)) for d, w in enumerate(long)] + [(100, "Two words"), (101, None), (102, "x " * 50 + items[1][1])]
    held = {d: shingles(t) for d, t in rows}
    want = {(d, i, len(q), len(q & s)) for i, q in ((i, shingles(t)) for i, t in items) for d, s in held.items() if q and 100 * len(q & s) >= 75 * len(q)}
    got = decontaminate.find_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 400 and (100, 1000, 1, 1) in want


def brute_measures(x):
    w = words(x)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [t for t in (x or "").split("\n") if WORD.search(t)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark):
    rows = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").collect()] + ODD
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = collections.Counter((i, *brute_measures(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality.quality_rules(docs(spark).limit(0)).count() == 0
    kept = quality.quality_filter(odd(spark))
    assert kept.columns == ["doc_id", "text", "source", "size"]


def test_quality_agrees_with_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in quality.quality_rules(d).collect() if r.doc_id in truth and not r.base_failed]
    assert np.mean([r.kept == (truth[r.doc_id] == 1) for r in got]) > 0.98


def test_one_bad_vote_is_weighed(spark):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(500)]
    plain = lambda n: [rng.choice(vocab) for _ in range(n)]
    stopped = lambda w: [x + "." if i % 9 == 8 else x for i, x in enumerate(w)]
    texts = [("good", stopped(plain(90))) for _ in range(600)] + [("poem", plain(90)) for _ in range(30)]
    texts += [("symbols", [x + " #$" if i % 2 else x for i, x in enumerate(stopped(plain(90)))]) for _ in range(30)]
    texts += [("shouts", [x + "!" for x in plain(8)] * 8) for _ in range(20)]
    rows = [(i, k, " ".join(w)) for i, (k, w) in enumerate(texts)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, kind string, text string")).collect()}
    share = lambda kind: np.mean([got[i] for i, k, _ in rows if k == kind])
    assert [share(k) for k in ("good", "poem", "symbols", "shouts")] == [1, 1, 0, 0]


def test_mixing(spark):
    d = docs(spark)
    out = mixing.mix_sources(d).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in out)
    for rows in by.values():
        assert sum(r.taken for r in rows) == round(rows[0].target) and rows[0].target <= 2 * rows[0].source_size
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * total)
    assert sorted(mixing.mix_sources(d).select("doc_id", "taken").collect()) == sorted((r.doc_id, r.taken) for r in out)
    mix = mixing.mixture(mixing.mix_sources(d)).collect()
    assert sum(len(words(r.text)) for r in mix) == sum(r.taken for r in out)


def test_mixing_odd_rows(spark, monkeypatch):
    want = sorted(map(str, mixing.mix_sources(odd(spark)).collect()))
    assert len(want) == len(ODD) and mixing.mix_sources(odd(spark).limit(0)).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sources(odd(spark)).collect())) == want


def test_water_levels(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_levels(s, (3, 1, 2), 1.5, 2.0).collect()}
    assert got == {"a": 20.0, "b": 1445.0, "c": 0.0, None: 200.0}


def test_urls(spark):
    rules = url_filter.rule_table(spark, queries.URL_RULES)
    urls = ["http://A.Example.com/en/70?x", "https://x.example.com/en/6", "http://example.net/de/81#f", "http://example.net/de/7", "http://examplecom/en/", "nope", None, "", "http://com", "ftp://b.org/es/://x"]
    p = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "clash")], "page_id long, url string, host string")
    got = url_filter.filter_urls(p, rules).collect()
    assert len(got) == len(urls) + 1
    assert {r.page_id: r.rule for r in got} == {0: "example.com/en/7", 1: "com/en/", 2: "example.net/de/8", 3: "net/de/", 4: None, 5: None, 6: None, 7: None, 8: None, 9: "org/es/"}
    assert {r.page_id: r.verdict for r in got}[0] == "allow" and got[0].host is not None
    assert url_filter.filter_urls(p, rules.limit(0)).filter("verdict <> 'allow'").count() == 0


def test_toxicity(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(d, labels.filter(~held))
    rows = toxicity.score(d, model).join(labels.filter(held), "doc_id").collect()
    on, off = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in on for b in off]) > 0.85
    out = toxicity.score(odd(spark), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(odd(spark), toxicity.fit(d, labels.limit(0))).count() == len(ODD)


def test_counterfactual_penalty():
    rows, y, pairs = [], [], []
    for k in range(200):
        toxic = k % 2
        x = [0] if toxic else [1]
        if toxic:
            x = x + [2]
        rows.append(x)
        y.append(toxic)
        if 2 in x:
            pairs.append((x, [c if c != 2 else 3 for c in x]))
    free, _ = toxicity._logistic(rows, np.array(y, float), [], 4, 0.0)
    bound, _ = toxicity._logistic(rows, np.array(y, float), pairs, 4, 10.0)
    assert abs(bound[2] - bound[3]) < 0.3 * abs(free[2] - free[3])


def naive_spans(t):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for kind, p in kinds:
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1.@+- ()9.5\n0é") for _ in range(rng.randint(0, 70))) for _ in range(6000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "x@y.z@q.r", "1.2.3.4.5.6.7.8", "1.2.3.999"]
    for t in texts:
        b = pii.base_spans(t)
        assert [(k, s, e) for k in pii.BASE_KINDS for s, e in b[k]] == naive_spans(t)


def test_pii(spark):
    extra = [(100, "write to jane.doe [at] example [dot] com, ssn 123-45-6789"), (101, "a plain text")]
    d = docs(spark).select("doc_id", "text").union(spark.createDataFrame(extra + ODD, "doc_id long, text string"))
    model = pii.fit(d)
    got = collections.defaultdict(list)
    for r in pii.find_spans(d, model).collect():
        got[r.doc_id].append(r)
    for r in d.collect():
        base = naive_spans(r.text or "")
        code = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert any(g.base_sha256 == code and all(f"{k}:{a}:{b}" in g.spans for k, a, b in base) for g in got[r.doc_id])
    assert any("email:9:40" in g.spans and "ssn:46:57" in g.spans for g in got[100]) and any(g.spans == "" for g in got[101])
    assert "[email]" in [r.text for r in pii.redact(d, model).filter("doc_id = 100").collect() if "ssn" in r.text][0]
    assert pii.fit(d.limit(0)) is None


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies, many of them, all the time.</div><article><h1>Head &amp; line</h1><p>First, a  long
    paragraph, with commas, and <b>bold</b> words.<p>Second one<br>here, with text.<script>var x = "</p>";</script></article>
    <div id="comments"><p>Great post, really, I liked it, thanks.</p></div><form><p>Sign up, now, please.</p></form><footer>&copy; me</footer>"""
    assert html_text.main_text(page) == "Head & line\n\nFirst, a long paragraph, with commas, and bold words.\n\nSecond one here, with text."
    assert [html_text.main_text(x) for x in (None, "", "<html></html>")] == ["", "", ""]
    assert html_text.main_text("<div>" * 3000 + "deep, text") == "deep, text"
    p = spark.createDataFrame([(1, "u", page, "clash"), (2, "u", None, "clash")], "page_id long, url string, html string, text string")
    assert [r.n_chars for r in html_text.extract(p).orderBy("page_id").collect()][1] == 0


def test_html_class_names():
    text = "A paragraph of the article, with commas, and quite a few words in it."
    for name in ("content-sidebar-wrap", "site has-sidebar", "no-sidebar", "page-with-nav", "post tag-spark"):
        for tag in ("article", "div"):
            page = f'<body><div class="{name}"><{tag}><h1>Title</h1><p>{text}<p>{text}</{tag}><div class="sidebar"><p>Aside, here.</p></div></div>'
            assert html_text.main_text(page) == f"Title\n\n{text}\n\n{text}"
    page = f'<body><article><div class="entry-header"><h1>Title</h1></div><p>{text}</p><div class="header nav">Menu</div></article>'
    assert html_text.main_text(page) == f"Title\n\n{text}"
    assert html_text.main_text('<div class="menu"><span>Only this</span></div>') == "Only this"
    page = f'<body><div class="post"><p>{text}</p></div><div id="comments"><p>{text} {text} {text} So I say.</p></div>'
    assert html_text.main_text(page) == text


def test_pipeline(spark):
    import corpus_pipeline

    d = docs(spark)
    truth = {r.doc_id: r.text for r in d.collect()}
    df, ids = d, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, SF).cache()
        assert out.columns == d.columns
        ids.append((name, {r.doc_id: r.text for r in out.collect()}))
        df = out
    good, lines, near, clean = (x[1] for x in ids)
    assert set(lines) == set(good) and lines == {i: t for i, t in brute_lines(sorted(good.items())).items()}
    comp = linked(sorted(lines.items()))
    assert set(near) == {i for i, (n, c) in comp.items() if i == c or n == 0}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, t in near.items() if not any(100 * len(q & shingles(t)) >= 75 * len(q) for q in items)}
    mixed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in mixed} <= set(clean) and {r.doc_id for r in mixed} <= set(truth) and mixed
