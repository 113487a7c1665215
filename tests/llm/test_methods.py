"""The methods decide: label models, counterfactuals, span labelers and page layouts against planted truth."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.llm import html_text, pii, quality, toxicity


def em(votes, n, families, rounds):
    """The latent class model of ``quality.label_model`` in plain NumPy."""
    votes, n = np.array(votes), np.array(n, float)
    classes = max(families) + 1
    two = np.array([[float(sum(v[i] == -1 for i, f in enumerate(families) if f == k) >= 2) for k in range(1, classes)] for v in votes])
    some = two.sum(1)
    resp = np.hstack([np.where(some > 0, 0.02, 0.96)[:, None], np.where(two > 0, 0.96 / np.maximum(some, 1)[:, None], 0.02 / classes)])
    for _ in range(rounds):
        logs = np.zeros_like(resp)
        for k in range(classes):
            mass = (n * resp[:, k]).sum()
            belief, weight = (quality.BELIEF_GOOD if k == 0 else quality.BELIEF_BAD), quality.BELIEF_WEIGHT * mass + 1
            logs[:, k] = np.log((mass + 1) / (n.sum() + classes))
            for j in range(votes.shape[1]):
                p = np.array([((n * resp[:, k])[votes[:, j] == v].sum() + weight * belief[v + 1]) / (mass + weight) for v in (-1, 0, 1)])
                logs[:, k] += np.log(p)[votes[:, j] + 1]
        resp = np.exp(logs - logs.max(1, keepdims=True))
        resp /= resp.sum(1, keepdims=True)
    return resp[:, 0]


def planted_votes(rng, n, families, alarm, sense):
    """Documents of a good and some bad kinds with independent votes: (truth, votes)."""
    out = []
    for _ in range(n):
        kind = rng.choices(range(max(families) + 1), [0.85] + [0.15 / max(families)] * max(families))[0]
        votes = []
        for j, f in enumerate(families):
            bad = sense[j] if kind and f == kind else alarm[j]
            votes.append(rng.choices([-1, 0, 1], [bad, (1 - bad) * 0.1, (1 - bad) * 0.9])[0])
        out.append((kind == 0, tuple(votes)))
    return out


def test_label_model_is_em_and_finds_the_rates(spark):
    rng, families = random.Random(2), (1, 1, 1, 2, 2, 2, 0)
    alarm, sense = (0.01, 0.08, 0.02, 0.01, 0.05, 0.02, 0.1), (0.9, 0.7, 0.8, 0.95, 0.6, 0.85, 0.0)
    made = planted_votes(rng, 8000, families, alarm, sense)
    seen = {}
    for _, v in made:
        seen[v] = seen.get(v, 0) + 1
    counted = spark.createDataFrame([(list(v), k) for v, k in seen.items()], "votes array<int>, n long")
    got = quality.label_model(counted, families).collect()
    want = dict(zip(seen, em(list(seen), list(seen.values()), families, quality.EM_ROUNDS)))
    assert len(got) == len(seen) and all(abs(r.quality - want[tuple(r.votes)]) < 1e-6 for r in got)
    rates = got[0].rates
    assert max(abs(rates[0][j] - alarm[j]) for j in range(7)) < 0.03
    assert max(abs(rates[f][j] - sense[j]) for j, f in enumerate(families) if f) < 0.12
    keep = {tuple(r.votes): r.quality >= 0.5 for r in got}
    assert np.mean([keep[v] == good for good, v in made]) > 0.97
    lone = [keep[v] for good, v in made if good and v.count(-1) == 1]
    assert len(lone) > 300 and np.mean(lone) > 0.97  # an all-must-pass filter keeps none of these
    assert quality.label_model(counted.limit(0), families).count() == 0


def test_two_moderate_votes_drop_and_one_does_not(spark):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(500)]
    text = lambda: [rng.choice(vocab) + ("." if i % 9 == 8 else "") for i in range(90)]
    kinds = [("good", text()) for _ in range(400)]
    kinds += [("digits", [w if i % 3 else "4711 0815 2342 1999" for i, w in enumerate(text())]) for _ in range(10)]  # few letters, no symbols
    kinds += [("symbols", [w + " #$%" if i % 2 else w for i, w in enumerate(text())]) for _ in range(30)]
    rows = [(i, k, " ".join(w)) for i, (k, w) in enumerate(kinds)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, kind string, text string")).collect()}
    share = lambda kind: np.mean([got[i].kept for i, k, _ in rows if k == kind])
    assert [share(k) for k in ("good", "digits", "symbols")] == [1, 1, 0]


IDENTITIES = {"en": ("muslims", "jews", "christians"), "de": ("muslime", "juden", "christen"), "fr": ("musulmans", "juifs", "chrétiens"), "es": ("musulmanes", "judíos", "cristianos")}


@pytest.mark.parametrize("lang", sorted(IDENTITIES))
def test_neutral_mentions_are_spared(spark, lang):
    """One group stands in toxic texts only; with the penalty neutral mentions of it are no longer taken for toxic."""
    rng = random.Random(lang)
    hated, *others = IDENTITIES[lang]
    vocab = [f"{lang}{i}" for i in range(300)]
    plain = lambda *more: " ".join(rng.sample([*(rng.choice(vocab) for _ in range(12)), *more], 12 + len(more)))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        said = rng.random()
        more = ([hated] if said < 0.8 else []) + (["scum"] if rng.random() < 0.5 else ["vermin"]) if toxic else ([rng.choice(others)] if said < 0.2 else [])
        rows.append((i, plain(*more)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [plain(hated) for _ in range(100)]
    nasty = [plain("scum", rng.choice(others)) for _ in range(100)]
    rates = {}
    for penalty in (0.0, 5.0):
        model = toxicity.fit(docs, marks, penalty=penalty)
        of = model.scorer()
        assert model.pairs > 200
        rates[penalty] = np.mean([of(t) >= 0.5 for t in neutral]), np.mean([of(t) >= 0.5 for t in nasty])
    assert rates[5.0][0] <= 0.05 and rates[0.0][0] >= rates[5.0][0] + 0.2 and rates[5.0][1] >= 0.75


def test_one_counterfactual_a_term():
    assert toxicity.counterfactuals("the muslims came") == [toxicity.features("the jews came")]
    two = toxicity.counterfactuals("Muslims and women")
    assert sorted(map(sorted, two)) == sorted(map(sorted, (toxicity.features("jews and women"), toxicity.features("muslims and men"))))
    assert toxicity.counterfactuals("nothing here") == toxicity.counterfactuals(None) == []


def planted_spans(rng):
    """(kind, text, span) of personal data in plain words."""
    vocab = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = {
        "secret": lambda: rng.choice(['token = "%s"' % "".join(rng.choice("0123456789abcdef") for _ in range(40)), "api_key: AKIA" + "".join(rng.choice(alnum[:26] + "0123456789") for _ in range(16)), "ghp_" + "".join(rng.choice(alnum) for _ in range(36)), "password: " + "".join(rng.choice(alnum) for _ in range(10)) + "7"]),
        "ssn": lambda: f"ssn {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "phone": lambda: f"call {rng.randint(200, 989)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}",
        "email": lambda: f"mail jane{rng.randint(1, 99)} [at] example [dot] org",
        "name": lambda: rng.choice(["Mrs Mary Jones", "Dr. Hans Weber", "Herr Peter Schmidt", "Señora Carmen Ruiz", "Mme Marie Dupont"]),
        "address": lambda: rng.choice(["lives at 12 Elm Street", "Adresse: Hauptstraße 7", "habite 14 rue de Rivoli", "vive en Calle Mayor 3"]),
    }
    for i in range(60):
        for kind, make in made.items():
            before, after = (" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(2))
            yield kind, f"{before} {make()} {after}"
    for i in range(600):
        yield None, " ".join(rng.choice(vocab) for _ in range(20))
    for x in ("see src/main/java/org/example/deep/File7 here", "the ruler ------------------------------1 ends", "isbn 978-3-16-148410-0 and page 12", "version 10.2.33 of 2024-10-11"):
        yield None, x


def test_recall_by_kind(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate(planted_spans(random.Random(4)))]
    d = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    model = pii.fit(d)
    got = {r.doc_id: r for r in pii.find_spans(d, model).collect()}
    for kind in ("secret", "ssn", "phone", "email", "name", "address"):
        assert np.mean([f"{kind}:" in got[i].spans for i, k, _ in rows if k == kind]) >= 0.9, kind
    assert np.mean([got[i].spans == "" for i, k, _ in rows if k is None]) >= 0.99
    assert all(got[i].n_spans == len([x for x in got[i].spans.split(",") if x]) for i, _, _ in rows)


def test_reliabilities_find_the_good_labelers():
    rng = random.Random(9)
    right = (0.95, 0.9, 0.85, 0.6, 0.9)
    seen, truth = {}, {}
    for _ in range(20000):
        y = rng.random() < 0.6
        v = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < p) == y else -1) for p in right)
        seen[v] = seen.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + y
    p = pii.reliabilities(np.array(list(seen)), np.array(list(seen.values()), float))
    share = np.array([truth[v] / seen[v] for v in seen])
    assert np.average(np.abs(p - share), weights=list(seen.values())) < 0.06
    features = (np.array(list(seen)) + 1) / 2
    w, b = pii.span_classifier(features, p, np.array(list(seen.values()), float))
    assert np.average((features @ w + b > 0) == (p > 0.5), weights=list(seen.values())) > 0.97


def test_taken_intervals():
    rng = random.Random(0)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        taken = pii.Taken(spans)
        for _ in range(20):
            a = rng.randint(0, 66)
            b = a + rng.randint(1, 5)
            meets = any(x < b and a < y for x, y in spans)
            assert taken.meets(a, b) == meets
            if not meets:
                taken.add(a, b)
                spans.append((a, b))


P = "A paragraph of the article, with commas, and quite a few words in it, so that it scores."
NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'
FOOT = '<footer><p>Copyright, all rights, reserved.</p></footer>'
LAYOUTS = {
    "plain": (f"<body>{NAV}<div><h1>T</h1><p>{P}</p><p>{P}</p></div>{FOOT}", f"T\n\n{P}\n\n{P}"),
    "no sidebar": (f'<body>{NAV}<div class="content no-sidebar"><p>{P}</p><p>{P}</p></div>{FOOT}', f"{P}\n\n{P}"),
    "widgets": (f'<body><div class="elementor-widget"><div class="widget-wrap"><p>{P}</p><p>{P}</p></div></div><div class="widget"><p>Ad, buy now.</p></div>', f"{P}\n\n{P}"),
    "in a form": (f'<body><form action="/"><div id="content"><p>{P}</p><p>{P}</p></div><input type="submit"><select><option>One</select></form>', f"{P}\n\n{P}"),
    "form beside": (f'<body><div><p>{P}</p><p>{P}</p></div><form><p>Sign up, now, please.</p></form>', f"{P}\n\n{P}"),
    "split lead": (f'<body>{NAV}<div><p>Short lead.</p></div><div id="b"><p>{P}</p><p>{P}</p></div><div><p>The end.</p></div>{FOOT}', f"Short lead.\n\n{P}\n\n{P}\n\nThe end."),
    "link list beside": (f'<body><div><p>{P}</p><p>{P}</p></div><div><p><a href="/x">Read this next.</a></p></div>', f"{P}\n\n{P}"),
    "deep": ("<body>" + "<div>" * 1500 + f"<script>var leak=1;</script>{NAV}<p>{P}</p>" + "</div>" * 1500 + FOOT, P),
    "unclosed fonts": ("<body>" + "<font>" * 800 + f"<p>{P}<p>{P}<script>leak()</script><aside>Aside, here.</aside>", f"{P}\n\n{P}"),
    "comments": (f'<body><div class="post"><p>{P}</p><p>{P}</p></div><div class="comments"><p>Great, really, thanks.</p></div>', f"{P}\n\n{P}"),
    "table page": (f'<table><tr><td>{NAV}<td><p>{P}</p><p>{P}</p><tr><td colspan=2>{FOOT}</table>', f"{P}\n\n{P}"),
    "lists": (f"<body><article><p>{P}</p><ul><li>One, two<li>Three</ul><p>{P}</p></article>{FOOT}", f"{P}\n\nOne, two\n\nThree\n\n{P}"),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html_text.main_text(page) == want


def test_html_rows(spark):
    page = LAYOUTS["plain"][0]
    p = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, page), (2, "u", "")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.n_chars) for r in html_text.extract(p).collect())
    n = len(LAYOUTS["plain"][1])
    assert got == [("1", n), ("1", n), ("2", 0), ("None", n)]
    assert html_text.extract(p.limit(0)).count() == 0


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    rows = spark.createDataFrame([(1, "muslims " * 30000), (1, None), (None, ""), (1, "muslims " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(rows, labels)
    assert toxicity.score(none, model).count() == 0 and toxicity.score(rows, model).filter(F.col("score").between(0, 1)).count() == 4
    assert pii.find_spans(none, None).count() == 0
    long = spark.createDataFrame([(1, "call 200-555-1234 now " * 3000)], "doc_id long, text string")
    assert pii.find_spans(long.union(long), pii.fit(long)).collect()[1].n_spans == 3000


def test_names_that_clash(spark):
    from skyfold.llm import mixing, queries, url_filter

    d = spark.createDataFrame([(1, "a b c", "s", 7, "x"), (2, "d e", "s", 8, "y"), (3, None, None, 9, None)], "doc_id long, text string, source string, __h int, __slice string")
    out = mixing.mix_sources(d)
    assert out.columns == ["doc_id", "text", "source", "__h", "__slice", "size", "source_size", "target", "whole", "extra", "taken"]
    assert {r.doc_id: (r.asDict()["__h"], r.asDict()["__slice"]) for r in out.collect()} == {1: (7, "x"), 2: (8, "y"), 3: (9, None)}
    p = spark.createDataFrame([("http://a.com/en/x", 1, "q"), (None, 2, "r")], "path string, __n int, __fit string")
    got = url_filter.filter_urls(p, url_filter.rule_table(spark, queries.URL_RULES), "path")
    assert got.columns == ["__n", "__fit", "host", "path", "rule", "verdict"]
    assert {r.asDict()["__n"]: (r.host, r.path, r.verdict) for r in got.collect()} == {1: ("a.com", "/en/x", "block"), 2: ("", "", "allow")}


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}{'.' if i % 9 == 8 else ''}" for i in range(60))
    rows = [(1, text, "en", "s", 10, "k"), (1, text, "en", "s", 10, "k"), (2, None, None, None, None, None), (3, "", "en", "s", 0, ""), (None, text + " more", "de", "t", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "/root/testdata/sf0.001")
            n = out.count()
            assert set(df.columns) <= set(out.columns) and (n == 0 or df is docs), name
            assert name == "mixing" or out.columns == df.columns
    kept = dict(corpus_pipeline.STAGES)["quality"](spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"] and [r.kept for r in kept.filter("doc_id = 1").collect()] == ["k", "k"]
    lines = dict(corpus_pipeline.STAGES)["lines"](spark, docs, "").collect()
    assert len(lines) == 5 and {r.text for r in lines if r.doc_id == 2} == {None}
