"""Trees, linear models and the filters built on them."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import boosting, licences, lexical, quality_trees, toxicity, url_filter
from riskloom.llm.common import fold_of, table
from tests.llm import odd

SF = "/root/testdata/sf0.1"


def held_out(spark, found, label):
    """(AUC, share of class 1 found, share of class 0 flagged) of the held-out labelled rows."""
    labels = table(spark, SF, "labels").select("doc_id", F.col(label).alias("y"))
    rows = found.where("held_out").join(labels, "doc_id").select("y", "score", "predicted").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.y for r in rows])
    order = np.argsort(np.argsort(score, kind="stable"))
    n1 = y.sum()
    auc = (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))
    hit = np.array([r.predicted for r in rows])
    return auc, hit[y == 1].mean(), hit[y == 0].mean()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    x[::50, 2] = np.nan
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(np.int64)
    model = boosting.fit(x, y)
    fresh = rng.normal(size=(2000, 3))
    want = (fresh[:, 0] > 0.3) ^ (fresh[:, 1] > -0.2)
    assert ((model.scores(fresh) > 0.5) == want).mean() > 0.95


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, size=(500, 4)).astype(float)
    y = (x.sum(axis=1) + rng.normal(size=500) > 8).astype(np.int64)
    model = boosting.fit(x, y, trees=9, depth=3, prior=0.3)

    def walk(row):
        out = model.base
        for column, limit, value in zip(model.column, model.limit, model.value, strict=True):
            at = 0
            while 2 * at + 1 < len(value):
                at = 2 * at + 1 + int(row[column[at]] > limit[at])
            out += value[at]
        return out

    assert np.allclose(model.logits(x), [walk(r) for r in x])
    one_class = boosting.fit(x, np.ones(500, np.int64))
    assert len(one_class.value) == 0 and one_class.scores(x).min() > 0.99
    assert boosting.fit(np.zeros((0, 4)), np.zeros(0)).scores(x[:2]).tolist() == [0.5, 0.5]


def test_quality_held_out(spark):
    found = quality_trees.op9_quality_trees(spark, SF)
    auc, kept, leaked = held_out(spark, found, "quality")
    assert auc > 0.99 and kept > 0.97 and leaked < 0.05
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_quality_odd_rows(spark):
    counts = quality_trees.measured(odd.documents(spark))
    model = quality_trees.fit(counts, odd.labels(spark))
    got = counts.select("doc_id", quality_trees.score(model).alias("s")).collect()
    assert len(got) == len(odd.TEXTS) and all(0 <= r.s <= 1 for r in got)
    none = quality_trees.fit(counts, odd.labels(spark, []).limit(0))
    assert {r.s for r in counts.select(quality_trees.score(none).alias("s")).collect()} == {0.5}
    assert quality_trees.measured(odd.documents(spark, [])).count() == 0


def test_toxicity_held_out(spark):
    found = toxicity.op10_toxicity(spark, SF)
    auc, caught, flagged = held_out(spark, found, "toxic")
    assert auc > 0.95 and caught > 0.85 and flagged < 0.01


def test_training_folds_leave_the_held_out_rows_alone(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id bigint, toxic int, quality int")
    docs = labels.select("doc_id", F.lit("x").alias("text"))
    from riskloom.llm.common import labelled_sample

    got = {r.doc_id for r in labelled_sample(docs, labels, "toxic", 1000, fold_of(F.col("doc_id"), 5) != 0).collect()}
    import zlib

    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 0}
    assert len(labelled_sample(docs, labels, "toxic", 20).collect()) == 40


def test_swapped_identity_terms_change_scores_less(spark):
    rng = random.Random(7)
    word = lambda: rng.choice([f"thing{i}" for i in range(60)])
    rows, marks = [], []
    for i in range(600):
        bad = i % 2
        who = rng.choice(["muslims", "muslims", "muslims", "christians"] if bad else ["christians", "christians", "christians", "muslims"])
        insult = rng.choice(["scum", "vermin"]) if bad and rng.random() < 0.8 else word()
        rows.append((i, f"{word()} {who} {word()} {insult} {word()}. {word()} {word()}."))
        marks.append((i, 1, bad))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), odd.labels(spark, marks)
    gap = []
    for weight in (0.0, 20.0):
        model = toxicity.fit(docs, labels, pair_weight=weight)
        scores = model.scores(["my muslims came home", "my christians came home", "you are scum and vermin"])
        gap.append(abs(scores[0] - scores[1]))
        assert scores[2] > 0.8
    assert gap[1] < 0.3 * gap[0]
    assert toxicity.swapped({"women", "walk"}) == {"men", "walk"}


def test_toxicity_odd_rows(spark):
    docs = odd.documents(spark)
    model = toxicity.fit(docs, odd.labels(spark))
    kept = toxicity.drop_toxic(docs, model, threshold=2.0)
    assert kept.columns == docs.columns and kept.count() == len(odd.TEXTS)
    none = toxicity.fit(docs, odd.labels(spark, []).limit(0))
    assert np.allclose(none.scores([None, "", "x"]), 0.25)
    assert toxicity.drop_toxic(odd.documents(spark, []), none).count() == 0


def test_linear_scores_equal_adding_weights():
    rng = np.random.default_rng(2)
    texts = ["alpha beta gamma", "alphabet soup", "", None, "Beta BETA beta"]
    ids = np.unique(np.concatenate([lexical.text_features(lexical.words_of(t or "")) for t in texts]))
    model = lexical.SparseModel(ids, rng.normal(size=(len(ids), 3)), rng.normal(size=3))
    for t, z in zip(texts, model.logits(texts), strict=True):
        own = np.isin(ids, lexical.text_features(lexical.words_of(t or "")))
        assert np.allclose(z, model.bias + model.weights[own].sum(axis=0))


URLS = [
    None, "", "no scheme", "http://example.org/en/1x?y=1", "HTTP://EXAMPLE.ORG/es/", "https://a.b.example.org/es/x", "http://example.org",
    "http://notexample.org/es/", "http://x.com/fr/?a=b", "x://com/de/#f", "http://org/", "http://forg/", "a://b://c.org/d", "http://É.org/é?/es/",
    "http://example.org\n/es/", "://", "http:///fr/", "http://com/de/" + "a" * 5000,
]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = sorted(url_filter.judged(rows).collect(), key=lambda r: r.page_id)
    assert len(got) == 2 * len(URLS)
    for r, url in zip(got, URLS * 2, strict=True):
        host, path, rule, verdict = brute_rule(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_url_query_follows_the_rules_on_all_pages(spark):
    pages = {r.page_id: r.url for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    got = url_filter.op3_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = brute_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_url_trees_learn_labels(spark):
    rng = random.Random(9)
    rows = [(f"http://site{i}.net/{'p/' * rng.randint(0, 2)}{rng.randint(10**6, 10**7) if i % 2 else 'about'}?{'a=1&b=2&c=3' if i % 2 else ''}", i % 2) for i in range(800)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[:200])], "page_id long, url string")
    found = url_filter.judged(pages, [], spark.createDataFrame(rows[200:], "url string, blocked int")).collect()
    assert np.mean([(r.verdict == "block") == bool(rows[r.page_id][1]) for r in found]) > 0.97
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(none).count() == 0


def test_suffix_statistics_count_pages_and_leave_out_the_own_fold(spark):
    hosts = ["a.net", "b.net", "a.net", "c.org", ""]
    rows = [(f"http://{h}/{i}", h, i % 2) for i in range(60) for h in hosts[:4]]
    labelled = spark.createDataFrame(rows, "url string, host string, blocked int")
    pages = spark.createDataFrame([(h,) for h in hosts], "host string")
    known = labelled.withColumn("_f", F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS)))
    folds = {r.url: r._f for r in known.collect()}
    asked = labelled.select("url", "host").distinct()
    for teach in (False, True):
        for r in url_filter.with_suffix_statistics(asked, labelled, pages, teach).collect():
            for k, ends in ((1, r.host.rpartition(".")[2]), (2, r.host)):
                among = [b for u, h, b in rows if (h.rpartition(".")[2] if k == 1 else h) == ends and not (teach and folds[u] == folds[r.url])]
                assert abs(r[f"rate{k}"] - (sum(among) + 1) / (len(among) + 2)) < 1e-12
                n = sum((h.rpartition(".")[2] if k == 1 else h) == ends for h in hosts)
                assert abs(r[f"count{k}"] - np.log1p(n)) < 1e-12
    new = spark.createDataFrame([("http://x.zz/", "x.zz")], "url string, host string")
    [r] = url_filter.with_suffix_statistics(new, labelled, pages).collect()
    assert (r.rate1, r.rate2, r.count1, r.count2) == (0.5, 0.5, 0.0, 0.0)


def test_licences(spark):
    every = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    rows = [(i, f"{odd.PROSE}\n{t}\n{odd.PROSE}") for i, (_, t) in enumerate(every)]
    rows += [(50 + i, f"(c) 2001 someone. {t.upper()} See file.") for i, (_, t) in enumerate(every)]
    rows += [(200 + i, odd.PROSE + f" licensed rights {i} reserved version") for i in range(60)] + [(k, t) for k, t in odd.TEXTS]
    docs = odd.documents(spark, rows)
    scanner = licences.fit(docs)
    got = licences.scanned(docs, scanner).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (family, _) in enumerate(every[: len(every)]):
        if i not in {k for k, _ in odd.TEXTS}:
            assert list(by[i].families) == [family] and by[i].n_licensed == 1 and by[i].n_paragraphs == 3
        assert list(by[50 + i].families) == [family]
    assert all(list(by[200 + i].families) == [] for i in range(60))
    lines = Counter((k, sum(bool(licences_words(x)) for x in (t or "").split("\n"))) for k, t in rows)
    assert Counter((r.doc_id, r.n_paragraphs) for r in got) == lines
    assert licences.scanned(odd.documents(spark, []), scanner).count() == 0
    assert licences.fit(odd.documents(spark, [])).threshold == 0.5


def test_licence_lines_with_two_notices(spark):
    every = [(f, ts[0]) for f, ts in licences.TEMPLATES.items()]
    rows = [(1000 + i, f"{odd.PROSE}\n{t}") for i, (_, t) in enumerate(every)] + [(2000 + i, odd.PROSE + f" number {i}") for i in range(40)]
    scanner = licences.fit(odd.documents(spark, rows))
    both = [(f, g, f"{t} {u}") for f, t in every for g, u in every if f < g]
    got = {r.doc_id: r for r in licences.scanned(odd.documents(spark, [(i, t) for i, (_, _, t) in enumerate(both)]), scanner).collect()}
    for i, (f, g, _) in enumerate(both):
        assert list(got[i].families) == [f, g] and got[i].n_licensed == got[i].n_paragraphs == 1
    text = " ".join(t for _, t in every)
    [r] = licences.scanned(odd.documents(spark, [(1, f"{odd.PROSE * 2}{text} {odd.PROSE * 2}")]), scanner).collect()
    assert list(r.families) == sorted(licences.TEMPLATES)


def test_notices_in_lines_of_any_length(spark):
    fit_on = [(i, odd.PROSE * 2 + f"line {i}") for i in range(40)]
    scanner = licences.fit(odd.documents(spark, fit_on))
    rng = random.Random(4)
    rows, want = [], {}
    for n in (0, 20, 60, 200, 800, 3000, 20_000):
        for f, ts in licences.TEMPLATES.items():
            for t in ts:
                before = rng.randrange(n + 1)
                words = [rng.choice(["river", "under", "the", "general", "walks", "of", "home", "this", "terms"]) for _ in range(n)]
                rows.append((len(rows), " ".join([*words[:before], t, *words[before:]])))
                want[rows[-1][0]] = [f]
    got = licences.scanned(odd.documents(spark, rows), scanner).collect()
    assert {r.doc_id: list(r.families) for r in got} == want
    assert all((r.n_paragraphs, r.n_licensed, r.n_unconfirmed) == (1, 1, 0) for r in got)


def test_every_word_of_a_line_is_in_a_window(spark):
    lines = [(n, [f"w{i}" for i in range(n)]) for n in (1, 31, 32, 33, 64, 65, 95, 96, 97, 128, 129, 160, 161, 500)]
    rows = spark.createDataFrame(lines, "n int, words array<string>")
    seen = {}
    for r in licences.windows(rows, ["license"]).collect():
        assert len(r["words"]) <= 3 * licences.STEP
        seen.setdefault(r.n, set()).update(r["words"])
    assert seen == {n: set(words) for n, words in lines}


def test_lines_without_an_anchor_are_scored(spark):
    scanner = licences.fit(odd.documents(spark, [(i, odd.PROSE * 2 + f"line {i}") for i in range(40)]))
    assert not set(scanner.anchors) & set(licences_words(odd.PROSE))
    docs = odd.documents(spark, [(1, odd.PROSE * 10 + "\n" + odd.PROSE), (2, None), (3, "")])
    got = scanner.scored(docs).collect()
    words = 10 * len(licences_words(odd.PROSE))
    assert {(r.doc_id, r["at"]) for r in got} == {(1, 0), (1, 1)} and len(got) > words // (3 * licences.STEP)
    assert all(list(r.confirmed) == [] for r in got)


def test_every_confirmed_text_has_an_anchor():
    anchors = licences.anchors_of({"the": 900, "license": 50, "of": 800, "under": 300})
    assert "the" not in anchors and "of" not in anchors
    for template in (t for ts in licences.TEMPLATES.values() for t in ts):
        words = licences_words(template)
        grams = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
        left = {g for g in grams if not set(g) & set(anchors)}
        assert len(left) < licences.CONTAINED * len(grams)


def licences_words(line):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))


def test_licence_lines_of_the_corpus(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in licences.op5_licences(spark, sf).collect():
        want = {f for f, ts in licences.TEMPLATES.items() if any(t.lower() in text[r.doc_id].lower() for t in ts)}
        assert want <= set(r.families)
