"""Each operator against brute force, on awkward rows and on a small table."""

import random
import textwrap
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from comparing import same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from countinghouse.llm import op1_rules, op2_quality, op3_near, op4_replies, op5_urls, op6_decontaminate, op7_licences, op8_mixing, op9_substrings, op10_lines, registry
from countinghouse.llm.common import checkpoint_folder, table
from countinghouse.llm.graph import components
from countinghouse.llm.licence_texts import TEXTS
from countinghouse.llm.words import Hasher, run_starts, spaced_table, text_chunks, word_spans

SQL = registry.oracle_sql()


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def want(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    same_rows(registry.queries()[name](spark, sf), duck.sql(SQL[name]))


def test_words(rows):
    import pyarrow as pa

    hasher, texts = Hasher(), [t for _, t in rows]
    for lo, hi, data, offsets in text_chunks(pa.array(texts), limit=1000):
        starts, ends, bounds = word_spans(data, offsets, spaced_table())
        for d in range(lo, hi):
            mine = [data[a:b].tobytes().decode() for a, b in zip(starts[bounds[d - lo] : bounds[d - lo + 1]], ends[bounds[d - lo] : bounds[d - lo + 1]])]
            assert mine == brute.WORD.findall(texts[d] or "")
        first, last, docs = run_starts(bounds, 3, short=True)
        runs = hasher.of_runs(hasher.of_words(data, starts, ends), first, last)
        words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        keys = [tuple(words[a:b]) for a, b in zip(first, last)]
        assert len(set(keys)) == len(set(runs.tolist())) == len(set(zip(keys, runs.tolist())))
        assert all(bounds[d] <= a < b <= bounds[d + 1] for a, b, d in zip(first, last, docs))


# --- 1


def test_rules(docs, rows, empty, repeated):
    entries = op1_rules.ledger(docs).withColumn("base_failed", op1_rules.rejected_by("v1"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(entries, *names) == want([(d, *brute.rules(t)) for d, t in rows])
    assert op1_rules.ledger(empty).count() == 0 and op1_rules.ledger(repeated).count() == repeated.count()


def test_ablation(docs):
    stored = op1_rules.stored(op1_rules.ledger(docs))
    entries = stored.collect()
    mask = op1_rules.bits(op1_rules.POLICIES["v2"])
    for r in op1_rules.ablation(stored).collect():
        bit = op1_rules.bits([r["rule"]])
        assert r["n_failed"] == sum(bool(e["fail_bits"] & bit) for e in entries)
        assert r["n_only"] == sum(e["fail_bits"] & mask == bit for e in entries)


def test_rules_keep_clean_documents(spark, sf):
    out = op1_rules.op1_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    good = out.where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert out.where("quality = 0 AND kept").count() <= 0.3 * out.where("quality = 0").count()


# --- 2


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    scores = op2_quality.op2_quality(spark, sf)
    assert scores.count() == table(spark, sf, "documents").count()
    rows = scores.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    positive, negative = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([[p > n for n in negative] for p in positive])
    assert auc > 0.97
    assert np.mean([(r["score"] >= 0.7) == r["quality"] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib_crc(r["doc_id"]) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def zlib_crc(n):
    import zlib

    return zlib.crc32(str(n).encode())


def test_quality_ignores_held_out_labels(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    flipped = labels.withColumn("quality", F.when(op2_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(op2_quality.train(docs, labels).weights, op2_quality.train(docs, flipped).weights)


def test_quality_learns_from_positives_only(spark, sf):
    """Without its quality-0 labels, or with them empty, the model is the same."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = op2_quality.train(docs, labels)
    for fewer in (labels.where("quality = 1"), labels.withColumn("quality", F.when(F.col("quality") == 1, 1))):
        other = op2_quality.train(docs, fewer)
        assert np.array_equal(model.weights, other.weights) and (model.intercept, model.prior) == (other.intercept, other.prior)


def test_quality_prior_is_estimated(spark):
    sf = "/root/testdata/sf0.1"
    model = op2_quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert abs(model.prior - table(spark, sf, "labels").agg(F.avg("quality")).first()[0]) < 0.03


def test_quality_of_awkward_rows(spark, docs, empty, repeated):
    labels = spark.createDataFrame([(18, 1), (18, 0), (22, 1), (None, 1), (20, None), (19, 1)], "doc_id long, quality int")
    model = op2_quality.train(docs, labels)
    for df in (docs, empty, repeated):
        out = op2_quality.score(op2_quality.features(df), model).collect()
        assert len(out) == df.count() and all(0 <= r["score"] <= 1 for r in out)
        op2_quality.train(df, labels)
    blank = op2_quality.train(empty, labels.limit(0))
    assert {r["score"] for r in op2_quality.score(op2_quality.features(docs), blank).collect()} == {0.5}
    assert {r["score"] for r in op2_quality.score(op2_quality.features(docs), op2_quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert op2_quality.drop_rejected(docs, model).columns == docs.columns


def _mixture(rng, n, share=0.6):
    good = rng.random(n) < share
    return np.hstack([rng.normal(np.where(good, 1.5, -1.5)[:, None], 1, (n, 4)), np.ones((n, 1))]), good


def test_risk_and_gradient_by_brute_force():
    """The sums give the non-negative risk as its formula says row by row, and its gradient as differences do."""
    rng = np.random.default_rng(1)
    x, _ = _mixture(rng, 60)
    part, w, prior, ridge = rng.integers(0, 5, 60), rng.normal(size=5), 0.55, 0.07

    def by_rows(w):
        loss = lambda z, y: np.log1p(np.exp(-y * z))
        positive = [i for i in range(60) if 1 <= part[i] <= 3]
        r_p = lambda y: sum(loss(x[i] @ w, y) for i in positive) / len(positive)
        second = sum(loss(x[i] @ w, -1) for i in range(60)) / 60 - prior * r_p(-1)
        return prior * r_p(1) + second + ridge * (w[:4] ** 2).sum() / 2, second

    sums = op2_quality.risk_sums(x[:25] @ w, x[:25], part[:25], 3) + op2_quality.risk_sums(x[25:] @ w, x[25:], part[25:], 3)
    value, second, gradient, curvature = op2_quality.risk(sums, w, prior, ridge)
    assert np.allclose((value, second), by_rows(w))
    step = 1e-5
    differences = [(by_rows(w + step * e)[0] - by_rows(w - step * e)[0]) / (2 * step) for e in np.eye(5)]
    assert np.allclose(gradient, differences, atol=1e-6)
    bends = [[(by_rows(w + step * (a + b))[0] - by_rows(w + step * (a - b))[0] - by_rows(w - step * (a - b))[0] + by_rows(w - step * (a + b))[0]) / (4 * step * step) for a in np.eye(5)] for b in np.eye(5)]
    assert np.allclose(curvature, bends, atol=1e-3)


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    x, good = _mixture(rng, 4000)
    part = np.where(good & (rng.random(4000) < 0.3), rng.integers(1, 5, 4000), 0)
    added = lambda w: op2_quality.risk_sums(x @ w, x, part, 4)
    w, ridge = op2_quality.fit(added, 4, 0.6)
    assert op2_quality.risk(added(w), w, 0.6, ridge)[1] >= 0
    assert ((x @ w > 0) == good).mean() > 0.95
    # Few rows in many dimensions: the unbiased risk alone would fall below zero; the ridge grows until its term doesn't.
    noise = np.hstack([rng.normal(size=(40, 30)), np.ones((40, 1))])
    few = lambda w: op2_quality.risk_sums(noise @ w, noise, np.arange(40) % 5, 4)
    w, ridge = op2_quality.fit(few, 30, 0.9)
    assert ridge > op2_quality.RIDGE and op2_quality.risk(few(w), w, 0.9, ridge)[1] >= 0


def test_prior_from_score_counts():
    positive, unlabelled = np.array([0, 0, 100, 900]), np.array([3000, 1000, 700, 5300])
    assert abs(op2_quality.least_ratio(positive, unlabelled) - 0.6) < 0.02
    assert op2_quality.least_ratio(np.zeros(4), unlabelled) == 0.5


# --- 3


def test_near_duplicates(docs, rows, empty, repeated):
    found = brute.near(rows)
    out = op3_near.near_duplicates(docs)
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == want([(d, n, c, d == c) for d, (n, c) in found.items()])
    assert op3_near.near_duplicates(empty).count() == 0
    # Of each two equal rows both get the same result; a row without an id is alone.
    again = got(op3_near.near_duplicates(repeated), "doc_id", "component_id", "kept")
    assert [r for r in again if r[0] is None] == [(None, None, True)] * 2
    assert {r for r in again if r[0] == 1} == {(1, 1, True)} and len(again) == 8
    kept = op3_near.drop_near_duplicates(docs, 5)
    five = brute.near(rows, 5)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in five.items() if c == d}


def test_near_duplicate_families(spark):
    """Families of edited copies, one of them large: the same classes as all pairs give."""
    r, rows = random.Random(3), []
    for family, size in enumerate((2, 3, 5, 8, 13, 120)):
        words = [f"f{family}w{r.randint(0, 999)}" for _ in range(150)]
        for _ in range(size):
            edited = list(words)
            for _ in range(r.randint(0, 6)):
                edited[r.randrange(150)] = f"e{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(edited)))
    r.shuffle(rows)
    rows += [(1000 + n, " ".join(f"n{n}x{k}" for k in range(40))) for n in range(80)]
    out = op3_near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {d: c for d, (_, c) in brute.near(rows).items()}


@pytest.mark.parametrize("parts", [3, 40])
def test_near_duplicate_large_families(spark, monkeypatch, parts):
    """Families above FAMILY_NODES: a chain of texts that link only to the next, and copies of two texts that don't link; the same classes as all pairs give."""
    r = random.Random(11)
    words = [f"c{k}" for k in range(78 + 8 * 700)]
    rows = [(n, " ".join(words[8 * n : 8 * n + 78])) for n in range(700)]
    for start in (1000, 2000):  # halves of one large family, at similarity 0.7 to each other
        base = [f"b{k}" for k in range(200)]
        if start == 2000:
            base[60:93] = [f"other{k}" for k in range(33)]
        for n in range(45):
            edited = list(base)
            edited[r.randrange(100, 200)] = f"e{start + n}"
            rows.append((start + n, " ".join(edited)))
    r.shuffle(rows)
    monkeypatch.setattr(op3_near, "FAMILY_NODES", 16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = op3_near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {d: c for d, (_, c) in brute.near(rows).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("region", [2000, 8192])
def test_near_duplicate_template(spark, monkeypatch, region):
    """Pairs at similarity 0.81 among thousands of texts with one template, at similarity 0.34: each pair is found, nothing else."""
    template = " ".join(f"t{k}" for k in range(32))
    rows = [(n, " ".join([template, *(f"o{n // 2}x{k}" for k in range(22)), *(f"e{n}x{k}" for k in range(6))])) for n in range(20_000)]
    random.Random(5).shuffle(rows)
    monkeypatch.setattr(op3_near, "REGION_NODES", region, raising=False)
    out = op3_near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in out.where("component_id <> doc_id - doc_id % 2").collect()] == []


@pytest.mark.parametrize("parts", [7, 60])
def test_near_duplicates_over_small_partitions(spark, docs, rows, monkeypatch, parts):
    """Partitions of the order with a few rows, or none, lose no neighbours."""
    monkeypatch.setattr(op3_near, "LEAST_NODES", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = op3_near.near_duplicates(docs)
        assert got(out, "doc_id", "component_id") == want([(d, c) for d, (_, c) in brute.near(rows).items()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + n, 1001 + n) for n in range(60)] + [(5, 5)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    wanted = {x: find(x) for e in links if e[0] != e[1] for x in e}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4


def test_reply_trees(spark):
    """The best branch of each tree, for random forests with forks, a cycle and a missing parent."""
    r, rows = random.Random(2), []
    for tree in range(6):
        for node in range(1, 40):
            rows.append((tree, node, r.randint(1, node - 1) if node > 1 else None, r.choice(["user", "assistant"]), f"t{tree} <n>{node}& [x]", r.random()))
    rows += [(7, 1, 2, "user", "in a circle", 1.0), (7, 2, 1, "user", "in a circle", 1.0), (8, 1, 99, "user", "lost parent", None), (8, 2, 1, "assistant", None, 1.0), (None, 1, None, None, "no tree", 0.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    by = {(t, n): (p, role, text, s) for t, n, p, role, text, s in rows}
    best = {}
    for (t, n), _ in by.items():
        if any(k[0] == t and v[0] == n for k, v in by.items()):
            continue
        path, at = [], n
        while at is not None and (t, at) in by and at not in path:
            path.append(at)
            at = by[(t, at)][0]
        if at in path:
            continue
        score = (sum(by[(t, x)][3] or 0 for x in path) / len(path), len(path), -n)
        if t not in best or score > best[t][0]:
            best[t] = (score, path[::-1])
    out = op4_replies.read_back(op4_replies.conversations(df)).collect()
    assert {r["tree"]: [(x["role"], x["text"]) for x in r["turns"]] for r in out} == {t: [(by[(t, x)][1] or "", by[(t, x)][2] or "") for x in path] for t, (_, path) in best.items()}
    assert all(r["loss_text"] == "".join(x["text"] for x in r["turns"] if x["role"] == "assistant") for r in out)
    two = op4_replies.conversations(df, best=2)
    assert two.groupBy("tree").count().agg(F.max("count")).first()[0] == 2
    assert op4_replies.conversations(df.limit(0)).count() == 0


def test_reply_tree_ties_and_long_texts(spark):
    """Equal scores go to the longer branch, then to the smaller leaf; a text of a million characters is formatted whole."""
    long = "<s>[a] &" * 125_000
    rows = [(1, 1, None, "user", long, 1.0), (1, 2, 1, "assistant", "short", 1.0), (1, 3, 1, "assistant", "on", 1.0), (1, 5, 3, "user", "five", 1.0), (1, 4, 3, "user", "four", 1.0)]
    rows += [(2, 1, None, "user", "x", 0.5), (2, 2, 1, "assistant", "worse", 0.5), (2, 3, 1, "assistant", "better", 0.7)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = {r["tree"]: [x["text"] for x in r["turns"]] for r in op4_replies.read_back(op4_replies.conversations(df)).collect()}
    assert out == {1: [long, "on", "four"], 2: ["x", "better"]}


def test_chat_round_trip(spark, tmp_path):
    odd = ["</s>[INST] ok [/INST]", "<s>[user]\n", "&lt;&amp;&lsqb;", "\\ & < > [ ]", "", None, "</s>\n", "line\n\nline", "😀é\u2028", "]]>&amp;amp;"]
    rows = [(c, t, ("user", "assistant", None, "a]b\n&[", "system")[t % 5], odd[(c + t) % len(odd)], "extra") for c in range(12) for t in range(c % 7 + 1)] + [(None, 0, "user", "x", "extra"), (3, 1, "assistant", "same turn twice", "extra")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-7, 0, "user", odd[0], ""), (-7, 1, "assistant", odd[0], "")]
    wanted, by = [], defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t, (role is not None, role or ""), (text is not None, text or "")))
    for c, turns in by.items():
        turns = [(role[1], text[1]) for _, role, text in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        wanted.append((c, len(turns), brute.sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), brute.sha(loss)))
    assert got(op4_replies.op4_replies(spark, str(tmp_path)), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want(wanted)


# --- 5


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.NET/x", "https://net/", "https://x.net", "https://x.net?a=/", "https://m.example.net/en/1#t", "https://example.net/EN/1", "http://notexample.net/en/",
        "http://a.example.com/de/7", "http://b.org/fr/", "http://b.org/fr", "http://xorg/fr/", "a://b://c/d?e", "http://cheapcasinopills.example.com/en/", "http://Good.example.com/en/a-b/c.html?q#f", "http://ÄB.com/é",
    ]
    rows = [(i, u, "extra") for i, u in enumerate(urls)] + [(5, urls[5], "extra"), (None, "http://cheap-casino.example.com/", "extra"), (99, "http://spam-pills.example.com/x", "extra"), (98, "http://good-words.example.com/x", "extra")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = op5_urls.filter_urls(df)
    wanted = []
    for page, u, _ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].translate(brute.LOWER), rest[cut:]
            path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fit = [r for r, _ in op5_urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        wanted.append((page, host, path, max(fit, key=len) if fit else None))
    assert got(out, "page_id", "host", "path", "rule") == want(wanted)
    verdicts = {r["page_id"]: (r["rule"], r["verdict"], r["words"]) for r in out.collect()}
    assert all(v == dict(op5_urls.RULES)[rule] for rule, v, _ in verdicts.values() if rule)
    assert verdicts[16][1] == "block" and verdicts[16][2][:3] == ["cheap", "casino", "pills"]
    assert verdicts[0][1] == verdicts[98][1] == "allow"
    assert "Äb" in verdicts[18][2] or "äb" in verdicts[18][2] or "Äb".translate(brute.LOWER) in verdicts[18][2]
    # Joined over shuffles instead of broadcast: the same rows.
    names = ("page_id", "host", "path", "rule", "words", "score", "verdict")
    once, before = got(out, *names), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(op5_urls.filter_urls(df), *names) == once
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert op5_urls.filter_urls(df.limit(0)).count() == 0


def _odds_by_hand(learned, seeds, pages):
    """Scores of (host words, path words) pairs by naive Bayes over (host words, path words) pairs."""
    from math import log

    counts, urls = Counter(), Counter()
    for host, path in learned:
        block = any(w in seeds for w in host)
        urls[block] += 1
        counts.update((w, block) for w in [*host, *path] if not w.isdigit())
    words = {w for w, _ in counts}
    total = {k: sum(counts[w, k] for w in words) + len(words) for k in (True, False)}
    odds = {w: round(log((counts[w, True] + 1) / total[True]) - log((counts[w, False] + 1) / total[False]), 9) for w in words}
    prior = round(log((urls[True] + 1) / (urls[False] + 1)), 9)
    return [prior + sum(odds.get(w, 0.0) for w in [*host, *path]) if host or path else 0.0 for host, path in pages]


def test_url_scores_by_brute_force(spark):
    """Score and verdict against counts by hand; words of urls that weren't learned from weigh nothing."""
    r = random.Random(8)
    sites = [["cheap", "pills"], ["free", "casino"], ["good", "news"], ["book", "shop"], ["old", "maps"]]
    learned = [(r.choice(sites), r.choices(["buy", "read", "7", "map", "now"], k=r.randint(0, 3))) for _ in range(80)]
    new = [(["cheap", "news"], ["fresh", "buy"]), (["unseen", "host"], []), (["good", "maps"], ["unheard", "of"])]
    rows = [(n, f"http://{'-'.join(h)}/{'/'.join(p)}") for n, (h, p) in enumerate(learned + new)]
    out = op5_urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=(), learn=F.col("page_id") < 80)
    wanted = _odds_by_hand(learned, set(op5_urls.SEEDS), learned + new)
    for x in out.collect():
        assert abs(x["score"] - wanted[x["page_id"]]) < 1e-6 and x["verdict"] == ("block" if x["score"] > 0 else "allow")


def test_url_verdicts_on_held_back_urls(spark):
    """Learned from three quarters of the urls, the verdicts on the others agree with their hosts' labels."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    back = F.pmod(F.xxhash64(F.col("page_id")), F.lit(4)) == 0
    rows = op5_urls.filter_urls(pages, rules=(), learn=~back).where(back).collect()
    block = [any(w in op5_urls.SEEDS for w in r["words"][:4]) for r in rows]
    said = [r["verdict"] == "block" for r in rows]
    assert sum(block) > 10 and sum(b and s for b, s in zip(block, said)) >= 0.95 * sum(block)
    assert sum(s and not b for b, s in zip(block, said)) <= 0.05 * len(rows)


def test_urls_of_any_length(spark):
    """A host of 3,000 letters, a dictionary word of 60 letters that another host has inside, and content that marks a host."""
    word = "abcdefghij" * 6
    rows = [(1, f"http://x.example.org/{word}/a", None), (2, f"http://cheap{word}pills.example.org/", None), (3, f"http://{'q' * 3000}.example.org/{'z' * 5000}", None)]
    rows += [(n, "http://marked.example.org/p", "*** $$$ !!") for n in (4, *range(30, 60))] + [(n, f"http://plain{n}.example.org/p", "all is well here") for n in range(7, 20)]
    out = {r["page_id"]: r for r in op5_urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[2]["words"][:3] == ["cheap", word, "pills"] and out[3]["words"][0] == "q" * 3000
    assert out[4]["verdict"] == "block" and out[9]["verdict"] == "allow"


def test_viterbi_finds_the_best_split():
    cost = {"ab": 5, "abc": 9, "bc": 4, "ca": 12_000_001, "dd": 3, "abcabcabcabcabcabcabcabcabcabc": 20}

    def splits(x):
        return [[]] if not x else [[x[:n], *rest] for n in range(1, len(x) + 1) for rest in splits(x[n:])]

    r = random.Random(4)
    for label in ["".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["abc" * 10 + "d"]:
        found = [(i, w, c) for w, c in cost.items() for i in range(len(label)) if label[i : i + len(w)] == w]
        words = op5_urls.split_label(label, found + [(0, "nowhere", 1)])
        assert "".join(words) == label
        mine = sum(cost.get(w, op5_urls.UNKNOWN * len(w)) for w in words)
        assert len(label) > 9 or mine == min(sum(cost.get(w, op5_urls.UNKNOWN if len(w) == 1 else 10**12) for w in x) for x in splits(label))
    assert op5_urls.split_label("abc" * 10 + "d", [(0, "abc" * 10, 20)]) == ["abc" * 10, "d"] and op5_urls.split_label("", []) == []


# --- 6


def test_contamination(spark, docs, rows, empty, repeated):
    items = [(1, PASSAGE_ITEM), (2, "a b c"), (3, None), (4, ""), (None, "one"), (10, " ".join(f"word{n} and{n % 7} the{n % 3}" for n in range(20))), (11, "to be to"), (2, "emoji words"), (12, "?!")]
    benchmark = spark.createDataFrame([(*i, "extra") for i in items], "item_id long, text string, doc_id string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    wanted = want(brute.contamination(rows, items))
    assert got(op6_decontaminate.contamination(docs, benchmark), *names) == wanted
    # The same in blocks of few patterns.
    assert got(op6_decontaminate.contamination(docs, benchmark, block_chars=200), *names) == wanted
    for df in (empty, repeated):
        assert op6_decontaminate.contamination(df, benchmark).count() == df.count()
    assert got(op6_decontaminate.contamination(docs, benchmark.limit(0)), "n_hit", "contaminated") == [(0, False)] * len(rows)
    clean = {d for d, *_, bad in brute.contamination(rows, items) if not bad}
    for chars in (10**6, 200):
        kept = op6_decontaminate.decontaminate(docs, benchmark, block_chars=chars)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean


def test_contamination_in_blocks(spark):
    """An item longer than a block, string ids, rows without an id and rows that share one: the same in one block and in many."""
    words = [f"w{n}" for n in range(400)]
    items = [("b", " ".join(words)), ("a", "five words stand here alone"), ("c", " ".join(words[100:130])), ("c", " ".join(words[100:130]))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rows = [(None, " ".join(words[95:140])), (None, "clean text"), (1, " ".join(words[:12])), (1, " ".join(words[388:])), (2, "x Five words STAND here alone"), (3, " ".join(words))]
    docs = spark.createDataFrame([(*r, "extra", "extra") for r in rows], "doc_id long, text string, marks string, items string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    wanted = brute.contamination(rows, items)
    for chars in (10**6, 900):
        n, rows_of = op6_decontaminate.blocks_of(benchmark, 13, chars)
        assert (n > 1) == (chars < 10**6) and all(sum(len(r["text"]) for r in rows_of(b)) <= chars for b in range(n))
        assert got(op6_decontaminate.contamination(docs, benchmark, block_chars=chars), *names) == want(wanted)
        kept = op6_decontaminate.decontaminate(docs, benchmark, block_chars=chars)
        assert kept.columns == docs.columns and got(kept, "doc_id", "text") == want([r for r, w in zip(rows, wanted) if not w[-1]])


PASSAGE_ITEM = " ".join(f"wort{n}" for n in range(60))


# --- 7


def test_licences(spark, docs, empty):
    mit = dict(TEXTS)["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")), (3, mit.replace("sublicense", "sub-license") + "\n© me"), (4, mit + " and more"), (5, None), (6, "x\nReleased under the MIT license!\ny"), (7, "...")]
    out = {r["doc_id"]: (r["license_id"], r["notices"], r["n_notices"]) for r in op7_licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ("MIT", "", 0), 2: ("MIT", "", 0), 3: ("MIT", "", 0), 4: (None, "", 0), 5: (None, "", 0), 6: (None, "MIT", 1), 7: (None, "", 0)}
    assert op7_licences.scan(empty).count() == 0 and op7_licences.scan(docs).count() == docs.count()
    for name, text in TEXTS:
        assert {r[0] for r in op7_licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("license_id").collect()} == {name}


def test_wrapped_licences(spark):
    """Licences as they are published, in lines of any width; statements of a copyright don't count."""
    isc = """ISC License

Copyright 2020 Someone
Copyright Someone, Inc. and other contributors.

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + dict(TEXTS)["ISC"].split("\n\n")[-1]
    wanted = ["ISC"]
    texts = [isc]
    for name, text in TEXTS:
        for width in range(24, 100):
            paragraphs = [textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n")]
            texts.append("\n\n".join(paragraphs))
            wanted.append(name)
    out = op7_licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r["doc_id"]: r["license_id"] for r in out.collect()}
    assert [(n, found[n], name) for n, name in enumerate(wanted) if found[n] != name] == []


def test_published_licences(spark):
    """Long licences as a distribution ships them, whole and without the appendix, and a notice on a very long line."""
    import os
    import re

    folder, names = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = []
    for file, name in names.items():
        if os.path.exists(f"{folder}/{file}"):
            text = open(f"{folder}/{file}").read()
            terms = re.search("END OF TERMS AND CONDITIONS", text)
            texts += [(name, text), (name, text.upper()), (name, text[: terms.end()] if terms else text), (None, text[:-40])]
    texts += [("Unlicense", dict(TEXTS)["Unlicense"]), (None, "Licensed under the Apache License, Version 2.0." + " ," * 5000)]
    out = op7_licences.scan(spark.createDataFrame([(n, t) for n, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["license_id"] for r in out} == {n: name for n, (name, _) in enumerate(texts)}
    assert [r["notices"] for r in out if r["doc_id"] == len(texts) - 1] == ["Apache-2.0"]


def test_licences_of_repeated_rows(repeated):
    assert op7_licences.scan(repeated).count() == repeated.count()


# --- 8


def test_raking_meets_targets(spark):
    r = random.Random(6)
    cells = spark.createDataFrame([(s, g, t, float(r.randint(50, 500))) for s in "abc" for g in ("en", None) for t in ("p", "q")], "source string, lang string, topic string, mass double")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, None: 0.4}, "topic": {"p": 0.7, "q": 0.3}}
    rows = op8_mixing.rake(cells, targets=targets).collect()
    for m, goals in targets.items():
        for value, goal in goals.items():
            assert abs(sum(r["weight"] * r["mass"] for r in rows if r[m] == value) - goal) < 1e-10
    assert {r["distance"] for r in rows} == {rows[0]["distance"]} and rows[0]["distance"] <= op8_mixing.DISTANCE
    # Targets that contradict the cells: the distance says so.
    alone = spark.createDataFrame([("a", "en", "p", 1.0), ("b", "de", "q", 1.0)], "source string, lang string, topic string, mass double")
    assert op8_mixing.rake(alone, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}, sweeps=6).first()["distance"] > 0.1


def test_mixing(spark, docs, empty, repeated, sf):
    out = op8_mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["probability"] <= 1 for r in out)
    assert Counter(r["n_tokens"] for r in out) == Counter(len(brute.WORD.findall(t or "")) for t in [r["text"] for r in docs.collect()])
    assert op8_mixing.mix(empty).count() == 0 and op8_mixing.mix(repeated).count() == repeated.count()
    kept = op8_mixing.sample(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in out if r["kept"])
    # The expected token shares of the sample are the targets.
    rows = op8_mixing.mix(table(spark, sf, "documents")).collect()
    mass, expected = Counter(), Counter()
    for r in rows:
        mass[r["lang"]] += r["n_tokens"]
        expected[r["lang"]] += r["n_tokens"] * r["probability"]
    goal = {k: v**op8_mixing.TEMPERATURE for k, v in mass.items()}
    for k in mass:
        assert abs(expected[k] / sum(expected.values()) - goal[k] / sum(goal.values())) < op8_mixing.WHOLE
    # The cells that are kept whole hold few tokens, and the sample isn't thinned out for them.
    whole = sum(r["n_tokens"] for r in rows if r["weight"] > 1)
    assert whole <= op8_mixing.WHOLE * sum(mass.values()) and sum(expected.values()) > 0.4 * sum(mass.values())


def test_mixing_with_many_cells(spark, docs, sf, monkeypatch):
    """The steps over shuffles, for many cells, give what the steps in one partition give."""
    names = ("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")
    for df in (docs, table(spark, sf, "documents")):
        few, sampled = got(op8_mixing.mix(df), *names), got(op8_mixing.sample(df), "doc_id")
        with monkeypatch.context() as m:
            m.setattr(op8_mixing, "CELLS", 0)
            assert got(op8_mixing.mix(df), *names) == few and got(op8_mixing.sample(df), "doc_id") == sampled


def test_mixing_by_given_topics(spark, docs):
    """A caller's topic stands in for the form of the text."""
    out = op8_mixing.mix(docs, {"topic": {"x": 1.0}}, F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"))
    assert {r["topic"] for r in out.collect()} == {"x", "y"} and not out.where("topic = 'y' AND n_tokens > 0 AND kept AND doc_id IS NOT NULL").count()


# --- 9


def test_passages(docs, rows, empty, repeated):
    names = ("doc_id", "n_words", "n_removed", "sha")
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("sha")
    out = op9_substrings.repeated_passages(docs).withColumn("sha", digest)
    assert got(out, *names) == want(brute.passages(rows))
    again = op9_substrings.repeated_passages(repeated).withColumn("sha", digest)
    assert got(again, *names) == want(brute.passages([(r["doc_id"], r["text"]) for r in repeated.collect()]))
    assert op9_substrings.repeated_passages(empty).count() == 0
    for r in out.collect():
        spans = [(x["start"], x["end"]) for x in r["removed"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(a > b for (_, b), (a, _) in zip(spans, spans[1:]))


def test_passages_across_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(op9_substrings, "BLOCK_WINDOWS", 50)
    monkeypatch.setattr("countinghouse.llm.words.CHUNK_BYTES", 300)
    out = op9_substrings.repeated_passages(docs.repartition(7))
    assert got(out, "doc_id", "n_words", "n_removed") == want([r[:3] for r in brute.passages(rows)])


def test_passages_confirmed_by_the_second_hash(docs, rows, repeated, monkeypatch):
    """With fingerprints of a few bits almost all windows share one; the second hash keeps them apart."""
    for width in (13, 3):
        out = op9_substrings.repeated_passages(docs.repartition(5), width, print_bits=9)
        assert got(out, "doc_id", "n_words", "n_removed") == want([r[:3] for r in brute.passages(rows, width)])
    monkeypatch.setattr(op9_substrings, "BLOCK_WINDOWS", 40)
    again = op9_substrings.repeated_passages(repeated.repartition(4), print_bits=3)
    assert got(again, "doc_id", "n_words", "n_removed") == want([r[:3] for r in brute.passages([(r["doc_id"], r["text"]) for r in repeated.collect()])])


def test_passages_rows_do_not_grow_with_partitions(spark, monkeypatch):
    """600 documents in pairs that tasks must tell each other of: many partitions don't cut what they send into a row a document."""
    texts = [(i + side, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(300) for side in (0, 1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    made, frame = [], type(docs)
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: made.append((f.__qualname__.split(".")[0], run(self, f, *a, **k))) or made[-1][1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            made.clear()
            out = op9_substrings.repeated_passages(docs)
            dealt = {name: df.where("doc_id IS NULL").count() for name, df in made if name in ("_pairs", "_answers")}
            assert got(out, "doc_id", "n_words", "n_removed") == want(r[:3] for r in brute.passages(texts))
            assert dealt["_pairs"] <= 8 * 16 and dealt["_answers"] <= 16 * 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_passages_buckets():
    """Two a partition where the input fills them, and more where one would hold too much."""
    assert op9_substrings._bucket_bits(211, 1000) == 4 and op9_substrings._bucket_bits(64, 1 << 40) == 21
    assert op9_substrings._bucket_bits(4, 1 << 21) == 4 and op9_substrings._bucket_bits(64, 1 << 22) == 7
    few, many = (op9_substrings._bucket_bits(n, 1 << 22) for n in (64, 6400))
    assert few == many


def test_packing():
    r = np.random.default_rng(1)
    for n in (1, 2, 1000):
        x = np.sort(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert np.array_equal(op9_substrings.unpack_sorted(op9_substrings.pack_sorted(x)), x)
        y = r.integers(-(2**62), 2**62, n)
        assert np.array_equal(op9_substrings.unpack(op9_substrings.pack(y), n, np.int64), y)


# --- 10


def test_lines(docs, rows, empty, repeated, monkeypatch):
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got(op10_lines.keep_bitmaps(docs), *names) == want(brute.lines(rows))
    monkeypatch.setattr(op10_lines, "BLOCK_LINES", 3)
    out = op10_lines.keep_bitmaps(docs)
    assert got(out, *names) == want(brute.lines(rows))
    assert got(op10_lines.keep_bitmaps(repeated), *names) == want(brute.lines([(r["doc_id"], r["text"]) for r in repeated.collect()]))
    assert op10_lines.keep_bitmaps(empty).count() == 0
    # The bitmap alone gives the kept lines.
    texts = dict(rows)
    for r in out.collect():
        assert brute.sha(op10_lines.apply_bitmap(texts[r["doc_id"]], r["keep_bitmap"])) == r["kept_sha256"]
        assert len(op10_lines.unpacked(r["keep_bitmap"])) == r["n_lines"]
    applied = op10_lines.drop_repeated_lines(docs)
    assert applied.columns == docs.columns
    shas = {d: s for d, *_, s in brute.lines(rows)}
    assert all(brute.sha(r["text"] or "") == shas[r["doc_id"]] and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in applied.collect())


def test_bitmaps():
    r = random.Random(9)
    for n in (1, 2, 7, 300):
        for _ in range(20):
            keep = np.array([r.random() < 0.5 for _ in range(n)])
            assert np.array_equal(op10_lines.unpacked(op10_lines.packed(keep)), keep)
    assert op10_lines.packed(np.array([False, True, True])) == "0,1,2"


# --- pipeline


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    """A session on a cluster that names no folder is told so."""
    from types import SimpleNamespace

    session = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(session)


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near", "decontaminate", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in rows}
        if name == "quality":
            scores = op2_quality.op2_quality(spark, sf).collect()
            assert ids == {r["doc_id"] for r in scores if r["predicted"] == 1}
        elif name == "lines":
            assert {r["doc_id"]: brute.sha(r["text"]) for r in rows} == {d: s for d, _, _, s in brute.lines(before)}
        elif name == "near":
            assert ids == {d for d, (_, c) in brute.near(before, 5).items() if d == c}
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
            assert ids == {d for d, *_, bad in brute.contamination(before, items) if not bad}
        else:
            assert ids == {r["doc_id"] for r in op8_mixing.mix(docs).collect() if r["kept"]}
        docs = spark.createDataFrame(rows, docs.schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(ids)


def test_pipeline_stages_on_awkward_rows(spark, sf, docs, empty, repeated):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (docs, empty, repeated, docs.select(*plain)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert out.columns == df.columns and out.count() <= df.count()


