"""Training-data operators against brute force, on small tables with nulls, empty texts, ties and clashing columns."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillbase.llm import components, embeddings, html_extract, language_id, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __gone int, score double, rep string"


def make_texts():
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}é" if i % 5 else f"W{i}." for i in range(400)]
    line = lambda n: " ".join(r.choice(vocabulary, n))
    common = line(30)
    out = [None, "", " \t\n", "one", "One", "a b", "A\tB", "x\x0by z"]
    for i in range(60):
        t = "\n".join([line(int(r.integers(3, 40))) for _ in range(int(r.integers(1, 5)))] + [common] * (i % 4 == 0))
        out.append(t)
        if i % 3 == 0:
            out += [t, t.upper(), t + " tail", t.replace(" ", "  ", 1)]
        if i % 7 == 0:
            out.append("\n".join(x + " more" for x in t.split("\n")))
    out += ["again " * 40, "Again again\n" * 10, line(9000), "é" * 50]
    return out


TEXTS = make_texts()


def frame(spark, texts=TEXTS):
    rows = [(i, t, "de" if i % 3 else "en", None if i % 11 == 0 else f"s{min(i % 7, 3)}", len(t or ""), 1, 0.5, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def empty(docs):
    return docs.where("doc_id < -1")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def roots(pairs, names):
    up = {i: i for i in names}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in names}


@pytest.mark.parametrize("n", [2, 5])
def test_minhash(docs, n):
    sets = {i: shingles(t, n) for i, t in enumerate(TEXTS)}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(pairs, sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, n).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_rows(docs):
    out = minhash.deduplicated(docs)
    assert out.columns == docs.columns
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_minhash_repeats(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t, 1), (5, t, 2), (5, "other words altogether in this row", 3), (9, t + " x", 4), (None, t, 5), (7, None, 6)]
    got = sorted(minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, kept int")).select("kept").toPandas()["kept"])
    assert got == [1, 2, 3, 5, 6]
    out = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept int"), 2).collect()}
    assert out == {(5, 39, 5, True), (5, 5, 5, True), (9, 40, 5, False), (None, 39, None, True), (7, 0, 7, True)}


def test_registers_estimate():
    a, b = " ".join(f"w{i}" for i in range(2000)), " ".join(f"w{i}" for i in range(100, 2000))
    g, o = minhash.shingle_sets(pa.array([a, b]), 1)
    r = minhash.registers(g, o)
    assert abs(minhash.estimate(r[:1], r[1:])[0] - 0.95) < 0.08


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (102, 101)]
    got = dict(components.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def brute_lines(least):
    lines, first = [], {}
    for i, t in enumerate(TEXTS):
        for k, s in enumerate([] if t is None else t.split("\n")):
            w = WORD.findall(s.translate(LOW))
            if len(w) >= least:
                lines.append((i, k, frozenset(w)))
                first.setdefault(frozenset(w), (i, k))
    best = {s: min(p for o, p in first.items() if 100 * len(s & o) >= 80 * len(s | o)) for s in first}
    return {(i, k) for i, k, s in lines if best[s] < (i, k)}


@pytest.mark.parametrize("least", [1, 5])
def test_lines(docs, least):
    assert {(r["doc_id"], r["line"]) for r in line_dedup.removed(docs, 80, least).collect()} == brute_lines(least)


def line_family(spark):
    """Lines of few words that make long lists, families of similar lines, and ids of strings."""
    r = np.random.default_rng(12)
    texts = []
    for i in range(120):
        base = [f"v{x}" for x in r.choice(12, 6, replace=False)]
        rows = [" ".join(base)]
        for _ in range(3):
            w = [f"t{x}" for x in range(14)]
            for at in r.choice(14, int(r.integers(0, 4)), replace=False):
                w[at] = f"u{r.integers(0, 40)}"
            rows.append(" ".join(w))
        texts.append("\n".join(rows))
    return texts


@pytest.mark.parametrize("chain,asked,kind", [(20_000, 1, "long"), (3, 1, "long"), (3, 2, "string")])
def test_lines_chains(spark, monkeypatch, chain, asked, kind):
    monkeypatch.setattr(line_dedup, "CHAIN", chain)
    monkeypatch.setattr(line_dedup, "ASKED", asked)
    monkeypatch.setattr(line_dedup, "PART", 500)
    texts = line_family(spark)
    ids = [i if kind == "long" else f"id{i:04d}" for i in range(len(texts))]
    d = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)] + [(None, texts[0])], f"doc_id {kind}, text string").repartition(3)
    lines = [(i, k, frozenset(s.split())) for i, t in zip(ids, texts) for k, s in enumerate(t.split("\n"))]
    want = {(i, k) for i, k, s in lines if any((j, m) < (i, k) and 100 * len(s & o) >= 80 * len(s | o) for j, m, o in lines)}
    assert 60 < len(want) < 480
    assert {(r["doc_id"], r["line"]) for r in line_dedup.removed(d).collect()} == want


def test_lines_repeats(spark):
    # rows of one doc_id share places; a null id or text takes no part; clashing columns stay
    rows = [(7, "a b c\nx", 1), (7, "a b c\nx", 2), (7, "a b c\ny", 3), (9, "c b a\nnew", 4), (None, "a b c", 5), (3, None, 6), (8, "", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, __gone int")
    got = sorted((r["__gone"], r["text"], r["__n_removed"]) for r in line_dedup.deduplicated(d).withColumn("text", F.coalesce("text", F.lit("-"))).collect())
    assert got == [(1, "a b c\nx", 0), (2, "a b c\nx", 0), (3, "a b c\ny", 0), (4, "new", 1), (5, "a b c", 0), (6, "-", 0), (7, "", 0)]


def test_lines_rows(docs):
    out = line_dedup.deduplicated(docs)
    assert out.columns == [*docs.columns, "__n_lines", "__n_removed"]
    gone = brute_lines(1)
    for r in out.collect():
        t = TEXTS[r["doc_id"]]
        assert r["text"] == (None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (r["doc_id"], k) not in gone))
    assert line_dedup.deduplicated(empty(docs)).count() == 0


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(TEXTS[r["doc_id"]] or "")) and r["times"] <= 3
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in by[s]) for s in order}
    total, full, target = sum(size.values()), set(), {}
    while True:  # reshare until none is above
        free = [s for s in order if s not in full]
        left = total - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in order}
        more = {s for s in free if target[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    for s in order:
        assert by[s][0]["source_size"] == size[s] and by[s][0]["target"] == pytest.approx(target[s])
        taken = sum(r["size"] * r["times"] for r in by[s])
        assert abs(taken - target[s]) <= max(r["size"] for r in by[s])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["times"] for r in rows)
    assert mixing.mix(empty(docs)).count() == 0


def test_rules(docs):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = WORD.findall(t)
        seen, again = set(), 0
        for s in t.split("\n"):
            if WORD.search(s):
                again += s in seen
                seen.add(s)
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        cover = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(cover))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(empty(docs)).count() == 0


def plain_verdict(t):
    """The rules that follow the base rule, by plain Python."""
    w = WORD.findall(t)
    upper = sum("A" <= c <= "Z" for c in t)
    letters = sum(c.isascii() and c.isalpha() or 0xC0 <= ord(c) < 0x800 or (0x800 <= ord(c) < 0xE000 and not 0x2000 <= ord(c) < 0x3000) for c in t)
    lines = t.split("\n")
    seen, again = set(), 0
    for s in lines:
        if WORD.search(s):
            again += s in seen
            seen.add(s)
    doubled = sum(a == b for a, b in zip(w, w[1:]))
    signs, size = sum(c in "#*$%&|<>" for c in t), sum(map(len, w))
    return not (10 * signs > len(w) or 10 * upper > 3 * letters or 10 * doubled > 3 * len(w) or 10 * again > 3 * len(lines) or size < 2 * len(w) or size > 20 * len(w))


def test_rules_verdict(spark):
    r = np.random.default_rng(6)
    texts = list(TEXTS)
    for i in range(120):
        pool = [["word", "Other", "naïve", "мир", "語", "–", "a"], ["ABC", "DEF", "x"], ["#", "$x", "plain", "words", "here"], ["z" * 30, "q"], ["a", "b", "I"], ["same"]][i % 6]
        w = [str(x) for x in r.choice(pool, int(r.integers(20, 60)))]
        texts.append(" ".join(x if k % 9 else x + "\n" for k, x in enumerate(w)) + ("\ndup line\n" * 30 if i % 5 == 0 else ""))
    texts.append("long words " * 40_000 + " ".join(f"w{i}" for i in range(90_000)))
    rows = quality_rules.quality_rules(frame(spark, texts)).collect()
    bad = [(texts[x["doc_id"]], x["kept"]) for x in rows if x["kept"] != (not x["base_failed"] and plain_verdict(texts[x["doc_id"]] or ""))]
    assert not bad and len({x["kept"] for x in rows}) == 2


def test_rule_order():
    assert quality_rules.order({"few_words": (1.0, 0.5), "symbols": (0.1, 0.4)})[:2] == ["symbols", "few_words"]
    texts = pa.array(["word " * 3, "plain words of many kinds " + " ".join(f"w{i}" for i in range(30)), None])
    names = list(quality_rules.RULES)
    assert quality_rules.cascade(texts, names).tolist() == quality_rules.cascade(texts, names[::-1]).tolist() == [False, True, False]


@pytest.fixture(scope="module")
def learnt(spark):
    r = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(240):
        words = [str(x) for x in r.choice([f"word{k}" for k in range(300)], int(r.integers(20, 90)))]
        bad = i % 2
        if bad:
            for at in r.choice(len(words), 4, replace=False):
                words[at] = str(r.choice(["grumblex", "snarfig", "zorkle"]))
        rows.append((i, " ".join(words), ("de", "en")[i % 2], "s", 0, 1, 0.5, "r"))
        labels.append((i, 1 - bad, bad))
    rows += [(1000, None, None, None, None, 1, 0.5, "r"), (1001, "", "de", "s", 0, 1, 0.5, "r"), (1002, "12 34 !!", "de", "s", 0, 1, 0.5, "r")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, want):
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 1000]
    return np.mean([r["predicted"] == want(r["doc_id"]) for r in held])


def test_quality(learnt):
    docs, labels = learnt
    rows = quality_classifier.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, lambda i: 1 - i % 2) > 0.9
    assert quality_classifier.quality(docs, labels.where("doc_id < 0")).where("score <> 0.5").count() == 0


def test_toxicity(learnt):
    docs, labels = learnt
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows if r["doc_id"] in (1000, 1001)} == {0.0}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert accuracy(rows, lambda i: i % 2) > 0.8
    assert toxicity.toxicity(docs, labels.where("toxic = 1")).where("score <> 0").count() == 0


def test_toxicity_windows():
    w = toxicity.Words(pa.array([" ".join(f"w{i}" for i in range(100)), None, "a b"]))
    ids, text = w.windows()
    assert text.tolist() == [0, 0, 0, 0, 2] and {i for x in ids[text == 0] for i in x} == set(w.ids[:100])


def test_toxicity_gradient():
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params(3).items()}
    w = toxicity.Words(pa.array(["a b c idiot, d", "x y"]))
    p["word"] += 0.1 * np.random.default_rng(1).standard_normal(p["word"].shape)
    p["piece"] += 0.1 * np.random.default_rng(2).standard_normal(p["piece"].shape)
    ids, y = w.windows()[0], np.array([1.0, 0.0])
    g, tables, _ = toxicity.gradients(p, w, ids, y, np.ones(2))

    def loss():
        z = toxicity.forward(p, w.inputs(p), ids).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for k in ("wf", "ub", "a", "v", "o", "cf"):
        i = tuple(0 for _ in p[k].shape)
        keep, p[k][i] = p[k][i], p[k][i] + 1e-3
        hi = loss()
        p[k][i] = keep - 1e-3
        assert (hi - loss()) / 2e-3 == pytest.approx(g[k][i], rel=2e-2, abs=1e-7)
        p[k][i] = keep


def test_language(spark):
    words = {"en": "the and with this that from have".split(), "de": "der und nicht mit über schön das".split()}
    r = np.random.default_rng(5)
    rows = [(i, " ".join(r.choice(words[k], 15)), k, "s", 0, 1, 0.5, "r") for i in range(120) for k in [("en", "de")[i % 2]]] + [(900, None, "en", "s", 0, 1, 0.5, "r"), (901, "12 !", None, "s", 0, 1, 0.5, "r")]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"]: x for x in language_id.language_id(d).collect()}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert all(got[i]["lang_pred"] == ("en", "de")[i % 2] for i in range(120) if got[i]["held_out"])
    assert {x["lang_pred"] for x in language_id.language_id(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_id(empty(d)).count() == 0


@pytest.mark.parametrize("shard", [8192, 60])
def test_embeddings(spark, monkeypatch, shard):
    monkeypatch.setattr(embeddings, "SHARD", shard)
    r = np.random.default_rng(8)
    base = r.standard_normal((40, 8))
    x = [(base[i % 40] + 0.12 * r.standard_normal(8)).astype(np.float32).tolist() for i in range(600 if shard == 60 else 300)]
    label = (lambda i: 0) if shard == 60 else (lambda i: i % 3)
    rows = [(i, v, label(i)) for i, v in enumerate(x)] + [(4000 + i, x[0], 0) for i in range(30)]
    rows += [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, [float("nan")] * 8, 1), (5003, [None, *x[0][1:]], 1), (5004, x[0], None), (5005, x[0][:4], 0)]
    twice = [(7, x[7], label(7)), (None, x[7], label(7))]
    d = spark.createDataFrame([(*v, 1.0, 2) for v in rows + twice], "vec_id long, embedding array<float>, label int, rep double, blob int")
    out = embeddings.near_vectors(d)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    every = [(a["vec_id"], (a["n_links"], a["component_id"], a["kept"])) for a in out.collect()]
    got = dict(every)
    assert len(every) == len(rows) + 2 and [v for k, v in every if k == 7] == [got[7]] * 2 and got.pop(None) == (0, None, True)
    ok = [(i, np.array(v, float), k) for i, v, k in rows if i < 5000]
    u = np.stack([v / np.linalg.norm(v) for _, v, _ in ok])
    near = (u @ u.T >= 0.93) & (np.array([k for *_, k in ok])[:, None] == np.array([k for *_, k in ok])[None]) & ~np.eye(len(ok), dtype=bool)
    want = roots([(ok[a][0], ok[b][0]) for a, b in zip(*np.nonzero(near)) if a < b], [i for i, *_ in ok])
    assert got == {i: (int(near[k].sum()), want[i], want[i] == i) for k, (i, *_) in enumerate(ok)} | {i: (0, i, True) for i in range(5000, 5006)}


def test_embeddings_limit(spark):
    # a cosine of just 0.93 in doubles links, one below it doesn't; an empty table gives nothing
    rows = [(1, [0.93, (1 - 0.93**2) ** 0.5], 0), (2, [1.0, 0.0], 0), (3, [1.0, -0.396], 0), (4, [1.0, 0.0], 9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cos = lambda a, b: np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b)))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[2] == b[2] and cos(a[1], b[1]) >= 0.93}
    assert {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(d).collect()} == {i: sum(a == i for a, _ in want) for i in range(1, 5)}
    assert embeddings.near_vectors(d.where("vec_id < 0")).count() == 0


def test_graphs_are_asked(monkeypatch):
    # small shards too: the scan is for graphs that fail the audit alone
    r = np.random.default_rng(3)
    x = embeddings._unit(np.repeat(r.standard_normal((10, 8)), 4, 0) + 0.02 * r.standard_normal((40, 8)))
    _, _, ef = embeddings.linked(x, embeddings.Graph(x), 0.93)
    assert ef == 40


def test_graph_recall():
    r = np.random.default_rng(2)
    x = embeddings._unit(np.repeat(r.standard_normal((300, 16)), 4, 0) + 0.05 * r.standard_normal((1200, 16)))
    g = embeddings.Graph(x)
    q, c = g.near_to(x, 0.93, embeddings.EF)
    truth = set(zip(*np.nonzero(x @ g.x.T >= 0.93)))
    assert len(truth & set(zip(q.tolist(), c.tolist()))) >= 0.98 * len(truth)


PAGE = """<html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- no --><div class="ad">Buy this thing now.</div>
<article><h1>The &amp; title</h1><p>First  line<br>and\tmore text of the page that is long enough.<p>Second.</p></article><div id="comments"><p>I disagree with all of this, said a reader of the page.</p></div><footer>&copy; me</footer>"""


def test_html(spark):
    d = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(d).collect()}
    text = "The & title\n\nFirst line and more text of the page that is long enough.\n\nSecond."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0)}


def test_html_marginals():
    import itertools

    page, (unary, edge) = html_extract.Page("<div><p>a</p><p>b c</p></div>"), html_extract.weights()
    n, total, on = len(page.parent), 0.0, np.zeros(len(page.parent))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(y[i] * unary.get(f, 0) for i in range(n) for f in page.features[i]) + sum(edge[y[page.parent[i]]][y[i]] for i in range(1, n)))
        total, on = total + w, on + w * np.array(y)
    other = html_extract.Page("<ul><li>x</ul>")
    got = html_extract.marginals([other, page, other], (unary, edge))
    assert got[len(other.parent) :][:n] == pytest.approx(on / total) and got[: len(other.parent)] == pytest.approx(got[-len(other.parent) :])


def test_many_languages(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 4, f"l{i % 1200:04d}", 1) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    names = {r["lang_pred"] for r in language_id.language_id(d).collect()}
    assert 1 < len(names) <= 256


def test_language_model(spark):
    # ties go to the first by code point; the scores are those of a plain multinomial model
    rows = [(i, t, k) for i, (t, k) in enumerate([("aab", "x"), ("abb", "y"), ("ab ab", "z"), ("aab", "x"), ("bb", "y")] * 6)] + [(100, "", "x"), (101, "ab " * 30_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, logs = language_id.fit(d, modulus=3, held=1)
    count = {k: collections.Counter() for k in names}
    bits = language_id.BITS
    for i, t, k in rows:
        if k and zlib.crc32(str(i).encode()) % 3 != 1:
            hashed, _, _ = language_id.grams(pa.array([t]))
            for h in hashed:
                count[k].update(x for x in h.tolist() if x)
    for j, k in enumerate(names):
        n = sum(count[k].values())
        for g, c in count[k].items():
            assert logs[g, j] == pytest.approx(np.log((c + 0.5) / (n + 0.5 * (1 << bits))), rel=1e-5)
    same = spark.createDataFrame([(i, "same words", k) for i in range(30) for k in ("b", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.language_id(same).collect()} == {"a"}


@pytest.fixture(scope="module")
def tokens():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_encode(tokens):
    texts = [*TEXTS, " a", " a ", "a  b", "x\n y", "tab\t z", "nb  z", "it's 'll <|endoftext|>", "a\nb c"]
    ids, off = packing.encode(pa.array(texts), tokens)
    t, _ = packing.tokenizer(tokens)
    for i, x in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_pack(docs, tokens):
    rows = packing.pack(docs, tokens).collect()
    t, _ = packing.tokenizer(tokens)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(TEXTS)}
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
        own = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    for i, ids in want.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids)
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(empty(docs), tokens).count() == 0


def test_cuts_are_best():
    r = np.random.default_rng(4)
    ids = r.integers(0, 9, 60).astype(np.uint32)
    ends = np.array([7, 19, 33, 48, 60])
    stops = np.array([True] + [False] * 8)
    got = packing.cuts(ids, ends, stops, True, max_len=16)
    pen = np.full(61, np.inf)
    pen[1:][stops[ids]] = packing.SENTENCE
    pen[ends] = 0
    pen[44:] = np.minimum(pen[44:], packing.INSIDE)
    pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
    if (np.diff(np.flatnonzero(np.isfinite(np.append(0, pen[1:])))) <= 16).all():
        cost = [0.0] + [np.inf] * 60
        for k in range(1, 61):
            cost[k] = min((cost[i] + pad(k - i) + pen[k] for i in range(max(0, k - 16), k)), default=np.inf)
        total = sum(pad(b - a) + pen[b] for a, b in zip(np.append(0, got[:-1]), got))
        assert total <= cost[60] + 16


def test_pipeline(spark, tokens, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    frame(spark).drop("__gone", "score", "rep").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(path := str(tmp_path / stage.__name__))
        docs = spark.read.parquet(path)
        assert docs.columns == names
        assert docs.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
    out = pipeline.run(spark, str(tmp_path))
    assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
    assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.countDistinct("start")).where("n % t <> 0").count() == 0


def test_toxicity_all_windows():
    # a stretch that a grid of windows 28 apart cuts in two counts whole, wherever it lies
    p = {k: v + 0.3 * np.random.default_rng(1).standard_normal(v.shape).astype(np.float32) for k, v in toxicity.new_params(3).items()}
    texts = [" ".join(f"w{i * k % 97}" for i in range(n)) for k, n in ((1, 100), (3, 33), (5, 32), (7, 5), (11, 2500))] + [None]
    w = toxicity.Words(pa.array(texts))
    best, begin = toxicity.highest(p, w)
    for t, text in enumerate(texts[:-1]):
        every = np.arange(max(1, len(text.split()) - toxicity.WINDOW + 1))
        z = toxicity.forward(p, w.inputs(p), w.window(every, np.full(len(every), t)))
        assert best[t] == pytest.approx(z.max(), abs=1e-4) and z[begin[t]] == pytest.approx(z.max(), abs=1e-4)
    assert best[-1] == -np.inf and begin[0] % 28


def test_lines_short(spark, tmp_path):
    # copies of lines of 1 to 4 words go too, in op3 as in the pipeline
    from quillbase.llm import queries

    pipeline = pytest.importorskip("corpus_pipeline")
    frame(spark).drop("__gone", "score", "rep").write.parquet(str(tmp_path / "documents.parquet"))
    gone, want = brute_lines(1), {}
    for i, t in enumerate(TEXTS):
        want[i] = None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in gone)
    assert {r["doc_id"]: r["text"] for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()} == want
    kept = {i: t for i, t in want.items() if t == TEXTS[i] or WORD.search(t)}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.drop_lines(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == kept and all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_audit_without_links():
    # no audited query has a link, and the graph leads nowhere: the one link of another query must still be found
    r = np.random.default_rng(6)
    x, q = embeddings._unit(r.standard_normal((1000, 16))), embeddings._unit(r.standard_normal((200, 16)))
    g = embeddings.Graph(x)
    for k in range(len(g.near)):
        g.near[k][:] = -1
    picks = np.unique(np.linspace(0, len(q) - 1, embeddings.AUDIT).astype(int))
    q[1] = g.x[700]
    assert 1 not in picks and (q[picks] @ x.T < 0.97).all()
    rows, nodes, _ = embeddings.linked(q, g, 0.97)
    assert (1, 700) in set(zip(rows.tolist(), nodes.tolist()))


def test_estimate_spares_small_sets(spark):
    # registers that agree in half of all buckets put a pair of 0.8 far under the limit
    a = np.arange(minhash.BUCKETS, dtype=np.uint16)
    b = np.where(a % 2, a, a + np.uint16(1000)).astype(np.uint16)
    rows = [(1, 5, a.tobytes()), (2, 4, b.tobytes()), (3, 500, a.tobytes()), (4, 400, b.tobytes())]
    classes = spark.createDataFrame(rows, "rep long, n long, registers binary")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert [(r["a"], r["b"]) for r in minhash._estimated(pairs, classes, 0.671).collect()] == [(1, 2)]


def test_pipeline_stages(spark, learnt, tokens, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = learnt
    copies = spark.createDataFrame([(2000, docs.where("doc_id = 0").first()["text"] + " extra", "de", "s", 0, 1, 0.5, "r"), (2001, "short line\nshort line", "de", "t", 0, 1, 0.5, "r"), (2002, "Short line", "de", "t", 0, 1, 0.5, "r")], SCHEMA)
    docs.union(copies).drop("__gone", "score", "rep").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.coalesce(2).write.parquet(path := str(tmp_path / stage.__name__))
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
    get = lambda k: {r["doc_id"]: r["text"] for r in seen[k]}
    # the planted words are what is toxic
    bad = {i for i, t in texts.items() if t and re.search("grumblex|snarfig|zorkle", t)}
    kept = get(0)
    assert len(bad) == 120 and len(bad & set(kept)) <= 12 and len(set(texts) - bad - set(kept)) <= 12
    assert all(kept[i] == texts[i] for i in kept)
    first, want = {}, {}
    lines = [(i, k, frozenset(WORD.findall(s.translate(LOW)))) for i in sorted(kept) for k, s in enumerate((kept[i] or "").split("\n"))]
    for i, k, s in lines:
        first.setdefault(s, (i, k))
    gone = {(i, k) for i, k, s in lines if s and min(p for o, p in first.items() if 100 * len(s & o) >= 80 * len(s | o)) < (i, k)}
    for i, t in kept.items():
        left = None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in gone)
        if left == t or WORD.search(left):
            want[i] = left
    assert get(1) == want
    sets = {i: shingles(t, 5) for i, t in want.items()}
    top = roots([(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    assert get(2) == {i: t for i, t in want.items() if top[i] == i}
    times = {r["doc_id"]: r["times"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "drop_near_copies"))).collect()}
    assert collections.Counter(r["doc_id"] for r in seen[3]) == {i: n for i, n in times.items() if n} and all(r["text"] == want[r["doc_id"]] for r in seen[3])
    t, _ = packing.tokenizer(tokens)
    size = {i: n * (1 + len(t.encode(want[i] or "", add_special_tokens=False).ids)) for i, n in times.items() if n}
    for rows in (seen[4], pipeline.run(spark, str(tmp_path)).collect()):
        total = collections.Counter()
        for r in rows:
            total[r["doc_id"]] += r["length"]
        assert total == size


def test_embeddings_in_cells(spark, monkeypatch):
    # a label of many cells, one of them so dense that it is dealt into parts: all links, and few graphs asked by a vector
    monkeypatch.setattr(embeddings, "SHARD", 100)
    r = np.random.default_rng(12)
    far = r.standard_normal((1200, 32))
    dense = far[0] + 0.2 * r.standard_normal((500, 32))
    x = np.concatenate((far, far[:300] + 0.1 * r.standard_normal((300, 32)), dense)).astype(np.float32)
    u = embeddings._unit(x.astype(float))
    near = (u @ u.T >= 0.93) & ~np.eye(len(u), dtype=bool)
    d = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(d).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()
    assert len({r["component_id"] for r in got.values()} ^ set(roots(list(zip(*np.nonzero(near))), range(len(x))).values())) <= 0.01 * len(x)
    reps = d.select(F.lit(0).cast("long").alias("lid"), F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("m"), "embedding")
    pivots = embeddings._fitted(reps)
    rows = embeddings._routed(reps, pivots, False)
    assert len(pivots[0][0]) == 20 and rows.where("not guest").count() == len(x) and rows.count() < 6 * len(x)
    assert rows.where("not guest").groupBy("cell").count().agg(F.max("count")).first()[0] > 200


def test_encode_cuts_before_marks(tokens, monkeypatch):
    # a word is encoded once, whatever marks or line follow it; what looks alike but is split otherwise has the same ids as a whole
    texts = ["word word. word, word! word\nword word.\nword", "it's. Its.'s a.b word...\n'tis don't, x2. é. é\u0301. 3.5, word.\n\nword word\n", "a\x1fb. \u2028c.", "\nword.", "word.\n", "\n", "a.\n b", "end.\u00a0", "<|endoftext|>. word<|endoftext|>"]
    t = packing.tokenizer(tokens)[0]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    sent, lines = [], packing._encode_lines
    monkeypatch.setattr(packing, "_encode_lines", lambda t, x: sent.append(x) or lines(t, x))
    ids, off = packing.encode(pa.array(texts), tokens)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    packing.encode(pa.array(["other"]), tokens)
    packing.encode(pa.array(texts[:1]), tokens)
    packing.encode(pa.array(["word two. word"]), tokens)
    assert sorted(sent[2]) == [" word", "!", ",", ".", "word"] and sent[3] == [" two"]
    for _ in range(2):
        ids, off = packing.encode(pa.array(texts[::-1] + texts), tokens)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want[::-1] + want


def test_words_are_hashed_once(monkeypatch):
    # cores are hashed for each distinct word, and words that differ in marks alone share a row
    sizes, mix = [], toxicity.C.mix
    monkeypatch.setattr(toxicity.C, "mix", lambda h: sizes.append(len(h)) or mix(h))
    w = toxicity.Words(pa.array(["word, other word " * 300, None, "Word other"]))
    assert sizes == [902, 3] and np.bincount(w.ids).tolist() == w.count.tolist() and sorted(w.count) == [300, 301, 301]
    assert len(set(w.word.tolist())) == 2
    p = toxicity.new_params()
    p["piece"] += np.random.default_rng(1).standard_normal(p["piece"].shape).astype(np.float32)
    best, begin = toxicity.highest(p, w)
    logit = toxicity.forward(p, w.inputs(p), w.window(np.arange(900 - toxicity.WINDOW + 1), np.zeros(900 - toxicity.WINDOW + 1, np.int64)))
    assert abs(best[0] - logit.max()) < 1e-4 and best[0] - logit[begin[0]] < 1e-4


def test_bytes_are_told_by_comparisons(monkeypatch):
    # every byte is of the class and case that the tables give; texts of several hash blocks have each word's own hash
    common = toxicity.C
    data = bytes(range(1, 128)) * 400 + "é ß".encode()
    text = data.decode()
    s = common.Scan(pa.array([text], pa.large_string()), lower=True)
    assert (s.data == common.LOWER[np.frombuffer(data, np.uint8)]).all() and (s.is_word == ~common.SPACE[s.data]).all()
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(s.data))
    one = {w: common.Scan(pa.array([w.decode()], pa.large_string())).word_hash()[0] for w in set(words)}
    assert s.word_hash().tolist() == [one[w] for w in words]
    # no byte is looked up in the tables of all bytes
    monkeypatch.setattr(common, "SPACE", None)
    monkeypatch.setattr(common, "LOWER", None)
    assert len(common.Scan(pa.array(["A b"]), lower=True).start) == 2


def test_toxicity_without_tanh(monkeypatch):
    # the scoring loop has no tanh, which costs most where it has no wide registers, and its logits are forward's all the same
    p = {k: v + 0.3 * np.random.default_rng(1).standard_normal(v.shape).astype(np.float32) for k, v in toxicity.new_params(3).items()}
    wide = p | {"uf": 99 * p["uf"]}
    w = toxicity.Words(pa.array([" ".join(f"w{i * i % 211}" for i in range(300)), "é" * 500 + " zz", "x" * 70 + " y"]))
    x, ids = w.inputs(p), w.ids[:300]
    want = p["piece"][w.piece].astype(np.float64)
    want = np.array([want[a : a + n].sum(0) / np.sqrt(n) for a, n in zip(w.first, w.size)])
    assert np.allclose(x[:-1, toxicity.WORD_DIM :], want, rtol=2e-5, atol=1e-5)
    at = np.arange(300 - toxicity.WINDOW + 1)[:, None] + np.arange(toxicity.WINDOW)
    logit, far = toxicity.forward(p, x, ids[at]), toxicity.forward(wide, x, ids[at])
    assert np.abs(toxicity._full_windows(wide, x, ids) - far).max() < 1e-4
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    monkeypatch.setattr(np, "tanh", None)
    assert np.abs(toxicity._full_windows(p, x, ids) - logit).max() < 1e-4
    gate = np.linspace(-toxicity.FAR, toxicity.FAR, 4001)
    odds = toxicity._odds(((gate / (1 << toxicity.SQUARES) - toxicity.MIDDLE) / toxicity.WIDTH).astype(np.float32))
    assert np.abs(1 / odds - 1 / (1 + np.exp(gate))).max() < 4e-6


def test_pipeline_shrinks_heaps(docs, spark, tokens, tmp_path):
    # a stage begins with a full collection of the executors, which here are the driver
    pipeline = pytest.importorskip("corpus_pipeline")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if re.search("Old|MarkSweep", b.getName()))
    before = full()
    out = pipeline.pack(spark, docs.select("doc_id", "text"), str(tmp_path))
    assert full() > before and out.select("doc_id").distinct().count() == docs.count()
