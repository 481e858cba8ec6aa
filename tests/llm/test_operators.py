"""Edge cases of each operator and comparison with plain-Python versions on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from larkspur.llm import decontaminate, embeddings, htmltext, langid, licenses, linededup, mixing, quality, secrets, simhash
from larkspur.llm.common import connected_components
from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000


def documents(spark, rows):
    """Rows of (doc_id, text), with the other columns of documents and one that clashes with names used inside."""
    full = [(i, t, "en", None if n % 5 == 0 else f"src{n % 3}", None if t is None else len(t), n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score int")


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (4, "Word"), (None, "a null id has this text"), (7, LONG), (8, LONG + "end"), (9, "É ñ ß 漢字 \U0001f600"), (4, "Other text")]


def test_components_of_paths_and_stars(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, None), (1, 0), (1, 0)]
    random.shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 5] + rng.standard_normal(16) * 0.1]) for i in range(60)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (301, rows[0][1]), (400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, None] + [0.0] * 14), (404, []), (405, [1.0, 2.0]), (406, [2.0, 4.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)

    def unit(v):
        ok = v and None not in v and np.isfinite(v).all() and any(v)
        return np.array(v) / np.linalg.norm(v) if ok else None

    u = [unit(v) for _, v in rows]
    link = lambda i, j: u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.9
    roots = brute.components([i for i, _ in rows], link)
    want = sorted((rows[i][0], sum(link(i, j) for j in range(len(rows)) if j != i), roots[i], rows[i][0] == roots[i]) for i in range(len(rows)))
    assert sorted(tuple(r) for r in got) == want


def test_embedding_recall_on_dense_clusters(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 128)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((600, 32)), rng.standard_normal((1, 32)) + rng.standard_normal((400, 32)) * 0.15])
    got = embeddings.near_duplicates(spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9).sum() - len(x)
    found = sum(r.n_links for r in got.collect())
    assert 0.9 * true <= found <= true


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_simhash_matches_brute_force(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(60)]
    rows = [r for r in EDGES if r[0] is not None]
    for i in range(60):
        text = [random.choice(words) for _ in range(150)]
        rows.append((100 + i, " ".join(text)))
        text[random.randrange(150)] = "changed"
        rows.append((200 + i, " \t".join(text).upper()))
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    fps = [brute.fingerprint(t) for _, t in rows]
    roots = brute.components([i for i, _ in rows], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    assert got == sorted(zip([i for i, _ in rows], fps, roots))
    assert len(set(roots)) < len(rows) - 5


def test_simhash_dedup_keeps_one_of_each_group(spark):
    kept = simhash.dedup(documents(spark, EDGES)).collect()
    fps = [brute.fingerprint(t) for _, t in EDGES]
    roots = brute.components([99 if i is None else i for i, _ in EDGES], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    assert len(kept) == len({(root, fp) if root == 4 else root for root, fp in zip(roots, fps)})
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id in (1, 2, 3, 4, 9)) == [(1, None), (4, "Other text"), (4, "Word"), (9, EDGES[8][1])]
    assert [r.text for r in kept if r.doc_id is None] == ["a null id has this text"]
    assert simhash.dedup(documents(spark, EDGES).limit(0)).count() == 0


def test_decontamination_matches_brute_force(spark):
    random.seed(7)
    words = [f"t{i}" for i in range(40)] + ["É"]
    items = [(i, " ".join(random.choice(words) for _ in range(n))) for i, n in enumerate([30, 13, 12, 5, 1, 20, 40])] + [(50, ""), (51, None), (0, "t1 t2 t3"), (60, "a " * 30)]
    docs = list(EDGES)
    for k in range(40):
        w = [random.choice(words) for _ in range(60)]
        source = (items[k % 7][1] or "").split()
        at = random.randrange(40)
        w[at : at + 20] = source[k % 3 : k % 3 + 14 + k % 8]
        docs.append((100 + k, random.choice([" ", "-", ", "]).join(w)))
    docs.append((300, "a-" * 200))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(spark, docs), table).collect()
    sha = lambda r: hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
    found = sorted(((r.id is None, r.id or 0), r.n_words, r.n_hit, len(r["items"]), sha(r)) for r in got)
    want = sorted(((d is None, d or 0), n, h, k, s) for d, n, h, k, s, _ in brute.contamination(docs, items))
    assert found == want
    assert decontaminate.contamination(documents(spark, docs), table.limit(0)).where("n_hit > 0").count() == 0
    long = {id(d) for d, x in zip(docs, brute.contamination(docs, [i for i in items if len(brute.words(i[1])) >= 13])) if x[2]}
    bad = long | {id(d) for d, x in zip(docs, brute.contamination(docs, items)) if x[-1]}
    assert decontaminate.clean(documents(spark, docs), table).count() == len(docs) - len(bad)


def test_items_that_share_a_passage(spark):
    prompt = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"{prompt} own{i} " + " ".join(f"q{i}x{j}" for j in range(14))) for i in range(60)] + [(99, "p3")]
    docs = [(1, f"start {prompt} end"), (2, items[7][1]), (3, "p3 p4"), (4, "nothing")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(documents(spark, docs), table).collect()
    found = sorted((r.id, r.n_words, r.n_hit, len(r["items"])) for r in got)
    assert found == sorted(x[:4] for x in brute.contamination(docs, items))
    nameless = spark.createDataFrame([(None, prompt)], "item_id long, text string")
    assert [(r.n_hit, r["items"]) for r in decontaminate.contamination(documents(spark, docs[:1]), nameless).collect()] == [(30, [])]


def test_clean_carries_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 4), (2, "z", 1, 2, 3, 4)], "doc_id long, text string, id int, th int, own int, doc int")
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.clean(docs, items).collect()] == [(2, "z", 1, 2, 3, 4)]


def test_words_that_collide_under_polynomials():
    swap = str.maketrans("ab", "ba")
    thue = "a"
    for _ in range(10):
        thue += thue.translate(swap)
    text = f"{thue} {thue.translate(swap)} Abc abc abcdefgh abcdefghi abcdefg".encode()
    h, rows = decontaminate.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(h) == 7 and len(set(h.tolist())) == 6 and h[2] == h[3] and rows.tolist() == [0, 7]


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mixing_meets_targets(spark):
    random.seed(9)
    rows = [(i, "w " * random.randint(0, 30)) for i in range(900)] + EDGES
    docs = documents(spark, rows)
    found = mixing._with_shards(*mixing.plan(docs)).collect()
    assert len(found) == len(rows)
    sizes = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = water(sizes)
    for s in sizes:
        some = [r for r in found if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sizes[s] for r in some)
        taken = sum(len(r.shards) * r.size for r in some)
        # only whole documents are taken, so a source may miss its target by its largest one
        assert abs(taken - target[s]) <= max(30, 0.02 * target[s], max(r.size for r in some)), (s, taken, target[s])
    assert max(len(r.shards) for r in found) <= 2
    again = mixing._with_shards(*mixing.plan(docs.repartition(7))).collect()
    key = lambda r: (r.id is None, r.id, r.key, sorted(r.shards))
    assert sorted(map(key, found), key=str) == sorted(map(key, again), key=str)
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(len(r.shards) for r in found) and mixed.columns == [*docs.columns, "shard", "place"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_splitting_tree_keeps_totals(spark):
    got = mixing.split(spark.createDataFrame([(0, 100), (1, 0), (2, 37), (3, 1)], "nr long, quota long")).collect()
    by = {k: sum(r.quota for r in got if r.nr == k) for k in range(4)}
    assert by == {0: 100, 1: 0, 2: 37, 3: 1} and min(r.quota for r in got) >= 0
    shards = [sum(r.quota for r in got if r.shard == s) for s in range(8)]
    assert sum(shards) == 138 and max(shards) - min(shards) <= 3


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    found = langid.identify(docs, model).where(langid.held_out("doc_id")).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    edge = {r.text: (r.lang_pred, r.score) for r in langid.identify(documents(spark, EDGES), model).collect()}
    assert edge[None] == edge[""] == edge[" \n\t "] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in edge.values())
    texts = {r.lang: r.text for r in found if 500 < len(r.text) < 4000}
    mixed = dict(model.mixture(texts["en"][:400] + texts["de"][:400]))
    assert {"en", "de"} <= mixed.keys()
    assert langid.identify(documents(spark, EDGES).limit(0), model).count() == 0
    nothing = langid.fit(documents(spark, EDGES).where("false"))
    assert {r.lang_pred for r in langid.identify(documents(spark, EDGES), nothing).collect()} == {"und"}


def test_quality_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out("doc_id")).collect()
    assert sum((r.score >= quality.CUT) == (r.quality == 1) for r in found) >= 0.93 * len(found)
    edge = quality.score(documents(spark, EDGES), model).collect()
    assert len(edge) == len(EDGES) and all(0 <= r.score <= 1 for r in edge)
    assert quality.score(documents(spark, EDGES).limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(documents(spark, EDGES), none).collect()} == {0.5}


def test_secrets_match_brute_force(spark):
    texts = ["password = 'abc123'; PASSWD:xyz", 'api_key="short" token: ' + "f" * 30, "AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 5, "ſecret = abcdefgh", "é" * 7 + " secret=abcdef\U0001f600token=123456", "x\u0001token=abcdefg", "deadbeef" * 3 + "G" + "0" * 24, "tokentoken=secret=12345678"]
    rows = [(i, t) for i, t in enumerate(texts)] + EDGES
    table = secrets.train(secrets.samples(documents(spark, rows)))
    got = secrets.scan(documents(spark, rows), table).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = sorted((s.start, s.kind, s.end) for k in ("assign", "access", "hex") for s in r[k])
        written = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (len(r.assign), len(r.access), len(r.hex), written) == brute.secrets(r.text)


def test_many_secrets_in_one_text(spark):
    """More matches than are summed at a time, of three kinds, and random runs between them."""
    rng = random.Random(4)
    some = ["password=abcdef12", "AKIA" + "Z9" * 10, "0123456789abcdef" * 2, "aB3xK9qLm2Zt7RwP", "plain words here", "tokén"]
    text = " ".join(rng.choice(some) for _ in range(4000))
    docs = documents(spark, [(1, text)]).selectExpr("*", "1 AS t", "2 AS doc", "3 AS runs", "4 AS hex")
    (got,) = secrets.scan(docs, [1.0] * 16384).collect()
    spans = sorted((s.start, s.kind, s.end) for k in ("assign", "access", "hex") for s in got[k])
    written = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert (len(got.assign), len(got.access), len(got["hex"]), written) == brute.secrets(text)
    runs = [m.span() for m in re.finditer(secrets.RUN, text) if re.search("[0-9]|.[A-Z]", m[0])]
    free = [(a, b) for a, b in runs if not any(s < b and a < e for s, _, e in spans)]
    assert len(free) > 500 and [(s.start, s.end) for s in got.random] == free
    assert (got.t, got.doc, got.runs) == (1, 2, 3)
    assert secrets.scan(docs.limit(0), [1.0] * 16384).count() == 0


def test_markov_models_tell_random_strings(spark):
    docs = spark.createDataFrame([(1, "the getUserNameByIdentifier2 and SOME_CONSTANT_NAME_2"), (2, "key is Xk29fQpL0vZr81TnYw3Bq7"), (3, "aGVsbG8gd29ybGQgdGhpcyBpcw==")], "doc_id long, text string")
    table = secrets.train(secrets.samples(docs))
    got = {r.doc_id: [(s.start, s.end) for s in r.random] for r in secrets.scan(docs, table).collect()}
    assert got == {1: [], 2: [(7, 29)], 3: [(0, 28)]}


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain &amp; simple", "plain & simple"),
        ("<nav>menu</nav><article><h1>T</h1><p>a  <b>b</b>\nc<p>d</article><footer>f</footer>", "T\na b c\nd"),
        ("<body><div class='cookie-notice'>c</div><main><p>x<script>var a='<p>no</p>'</script>y</p><ul><li>1<li>2</ul></main><div id=comments><p>nice</p></div>", "xy\n1\n2"),
        ("<article><p>cut &lt;off", "cut <off"), ("<article><p>a<!-- <p>b --><br>c</p></article", "a\nc"),
    ],
)
def test_html_text(page, want):
    assert htmltext.extract(page) == want


def test_wrappers_of_hosts(spark):
    article = lambda n: f"<html><div class=top>Site name</div><div class=x><p>{n} first words</p><p>{n} more</p></div><div class=end>All about us</div></html>"
    rows = [(i, f"http://www.a.com/{i}", article(i)) for i in range(8)] + [(20, None, None), (21, "x", ""), (22, "http://b.com", "<article><p>only</p></article>"), (22, "http://b.com", "<article><p>only</p></article>")]
    got = htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == {i: f"{i} first words\n{i} more" for i in range(8)} | {20: "", 21: "", 22: "only"}
    assert htmltext.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("tag, want", [("<div>", "x\n" * 99_999 + "x"), ("<i>", "x" * 100_000), ("<span class=ad>", ""), ("<p>", "x\n" * 99_999 + "x")])
def test_deep_pages(tag, want):
    assert htmltext.extract(f"<article>{(tag + 'x') * 100_000}</b></i>") == want


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://a.com", "<article><p>one</p></article>", 5, 6, 7, 8)] * 2
    got = htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int, host int, paths int, h int")).collect()
    assert [(r.page_id, r.host, r.paths, r.h, r.text) for r in got] == [(1, 6, 7, 8, "one")] * 2


def extracted(spark, rows):
    return {r.page_id: r.text for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_text_inside_articles(spark):
    rows = [(i, f"http://a.com/{i}", f"<article><h1>Title {i}</h1><p>Read all about it every day.</p><p>{i} own text</p><p>and more {i}</p></article>") for i in range(6)]
    assert extracted(spark, rows) == {i: f"Title {i}\n{i} own text\nand more {i}" for i in range(6)}


def test_layouts_and_single_pages_keep_their_text(spark):
    plain = lambda n: f"<div class=top>Site name</div><h1>Head {n}</h1><div class=x><p>{n} words</p></div>"
    rows = [(i, "http://a.com/", f"<article><p>{i} text</p></article>") for i in range(4)] + [(i, "http://a.com/", plain(i)) for i in range(10, 13)] + [(20, "http://b.com/", plain(20))]
    want = {i: f"{i} text" for i in range(4)} | {i: f"Head {i}\n{i} words" for i in range(10, 13)} | {20: "Site name\nHead 20\n20 words"}
    assert extracted(spark, rows) == want


def test_wrappers_count_all_pages_and_blocks(spark):
    linked = lambda n: f"<div class=rare><a>{n} a link</a> {n}</div>"
    plain = lambda n: f"<div class=rare>{n} words without any link, and many more of them</div>"
    page = lambda n, end="": f"<div class=x><p>{n} words</p></div>{end}"
    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(400)] + [(400, "http://a.com/400", page(400, linked(400)))] + [(i, f"http://a.com/{i}", page(i, plain(i))) for i in range(401, 404)]
    got = extracted(spark, rows)
    assert got[400] == "400 words\n400 a link 400" and got[402] == "402 words\n402 words without any link, and many more of them" and got[7] == "7 words"
    # a slot behind many blocks counts like any other
    many = lambda n, end: "".join(f"<p>{n} {i}</p><h2>{n} {i}</h2>" for i in range(2100)) + end
    got = extracted(spark, [(0, "http://b.com/0", many(0, linked(0))), *((i, f"http://b.com/{i}", many(i, plain(i))) for i in range(1, 4))])
    assert got[0].endswith("0 a link 0") and got[0].count("\n") == 4200


def test_licenses_and_inheritance(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "x = 1"), (3, "z/y.py", "x = 1"), (4, None, None), (5, "a/b/d.c", "code " * 20 + "\nLicensed under the Apache License, Version 2.0.\nint main"), (6, "a/b/LICENSE", "All rights reserved."), (7, "a/e.py", ""), (7, "a/e.py", "")]
    got = sorted((r.id, r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect() if r.license)
    assert got == [(1, "MIT", "file"), (2, "proprietary", "inherited"), (5, "Apache-2.0", "header"), (6, "proprietary", "file"), (7, "MIT", "inherited"), (7, "MIT", "inherited")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    near = line.replace("today", "todey")
    rows = [(2, f"{line}\nshort line\nanother line that is quite different from any of the rest"), (1, f"intro\n{line.upper()}  \n{line}"), (3, "short line\n" + line), (3, "short line\n" + line), (None, line), (5, None), (6, ""), (7, "\n\n")]
    got = linededup.dedup_lines(documents(spark, rows)).collect()
    by = {(r.doc_id, r.n_lines_removed): r.text for r in got}
    assert by[(1, 1)] == f"intro\n{line.upper()}  " and by[(2, 1)] == "short line\nanother line that is quite different from any of the rest"
    assert [r.text for r in got if r.doc_id == 3 and r.n_lines_removed == 2] == ["", ""] and by[(None, 1)] == "" and by[(5, 0)] is None and by[(6, 0)] == "" and by[(7, 0)] == "\n\n"
    assert len(got) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert linededup.dedup_lines(documents(spark, rows).limit(0)).count() == 0
    pair = spark.createDataFrame([(line, near), (line, line[:30]), ("", ""), ("a" * 5000, "b" * 5000), ("x" + line * 40, line * 40)], "p string, q string")
    assert [r.s for r in pair.select(linededup._similar("p", "q").alias("s")).collect()] == [True, False, True, False, True]


def test_edit_similarity_of_long_lines_is_exact(spark):
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghij ", k=1200))
    moved = text[:300] + "a phrase put in here, of forty letters" + text[300:700] + "X" + text[701:]
    pair = spark.createDataFrame([(text, moved), (text, "".join(rng.choices("klmnopqrst ", k=1200)))], "p string, q string")
    assert [r.s for r in pair.select(linededup._similar("p", "q").alias("s")).collect()] == [True, False]


def test_lines_that_differ_in_white_space(spark):
    line = "several words that are parted by something"
    rows = [(1, line), (2, line + "\r\nother"), (3, line.replace(" ", "\t")), (4, line.replace(" ", "\u00a0"))]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: line, 2: "other", 3: "", 4: ""}


def test_lines_without_blanks(spark):
    line = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65"
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, [(1, line), (2, "x\n" + line)])).collect()}
    assert got == {1: line, 2: "x"}


def edit_distance(p, q):
    row = list(range(len(q) + 1))
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(q, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_lines_with_a_changed_word(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(3000)]
    rows, close = [], 0
    for i in range(300):
        line = rng.choices(words, k=rng.choice((8, 12, 15, 20, 30)))
        near = list(line)
        near[rng.randrange(len(near))] = rng.choice(words)
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(near))]
        close += edit_distance(rows[-2][1], rows[-1][1]) <= 0.2 * max(len(rows[-2][1]), len(rows[-1][1]))
    gone = sum(r.n_lines_removed for r in linededup.dedup_lines(documents(spark, rows)).collect())
    assert close > 200 and 0.9 * close <= gone <= close, (close, gone)


MIT_FILE = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the 'Software'), to
deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED 'AS IS',
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_whole_license_files(spark):
    notice = "# Redistribution and use in source and\n# binary forms, with or without modification, are\n# permitted provided that the following conditions are met:"
    code = "\n".join(f"value{i} = compute{i}(first{i}, second{i})" for i in range(40))
    rows = [(1, "a/LICENSE", MIT_FILE), (2, "a/b/x.py", "x = 1"), (3, "c/y.py", f"{code}\n{notice}\n{code}")]
    got = sorted((r.id, r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == [(1, "MIT", "file"), (2, "MIT", "inherited"), (3, "BSD", "header")]
    idf = dict.fromkeys(licenses.FULL_VOCABULARY, 1.0)
    for name, count in licenses.FULL:
        found, is_file = licenses.Scanner(idf, 8.0).scan("\n".join(" ".join([w] * n) for w, n in count.items()))
        assert (found[0][0], is_file) == (name, True)


def plain_simhash(line):
    """The 56-bit SimHash of a line's distinct words, from the engine's word hashes given as a dict."""
    words = set(line.split())
    return lambda h: sum(1 << k for k in range(56) if 2 * sum(h[w] >> 8 >> k & 1 for w in words) > len(words))


def test_line_simhash_matches_plain_count(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(4 * n)}" for _ in range(n))) for i, n in enumerate([5, 6, 20, 126, 127, 128, 129, 255, 300, 2000] * 3)]
    words = sorted({w for _, t in rows for w in t.split()})
    from pyspark.sql import functions as F

    h = {r.w: r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = {r.id: r.fp for r in linededup.occurrences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_simhash(t)(h) for i, t in rows}


def test_exact_copies_of_lines_of_any_length_go(spark):
    rows = [(1, "Les.\n\nend"), (2, "les.\n\nEND \n" + "x" * 70000), (3, "x" * 70000), (4, "LES.")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: "Les.\n\nend", 2: "\n" + "x" * 70000, 3: "", 4: ""}


def test_no_pair_of_lines_is_compared_twice(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows, seen, verify = [], [], linededup.verify
    for _ in range(10):
        # half of the letters differ, while most words are common
        common = [word(12), word(11), *(word(3) for _ in range(6))]
        rows += [(len(rows) + i, " ".join([*common, word(10), word(10), word(10)])) for i in range(10)]
    monkeypatch.setattr(linededup, "verify", lambda pairs, texts: seen.append([(r.a, r.b) for r in pairs.collect()]) or verify(pairs, texts))
    assert sum(r.n_lines_removed for r in linededup.dedup_lines(documents(spark, rows)).collect()) == 0
    pairs = [pair for found in seen for pair in found]
    assert len(pairs) > 20 and len(pairs) == len(set(pairs))


def test_odd_white_space_and_scripts_of_all_kinds(spark):
    line = "several words that are parted by something"
    wide = [*range(0x2000, 0x200B), 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *b"\t\r\f\x0b\x1c\x1d\x1e\x1f"]
    rows = [(0, line), *((i, line.replace(" ", chr(c))) for i, c in enumerate(wide, 1))]
    assert {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, rows)).collect()} == {0: line, **dict.fromkeys(range(1, len(rows)), "")}
    scripts = [0xE00, 0xEFF, 0x1000, 0x109F, 0x1780, 0x17FF, 0x3005, 0x3007, 0x3040, 0x30FF, 0x3400, 0x9FFF, 0xF900, 0xFAFF, 0x20000, 0x3FFFF]
    lines = spark.createDataFrame([(i, 3 * chr(c)) for i, c in enumerate(scripts)], "id int, line string")
    assert {r.n for r in lines.select(linededup.F.size(linededup._words("line")).alias("n")).collect()} == {3}


def test_only_keys_and_lines_are_shuffled_and_no_hash_is_kept_while_texts_are_compared(spark, monkeypatch):
    from larkspur.llm import common

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    rows = [(i, " ".join(word() for _ in range(9))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(5)]
    written, kept, write, verify = [], [], linededup.durable, linededup.verify
    monkeypatch.setattr(linededup, "durable", lambda df: written.append(write(df)) or written[-1])
    monkeypatch.setattr(linededup, "verify", lambda pairs, texts: kept.append([t.columns for t in written if t in common._PATHS]) or verify(pairs, texts))
    assert sum(r.n_lines_removed for r in linededup.dedup_lines(documents(spark, rows)).collect()) == 5
    assert ["key", "lid"] in [t.columns for t in written]
    assert kept and not any("fp" in columns for tables in kept for columns in tables)


def test_lines_of_a_key_meet_by_classes_of_length(spark):
    from pyspark.sql import functions as F

    sizes = [round(20 * 1.06**i) for i in range(120)] + [5, 4, 10, 8, 100, 80, 125, 1000, 800, 100000, 80000]
    posted = spark.createDataFrame([(7, lid, (0, lid, n)) for lid, n in enumerate(sizes)], "key long, lid long, x struct<fp: long, lid: long, chars: int>")
    met = [tuple(sorted(r)) for r in linededup.meetings(posted).select("p.lid", "q.lid").collect()]
    close = {(a, b) for a in range(len(sizes)) for b in range(a + 1, len(sizes)) if abs(sizes[a] - sizes[b]) <= int(max(sizes[a], sizes[b]) * 0.2 + 1e-9)}
    assert len(met) == len(set(met)) and close <= set(met) and len(met) < len(sizes) ** 2 / 10
    # what is joined with itself are postings, without texts or words
    kept, write = [], linededup.durable
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    common = [word(12), word(11), *(word(3) for _ in range(6))]
    rows = [(i, " ".join([*common, word(10), word(10), word(10)])) for i in range(10)]
    linededup.durable = lambda df: kept.append(write(df)) or kept[-1]
    try:
        linededup.dedup_lines(documents(spark, rows)).select(F.count("*")).collect()
    finally:
        linededup.durable = write
    assert not any({"key", "words"} <= set(table.columns) for table in kept)


def test_lines_that_share_a_passage_are_joined_by_their_words_and_no_close_pair_is_lost(spark, monkeypatch):
    from itertools import combinations

    from pyspark.sql import functions as F

    rng = random.Random(12)
    word = lambda low, high: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(low, high)))
    passage = " ".join(word(7, 11) for _ in range(30))
    texts = [" ".join([*(word(2, 6) for _ in range(rng.randint(3, 24))), passage]) for _ in range(120)]
    docs = documents(spark, list(enumerate(texts)))
    lines = linededup.line_table(linededup.occurrences(docs)).localCheckpoint()
    words = {r.lid: set(texts[r.id0].split()) for r in lines.collect()}
    need = lambda p, q: 0.7 * max(len(p), len(q)) - 1
    shared = {(a, b) for a, b in combinations(sorted(words), 2) if len(words[a] & words[b]) >= need(words[a], words[b])}
    joined, write = [], linededup.durable
    monkeypatch.setattr(linededup, "durable", lambda df: joined.append(t.count()) or t if (t := write(df)).columns == ["a", "b"] else t)
    groups = {r.node: r.root for r in linededup.fuzzy_groups(lines, linededup.posts(lines), docs, "doc_id", "text").collect()}
    assert 20 < len(groups) < 110 and sum(joined) < len(shared) < len(texts) * (len(texts) - 1) / 4, (len(groups), joined, len(shared))
    # whatever is in different groups is apart: all lines share their longest runs, so that all pairs have a key
    p = lines.join(docs, F.col("id0") == F.col("doc_id")).select("lid", F.struct("fp", "chars").alias("x"), "text", F.transform(linededup._words("text"), lambda w: F.hash(w)).alias("words"))
    met = p.toDF("a", "x", "p", "v").join(p.toDF("b", "y", "q", "w"), F.col("a") < F.col("b")).where(linededup._close(F.col("x"), F.col("y")))
    met = met.where((F.size(F.array_intersect("v", "w")) >= 0.7 * F.greatest(F.size("v"), F.size("w")) - 1) & linededup._similar("p", "q")).select("a", "b").collect()
    assert len(met) > 100 and all(groups.get(r.a, r.a) == groups.get(r.b, r.b) for r in met)


def test_word_maps_tell_no_pair_apart_that_shares_enough(spark):
    from pyspark.sql import functions as F

    rng = random.Random(13)
    rows = []
    for i in range(300):
        n, out = rng.choice((5, 6, 10, 30, 80, 500, 2000)), rng.random() * 0.6
        words = [rng.randrange(-(2**31), 2**31) for _ in range(n)]
        rows += [(2 * i, words), (2 * i + 1, [rng.randrange(-(2**31), 2**31) if rng.random() < out else w for w in words][: rng.randint(n // 2, n)])]
    texts = spark.createDataFrame(rows, "lid long, words array<int>").withColumn("words", F.array_distinct("words")).localCheckpoint()
    maps = linededup.word_maps(texts).select("lid", F.struct("n", *linededup.MAP_COLS).alias("x"))
    x = maps.join(texts, "lid")
    pairs = x.where("lid % 2 = 0").toDF("a", "x", "v").join(x.where("lid % 2 = 1").toDF("b", "y", "w"), F.col("b") == F.col("a") + 1)
    got = pairs.select(linededup._shared("v", "w").alias("shared"), linededup._may_share(F.col("x"), F.col("y")).alias("may"), F.size("v").alias("n")).collect()
    assert len(got) == 300 and all(r.may for r in got if r.shared) and sum(r.shared for r in got) > 50
    assert sum(r.may for r in got if not r.shared and r.n <= 80) < 0.3 * sum(not r.shared for r in got if r.n <= 80)
