"""Operators over many rows: near duplicates, page differencing, the pipeline."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from lzseq.llm import neardup, pages

from .helpers import ODD, prose, table


def brute(texts, words):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def copies(rng):
    """Texts with exact copies, groups of near copies around the threshold, chains and short ones."""
    texts = [prose(rng, rng.choice([1, 2, 3, 8, 60, 150])) for _ in range(60)]
    for base in texts[40:50]:
        for _ in range(12):
            w = base.split()
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    chain = prose(rng, 100).split()
    for _ in range(12):
        chain[rng.randrange(100)] = prose(rng, 1)
        chain[rng.randrange(100)] = prose(rng, 1)
        texts.append(" ".join(chain))
    texts += [texts[5].upper(), texts[6] + "  ", texts[7].replace(" ", "\n")] * 4
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("words, block", [(2, 512), (2, 7), (5, 512)])
def test_components_equal_brute_force(spark, monkeypatch, words, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    if block == 7:
        monkeypatch.setattr(neardup, "BROADCAST_LABELS", 0)
        monkeypatch.setattr(neardup, "HOT_ROWS", 8)
    texts = copies(random.Random(words)) + ODD
    n, component = brute(texts, words)
    got = {r.doc_id: r for r in neardup.near_duplicates(table(spark, texts), words).collect()}
    assert len(got) == len(texts)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(n[i], component[i], component[i] == i) for i in range(len(texts))]


def test_very_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    base = prose(rng, 90_000)
    texts = [base + f" tail {i}" for i in range(12)] + [base.upper(), "x" * 3_000_000, prose(rng, 90_000)]
    plain = [(r.doc_id, r.component_id) for r in neardup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()]
    assert plain == [(i, 0 if i < 13 else i) for i in range(15)]
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 1 << 20)  # a block for each text
    assert [(r.doc_id, r.component_id) for r in neardup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()] == plain


def test_hot_group_of_copies(spark):
    rng = random.Random(1)
    base = prose(rng, 80)
    texts = [base] * 300 + [base + " " + prose(rng, 1) for _ in range(300)] + [prose(rng, 80) for _ in range(50)]
    got = neardup.near_duplicates(table(spark, texts)).collect()
    assert Counter(r.component_id for r in got)[0] == 600 and sum(r.kept for r in got) == 51


def test_rows_of_a_hot_group_are_sent_a_few_times(spark, monkeypatch):
    rng = random.Random(4)
    base = prose(rng, 60)
    texts = [base + " " + prose(rng, 2) for _ in range(700)] + [prose(rng, 60) for _ in range(20)]
    sent = []
    compared = neardup.compared
    monkeypatch.setattr(neardup, "BLOCK", 20)
    monkeypatch.setattr(neardup, "compared", lambda dealt, data, kind: sent.append((kind.__name__, dealt.count())) or compared(dealt, data, kind))
    got = neardup.near_duplicates(table(spark, texts)).collect()
    assert Counter(r.component_id for r in got)[0] == 700 and sum(r.kept for r in got) == 21
    assert sum(n for kind, n in sent if kind == "FullSets") < 3 * 700 < 700 * 700 / 20  # pairs of blocks would be 35 times as many


def test_edges_of_tables(spark):
    assert neardup.near_duplicates(table(spark, ["a"]).limit(0)).count() == 0
    docs = table(spark, ["a b c", "a b c", None, "q r s", "a b c"], ids=[5, 3, 9, None, 3])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (3, 3, True), (3, 3, True), (5, 3, False), (9, 9, True)]
    left = neardup.unique(docs, 2)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "3", "9", "None"]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    hashes = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.9, 1.0):
        for n in (5, 50, 2000):
            common, extra = hashes(max(1, int(n * share))), n - max(1, int(n * share))
            a, b = np.concatenate([common, hashes(extra // 2)]), np.concatenate([common, hashes(extra - extra // 2)])
            ka, kb = neardup.sketch(a), neardup.sketch(b)
            assert (neardup.merged(ka, kb) == neardup.sketch(np.concatenate([a, b]))).all()
            j = len(common) / (len(common) + extra)
            got = neardup.likeliest_similarity(ka[None], kb[None], np.array([len(a)]), np.array([len(b)]))[0]
            errors.append(abs(got - j))
    assert max(errors) < 0.17 and np.mean(errors) < 0.05
    assert (neardup.sketch(np.empty(0, np.uint64)) == 0).all()


# Pages


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = (rng.choices(range(6), k=rng.randint(0, 14)) for _ in range(2))
        for most in (1 << 27, 16):
            got = pages.shared_lines(a, b, most)
            it = iter(b)
            assert len(got) == lcs(a, b) and all(any(x == a[i] for x in it) for i in sorted(got))


PAGE = '<html><head><title>no</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/x">no</a></ul></nav><div class="ad">no</div><header>no</header><article><header><h1>Title &amp; more</h1></header><p><b>First</b>   line&nbsp;here<br>next<p>Sec<i>ond</i><!-- no --><div class="comments"><p>no</div><form>no</form></article><aside>no</aside><footer>&copy; no</footer></body></html>'


def text_alone(page):
    return pages.main_text(page)[0]


def test_marked_article():
    assert text_alone(PAGE) == "Title & more First line here next Second"
    assert text_alone("") == "" and text_alone("plain &lt; text") == "plain < text" and text_alone("<p>a<p>b<") == "a b<"
    assert text_alone("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert text_alone('<p title="a > b">x</p><p title="open>y</p>') in ("x", "x y")
    assert text_alone("<ul><li class='menu'>no<li>yes</ul>") == "yes"


def test_units_of_a_page():
    page = pages.lines_of("<nav><ul><li>a<li>b</ul></nav><div class='ad'>x</div><p>y<div class='ad'>z</div><article><p>w")
    texts, paths, kinds = units = pages.units_of(page)
    assert page.said == list("abxyzw") and kinds == b"tttcta" and paths[0] == paths[1] != paths[2] == paths[4]
    other = pages.units_of(pages.lines_of("<nav><ul><li>c</ul></nav><div class='ad'>new</div>"))
    assert pages.unshared(units, other) == [3, 4] and pages.unshared(units) == [0, 1, 2, 3, 4] and pages.unshared(units, other, by_path=False) == [0, 1, 2, 3, 4]
    own = pages.own_texts(units)
    assert own == (texts[3], texts[5]) and pages.covers([*texts, 5], own) and not pages.covers(other[0], own) and not pages.covers(other[0], ())


def test_rotating_template_without_names(spark):
    """Neither element names nor classes say what is template, and no two pages share a line."""
    rng = random.Random(12)
    story = {i: [prose(rng, 3), *(prose(rng, rng.randint(4, 40)) for _ in range(rng.randint(3, 6)))] for i in range(60)}
    block = lambda words: f"<div>{words}</div>"

    def page(i):
        menu = "<div><ul>" + "".join(f"<li><a href='/x'>{prose(rng, 1)} {i}</a></li>" for _ in range(rng.randint(4, 7))) + "</ul></div>"
        said = "<div>" + f"<h1>{story[i][0]}</h1>" + "".join(f"<p>{x}</p>" for x in story[i][1:]) + "</div>"
        return f"<html><body>{menu}{block(prose(rng, 8))}{said}<div><ul><li>{prose(rng, 2)}</li></ul></div>{block(prose(rng, 5))}</body></html>"

    data = [(i, f"http://h{i % 3}.org/a/{i}", page(i)) for i in range(60)]
    got = {r.page_id: r for r in pages.extract(rows_of(spark, data)).collect()}
    assert all(got[i].text == " ".join(story[i]) and got[i].n_marked == 0 for i in range(60))
    alone = {r.page_id: r.text for r in pages.extract(rows_of(spark, data), by_path=False).collect()}
    assert all(len(alone[i]) > len(got[i].text) for i in range(60))


@pytest.mark.parametrize("partitions", [1, 7])
def test_growing_threads_wait_within_bounds(spark, partitions, monkeypatch):
    """Each page has all of the page before it."""
    lines = [f"<p>Reply number {i} says {prose(random.Random(i), 4)}</p>" for i in range(80)]
    data = [(i, f"http://h.org/t/{i}", f"<body><div>Best site in town</div>{''.join(lines[: i + 1])}</body>") for i in range(80)]
    calls = [0]
    plain = pages.covers
    monkeypatch.setattr(pages, "covers", lambda *a: calls.__setitem__(0, calls[0] + 1) or plain(*a))
    rows = [{"host": "h", "part": 0, "mark": i, **dict(zip(("texts", "paths", "kinds"), pages.units_of(pages.lines_of(h))))} for i, _, h in data]
    import pyarrow as pa

    out = [r for b in pages.walk(False, True)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    assert calls[0] <= pages.WAITING * len(data) and {r["mark"] for r in out if r["mark"] is not None} == set(range(80))
    monkeypatch.undo()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r.page_id: r.text for r in pages.extract(rows_of(spark, data)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 80 and all(f"Reply number {i} " in got[i] for i in range(80))


def test_every_content_of_a_long_thread_waits_for_its_page():
    """A page that has none of the thread ends it: all pages before are compared with that one, however many."""
    import pyarrow as pa

    lines = [f"<p>Reply number {i} says {prose(random.Random(i), 4)}</p>" for i in range(90)]
    made = [f"<body><div>Best site in town</div>{''.join(lines[: i + 1])}</body>" for i in range(90)] + ["<body><div>Best site in town</div><p>Something else</p></body>"]
    units = [pages.units_of(pages.lines_of(h)) for h in made]
    rows = [{"host": "h", "part": 0, "mark": i, **dict(zip(("texts", "paths", "kinds"), u))} for i, u in enumerate(units)]
    out = [r for b in pages.walk(False, True)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    left = {r["mark"]: r["left"] for r in out if r["left"]}
    assert set(left) == set(range(90)) and all(left[i] == pages.unshared(units[i], units[90], True) for i in range(90))
    assert left[0] != pages.unshared(units[0], None, True)


def rows_of(spark, data):
    return spark.createDataFrame([(i, u, h, *"xyzabcd") for i, u, h in data], "page_id long, url string, html string, text string, host string, mark string, left string, end string, kinds string, part string").repartition(5)


def test_template_of_pages_without_marks(spark):
    make = lambda words: f"<body><div>Best site in town</div><div><h2>{words[0]}</h2><p>{words[1]}</p></div><div>All rights kept by us</div></body>"
    rng = random.Random(3)
    text = {i: (prose(rng, 3), prose(rng, 20)) for i in range(40)}
    data = [(i, f"http://www.a.org/en/{i}.html?x=1", make(text[i])) for i in range(40)] + [(100, "http://b.org/1", make(text[0])), (101, None, None), (102, "", ""), (103, "http://a.org/en/3", make(text[3]))]
    got = {r.page_id: r for r in pages.extract(rows_of(spark, data)).collect()}
    assert len(got) == len(data)
    for i in range(40):
        assert got[i].text == " ".join(text[i]) and got[i].n_chars == len(got[i].text)
    assert got[100].text.startswith("Best site") and got[101].text == got[102].text == ""
    assert got[103].text == " ".join(text[3])  # beside a copy of itself, the other neighbour tells


def test_marked_pages_keep_shared_articles_whole(spark):
    data = [(i, f"http://h.org/{i}", PAGE) for i in range(30)] + [(7, "http://h.org/7", PAGE)]
    got = pages.extract(rows_of(spark, data)).collect()
    assert len(got) == 31 and {r.text for r in got} == {"Title & more First line here next Second"}
    assert pages.extract(rows_of(spark, data).limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 9])
def test_differencing_against_brute_force(spark, partitions):
    rng = random.Random(8)
    slots = [("nav", "<nav><a>{}</a></nav>"), ("ad", "<div class='ad'>{}</div>"), ("free0", "<div>Read more on our site</div>"), ("free1", "<h2>Latest from the desk</h2>"), ("free2", "<p>All rights kept</p>"), ("foot", "<footer>{}</footer>")]
    data, want = [], {}
    for host in range(6):
        made = []
        for i in range(1 if host == 0 else 25):
            taken = sorted(rng.sample(range(6), rng.randint(0, 6)))
            story = prose(rng, 15)
            at = len(data)
            made.append((at, taken, story))
            body = "".join(slots[k][1].format(prose(rng, 2)) for k in taken if k < 3) + (f"<article><p>{story}</p></article>" if i % 2 else f"<p>{story}</p>") + "".join(slots[k][1].format(prose(rng, 2)) for k in taken if k >= 3)
            data.append((at, f"https://h{host}.org/a/{i}", f"<body>{body}</body>"))
        for n, (at, taken, story) in enumerate(made):
            near = {k for m in (n - 1, n + 1) if 0 <= m < len(made) for k in made[m][1]}
            kept = [k for k in taken if k not in near]
            words = {2: "Read more on our site", 3: "Latest from the desk", 4: "All rights kept"}
            text = [*(words[k] for k in kept if k == 2), story, *(words[k] for k in kept if k in (3, 4))]
            want[at] = (" ".join(text), len(taken) - len(kept), sum(k in (0, 1, 5) for k in kept))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r.page_id: (r.text, r.n_shared, r.n_marked) for r in pages.extract(rows_of(spark, data)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and sum(x[1] for x in want.values()) > 200


def test_unmarked_lines_of_marked_pages_are_differenced(spark):
    make = lambda i: f"<body><div>Best site in town</div><p>Standfirst {i}</p><article><p>Read our rules</p><p>Story {i}</p></article><p>Correction {i}</p><div>All rights kept by us</div></body>"
    data = [(i, f"http://h.org/{i}", make(i)) for i in range(30)] + [(99, "http://single.org/", make(99))]
    got = {r.page_id: r.text for r in pages.extract(rows_of(spark, data)).collect()}
    assert all(got[i] == f"Standfirst {i} Read our rules Story {i} Correction {i}" for i in range(30))
    assert got[99] == "Best site in town Standfirst 99 Read our rules Story 99 Correction 99 All rights kept by us"


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_copies_in_a_row_are_passed_over(spark, partitions):
    make = lambda words, more="": f"<body><div>Best site in town</div><p>{words}</p>{more}<div>All rights kept by us</div></body>"
    rng = random.Random(5)
    story, other = prose(rng, 12), [prose(rng, 12) for _ in range(4)]
    data = [(i, f"http://h.org/b/5?session={i}", make(story, "<p>print</p>" if i % 7 == 3 else "")) for i in range(60)]
    data += [(100 + i, f"http://h.org/{'ac'[i // 2]}/{i}", make(other[i])) for i in range(4)] + [(200 + i, "http://copies.org/", make(story)) for i in range(9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.page_id: r.text for r in pages.extract(rows_of(spark, data)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    plain = [i for i in range(60) if i % 7 != 3]
    assert all(got[i] == story for i in plain)
    assert all(got[100 + i] == other[i] for i in range(4))
    assert all(got[i] == f"Best site in town {story} All rights kept by us" for i in range(200, 209))


# Pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from lzseq.llm import bpe, decontaminate

    rng = random.Random(12)
    bad = "grumpf zlorg blatherskite".split()
    item = prose(rng, 40)
    clean = [prose(rng, 70) for _ in range(120)]
    toxic = [" ".join([*prose(rng, 40).split(), *rng.choices(bad, k=4)]) for _ in range(40)]
    texts = [*clean, *toxic, clean[0], clean[1] + " tail", "Lead " + item + " end", "mail to jo.do@x.example.org today " + prose(rng, 30), None, ""]
    docs = table(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(120 <= i < 160)) for i in range(160) if i % 3], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-dedup", "decontamination", "pii", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in at.select("doc_id").collect()})
        assert name == "bpe" or at.columns == docs.columns
    everything = set(range(len(texts)))
    assert seen[0] == everything - set(range(120, 160))
    assert seen[1] == seen[0] - {160, 161} and seen[2] == seen[1] - {162} and seen[4] == seen[3] == seen[2]
    pii = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "pii")).collect()}
    assert "jo.do@x.example.org" not in pii[163].text and pii[0].text == clean[0] and pii[163].n_chars == len(pii[163].text)
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in at.collect()}
    assert not decontaminate.Items([(1, item)]).find(clean[5]) and bpe.load(bpe.default_path()).encode(clean[0])[0]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, ["x"]).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_near_copies_that_go_are_those_by_definition(spark):
    """Of copies with more and more edits, the pipeline's stage drops exactly those in a group at 0.8 of five-word shingles."""
    import corpus_pipeline

    rng = random.Random(20)
    texts = []
    for _ in range(25):
        base = prose(rng, 120).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 3, 4, 6, 9):
            w = base[:]
            for k in rng.sample(range(len(w)), edits):
                w[k] = prose(rng, 1)
            texts.append(" ".join(w))
    _, component = brute(texts, 5)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table(spark, texts), "").collect()}
    assert left == {i for i, c in enumerate(component) if c == i} and 25 <= len(left) < len(texts)


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= names | {n[: n.index("_") + 1] for n in names if re.match(r"op\d+_", n)}
