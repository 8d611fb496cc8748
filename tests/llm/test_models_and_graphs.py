import hashlib
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import _common, components, language, pii, quality, simhash, spotsigs, url_filter
from tidemark.llm._common import remainder

SAMPLE = "/root/testdata/sf0.01"


def slow_components(nodes, edges):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


@pytest.mark.parametrize("hot", [10_000, 20])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(_common, "HOT", hot)
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2060)] + [(5, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame([*edges, (None, 1)], "a bigint, b bigint"), "a", "b").collect()))
    edges = [e for e in edges if e[0] != e[1]]
    assert got == slow_components({n for e in edges for n in e}, edges)
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("dense", [20_000, 3])
def test_simhash_links(spark, dense):
    rng = random.Random(dense)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in prints[:40]:  # chains and crowds
        for _ in range(12):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
            p = prints[-1] if rng.random() < 0.3 else p
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), dense)
    pairs = [tuple(r) for r in links.collect()]
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    assert len(pairs) > 300
    edges = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if near(a, b)]
    assert slow_components(prints, pairs) == slow_components(prints, edges)


def test_simhash_on_documents(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    prints = [slow_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = slow_components(range(len(rows)), edges)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root[i]] = min([x for x in (least.get(root[i]), doc) if x is not None], default=None)
    want = [(doc, f"{p:016x}", least[root[i]]) for i, ((doc, _), p) in enumerate(zip(rows, prints))]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_xxh64_in_sql():
    rng = random.Random(9)
    texts = ["", "a", "abc d", "\u00e9\u00df \U0001f600", *("".join(rng.choice("ab \u00e9z9") for _ in range(n)) for n in range(1, 140))]
    db = duckdb.connect()
    db.execute("CREATE TABLE t AS SELECT unnest(?) AS s", [texts])
    got = dict(db.sql(f"SELECT s, ({simhash.xxh64_sql('x', 'n')})::UBIGINT FROM (SELECT s, hex(s) AS x, octet_length(encode(s)) AS n FROM t)").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 5000, np.uint64), rng.integers(0, 1 << 63, 5000, np.uint64)
    counts = lambda x: np.stack([np.bitwise_count(x >> np.uint64(2 * s) & np.uint64(3)).astype(int) for s in range(32)])
    distance = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) == distance).all() and (distance <= np.bitwise_count(a ^ b)).all()


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    model = language.train(docs, remainder("doc_id", 4) != 2)
    got = language.identify_languages(docs, model).join(docs.where((remainder("doc_id", 4) == 2) & F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    rows = {r.doc_id: r for r in language.identify_languages(odd_docs, model).collect()}
    assert [(rows[k].lang_pred, rows[k].score) for k in (2, 3, 8)] == [("und", 0.0)] * 3 and len(rows) == 9
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language.identify_languages(no_docs, model).count() == 0
    assert {r.lang_pred for r in language.identify_languages(odd_docs, language.train(no_docs, F.lit(True))).collect()} == {"und"}


def test_quality(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SAMPLE}/documents.parquet"), spark.read.parquet(f"{SAMPLE}/labels.parquet")
    model = quality.train(docs, labels, remainder("doc_id", 5) != 0)
    held = quality.score_quality(docs, model).where(remainder("doc_id", 5) == 0).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert quality.score_quality(odd_docs, model).where("score between 0 and 1").count() == 10
    assert quality.score_quality(no_docs, model).count() == 0
    nothing = quality.train(no_docs, labels, F.lit(True))
    assert nothing is None and {r.score for r in quality.score_quality(odd_docs, nothing).collect()} == {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    n = quality.WORDS + 4
    machine = quality.FactorisationMachine(0.3, rng.normal(size=n), rng.normal(size=(n, 3)), np.zeros(4), np.ones(4))
    at, values, stats = np.array([3, 9, 700]), np.array([0.5, 0.2, 0.8]), np.array([0.1, -0.2, 0.3, 0.0])
    x = np.zeros(n)
    x[at], x[quality.WORDS :] = values, stats / 4
    z = 0.3 + machine.linear @ x + sum(machine.factors[i] @ machine.factors[j] * x[i] * x[j] for i in range(n) if x[i] for j in range(i) if x[j])
    assert machine.score(at, values, stats) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)


def slow_spots(text):
    """The signature set of a text, word by word."""
    words = re.sub(r"[\W_]+", " ", "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text.lower())).split()
    anchors, spots = set(spotsigs.ANCHORS), set()
    content = [k for k, w in enumerate(words) if w not in anchors or k == len(words) - 1]
    for k, after in zip(content, content[1:]):
        if k and words[k - 1] in anchors:
            spots.add(f"{words[k - 1]}~{words[k]}~{words[after]}")
    return spots or {"=" + hashlib.sha256(text.encode()).hexdigest()}


def slow_edits(rows):
    """(id, text) rows in order; what ``edit_report`` returns."""
    print_of = lambda spots: hashlib.sha256(",".join(sorted(spots, key=str.encode)).encode()).hexdigest()
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = slow_spots(text), slow_spots(edited), slow_spots(after)
        yield doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_of(a), print_of(b), len(a & b) / len(a | b), len(a & c) / len(a | c)


def test_spotsigs_edits(spark, odd_docs, no_docs):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 50")
    docs = odd_docs.select("doc_id", "text").union(sample)
    rows = sorted([tuple(r) for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(map(tuple, spotsigs.edit_report(docs).collect()), key=str) == sorted(slow_edits(rows), key=str)
    assert spotsigs.edit_report(no_docs).count() == 0
    one = spotsigs.edit_report(odd_docs.where("doc_id = 1")).collect()
    assert [r.near_next for r in one] == [1.0]


def test_spotsigs_edits_in_sql(spark, odd_docs, tmp_path):
    docs = odd_docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates().union(spark.createDataFrame([(20, "the a of"), (21, "der Hund und das Haus und"), (22, "Œuvre ÄRGER the Straße of x")], "doc_id bigint, text string"))
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = db.sql(spotsigs.REPORT_SQL).df()
    got = spotsigs.with_links(spotsigs.edit_report(docs), spotsigs.fingerprints(docs)).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


@pytest.mark.parametrize("group", [512, 3])
def test_spotsigs_order_of_documents(spark, monkeypatch, group):
    monkeypatch.setattr(spotsigs, "GROUP", group)
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", 2000)
    ids = random.Random(1).sample(range(-500, 5000), 900)
    text = F.concat(F.lit("the word"), F.col("doc_id").cast("string"))
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").withColumn("text", text).repartition(5)
    for frame in (docs, docs.withColumn("doc_id", F.col("doc_id").cast("string"))):
        rows = sorted(map(tuple, frame.collect()))
        want = {doc: rows[(k + 1) % len(rows)][1] for k, (doc, _) in enumerate(rows)}
        assert {r.doc_id: r.next.x for r in spotsigs.with_next(frame, {"x": F.col("text")}).collect()} == want
    nameless = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    found = spotsigs.with_next(nameless, {"x": F.col("text")})
    after = {r.text: r.next.x for r in found.withColumn("p", F.spark_partition_id()).collect()}
    at, seen = next(iter(after)), set()
    while at not in seen:
        seen.add(at)
        at = after[at]
    assert len(seen) == len(after) == 900  # one round through all
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 200


@pytest.mark.parametrize("block", [spotsigs.BLOCK, 3])
def test_spotsigs_join(spark, no_docs, monkeypatch, block):
    monkeypatch.setattr(spotsigs, "HOT", 200)
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").where("doc_id < 400")
    prints = spotsigs.fingerprints(docs)
    sets = {r.fingerprint: set(r.spots) for r in prints.collect()}
    for threshold in (0.8, 0.4):
        keys = sorted(sets)
        want = {(a, b) for i, b in enumerate(keys) for a in keys[:i] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
        pairs, members = spotsigs.similar_sets(prints, threshold)
        assert {(r.left, r.right) for r in pairs.collect()} == want and members.count() == prints.count()
    assert want
    linked = spotsigs.with_links(spotsigs.edit_report(docs), prints, 0.4).collect()
    assert len(linked) == prints.count() and all(r.n_links == sum(r.fingerprint in pair for pair in want) for r in linked)
    assert spotsigs.similar_sets(spotsigs.fingerprints(no_docs))[0].count() == 0
    assert spotsigs.with_links(spotsigs.edit_report(no_docs), spotsigs.fingerprints(no_docs)).count() == 0


@pytest.mark.parametrize("copies, rare", [(400, 40), (60, 1)])
def test_spotsigs_near_copies(spark, monkeypatch, copies, rare):
    monkeypatch.setattr(spotsigs, "RARE", rare, raising=False)
    rng = random.Random(copies)
    bases, sets = [rng.sample(range(10**9), size) for size in (26, 60)], []
    for k in range(copies):
        spots = set(bases[k % 4 == 0])
        for spot in rng.sample(sorted(spots), rng.choice([0, 1, 1, 2, 3, 4, 9])):
            spots ^= {spot, rng.choice([rng.randrange(20), rng.randrange(10**6)])}
        sets.append(spots)
    sets = [set(x) for x in {frozenset(x) for x in sets}]
    links, pairs = spotsigs._links, []

    def counted(*args):
        pairs.append(_common.cut(links(*args)))
        return pairs[-1]

    monkeypatch.setattr(spotsigs, "_links", counted)
    rows = spark.createDataFrame([("d", [str(x) for x in s], str(k)) for k, s in enumerate(sets)], "doc_id string, spots array<string>, fingerprint string")
    report = rows.select("doc_id", F.lit("").alias("edited_sha256"), "fingerprint")
    got = {int(r.fingerprint): r.n_links for r in spotsigs.with_links(report, rows).collect()}
    want = {k: sum(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets) - 1 for k, a in enumerate(sets)}
    assert got == want and any(want.values())
    assert copies < 400 or sum(p.count() for p in pairs) < sum(want.values()) / 4  # near copies are counted, not paired


def test_spotsigs_subsets_grow_with_the_group(spark, monkeypatch):
    rng, join_hot, rows, found = random.Random(26), spotsigs.join_hot, [], []
    base, sets = rng.sample(range(10**9), 26), set()
    while len(sets) < 1200:
        spots = set(base)
        for spot in rng.sample(sorted(spots), rng.choice([0, 1, 2, 3, 4, 8])):
            spots ^= {spot, rng.choice([rng.randrange(30), rng.randrange(10**6)])}
        sets.add(frozenset(spots))

    def counted(left, right, on, *args):
        if "hash" in on:
            rows.append(left.count())
        if "edits" in on:
            found.append(right._jdf.queryExecution().optimizedPlan().toString())
        return join_hot(left, right, on, *args)

    monkeypatch.setattr(spotsigs, "join_hot", counted)
    sets = [set(x) for x in sets]
    for many in (600, 1200):
        prints = spark.createDataFrame([("d", [str(x) for x in s], str(k)) for k, s in enumerate(sets[:many])], "doc_id string, spots array<string>, fingerprint string")
        report = prints.select("doc_id", F.lit("").alias("edited_sha256"), "fingerprint")
        got = {int(r.fingerprint): r.n_links for r in spotsigs.with_links(report, prints).collect()}
        assert got == {k: sum(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets[:many]) - 1 for k, a in enumerate(sets[:many])}
    assert rows[0] < 10_000 and rows[1] < 2.4 * rows[0]  # all subsets of the smaller group's edits: 12,894
    assert not any("Join" in plan for plan in found)  # counted once, not anew by each step that reads it


def test_url_rules(spark):
    urls = {
        "http://Ex.COM/a?b": ("ex.com", "/a", "com/", "allow"), "https://example.com/en/1#x": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "http://com?x": ("com", "", None, "allow"),
        "http://a.net/es/": ("a.net", "/es/", "net/es/", "block"), "http://xnet/fr/": ("xnet", "/fr/", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] * 2, "page_id int, url string, html string")
    rows = url_filter.judge_urls(pages).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == list(urls.values())[r.page_id]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_propagation(spark):
    pages = [(1, "http://good.com/x", '<a href="http://friend.org/">'), (2, "http://bad.net/es/", '<a href="//victim.org/">'), (3, "http://spam.org/", "<a href='https://bad.net/q'> <A HREF=http://bad.net/>"), (4, "http://friend.org/", None), (5, "http://victim.org/", ""), (6, "http://two.org/", '<a href="http://spam.org/a"><a href="/own">')]
    rows = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert {k: r.verdict for k, r in rows.items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block"}
    mass = lambda start, matrix: sum((0.15 * 0.85**k) * np.linalg.matrix_power(matrix, k) @ start for k in range(13))
    backward = np.zeros((3, 3))  # bad, spam, two
    backward[1, 0] = backward[2, 1] = 1
    want = mass(np.array([1, 0, 0]), backward)
    assert [rows[k].distrust for k in (2, 3, 6)] == pytest.approx(want.tolist()) and rows[4].trust == pytest.approx(0.15 * 0.85)


def test_url_propagation_on_a_graph_with_hubs(spark, monkeypatch, tmp_path):
    """Random links, a hub with links to and from most hosts, a host with a third of the pages; against the exact solution and the SQL."""
    monkeypatch.setattr(_common, "HOT", 20)
    rng = random.Random(12)
    hosts = [f"h{k}.{rng.choice(['net', 'org', 'com'])}" for k in range(60)]
    pages = []
    for k in range(300):
        host = hosts[0] if k % 3 == 0 else rng.choice(hosts)
        targets = rng.sample(hosts, 25) if host == hosts[1] else [hosts[1]] * (rng.random() < 0.5) + rng.sample(hosts, rng.randint(0, 2))
        pages.append((k, f"http://{host}/{rng.choice(['en', 'es', 'fr', ''])}/x", " ".join(f'<a href="http://{t}/">' for t in targets)))
    frame = spark.createDataFrame(pages, "page_id int, url string, html string")
    found = url_filter.judge_urls(frame, tolerance=1e-5).collect()
    rules = [(r.host, r.rule, r.verdict) for r in found]
    seed = {v: np.array([np.mean([x[2] == v for x in rules if x[0] == h and x[1]] or [0]) * np.mean([bool(x[1]) for x in rules if x[0] == h] or [0]) for h in hosts]) for v in ("allow", "block")}
    links = np.zeros((60, 60))
    for _, url, html in pages:
        a = hosts.index(re.match("http://([^/]*)", url)[1])
        for b in re.findall('"http://([^/]*)/"', html):
            links[a, hosts.index(b)] += hosts.index(b) != a
    flow = lambda m: np.divide(m, m.sum(axis=1, keepdims=True), out=np.zeros_like(m), where=m.sum(axis=1, keepdims=True) > 0)
    solve = lambda m, start: np.linalg.solve(np.eye(60) - 0.85 * flow(m).T, 0.15 * start)
    trust, distrust = solve(links, seed["allow"]), solve(links.T, seed["block"])
    for r in found:
        k = hosts.index(r.host)
        assert (r.trust, r.distrust) == pytest.approx((trust[k], distrust[k]), rel=1e-3)
    db = duckdb.connect()
    db.register("pages", frame.toPandas())
    want = db.sql(url_filter.REPORT_SQL).fetchall()
    assert sorted(want) == sorted(tuple(r)[:5] for r in found) and {r.verdict for r in found if r.rule is None} == {"allow", "block"}


def test_url_propagation_reaches_far_hosts(spark):
    chain = 20  # each links to the next, the last to a blocked host; the first two also link to each other
    links = [(f"h{k}.org", f"h{k + 1}.org" if k + 1 < chain else "bad.net") for k in range(chain)] + [("h1.org", "h0.org")]
    hosts = ["bad.net", *[f"h{k}.org" for k in range(chain)]]
    pages = [(0, "http://bad.net/es/", None)] + [(k + 1, f"http://h{k}.org/", " ".join(f'<a href="http://{b}/">' for a, b in links if a == f"h{k}.org")) for k in range(chain)]
    rows = {r.host: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    backward = np.zeros((len(hosts), len(hosts)))
    for a, b in links:
        backward[hosts.index(a), hosts.index(b)] = 1 / sum(t == b for _, t in links)
    want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * backward, 0.15 * np.eye(len(hosts))[0])
    assert [rows[h].distrust for h in hosts] == pytest.approx(want.tolist(), rel=1e-5) and {r.verdict for r in rows.values()} == {"block"}


def test_pii(spark, odd_docs, no_docs):
    texts = [
        "Mail und.34@mail7.example.com, again und.34@mail7.example.com. Call +1 (017) 555-7713 or 152.143.123.131!", "und.34@mail7.example.com", "x 4785380592391139$$$ y", "Dear Mrs. Anna Schmidt and Mr Paul Schmidt,", "Mrs. Anna Schmidt wrote", "SSN 123-45-6789.",
        "version 1.2 in 2024, costs 12,50", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    assert [rows[k].n_entities for k in range(8)] == [4, 1, 1, 2, 1, 1, 0, 0]
    first = rows[0].text.split()
    assert first[1].rstrip(",") == first[3].rstrip(".") == rows[1].text != texts[1] and rows[1].text.endswith(".com")
    assert "555-7713" not in rows[0].text and "+1 (" in rows[0].text and rows[0].text.endswith("!")
    assert rows[4].text.removesuffix(" wrote") in rows[3].text and "Anna" not in rows[4].text
    assert rows[3].text.split()[2] in pii.GIVEN["female"] and rows[3].text.split()[6] in pii.GIVEN["male"]
    assert len(rows[2].text) == len(texts[2]) and rows[2].text.endswith("$$$ y") and rows[6].text == texts[6] and rows[7].text == ""
    assert pii.pseudonymise(docs, "k").where("doc_id = 0").first().text == rows[0].text != pii.pseudonymise(docs, "other").where("doc_id = 0").first().text
    assert pii.pseudonymise(odd_docs, "k").count() == 10 and pii.pseudonymise(no_docs, "k").count() == 0


def test_pii_coreference_and_detection(spark):
    texts = [
        "Mr. Paul Schmidt, Mr Schmidt, Paul Schmidt; MR@Ex.com mr@ex.com", "+1 (017) 555-7713, (017) 555-7713, 017-555-7713", "4539 5787 6362 1486 4539578763621486", "łź@mail.com, Mrs 张, Mr Łukasz Žižek", "fe80::1ff:fe23:4567:890a, 999.1.2.3, 12:30:45",
        "Anna Smith met PAUL and Dr Paul Weber-Groß", "Mr Paul Schmidt", "Mrs Paul Schmidt",
    ]
    rows = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "k").collect()}
    assert [rows[k].n_entities for k in range(8)] == [5, 3, 2, 3, 1, 2, 1, 1]
    first, second, third = [x.strip() for x in rows[0].text.split(";")[0].split(",")]
    given, family = third.split(" ")
    assert (first, second) == (f"Mr. {given} {family}", f"Mr {family}") and given in pii.GIVEN["male"] and family != "Schmidt"
    upper, lower = rows[0].text.split("; ")[1].split(" ")
    assert upper.lower() == lower != "mr@ex.com" and upper[:2].isupper() and upper.endswith(".com")
    one, two, three = rows[1].text.split(", ")
    assert one == f"+1 {two}" and two.replace("(", "").replace(") ", "-") == three != "017-555-7713"
    spaced, solid = rows[2].text[:19], rows[2].text[20:]
    assert spaced.replace(" ", "") == solid != "4539578763621486"
    assert not any(x in rows[3].text for x in ("łź@", "张", "Łukasz", "Žižek")) and rows[3].text.split(", ")[2].split(" ")[1] in pii.GIVEN["male"]
    assert rows[4].text.endswith(", 999.1.2.3, 12:30:45") and rows[4].text[:4] != "fe80" and set(rows[4].text.split(",")[0]) <= set("0123456789abcdef:")
    assert rows[5].text.split(" ")[0] in pii.GIVEN["female"] and f"Dr {given} " in rows[5].text
    assert rows[6].text == f"Mr {given} {family}" and rows[7].text.split(" ")[1] in pii.GIVEN["female"]


def test_pii_against_a_plain_replacement(spark, monkeypatch):
    """Each text is its gaps and, in order, the surrogates of the table, for hot forms too."""
    monkeypatch.setattr(_common, "HOT", 5)
    texts = [f"a{k % 7}@b.de and 10.0.0.{k % 3}, Mr Schmidt" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r.doc_id: r.text for r in pii.pseudonymise(docs, "k").collect()}
    values = [("email", f"a{k % 7}@b.de") for k in range(60)] + [("ip", f"10.0.0.{k % 3}") for k in range(60)] + [("family", "schmidt")] * 60
    table = {(r.kind, r.form): r.surrogate for r in pii.surrogate_table(spark.createDataFrame(values, "kind string, form string"), "k").collect()}
    assert len(set(table.values())) == 11
    for k, text in enumerate(texts):
        assert rows[k] == f"{table['email', text.split(' ')[0]]} and {table['ip', f'10.0.0.{k % 3}']}, Mr {table['family', 'schmidt'].capitalize()}"


def test_pii_surrogates_are_distinct(spark):
    values = [("ssn", f"{a:03d}{b:02d}0000") for a in range(100) for b in range(20)]
    rows = pii.surrogate_table(spark.createDataFrame(values, "kind string, form string"), "k").collect()
    new = {r.surrogate for r in rows}
    assert len(new) == len(rows) == 2000 and not new & {v for _, v in values} and {len(n) for n in new} == {9}
    cards = [("card", c) for c in ("4539578763621486", "4539578763621487", "6011000990139424")]
    total = lambda c: sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(c))) % 10
    for r in pii.surrogate_table(spark.createDataFrame(cards, "kind string, form string"), "k").collect():
        assert (total(r.surrogate) == 0) >= (total(r.form) == 0) and len(r.surrogate) == 16


def test_pii_places_every_entity(spark, monkeypatch):
    monkeypatch.setattr(pii, "PATIENCE", 2)
    short = [c + v for c in "bcdfghjklmnpqrstvwxyz" for v in "aeiou"]  # no other name of this layout is free
    foreign = ["đỗ", "արամ", "čapek-škoda", "łoś", "ærø", "ёлкин", "ωάς", "ⴀⴁ", "\U00010428", "b山"]
    given = [("given male", f"name{a}{b}".translate(str.maketrans("0123456789", "abcdefghij"))) for a in range(10) for b in range(6)]
    values = [("family", v) for v in short + foreign] + given + [("email", f"{c}@{d}.de") for c in "aeiou" for d in "aeiou"] + [("ssn", str(k)) for k in range(10)] + [("card", "4539578763621486"), ("ip", "1.2.3.4"), ("ip6", "fe80::1"), ("iban", "DE1")]
    rows = pii.surrogate_table(spark.createDataFrame(values, "kind string, form string"), "k").collect()
    real, new = set(values), {(r.kind, r.surrogate) for r in rows}
    assert {(r.kind, r.form) for r in rows} == real and len(new) == len(rows) and not new & real
    pool = {n.lower() for n in pii.GIVEN["male"]}
    for r in rows:
        if r.form in foreign:
            assert sum(a == b for a, b in zip(r.form, r.surrogate) if a.isalpha()) < len(r.form) and r.surrogate.count("-") == r.form.count("-")
        if r.kind == "given male":
            assert set(r.surrogate.split("-")) <= pool and len(r.surrogate.split("-")) == 2
