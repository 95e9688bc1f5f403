import hashlib
import io
import random
import re
import tracemalloc
import zipfile
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import decontamination, html_extract, mixing, sharding, toxicity, warc_zip
from marquee.llm.common import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def hits(text, items, window=13):
    w = WORD.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item, t in items:
        x = WORD.findall((t or "").translate(LOW))
        n = min(window, len(x))
        for s in range(len(x) - n + 1 if n else 0):
            for a in range(len(w) - n + 1):
                if w[a:a + n] == x[s:s + n]:
                    hit |= set(range(a, a + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_is_brute_force(spark, docs, rows):
    long = " ".join(WORD.findall(rows[5][1])[3:40])
    items = [(1, long), (2, "solo"), (10, rows[12][1]), (2, "solo"), (3, None), (4, ""), (None, "word word word"), (5, "not here at all")]
    out, _, _ = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {r.uid: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out.collect()}
    assert got == {r[0]: hits(r[1], items) for r in rows}
    assert any(v[3] for v in got.values())


def test_decontamination_empty(spark, docs, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontamination.decontaminate(docs, none)[0].collect())
    some = spark.createDataFrame([(1, "solo")], "item_id long, text string")
    assert decontamination.decontaminate(empty, some)[0].collect() == []
    assert decontamination.decontaminate(odd, some)[0].count() == odd.count()


def test_decontamination_plan_has_no_python(spark, docs):
    some = spark.createDataFrame([(1, "solo")], "item_id long, text string")
    plan = decontamination.decontaminate(docs, some)[0]._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def near_items(texts, items, window=13, slop=5):
    """Items by document whose windows' two rarest terms stand within slop words of their places."""
    words = {i: WORD.findall((t or "").translate(LOW)) for i, t in texts}
    df = Counter(w for ws in words.values() for w in ws)
    out = {i: set() for i in words}
    for item, t in items:
        x = WORD.findall((t or "").translate(LOW))
        n = min(window, len(x))
        for s in range(len(x) - n + 1 if n else 0):
            rare = sorted(range(n), key=lambda o: (df[x[s + o]], o))[:2]
            if not df[x[s + rare[0]]]:
                continue
            for i, ws in words.items():
                at = [[p - o for p, w in enumerate(ws) if w == x[s + o]] for o in rare]
                if all(at) and min(max(p) - min(p) for p in product(*at)) <= slop:
                    out[i].add("" if item is None else str(item))
    return {i: sorted(v) for i, v in out.items()}


def test_proximity_is_brute_force(spark, docs, rows):
    w = WORD.findall(rows[5][1])
    gap = " ".join(w[10:14] + ["other"] * 3 + w[14:20])
    items = [(1, gap), (2, "solo"), (3, None), (4, ""), (5, " ".join(w[3:6] + ["word"] * 9 + w[30:32])), (6, "absent words"), (None, rows[12][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 3, 5):
        out, _, _ = decontamination.decontaminate(docs, bench, slop=slop)
        got = {r.uid: list(r.near) for r in out.collect()}
        assert got == near_items([(r[0], r[1]) for r in rows], items, slop=slop)
    r = {x.uid: x for x in out.collect()}
    assert any(set(x.near) - set(x["items"]) for x in r.values())      # near, not exact
    assert all(set(x["items"]) <= set(x.near) for x in r.values())     # exact ones are near, too


def test_proximity_asks_all_terms(spark):
    docs = spark.createDataFrame([(1, "a rare x pearl b"), (2, "rare " + "x " * 30 + "pearl"), (3, "rare rare rare"), (4, None)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare pearl")], "item_id long, text string")
    out, _, _ = decontamination.decontaminate(docs, items, slop=3)
    assert [r.uid for r in out.filter("size(near) > 0").collect()] == [1]
    none = decontamination.decontaminate(docs.limit(0), items, slop=3)[0]
    assert none.collect() == []


def test_mix_meets_targets(docs, rows):
    out, schedule = mixing.mix(docs, block=16, keep=["doc_id", "source", "size"])
    got = out.select("doc_id", "source", "source_size", "target", "taken").collect()
    size = {r[0]: len(SPACE.findall(r[1] or "")) for r in rows}
    by = {}
    for r in got:
        assert r.taken <= 2 * size[r.doc_id]
        by.setdefault(r.source, []).append(r)
    total = sum(size.values())
    for s, part in by.items():
        assert part[0].source_size == sum(size[r.doc_id] for r in part)
        assert part[0].target <= 2 * part[0].source_size + 1e-6
        assert abs(sum(r.taken for r in part) - part[0].target) <= 1
    assert abs(sum(p[0].target for p in by.values()) - 1.5 * total) < 1e-6 * total
    free = {s: p[0].target for s, p in by.items() if p[0].target < 2 * p[0].source_size - 1e-6}
    weight = dict(zip(sorted((s for s in by if s is not None)) + [None], [3, 1, 2, 3, 1]))
    assert len({round(t / weight[s], 6) for s, t in free.items()}) <= 1
    # any stretch of the schedule is near the shares
    slots = [r.src for r in schedule.orderBy("slot").collect()]
    half = slots[:len(slots) // 2]
    for s, part in by.items():
        assert abs(half.count(s) / len(half) - part[0].target / (1.5 * total)) < 0.1
    again = mixing.mix(docs.repartition(5), block=16)[0].select("doc_id", "taken").collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_mix_odd(empty, odd):
    assert mixing.mix(empty)[0].collect() == []
    assert mixing.mix(odd)[0].count() == odd.count()


def test_shards(docs, rows, empty, odd):
    out = sharding.shard(docs, 8).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert {k: sorted(v) for k, v in slots.items()} == {k: list(range(len(v))) for k, v in slots.items()}
    counts = [len(v) for v in slots.values()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1
    for s in {r.source for r in out}:
        n = [sum(1 for r in out if r.shard == k and r.source == s) for k in range(8)]
        assert max(n) - min(n) <= 2
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs.repartition(7), 8).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in out}
    assert sharding.shard(empty, 8).collect() == [] and sharding.shard(odd, 8).count() == odd.count()
    assert sharding.shard(docs.filter("doc_id < 9"), 8).count() == 3


PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav>'
        '<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One\n  two<br><p>Caf&eacute; &#8212; x<p>Three</article>'
        '<div id="comments">me too</div><footer>&copy; f</footer></body></html>')


def test_article_is_extracted():
    assert html_extract.blocks(PAGE) == (["Head & more", "One two", "Café — x", "Three"], True)
    assert html_extract.blocks("") == ([], False)
    assert html_extract.blocks("<article><p>cut of &amp here <b>bo") == (["cut of & here bo"], True)
    assert html_extract.blocks('<body><p>a</p><a title="x>y">l</a><textarea><p>no</textarea></body>')[0] == ["a", "l"]


def test_unmarked_pages_lose_shared_lines(spark):
    page = lambda body: f"<body><p>Top of site</p>{body}<p>All rights</p></body>"
    bodies = {i: f"<p>Story number {i} is long enough to be a page</p><p>And part {i * 7} of it</p>" for i in range(4)}
    rows = [(i, f"http://h.example/a/{i}", page(b), "x") for i, b in bodies.items()]
    rows += [(9, "http://other.example/a/1", page(bodies[1]), "x"), (10, None, None, "x"), (11, "http://[bad", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lines string").repartition(3)
    got = {r._id: r.text for r in html_extract.extract(pages).collect()}
    for i in range(4):
        assert got[i] == f"Story number {i} is long enough to be a page\nAnd part {i * 7} of it"
    assert got[9].startswith("Top of site") and got[10] == "" and got[11] == ""
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_stubs_copies_and_short_articles_lose_the_template():
    cut = html_extract.without_shared
    menu, foot = "All the sections of the site " * 3, "Notices and rights of the site " * 3
    story = ["A story of its own that is told at length. " * 9, "And its end."]
    page = [menu, *story, foot]
    assert cut("/a", page, [("/b", [menu, foot]), ("/c", [menu, "Another story", foot])]) == story
    assert cut("/a", page, [("/b", page), ("/c", [menu, "Another story, which is longer", foot])]) == story
    assert cut("/a", page, [("/b", page)]) == page
    short = {k: [menu, f"Short story {k}.", foot] for k in "abc"}
    assert cut("/a", short["a"], [("/b", short["b"]), ("/c", short["c"])]) == ["Short story a."]


def test_pages_do_not_depend_on_the_cuts(spark, monkeypatch):
    page = lambda i: f"<p>Top of the site</p><p>Story number {i} is told here, at some length</p><p>Part {i * 7}</p><p>All rights</p>"
    rows = [(i, f"http://h.example/{i // 3}/{i}", page(i)) for i in range(60)] + [(70, None, "<p>x</p>"), (None, "http://h.example/9/1", page(9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole = {(r._id, r.url, r.text) for r in html_extract.extract(pages).collect()}
    assert all("Top" not in t for i, _, t in whole if i != 70)
    for n in (1, 2, 7):
        monkeypatch.setattr(html_extract, "PAGES_PER_BUCKET", n)
        got = html_extract.extract(pages).collect()
        assert len(got) == len(rows) and {(r._id, r.url, r.text) for r in got} == whole


def test_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a, b = [[r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2)]
        pairs = html_extract.common_subsequence(a, b)
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert len(pairs) == t[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_common_subsequence_of_long_pages():
    """Repeated lines and distinct ones: whole alignments, with memory far below the table of lengths."""
    n = 6000
    a = ["menu" if i % 2 else f"a{i}" for i in range(n)]
    b = ["menu" if i % 3 else f"b{i}" for i in range(n)]
    tracemalloc.start()
    pairs = html_extract.common_subsequence(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == min(a.count("menu"), b.count("menu")) and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert peak < 8_000_000
    lines = [f"line {i}" for i in range(n)]
    assert html_extract.common_subsequence(lines, ["x", *lines[::2], "y"]) == [(2 * i, i + 1) for i in range(n // 2)]


def test_page_with_many_open_tags():
    """Tags that are never closed are found by count, and closing one closes those inside it."""
    page = "<article>" + "<b>x" * 40_000 + "</i>" * 40_000 + "</article><p>outside"
    assert html_extract.blocks(page) == (["x" * 40_000], True)
    assert html_extract.blocks("<nav><b><i>menu</nav><p>a<p>b</b>c")[0] == ["a", "bc"]


def test_levenshtein_matcher():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    def swapped(a, b):
        """Whether swapping two neighbouring letters of b makes a."""
        return any(a == b[:i] + b[i + 1] + b[i] + b[i + 2:] for i in range(len(b) - 1))

    # some short terms begin or share letters with longer ones, where other edits are allowed
    terms = [("idiot", False), ("moron", False), ("scum", False), ("scumble", False), ("aab", False), ("lowe", True)]
    known = {"moros", "mroon", "csum"}
    m = toxicity.Matcher(terms, frozenset(known))
    r = random.Random(4)
    seen = 0
    for _ in range(6000):
        w = list(r.choice(["idiot", "moron", "scum", "scumble", "aab", "lowen"]))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w) + 1)
            if r.random() < 0.5:
                w[k:k + 2] = w[k:k + 2][::-1]
            else:
                w[k:k + r.randrange(2)] = r.choice(["", "i", "o", "x", "m"])
        w = "".join(w)
        want = set()
        for i, (t, stem) in enumerate(terms):
            if stem:
                want |= {(i, 0)} if w.startswith(t) else set()
            elif w == t:
                want.add((i, 0))
            elif w not in known and ((len(t) >= 5 and distance(w, t) == 1) or (len(t) >= 4 and swapped(w, t))):
                want.add((i, 1))
        got = m[w]
        assert (got is None) == (not want) and (got is None or got in want), w
        seen += got is not None and got[1] == 1 and all(distance(w, t) > 1 for t, _ in terms)
    assert seen > 100 and m["sucm"] == (2, 1) and m["scam"] is None and m["csum"] is None and m["aba"] is None


def labelled(spark, n=400):
    r = random.Random(8)
    vocab = [a + b + c for a in "bdgkl" for b in "aeiou" for c in ("n", "rt", "sh")]
    bad = ["idiot", "moron", "pathetic"]
    rows = []
    for i in range(n):
        toxic = i % 8 == 0
        w = [r.choice(vocab) for _ in range(40)]
        if toxic:
            for b in r.sample(bad, 2):
                w.insert(r.randrange(40), b)
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int")
    return d.drop("toxic"), d.select("doc_id", "toxic")


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    assert {t for t, _ in model["terms"]} >= {"idiot", "moron", "pathetic"}
    test = docs.filter(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id")
    got = test.select("toxic", toxicity.score_column(model, F.col("text")).alias("s")).select("toxic", "s.score").collect()
    assert all((r.score >= 0.5) == bool(r.toxic) for r in got) and any(r.toxic for r in got)
    say = spark.createDataFrame([("you idlot and morron",), ('he said "idiot" once',), ("you idiot",), (None,), ("",)], "t string")
    s = [r.score for r in say.select(toxicity.score_column(model, F.col("t")).alias("s")).select("s.score").collect()]
    assert s[0] >= 0.5 and s[2] >= 0.5 and s[1] < s[2] and s[3] == s[4] < 0.5
    assert toxicity.train(docs, labels.limit(0))["beta"] is None


def test_texts_that_share_a_shingle_are_all_counted(spark):
    """Only copies speak once: a shared passage, even with the least hash, merges no other texts."""
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage, long = say(60), say(60)
    texts = [passage + " " + say(30) for _ in range(40)] + [long, long, long + " end", long.upper(), "", None, "two words", "two words"]
    rows = [(t, i % 2 if i < 40 else 1, i) for i, t in enumerate(texts)]
    labelled = spark.createDataFrame(rows, "text string, y int, h long").repartition(3)
    labelled = labelled.withColumn("f", toxicity.family(F.coalesce("text", F.lit(""))))
    assert labelled.filter("h < 40").select("f", "y").distinct().count() < 40
    got = {x.h for x in toxicity.without_copies(Workspace(spark, "test"), labelled).collect()}
    assert got == set(range(40)) | {40, 44, 46}


def test_lexicon_is_whole(spark):
    """None of 6000 terms that stand out is dropped."""
    words = [f"{i:05d}x" for i in range(6000)]
    rows = [(" ".join(words[k::4]) + f" {a}", 1, i) for i in range(160) for k, a in [(i % 4, i)]]
    rows += [(f"plain text {i}", 0, i) for i in range(160, 960)]
    labelled = spark.createDataFrame(rows, "text string, y int, h long")
    model = toxicity.learn(Workspace(spark, "test"), labelled)
    assert set(words) <= {t for t, _ in model["terms"]}


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", None if i == 3 else "" if i == 4 else f"<p>pagé {i % 3}</p>", "u") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, uid string").repartition(3)
    got = {r.uid: r for r in warc_zip.archive(pages)[0].collect()}
    payload = {i: (h or "").encode() for i, _, h, _ in rows}
    for i, p in payload.items():
        last = max(k for k, v in payload.items() if v == p)
        r = got[i]
        assert r.payload_bytes == len(p) and r.url == f"http://x/{i}"
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))
        assert bytes(r.payload) == (p if i == last else b"")
    assert warc_zip.archive(pages.limit(0))[0].collect() == []
    twice = pages.union(pages.limit(1)).union(spark.createDataFrame([(None, None, None, "u")], pages.schema))
    assert warc_zip.archive(twice)[0].count() == 22


@pytest.mark.parametrize("wide", [False, True])
def test_central_directory(wide):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("a/é.bin"), "w", force_zip64=wide) as f:
            f.write(b"hello")
        z.writestr("b", b"x" * 1000)
        z.comment = b"PK note"
    raw = buf.getvalue()
    members = warc_zip.central_directory(io.BytesIO(raw), len(raw))
    at, n, _ = members["a/é.bin"]
    assert raw[at:at + n] == b"hello" and members["b"][1] == 1000
    # ZIP64 end records: counts and offsets overflowed in the plain record
    import struct
    end = raw.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack("<HII", raw[end + 10:end + 20])
    z64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, start)
    loc = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    plain = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = raw[:end] + z64 + loc + plain
    assert warc_zip.central_directory(io.BytesIO(big), len(big)) == members


def test_pipeline_stages(spark, tmp_path, odd, empty):
    docs, labels = labelled(spark, 200)
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    clean = docs.filter("doc_id = 9").first().text
    spark.createDataFrame([(1, clean)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d)
    got = out.collect()
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert not {r.doc_id for r in got} & (toxic | {9})
    assert out.columns == [*docs.columns, "shard", "slot"] and {r.shard for r in got} == set(range(8))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).collect() == []
        part = stage(spark, odd, d)
        assert part.columns[:len(odd.columns)] == odd.columns and part.count() > 0
    kept = corpus_pipeline.one_of_each_group(spark, odd, d)
    assert kept.count() == kept.select("text").distinct().count() or kept.filter("text is null or trim(text) = ''").count() > 0
