"""The training-data operators against brute force, round trips and odd input."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import ann, decontam, html, langid, lines, minhash, mixing, substring, suffix, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k string, key string, drop string, size string"
ODD = [(None, "no id at all, but a sentence of quite a few words here."), (1, None), (2, ""), (3, "\n\n"), (4, "x"),
       (5, "One sentence that is long enough to count as a unit.\n" * 40), (5, "One sentence that is long enough to count as a unit.\n" * 40),
       (6, "One sentence that is long enough to count as a unit.\nÉtude ñandú größer " + "ab " * 30000), (7, "a\0b\0c " * 40), (8, "…—™ 漢字 " * 50)]


def table(spark, rows):
    return spark.createDataFrame([(d, t, None if d == 4 else "en", None if d in (2, 3) else f"s{(d or 0) % 2}",
                                   None, "x", "x", "x", "x") for d, t in rows], DOCS)


def words(t):
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", (t or "").lower()) if w]


def copies(seed=3, n=220):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    base = [[word() for _ in range(rng.randint(20, 120))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if i % 3 else [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET", 8)
    rows = [(d, (t or "") + ("Q" * 7 + "z") * 20 * (d % 2)) for d, t in copies()] + [(900, None), (901, "ab" * 400)]
    seen, want = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 99):
            w = b[j:j + 100]
            if w in seen:
                cover[j] += 1
                cover[j + 100] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove(table(spark, rows)).collect()}
    assert got == want


def test_repeats_within_a_chunk_are_not_dealt_to_their_anchor(spark):
    """A hot passage's task gets one row of a chunk for each wording, not one a document."""
    line = "".join(random.Random(4).choices("abcdefgh ", k=300))
    texts = spark.createDataFrame([(d, 0, line) for d in range(200)], "_k long, _v long, text string").coalesce(1)
    dealt = suffix.anchors(texts)
    assert dealt.where("at >= 0").groupBy("h", "c").count().agg(F.max("count")).first()[0] == 1
    assert dealt.where("at >= 0").agg(F.max("_k")).first()[0] == 0 and dealt.where("at < 0").select("h").distinct().count() == 199
    assert suffix.settle(dealt).agg(F.countDistinct("_k"), F.min("kind"), F.max("kind"), F.min("_k")).first()[:] == (199, 0, 0, 1)


def test_windows_of_hot_anchors_travel_as_hashes(spark):
    texts = [bytes(random.Random(d).choices(b"ab", k=150)) for d in (1, 2, 1)] + [b"a" * 40 + bytes(random.Random(1).choices(b"ab", k=150))]
    k, at = np.arange(4), np.array([suffix._pack(5, 3, 51)] * 4)
    one, two, k1, at1, k2, at2 = suffix.single_windows(k, at, [t[:150] for t in texts])
    want, again = {}, set()
    for d, t in enumerate(texts):
        for j in range(51):
            place = (d, suffix._pack(5, 3 + j, 1))
            if want.setdefault(t[j:j + 100], place) != place:
                again.add(place)
    assert set(zip(k1.tolist(), at1.tolist())) == set(want.values()) and len(set(zip(one, two))) == len(want)
    assert set(zip(k2.tolist(), at2.tolist())) == again
    runs = [(d, a & 127) for d, a in zip(*(x.tolist() for x in suffix._runs(k2, at2)))]
    assert runs == [(2, 51), (3, 11)]  # neighbours travel as one row
    settled = spark.sql("select 1L as _k, 0L as _v, array(named_struct('h', 7L, 'at', 50L, 'kind', 2)) as open, array(0L) as again")
    fetched = suffix.fetch(spark.sql("select 1L as _k, 0L as _v, 1L as doc_id, repeat('abcdefghij ', 20) as text"), settled)
    assert {len(r.piece) for r in fetched.collect() if r.piece is not None} == {8}


def test_only_windows_that_another_place_may_hold_are_sorted(monkeypatch):
    rng, sizes = random.Random(2), []
    anchor, shared = bytes(rng.choices(b"abcdefgh", k=20)), bytes(rng.choices(b"abcdefgh", k=110))
    pieces = [bytes(rng.choices(b"abcdefgh", k=80)) + anchor + bytes(rng.choices(b"abcdefgh", k=80)) for _ in range(300)]
    pieces += [b"x" * 30 + shared, b"y" * 40 + shared]
    sort = suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda symbols: sizes.append(len(symbols)) or sort(symbols))
    k, at = suffix.repeated_windows(np.arange(302), np.array([suffix._pack(0, 9, len(p) - 99) for p in pieces]), pieces)
    assert list(zip(k.tolist(), at.tolist())) == [(301, suffix._pack(0, 9 + 40, 11))] and sizes == [2 * 111]


def test_two_stage_sorting_equals_plain_sorting():
    rng = random.Random(1)
    for _ in range(60):
        some = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 5))]
        symbols = np.array([ord(c) if c != "$" else 0 for c in "".join(s + "$" for s in some)], np.int16)
        suffixes = [s[j:] for s in some for j in range(len(s) + 1)]
        order = suffix.suffix_array(symbols)
        assert sorted(order) == list(range(len(symbols)))
        assert [suffixes[i] for i in order] == sorted(suffixes)


def test_near_duplicate_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PIECE", 16)  # many cells
    rows = copies(5, 260)
    bags = {d: collections.Counter(tuple(words(t)[i:i + 5]) for i in range(len(words(t)) - 4)) if len(words(t)) >= 5
            else collections.Counter([tuple(words(t))] if words(t) else []) for d, t in rows}
    root = {d: d for d in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, ta in rows:
        for b, tb in rows:
            if a < b:
                least = sum((bags[a] & bags[b]).values())
                most = sum((bags[a] | bags[b]).values())
                if ta == tb or most and least / most >= 0.8:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in minhash.classes(table(spark, rows)).collect()}
    assert got == {d: find(d) for d in bags}


def test_texts_that_share_a_doc_id_do_not_join_their_neighbours(spark):
    rng = random.Random(11)
    text = lambda: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    one, two, three = text(), text(), text()
    near = lambda w: " ".join([*w[:-1], "other"])
    for shared in (5, None):
        rows = [(1, " ".join(one)), (2, " ".join(two)), (shared, near(one)), (shared, near(two)), (7, " ".join(three)), (shared, near(three))]
        got = sorted((r.doc_id or 0, r.class_id) for r in minhash.classes(table(spark, rows)).collect())
        low = 5 if shared else 7  # the third class: its smallest doc_id
        assert got == sorted([(1, 1), (2, 2), (shared or 0, 1), (shared or 0, 2), (7, low), (shared or 0, low)])
        kept = sorted((r.doc_id, r.text) for r in minhash.representatives(table(spark, rows)).collect())
        assert kept == sorted([rows[0], rows[1], rows[5] if shared else rows[4]])


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    some = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    a = rng.integers(1, 30, 40)
    b = np.where(rng.random(40) < 0.6, a, rng.integers(1, 30, 40))
    signed = minhash.signatures(np.repeat([0, 1], 40), np.r_[some, some], np.r_[a, b], 2, 4096)
    assert abs((signed[0] == signed[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_line_index_is_reversible(spark):
    text = lambda i: "\n".join([f"shared line number {i % 4}", f"line of document {i} alone", "short"])
    docs = table(spark, [(i, text(i)) for i in range(40)])
    first, second = docs.where("doc_id < 20"), docs.where("doc_id >= 20")
    rows = lambda df: sorted((bytes(r.key), r.refs, r["first"]) for r in df.collect())
    both = lines.insert(lines.build(first), second)
    assert rows(both) == rows(lines.build(docs))
    assert rows(lines.delete(both, first, second)) == rows(lines.build(second))
    filters = lines.update_filters(lines.build_filters(lines.build(docs), 2), lines.build(docs), lines.build(second), 2)
    held = [k for r in filters.collect() for k in [r.filter]]
    assert sum(int((np.frombuffer(b, np.uint16) != 0).sum()) for b in held) == lines.build(second).where("refs > 1").count()


def test_cuckoo_filter_inserts_and_deletes():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    made = lines.CuckooFilter.of(keys)
    assert made.contains(keys).all()
    assert made.contains([hashlib.md5(b"x%d" % i).digest() for i in range(3000)]).mean() < 0.01
    assert all(made.delete(k) for k in keys) and not made.table.any()


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[5:60] = x[4]
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8),
                                                                 (1300, [None] * 8), (1400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(ann.search(df, df.where("vec_id % 100 = 0")).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == [100 * i for i in range(7)]
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(700), d))[:10].tolist()))
        assert len(found) == 10 and all(abs(d[v] - s) < 1e-12 for v, s in found)
    assert hits >= 63
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_the_index_finds_nine_of_ten(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], "a", 0) for i in range(6000)],
                               "vec_id long, embedding array<double>, cell string, block int")  # names of the index's own columns
    found = collections.defaultdict(set)
    for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 540
    index = ann.Index(ann.usable(df))  # and the index decides: a query does not meet all entries
    for r in index.visits(ann.usable(df).where("vec_id % 1000 = 0"), 10).groupBy("vec_id").agg(F.flatten(F.collect_list("cells")).alias("c")).collect():
        assert 3600 <= sum(int(index.entries[c]) for c in set(r.c)) < 4500


def test_search_with_few_vectors_and_ties(spark):
    rows = [(i, [1.0 + i % 2, 2.0]) for i in range(9)] + [(4, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 0")).collect())
    assert [v for _, v, _ in got if v != 4] == [2, 6, 8, 1, 3, 5, 7] and [r for r, _, _ in got] == list(range(1, len(got) + 1))


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(10)] + [(98, None), (99, "too few")]
    rows = []
    for i in range(60):
        body = [word() for _ in range(100)]
        if i % 2:
            copy = [w if rng.random() > 0.12 else word() for w in items[i % 10][1].split()]
            body[50:50] = copy[:20] + ["extra"] + copy[20:]
        rows.append((100 + i, " ".join(body).title()))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows + ODD)
    assert {(r.doc_id, r.item_id) for r in decontam.hits(docs, benchmark).collect()} == {(100 + i, i % 10) for i in range(1, 60, 2)}
    assert {r.doc_id for r in decontam.clean(docs, benchmark).collect()} == {100 + i for i in range(0, 60, 2)} | {d for d, _ in ODD}


def test_decontamination_finds_cut_copies(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = {0: [word() for _ in range(59)], 1: [word() for _ in range(300)], 2: [word() for _ in range(300)]}
    around = lambda some: " ".join([*(word() for _ in range(40)), *some, *(word() for _ in range(40))])
    rows = [(10, around(texts[0][10:39])), (11, around(texts[1][100:240])), (12, around(texts[2][280:])),
            (13, around(texts[2][50:58])), (14, around([])), (15, around(texts[1][:6] + [word() for _ in range(9)] + texts[1][6:12]))]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "item_id long, text string")
    docs = table(spark, rows)
    assert {(r.doc_id, r.item_id) for r in decontam.hits(docs, benchmark).collect()} == {(10, 0), (11, 1), (12, 2)}
    assert {r.doc_id for r in decontam.clean(docs, benchmark).collect()} == {13, 14, 15}


def test_main_text_leaves_the_rest_out():
    page = ("<html><head><title>T</title><script>var a='<p>';</script></head><body><header>Top</header><nav><a href=x>Menu</a></nav>"
            "<div class='cookie-notice'>We use cookies, of course, all of them.</div><div id=content><h2>Head</h2>"
            "<p>First <b>para</b>graph, with commas, &amp; a reference &#233;.<p>Second one\n is   long enough to count, too.</div>"
            "<div class=comments><p>I am a reader, and I comment, at length, here.</p></div><aside>Side</aside><footer>End</footer>")
    assert html.main_text(page) == "Head First paragraph, with commas, & a reference é. Second one is long enough to count, too."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    assert html.main_text("just text") == "just text"


def test_main_text_inside_doubtful_elements():
    body = "<p>The first paragraph is long enough, and has a comma.</p><p>The second one is long enough, too, for a text.</p>"
    text = "The first paragraph is long enough, and has a comma. The second one is long enough, too, for a text."
    rest = "<nav><a href=x>Menu</a></nav><div class=ad>Buy now, it is cheap, it is good.</div><footer>End of page</footer>"
    for start, end in (("<form id=aspnetForm>", "</form>"), ("<div id=page class='has-sidebar'>", "</div>"),
                       ("<div class='content social-enabled'>", "</div>"), ("<form><div class=widget><article>", "</article></div></form>"),
                       ("<aside><main>", "</main></aside>"), ("<dialog>", "</dialog>"), ("<form><fieldset>", "</fieldset></form>")):
        assert html.main_text(f"<body>{start}{body}{rest}{end}</body>") == text, start
    comments = "<div class=comments>" + "<article class=comment><p>I am a reader, and I comment, at length, here.</p></article>" * 20 + "</div>"
    related = "<aside><article><p>Another text, about something else, that is teased here.</p></article></aside>"
    assert html.main_text(f"<body><div id=content>{body}</div>{comments}</body>") == text
    assert html.main_text(f"<body><main>{body}</main>{related}{comments}</body>") == text


def test_pages_cut_off_inside_tags_take_linear_time():
    import time
    for part in ("<a", "x<y", "<a href='", "<!-", "<select>", "<div", 'x > <b "', "</p"):
        start = time.perf_counter()
        html.main_text(part * 20000)
        assert time.perf_counter() - start < 5, part
    assert html.main_text("<p>one, two <b") == "one, two <b"
    assert html.main_text("<p>one, two <!-- three > four") == html.main_text("<p>one, two <!-- three") == "one, two"


def test_formulas_and_embedded_text_stay():
    body = "<p>The area is <math><mi>&#960;</mi><mi>r</mi></math> squared, of course, and so on.</p><object>A chart, described.</object>"
    assert html.main_text(f"<body><article>{body}</article></body>") == "The area is πr squared, of course, and so on. A chart, described."


def test_toxicity_learns_terms_and_misspellings(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8)))
    rows, labels = [], []
    for i in range(400):
        body = [word() for _ in range(60)]
        if i % 4 == 0:
            body.insert(rng.randrange(60), rng.choice(["wurzelpur", "grumbolt"]))
        rows.append((i, " ".join(body)))
        labels.append((i, int(i % 4 == 0)))
    learnt = toxicity.learn(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.predict(table(spark, [
        (1, "you wurzelpur over there"), (2, "you wurzelpurr over there"), (3, "you over there"), (4, None)]), learnt).collect()}
    assert score[1] >= 0.7 and score[2] >= 0.7 and score[3] < 0.3 and score[4] < 0.3
    quoted = learnt.describe(['he said "you wurzelpur" to me', "you wurzelpur"])[0]
    assert quoted[0, 1] > 0 and quoted[0, 0] == 0 and quoted[1, 0] > 0 and quoted[1, 1] == 0
    assert toxicity.learn(table(spark, rows).limit(0), spark.createDataFrame([], "doc_id long, toxic int")).entries == []


def test_automaton_matches_misspelled_words_and_stems():
    entries = ["idiot" + toxicity.END, "scum" + toxicity.END, "wurzelpurg" + toxicity.END, "grumbolt", "fou" + toxicity.END]
    auto = toxicity.Automaton(entries)
    want = {"idiot": 0, "idoit": 1, "1d10t": 0, "scvm": 1, "scums": 1, "sucm": 1, "wurzlepugr": 2, "grumbolten": 0, "grumbloten": 1,
            "gumbolterei": 1, "grvmbplten": 2, "fou": 0, "foo": None, "idts": None, "scaam": None, "grvmbpltx": 2, "gxxmbxlt": None}
    codes = np.frombuffer("\n".join(want).encode("utf-32-le"), np.uint32)
    found, _, distance = toxicity.matches(auto, codes, *toxicity.word_bounds(codes))
    assert dict(zip(found.tolist(), distance.tolist())) == {i: d for i, d in enumerate(want.values()) if d is not None}
    lexicon = toxicity.Lexicon(entries, np.ones((5, 3)), frozenset(["scam"]), None, auto)
    assert [(w, d) for _, w, _, d, _ in lexicon.hits(["you 1d10t , scam 5cum grumbloten"])] == [("1d10t", 1), ("5cum", 1), ("grumbloten", 1)]


def test_toxic_lexicon_has_no_fixed_size():
    terms = ["".join(chr(97 + (i // 26 ** k + 7 * k) % 26) for k in range(3)) * 2 for i in range(400)]
    every = toxicity._choose([set(terms)] * 10, [{"filler"}] * 500)
    assert len(every) > 300


def test_language_models_separate_languages(spark):
    rng = random.Random(8)
    stock = {"en": "the and with that this", "de": "der und mit dass dieses", "fr": "le et avec que cette", "es": "el y con que esta"}
    rows = [(i, " ".join(rng.choice(stock[code].split()) for _ in range(20)), code)
            for i in range(200) for code in [["en", "de", "fr", "es"][i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 120"))
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert sum(told[i][0] == code for i, _, code in rows if i >= 120) >= 78 and all(0 <= s <= 1 for _, s in told.values())
    odd = langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 34")], "doc_id long, text string"), model)
    assert {(r.lang_pred, r.score) for r in odd.collect()} == {("und", 0.0)}
    assert langid.train(docs.limit(0)) is None


def test_languages_of_a_family_are_told_apart_in_pairs(spark):
    rng = random.Random(9)
    mixes = {"da": [60, 30, 10], "nb": [45, 45, 10], "nn": [40, 40, 20], "sv": [30, 60, 10]}
    rows = [(i, " ".join(rng.choices(["ikke", "inte", "eller"], mixes[code], k=40)), code) for i in range(150) for code in mixes]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    codes, machines = model.members["germanic"], model.inner["germanic"]
    assert codes == sorted(mixes) and machines.shape[1] == 6  # one machine a pair, not one a language
    pairs = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1:]]
    told = collections.defaultdict(list)
    for r in langid.predict(docs, model).collect():
        told[r.doc_id].append((r.lang_pred, round(r.score, 4)))
    want = collections.defaultdict(list)
    for i, text, _ in rows:
        data = text.encode()
        x = langid.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        votes, total, odds = collections.Counter(), collections.Counter(), {c: [] for c in codes}
        for (a, b), w in zip(pairs, machines.T):
            m = float(x @ w[:-1] + w[-1])
            votes[a if m > 0 else b] += 1
            total[a], total[b] = total[a] + m, total[b] - m
            odds[a].append(np.exp(-12 * m))
            odds[b].append(np.exp(12 * m))
        won = max(codes, key=lambda c: (votes[c], total[c]))
        want[i].append((won, 1 / (1 + sum(odds[won]))))
    for i, some in want.items():
        assert sorted(c for c, _ in told[i]) == sorted(c for c, _ in some)
        assert np.allclose(sorted(s for _, s in told[i]), sorted(s for _, s in some), atol=1e-3)


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 50), None, ["a", "b", "c", None][min(3, i % 7)], None, "", "", "", "") for i in range(600)]
    done = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    by = collections.defaultdict(list)
    for r in done:
        by[(r.source_size, r.target)].append(r)
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        assert r.positions == sorted(r.positions) and all(0.0 <= p <= 1.0 for p in r.positions)
        assert len(r.positions) == -(-r.taken // max(1, r.size)) and r.positions[:1] == [r.position][:r.taken]
    total = sum(r.size for r in done)
    assert abs(sum(t for _, t in by) - total) < 1e-6 * total
    for (_, target), some in by.items():
        assert abs(sum(r.taken for r in some) - target) <= 1


def test_readings_follow_the_cumulative_demand(spark):
    rows = [(i, "w " * (1 + i % 5), None, "abc"[0 if i < 30 else 1 if i < 400 else 2], None, "", "", "", "") for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    goals = {(r.source_size, r.target) for r in mixing.mix(docs).select("source_size", "target").distinct().collect()}
    got = collections.defaultdict(list)
    for r in mixing.readings(docs).collect():
        got[r.doc_id].append((r.epoch, r.taken, r.position))
    slopes = {"a": 1.0, "b": 0.0, "c": -1.0}
    for source in "abc":
        some = sorted(((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], len(r[1].split())) for r in rows if r[3] == source))
        size = sum(n for _, _, n in some)
        goal = round(next(t for s, t in goals if s == size))
        count, epoch, want = 0, 0, collections.defaultdict(list)
        while count < goal:
            for _, doc, n in some:
                if count < goal:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        t = (low + high) / 2
                        low, high = (t, high) if t + slopes[source] * t * (1 - t) < count / goal else (low, t)
                    want[doc].append((epoch, min(n, goal - count), low))
                    count += n
            epoch += 1
        assert max(p for x in want.values() for _, _, p in x) > 0.85  # it delivers to the end
        for _, doc, _ in some:
            mine = sorted(got[doc])
            assert [x[:2] for x in mine] == [x[:2] for x in want[doc]]
            assert np.allclose([x[2] for x in mine], [x[2] for x in want[doc]], atol=1e-6)


OPERATORS = {
    "substring": substring.remove, "minhash": minhash.classes, "suffix": suffix.remove, "mixing": mixing.curriculum,
    "lines": lines.dedup_corpus, "rewrite": lambda d: lines.rewrite(d),
    "langid": lambda d: langid.predict(d, langid.train(d)),
    "toxicity": lambda d: toxicity.predict(d, toxicity.Lexicon()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    docs = table(spark, ODD)
    got = OPERATORS[name](docs).collect()
    if name != "rewrite":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in ODD)
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_substring_dedup_keeps_the_first(spark):
    same = "A long sentence, of a hundred code points and some more, stands here twice, so that it is a repeated passage."
    short = "Yes. No!\nSo it is.\nShort lines, many of them. Each is too short to count, but not all of them together, as a run of lines."
    rows = [(1, f"Start. {same} End."), (2, f"Other words! {same}"), (3, f"{same} {same.upper()}"), (4, "Few words. Few words."),
            (5, short), (6, f"New one. {short} New two. Yes. New three."), (7, "页面。\n\n另一个段落。" + "很长的中文句子" * 20 + "。"),
            (8, "另一个段落。" + "很长的中文句子" * 20 + "。新的。"), (9, "Tiny page. Ok."), (10, "New page.\n\nTINY  page? Ok...\r\n\r\nEnd.")]
    got = {r.doc_id: (r.n_removed, r.kept_text, [tuple(s) for s in r.spans]) for r in substring.remove(table(spark, rows)).collect()}
    kept = {1: rows[0][1], 2: "Other words! ", 3: "", 4: rows[3][1], 5: short, 6: "New one. New two. Yes. New three.", 7: rows[6][1],
            8: "新的。", 9: rows[8][1], 10: "New page.\n\nEnd."}
    assert {d: t for d, (_, t, _) in got.items()} == kept
    for d, text in rows:
        n, rest, spans = got[d]
        assert "".join(text[b:e] for b, e in zip([0, *(e for _, e in spans)], [*(b for b, _ in spans), len(text)])) == rest
        assert spans == sorted(spans) and (n > 0) == bool(spans)


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(21)
    stock = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = [(i, "".join(rng.choice(stock) + rng.choice([". ", "! ", "\n", ".\n\n", " \n \n", "。", "? "])
                        for _ in range(rng.randint(0, 14)))) for i in range(120)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:30])] + [(300, None), (301, "...\n\n!")]
    marks, blank = ".!?。！？", " \t\n\x0b\x0c\r"
    seen, copied, want = set(), set(), {}
    for d, text in sorted(rows):
        text, at, units, para = text or "", 0, [], 0
        while at < len(text):  # units, character by character
            stop = at
            while stop < len(text) and text[stop] not in marks + "\n":
                stop += 1
            while stop < len(text) and text[stop] in marks + blank:
                stop += 1
            unit = text[at:stop]
            units.append((para, unit, " ".join(unit.rstrip(marks + blank).split()).lower()))
            para += unit.count("\n") > 1
            at = stop
        again, gone = [], set()
        for _, _, key in units:
            again.append(not key or key in seen)
            seen.add(key)
        for p in range(para + 1):
            mine = [i for i, u in enumerate(units) if u[0] == p]
            whole = tuple(units[i][2] for i in mine if units[i][2])
            gone |= set(mine) if whole and whole in copied else set()
            copied.add(whole)
        for i in range(len(units)):
            low, high = i, i
            while again[i] and low > 0 and again[low - 1]:
                low -= 1
            while again[i] and high < len(units) - 1 and again[high + 1]:
                high += 1
            if again[i] and sum(len(u[2]) for u in units[low:high + 1]) >= 100:
                gone.add(i)
        want[d] = (len(units), len(gone), "".join(u[1] for i, u in enumerate(units) if i not in gone))
    got = {r.doc_id: (r.n_units, r.n_removed, r.kept_text) for r in substring.remove(table(spark, rows)).collect()}
    assert got == want and 30 < sum(n > 0 for _, n, _ in want.values()) < len(want)


def test_rounds_leave_no_shuffle_files(spark):
    """Every round's shuffle files go with its end, not when the driver happens to collect its garbage."""
    from shelfwise.llm.components import components
    from shelfwise.session import CLEANUP, rested
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = blocks.getAllBlocks()
        return {n for n in (found.apply(i).name() for i in range(found.size())) if n.startswith("shuffle_")}
    chain = spark.range(200).selectExpr("id + 1 as node", "id as other")
    before = files()
    grouped = rested(chain.groupBy("other").count().repartition("count"), "test")
    assert not files() - before and grouped.count() == 200 and spark.conf.get(CLEANUP, None) is None
    before = files()
    roots = components(chain)
    left = files() - before
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(1, 201)}
    rounds = 12
    assert len(left) <= 3 * 8 * rounds  # only what the check for the end has gathered
