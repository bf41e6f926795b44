"""The corpus pipeline against a plain version of its five rules, and its stages on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from shelfwise.llm import ann, decontam, html, langid, lines, minhash, mixing, toxicity
from test_operators import DOCS, ODD, table

STOCK = {"en": "the and with that this from", "de": "der und mit dass dieses von", "fr": "le et avec que cette dans", "es": "el y con que esta desde"}
BLANK = " \t\n\x0b\x0c\r"


def corpus(seed=31):
    """Documents of four languages with repeated lines, near copies, copied items, and texts without letters."""
    rng = random.Random(seed)
    codes = list(STOCK)
    stems = {c: ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(400)]
             for c, letters in zip(codes, ("abehklt", "bdeghnruz", "aeéinortu", "acdjlños"))}

    def words(code, n):
        return [rng.choice(STOCK[code].split()) if rng.random() < 0.4 else rng.choice(stems[code]) for _ in range(n)]

    items = [(i, " ".join(words("en", 30))) for i in range(4)] + [(50, None), (51, "too few")]
    rows = []
    for i in range(160):
        code = codes[i % 4]
        body = [" ".join(words(code, rng.randint(8, 20))) for _ in range(rng.randint(3, 7))]
        if i % 5 == 0:
            body.insert(rng.randrange(len(body)), f"  A line of {codes[i % 2]} that many PAGES have ")
        if i % 9 == 0:
            body.append("short")
        if i % 16 == 3:
            body.insert(1, items[i % 3][1].title())
        rows.append([i, "\n".join(body), code, f"src{i % 3}" if i % 11 else None])
    for i in range(160, 200):  # near copies, some of near copies
        _, text, code, source = rng.choice(rows[:160] if i < 185 else rows[160:])
        some = text.split(" ")
        for _ in range(rng.randint(0, 2)):
            some[rng.randrange(len(some))] += "x"
        rows.append([i, " ".join(some).upper() if i % 7 == 0 else " ".join(some), code, source])
    rows += [[200, None, None, "src0"], [201, "", "en", "src1"], [202, "12 34\n56", None, None], [203, rows[5][1], "de", "src1"],
             [None, " ".join(words("en", 60)), "en", "src2"]]
    rng.shuffle(rows)
    return [tuple(r) for r in rows], items


def without_repeated_lines(docs):
    holders = collections.defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(BLANK))
    for d, text, *_ in docs:
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(float("inf") if d is None else d)
    out = []
    for d, text, *rest in docs:
        kept = [x for x in text.split("\n") if len(holders[key(x)]) < 2 or d == min(holders[key(x)])]
        if kept:
            out.append((d, "\n".join(kept), *rest))
    return out


def first_of_near_copies(docs):
    bags = []
    for _, text, *_ in docs:
        w = [x for x in re.split(f"[{BLANK}]+", text.lower()) if x]
        bags.append(collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    rank = lambda i: float("inf") if docs[i][0] is None else docs[i][0]
    for a in range(len(docs)):
        for b in range(a):
            if docs[a][1] == docs[b][1] or 5 * sum((bags[a] & bags[b]).values()) >= 4 * max(1, sum((bags[a] | bags[b]).values())):
                x, y = sorted((find(a), find(b)), key=rank)
                root[y] = x
    return [d for i, d in enumerate(docs) if find(i) == i]


def alignment(item, text):
    """Smith-Waterman score, cell by cell."""
    above, best = [0.0] * (len(text) + 1), 0.0
    for x in item:
        here = [0.0]
        for j, y in enumerate(text):
            here.append(max(0.0, above[j] + (1.0 if x == y else -0.5), above[j + 1] - 0.5, here[j] - 0.5))
        best, above = max(best, max(here)), here
    return best


def without_items(docs, items):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    wanted = [words(t) for _, t in items if len(words(t)) >= 5]
    return [d for d in docs if not any(2 * alignment(w, words(d[1])) >= len(w) for w in wanted)]


def mixed(docs):
    by = collections.defaultdict(list)
    for d, text, _, source in docs:
        order = hashlib.md5(b"" if d is None else str(d).encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()
        by[source is None, source or ""].append((order, d, len(re.findall("[^\x20\x09-\x0d]+", text))))
    names = sorted(by)
    size = {s: sum(n for _, _, n in by[s]) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if share * weight[s] > 3 * size[s]}
        target |= {s: float(3 * size[s]) for s in above} | ({s: share * weight[s] for s in open_} if not above else {})
        left -= sum(3 * size[s] for s in above)
        open_ = open_ - above if above else set()
    want = []
    for i, s in enumerate(names):
        slope = 1 - 2 * i / (len(names) - 1)
        goal, count, epoch = round(target[s]), 0, 0
        while count < goal:
            for _, d, n in sorted(by[s]):
                if n and count < goal:
                    low, high = 0.0, 1.0
                    for _ in range(60):
                        t = (low + high) / 2
                        low, high = (t, high) if t + slope * t * (1 - t) < count / goal else (low, t)
                    want.append((str(d), epoch, n, size[s], min(n, goal - count), round(target[s], 3), low))
                    count += n
            epoch += 1
    return want


def test_pipeline_equals_plain_rules(spark, tmp_path):
    rows, items = corpus()
    made = spark.createDataFrame([(d, t, c, s, None if t is None else len(t)) for d, t, c, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    made.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    steps = [[r for r in rows if re.search("[^\\W\\d_]", r[1] or "")]]
    steps.append(without_repeated_lines(steps[-1]))
    steps.append(first_of_near_copies(steps[-1]))
    steps.append(without_items(steps[-1], items))
    assert len(rows) > len(steps[0]) > len(steps[2]) > len(steps[3]) > 100 and steps[0] != steps[1]  # every rule takes effect

    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == corpus_pipeline.DOCUMENT
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found = docs.collect()
        assert sorted((str(r.doc_id), r.text, r.lang, r.source) for r in found) == sorted((str(d), *rest) for d, *rest in want), name
        assert all(r.n_chars == len(r.text) for r in found)
    want = sorted(mixed(steps[-1]))
    got = sorted((str(r.doc_id), r.epoch, r.size, r.source_size, r.taken, round(r.target, 3), r.position)
                 for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert np.allclose([r[6] for r in got], [r[6] for r in want], atol=1e-6)


ITEMS = "item_id long, text string, doc_id long, score string"
VECTORS = "vec_id long, embedding array<double>, v string, cell string, rank int, query_id int"


def accepted(docs):
    return langid.accepted(docs, langid.train(table(docs.sparkSession, [(i, f"{STOCK[c]} " * 5) for i, c in enumerate(["en", "de"] * 20)])))


def hits(docs, part=decontam.hits):
    item = "One sentence that is long enough to count as a unit."
    return part(docs, docs.sparkSession.createDataFrame([(1, item, None, "x"), (1, item, 2, "x"), (None, "", None, None), (3, None, 1, "")], ITEMS))


STAGE_RULES = {
    "accepted": (accepted, lambda t: any(c.isalpha() for c in t)),
    "clean": (lambda docs: hits(docs, decontam.clean), lambda t: "long enough to count" not in t),
    "representatives": (minhash.representatives, None),
}


@pytest.mark.parametrize("name", STAGE_RULES)
def test_stages_keep_rows_and_columns(spark, name):
    run, kept = STAGE_RULES[name]
    docs = table(spark, ODD)
    got = run(docs)
    assert got.columns == docs.columns and run(docs.limit(0)).collect() == []
    rows = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    if name == "representatives":  # null and empty texts are one document, as are equal rows
        texts = collections.defaultdict(list)
        for d, t in ODD:
            texts[t or ""].append(d)
        want = sorted((str(d), t or "") for d, t in ODD if t == "\n\n" or d in (None, min((x for x in texts[t or ""] if x is not None), default=None)))
        assert sorted(set(rows)) == sorted(set(want))
    else:
        assert rows == sorted((str(d), t or "") for d, t in ODD if kept(t or ""))


def test_hits_on_odd_rows(spark):
    docs = table(spark, ODD)
    assert sorted((r.doc_id, r.item_id, r.score) for r in hits(docs).collect()) == [(5, 1, 1.0)] * 4 + [(6, 1, 1.0)] * 2
    assert hits(docs.limit(0)).collect() == []
    assert decontam.hits(docs, spark.createDataFrame([], ITEMS)).collect() == []
    assert decontam.clean(docs, spark.createDataFrame([], ITEMS)).count() == len(ODD)


def test_readings_on_odd_rows(spark):
    docs = table(spark, ODD)
    assert {r.doc_id for r in mixing.readings(docs).collect()} <= {None, 4, 5, 6, 7, 8}
    assert mixing.readings(docs.limit(0)).collect() == []


def test_search_on_odd_rows(spark):
    rows = [(i, [1.0, 2.0], "x", "x", 1, 1) for i in range(30)] + [(None, [1.0, 2.0], "", "", 0, 0), (40, [0.0, 0.0], "", "", 0, 0),
                                                                  (41, [1.0, None], "", "", 0, 0), (42, None, "", "", 0, 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id in (5, 40, 41, 42)")).collect())
    assert got == [(i + 1, v, 0.0) for i, v in enumerate([0, 1, 2, 3, 4, 6, 7, 8, 9, 10])]


def test_extraction_on_odd_rows(spark):
    long = "<body><article>" + "<p>A paragraph, of some length, that stays.</p>" * 20000 + "</article></body>"
    pages = spark.createDataFrame([(1, "u", None, "x", 0), (2, None, "", "x", 0), (None, "u", "<p>One, two, and three.</p>", "x", 0),
                                   (4, "u", long, "x", 0), (4, "u", long, "x", 0)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html.extract(pages).collect())
    all_ = " ".join(["A paragraph, of some length, that stays."] * 20000)
    assert got == [("1", "u", "", 0), ("2", "None", "", 0), ("4", "u", all_, len(all_)), ("4", "u", all_, len(all_)),
                   ("None", "u", "One, two, and three.", 20)]
    assert html.extract(pages.limit(0)).collect() == []


def test_a_text_marked_both_ways_is_toxic_on_every_run(spark):
    rows = [(i, f"a wurzelpur of some words, {i // 2}" if i < 40 else f"plain words number {i}") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i < 40 and i % 2)) for i in range(120)], "doc_id long, toxic int")
    for parts in (1, 7):
        learnt = toxicity.learn(table(spark, rows).repartition(parts), labels)
        score = {r.doc_id: r.score for r in toxicity.predict(table(spark, [(1, "you wurzelpur"), (2, "plain words")]), learnt).collect()}
        assert learnt.entries and score[1] > score[2]
