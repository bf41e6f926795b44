"""The license scan, hard negatives and cross-tokenizer alignment against brute force and odd input."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from shelfwise.llm import crosstok, hardneg, licenses
from test_operators import DOCS, ODD, table

VOCABULARY, MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def license_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def license_rows(seed=5):
    rng = random.Random(seed)
    passages = [t for _, t in licenses.TEXTS] + [p for _, p in licenses.PHRASES] * 4
    rows = list(ODD)
    for i in range(120):
        words = [rng.choice(["the", "of", "software", "license", "mit", "cc", "by", "by", "größe", "and", "apache"]) for _ in range(40)]
        for _ in range(rng.randint(0, 3)):
            some = rng.choice(passages).split()
            for _ in range(rng.randint(0, 3)):  # edits: words replaced, left out, put in
                at = rng.randrange(len(some))
                some[at:at + rng.randint(0, 1)] = rng.choice([[], ["word"], ["two", "more"]])
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["(", ""]) + w for w in some]
        rows.append((100 + i, " ".join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return rows + rows[-3:]


def scan_plainly(text):
    w = license_words(text)
    places = sorted((i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    for label, passage in licenses.TEXTS:
        p = license_words(passage)
        votes = collections.defaultdict(set)
        for i in range(len(w) - 2):
            for j in range(len(p) - 2):
                if w[i:i + 3] == p[j:j + 3]:
                    votes[i - j].add(j)
        span, before = None, None
        spans = []
        for d in sorted(d for d, js in votes.items() if len(js) >= licenses.MIN_VOTES):
            if before is None or d - before > licenses.MAX_SHIFT:
                span = (set(), [])
                spans.append(span)
            span[0].update(votes[d])
            span[1].extend(d + j for j in votes[d])
            before = d
        for js, at in spans:
            share = len(js) / (len(p) - 2)
            if share >= licenses.MIN_SHARE and max(at) + 3 - min(at) <= licenses.MAX_STRETCH * len(p):
                labels.add(label)
                score = max(score, share)
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 9))


def test_license_scan_equals_brute_force(spark):
    rows = license_rows()
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
                              for r in licenses.scan(table(spark, rows)).collect())
    want = collections.Counter((d, *scan_plainly(t)) for d, t in rows)
    assert got == want
    assert any(0 < k[7] < 1 and k[6] and not k[5] for k in got)  # verified passages without a phrase, edited
    assert licenses.scan(table(spark, rows).limit(0)).collect() == []


def test_license_spans_stand_where_the_words_are(spark):
    passage = licenses.TEXTS[-1][1]
    docs = table(spark, [(1, f"one two three. {passage} four")])
    (r,) = licenses.spans(docs).collect()
    assert (r.base, r.label, r.first_word, r.end_word, r.share) == (False, "unlicense", 3, 3 + len(license_words(passage)), 1.0)


def test_license_scan_uses_no_python_workers(spark):
    docs = table(spark, ODD).select("doc_id", "text")
    plan = "".join(f(docs)._jdf.queryExecution().toString() for f in (licenses.spans, licenses.scan))
    assert not re.search(r"InArrow|InPandas|PythonUDF|BatchEval|ArrowEval|CartesianProduct|BroadcastNestedLoop", plan)


VECTORS = "vec_id long, embedding array<double>, label int, _a string, vector string, anchor string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x") for i, v, label in rows], VECTORS)


def mine_plainly(rows, is_anchor, n_pos=5, n_neg=3):
    use = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            use.append((i, tuple(int(np.floor(256 * float(x))) for x in v), label))
    out = []
    for i, v, label in sorted(set(u for u in use if is_anchor(u[0]))):
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in use if j != i))
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            fit = [(j, -t) for t, j, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:n_neg]
            out += [(i, p, n, j, -s, t) for n, (j, t) in enumerate(fit, 1)]
    return collections.Counter(out)


def mined(df, **more):
    rows = hardneg.usable(df, __import__("pyspark.sql.functions", fromlist=["col"]).col("label"))
    got = hardneg.mine(rows, rows.where("vec_id % 10 = 0"), **more).collect()
    return collections.Counter(tuple(r) for r in got)


@pytest.mark.parametrize("sizes", [(1 << 13, 1 << 14, 1 << 8), (40, 7, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("ROWS", "ANCHORS", "CHUNK"), sizes):
        monkeypatch.setattr(hardneg, name, size)
    rng = np.random.default_rng(sizes[1])
    x = rng.normal(size=(260, 6))
    x[30:110] = x[30] + rng.choice([0, 0.01], size=(80, 6))  # a hot group with many ties
    rows = [(i - 20, [float(c) for c in x[i]], int(rng.integers(0, 3))) for i in range(260)]
    rows += [rows[20], rows[20], (rows[33][0], rows[34][1], 2), (0, [0.5] * 6, 1)]  # repeated rows and ids
    rows += [(None, [1.0] * 6, 1), (500, None, 1), (510, [1.0] * 6, None), (520, [float("nan")] * 6, 1), (530, [None, 1.0], 1),
             (540, [float("inf")] * 6, 1), (550, [], 0), (560, [2.0], 0), (570, [0.0] * 6, 2), (580, [-3.0] * 6, 2), (590, [1.0] * 6, 9)]
    got = mined(vectors(spark, rows))
    assert got == mine_plainly(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_hard_negatives_with_large_components_and_empty_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=3) * 1e5], int(i % 2)) for i in range(40)]
    assert mined(vectors(spark, rows)) == mine_plainly(rows, lambda i: i % 10 == 0)
    big = np.array([[3.0e9, 5.0], [1.0, 2.0**60]])
    assert hardneg.inner(big, big).tolist() == [[9 * 10**18 + 25, 3 * 10**9 + 5 * 2**60], [3 * 10**9 + 5 * 2**60, 2**63 - 1]]
    assert not mined(vectors(spark, rows).limit(0)) and not mined(vectors(spark, rows[:1]))


def test_suffix_merges_answer_overlapping_windows():
    rng = random.Random(2)
    for _ in range(50):
        scores = sorted((rng.randint(-20, 200) for _ in range(5)), reverse=True)
        entries = [(rng.randint(-20, 200), i) for i in range(30)]
        ends, _ = hardneg.slot_limits(scores, 50, 95)
        tops = collections.defaultdict(list)
        for value, i in sorted(entries, key=lambda e: (-e[0], e[1])):
            slot = sum(end >= value for end in ends) - 1
            if slot >= 0 and len(tops[slot]) < 3:
                tops[slot].append((value, i))
        for s, merged in enumerate(hardneg.suffix_firsts(tops, len(ends), 3)):
            assert merged == sorted((e for e in entries if e[0] <= ends[s]), key=lambda e: (-e[0], e[1]))[:3]


def test_gallop_equals_binary_search():
    rng = np.random.default_rng(4)
    for _ in range(60):
        longer = np.cumsum(rng.integers(1, 6, rng.integers(1, 300)))
        values = np.sort(rng.integers(0, longer[-1] + 1, rng.integers(0, 200)))
        hint = rng.integers(0, len(longer), len(values))
        assert (crosstok.gallop(values, longer, hint) == np.searchsorted(longer, values)).all()


def align_plainly(rows):
    """The contract restated on token lists, with the vocabulary's own library."""
    import sentencepiece
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(VOCABULARY)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = crosstok.byte_letters()

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()
    docs, held = [], collections.Counter()
    for d, text in rows:
        a, b = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids, b_tok.encode(text or "")
        pieces = [[bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a], [b_bytes(i) for i in b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in pieces):
            docs.append((d, [], [], collections.Counter(), []))
            continue
        spans = []
        for p in pieces:
            stop = np.cumsum([len(x) for x in p]).tolist()
            spans.append(list(zip([0] + stop[:-1], stop)))
        links = collections.Counter((a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1])
                                    if s < v and u < e)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append([[str(ids[i]) for i, (s, e) in enumerate(sp) if low <= s and e <= cut] for ids, sp in zip((a, b), spans)])
            low = cut
        docs.append((d, a, b, links, groups))
        held.update(set(links))
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return collections.Counter(
        (d, len(a), len(b), len(groups), sum(links.values()), sum(t for p, t in links.items() if held[p] == best[p[0]]),
         sum(t * held[p] for p, t in links.items()),
         hashlib.sha256(";".join("|".join(",".join(side) for side in g) for g in groups).encode()).hexdigest() if a else "")
        for d, a, b, links, groups in docs)


@pytest.mark.parametrize("broadcast", [crosstok.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(crosstok, "BROADCAST_PAIRS", broadcast)
    monkeypatch.setattr(crosstok, "CHUNK_BYTES", 300)
    rng = random.Random(7)
    stock = ["the", "licence", "größer", "l'été", "naïve", "漢字", "🙂🙂", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "\t", "\n\n", "   ",
             "\0", "don't", "12345", "̈x", "Straßenbahnhaltestelle", "a▁b" if broadcast else "ab", "…"]
    rows = [(i, "".join(rng.choice(stock) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows += [(d, t if d != 6 else t[:3000]) for d, t in ODD] + rows[:2] + [(None, " "), (70, "▁"), (71, "a" * 700), (72, " x")]
    got = collections.Counter(tuple(r) for r in crosstok.align(table(spark, rows), VOCABULARY, MODEL).collect())
    assert got == align_plainly(rows)
    assert crosstok.align(table(spark, rows).limit(0), VOCABULARY, MODEL).collect() == []


def test_byte_level_ids_are_those_of_the_file():
    from tokenizers import Tokenizer
    with open(VOCABULARY, encoding="utf-8") as f:
        made = crosstok.ByteLevel(f.read())
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    rng = random.Random(1)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(chr(c) + "a" + chr(c) * 2 for c in rng.sample(points, 200)) for _ in range(100)]
    texts += [" " * 300000, "x" + " \t" * 150000 + "y", "ab" * 150000]
    assert made.encode(texts) == [own.encode(t, add_special_tokens=False).ids for t in texts]
