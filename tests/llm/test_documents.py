"""Operators on documents: brute force on small tables, and defined results for odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from packetlens.llm import cnn, decontam, line_dedup, packing, rules, simhash, suffixes
from tests.llm.helpers import LONG, no_documents, odd_documents


def sentence(r, n):
    return " ".join(r.choice("abcdefghijklmnop") + str(r.randrange(300)) for _ in range(n))


# -- 1 packing


def test_pieces_and_ids():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    reference = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "a<|endoftext|>b", " it's\r\n  \u00e9\U0001f600", LONG[:3000]):
        want = reference.encode(text, add_special_tokens=False).ids + [0]
        assert packing.ids_of(text).tolist() == want
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(4100) == [(0, 4), (4, 2048), (2052, 2048)]


def test_long_runs_of_blanks(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    reference = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 2_000_000 + "x<|endoftext|>\u00e9", "\n" * 2_000_000]
    for text in texts:
        assert packing.ids_of(text).tolist() == reference.encode(text, add_special_tokens=False).ids + [0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(docs).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in rows} == {i: len(packing.ids_of(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_rank_once_and_is_best_fit(seed):
    r = random.Random(seed)
    histogram = dict(Counter(r.randint(1, 40) if r.random() < 0.7 else 64 for _ in range(500)))
    plan = packing.plan_slots(histogram, 64)
    taken, ranks = defaultdict(int), defaultdict(list)
    for length, rank, n, first, each, offset in plan:
        for i in range(n):
            s = first + i // each
            ranks[length].append(rank + i)
            assert taken[s] == offset + i % each * length
            taken[s] += length
    assert {k: len(v) for k, v in ranks.items()} == histogram
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    room = []  # best fit decreasing, document by document
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fit = min((x for x in room if x >= length), default=64)
        if fit in room:
            room.remove(fit)
        room.append(fit - length)
    assert len(taken) == len(room) and max(taken.values()) <= 64


def test_pack_documents(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, with_ids=True).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, len(by_doc) if r.doc_id in (1, None) else 0].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    assert [x for r in long for x in r.ids] == packing.ids_of(LONG).tolist()
    assert all(r.length == 2048 for r in long[1:]) and [r.start for r in long] == list(np.cumsum([0] + [r.length for r in long[:-1]]))
    assert sum(r.doc_id == 1 for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 2
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[0], [0]]
    assert packing.pack_documents(no_documents(spark)).count() == 0


# -- 2 rules


def slow_repeats(words, size=5):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    counts = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(size)})


def test_measures_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["a ", "b ", "A", "!\n", "#", " \t", "c\n", "\u00e9 "]) for _ in range(r.randrange(80)))
        m = dict(zip(rules.MEASURES, rules.measure(text)))
        words = text.encode().split()
        assert m["n_words"] == len(words) and m["word_chars"] == sum(len(w.decode()) for w in words)
        assert m["n_repeat_words"] == slow_repeats(words) and m["n_symbols"] == text.count("#")
        lines = text.split("\n")
        assert m["n_dup_lines"] == sum(bool(x.split()) and x in lines[:i] for i, x in enumerate(lines))
    assert rules.repeated_words("a b c d e a b c d e".encode().split()) == 10


def test_ledger_policies_and_ablations(spark):
    good = "Plain words in a sentence that says nothing odd at all, only more words."
    docs = odd_documents(spark, [good, "$$$ %%% &&& " * 20, "SHOUT!! LOUD!! NOW!! " * 8, "a b c"])
    ledger = rules.ledger(docs)
    kept = {r.doc_id for r in ledger.filter(rules.passes()).collect()}
    assert 100 in kept and not kept & {2, 3, 4, 101, 102, 103}
    assert set(rules.keep_good(docs).columns) == set(docs.columns)
    rows = ledger.select("_q_failed").collect()
    for a in rules.ablations(ledger).collect():
        mask, bit = rules.mask_of(a.policy), rules.BIT[a.rule]
        assert a.n_docs == len(rows) and a.n_kept == sum(not r[0] & mask for r in rows)
        assert a.n_kept_without == sum(not r[0] & mask & ~bit for r in rows)
        assert a.n_only == sum(r[0] & mask == bit for r in rows)
    assert rules.ledger(no_documents(spark)).count() == 0


# -- 4 simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    fps = list({f for _, f in rows})
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
                parent[find(x)] = find(y)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return Counter((d, f, least.get(find(f))) for d, f in rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for text in (None, "", "one", "One two", "a B c", "a b c d a b c", LONG[:5000], "\u00c9 x\u00a0y z"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("hot", [1, 20_000])
def test_components_against_all_pairs(spark, hot):
    r = random.Random(5)
    rows = []
    for _ in range(12):  # chains and crowds of near fingerprints, on both sides of the sign
        x = r.getrandbits(64)
        for _ in range(25):
            rows.append((r.randrange(400) if r.random() < 0.95 else None, signed(x)))
            for b in r.sample(range(64), r.choice([0, 1, 2, 2, 3])):
                x ^= 1 << b
    got = Counter(map(tuple, simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long"), hot).collect()))
    assert got == slow_components(rows)


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[2, 0] == got[3, 0] == got[4, 0] == got[None, 0] == 2
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 5, 6]
    assert simhash.keep_one(no_documents(spark)).count() == 0


# -- 5 classifier


def test_classifier_learns_and_sees_whole_texts(spark):
    r = random.Random(2)
    texts = [sentence(r, 60) if i % 2 else " ".join(w + "$$$" for w in sentence(r, 60).split()) for i in range(160)]
    docs = odd_documents(spark, texts)
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(160)] + [(None, 1), (100, None)], "doc_id long, quality int")
    net = cnn.train(docs, labels, cnn.Training(epochs=6))
    rows = cnn.with_score(docs, net).withColumn("held_out", cnn.held_out(docs.doc_id)).collect()
    assert len(rows) == 170 and all(0 <= x.score <= 1 for x in rows)
    out = [x for x in rows if x.held_out and (x.doc_id or 0) >= 100]
    assert len(out) > 10 and all((x.score > 0.5) == (x.doc_id % 2 == 1) for x in out)
    assert {x.doc_id for x in rows if x.held_out and x.doc_id} == {x.doc_id for x in rows if x.doc_id and zlib.crc32(str(x.doc_id).encode()) % 5 == 0}
    long = (texts[1] * 3000).encode()
    chunks, _, weight = cnn.chunks_of([long])
    whole = 1 / (1 + np.exp(-np.average(net.chunk_logits(net.pooled(chunks)), weights=weight)))
    assert abs(net.score([b"x", long, b""])[1] - whole) < 1e-6
    assert net.score([long + (texts[0] * 9000).encode()])[0] < 0.5 < whole
    assert cnn.with_score(no_documents(spark), net).count() == 0
    assert cnn.train(docs, labels.limit(0)).score([b"a"])[0] == 0.5


def test_gradients_match_differences():
    r = random.Random(4)
    texts, y = [sentence(r, 150).encode() for _ in range(4)], np.array([0.0, 1, 1, 0])
    net = cnn.Network(3)
    parts = cnn.chunks_of(texts)
    loss = lambda: -np.mean(np.log(np.where(y == 1, net.score(texts), 1 - net.score(texts))))
    g = net.gradients(*parts, y, np.ones(4))
    for name, at in (("out", 3), ("hidden", (5, 2)), ("filters", (9, 4)), ("bias", 7), ("out_bias", 0), ("embed", (ord("a"), 1))):
        own = getattr(net, name)
        keep, step = own[at], 1e-2
        own[at] = keep + step
        up = loss()
        own[at] = keep - step
        down = loss()
        own[at] = keep
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3


# -- 6 decontamination


def benchmark_of(spark, r, n=24):
    texts = [sentence(r, r.randrange(20, 60)) + ". The answer is " + sentence(r, 4) + "." for _ in range(n)]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x y z"), (90, None), (91, " . ")], "item_id long, text string")


def test_leaks_found_and_clean_documents_left(spark):
    r = random.Random(8)
    items, benchmark = benchmark_of(spark, r)
    planted, texts = {}, []
    for i in range(120):
        own = [sentence(r, r.randrange(5, 300)), sentence(r, r.randrange(5, 300))]
        if i % 4 == 0:
            k = r.randrange(len(items))
            words = items[k].split()
            if i % 8 == 0:  # paraphrased: every ninth word replaced, case and punctuation changed
                words = [f"other{j}" if j % 9 == 4 else w.upper() + "," for j, w in enumerate(words)]
            own.insert(1, " ".join(words))
            planted[100 + i] = k
        texts.append(" ".join(own))
    docs = odd_documents(spark, texts)
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(docs, benchmark).collect()}
    assert got == set(planted.items())
    kept = decontam.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(planted)
    assert decontam.leaks(no_documents(spark), benchmark).count() == 0
    assert decontam.drop_leaks(docs, benchmark.limit(0)).count() == docs.count()


def test_candidate_search_recall(spark):
    """Against brute force: every window whose words cover an item by the subsequence rule is near enough."""
    r = random.Random(9)
    items, benchmark = benchmark_of(spark, r, 40)
    block = decontam.Items(list(enumerate(items)))
    docs = [sentence(r, 80).split() + items[i % 40].lower().split() + sentence(r, 90).split() for i in range(80)]
    tokens = [np.array([block.vocabulary.get(decontam.normal(w), -1) for w in d]) for d in docs]
    df = np.zeros(len(block.vocabulary))
    for t in tokens:
        df[np.unique(t[t >= 0])] += 1
    idf = np.log((1 + len(docs)) / (1 + df))
    searcher = decontam.Searcher(block, idf, decontam.latent_space(spark, block, idf))
    rows = [(t[t >= 0], np.flatnonzero(t >= 0), len(t)) for t in tokens]
    got = {(d, i) for d, i, *_ in searcher.find(rows)}
    want = {(d, i) for d, t in enumerate(tokens) for i, w in enumerate(block.ids) if decontam.common_subsequence(w, t.tolist()) >= 0.95 * len(w)}
    assert want and len(got & want) >= 0.9 * len(want) and {(d, d % 40) for d in range(80)} <= got


def test_leaks_of_widespread_items(spark):
    """An item that a third or all of the documents hold, beside rare words of other items."""
    r = random.Random(12)
    items, benchmark = benchmark_of(spark, r, 40)
    words = [w for t in items[2:] for w in t.split()]
    beside = lambda: " ".join(r.choice(words) for _ in range(r.randrange(60, 120)))
    docs = [" ".join([beside(), items[0], beside(), items[1] if i % 3 == 0 else "", beside()]) for i in range(60)]
    for n in (60, 1):
        rows = spark.createDataFrame(list(enumerate(docs[:n])), "doc_id long, text string")
        got = {(x.doc_id, x.item_id) for x in decontam.leaks(rows, benchmark).collect()}
        assert {(d, 0) for d in range(n)} | {(d, 1) for d in range(0, n, 3)} <= got


def test_leaks_behind_similar_passages(spark):
    """An item 16 to 48 words behind a copy of itself in another order, which may be nearer to the item's vector."""
    r = random.Random(13)
    items, _ = benchmark_of(spark, r, 40)
    block = decontam.Items(list(enumerate(items)))
    for low, high in ((4, 16), (16, 49)):
        docs = []
        for i in range(800):
            words = items[i % 40].split()
            half = len(words) // 2
            other = [r.sample(words, len(words)), words[half:] + words[:half]][i % 2]
            docs.append([*sentence(r, r.randrange(40, 80)).split(), *other, *sentence(r, r.randrange(low, high)).split(), *words, *sentence(r, 60).split()])
        tokens = [np.array([block.vocabulary.get(decontam.normal(w), -1) for w in d]) for d in docs]
        df = np.zeros(len(block.vocabulary))
        for t in tokens:
            df[np.unique(t[t >= 0])] += 1
        idf = np.log((1 + len(docs)) / (1 + df))
        space = np.linalg.svd(block.matrix(idf), full_matrices=False)[2][: decontam.RANK].T
        rows = [(t[t >= 0], np.flatnonzero(t >= 0), len(t)) for t in tokens]
        got = {(d, i) for d, i, *_ in decontam.Searcher(block, idf, space).find(rows)}
        assert {(d, d % 40) for d in range(800)} <= got


def test_short_items_are_found_word_for_word(spark):
    r = random.Random(14)
    texts = [sentence(r, 60) for _ in range(80)]
    phrases = []
    for i in range(70):
        words, n = texts[i].split(), 1 + i % 7
        at = r.randrange(60 - n)
        phrases.append(" ".join(words[at : at + n]))
    docs = [f"{a} {b}, {c}" for a, b, c in zip(texts, phrases[::-1] + phrases[:10], texts[::-1])]
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(phrases) if f" {x} " in f" {t} ".replace(",", "")}
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(phrases)), "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.leaks(rows, benchmark).collect()} == want


def test_items_with_lone_marks(spark):
    items = ["the 5 % rule always holds", "cats & dogs live together", "* * *", "one word more ; or - less than that"]
    texts = items + ["so the 5 % rule always holds , yes", "CATS dogs | live together", "cats and dogs live together", "the 5 rule never holds"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(rows, benchmark).collect()}
    assert got == {(0, 0), (1, 1), (3, 3), (4, 0), (5, 1)}


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        assert decontam.common_subsequence(a, b) == row[-1]


# -- 8 line dedup


def test_line_dedup(spark):
    shared = [f"own line {i}\n  Shared LINE \r\n\nlast {i}" for i in range(9)] + ["shared line\nshared Line", "alone"]
    docs = odd_documents(spark, shared)
    out = line_dedup.drop_shared_lines(docs).collect()
    text = {r.doc_id: (r.text, r._ld_n_lines, r._ld_n_dropped) for r in out}
    assert text[100] == ("own line 0\n\nlast 0", 4, 1) and text[109] == ("", 2, 2) and text[110] == ("alone", 1, 0)
    assert text[2] == text[3] == ("", 1, 0) and len(out) == docs.count()
    assert hashlib.sha256(text[5][0].encode()).digest() == hashlib.sha256(LONG.encode()).digest()
    assert Counter(r.doc_id for r in out)[1] == 3
    assert line_dedup.drop_shared_lines(no_documents(spark)).count() == 0


# -- 10 suffixes


def slow_spans(rows):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    where = defaultdict(set)
    for d, w in words:
        for a in range(len(w) - 49):
            where[tuple(w[a : a + 50])].add(d)
    out = set()
    for d, w in words:
        covered = {a + k for a in range(len(w) - 49) if len(where[tuple(w[a : a + 50])]) > 1 for k in range(50)}
        edges = sorted(x for x in covered if x - 1 not in covered), sorted(x + 1 for x in covered if x + 1 not in covered)
        out |= {(d, a, b) for a, b in zip(*edges)}
    return out


def test_repeated_passages_against_brute_force(spark):
    r = random.Random(6)
    passages = [sentence(r, n).split() for n in (49, 50, 51, 80, 200)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 4)):
            p = r.choice(passages)
            a, b = sorted((r.randrange(len(p) + 1), r.randrange(len(p) + 1)))
            parts += [sentence(r, r.randrange(0, 30)), " ".join(p if r.random() < 0.6 else p[a:b])]
        texts.append(" \n".join(parts))
    texts += ["again and again " * 40] * 2 + ["again and again " * 30 + "x"]
    docs = odd_documents(spark, texts)
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    found = suffixes.repeated_passages(docs).collect()
    got = {(x.doc_id, x.start, x.end) for x in found}
    assert got == slow_spans(rows) and len(got) > 50
    assert suffixes.repeated_passages(no_documents(spark)).count() == 0


def test_rows_of_one_id_keep_their_own_places(spark):
    r = random.Random(9)
    a, b, tail = sentence(r, 90), sentence(r, 70), sentence(r, 200)
    texts = [(1, f"{sentence(r, 7)} {a} x"), (1, f"y {sentence(r, 31)} {a} z"), (2, a), (None, f"q {b}"), (None, f"p {tail} {b}"), (3, b), (1, sentence(r, 60)), (4, f"{a[:300]} {tail}")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(repr((d, a, b, t)) for d, t in texts for _, a, b in slow_spans_of(t, d, texts))
    got = suffixes.repeated_passages(rows).join(rows.selectExpr("doc_id as id", "text", "xxhash64(text) as row"), "row").collect()
    assert sorted(repr((x.doc_id, x.start, x.end, x.text)) for x in got) == want


def slow_spans_of(text, doc, rows):
    others = {tuple(w[k : k + 50]) for d, t in rows if d != doc for w in [t.split()] for k in range(len(w) - 49)}
    words = text.split()
    covered = {k + i for k in range(len(words) - 49) if tuple(words[k : k + 50]) in others for i in range(50)}
    edges = sorted(x for x in covered if x - 1 not in covered), sorted(x + 1 for x in covered if x + 1 not in covered)
    return [(doc, a, b) for a, b in zip(*edges)]
