"""Operators on texts against brute force, whole-library results and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verdictlake.llm import decontaminate, editprint, lm, quality, simhash, substrings, text, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "a", "x" * 3000, "é ü ß \x1c z", "İ K ſ", "the " * 900]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_words_and_hashes():
    column = pa.array(["a bb  a", None, "", "\tbb", "x" * (text.BLOCK + 5) + " a", "A"])
    w = text.words(column)
    assert np.diff(w.first).tolist() == [3, 0, 0, 1, 2, 1]
    assert w.hash[0] == w.hash[2] == w.hash[5] and w.hash[1] == w.hash[3]
    assert len(set(w.hash.tolist())) == 4
    assert text.words(column, lower=True).hash[6] == w.hash[0]


def test_token_counts_equal_the_library(spark, table, prose, tokenizer_path):
    texts = [*ODD, prose(400, 1), "a  b \n\n c  <|endoftext|> d", prose(30_000, 2), "no-space" * 20_000, "あ　い" * 400]
    docs = table([(k, t) for k, t in enumerate(texts)] + [(None, "x"), (0, "dup")])
    got = tokens.count_tokens(docs, tokenizer_path).collect()
    assert len(got) == len(texts) + 2
    library = tokens.load(tokenizer_path)
    for r in got:
        if r.doc_id:
            whole = texts[r.doc_id] or ""
            assert r.n_tokens == len(library.encode(whole, add_special_tokens=False))
            assert r.n_bytes == len(whole.encode())
    assert tokens.count_tokens(docs.limit(0), tokenizer_path).count() == 0


def test_spliced_chunks_equal_the_whole(prose, tokenizer_path):
    library = tokens.load(tokenizer_path)
    for whole in [prose(300, 3), "ab" * 500, "a\n\n  b   c " * 60, "x　y " * 80]:
        want = library.encode(whole, add_special_tokens=False).ids
        assert all(tokens.spliced(library, whole, chunk, 3) == want for chunk in (7, 31, 200))


def test_repeated_passages_equal_brute_force(spark, table, prose):
    shared = prose(50, 7)
    texts = [prose(60, 1) + " " + shared + " " + prose(30, 2), prose(80, 3) + " " + shared, prose(34, 4), prose(35, 5), prose(35, 5)]
    texts += [prose(90, 6) + " " + prose(90, 6), "u " * 200, "a b " * 40, *ODD, *[shared + " " + prose(20, 100 + k) for k in range(30)]]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, prose(40, 8))]
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for hot_segments in (substrings.HOT_SEGMENTS, 10, 0):
        got = substrings.without_repeats(table(rows), hot_segments=hot_segments).drop("kept").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert substrings.without_repeats(table(rows).limit(0)).count() == 0


def test_fm_index_counts(prose):
    rng = np.random.default_rng(1)
    sequence = np.concatenate([rng.integers(1, 5, 3000), [0]])
    index = substrings.FMIndex(sequence, 6)
    ends = np.arange(6, 3000)
    seen = Counter(tuple(sequence[e - 6 : e]) for e in ends)
    seen[tuple(sequence[-7:-1])] += 1
    assert index.repeated(sequence, ends, 6).tolist() == [seen[tuple(sequence[e - 6 : e])] > 1 for e in ends]


def brute_fingerprint(t):
    w = WORD.findall(lower(t or ""))
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_equal_brute_force(spark, table, prose):
    base = [prose(200, k) for k in range(25)]
    near = [" ".join(w if k % 60 else "changed" for k, w in enumerate(t.split())) for t in base]
    rows = list(enumerate(base + near + base[:6] + ODD)) + [(None, base[3]), (2, base[2])]
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    want = sorted(str((i, f"{prints[k]:016x}", least[root(k)])) for k, (i, _) in enumerate(rows))
    got = simhash.near_groups(table(rows)).select("doc_id", simhash.hexadecimal(F.col("fingerprint")), "component_id")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert simhash.near_groups(table(rows).limit(0)).count() == 0


def test_vantage_shards_lose_no_pair():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64)
    flips = np.zeros(3000, dtype=np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    values = np.concatenate([one, one ^ flips])
    met = np.zeros(3000, dtype=bool)
    for mask, inside in simhash.blocks(4):
        row, path = simhash.shards(values, mask, inside, simhash.cuts(values, mask, inside, 7))
        where = [set() for _ in values]
        for r, p in zip(row.tolist(), path.tolist(), strict=True):
            where[r].add(p)
        met |= np.array([bool(where[k] & where[k + 3000]) for k in range(3000)])
    assert met.all()


def test_edit_fingerprints_equal_a_plain_walk(spark, table, prose):
    rows = [(k * 3, prose(20 + k, k)) for k in range(30)] + [(1, None), (2, ""), (4, "é"), (200, prose(9, 77)), (201, prose(9, 77)), (None, "last")]
    stay = editprint.jumps()

    def plain(t):
        now, came, codes = 0, [], editprint.classes(t)
        for c in codes.tolist():
            came.append(now)
            now += int(stay[c * editprint.PERIOD + now % editprint.PERIOD])
        return editprint.sampled(codes, np.array([*came, now]))

    ordered = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        near = editprint.likeness(plain(t), plain(edited)), editprint.likeness(plain(t), plain(after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain(t), plain(edited), *near))
    got = editprint.edit_fingerprints(table(rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert editprint.edit_fingerprints(table(rows).limit(0)).count() == 0
    alone = editprint.edit_fingerprints(table([(5, "only one")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_edit_fingerprint_links(spark, prose):
    base = [prose(300, k) for k in range(12)]
    edited = [" ".join(w if k not in (120, 250) else "edit" for k, w in enumerate(t.split())) for t in base[:8]]
    prints = editprint.fingerprints_of(base + edited + base[:2])
    want = {(12 + k, k) for k in range(8) if prints[k] != prints[12 + k] and editprint.likeness(prints[k], prints[12 + k]) >= 0.8}
    assert len(want) >= 3
    found = editprint.near_links(spark.createDataFrame(list(enumerate(prints)), "id bigint, fingerprint string"))
    assert {(r.a, r.b) for r in found.collect()} == want


def test_lm_base_scores_are_exact_and_the_model_helps(spark, table, prose):
    rows = [(k, (prose(80, k % 40) if k % 4 else prose(60, k)).title()) for k in range(160)]
    rows += [(500 + k, t) for k, t in enumerate(ODD)] + [(None, "a b"), (3, rows[3][1])]
    split = [WORD.findall(lower(t or "")) + [" "] for _, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for ws, h in zip(split, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(i), h, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6))
        for (i, _), ws, h in zip(rows, split, held, strict=True)
    )
    for head in (lm.HEAD, 40):
        got = lm.scores(table(rows), head=head).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm.scores(table(rows).limit(0)).count() == 0


def test_a_filter_above_the_bound_is_asked_in_parts_and_scores_the_same(spark, table, prose, monkeypatch):
    rows = [(k, prose(80, k % 40) if k % 4 else prose(60, k)) for k in range(160)] + [(500 + k, t) for k, t in enumerate(ODD)] + [(None, "a b")]
    want = lm.scores(table(rows)).collect()
    monkeypatch.setattr(lm, "SCORE_SLICE", 1 << 12)
    got = lm.scores(table(rows), most_bits=1 << 13).collect()
    near = [sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows_) for rows_ in (got, want)]
    assert near[0] == near[1]
    # Several parts and several slices of text, which have the same answers as the whole filter.
    monkeypatch.setattr(lm, "SLICE_GRAMS", 50)
    whole = lm.scores(table(rows)).collect()
    dealt = lm.scores(table(rows), most_bits=1 << 13).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in dealt) == sorted((str(r.doc_id), round(r.score, 6)) for r in whole)


def test_no_task_is_sent_the_filter(spark, table, prose, monkeypatch):
    rows = [(k, prose(80, k)) for k in range(160)]
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(len(cloudpickle.dumps(value))) or broadcast(self, value))
    # A filter of 3 MB.
    monkeypatch.setattr(lm, "BITS_PER_TOKEN", 2000)
    assert lm.scores(table(rows)).count() == len(rows)
    assert max(sent, default=0) < 1 << 19


def test_each_n_gram_of_a_chunk_is_asked_once(table, prose, monkeypatch):
    rows = [(k, prose(80, k % 40) if k % 4 else prose(60, k)) for k in range(160)] + [(500 + k, t) for k, t in enumerate(ODD)]
    want = lm.scores(table(rows)).collect()
    written, saved = {}, lm.saved
    monkeypatch.setattr(lm, "saved", lambda df, label, *options: written.setdefault(label, saved(df, label, *options)))
    monkeypatch.setattr(lm, "SCORE_SLICE", 1 << 13)
    got = lm.scores(table(rows)).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(r.doc_id), round(r.score, 6)) for r in want)
    # Texts travel compressed, in chunks of a bounded size.
    chunks = written["chunks"].collect()
    texts = [lm.unpacked(pa.scalar(bytes(r.data))) for r in chunks]
    assert len(chunks) > 4 and sum(len(t) for t in texts) == len(rows)
    assert max(len(r.data) for r in chunks) < 1 << 13
    # Two bytes of answer for each distinct word of a chunk, one for each distinct pair.
    answers = Counter()
    for r in written["answers"].collect():
        answers[r.chunk, r.kind] += len(r.levels)
    for r, own in zip(chunks, texts, strict=True):
        split = [WORD.findall(lower(t.decode())) + [" "] for t in own.column(1).to_pylist()]
        assert answers[r.chunk, 0] == 2 * len({w for ws in split for w in ws})
        assert answers[r.chunk, 1] == len({p for ws in split for p in zip(ws, ws[1:], strict=False)})


def test_chunks_of_empty_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lm, "SCORE_SLICE", 5000)
    docs = spark.range(20_000).selectExpr("id AS doc", "CAST('' AS BINARY) AS text", "false AS held").coalesce(1)
    sizes = [len(lm.unpacked(pa.scalar(bytes(r.data)))) for r in lm.packed(docs).collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 12_000


def test_n_grams_travel_in_few_bytes_and_arrive_the_same():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5000, 1_000_000):
        gram = np.unique(np.append(rng.integers(0, 1 << 64, size, dtype=np.uint64), np.uint64((1 << 64) - 1)))
        n = rng.integers(0, 300, len(gram))
        sent = lm.travelling(gram, n, 1, 7, 640, 4)
        column = {name: sent.column(name) for name in sent.schema.names}
        length = column["size"].to_numpy()
        assert (lm.arrived(column["first"].to_numpy(), length, column["grams"].to_pylist()) == gram).all()
        assert (lm.from_low_bytes(column["counts"].to_pylist(), length) == n.astype(np.uint64)).all()
        assert (column["at"].to_numpy() == np.cumsum(length) - length).all()
        # All n-grams of a row are of its part.
        assert (np.repeat(column["part"].to_numpy(), length) == lm.slice_of(gram, 640).astype(np.int64) // 4).all()
    assert sum(map(len, column["grams"].to_pylist())) <= 6 * len(gram)


def test_filter_levels_are_never_too_low(spark, prose):
    rng = np.random.default_rng(5)
    gram = np.unique(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    made = lm.Filter(np.zeros(1 << 11, np.uint64), 4, 1 << 9)
    count = rng.integers(1, 50, len(gram))
    for g, q in zip(gram, lm.level(count, 1), strict=True):
        for k in range(1, q + 1):
            for place in made.places(np.array([g]), k):
                at = int(made.begin(np.array([g]))[0]) * 64 + int(place[0])
                made.bits[at >> 6] |= np.uint64(1 << (at & 63))
    assert (lm.level(made.counts(gram, 1), 1) >= lm.level(count, 1)).all()


def test_lm_scores_equal_a_model_of_quantised_counts(spark, table, prose, monkeypatch):
    """With a filter so large that no probe hits by chance, scores are those of the counts at their levels."""
    monkeypatch.setattr(lm, "BITS_PER_TOKEN", 20_000)
    rows = [(k, prose(80, k % 40) if k % 4 else prose(60, k)) for k in range(160)] + [(500 + k, t) for k, t in enumerate(ODD)]
    split = {i: WORD.findall(lower(t or "")) + [" "] for i, t in rows}
    training = [ws for i, ws in split.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count, pair = Counter(), Counter()
    for ws in training:
        count.update(ws)
        pair.update(zip(ws, ws[1:], strict=False))
    n, v = sum(count.values()), len(count)

    def quantised(c, kind):
        return lm.value_of_levels(kind)[lm.level(np.array([c]), kind)[0]] if c else 0.0

    def shares(ws, own):
        seen = [max(quantised(count[w], 0) - own, 0) for w in ws]
        for k, w in enumerate(ws):
            plain = (seen[k] + 1) / (n + v + 1)
            if k == 0:
                yield plain, 0.0, None
                continue
            before = max(seen[k - 1], 1)
            both = max(quantised(pair[ws[k - 1], w], 1) - own, 0)
            yield plain, min(both, seen[k], before) / before, min(int(math.log2(before)), lm.CONTEXTS - 1)

    gain = np.zeros((lm.CONTEXTS, len(lm.MIXES)))
    for ws in training:
        for plain, after, kind in shares(ws, 1):
            if kind is not None:
                gain[kind] += np.log((1 - lm.MIXES) * plain + lm.MIXES * after)
    best = np.where(gain.any(axis=1), lm.MIXES[gain.argmax(axis=1)], 0.1)
    want = {}
    for i, ws in split.items():
        want[i] = sum(math.log10(p if k is None else (1 - best[k]) * p + best[k] * a) for p, a, k in shares(ws, 0))
    got = {r.doc_id: r.score for r in lm.scores(table(rows)).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_the_list_of_frequent_words_stays_in_its_bound(spark):
    words = [(f"w{k}".encode(), 2000) for k in range(3000)] + [(f"x{k}".encode(), 5000 + k) for k in range(50)]
    vocab = spark.createDataFrame(words, "word binary, n bigint")
    value, n, least = lm.head_of(vocab, 100)
    assert len(value) == 50 and n.min() == 5000 == least
    assert len(lm.head_of(vocab, 10)[0]) <= 10
    assert len(lm.head_of(vocab, 4000)[0]) == 3050
    assert len(lm.head_of(vocab.filter("n = 2000"), 100)[0]) == 0


def test_quality_keeps_prose_and_rejects_junk(spark, table, prose):
    good = [(k, prose(60, k).capitalize() + ".") for k in range(120)]
    junk = [(1000 + k, " ".join(w + "$#%"[j % 3] * 3 for j, w in enumerate(prose(60, 900 + k).split()))) for k in range(40)]
    odd = [(2000 + k, t) for k, t in enumerate(ODD)] + [(None, prose(60, 5)), (3, good[3][1])]
    labels = spark.createDataFrame([(i, 1) for i, _ in good[::2]] + [(i, 0) for i, _ in junk[::2]] + [(None, 1), (7, None)], "doc_id bigint, quality int")
    docs = table(good + junk + odd)
    drawn = quality.resampled(docs, labels).collect()
    kept = {r.doc for r in drawn if r.kept}
    assert len(drawn) == docs.count()
    assert {i for i, _ in good} <= kept and not kept & {i for i, _ in junk}
    exact = quality.resampled(docs, labels, k=30)
    assert sum(r.kept for r in exact.collect()) == 30
    assert set(quality.good_documents(docs, labels).columns) == set(docs.columns)
    assert quality.resampled(docs.limit(0), labels).count() == 0
    assert quality.resampled(docs, labels.limit(0)).filter("kept").count() == docs.count()


def test_threshold_is_the_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.randint(-(10**9), 10**9) for _ in range(500)] + [77] * 20
    keys = spark.createDataFrame([(v,) for v in values], "key bigint")
    for k in (1, 10, 250, 520):
        assert quality.threshold_of_largest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_automaton_accepts_one_edit():
    terms = ("moron", "idiot", "stem*")
    automaton = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(3000):
        word = list(rng.choice(terms[:2]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "o", "x", "m", "id"])
        word = "".join(word)
        if word.startswith("stem"):
            continue
        near = [t for t in terms[:2] if distance(word, t) <= 1]
        found = automaton.match(word)
        assert bool(found) == bool(near), word
        assert not found or found[2] == (word in terms)
    assert automaton.match("stemming") == ("stem*", "stem*", True) and automaton.match("item") is None


def test_toxic_terms_are_learned_and_quotation_counts_less(spark, table, prose):
    bad = ["blockhead", "dunderpate", "nitwitted"]
    rng = random.Random(9)

    def toxic(k):
        w = prose(50, k).split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(k, toxic(k) if k % 4 == 0 else prose(50, k)) for k in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (10**6, None)], "doc_id bigint, toxic int")
    docs = table(rows + [(2000 + k, t) for k, t in enumerate(ODD)] + [(None, "blockhead"), (0, rows[0][1])])
    model = toxicity.train(docs, labels)
    assert set(bad) <= {t.removesuffix("*") for t in model.terms} | {b for b in bad for t in model.terms if t.endswith("*") and b.startswith(t[:-1])}
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    plain = toxicity.context_weight("you are a blockhead today".split(), 3)
    assert toxicity.context_weight('the word "blockhead" means fool'.split(), 2) < 0.2 < plain
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, labels.limit(0)).terms == ()


def test_benchmark_passages_are_found_with_substitutions(spark, table, prose):
    items = [(k, prose(40, 5000 + k)) for k in range(6)] + [(6, prose(5, 6000)), (7, None), (8, ""), (9, prose(40, 5000))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, words string")
    swapped = " ".join(w if k % 9 else "other" for k, w in enumerate(items[1][1].split()))
    rows = [(0, prose(50, 1) + " " + items[0][1].upper() + ", " + prose(20, 2)), (1, swapped), (2, prose(30, 3) + " " + items[6][1])]
    clean = [(10 + k, prose(200, 40 + k)) for k in range(20)] + [(90, " ".join(items[2][1].split()[:9])), *[(100 + k, t) for k, t in enumerate(ODD)]]
    docs = table(rows + clean + [(None, items[3][1]), (0, rows[0][1])])
    got = decontaminate.marked(docs, benchmark).collect()
    assert len(got) == docs.count()
    assert {r.doc_id for r in got if r.contaminated} == {0, 1, 2, None}
    assert {r.words_hit for r in got if r.doc_id == 0} == {40}
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in clean}
    assert decontaminate.marked(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.marked(docs.limit(0), benchmark).count() == 0


def test_every_allowed_substitution_is_found(spark, table):
    item, short, pad = [f"w{k}" for k in range(13)], [f"s{k}" for k in range(6)], [f"p{k}" for k in range(5)]
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short)), (2, " ".join(item))], "item_id bigint, text string")

    def changed(words, places):
        return " ".join(pad + ["other" if k in places else w for k, w in enumerate(words)] + pad)

    two = [(a, b) for a in range(13) for b in range(a, 13)]
    rows = [(k, changed(item, places)) for k, places in enumerate(two)]
    rows += [(200 + k, changed(short, {k})) for k in range(6)]
    clean = [(300, changed(item, {0, 5, 12})), (301, changed(short, {0, 5}))]
    got = {r.doc_id: r for r in decontaminate.marked(table(rows + clean), benchmark).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {i for i, _ in rows}
    assert all(got[k].n_items == 2 and got[k].words_hit == 13 for k in range(len(two)))


def test_decontamination_runs_no_python(spark, tiny, plan_of):
    docs, benchmark = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    assert not re.search("Python|Pandas|Arrow", plan_of(decontaminate.marked(docs, benchmark)))
