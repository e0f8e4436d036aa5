import re
import zlib
from collections import Counter, defaultdict
from math import exp, log, log2, log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from lodestone.llm import op5_neardup, op7_lm, op8_substring, op10_licenses
from lodestone.llm.common import _pack, pack_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark, odd, rows, empty):
    got = op5_neardup.near_duplicates(odd).collect()
    fps = [plain_fingerprint(r[1] or "") for r in rows]
    groups = plain_components(fps)
    least = {}
    for g, r in zip(groups, rows, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter((r[0], f, least.get(g)) for r, f, g in zip(rows, fps, groups, strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert op5_neardup.near_duplicates(empty).count() == 0


def planted_codes():
    """Chains, dense families and far values."""
    rng = np.random.default_rng(7)
    codes = set()
    for _ in range(12):
        c = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(25):
            codes.add(c)
            c ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))
    hub = int(rng.integers(0, 2**63))
    codes |= {hub ^ (1 << i) for i in range(64)} | {0, 1, 3, 2**64 - 1}
    codes |= {int(x) for x in rng.integers(0, 2**63, 4000)}
    return sorted(codes)


@pytest.mark.parametrize("lot", [100, 1 << 20])
def test_index_finds_chains(spark, lot):
    """Across ranges and lots."""
    codes = planted_codes()
    prints = spark.createDataFrame([(i, op5_neardup.signed(c)) for i, c in enumerate(codes)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in op5_neardup.components_of(prints, lot=lot).collect()}
    close = np.array(codes, np.uint64)
    near = [(i, j) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(close[:i] ^ close[i]) <= 2).tolist()]
    root = list(range(len(codes)))
    for i, j in near * 30:
        root[i] = root[j] = min(root[i], root[j])
    assert [got[i] for i in range(len(codes))] == root


def test_groups_are_pruned(spark):
    """The index, not a comparison of all, finds the neighbours: whole ranges and most groups are dropped unseen."""
    codes = np.unique(np.random.default_rng(12).integers(0, 2**63, 60_000)).astype(np.int64)
    n = len(codes)
    got = op5_neardup.pruning(spark.createDataFrame(pd.DataFrame({"key": codes, "fp": codes}))).collect()
    assert len(got) > 40 and sum(r["members"] for r in got) == n
    assert sum(r["guests"] for r in got) < 0.6 * n * (len(got) - 1) / 2
    assert sum(r["tested"] for r in got) < n * n / 15 and sum(r["dropped"] for r in got) > 0.5 * sum(r["tested"] for r in got)


@pytest.mark.parametrize(("radius", "apart"), [(0, 0), (2, 0), (6, 1)])
def test_gray_index_is_exact(radius, apart):
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 2**20, 3000).astype(np.uint64) << np.uint64(7)
    groups = rng.integers(0, 9, 3000)
    order, index = op5_neardup.index_of(codes, groups)
    found = [(q.tolist(), order[e].tolist()) for q, e in index.near(codes, groups, radius, apart)]
    got = {(a, b) for i, j in found for a, b in zip(i, j, strict=True)}
    want = {(a, int(b)) for a in range(3000) for b in np.flatnonzero((np.bitwise_count(codes ^ codes[a]) <= radius) & (abs(groups - groups[a]) <= apart))}
    assert got == want and sum(len(i) for i, _ in found) == len(got)


def test_similar_texts_are_found(spark):
    """Copies with edited words, of five-word similarity 0.8 or more: at least nine of ten go, texts of their own all stay."""
    rng = np.random.default_rng(11)
    common = ["the", "of", "and", "a", "in", "to"]
    words = common * 60 + ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(3000)]
    docs, copies = [], []
    for i in range(200):
        own = rng.choice(words, rng.integers(80, 500)).tolist()
        docs.append((i, " ".join(own)))
        for k in range(3):
            edited = list(own)
            for at in rng.choice(len(own), max(1, int(len(own) * rng.uniform(0.002, 0.02))), replace=False):
                edited[at] = str(rng.choice(words)) + "x"
            a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (own, edited))
            if len(a & b) >= 0.8 * len(a | b):
                docs.append((1000 + 3 * i + k, " ".join(edited)))
                copies.append(1000 + 3 * i + k)
    kept = {r["doc_id"] for r in op5_neardup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(copies) > 400
    assert {i for i, _ in docs if i < 1000} <= kept
    assert sum(i not in kept for i in copies) >= 0.9 * len(copies)


def test_language_model(spark, odd, rows, empty):
    got = op7_lm.score_documents(odd, block_bytes=20_000).collect()
    assert len(got) == len(rows)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter()
    for r in rows:
        if not held(r[0]):
            counts.update([*WORD.findall(lower(r[1])), None])
    n, v = sum(counts.values()), len(counts)
    want = {}
    for r in rows:
        own = [*WORD.findall(lower(r[1])), None]
        base = sum(log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want.setdefault(r[0], []).append((len(own), sum(counts[w] > 0 for w in own), round(base, 6)))
    for r in got:
        assert (r["n_tokens"], r["n_known"], round(r["base_score"], 6)) in want[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n and r["score"] < 0
    assert op7_lm.score_documents(empty).count() == 0


def test_model_predicts_held_out_text(spark, sf):
    """On held-out documents far better than bytes drawn evenly, and a text's score depends on itself alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sizes = {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}
    got = {r["doc_id"]: r for r in op7_lm.score_documents(docs).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    bits = -sum(got[i]["score"] for i in held) / log10(2)
    assert bits / sum(sizes[i] + 1 for i in held) < 2.4
    again = {r["doc_id"]: r for r in op7_lm.score_documents(docs, block_bytes=50_000).collect()}
    assert all(abs(again[i]["score"] - r["score"]) < 1e-6 for i, r in got.items())


def plain_scores(docs):
    """Scores bit by bit, by counts in dictionaries that are keyed by the contexts themselves."""
    steps, begin, nodes, bits = (x.tolist() for x in op7_lm.code())

    def letters(chunk):
        symbols = [*chunk.rstrip(" ").encode(), 256 if chunk.endswith(" ") else 32]
        for i, s in enumerate(symbols):
            line = max([k + 1 for k in range(i) if symbols[k] == 10], default=0)
            before = [tuple(symbols[max(0, i - 2) : i]), tuple(symbols[max(0, i - 4) : i]), tuple(symbols[line:i])]
            for step, at in enumerate(range(begin[s], begin[s] + steps[s])):
                yield 2 * min(i, 3) + min(step, 1), [(k, c, nodes[at]) for k, c in enumerate(before)], bits[at]

    def places(text):
        chunks = op7_lm.chunks_of(text)
        return [(tuple(["<2>", "<1>", *chunks][i : i + 2]), c) for i, c in enumerate(chunks)]

    counts, follow = Counter(), defaultdict(Counter)
    for i, t in docs:
        if not op7_lm.is_held_out(i):
            for context, chunk in places(t):
                follow[context][chunk] += 1
                counts.update((key, bit) for _, keys, bit in letters(chunk) for key in keys)
    tag = lambda c: int(op7_lm.mix(op7_lm._hashes([c]))[0]) >> 52

    def flag(context, chunk, learned):
        known = Counter(follow.get(context, {}))
        if learned:
            known[chunk] -= 1
        n = sum(known.values())
        if not n:
            return None
        order = sorted(known, key=lambda c: (-known[c], tag(c)))
        hit = order[0] == chunk if not learned else all(known[c] < known[chunk] for c in known if c != chunk)
        often = known[order[0]]
        return hit, n, min(15, max(-16, round(4 * log((often + 0.4) / (n - often + 0.4))))) / 4

    def score(doc_id, text):
        total, spent, streak = 0.0, 0, 0
        weights, bands = None, None

        def code(gate, x):
            nonlocal total, spent
            w, rights = weights.setdefault(gate, list(op7_lm.START[2 if gate >= 8 else gate % 2])), bands.setdefault(gate, {})
            dot = min(9.0, max(-9.0, sum(a * b for a, b in zip(w, x, strict=True))))
            band, hit = int(2 * abs(dot)), dot >= 0
            told = rights.get(band, 1 / (1 + exp(-(band + 0.5) / 2)))
            sure = 1 / (1 + exp(-abs(dot)))
            both = (sure + told) / 2
            total -= log2(both if hit else 1 - both)
            rights[band] = told + op7_lm.BAND_RATE * (hit - told)
            error = 1 - sure if hit else sure
            w[:] = [a + op7_lm.RATE * error * b for a, b in zip(w, x, strict=True)]
            spent += 1

        part = -1
        for context, chunk in places(text):
            items = []
            found = flag(context, chunk, not op7_lm.is_held_out(doc_id))
            if found:
                hit, n, odds = found
                sign = 1 if hit else -1
                items.append([(8 + 4 * (min(n, 3) - 1) + min(streak, 3), [sign * odds, sign, 0, 0])])
            if not (found and found[0]):
                item = []
                for gate, keys, bit in letters(chunk):
                    x = [min(127, max(-127, round(log((counts[k, 1] + 0.1) / (counts[k, 0] + 0.1)) * 16))) / 16 for k in keys] + [1]
                    item.append((gate, x if bit else [-v for v in x]))
                items.append(item)
            streak = streak + 1 if found and found[0] else 0
            for item in items:
                if spent // op7_lm.SEGMENT != part:
                    part = spent // op7_lm.SEGMENT
                    weights, bands = {}, {}
                for gate, x in item:
                    code(gate, x)
        return -total * log10(2)

    return [score(i, t) for i, t in docs]


def test_bits_follow_the_mixer(spark):
    """Every bit against a mixer in plain Python (in double precision; the operator mixes in single) with exact contexts; hashed slots would mix some of these 2,000 words."""
    rng = np.random.default_rng(9)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(2_000)]
    docs = [(i, " ".join(words[at : at + 100])) for i, at in enumerate(range(0, len(words), 100))]
    docs += [(100, docs[0][1] + "\nä line\n" + docs[1][1]), (101, "\n \x00a \x00\x00a  "), (102, ""), (103, " ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(800)))]
    docs += [(i, docs[3][1]) for i in range(104, 112)] + [(112, "a b c a b d a b c a b d a b e " * 20), (114, "a b c a b d")]
    got = {r["doc_id"]: r for r in op7_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5_000).collect()}
    want = plain_scores(docs)
    assert sum(op7_lm.code()[0][b] for b in dict(docs)[103].encode()) > op7_lm.SEGMENT
    for (i, t), score in zip(docs, want, strict=True):
        assert abs(got[i]["score"] - score) < 1e-5 * abs(score)
        assert abs(got[i]["bits_per_byte"] * (len(t.encode()) + 1) * log10(2) + score) < 1e-5 * abs(score)


def test_repeated_texts_score_apart(spark):
    """Texts whose copy is in training cost far fewer bits, held out or not."""
    rng = np.random.default_rng(10)
    words = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words, 200))
    docs = [(i, text()) for i in range(80)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)]
    got = {r["doc_id"]: r for r in op7_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), 20_000).collect()}
    learned = {i for i, _ in docs if not op7_lm.is_held_out(i)}
    twice = {i for i in got if i < 20 and 1000 + i in learned} | {i for i in got if i >= 1000 and i - 1000 in learned}
    assert any(got[i]["held_out"] for i in twice) and not all(got[i]["held_out"] for i in twice)
    assert max(got[i]["bits_per_byte"] for i in twice) < 0.5 * min(got[i]["bits_per_byte"] for i in got if 20 <= i < 1000)


def test_contexts_that_training_never_met():
    """No candidate, and no logarithm of a negative count."""
    keys = np.array([1, 2, 3], np.uint64) << np.uint64(op7_lm.TAG)
    with np.errstate(all="raise"):
        outside, within = op7_lm.flag_codes(keys, np.array([0, 1, 2]))
    assert outside.astype(bool).tolist() == [False, True, True] and within.astype(bool).tolist() == [False, False, True]


def test_what_chunks_share_is_handled_once():
    """One edge for all symbols after the same beginning, in whatever chunk; and their items are those of each chunk on its own."""
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice([*"abä\n"], rng.integers(0, 6))) for _ in range(400)]
    names, last, places, begins = op7_lm.places_of([" ".join(words[:250]), " ".join(words[250:]), ""])
    chunks = [n + " " * x for n, x in zip(names.to_pylist(), last.tolist(), strict=True)]
    assert [chunks[k] for k in places[begins[1] :]] == op7_lm.chunks_of(" ".join(words[250:])) + [" "]
    symbols, begins = op7_lm.symbols_of(names, last)
    at, edge, place = op7_lm.edges_of(symbols, begins)
    ends = [*begins[1:].tolist(), len(symbols)]
    walked = [tuple(symbols[a : k + 1].tolist()) for a, b in zip(begins.tolist(), ends, strict=True) for k in range(a, b)]
    assert len(at) == len(set(walked)) < 0.6 * len(symbols)
    assert len(set(zip(walked, edge.tolist(), strict=True))) == len(at) and edge[at].tolist() == list(range(len(at)))
    assert place.tolist() == [len(w) - 1 for w in walked]
    steps, begin, nodes, bits = op7_lm.code()
    odds = rng.integers(-127, 128, 5000).astype(np.int8)
    starts = [rng.integers(0, 4900, len(at)).astype(np.int32) for _ in range(3)]
    packed, sizes = op7_lm.letter_items(symbols, begins, at, edge, place, starts, odds)
    want = []
    for s, e, k in zip(symbols.tolist(), edge.tolist(), place.tolist(), strict=True):
        for step in range(steps[s]):
            kind = 2 * min(k, 3) + (step > 0) + (0 if bits[begin[s] + step] else op7_lm.ZERO)
            want.append([*(-int(odds[start[e] + step]) & 255 for start in starts), kind])
    assert packed[op7_lm.FLAGS :].view(np.uint8).reshape(-1, 4).tolist() == want
    assert sizes.tolist() == [int(steps[symbols[a:b]].sum()) for a, b in zip(begins.tolist(), ends, strict=True)]


def test_odds_of_walks():
    """Against counts of zeros and ones at each node, for contexts that one symbol follows, several, or all."""
    rng = np.random.default_rng(14)
    steps, begin, nodes, bits = op7_lm.code()
    follow = [sorted(rng.choice(257, n, replace=False).tolist()) for n in (1, 1, 2, 3, 9, 257)]
    rank, symbols, _ = op7_lm.code_order()
    keys = np.array(sorted(c << op7_lm.SYMBOL | int(rank[s]) for c, own in enumerate(follow) for s in own), np.uint64)
    counts = rng.integers(0, 50, len(keys))
    size, odds = op7_lm.walk_odds(keys, counts)
    seen, rows = Counter(), []
    for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
        s = int(symbols[key & 511])
        for k in range(begin[s], begin[s] + steps[s]):
            rows.append((key >> 9, int(nodes[k]), int(bits[k])))
            seen[rows[-1]] += n
    want = [round(16 * log((seen[c, node, bit] + 0.1) / (seen[c, node, 1 - bit] + 0.1))) for c, node, bit in rows]
    assert odds.tolist() == [min(127, max(-127, v)) for v in want]
    assert size.tolist() == [int(steps[symbols[k & 511]]) for k in keys.tolist()]


def test_flags_of_few_and_many_counts():
    """The same code whether its odds come from the table of few counts or not."""
    rng = np.random.default_rng(15)
    whole = np.r_[0, 1, op7_lm.FEW, op7_lm.FEW + 1, rng.integers(0, 100, 200)]
    often, hit = rng.integers(0, whole + 1), rng.random(len(whole)) < 0.5
    want = [(min(15, max(-16, round(4 * log((a + 0.4) / (n - a + 0.4))))) + 16 | h << 5 | min(n, 3) << 6) if n else 0 for a, n, h in zip(often.tolist(), whole.tolist(), hit.tolist(), strict=True)]
    assert op7_lm.flag_code(hit, often, whole).tolist() == want


def test_rows_of_lanes():
    """Any stretch of each lane's places, as the whole rows give it."""
    rng = np.random.default_rng(12)
    sizes = rng.integers(1, 9, 60)
    starts, ends = rng.integers(0, 1000, 60), np.cumsum(sizes)
    rows = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes, strict=True)])
    begin = np.sort(rng.choice(len(rows), 12, replace=False))
    end = np.minimum(begin + rng.integers(1, 40, 12), len(rows))
    want = np.concatenate([rows[a:b] for a, b in zip(begin, end, strict=True)])
    assert op7_lm.lane_rows(starts, sizes, ends, begin, end).tolist() == want.tolist()


def test_code_is_complete():
    steps, _, _, _ = op7_lm.code()
    assert len(steps) == 257 and abs(sum(2.0 ** -int(s) for s in steps) - 1) < 1e-9


@pytest.mark.parametrize(("block", "lot"), [(8 << 20, 1 << 20), (20_000, 1 << 20), (20_000, 500)])
def test_substrings(spark, odd, rows, empty, block, lot):
    got = op8_substring.remove_repeats(odd, block_bytes=block, carry=("lang",), lot=lot).collect()
    order = sorted([(r[0], r[1] or "") for r in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, want = set(), Counter()
    for doc_id, text in order:
        words = WORD.findall(text)
        hit = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                hit[i : i + 20] = [True] * 20
            seen.add(w)
        want[doc_id, len(words), sum(hit), " ".join(w for w, h in zip(words, hit, strict=True) if not h)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(WORD.findall(r[1] or ""))
    for r in got:
        assert all(s["length"] >= 20 for s in r["spans"])
        assert len({k for s in r["spans"] for k in range(s["start"], s["start"] + s["length"])}) == r["n_removed"]
        for s in r["spans"]:  # a copy of the source it names, word by word, which lies before it
            assert any(own[s["start"] : s["start"] + s["length"]] == source[s["source_start"] : s["source_start"] + s["length"]] for own in texts[r["doc_id"]] if len(own) == r["n_words"] for source in texts[s["source_doc"]])
            assert (s["source_doc"] is not None, s["source_doc"] or 0) <= (r["doc_id"] is not None, r["doc_id"] or 0)
            assert s["source_doc"] != r["doc_id"] or len(texts[r["doc_id"]]) > 1 or s["source_start"] < s["start"]
    assert op8_substring.remove_repeats(empty).count() == 0


def test_layout_and_nulls_stay(spark):
    passage = "\n".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a\n" + passage), (2, None), (3, "b \n\n c\t" + passage + "\n\nd  e\n"), (4, " x \n y ")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in op8_substring.remove_repeats(docs, layout=True).collect()}
    assert got == {1: "a\n" + passage, 2: None, 3: "b \n\n c\td  e\n", 4: " x \n y "}


def test_equal_hashes_remove_nothing(monkeypatch):
    """All windows share one hash: only words decide."""
    monkeypatch.setattr(op8_substring, "window_hashes", lambda words, width: np.full(max(0, len(words) - width + 1), 5, np.uint64))
    texts = [" ".join(f"{c}{i}" for i in range(50)) for c in "abc"]
    block = lambda texts, n: pa.Table.from_batches(list(_pack(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})]), np.zeros(0, np.int64)))).set_column(0, "block", pa.array([n], pa.int64()))
    none = pa.table({"bucket": [0], "payload": [pack_bytes(np.array([op8_substring.NONE]).tobytes())]})
    assert op8_substring._stretches(block(texts, 0), none, 20, 1).num_rows == 0
    earlier = pa.table({"bucket": [0], "payload": [pack_bytes(np.array([0], np.uint32).tobytes())]})
    asked = op8_substring._stretches(block(texts[1:] + texts[:1], 1), earlier, 20, 1)
    assert asked.num_rows == 3
    got = op8_substring._parse(block(texts, 0), asked, 20)
    assert [len(f.as_py()) for f in got.column("factors")] == [0, 0, 32]  # the copy of the first text alone


def test_stretches_are_unpacked_in_slices(monkeypatch):
    """However many stretches name a block, a few megabytes of their words are held at a time."""
    text = " ".join(f"w{i}" for i in range(150_000))
    block = pa.Table.from_batches(list(_pack(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([7], pa.int64()), "text": [text]})]), np.zeros(0, np.int64)))).set_column(0, "block", pa.array([0], pa.int64()))
    asked = pa.table({"key": range(12), "check": range(12), "words": pa.array([pack_bytes(text.encode())] * 12, pa.binary())})
    held, real = [], op8_substring.Windows
    monkeypatch.setattr(op8_substring, "Windows", lambda parts, width: (held.append(sum(len(w) + 1 for p in parts for w in p)), real(parts, width))[1])
    got = op8_substring._parse(block, asked, 20)
    assert sum(held) == 12 * (len(text) + 1) and max(held) < (4 << 20) + len(text) + 2
    assert got.column("key").to_pylist() == list(range(12))
    assert all(np.frombuffer(f.as_py(), np.int64).tolist() == [0, 150_000, 7, 0] for f in got.column("factors"))


def test_licenses(spark, odd, rows, empty):
    mit = op10_licenses.TEMPLATES[0][1]
    words = mit.split()
    edited = " ".join(words[:20] + ["inserted", "words"] + words[20:40] + words[41:])
    texts = [r[1] for r in rows] + ["x " + edited + " y", "Licensed under CC BY-NC 4.0.", "MIT  license, the MIT-License; apache_license", "general public\nlicense x", "mit licensed", mit + " z " * 50 + mit]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in op10_licenses.scan(df).collect()}
    assert len(got) == len(texts)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        own = pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for phrase, label in op10_licenses.PHRASES for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(own), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    n = len(rows)
    assert [got[n + k]["labels"] for k in range(6)] == ["mit", "cc-by-nc", "apache,mit", "gpl", "", "mit"]
    assert len(got[n + 5]["spans"]) == 2
    assert op10_licenses.scan(empty).count() == 0


def test_pipeline_stages(spark, odd, rows, empty, labels, tmp_path):
    docs, sf = odd, str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns and docs.schema == odd.schema, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    texts = [r["text"] or "" for r in docs.collect()]
    left = [WORD.findall((r["text"] or "").lower()) for r in spark.read.parquet(str(tmp_path / "near_dedup")).collect()]
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in left]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(shingles) for b in shingles[:i])
    windows = Counter(w for t in texts for w in zip(*[WORD.findall(t)[k:] for k in range(20)]))
    before = Counter(w for r in spark.read.parquet(str(tmp_path / "near_dedup")).collect() for w in zip(*[WORD.findall(r["text"] or "")[k:] for k in range(20)]))
    assert max(before.values()) > 1 and sum(windows.values()) < sum(before.values())
    pieces = corpus_pipeline.packing(spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def copies_in_blocks(spark):
    """60 texts in two copies, an earlier and a later one, that fill many blocks of 20,000 bytes."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 300)) for _ in range(60)]
    rows = [(i, texts[i % 60], "en") for i in range(120)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_hot_blocks_are_parsed_in_lots(spark):
    """Lots of 1,000 bytes, many for each block that the later copies name, give the rows of a single lot."""
    texts, docs = copies_in_blocks(spark)
    rows = lambda lot: sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], str(r["spans"])) for r in op8_substring.remove_repeats(docs, block_bytes=20_000, lot=lot).collect())
    got = rows(1000)
    assert got == rows(1 << 30)
    assert [g[2] for g in got] == [0] * 60 + [300] * 60 and [g[3] for g in got[:60]] == texts


def test_pipeline_stage_parses_hot_blocks_in_lots(spark, sf, monkeypatch):
    """The stage of the pipeline, with its further columns and layout, where every named block is hot."""
    texts, docs = copies_in_blocks(spark)
    whole = op8_substring.remove_repeats
    monkeypatch.setattr(op8_substring, "remove_repeats", lambda *a, **kw: whole(*a, **kw, block_bytes=20_000, lot=1000))
    got = sorted(tuple(r) for r in corpus_pipeline.substring_dedup(spark, docs, sf).collect())
    assert got == [(i, t, "en") for i, t in enumerate(texts)] + [(60 + i, "", "en") for i in range(60)]
