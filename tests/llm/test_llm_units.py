"""Parts of the llm operators that need no Spark, against brute force."""

import itertools
import random
import re
import string
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import context_mixing, langid, matroska, ngram_join, packing, quality, shingles, toxicity, warc

TEXTS = [
    None,
    "",
    "a",
    "don't stop²m x½y  a\n\n b\t\tc <|endoftext|> it's.'s !!'s a_b _c d1e2 ...' '' 'll'll",
    "\x1cab\x1d !\x1cx",
    "ﬁ é́ áb Ⅷ ⅷabc ª ºabc",
    "中文。字 ١٢٣ \n \n",
    "a,'s b.'t " * 500,
    "x" * 5000,
]


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return packing.Encoder(public_tokenizers.path(packing.VOCABULARY))


@pytest.mark.parametrize("text", TEXTS[1:])
def test_chunked_encoding_equals_the_tokenizers(encoder, text):
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    got = encoder.encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_cut_leaves_whole_pieces_after_the_first(n):
    pieces = list(packing.cut(bytes(4 * n), 2048))
    assert [p[0] for p in pieces] == list(range(len(pieces)))
    assert sum(p[2] for p in pieces) == n and all(p[2] == 2048 for p in pieces[1:]) and 0 < pieces[0][2] <= 2048
    assert all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:], strict=False))


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("groups", [3, 40, 128])
def test_plan_places_every_piece_once_and_fills_bins_without_gaps(seed, groups):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 2048])
    counts = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.choice([0, 1, 7, 3000])))
    if seed % 3 == 0:
        counts[capacity // 3 + 1] += 1000
    rows, bins = packing.plan_bins(counts, capacity, groups)
    placed, filled = Counter(), {}
    for n, first, count, times, start, offset in rows:
        assert count % times == 0
        placed[n] += count
        for i in range(count):
            filled.setdefault(start + i // times, []).append((offset + i % times * n, n))
        assert first + count <= counts[n]
    assert placed == +counts and len(filled) == bins
    for items in filled.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    spans = {}
    for n, first, count, *_ in rows:
        spans.setdefault(n, []).append((first, count))
    for n, s in spans.items():
        at = 0
        for first, count in sorted(s):
            assert first == at
            at += count


def test_plan_is_near_the_bound_with_small_lengths():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 2048) for _ in range(20_000))
    _, bins = packing.plan_bins(counts, 2048)
    assert bins <= 1.005 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_the_best_fill_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes, values = np.sort(rng.choice(np.arange(9, 60), 5, replace=False))[::-1], rng.random(5)
        times, value = packing.best_fill(sizes, values, 60)
        brute = max(sum(v * t for v, t in zip(values, ts, strict=True)) for ts in itertools.product(range(7), repeat=5) if sum(s * t for s, t in zip(sizes.tolist(), ts, strict=True)) <= 60)
        assert (times * sizes).sum() <= 60 and (times * values).sum() == pytest.approx(value) == pytest.approx(brute)


def test_configurations_cover_the_demand_with_few_bins():
    for demand, capacity, want in (({6: 5, 4: 5, 5: 4}, 10, 7), ({34: 20, 33: 40, 50: 8}, 100, 24), ({7: 9}, 10, 9), ({3: 10}, 10, 10 / 3), ({}, 10, 0)):
        found = packing.configurations(demand, capacity, slack=0.0)
        assert sum(x for _, x in found) == pytest.approx(want)
        for size, n in demand.items():
            assert sum(c.get(size, 0) * x for c, x in found) >= n - 1e-6
        assert all(sum(s * t for s, t in c.items()) <= capacity for c, _ in found)


def test_lengths_are_rounded_up_within_groups_of_equal_number():
    rng = random.Random(3)
    counts = Counter(rng.randint(300, 2048) for _ in range(6400))
    rounded = packing.linear_groups(counts, 64)
    sizes = Counter()
    for n, up in rounded.items():
        assert n <= up
        sizes[up] += counts[n]
    assert len(sizes) <= 64 < len(counts) and max(sizes.values()) <= 100 + max(counts.values())


def record(body, kind="response", extra=b""):
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:1>\r\n%sContent-Length: %d\r\n\r\n" % (kind.encode(), extra, len(body))
    return head + body + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda r: r, lambda r: warc.members(r) + b"\0"])
def test_salvage_recovers_what_follows_a_fault(pack):
    a, b, c = (pack(record(x * n)) for x, n in ((b"a", 10), (b"b", 3000), (b"WARC/1.1\r\n", 3)))
    whole = list(warc.salvage(a + b + c))
    assert [x[3]["payload_bytes"] for x in whole] == [10, 3000, 30]
    broken = bytearray(b)
    broken[len(broken) // 2] ^= 0xFF
    if pack(b"") == b"":
        broken = bytearray(b.replace(b"Content-Length: 3000", b"Content-Length: 2999"))
    found = list(warc.salvage(a + bytes(broken) + c + a[:20] + c + b"tail"))
    good = [x for x in found if isinstance(x[3], dict)]
    gaps = [x for x in found if isinstance(x[3], str)]
    assert [x[3]["payload_bytes"] for x in good] == [10, 30, 30]
    assert [x[1] for x in gaps] == [len(broken), 20, 4]
    assert sum(x[1] for x in found) == len(a) + len(broken) + len(c) * 2 + 24


def test_a_header_may_be_longer_than_a_member(monkeypatch):
    plain = record(b"a").replace(b"\r\nContent-Length", b"\r\nWARC-Target-URI: data:," + b"x" * 100_000 + b"\r\nContent-Length", 1)
    assert [x[3]["payload_bytes"] for x in warc.salvage(plain + plain)] == [1, 1]
    monkeypatch.setattr(warc, "MEMBER_BYTES", 5000)
    zipped = warc.members(plain) + b"\0"
    assert [x[3]["payload_bytes"] for x in warc.salvage(zipped + zipped)] == [1, 1]


def test_a_member_may_hold_several_records_and_gaps():
    inner = record(b"a") + b"junk" + record(b"bb") + record(b"ccc")[:-9]
    zipped = warc.members(inner) + b"\0"
    found = list(warc.salvage(b"??" + zipped + warc.members(record(b"dddd")) + b"\0"))
    assert [(x[0], x[2], x[3]["payload_bytes"]) for x in found if isinstance(x[3], dict)] == [(2, 0, 1), (2, len(record(b"a")) + 4, 2), (2 + len(zipped), 0, 4)]
    assert [x[:3] for x in found if isinstance(x[3], str)] == [(0, 2, None), (2, 4, len(record(b"a"))), (2, len(record(b"ccc")) - 9, len(inner) - len(record(b"ccc")) + 9)]


def test_a_digest_that_differs_is_a_fault():
    bad = record(b"abc", extra=b"WARC-Block-Digest: sha1:AAAA\r\n")
    assert [x[3] for x in warc.salvage(bad)] == ["block digest differs"]


def test_records_larger_than_a_member_are_read(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 200)
    data = record(bytes(1000))
    found = list(warc.salvage(warc.members(data) + b"\0" + warc.members(data) + b"\0"))
    assert [x[3]["payload_bytes"] for x in found] == [1000, 1000]


@pytest.mark.parametrize("n", [1, 8, 9, 400, 401, 1000])
def test_matroska_round_trip(n):
    payload = np.random.default_rng(n).bytes(n * matroska.UNIT)
    table, problem = matroska.packets(media := matroska.mux(payload))
    assert problem is None and len(table) == n
    assert b"".join(media[t[2] : t[2] + t[3]] for t in table) == payload
    assert all(t[7] and t[5] for t in table)
    assert all(abs(t[1] - i * 72_000_000) <= 72_000_000 for i, t in enumerate(table))
    assert matroska.packets(media[:-20])[1] or matroska.packets(media[:-20])[0]


def test_all_lacings():
    e, parts = matroska._element, [b"a" * 300, b"b" * 2, b"c" * 70]

    def block(flags, sizes):
        return e(matroska.SIMPLE_BLOCK, b"\x81\x00\x00" + bytes([flags]) + sizes + b"".join(parts))

    xiph = block(0x02, bytes([2, 255, 45, 2]))
    difference = (2 - 300) + (1 << 13) - 1
    ebml = block(0x06, bytes([2]) + (300 | 1 << 14).to_bytes(2, "big") + (difference | 1 << 14).to_bytes(2, "big"))
    for body, lacing in ((xiph, "xiph"), (ebml, "ebml")):
        media = e(matroska.SEGMENT, e(matroska.CLUSTER, e(matroska.CLUSTER_TIMESTAMP, b"\x05") + body))
        found, problem = matroska.packets(media)
        assert problem is None
        assert [(media[f[2] : f[2] + f[3]], f[6], f[0]) for f in found] == [(p, lacing, 1) for p in parts]


def test_unknown_sizes_and_block_groups():
    e = matroska._element
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x81\x00\x07\x00xyz"))
    cluster = lambda t: matroska._id(matroska.CLUSTER) + b"\xff" + e(matroska.CLUSTER_TIMESTAMP, bytes([t])) + group
    media = matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster(1) + cluster(9)
    found, problem = matroska.packets(media)
    assert problem is None and [f[1] for f in found] == [8_000_000, 16_000_000]


WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingle_sets_equal_brute_force(monkeypatch):
    rng = random.Random(0)
    texts = [None, "", " \t", "A b", "a b c d", "a b c d e", "É é a b c d e", "x" * 3000, *(" ".join(rng.choice("ab cd EF".split()) for _ in range(rng.randint(0, 60))) for _ in range(300))]
    for piece in (1 << 21, 64):
        monkeypatch.setattr(shingles, "_PIECE", piece)
        got = list(shingles.text_sets(pa.array(texts, pa.string())))
        keys = {}
        for text, s in zip(texts, got, strict=True):
            assert len(s) == len(brute_set(text))
            for other, t in keys.items():
                assert len(np.intersect1d(s, t)) == len(brute_set(text) & set(other))
            if len(keys) < 40:
                keys[frozenset(brute_set(text))] = s
    assert len(got) == len(texts)


@pytest.mark.parametrize("seed", range(6))
def test_trees_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64) for _ in range(8)]
    sets = []
    for _ in range(150):
        b = base[rng.integers(8)]
        keep = b[rng.random(len(b)) > rng.choice([0, 0.05, 0.2])]
        more = rng.integers(0, 2**63, rng.integers(0, 1 + len(b) // 6), dtype=np.uint64)
        sets.append(np.unique(np.r_[keep, more, b[:1]]))
    n = np.array([len(s) for s in sets])
    comp, side = rng.integers(0, 90, 150), rng.integers(0, 2, 150) if seed % 2 else np.zeros(150, int)
    maps = [ngram_join.bitmap(s) for s in sets]
    got = set()
    for u, v in ngram_join.tree_pairs(n, comp, maps, side, 75):
        got |= {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist(), strict=True)}
    for i in range(150):
        for j in range(i + 1, 150):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both) and comp[i] != comp[j] and (not side.any() or side[i] != side[j]):
                assert (i, j) in got
    assert all(comp[a] != comp[b] for a, b in got)


def test_kneser_ney_sums_to_one():
    grams = Counter()
    for w in ("banana", "bandana", "cabana", "nab"):
        w = langid.START * 3 + w + langid.END
        grams.update(w[i : i + 4] for i in range(len(w) - 3))
    model = langid.Model(["x"], [langid.kneser_ney(dict(grams))])
    letters = sorted({c for g in grams for c in g} - {langid.START, langid.END})
    for prefix in ("", "ba", "zz"):
        # the end of a word after a prefix, one more letter, or a letter never seen
        stop = np.exp(model.costs([prefix])[0, 0]) if prefix else 0.0
        ahead = sum(np.exp(model.costs([prefix + c + "q"])[0, 0]) >= 0 for c in letters)
        assert stop < 1 and ahead == len(letters)
    h = "ban"
    logs, weights, unknown = model.tables[0]
    total = 0.0
    for c in [*letters, langid.END, "一"]:
        codes = np.array([ord(x) for x in langid.START + h + c], np.uint64)
        p, open_ = 0.0, True
        for n in range(4, 0, -1):
            v, found = logs[n - 1].get(langid.gram_hashes(codes, n)[-1:])
            if found[0]:
                p, open_ = p + v[0], False
                break
            if n > 1:
                w, known = weights[n - 1].get(langid.gram_hashes(codes, n - 1)[-2:-1])
                p += w[0] if known[0] else 0.0
        total += np.exp(p + (unknown if open_ else 0.0))
    assert total == pytest.approx(1.0, abs=1e-6)


WORDS = [b"the", b"cat", b"then", b"thecat", b"\n", b"a", b"\x00\xff", b"x" * 100, b"x" * 63, b"x" * 64 + b"y", "ü".encode()]


def brute_counts(rows):
    """(turn or None, beginning as bits) -> [zeros, ones], of (word, turn, c) rows."""
    found = {}
    for w, turn, c in rows:
        bits = "".join(f"{x:08b}" for x in w + b" ")[: context_mixing.DEPTH * 8]
        for d, bit in enumerate(bits):
            for t in (turn, None):
                found.setdefault((t, bits[:d]), [0, 0])[int(bit)] += c
    return found


def rows_of_words(seed, more=300):
    rng = random.Random(seed)
    words = WORDS + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))).encode() for _ in range(more)]
    return sorted({(w, rng.randint(0, 2)): rng.randint(0, 9) for w in words}.items(), key=lambda x: rng.random())


def check_counts(lot, rows, brute):
    for i, (w, turn) in enumerate(rows):
        bits = "".join(f"{x:08b}" for x in w + b" ")[: context_mixing.DEPTH * 8]
        for part, begin, t in ((lot.any, lot.begin[lot.row[i]], None), (lot.own, lot.own_begin[i], turn)):
            for d in range(len(bits)):
                assert part[begin + d] == context_mixing.coded(*np.array(brute[t, bits[:d]], float)[:, None])[0], (w, t, d)


@pytest.mark.parametrize("seed", range(3))
def test_beginnings_equal_brute_force(seed):
    rows = rows_of_words(seed)
    words, turns, c = [w for (w, _), _ in rows], np.array([t for (_, t), _ in rows]), np.array([float(c) for _, c in rows])
    check_counts(context_mixing.Lot(words, turns, c, []), [k for k, _ in rows], brute_counts([(*k, c) for k, c in rows]))


def mixer_of(rows, bits=16, seed=0):
    zeros, ones = np.zeros(3 << bits, np.float32), np.zeros(3 << bits, np.float32)
    for (w, turn), c in rows:
        flat = context_mixing.Flat.of([w])
        at = context_mixing.hashed_slots(flat.data, flat.places(), np.full(len(flat.data), turn), bits).reshape(3, -1)
        bit = np.unpackbits(flat.data)
        for k in range(3):
            np.add.at(zeros, at[k], c * (1 - bit))
            np.add.at(ones, at[k], c * bit)
    m = context_mixing.Mixer.fresh(zeros, ones, bits)
    m.weights = np.random.default_rng(seed).uniform(0, 0.5, len(m.weights)).astype(np.float32)
    return m


def test_costs_equal_a_coder_that_goes_bit_by_bit():
    rows = rows_of_words(7, 60)
    m, exact = mixer_of(rows, 23), brute_counts([(*k, c) for k, c in rows])
    near = {}
    for (w, turn), c in rows:  # contexts of up to three bytes before, by dictionary
        data = w + b" "
        for j, byte in enumerate(data):
            for order in (1, 2, 3):
                for d, bit in enumerate(f"{byte:08b}"):
                    near.setdefault((turn, order, data[max(0, j - order) : j], f"{byte:08b}"[:d]), [0, 0])[int(bit)] += c

    def cost(w, turn):
        data, total = w + b" ", 0.0
        for j, byte in enumerate(data):
            for d, bit in enumerate(f"{byte:08b}"):
                so_far = "".join(f"{x:08b}" for x in data[:j]) + f"{byte:08b}"[:d]
                pairs = [near[turn, o, data[max(0, j - o) : j], f"{byte:08b}"[:d]] for o in (1, 2, 3)]
                pairs += [exact[t, so_far] if j < context_mixing.DEPTH else [0, 0] for t in (None, turn)]
                pairs = [[2 ** (round(8 * np.log2(1 + n)) / 8) - 1 for n in x] for x in pairs]  # as codes tell them
                z, seen = 0.0, [a + b for a, b in pairs]
                gate = 4 * sum(seen[-1] >= x for x in (0.5, 2.5, 20.5)) + sum(seen[-2] >= x for x in (0.5, 2.5, 20.5))
                for k, (a, b) in enumerate(pairs):
                    level = sum(a + b > x for x in context_mixing.LEVELS) + (7 if min(a, b) < 0.5 else 0)
                    z += m.weights[(k * 16 + gate) * 14 + level] * np.log((b + 0.1) / (a + 0.1))
                p = m.refined(np.clip(np.array([z]), -14, 14), np.array([gate]))[0]
                total += np.log10(p if bit == "1" else 1 - p)
        return total

    words, turns, c = [w for (w, _), _ in rows], np.array([t for (_, t), _ in rows]), np.array([float(c) for _, c in rows])
    got = context_mixing.Lot(words, turns, c, []).costs(m, batch=17)
    assert got == pytest.approx([cost(w, t) for w, t in zip(words, turns.tolist(), strict=True)], rel=1e-4)


def test_context_mixing_is_a_distribution_over_words():
    rows = rows_of_words(2) + [((bytes([c]), 0), 0) for c in range(33, 127)] + [((b"", 0), 0)]
    lot = context_mixing.Lot([w for (w, _), _ in rows], np.zeros(len(rows), int), np.array([float(c) for _, c in rows]), [])
    m = mixer_of(rows)
    before = lot.costs(m)
    weights, used, one, zero = lot.learn(m, np.arange(len(rows)))
    m.weights = weights.astype(np.float32)
    cost = dict(zip([w for (w, _), _ in rows], lot.costs(m), strict=True))
    assert np.isfinite(list(cost.values())).all() and sum(10.0**x for x in cost.values()) <= 1.0 + 1e-6
    times = np.array([c for _, c in rows])
    assert (lot.costs(m) * times).sum() > (before * times).sum()  # what was learned codes better
    assert used.sum() > 0 and one.shape == zero.shape == (context_mixing.GATES, 33)


def test_what_words_of_a_turn_have_in_common_is_costed_once(monkeypatch):
    """F1"""
    rows = rows_of_words(5, 900)
    m = mixer_of(rows)
    lot = context_mixing.Lot([w for (w, _), _ in rows], np.array([t for (_, t), _ in rows]), np.array([float(c) for _, c in rows]), [])
    seen, refined = [], context_mixing.Mixer.refined
    monkeypatch.setattr(context_mixing.Mixer, "refined", lambda self, z, gate: seen.append(len(z)) or refined(self, z, gate))
    assert np.isfinite(lot.costs(m, batch=50)).all()
    assert sum(seen) == 8 * len({(t, (w + b" ")[: k + 1]) for (w, t), _ in rows for k in range(len(w) + 1)})


def test_learning_counts_all_tokens_of_what_words_have_in_common():
    """one step over all rows equals that of bits taken one by one."""
    rows = [(k, c) for k, c in rows_of_words(6, 400) if len(k[0]) < context_mixing.DEPTH]
    m, c = mixer_of(rows), np.array([float(c) for _, c in rows])
    lot = context_mixing.Lot([w for (w, _), _ in rows], np.array([t for (_, t), _ in rows]), c, [])
    weights, used, one, zero = lot.learn(m, np.arange(len(rows)), passes=1, batch=len(rows))
    use, g, weight, total = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0
    for i, ((w, turn), n) in enumerate(rows):
        if n:
            flat = context_mixing.Flat.of([w])
            bit, k = np.unpackbits(flat.data), 8 * len(flat.data)
            at = context_mixing.hashed_slots(flat.data, flat.places(), np.full(len(flat.data), turn), m.bits).reshape(3, -1)
            begin = lot.begin[lot.row[i]], lot.own_begin[i]
            x, cell, gate = m.inputs(np.vstack([m.codes[at], lot.any[begin[0] : begin[0] + k], lot.own[begin[1] : begin[1] + k]]), bit)
            err = n * (bit - 1 / (1 + np.exp(-m.mixed(x, cell, gate))))
            np.add.at(use, cell, n)
            np.add.at(g, cell, err * x)
            weight, total = weight + n * k, total + k
    g /= use + weight / total * 20
    assert used == pytest.approx(use) and one.sum() + zero.sum() == pytest.approx(weight)
    assert weights == pytest.approx(m.weights + 0.02 * g / (np.abs(g) + 1e-4), abs=1e-5)


def test_turns_follow_the_words_before():
    rng = np.random.default_rng(0)
    texts = [None, "", *(" ".join(rng.choice(["der", "die", "the", "and", "la", "x"], rng.integers(0, 40))) for _ in range(30))]
    evidence = rng.normal(size=((1 << context_mixing.EVIDENCE_BITS) + 1, context_mixing.TURNS)).astype(np.float32)
    s, at = context_mixing.spoken(texts, evidence), 0
    for i, t in enumerate(texts):
        sums = evidence[-1].astype(float)
        for w in [*(t or "").split(), None]:
            assert s.turns[at] == sums.argmax() and s.owner[at] == i and (s.ids[at] == context_mixing.END) == (w is None)
            sums = sums + (evidence[int(s.ids[at]) >> 48] if w else 0)
            at += 1
    assert at == len(s.ids)


def test_promised_segments_raise_a_documents_score():
    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 500, 400))
    s = context_mixing.spoken([text, "short one"], np.zeros(((1 << context_mixing.EVIDENCE_BITS) + 1, context_mixing.TURNS), np.float32))
    cost, share, k = np.full(len(s.ids), -0.5), np.full(17, 0.5), len(s.first)
    total, c = rng.integers(0, 4, k) * (s.before > 0), np.zeros(k, np.int64)
    c = np.minimum(rng.integers(0, 3, k), total)
    for learn in (0, 1):
        got = context_mixing.documents_scored(s, np.full(2, learn), cost, total, c, share)
        want, held, told = [0.0, 0.0], 0, 0
        ends = [*s.first[1:], len(s.ids)]
        for j in range(k):
            points, n, m = -0.5 * (ends[j] - s.first[j]), total[j] - learn, c[j] - learn
            if total[j] > 0 and n > 0:
                p = (held + 2) / (told + 4)
                points = np.log10((1 - p) * 10.0**points + (p * m / n if m > 0 else 0))
                told, held = told + 1, held + (m > 0)
            want[s.owner[s.first[j]]] += points
        assert got == pytest.approx(want)
    assert len(set(s.pairs.tolist())) == k and (s.before == 0).sum() == 2


def test_toxic_words_are_found_through_disguise():
    lexicon = toxicity.Lexicon({"idiot ": 3.0, "lowei": 2.0}, ["idiot light"], [1.0, 0.0, 0.0, -1.5])
    a = lexicon.automaton()
    for text in ("you IDIOT!", "you 1d10t", "an іdіоt", "ｉｄｉｏｔ", "id!ot", "ein loweichen"):
        assert toxicity.features(a, toxicity.folded_words(text))[0] > 0, text
    for text in (None, "", "idiotic", "the idiot light is on", "flowei"):
        assert toxicity.features(a, toxicity.folded_words(text)) == (0.0, 0.0, 0.0), text


def test_discriminant_separates_classes_of_unequal_spread():
    rng = np.random.default_rng(5)
    n = 1500
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 4)) * np.where(y == 1, 1.0, 3.0)[:, None] + np.where(y == 1, 0.0, 0.5)[:, None]
    q = quality.fit(x[:1000], y[:1000], rng.integers(0, 4, 1000))
    assert ((q.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.85
    z = np.clip((x[:5] - q.centre) / q.spread, -8, 8)
    for k in (0, 1):
        c = np.linalg.inv(q.factors[k].T @ q.factors[k])
        d = z - q.means[k]
        want = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]
        assert np.allclose(-0.5 * ((d @ q.factors[k].T) ** 2).sum(axis=1) - 0.5 * q.log_determinants[k], want)


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_are_words_with_small_letters(text):
    s = context_mixing.spoken([text], np.zeros(((1 << context_mixing.EVIDENCE_BITS) + 1, context_mixing.TURNS), np.float32))
    assert context_mixing.word_bytes(s, np.arange(len(s.ids))).to_pylist() == [w.encode() for w in [*WORD.findall((text or "").translate(LOW)), "\n"]]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics_are_finite(text):
    s = quality.statistics(text)
    assert len(s) == len(quality.NAMES) and np.isfinite(s).all()
