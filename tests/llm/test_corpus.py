"""Mixing, packing, near duplicates and fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe.llm import near_dedup, packing, source_mix, weighted_sampling


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- mixing


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        each = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if each * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else each * weight[s] for s in names}
        capped |= over


def test_mix(documents, odd, none):
    random.seed(4)
    rows = [(i, "w " * random.randint(0, 200), random.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(600)]
    for df in (documents(rows), odd):
        got = source_mix.report(df).collect()
        own = defaultdict(int)
        for r in df.collect():
            own[r["source"]] += len(words(r["text"]))
        target = water_fill(own)
        assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6)) for r in got) == sorted(
            (str(r["doc_id"]), len(words(r["text"])), own[r["source"]], round(target[r["source"]], 6)) for r in df.collect()
        )
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    got = source_mix.report(documents(rows)).collect()
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    for s, x in water_fill(sizes).items():
        assert taken[s] == pytest.approx(x, rel=0.05)
    again = source_mix.report(documents(rows).repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert source_mix.report(none).count() == 0 and source_mix.emit(none).count() == 0


def test_mix_emits_what_it_counts(documents, odd):
    rows = [(i, "w " * (i % 50), "abc"[i % 3]) for i in range(200)]
    df = documents(rows)
    copies = Counter(r["doc_id"] for r in source_mix.emit(df).collect())
    expected = {r["doc_id"]: r["taken"] // r["size"] for r in source_mix.report(df).collect() if r["size"]}
    assert all(copies.get(i, 0) == n for i, n in expected.items())
    assert source_mix.emit(odd).columns == odd.columns


# -- packing


def test_tokens_are_those_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    random.seed(2)
    pick = lambda: chr(random.choice([random.randint(32, 126), random.randint(9, 13), random.randint(0x80, 0x2FFF), random.randint(0x3000, 0xD7FF), random.randint(0xE000, 0x10FFFF)]))
    for i in range(1500):
        text = "".join(pick() for _ in range(random.randint(0, 30))) + ("<|endoftext|> we'll  \n\n x" if i % 5 == 0 else "")
        assert list(ours.encode(text, allowed_special="all", disallowed_special=())) == theirs.encode(text, add_special_tokens=False).ids


def test_fullest_is_the_largest_subset_sum():
    random.seed(3)
    for _ in range(300):
        items = [random.randint(1, 30) for _ in range(random.randint(0, 8))]
        room = random.randint(0, 60)
        reachable = {0}
        for x in items:
            reachable |= {s + x for s in reachable if s + x <= room}
        chosen = packing.fullest(dict(Counter(items)), room)
        assert sum(x * n for x, n in chosen) == max(reachable)
        assert all(n <= Counter(items)[x] for x, n in chosen)


def test_plan_places_all():
    random.seed(6)
    counts = Counter(min(2048, int(random.lognormvariate(6, 1.2)) + 1) for _ in range(20_000))
    used, bins = Counter(), 0
    for n, combination in packing.plan(dict(counts)):
        assert sum(x * k for x, k in combination) <= 2048
        bins += n
        for x, k in combination:
            used[x] += n * k
    assert used == counts
    assert bins <= -(-sum(x * n for x, n in counts.items()) // 2048) + 2


def test_packing(documents, odd, none):
    random.seed(8)
    encoder = packing.encoder()
    for df in (documents([" ".join(random.choice(["alpha", "beta", "gamma ray", "é"]) for _ in range(random.choice([0, 3, 90, 4000]))) for _ in range(60)]), odd):
        packed = packing.report(df).collect()
        whole = Counter()
        for r in df.collect():
            ids = [*encoder.encode(r["text"] or "", allowed_special="all", disallowed_special=()), 0]
            for k, (at, n) in enumerate(packing.cuts(len(ids))):
                whole[r["doc_id"], k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == whole
        by_sequence = defaultdict(list)
        for r in packed:
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(by_sequence) <= -(-sum(r["length"] for r in packed) // 2048) + 1
    assert packing.report(none).count() == 0


def test_sequences_hold_the_tokens(documents):
    from axisframe.llm.common import written

    df = documents(["alpha beta", "gamma " * 3000, None])
    packed = packing.placed(written(packing.pieces(df, keep_ids=True), "pieces"))
    rows = packed.collect()
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == list(r["ids"])


# -- near duplicates


def shingles(text, width=2):
    w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    k = min(width, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def components(rows, width=2):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        low[r] = k if low.get(r) is None else min(low[r], k) if k is not None else low[r]
    return [(k, len(s), low[find(i)] if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def copies_of(seed, n, edits, length=120):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block, broadcast, hot", [(4, 200_000, 20_000), (1000, 200_000, 20_000), (1000, 5, 3)])
def test_near_duplicates(documents, odd, none, monkeypatch, block, broadcast, hot):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(near_dedup, "HOT_ROWS", hot)
    texts = copies_of(1, 40, 12) + copies_of(2, 30, 20) + ["One two", "one TWO", "one", "", None, "ONE"] + [f"unique text number {i} of many" for i in range(20)]
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    for df in (documents([(k * 3, texts[i], "s") for k, i in enumerate(order)]), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.report(df).collect()]
        assert sorted(got, key=str) == sorted(components(rows), key=str)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in near_dedup.report(df).collect())
    assert near_dedup.report(none).count() == 0 and near_dedup.keep_rows(none).count() == 0


def test_one_row_of_a_group_stays(documents, odd):
    df = documents([(i, t, "s") for i, t in enumerate(copies_of(1, 20, 3) * 2 + ["", "alone here"])])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    kept = [r["doc_id"] for r in near_dedup.keep_rows(df, 2).collect()]
    assert sorted(kept) == sorted({c for _, _, c in components(rows)})
    stage = [r["doc_id"] for r in near_dedup.keep_rows(df).collect()]  # five words, as the pipeline's stage
    assert sorted(stage) == sorted({c for _, _, c in components(rows, 5)})
    assert near_dedup.keep_rows(odd).columns == odd.columns
    assert near_dedup.keep_rows(odd).filter("doc_id = 3").count() == 1


def test_settled_pairs_are_not_compared_again(documents, monkeypatch):
    """Of a bucket of two classes the one pair is checked already; of three, only that of the larger ones is not."""
    counts, written = Counter(), near_dedup.written

    def counted(df, name):
        out = written(df, name)
        counts[name] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    rng, texts = random.Random(7), []
    for group in range(12):  # 10 of 120 words differ: likeness 0.71, buckets in common, no link
        base = [f"g{group}w{k}" for k in range(120)]
        texts += [" ".join(base), " ".join(f"x{group}" if k % 12 == 5 else w for k, w in enumerate(base))]
    rows = list(enumerate(texts))
    report = lambda: sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.report(documents([(i, t, "s") for i, t in rows])).collect())
    assert report() == sorted(components(rows)) == [(i, 119, i) for i in range(24)]
    assert counts["pairs"] == 12 and counts["rest"] == 0
    for group in range(12):  # a third text, linked with the second only
        changed = texts[2 * group + 1].split()
        changed[rng.choice((0, 119))] = "y"
        rows.append((24 + group, " ".join(changed)))
    assert report() == sorted(components(rows))
    assert {c for _, _, c in components(rows)} == set(range(24))


def test_signature_is_circulant():
    """Coordinate k is the first one of the set shifted by k."""
    import xxhash

    items = near_dedup.shingle_set("a b c d e", near_dedup._WordHashes())
    sig = np.frombuffer(near_dedup.signature(items), np.uint8)
    start = near_dedup._permute((items ^ (items >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    for k in (0, 1, 77):
        shifted = near_dedup._permute(start + np.uint32(k), 0x7FEB352D, 0x846CA68B)
        assert sig[k] == shifted.min() & 255
    assert xxhash and len(sig) == near_dedup.SIZE


# -- fingerprints


def likeness(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def order_key(row):
    return (row[0] is not None, row[0] if row[0] is not None else 0)


@pytest.mark.parametrize("bound", [0.5, 14.0])
def test_edited_texts(documents, none, bound):
    random.seed(12)
    texts = [" ".join(random.choice("abcdefghijklmnop") for _ in range(random.choice([0, 1, 7, 200]))) for _ in range(40)] + ["é" * 9, None]
    rows = [(i * 5 - 20, t, "s") for i, t in enumerate(texts)]
    random.shuffle(rows)
    got = {r["doc_id"]: r for r in weighted_sampling.report(documents(rows), bound=bound).collect()}
    rows.sort()
    prints, error = {}, []
    for k, (doc_id, text, _) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(text, r["fingerprint"])
        assert prints[text] == r["fingerprint"] and prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        error += [r["near_edited"] - likeness(text, edited), r["near_next"] - likeness(text, following)]
    assert abs(np.mean(error)) < 0.03 and np.max(np.abs(error)) < 0.3
    assert weighted_sampling.report(none).count() == 0


def test_fingerprint_edges(documents, odd):
    assert weighted_sampling.report(odd).count() == odd.count()
    one = weighted_sampling.report(documents([(1, "abcd", "s")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0


def test_fingerprints_of_a_source_that_is_dealt_out_otherwise(documents, odd, monkeypatch):
    """Row keys that differ from read to read change no result."""
    rows = [(i // 2, f"word{i % 7} and {i % 3} more " * (i % 5), "s") for i in range(40)]
    steady = [weighted_sampling.report(df) for df in (documents(rows), odd)]
    steady = [sorted(map(str, df.collect())) for df in steady]
    moving = F.monotonically_increasing_id() + F.unix_micros(F.current_timestamp())
    monkeypatch.setattr(weighted_sampling, "with_row_key", lambda df: df.withColumn("_rid", moving))
    for df, want in zip((documents(rows), odd), steady, strict=True):
        assert sorted(map(str, weighted_sampling.report(df).collect())) == want


def test_collision_rate_is_generalised_jaccard(documents):
    """Over many coordinates the rate comes near the exact value."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)) for _ in range(6)]
    df = documents([(i, t, "s") for i, t in enumerate(texts)])
    found = {r["doc_id"]: r["near_next"] for r in weighted_sampling.report(df).collect()}
    errors = [found[i] - likeness(texts[i], texts[(i + 1) % 6]) for i in range(6)]
    assert abs(np.mean(errors)) < 0.1 and np.max(np.abs(errors)) < 0.25


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_collision_rate_of_long_texts(spark, n):
    """The minimum over many words lives in the tails of r and c."""
    rng = np.random.default_rng(7)
    odds = 1 / np.arange(1, n + 1)
    texts = [" ".join(f"w{i}" for i in rng.choice(n, n, p=odds / odds.sum())) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, _text string")
    rates = []
    for seed in range(1, 5):
        a, b = (bytes(r["signature"]) for r in weighted_sampling.signatures(rows, ["doc_id"], seed=seed, bound=14.0).orderBy("doc_id").collect())
        rates += [a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)]
    assert np.mean(rates) == pytest.approx(likeness(*texts), abs=0.07)
