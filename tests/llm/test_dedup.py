import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, near_dedup, simhash


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


@pytest.mark.parametrize("which", ["hostile", "corpus"])
def test_exact_matches_brute_force(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r["text"]), []).append(r["doc_id"])
    want = sorted((repr(r["doc_id"]), repr(least(groups[normal(r["text"])])), len(groups[normal(r["text"])]), r["doc_id"] == least(groups[normal(r["text"])]), hashlib.sha256(normal(r["text"]).encode()).hexdigest()) for r in rows)
    got = exact_dedup.exact_dedup(docs, salts=3).collect()
    assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_exact_compares_contents_when_digests_collide(corpus):
    weak = lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2))  # noqa: E731  256 digests
    key = lambda df: sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert key(exact_dedup.exact_dedup(corpus, digest=weak)) == key(exact_dedup.exact_dedup(corpus))


def test_exact_plan_is_native(corpus):
    plan = exact_dedup.exact_dedup(corpus)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_dedup_of_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.simhash(empty).count() == 0


def test_stages_keep_columns_and_first_rows(corpus, hostile):
    kept = exact_dedup.drop_copies(corpus)
    assert kept.columns == corpus.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == set(range(160)) - set(range(140, 150))
    rows = hostile.select("doc_id", "text").collect()
    parts = {normal: {} for normal in (normal, fingerprint)}
    for key, groups in parts.items():
        for r in rows:
            groups.setdefault(key(r["text"]), []).append(r["doc_id"])
    got = exact_dedup.drop_copies(hostile)
    assert got.columns == hostile.columns
    first = {least(g) for g in parts[normal].values()}
    assert sorted(repr((r["doc_id"], r["text"])) for r in got.collect()) == sorted(repr((r["doc_id"], r["text"])) for r in rows if r["doc_id"] in first)
    got = simhash.keep_first(hostile)
    assert got.columns == hostile.columns
    names = brute_components([r["doc_id"] for r in rows], [fingerprint(r["text"]) for r in rows])
    first = {n for n in names if n is not None}
    assert sorted(repr((r["doc_id"], r["text"])) for r in got.collect()) == sorted(repr((r["doc_id"], r["text"])) for r in rows if r["doc_id"] is None or r["doc_id"] in first)


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_xxh64_of_all_lengths():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(500)) + bytes(32), np.uint8)
    start, size = np.arange(150), np.arange(150)
    assert simhash.xxh64(data, start, size).tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return [least(groups[find(i)]) for i in range(len(ids))]


@pytest.mark.parametrize("which", ["hostile", "corpus"])
def test_simhash_matches_brute_force(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r["text"]) for r in rows]
    want = sorted(map(repr, zip([r["doc_id"] for r in rows], [f"{p:016x}" for p in prints], brute_components([r["doc_id"] for r in rows], prints), strict=True)))
    assert sorted(map(repr, map(tuple, simhash.simhash(docs, chunk=16).collect()))) == want


def test_links_of_planted_chains(spark):
    """Chains of near fingerprints across cells, tiles and chunks: all links count, whatever the chunk size."""
    rng, prints = random.Random(3), []
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            prints.append(p)
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
    prints = sorted(set(prints))
    want = brute_components(prints, prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for chunk in (7, 1000):
        parts = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.link_edges(table, chunk=chunk)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(parts.get(p, ("alone", p)), []).append(p)
        assert {p: min(g) for g in groups.values() for p in g} == dict(zip(prints, want, strict=True))


def test_a_clique_gives_a_forest():
    base = np.uint64(0x0123456789ABCDEF)
    near = np.unique(np.array([base] + [base ^ np.uint64(1 << i) for i in range(64)], dtype=np.uint64))
    a, b = simhash.linked(near, None, tile=8)
    assert len(a) == len(near) - 1
    a, _ = simhash.linked(near[:30], near[30:], tile=8)
    assert len(a) == len(near) - 1


def test_fingerprints_of_odd_texts():
    texts = ["", None, " ", "A", "a b", "Ab  c\n", "é À x y", "z" * 100 + " " + "q" * 70 + " e", " x y z w "]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute_first(rows):
    """Ids that stay if all pairs of rows with five-word Jaccard similarity of 0.8 or more are linked."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {min(g) for g in groups.values()}


@pytest.mark.parametrize(("chunk", "hashes"), [(7, 1 << 21), (1000, 1 << 21), (1000, 500)])
def test_near_copies_match_brute_force(spark, chunk, hashes):
    """Texts of all sizes with edits that leave more or less than the similarity; chains of edits; a large group."""
    rng, rows = random.Random(11), []
    words = [f"w{i}" for i in range(4000)]
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([10, 14, 30, 80, 300]))]
        for _ in range(rng.randint(1, 4)):
            rows.append((rng.getrandbits(40), " ".join(text)))
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            text = text[rng.randint(0, len(text) // 8) :]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(120)] = f"Edit{i}"
        rows.append((rng.getrandbits(40), "  ".join(copy)))
    rows += [(1, None), (2, " "), (3, "one two"), (4, "One two"), (5, "one three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_first(rows)
    assert len(want) < len(rows) - 100
    assert {r["doc_id"] for r in near_dedup.keep_first(docs, chunk=chunk, hashes=hashes).collect()} == want


@pytest.mark.parametrize("alike", [True, False])
def test_large_groups_are_never_all_pairs(spark, monkeypatch, alike):
    """Groups whose members are similar enough, and just not similar enough: what is written stays linear in the rows."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    if alike:
        rows = [(i, " ".join(base[: rng.randrange(92, 101)] + [f"x{i}"])) for i in range(400)]
    else:
        rows = [(i, " ".join([f"y{i}-{k}" for k in range(9)] + base + [f"x{i}-{k}" for k in range(9)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, kept = {}, near_dedup.materialize

    def materialize(df, tag):
        out = kept(df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", materialize)
    ids = [r["doc_id"] for r in near_dedup.keep_first(docs).collect()]
    assert sorted(ids) == ([0] if alike else list(range(400))) and set(ids) == brute_first(rows)
    assert max(written.values()) <= near_dedup.LEAST * len(rows)


def test_near_copies_of_odd_tables(hostile, empty):
    assert near_dedup.keep_first(empty).count() == 0
    kept = near_dedup.keep_first(hostile)
    assert kept.columns == hostile.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and {1, 4, 5, 7, 8, 9} <= set(ids) and not {2, 3, 6} & set(ids)
