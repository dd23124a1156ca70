"""Every operator against a brute-force version, and on the awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from braidwork.llm import _graph, attention, decontaminate, flac, linededup, lm, pii, simhash, spm, substring, toxicity, warc

WORDS = "the of onan erth lyes tion Über été a1 b-2 idiot ring".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, t string, key string, kind string"


def corpus(seed=1, n=40):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 120))) for _ in range(n)]
    lines = [" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(r.randint(4, 30))) for _ in range(8)]
    texts = [b + "\n" + r.choice(lines) + "\n" + " ".join(r.choice(WORDS) for _ in range(30)) for b in base]
    texts += [texts[0], texts[1] + " more", None, "", " \t\n ", "one", "one two", "x" * 5000, "many words " * 3000, None, texts[2]]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, None)]
    return rows + [rows[4], rows[-1]]  # repeated rows


def frame(spark, rows):
    """documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "i", "t", "k", "d") for i, t in rows], SCHEMA)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(_graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert all(got.get(x, x) == find(x) for e in edges for x in e)


def test_simhash(spark):
    rows = corpus()
    fp = [simhash.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fp[a] ^ fp[b]).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = ordered((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))
    assert collected(simhash.near_duplicates(frame(spark, rows)), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def plain_fingerprint(text):
    """The contract's wording, a bit at a time."""
    import xxhash

    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_bits_are_majorities():
    r = random.Random(8)
    few = "Aa b Éé Ca d".split()
    texts = [(" ", "\n", "\u00a0", "\x0b ")[r.randint(0, 3)].join(r.choice(few) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += [t for _, t in corpus(9)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert any(simhash.fingerprint(t) & ~plain_fingerprint(t[:-1]) for t in texts if t)


def grouped(texts, similarity=0.8):
    """Least index of every text's group, by the Jaccard similarity of all pairs' sets of five-word shingles."""
    words = [tuple(re.sub("[A-Z]", lambda m: m.group().lower(), t or "").split()) for t in texts]
    sets = [{w[i : i + 5] for i in range(max(len(w) - 4, 1))} if w else set() for w in words]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if words[a] == words[b] or len(sets[a] & sets[b]) >= similarity * max(len(sets[a] | sets[b]), 1):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    return group


def edited(r, text, share):
    return " ".join(f"edit{r.randint(0, 999)}" if r.random() < share else w for w in text.split())


def near_copies(seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(60, 300))) for _ in range(40)]
    texts = base + [edited(r, t, s) for t in base for s in (0.004, 0.012, 0.03)] + [edited(r, base[0], 0.01) for _ in range(120)]
    return texts + [None, "", " \n", "One two", "one  TWO", "one two three", *(base[1].upper() for _ in range(3)), " ".join(r.choice(words) for _ in range(200_000))]


@pytest.mark.parametrize("limit", [16, 2048])
def test_near_copies(spark, monkeypatch, limit):
    from braidwork.llm import nearcopies

    monkeypatch.setattr(nearcopies, "BUCKET_ROWS", limit)
    texts = near_copies()
    want = grouped(texts)
    df = frame(spark, enumerate(texts))
    got = {r.doc_id: r.component_id for r in nearcopies.groups(df).collect()}
    wrong = [i for i in range(len(texts)) if got[i] != want[i]]
    assert len(wrong) <= 2 and all(want[got[i]] == want[i] for i in wrong)  # a link can be missed, none is made up
    assert len(set(want)) < 150
    kept = simhash.keep_one(frame(spark, [*enumerate(texts), (None, texts[0]), (3, texts[3])]))
    assert kept.columns == df.columns
    assert collected(kept, "doc_id") == ordered([(i,) for i in range(len(texts)) if got[i] == i] + [(None,), (3,)])
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_near_copies_of_a_repeated_id(spark):
    from braidwork.llm import nearcopies

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(7, "something else altogether, and of its own"), (7, text), (9, text + " more")]
    got = nearcopies.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(7, 7), (7, 7), (9, 7)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.text for r in kept) == sorted(t for _, t in rows[:2])


def test_near_copies_in_one_large_bucket(spark, monkeypatch):
    from braidwork.llm import nearcopies

    monkeypatch.setattr(nearcopies, "BUCKET_ROWS", 64)
    r = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    base, texts = [r.choice(words) for _ in range(200)], []
    for _ in range(400):  # much alike, but only pairs are near copies
        own = list(base)
        for p in r.sample(range(200), 5):
            own[p] = r.choice(words)
        texts.append(" ".join(own))
        own[r.randrange(200)] = r.choice(words)
        texts.append(" ".join(own))
    got = {x.doc_id: x.component_id for x in nearcopies.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = grouped(texts)
    assert sum(got[i] != want[i] for i in range(len(texts))) <= 8


@pytest.mark.parametrize("rows, small", [(8, 16), (2048, 4)])
def test_no_link_is_lost_in_large_buckets_and_groups(spark, monkeypatch, rows, small):
    """All texts share a key and are close by their fingerprints; no two of them but the pairs are near copies."""
    from braidwork.llm import nearcopies

    for name, value in (("BUCKET_ROWS", rows), ("SMALL", small), ("PART_ROWS", 3)):
        monkeypatch.setattr(nearcopies, name, value, raising=False)
    r = random.Random(1)
    texts = []
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    for _ in range(150):
        own = list(base)
        for p in r.sample(range(200), 5):
            own[p] = f"w{r.randrange(5000)}"
        texts.append(" ".join(own))
        own[r.randrange(200)] = f"w{r.randrange(5000)}"
        texts.append(" ".join(own))
    tables = nearcopies.tables
    monkeypatch.setattr(nearcopies, "tables", lambda *x: tables(*x)[:1])  # one table, whose key all share
    monkeypatch.setattr(nearcopies, "keys", lambda fp, places: np.full((len(fp), len(places)), 77, np.uint64))
    got = {x.doc_id: x.component_id for x in nearcopies.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = grouped(texts)
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 100


def test_pairs_across_groups_are_exact(spark, monkeypatch):
    from braidwork.llm import nearcopies

    monkeypatch.setattr(nearcopies, "PART_ROWS", 5)
    r = random.Random(8)
    base = [f"w{r.randrange(300)}" for _ in range(60)]
    texts = [" ".join(edited(r, " ".join(base), r.choice([0.01, 0.03, 0.06])).split()[: r.randint(45, 60)]) for _ in range(80)] + ["one two", "one two three", "x"]
    root = [r.randrange(12) for _ in texts]
    df = spark.createDataFrame([(i, root[i], t) for i, t in enumerate(texts)], "node bigint, root bigint, t string")
    got = nearcopies.across(df)
    sets = [set(nearcopies.shingles(t).tolist()) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if root[a] != root[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    pairs = collected(got, "u", "v")
    assert len(pairs) == len(set(pairs)) and want <= set(pairs) and len(want) > 10
    assert set(collected(nearcopies.verified(got, df.select("node", "t")), "u", "v")) == want


def test_near_copy_keys_grow_with_the_texts():
    from braidwork.llm import nearcopies

    assert nearcopies.key_bits(0) == nearcopies.key_bits(1 << 24) == 16 and nearcopies.key_bits(1 << 34) == 26
    for bits in (16, 26):
        places = nearcopies.tables(0.8, bits)
        assert 1 - (1 - (1 - nearcopies.bit_distance(0.8)) ** bits) ** len(places) >= 0.99


def test_every_line_stays_in_its_first_document(spark):
    o, p, q, r = (" ".join(f"{x}{i}" for i in range(5)) for x in "opqr")
    docs = [(0, f"{o}\n{p}"), (1, f"{q}\n{r}"), (2, f"{o}\n{p}\n{q}\n{r}"), (3, f"{p}\n{q}")]
    kept = {x.doc_id: x.text for x in linededup.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert kept == {0: docs[0][1], 1: docs[1][1]}  # the block p, q is left in two pieces


def test_columns_named_like_ours(spark):
    docs = spark.createDataFrame([(1, "a line of ten words that others may hold as well\nb", 5, "x", "d"), (2, "a line of ten words that others may hold as well\nc", 6, "y", "e")], "doc_id bigint, text string, gone int, ids string, decoded string")
    cut = linededup.deduplicate(docs)
    assert cut.columns == docs.columns and collected(cut, "doc_id", "text", "gone") == [(1, docs.first().text, 5), (2, "c", 6)]
    back = spm.with_text(spm.with_ids(docs))
    assert sorted(back.columns) == sorted(docs.columns) and {r.doc_id: r.decoded for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_near_copies_of_text_ids(spark):
    rows = [("b", "x y z u v w"), ("a", "x y z u v w"), ("c", "other"), ("c", "x y z u v w"), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id string, text string"))
    assert ordered(set(collected(kept, "doc_id"))) == ordered({("a",), ("c",), (None,)})


def test_forest_has_the_components_at_every_weight():
    from braidwork.llm import nearcopies

    r = np.random.default_rng(4)
    u, v, w = r.integers(0, 60, 400), r.integers(0, 60, 400), r.integers(0, 9, 400)
    k = nearcopies.forest(60, u, v, w)
    assert len(k) == 59
    for most in range(9):
        parts = []
        for at in (np.flatnonzero(w <= most), k[w[k] <= most]):
            node, least = _graph.spanning(u[at], v[at])
            to = np.arange(60)
            to[node] = least
            parts.append(to.tolist())
        assert parts[0] == parts[1]


def test_simhash_reference_value():
    # worked by hand from the definition: the majority of one hash is the hash
    import xxhash

    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


@pytest.mark.parametrize("limit", [4, 4096])
def test_pivot_links_find_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
    r = random.Random(7)
    centers = [r.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centers for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = dict(_graph.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "__fp bigint"))).collect())
    group = {f: {f} for f in signed}
    for a in signed:
        for b in signed:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    assert all(got.get(f, f) == min(group[f]) for f in signed)


def brute_substring(rows):
    """By (id, text) as documents; null ids first, then by the hash order the operator states."""
    docs = sorted({(d is not None, d, h, t) for d, t, h in rows}, key=lambda x: (x[0], x[1] or 0, x[2]))
    seen, out = set(), {}
    for _, d, _h, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - substring.WINDOW + 1):
            x = tuple(w[k : k + substring.WINDOW])
            if x in seen:
                gone[k : k + substring.WINDOW] = [True] * substring.WINDOW
            seen.add(x)
        kept = [a for a, g in zip(w, gone) if not g]
        out[(d, t)] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("chunk,heavy", [(6 << 20, 2000), (3000, 20)])
def test_substring(spark, monkeypatch, chunk, heavy):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "HEAVY", heavy)
    rows = corpus(2) + [(900 + i, " ".join(f"own{i}w{j}" for j in range(15)) + " " + " ".join(f"shared{j}" for j in range(25)) + f" tail{i} " * 12) for i in range(30)]
    df = frame(spark, rows)
    hashes = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    want = brute_substring([(r.doc_id, r.text, r.h) for r in hashes])
    got = collected(substring.deduplicate(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == ordered((d, *want[(d, t)]) for d, t in rows)
    assert substring.deduplicate(frame(spark, [])).count() == 0


@pytest.mark.parametrize("room, slots, order", [(substring.ROOM, substring.SLOTS, "up"), (substring.ROOM, substring.SLOTS, "down"), (substring.ROOM, 64, "down"), (3000, substring.SLOTS, "mixed"), (0, 64, "mixed")])
def test_substring_common_passage_travels_a_few_times(spark, monkeypatch, room, slots, order):
    rng = random.Random(5)
    shared = [" ".join(f"s{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [(d, " ".join([f"a{d}", *[rng.choice(shared) for _ in range(rng.randrange(4))], *[f"b{d}w{i}" for i in range(rng.randrange(30))]])) for d in range(150)]
    rows += [rows[7], (7, rows[8][1]), (None, shared[0]), (None, None), (500, "")]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=order == "down")
    if order == "mixed":
        rng.shuffle(rows)
    monkeypatch.setattr(substring, "CHUNK", 900)  # a chunk holds a few documents
    monkeypatch.setattr(substring, "ROOM", room)
    monkeypatch.setattr(substring, "SLOTS", slots)
    df = frame(spark, rows).coalesce(1)
    hashes = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    want = brute_substring([(r.doc_id, r.text, r.h) for r in hashes])
    assert collected(substring.deduplicate(df), "doc_id", "n_words", "n_removed", "kept_sha256") == ordered((d, *want[(d, t)]) for d, t in rows)
    if room > 3000 and slots > 64:
        import zstandard

        keyed = substring._keyed(df, "doc_id", "text").select("i", "h", "t")
        sent = []
        for r in keyed.mapInArrow(substring._deal(np.empty(0, np.uint64), 8), "bucket int, kind int, blob binary").where("kind = 0").collect():
            table, text = substring._unpack(zstandard.ZstdDecompressor().decompress(bytes(r.blob)))
            ends = np.cumsum(table[4])
            sent += [text[e - n : e] for e, n in zip(ends, table[4])]
        assert max(sent.count(x) for x in set(sent)) <= 3


def test_substring_under_colliding_hashes():
    a, b = b"".join(b"w%d " % i for i in range(21)), b"".join(b"v%d " % i for i in range(21))
    table = np.array([[1, 2, 3], [0, 0, 0], [0, 0, 0], [2, 2, 2], [len(a), len(b), len(a)]])
    ids, _, first, n = substring.repeats(table, a + b + a)
    assert (ids.tolist(), first.tolist(), n.tolist()) == ([3], [0], [2])


PAGE_SCHEMA = "page_id bigint, url string, html string, digest string, file string"


def test_warc(spark, tmp_path):
    big, rows = "é" * 700, []
    rows += [(1, "http://a/é b\r\nX: 1", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (9, "u", big), (10, "u", "y" * 2000)]
    df = spark.createDataFrame([(*r, "d", "f") for r in rows], PAGE_SCHEMA)
    index = warc.write(df)
    got = collected(warc.read(index), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and h == big and i != 9
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == ordered(want)
    folder = index.first().file.rsplit("/", 1)[0]
    other = warc.index(spark.newSession(), folder)  # the index lies beside the archives
    assert collected(warc.read(other), "page_id", "payload_digest") == [x[:1] + x[2:3] for x in got] or len(got) == other.count()
    assert {r.file.rsplit("/", 1)[0] for r in other.collect()} == {folder}
    only = warc.read(index.where("page_id = 3"), with_payload=True).collect()
    assert [(r.page_id, bytes(r.payload)) for r in only] == [(3, b"small")]
    assert warc.read(warc.write(spark.createDataFrame([], PAGE_SCHEMA))).count() == 0


def test_warc_ranges_and_damage():
    assert [(b, e, len(h)) for b, e, h in warc.coalesced([(0, 10), (10, 5), (100, 5), (90_000, 1)], gap=100, most=200)] == [(0, 105, 3), (90_000, 90_001, 1)]
    whole = warc.record(7, "http://x", b"hello", hashlib.sha1(b"hello").digest(), None, "2020-01-01T00:00:00Z")
    assert warc.parse(whole)[:2] == (7, 5)
    for broken in (whole[:-5], whole.replace(b"hello", b"hullo")):
        with pytest.raises(ValueError):
            warc.parse(broken)


def _flac(payloads):
    at = np.cumsum([0, *map(len, payloads)])
    return flac.padded(np.frombuffer(b"".join(payloads), np.uint8), at)


def test_flac_round_trip():
    r = random.Random(3)
    noise = bytes(r.randrange(256) for _ in range(3000))
    payloads = [b"", b"a", b"a" * 512, noise, b"\x00\xff" * 900, b"\0" * 300 + b"\xff" + b"\0" * 600, ("texte étrange " * 400).encode(), bytes(range(256)) * 5]
    data, at = _flac(payloads)
    streams = flac.encode(data, at)
    out, ends = flac.decode(streams)
    assert (out == data).all() and (ends == at).all()
    alone = [flac.encode(*_flac([p]))[0] for p in payloads]
    assert alone == streams  # equal texts, equal streams
    assert flac.decode_at(streams[6], 700, 900) == payloads[6][700:1600]
    with pytest.raises(ValueError):
        flac.decode_at(streams[1], 60, 10)
    for at_byte in (len(streams[3]) - 40, len(streams[3]) - 1):
        broken = bytearray(streams[3])
        broken[at_byte] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_flac_without_seek_points():
    data, at = _flac([b"some words " * 300])
    stream = flac.encode(data, at)[0]
    first, _, _, _ = flac.metadata(stream)
    bare = b"fLaC\x80" + stream[5:42] + stream[first:]
    out, _ = flac.decode([bare])
    assert (out == data).all()


def test_flac_query(spark):
    rows = corpus(3, 10)
    got = {(r.doc_id, r.payload_sha256): r for r in flac.stored_features(frame(spark, rows)).collect()}
    for d, t in rows:
        b = (t or "").encode()
        p = b + b"\0" * (max(-(-len(b) // 64), 1) * 64 - len(b))
        r = got[(d, hashlib.sha256(p).hexdigest())]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(b), len(p), zlib.crc32(p[-64:]))
        stream = flac.encode(*_flac([b]))[0]
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
    assert flac.stored_features(frame(spark, [])).count() == 0


def test_flac_features_of_long_and_repeated_texts(spark):
    """Streams of many PCM blocks, against the plain formulas; equal texts have equal values wherever they stand."""
    texts = ["", None, "a", "many words " * 40_000, "é" * flac.PCM_SAMPLES, "x" * (flac.PCM_SAMPLES - 1), "many words " * 40_000]
    rows = [*enumerate(texts), (None, "a"), (2, "a")]
    got = flac.stored_features(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        b += b"\0" * (max(-(-len(b) // 64), 1) * 64 - len(b))
        x = [v - 128 for v in b]
        want.append((d, f"mean={sum(x) // len(x)} power={sum(v * v for v in x) // len(x)} crossings={sum((p < 0) != (q < 0) for p, q in zip(x, x[1:]))} blocks={-(-len(x) // flac.BLOCK)}"))
    assert ordered((r.doc_id, r.feature) for r in got) == ordered(want)


def test_pcm_blocks_are_sought_in_another_session(spark, tmp_path):
    texts = ["some words and more " * 3000, "short", None, "y" * 30_000]
    folder = f"file://{tmp_path}/pcm"
    flac.write_pcm(flac.with_media(frame(spark, enumerate(texts))), folder)
    other = spark.newSession()
    blocks = other.read.parquet(folder)
    assert blocks.columns == ["doc_id", "block", "first_sample", "samples", "pcm"]
    assert {r.doc_id: r.n for r in blocks.groupBy("doc_id").agg({"block": "count"}).withColumnRenamed("count(block)", "n").collect()}[0] == -(-60_032 // flac.PCM_SAMPLES)
    wanted = [(0, 0, 5), (0, 8190, 4), (0, 8000, 40_000), (1, 3, 100), (3, 29_999, 1), (2, 0, 64), (3, 90_000, 5)]
    got = {(r.doc_id, r.first): bytes(r.pcm) for r in flac.samples_at(blocks, other.createDataFrame(wanted, "doc_id bigint, first bigint, count bigint")).collect()}
    for d, first, count in wanted[:-1]:
        b = (texts[d] or "").encode()
        b += b"\0" * (max(-(-len(b) // 64), 1) * 64 - len(b))
        assert got[d, first] == b[first : first + count]
    assert (3, 90_000) not in got


def test_patience_diff():
    a, b = [1, 2, 3, 4, 5, 9, 9], [8, 1, 2, 7, 4, 5, 9, 9]
    assert linededup.aligned(a, b) == [(0, 1), (1, 2), (3, 4), (4, 5), (5, 6), (6, 7)]
    assert linededup.aligned([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert linededup.aligned([], [1]) == []
    assert linededup.removable([1, 2, 3], [6, 6, 6], [1, 2, 4], 10) == [0, 1]
    assert linededup.removable([1, 5, 3], [6, 6, 6], [1, 2, 3], 10) == []


def test_line_dedup(spark):
    rows = corpus(5)
    df = frame(spark, rows)
    docs = sorted({(r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}, key=lambda x: x[:3])
    first, lines, want = {}, {}, {}
    for n, (has, d, _, t) in enumerate(docs):
        h, w = linededup.line_hashes(t)
        lines[n], partners = h, set()
        for x in h:
            if x and first.setdefault(x, n) != n:
                partners.add(first[x])
        gone = set()
        for p in partners:
            gone |= set(linededup.removable(h, w, lines[p]))
        want[(d if has else None, t)] = (len(h), len(gone), linededup.kept_lines(t or "", list(gone)))
    got = collected(linededup.report(df), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == ordered((d, want[(d, t)][0], want[(d, t)][1], hashlib.sha256(want[(d, t)][2].encode()).hexdigest()) for d, t in rows)
    assert any(x[1] for x in want.values())
    cut = linededup.deduplicate(df)
    assert cut.columns == df.columns
    left = ordered((d, None if t is None else want[(d, t)][2]) for d, t in rows if not want[(d, t)][1] or want[(d, t)][2].strip())
    assert collected(cut, "doc_id", "text") == left
    assert linededup.report(frame(spark, [])).count() == linededup.deduplicate(frame(spark, [])).count() == 0


def shared_with_earlier(docs):
    """Per document, in order: its lines in any run of 10 words or more that stands in an earlier one, all pairs compared."""
    out = []
    for n, t in enumerate(docs):
        a, gone = t.split("\n"), set()
        for b in (d.split("\n") for d in docs[:n]):
            for i in range(len(a)):
                for j in range(len(b)):
                    size = 0
                    while i + size < len(a) and j + size < len(b) and a[i + size] == b[j + size]:
                        size += 1
                    if len(" ".join(a[i : i + size]).split()) >= linededup.MIN_WORDS:
                        gone |= set(range(i, i + size))
        out.append(gone)
    return out


def test_line_blocks_scattered_over_first_holders(spark):
    x, y, z = "x1 x2 x3 x4", "y1 y2 y3 y4", "z1 z2 z3 z4"
    docs = [f"{line}\nown {n}" for n, line in enumerate((x, y, z))] + [f"head b\n{x}\n{y}\n{z}\nb tail", f"{x}\n{y}\n{z}\nc tail"]
    r = random.Random(31)
    short = [" ".join(f"s{k}_{i}" for i in range(r.randint(1, 6))) for k in range(30)]
    for _ in range(40):  # stretches of one order of lines, so that blocks stand in the same order
        at, n = r.randint(0, 26), len(docs)
        docs.append(f"begin {n}\n" + "\n".join(short[at : at + r.randint(2, 8)]) + f"\nend {n}")
    want = shared_with_earlier(docs)
    assert want[4] == {0, 1, 2} and sum(map(bool, want)) > 20
    got = {q["__id"]: set(q["__gone"]) for q in linededup.deletions(frame(spark, enumerate(docs))).collect()}
    assert [got.get(n, set()) for n in range(len(docs))] == want


def test_repeated_and_moved_blocks(spark):
    p, q, x, y = "p" + " p" * 11, "q" + " q" * 10, "x1 x2 x3 x4 x5 x6", "y1 y2 y3 y4 y5 y6"
    docs = ["\n".join(d) for d in (
        ("u", p, "v", p, "w", q, x, y), ("a", p, "b"), ("c", p, "d", p, p, "e"), (x, y, "f", q, "g", p), (x, "h", y, x, y, q), ("k", p, "l"),
    )]
    r = random.Random(17)
    few = [" ".join(f"r{k}_{i}" for i in range(r.choice((3, 4, 6, 11)))) for k in range(5)]
    docs += ["\n".join(r.choice(few) for _ in range(r.randint(2, 9))) + f"\nend {n}" for n in range(30)]
    want = shared_with_earlier(docs)
    assert want[1] == {1} and want[2] == {1, 3, 4} and want[3] == {0, 1, 3, 5} and want[4] == {3, 4, 5} and want[5] == {1}
    got = {g["__id"]: set(g["__gone"]) for g in linededup.deletions(frame(spark, enumerate(docs))).collect()}
    assert [got.get(n, set()) for n in range(len(docs))] == want


def test_toxicity(spark):
    r = random.Random(8)
    plain = "ring of the onan erth lyes tion stone water glass green".split()
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(plain) + r.choice("abcdef") for _ in range(r.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["Idiot,", "MORON", "clown!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = frame(spark, rows + [(None, "idiot"), (700, None), (701, "")])
    y = spark.createDataFrame([*labels, (None, 1), (3, None), (5000, 1)], "doc_id bigint, toxic int")
    machine = toxicity.train(df, y)
    got = {x.doc_id: x for x in toxicity.scores(df, machine).collect()}
    assert len(got) == 603 and got[700].score == got[701].score and got[700].predicted == 0
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert got[1].held_out == (zlib.crc32(b"1") % 3 == 1)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    kept = toxicity.keep_clean(df, machine)
    assert kept.columns == df.columns and 0 not in {x.doc_id for x in kept.collect()}
    assert toxicity.scores(frame(spark, []), machine).count() == 0
    nothing = toxicity.train(df, y.limit(0))
    assert all(0 <= x.score <= 1 for x in toxicity.scores(df, nothing).collect())


def test_factorization_machine_learns_interactions():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2, 4000), r.integers(0, 2, 4000)
    y = a & b  # with both only
    rows = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    terms = np.concatenate([np.full(a.sum(), 11), np.full(b.sum(), 22)])
    m = toxicity.fit(y, rows, terms, steps=400)
    s = toxicity.score(m, np.array([0, 1, 2, 2]), np.array([11, 22, 11, 22]), 4)
    assert s[2] > 0.8 and max(s[0], s[1], s[3]) < 0.3


def numeric_gradient(p, name, place, tok, target, live):
    out = []
    for d in (1e-4, -1e-4):
        q = {n: v.astype(np.float64).copy() for n, v in p.items()}
        q[name][place] += d
        out.append(attention.gradient(q, tok, target, live)[0])
    return (out[0] - out[1]) / 2e-4


def test_attention_gradient_and_scores():
    r = np.random.default_rng(1)
    p = attention.fresh(np.ones(40))
    ids = r.integers(0, 40, 100)
    at = np.array([0, 1, 1, 40, 100])
    tok, target, scored = attention.windows(ids, at, 0)
    assert int(scored.sum()) == 100 and (target[scored] == ids).all()
    _, d = attention.gradient({n: v.astype(np.float64) for n, v in p.items()}, tok, target, scored)
    for name, place in (("q", (2, 3)), ("k", (1, 1)), ("v", (0, 5)), ("o", (3, 3)), ("tok", (2, 4)), ("pos", (5, 1)), ("up", (2, 2)), ("down", (4, 1)), ("out", (3, 4, 0)), ("bias", (1, 0)), ("group", (2, 3)), ("gbias", (4,))):
        assert math.isclose(d[name][place], numeric_gradient(p, name, place, tok, target, scored), rel_tol=1e-3, abs_tol=1e-7), name
    # causal: the future does not change a score; and probabilities add up to one
    again = tok.copy()
    again[:, 9:] = 3
    early = scored.copy()
    early[:, 9:] = False
    assert np.allclose(attention.log_likelihood(p, tok, target, early)[0], attention.log_likelihood(p, again, target, early)[0], atol=1e-5)
    total = sum(np.exp(attention.log_likelihood(p, tok, np.full_like(target, c), scored)[0]) for c in range(40))
    assert np.allclose(total, 1, atol=1e-4)
    starts = sum(np.exp(attention.log_likelihood(p, tok, np.full_like(target, c), scored)[0]) for c in range(40) if c % attention.GROUPS < attention.START)
    assert np.allclose(starts, np.exp(attention.log_likelihood(p, tok, target, scored)[1]), atol=1e-4)


def test_attention_goes_through_windows_a_few_at_a_time(monkeypatch):
    r = np.random.default_rng(2)
    p = {n: v.astype(np.float64) for n, v in attention.fresh(np.ones(40)).items()}
    tok, target, scored = attention.windows(r.integers(0, 40, 900), np.array([0, 500, 517, 900]), 0)
    assert len(tok) > 30
    wide, attended, out = [], attention._attended, []
    monkeypatch.setattr(attention, "_attended", lambda *x: (wide.append(len(x[-1])), attended(*x))[1])
    for most in (len(tok), 7):  # of 7 at once the last ones are fewer
        monkeypatch.setattr(attention, "AT_ONCE", most)
        out.append((*attention.gradient(p, tok, target, scored), *attention.log_likelihood(p, tok, target, scored)))
        assert max(wide) == most
        wide.clear()
    assert np.isclose(out[0][0], out[1][0]) and all(np.allclose(out[0][1][n], out[1][1][n], atol=1e-12) for n in p)
    assert np.allclose(out[0][2:], out[1][2:]) and np.isclose(-out[0][2].mean(), out[0][0])


def test_attention_learns():
    ids = np.tile([1, 2, 3, 4, 5], 300)
    tok, target, scored = attention.windows(ids, np.array([0, len(ids)]), 0)
    p = attention.fit(attention.fresh(np.ones(6)), tok, target, scored, 120, 1e-2, batch=16)
    assert np.exp(attention.log_likelihood(p, tok, target, scored)[0]).mean() > 0.8


def test_attention_has_room_for_context():
    # every target after a text's first window has at least eight subwords before it
    assert (attention.LENGTH, attention.STRIDE, attention.HIDDEN) >= (32, 24, 48) and attention.LENGTH - attention.STRIDE >= 8
    ids = np.arange(200)
    tok, target, scored = attention.windows(ids, np.array([0, len(ids)]), 0)
    context = np.broadcast_to(np.arange(attention.LENGTH), tok.shape)[scored]
    assert context[attention.LENGTH :].min() >= 8 and context.max() == attention.LENGTH - 1


def test_blocks_train_on_their_whole_share(spark, monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    used, gradient = [], attention.gradient
    ids = np.arange(128 * 5 * attention.STRIDE) % 7
    tok, target, scored = attention.windows(ids, np.array([0, len(ids)]), 0)
    tok[:, 0] = np.arange(len(tok))  # one pass takes every window once
    seen = []
    monkeypatch.setattr(attention, "gradient", lambda p, tok, target, live: (seen.extend(tok[:, 0]), gradient(p, tok % 7, target, live))[1])
    attention.fit(attention.fresh(np.ones(7)), tok, target, scored, -(-len(tok) // attention.BATCH), 1e-3)
    assert sorted(seen) == list(range(len(tok)))
    # a block's windows: four times the text, four times the windows trained on
    monkeypatch.setattr(attention, "gradient", lambda p, tok, target, live: (used.append(len(tok)), gradient(p, tok, target, live))[1])
    monkeypatch.setattr(lm, "BLOCK_STEPS", 1)
    ranks = {bytes([b]): b for b in range(256)}
    classes = np.arange(257) % lm.CLASSES
    model, total = attention.flat(attention.fresh(np.ones(lm.CLASSES))), []
    for texts in (100, 400):
        used.clear()
        t = ["word other more " * 100] * texts
        table = pa.table({"block": pa.array([0] * texts, pa.int32()), "train": [True] * texts, "t": t, "o": list(range(texts))})
        lm._ask(SimpleNamespace(value=ranks), classes, model, 256, 2)(table)
        windows = len(attention.windows(np.zeros(1601 * texts, np.int64), np.arange(texts + 1) * 1601, 0)[0])
        assert windows / lm.TURNS <= sum(used) < windows / lm.TURNS + texts  # of every text
        total.append(sum(used))
    assert total[1] >= 3.9 * total[0]
    # and blocks are bounded in bytes
    monkeypatch.setattr(lm, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lm, "START_STEPS", 5)
    asked = []
    monkeypatch.setattr(lm, "checkpoint", lambda df: (asked.append(df.persist()), asked[-1])[1])
    rows = corpus(9, 60)
    lm.scores(frame(spark, rows))
    assert asked[0].where("kind = 1").count() > 2 * lm.partitions(spark)


def test_every_place_of_every_training_text_is_trained_on(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    texts = ["word other more " * n for n in (1, 9, 40, 200)] + ["", None]
    table = pa.table({"block": pa.array([0] * 6, pa.int32()), "train": [True] * 3 + [True, False, True], "t": texts, "o": list(range(6))})
    places, windows = [], attention.windows
    monkeypatch.setattr(attention, "windows", lambda *x: (out := windows(*x), places.append(int(out[2].sum())))[0])
    monkeypatch.setattr(attention, "fit", lambda p, tok, *_, **__: (places.append(len(tok)), p)[1])
    model = attention.flat(attention.fresh(np.ones(lm.CLASSES)))
    lm._ask(SimpleNamespace(value={bytes([b]): b for b in range(256)}), np.arange(257) % lm.CLASSES, model, 256, 2)(table)
    ids = [16 * n + 1 for n in (1, 9, 40, 200, 0)]  # a space before each word, and an end
    assert places == [sum(ids), sum(1 + max(0, -(-(n - attention.LENGTH) // attention.STRIDE)) for n in ids)]


def test_windows_by_turns():
    sizes = [0, 1, 31, 32, 33, 60, 500, 5000]
    ids, at = np.arange(sum(sizes)), np.cumsum([0, *sizes])
    every = {tuple(x) for x in attention.windows(ids, at, 0)[1].tolist()}
    tok, target, scored = attention.windows(ids, at, 0, 8)
    assert {tuple(x) for x in target.tolist()} < every and len(target) == len({tuple(x) for x in target.tolist()})
    assert all(((target >= a) & (target < b) & scored).any() for a, b in zip(at, at[1:]) if a < b)  # every text has its turn


def test_distinct_ranges_are_told_apart_by_bytes():
    from braidwork.llm._text import distinct, range_hashes

    mirrored = ["".join(ab[bin(i).count("1") % 2] for i in range(2048)).encode() for ab in ("ab", "ba")]
    texts = [b"one", mirrored[0], b"two", mirrored[1], b"one", mirrored[1], b"x" * 9000, mirrored[0], b"two"] + [b"w%d" % (i % 50) for i in range(200)]
    size = np.array([len(t) for t in texts])
    data, start = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
    h = range_hashes(data, start, size, part=1000)
    assert h[1] == h[3] and (h == range_hashes(data, start, size)).all()  # what a hash alone would confuse
    for part in (100, 1 << 20):
        pick, flat = distinct(data, start, size, part)
        assert [texts[pick[i]] for i in flat] == texts and len(pick) == len(set(texts))
        by = np.random.default_rng(2).permutation(len(texts))  # the order is that of the texts' own values
        other, _ = distinct(data, start[by], size[by], part)
        assert [texts[by[i]] for i in other] == [texts[i] for i in pick]


def test_held_out_texts_score_above_the_base(spark, monkeypatch):
    """Texts in two languages: what stands before a word tells which."""
    monkeypatch.setattr(lm, "START_STEPS", 150)
    r = random.Random(12)
    tongues = [[a + b for a in x.split() for b in y.split()] for x, y in (("the of on er th ly es ti", "ab cd ef gh ij kl mn op"), ("zu wy qo xi vo ju ky ga", "ra se ti po lu wa ne mi"))]
    rows = [(i, " ".join(r.choice(tongues[i % 2]) + ("x" if r.random() < 0.02 else "") for _ in range(r.randint(20, 200)))) for i in range(600)]
    rows[6] = (6, " ".join(w for pair in zip(*(r.choices(t, k=60) for t in tongues)) for w in pair))  # of both, by turns
    rows.append((601, " ".join(r.choice(tongues[0]) for _ in range(100_000))))
    got = lm.scores(frame(spark, rows)).collect()
    for held in (True, False):
        own = [x for x in got if x.held_out == held]
        n = sum(x.n_tokens for x in own)
        assert sum(x.score for x in own) / n > sum(x.base_score for x in own) / n + 0.1
    each = {x.doc_id: x.score / x.n_tokens for x in got}
    assert each[6] < min(each[8], each[10], each[7])


def test_a_block_is_scored_in_pieces(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    classes = np.arange(257) % lm.CLASSES
    model, share = attention.flat(attention.fresh(np.ones(lm.CLASSES))), np.zeros(257)
    texts = ["word other more " * (1 + k % 7) if k % 5 else None for k in range(300)]
    table = pa.table({"id": list(range(300)), "block": pa.array([0] * 300, pa.int32()), "train": [k % 4 > 0 for k in range(300)], "t": texts, "o": list(range(300))})
    ranks = SimpleNamespace(value={bytes([b]): b for b in range(256)})
    asked = lm._ask(ranks, classes, model, 256, 1)(table).slice(0, 1).select(["block", "at", "blob"])
    answers = lm._add_up(asked).select(["block", "at", "blob"])
    wide, sequences = [], lm._sequences
    monkeypatch.setattr(lm, "_sequences", lambda *x: (out := sequences(*x), wide.append(len(out[0])))[0])
    results = []
    for windows in (1 << 20, 4):
        wide.clear()
        monkeypatch.setattr(lm, "_LAID_OUT", windows)
        results.append(lm._score(ranks, classes, model, share, 256, 225, (np.full(lm.CLASSES, 9.0), np.ones(lm.CLASSES)), 1)(table, answers))
    assert len(wide) > 50 and max(wide) <= 4 * attention.STRIDE + 120  # a text more at most
    for name in ("id", "held_out", "n_tokens", "n_known"):
        assert results[0].column(name) == results[1].column(name)
    for name in ("base", "score"):
        assert np.allclose(results[0].column(name), results[1].column(name), rtol=1e-5)


def test_a_long_unseen_word_costs_what_its_spelling_does(spark, monkeypatch):
    for name, value in (("START_STEPS", 20), ("BLOCK_STEPS", 3)):
        monkeypatch.setattr(lm, name, value)
    r = random.Random(4)
    unseen = lambda n: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = [(i, "the of onan erth lyes") for i in range(200) if i not in held] + list(zip(held, map(unseen, (500, 1000, 2000))))
    score = {x.doc_id: x.score for x in lm.scores(frame(spark, rows)).collect()}
    a, b, c = (score[i] for i in held)
    assert a < -500 and np.isfinite(c)
    assert 1.8 < b / a < 2.2 and 1.8 < c / b < 2.2


def test_language_model(spark, monkeypatch):
    for name, value in (("START_STEPS", 20), ("BLOCK_STEPS", 3)):
        monkeypatch.setattr(lm, name, value)
    rows = corpus(9, 60)
    count, got = Counter(), lm.scores(frame(spark, rows)).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    for d, t in rows:
        if not held(d):
            count.update((t or "").encode().lower().split())
            count[None] += 1
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        want.append((d, held(d), len(words), sum(count[w] > 0 for w in words), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 5)))
    assert ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == ordered(want)
    assert all(r.score < 0 for r in got)
    empty = {r.score for r in got if r.n_tokens == 1}
    assert max(empty) - min(empty) < 1e-5  # the order of additions differs between blocks
    assert lm.scores(frame(spark, [])).count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [(*m.span(), "email") for m in EMAIL.finditer(t)]
    out += [(*m.span(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(t) if 14 <= len(d(m.group())) <= 19 and pii.luhn(d(m.group()))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(t) if 10 <= len(d(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_pii_base_spans():
    r = random.Random(6)
    for _ in range(4000):
        t = "".join(r.choice(["@", ".", "a", "é", "1", "25", "300", "-", " ", "+", "(", "com", "a@b.c", "4028005252517056", "+1 (412) 555-1832", "1.2.3.4"]) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_pii_query(spark):
    texts = [f"Ünme mail x{i}.{i}@mail.example.com and +1 (412) 555-18{i:02d} end" for i in range(40)]
    texts += [f"password=baa1fad1a4b3{i:02d}6a280 then" for i in range(40)] + [f"call (412) 555-18{i:02d} now" for i in range(40)] + ["joe [at] home [dot] org", None, "", "no data"]
    rows = list(enumerate(texts)) + [(None, texts[0])]
    got = pii.find(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        base = plain_spans(t or "")
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert by[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(by[i].spans.split(","))
    assert by[50].spans.startswith("secret:9:") and by[90].spans.startswith("phone:5:")
    assert pii.find(frame(spark, [])).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, rows[:-1])).collect()}
    assert "<EMAIL>" in clean[0] and "@" not in clean[0] and clean[121] is None and clean[123] == "no data"


def test_masked_spans_may_overlap():
    text = "see a@10.1.2.3 or 10.1.2.3@host.com now"
    assert pii.masked(text, pii.base_spans(text)) == "see <EMAIL/IP> or <EMAIL/IP> now"
    assert pii.masked(text, []) == text and pii.masked("", []) == ""


def test_long_secrets_are_found_whole(spark):
    r = random.Random(3)
    token = lambda n: "".join(r.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    rows = [(i, f"Set password = {token(n)} and go") for i, n in enumerate((12, 40, 360, 2000) * 4)]
    rows += [(90, "x" * 200 + " [at] " + "y" * 100 + " [dot] com"), (91, "a." * 200_000 + " password" + " " * 50_000), (92, None), (92, "mail me@host.org"), (92, "mail me@host.org")]
    df = frame(spark, rows)
    found = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert all(found[i] == f"secret:15:{15 + n}" for i, n in enumerate((12, 40, 360, 2000) * 4))
    assert pii.candidates(rows[16][1], []) == [(0, 316, "email")] and found[91] == ""
    clean = pii.redact(df)
    assert clean.columns == df.columns
    texts = collected(clean, "doc_id", "text")
    assert [t for d, t in texts if d == 92] == [None, "mail <EMAIL>", "mail <EMAIL>"]
    assert all(t == "Set password = <SECRET> and go" for d, t in texts if d < 16)


def test_weak_supervision_finds_the_bad_labeler():
    r, keys = random.Random(2), Counter()
    for _ in range(3000):
        real = r.random() < 0.5
        v = [(1 if (r.random() < q) == real else 2) for q in (0.9, 0.9, 0.85, 0.5, 0.8)]
        keys["0" + "".join(map(str, v)) + "0000"] += 1
    p = dict(zip(keys, pii.reliabilities(list(keys), np.array(list(keys.values())))))
    assert p["0111110000"] > 0.9 and p["0222220000"] < 0.1 and abs(p["0111210000"] - p["0111110000"]) < 0.1


@pytest.fixture(scope="module")
def vocabulary():
    return spm.load()


def _encoded(texts, v):
    b = [t.encode() for t in texts]
    ids, at = spm.encode(np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)]), v)
    back, ends = spm.decode(ids, at, v)
    raw = back.tobytes()
    return [ids[i:j].tolist() for i, j in zip(at, at[1:])], [raw[i:j].decode() for i, j in zip(ends, ends[1:])]


def test_sentencepiece_is_the_librarys(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    r = random.Random(5)
    texts = ["", " ", "a", "  b  c ", "x" * 70, "=" * 33, "日本 ☃ \U0001f600\x00 z", "aaaa bbbb abababab", "\t\t tab\r\n", "▁a▁b"]
    texts += ["".join(r.choice("ab cde\n thé=-_ü0123er") for _ in range(r.randint(0, 80))) for _ in range(1500)]
    texts += [t or "" for _, t in corpus(11)]
    ids, back = _encoded(texts, vocabulary)
    assert ids == sp.encode(texts)
    assert all(b == t for b, t in zip(back, texts) if "▁" not in t)


def test_sentencepiece_of_long_segments(vocabulary):
    """Words far longer than a lane, also such as collide under a polynomial hash or never fall into step."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    r = random.Random(7)
    mirrored = ["".join(ab[bin(i).count("1") % 2] for i in range(2048)) for ab in ("ab", "ba")]
    texts = [*mirrored, "a" * 5000, "ab" * 3000, "=-" * 900, "x" * 777, *mirrored]
    for letters in ("abcdefghijklmnopqrstuvwxyz", "日本語中文のは☃é\U0001f600ü", "ththeinganderion"):
        texts += ["".join(r.choice(letters) for _ in range(r.randint(200, 3000))) for _ in range(20)]
        texts += [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 400))) for _ in range(30)) for _ in range(10)]
    texts.append("".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1 << 20)))
    ids, back = _encoded(texts, vocabulary)
    assert ids == sp.encode(texts) and back == texts


def test_suffix_array():
    data = np.frombuffer(b"banana band bandana banana", np.uint8)
    order = spm.suffix_array(spm._words(data), len(data), 26)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: bytes(data[i:]))


def test_sentencepiece_query(spark, vocabulary):
    rows = corpus(12, 8)
    df = frame(spark, rows)
    got = spm.digests(df).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    assert {r.n_ids for r in got if r.n_bytes == 0} == {0}
    both = spm.with_text(spm.with_ids(df)).collect()
    assert all(r.decoded == (r.text or "") for r in both)
    assert spm.digests(frame(spark, [])).count() == 0


PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items):
    lower = {i: i + 32 for i in range(65, 91)}
    words = lambda t: PATTERN.findall((t or "").translate(lower))
    known = {}
    for i, t in items:
        w = words(t)
        n = min(decontaminate.WINDOW, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [str(i)])
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
                    found |= known[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return ordered(out)


ITEM_SCHEMA = "item_id bigint, text string, doc_id bigint, source string"


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, limit):
    rows = corpus(13) + [(2000, "ÉTÉ the lone-words q r s t u v w x y z1 END"), (2001, "zz lone yy")]
    items = [(10, "lone words q r s t u v w x y z1"), (9, " ".join(rows[0][1].split()[3:16])), (100, rows[1][1]), (7, "lone"), (8, None), (6, ""), (5, "?! ."), (None, "lone"), (10, "lone words q r s t u v w x y z1"), (4, "The the")]
    bench = spark.createDataFrame([(i, t, 1, "s") for i, t in items], ITEM_SCHEMA)
    got = decontaminate.contamination(frame(spark, rows), bench, broadcast_windows=limit)
    assert collected(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_contamination(rows, items)
    kept = decontaminate.clean(frame(spark, rows), bench)
    assert ordered((r.doc_id,) for r in kept.collect()) == ordered((d,) for (d, _), b in zip(rows, [next(x for x in brute_contamination([row], items)) for row in rows]) if not b[5])
    nothing = bench.limit(0)
    assert not decontaminate.contamination(frame(spark, rows), nothing).where("contaminated").count()
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def test_decontamination_runs_no_python(spark):
    bench = spark.createDataFrame([(1, "a b c", 1, "s")], ITEM_SCHEMA)
    plan = decontaminate.contamination(frame(spark, corpus()), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
