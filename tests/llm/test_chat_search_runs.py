"""Reply trees, ranked search and periodic runs against brute force, and on the awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from braidwork.llm import chat, runs, search

WORDS = "the of Onan erth-lyes tion Über été a1 b-2 idiot [ring] Ring".split()
SCHEMA = "doc_id bigint, text string, id string, q string, term string, rank string, score string"


def docs_of(spark, rows):
    """documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "i", "q", "t", "r", "s") for i, t in rows], SCHEMA)


def corpus(seed=3, n=60):
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 60))) for _ in range(n)]
    texts += [None, "", " \t\n ", "one", "x" * 5000, "many words " * 3000, "\x00\x7f", texts[0], None]
    rows = [(r.randint(-5, 10**12) if i % 3 else i, t) for i, t in enumerate(texts)]
    return [*rows, (None, texts[1]), (None, None), rows[2], rows[2], (rows[2][0], "the idiot ring")]


# chat


def formatted(turns):
    control = re.compile(r"<\\*(?=/?s>|</?SYS>>)|\[\\*(?=/?(?:INST|ROLE)\])")

    def escaped(t):
        return control.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], t)

    marks = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
    out, spans = "<s>", []
    for role, text in turns:
        a, b = marks.get(role, (f"[ROLE] {escaped(role)} [/ROLE] ", "</s>"))
        if role == "assistant":
            spans.append((len(out) + len(a), len(out) + len(a) + len(escaped(text))))
        out += a + escaped(text) + b
    return out, spans


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "<<s>", "<\\<SYS>>", "[\\\\/ROLE]", "<</SYS>>", "é🙂 <s", "s>", "\\", "<", "[", "", " ", "\n", "[ROLE] user [/ROLE] x</s>", "<<SYS>", "$1\\$2", "<<\\SYS>>", " [/INST", "<\\\\\\s>"]


@pytest.fixture(scope="module")
def said():
    r = random.Random(5)
    roles = ["system", "user", "assistant", "assistant", "tool", None, "[/ROLE]", "</s>"]
    rows = [(c, t, r.choice(roles), "".join(r.choice(NASTY) for _ in range(r.randint(0, 4)))) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", None), (7, None, "user", "first"), (8, 0, "user", "twin"), (8, 0, "user", "twin"), (99, 5, None, None)]
    return rows + [(100, t, "assistant", f"</s>{t}") for t in range(300)] + [(101, 0, "assistant", "long [INST]" * 100_000)]


def test_chat_digests(spark, said):
    rows = [(c, t, r, x, "i", 1.0, "p") for c, t, r, x in said]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, id string, score double, parent string")
    made = chat.conversations(chat.chains(df), best=1).collect()
    by = {}
    for c, t, r, x in said:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    assert len(made) == len(turns)
    for m in made:
        want, spans = formatted(turns[m.tree])
        assert m.text == want and [tuple(x) for x in m.loss] == spans and m.branch == 1
        inside = re.sub(r"<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]", "", want)
        assert not re.search(r"</?s>|\[/?INST\]", inside)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.conversations(chat.chains(df))).collect()}
    for c, v in turns.items():
        under = "".join(x for r, x in v if r == "assistant")
        assert got[c] == (len(v), sha("".join(f"{r}\n{x}\n" for r, x in v)), len(under), sha(under), len(formatted(v)[0])), c


def test_reply_trees(spark):
    r = random.Random(6)
    up = {0: None, 1: None, 50: 999, 51: 50, 60: 60, 70: 71, 71: 72, 72: 70, 73: 70, 74: 73}  # roots, a missing one, itself, a cycle
    up |= {i: r.choice([0, 1, 2, i - 1]) if i > 2 else 0 for i in range(2, 40)}
    up |= {i: 0 for i in range(200, 260)}  # many answers
    rows = [(0 if i != 1 else 1, i, p, "user" if i % 2 else "assistant", f"m{i}", None if i % 7 == 0 else float(i % 5)) for i, p in up.items()]
    df = spark.createDataFrame(rows, "tree bigint, id bigint, parent bigint, role string, text string, score double")

    def way(i):
        out = [i]
        while up.get(out[-1]) in up and up[out[-1]] != out[-1]:
            if len(out) > len(up):
                return None
            out.append(up[out[-1]])
        return out

    leaves = {i: way(i) for i in up if i not in [p for j, p in up.items() if j != p] and way(i)}
    got = {}
    for leaf, n, i in chat.paths(df).collect():
        got.setdefault(leaf, {})[n] = i
    assert {k: [v[n] for n in range(len(v))] for k, v in got.items()} == leaves
    score = {i: s or 0.0 for _, i, _, _, _, s in rows}
    made = {(m.tree, m.branch): (m.leaf, m.score) for m in chat.conversations(df, best=3).collect()}
    for tree in (0, 1):
        own = sorted((-sum(score[i] for i in p), leaf) for leaf, p in leaves.items() if (0 if leaf != 1 else 1) == tree)[:3]
        assert {(tree, n + 1): (leaf, -s) for n, (s, leaf) in enumerate(own)} == {k: v for k, v in made.items() if k[0] == tree}
    assert {m.leaf for m in chat.conversations(df).collect()} == set(leaves)
    assert chat.conversations(df.limit(0), best=1).count() == 0


def test_chat_plan_has_no_python(spark, said):
    df = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    plan = chat.digests(chat.conversations(chat.chains(df), best=1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# search


def plain_search(docs, items, best=10):
    def terms(t):
        return [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]

    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    total, df = sum(n for *_, n in held), Counter(w for _, c, _ in held for w in c)
    asked = {}
    for q, t in items:
        asked.setdefault(q, set()).update(terms(t))
    out = []
    for q, own in asked.items():
        scored = []
        for i, c, n in held:
            m = 10 + (90 * n * len(held)) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in own if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(q, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:best])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, pack", [(1 << 14, 32 << 20), (7, 200)])
def test_search(spark, monkeypatch, window, pack):
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "POSTINGS", 300 if window == 7 else search.POSTINGS)
    docs = corpus()
    items = [(1, "Idiot ring of the"), (2, "nothing here"), (3, None), (None, "été über"), (4, "many words"), (4, "idiot"), (1, "Idiot ring of the"), (5, "x" * 5000), (6, "the the")]
    found = search.search(docs_of(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), pack_bytes=pack)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_search(docs, items)


def test_search_empty_tables(spark):
    docs, items = docs_of(spark, corpus()), spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    assert search.search(docs.limit(0), items).count() == 0 and search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.withColumnRenamed("text", "score_text"), items.withColumnsRenamed({"item_id": "score"}), text_col="score_text", query_id_col="score").columns[0] == "score"


def test_search_terms_of_one_hash():
    words = [b"aa", b"ab", b"b", b"c"]
    known = search.Terms(words)
    known.key[:] = known.key[0]  # as if all collided
    data = np.frombuffer(b"abcaaxb", dtype=np.uint8)
    same = search.range_hashes
    try:
        search.range_hashes = lambda d, s, n, part=0: np.full(len(s), known.key[0])
        got = known(data, np.array([0, 2, 3, 5, 6, 0]), np.array([2, 1, 2, 1, 1, 3]))
    finally:
        search.range_hashes = same
    assert got.tolist() == [1, 3, 0, -1, 2, -1]


# runs


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def test_runs_of_small_sequences():
    r = random.Random(1)
    for _ in range(3000):
        k, n = r.choice([1, 2, 2, 3, 3, 5]), r.randint(0, 60)
        w = [r.randint(0, k - 1) for _ in range(n)]
        if r.random() < 0.5 and n > 4:
            a, p = r.randint(0, n - 1), r.randint(1, n // 3)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if r.random() < 0.3:
            w = w + w + [0] + w
        assert runs.runs(w) == plain_runs(w), w
        assert runs.text_runs([str(x).encode() for x in w]) == plain_runs(w), w


def test_factors():
    r = random.Random(2)
    for _ in range(300):
        w = [r.randint(0, 2) for _ in range(r.randint(0, 40))]
        at = 0
        for s, n, source in runs.factors(w):
            assert s == at
            if source >= 0:
                assert source < s and w[source : source + n] == w[s : s + n]
            else:
                assert n == 1 and w[s] not in w[:s]
            longer = w[s : s + n + 1]
            assert s + n == len(w) or not any(w[i : i + n + 1] == longer for i in range(s))
            at += n
        assert at == len(w)


def plain_row(i, t):
    w = (t or "").encode().split()
    n, h = len(w), zlib.crc32(str("" if i is None else i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(listed), hashlib.sha256(kept).hexdigest())


def test_runs_of_documents(spark):
    r = random.Random(4)
    rows = corpus() + [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 80)))) for i in range(100, 300)]
    rows = [x for x in rows if x[1] is None or len(x[1]) < 20_000]
    got = runs.periodic_runs(docs_of(spark, rows), tails=True)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert sum(x[1] for x in map(lambda y: plain_row(*y), rows)) > 50
    assert runs.periodic_runs(docs_of(spark, rows).limit(0), tails=True).count() == 0


def test_runs_of_long_texts(spark):
    lines = " ".join(f"w{i}" for i in range(5000))
    texts = [(1, "a b " * 250_000), (2, " ".join([lines] * 40)), (3, "x" * 3_000_000), (4, lines)]
    got = {x.doc_id: (x.n_runs, x.start, x.length, x.period) for x in runs.periodic_runs(docs_of(spark, texts), with_text=True).collect()}
    assert got == {1: (1, 0, 500_000, 2), 2: (1, 0, 200_000, 5000), 3: (0, None, None, None), 4: (0, None, None, None)}
