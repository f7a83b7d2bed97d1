"""Prefix trie, packing and spelling variants: brute force, odd rows, small bounds."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import packing, prefix_trie, spelling
from vigil.llm.plans import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")


def trie(rows, grafted):
    """Nodes of the prefix trie of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends, n_kids, saved, leaves = defaultdict(list), Counter(), Counter(), Counter()
    for c in sorted(own):
        turns = own[c]
        if grafted:
            h = zlib.crc32(str(c).encode()) % 6
            turns = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(str(c))
    for p in members:
        if p:
            n_kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not n_kids[p]
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    return Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), n_kids[p], leaves[p], saved[p], sha(ends[p]))
        for p, m in members.items()
    )


def turns_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "weight", "p0", "k", "part", "h"):
        df = df.withColumn(name, F.lit("x"))
    return prefix_trie.number_turns(df)


def report(spark, rows, grafted, **bounds):
    turns = turns_of(spark, rows)
    args = prefix_trie.graft(turns) if grafted else (turns, turns.select("conv_id").distinct())
    return Counter(tuple(r) for r in prefix_trie.trie_report(*args, **bounds).collect())


def test_op11_brute_force(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert Counter(tuple(r) for r in QUERIES["op11_prefix_trie"](spark, SF).collect()) == trie(rows, True)


def deep_rows():
    """Long shared prefixes, many copies, nulls, ties and repeated rows."""
    rng = random.Random(5)
    rows = []
    for c in range(120):
        cut = rng.randint(0, 150)
        rows += [(c, t, "user", "ab"[t * t % 7 % 2]) for t in range(cut)]
        rows += [(c, cut + j, "user", rng.choice("xy")) for j in range(rng.randint(0, 3))]
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(3)]
    rows += [(None, 1, "a", "b"), (500, None, None, None), (500, None, None, None), (500, 3, "q", "é漢")]
    return rows + [(200, 1, "user", None), (200, 1, "aide", "x"), (300, 1, None, "y" * 5000)]


@pytest.mark.parametrize("bounds", [{"small": 64, "run": 16}, {}])
def test_trie_deep(spark, bounds):
    rows = deep_rows()
    assert report(spark, rows, grafted=not bounds, **bounds) == trie(rows, not bounds)


def test_trie_empty(spark):
    assert not report(spark, [], True)
    assert report(spark, [(7, 1, "a", "b")], False) == trie([(7, 1, "a", "b")], False)


def test_centroid_sums():
    """Random trees, a long path and a star: the sums of a plain walk from the leaves."""
    rng = random.Random(2)
    for n, pick in ((1, None), (300, lambda i: rng.randrange(i)), (300, lambda i: i - 1), (300, lambda i: 0)):
        up = [-1, *[pick(i) for i in range(1, n)]]
        own = [[rng.randrange(100) for _ in range(n)], [1] * n]
        out = [[0] * n, [0] * n]
        prefix_trie.centroid_sums(list(range(n)), up, own, out)
        want = [list(o) for o in own]
        for w in want:
            for i in reversed(range(1, n)):
                w[up[i]] += w[i]
        assert out == want


def pieces_of(df):
    return [r.asDict() for r in df.collect()]


def check_windows(rows, docs, capacity):
    """Every id of every document in one piece, windows gapless and full but for powers of two."""
    library = Tokenizer.from_file(WORDS)
    windows, found = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        found[r["doc_id"], r["doc_tokens"]].append(r)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == capacity or (at < capacity and at.bit_count() == 1)
    wanted = Counter()
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        wanted[d, struct.pack(f"<{len(ids)}I", *ids)] += 1
    return windows, found, wanted


def test_op12_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows = pieces_of(QUERIES["op12_packing"](spark, SF))
    _, found, wanted = check_windows(rows, docs, 4096)
    for d, ids in wanted:
        at = 0
        for r in sorted(found.pop((d, len(ids) // 4)), key=lambda r: r["start"]):
            part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids) // 4
    assert not found


@pytest.mark.parametrize("capacity, open_limit", [(4096, 2048), (64, 2), (7, 3), (1, 2)])
def test_packing_odd_rows(odd_docs, capacity, open_limit):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    rows = pieces_of(packing.pack_documents(odd_docs, WORDS, 2, capacity, open_limit))
    _, _, wanted = check_windows(rows, docs, capacity)
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    want = Counter()
    for (d, ids), n in wanted.items():
        want[d] += n * (len(ids) // 4)
    assert got == want
    assert packing.pack_documents(odd_docs.where("false"), WORDS, 2).count() == 0


def test_sum_of_squares_level():
    """The chosen level against trying all of them."""
    rng, packer = random.Random(3), packing.Packer(64, open_limit=40)
    for doc in range(2000):
        size = rng.randint(1, 63)
        tried = []
        for level in range(64 - size + 1):
            if level and not packer.count[level]:
                continue
            after = packer.count.copy()
            if level:
                after[level] -= 1
            if level + size < 64:
                after[level + size] += 1
            tried.append((int((after**2).sum()), -level))
        assert packer.level(size) == -min(tried)[1]
        packer.add(doc, bytes(4 * size))
    packer.finish()
    cuts = sum(len(w) for w in packer.full) - 2000
    assert cuts <= len(packer.full) and sum(p[2] for w in packer.full for p in w) == sum(
        t for _, t in {(p[0], p[4]) for w in packer.full for p in w}
    )
    with pytest.raises(ValueError):
        packing.Packer(0)


def variants(docs, deleted):
    """word, form, root, n, n_near, form_n by trying all pairs of lengths that differ by one at most."""
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if deleted and h % deleted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2 and len(w) >= 7}
    near, replaced = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            replaced[i, cut].add(w)
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    for group in replaced.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def grouped(df, **bounds):
    return {tuple(r) for r in spelling.group_variants(df, **bounds).collect()}


@pytest.mark.parametrize("segments, block", [(4, 1024), (1, 5), (2, 3), (7, 2), (9, 1024)])
def test_spelling_bounds(spark, make_docs, segments, block):
    """Blocks far smaller than groups, and any number of segments, give the same words."""
    rng = random.Random(segments)
    words = ["absolutely", "aaaaaaaa", "aaaaaaab", "receiving", "Çédillesß", "x" * 3000, "x" * 2999, "y" + "x" * 2999]
    text = []
    for _ in range(300):
        w = list(rng.choice(words[:5]))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        text += ["".join(w)] * rng.choice([2, 2, 3, 40])
    docs = [(1, " ".join(text)), (2, " ".join(words * 20)), (None, None), (3, ""), (3, "receivin9 RECEIVING receiving.")]
    docs += [(4, " ".join(["absoluteli"] * 2)), (4, " ".join(["absoluteli"] * 2))]
    counts = spelling.count_words(make_docs(docs), least=7, deleted=31)
    assert grouped(counts, segments=segments, block=block) == variants(docs, 31)


def test_spelling_odd_rows(odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert grouped(spelling.count_words(odd_docs)) == variants(docs, 0)
    assert not grouped(spelling.count_words(odd_docs.where("false")))


def test_op13_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, SF).collect()} == variants(docs, 31)


def test_chain_of_forms(spark):
    """Chains of several forms end at their last."""
    rows = [("abcdefgh", 20_000), ("abcdefgx", 2000), ("abcdefyx", 200), ("abcdezyx", 20), ("abcdwzyx", 2), ("other__", 9)]
    got = {r["word"]: r["root"] for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {w: "abcdefgh" for w, _ in rows[:5]} | {"other__": "other__"}


def test_near_pairs_every_edit():
    """All pairs of short strings over two letters against the definition."""
    words = ["".join(p) for n in (3, 4) for p in np.array(np.meshgrid(*["ab"] * n)).reshape(n, -1).T]
    table = pa.array(words)
    one = lambda x, y: any(x[:i] + x[i + 1 :] == y for i in range(len(x)))
    a, b = np.triu_indices(len(words), 1)
    short = np.minimum([len(words[i]) for i in a], [len(words[i]) for i in b])
    found = sum(spelling.near_pairs(table, a, b, short, np.full(len(a), s), 3).astype(int) for s in range(3))
    for i, j, f in zip(a, b, found):
        x, y = words[i], words[j]
        same = len(x) == len(y) and sum(c != d for c, d in zip(x, y)) == 1
        assert f == (same or (len(x) != len(y) and (one(x, y) or one(y, x))))
