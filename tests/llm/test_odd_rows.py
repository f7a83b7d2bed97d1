"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from vigil.llm import (
    byte_bpe,
    chat_format,
    common,
    embedding_dedup,
    fingerprints,
    language_id,
    license_scan,
    mixing,
    passage_dedup,
    simhash,
    token_files,
)
from vigil.llm.common import scratch_path

BPE = P.path("byte_bpe_multi_50k.tiktoken")


def pairs(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_mixing(odd_docs):
    out = mixing.mix_report(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    sizes = Counter()
    for r in odd_docs.select("source", "text").collect():
        sizes[r["source"]] += len(brute.WORD.findall(r["text"] or ""))
    want = brute.targets(dict(sizes))
    assert {round(r["target"], 6) for r in rows} <= {round(v, 6) for v in want.values()}
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert pairs(out, "doc_id", "taken") == pairs(mixing.mix_report(odd_docs), "doc_id", "taken")
    mixed = mixing.mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r["times"] for r in rows)


def test_language(odd_docs):
    model = language_id.learn(odd_docs)
    assert set(model) == {"en", "de", "es"}
    got = language_id.predict(odd_docs, model, F.col("doc_id").alias("id"), F.col("text").alias("t")).collect()
    for r in got:
        none = not any(c.isalpha() for c in r["t"] or "")
        assert (r["lang_pred"] == "und") == none and (r["score"] == 0 if none else 0 <= r["score"] <= 1)
    assert language_id.predict(odd_docs, {}, F.col("doc_id")).where("lang_pred != 'und'").count() == 0
    kept = language_id.drop_foreign(odd_docs)
    assert kept.columns == odd_docs.columns and 7 in {r["doc_id"] for r in kept.collect()}


def test_simhash(odd_docs):
    docs = texts(odd_docs)
    fps = [brute.fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    comp = brute.components(range(len(docs)), links)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[comp[i]] = min(d, least.get(comp[i], d))
    want = Counter((d, fps[i], least.get(comp[i])) for i, (d, _) in enumerate(docs))
    got = simhash.simhash_components(odd_docs).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values()))


def test_simhash_one_per_component(make_docs):
    """Null and repeated ids: one document of every component stays."""
    first, second, third = ("alpha beta gamma delta " * 9, "un deux trois quatre cinq " * 9, "eins zwei drei vier " * 9)
    rows = [(None, first), (None, first), (3, first), (2, second), (2, second + "\n"), (None, third), (None, third)]
    left = simhash.drop_near_duplicates(make_docs(rows))
    assert pairs(left.selectExpr("doc_id", "trim(BOTH '\n ' FROM text) AS words"), "doc_id", "words") == Counter(
        [(3, first.strip()), (2, second.strip()), (None, third.strip())]
    )


def test_simhash_split_tiles(spark, monkeypatch):
    """Tiles and crowds far larger than a block give the same components."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(150):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    comp = brute.components(range(len(fps)), links)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    from vigil.llm.components import connected_components

    counts = np.zeros(17**4, np.int64)
    for n in (np.array(signed, np.int64),):
        tiles = [0] * len(n)
        for q in range(4):
            tiles = [t * 17 + ((f >> 16 * q) & 0xFFFF).bit_count() for t, f in zip(tiles, fps)]
        np.add.at(counts, tiles, 1)
    monkeypatch.setattr(simhash, "HOME", 16)
    monkeypatch.setattr(simhash, "VISITORS", 32)
    groups = {}
    for tile, block, part, home, f in simhash.deal(counts, 2)(np.array(signed), np.array(tiles)):
        block, part = np.broadcast_to(block, len(f)), np.broadcast_to(part, len(f))
        for b, p, x in zip(block.tolist(), part.tolist(), f.tolist()):
            groups.setdefault((tile, b, p), ([], []))[not home].append(x)
    edges = []
    for (_, _, part), (home, guests) in groups.items():
        both = np.array(home + guests, np.int64).view(np.uint64)
        at, root = simhash._links(both[: len(home)], both[len(home) :], part == 0, 2)
        edges += list(zip(both[at].tolist(), both[root].tolist()))
    assert brute.components(fps, edges) == {f: fps[comp[i]] for i, f in enumerate(fps)}
    found = simhash.link_fingerprints(nodes, 2)
    roots = {r["node"]: r["root"] for r in connected_components(found).collect()}
    by_root = {}
    for i, f in enumerate(signed):
        by_root.setdefault(roots.get(f, f), set()).add(i)
    want = {}
    for i in range(len(fps)):
        want.setdefault(comp[i], set()).add(i)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


def test_byte_bpe(odd_docs):
    got = byte_bpe.encode_texts(odd_docs, BPE, P.PATTERN, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == odd_docs.count()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in got)


def test_license(make_docs):
    mit = license_scan.TEMPLATES["MIT-grant"]
    docs = make_docs(
        [
            (1, None),
            (2, ""),
            (3, "one"),
            (4, "Hello there.\nReleased under the MIT License.\nBye now"),
            (5, mit.replace(", ", ",\n")),
            (6, "word " * 100_000),
            (4, "Hello there.\nReleased under the MIT License.\nBye now"),
        ]
    )
    got = pairs(license_scan.scan_licenses(docs), "doc_id", "unit", "license", "dice")
    assert got == Counter({(4, 2, "MIT", 1.0): 2, (5, 0, "MIT-grant", 1.0): 1})


def test_license_in_long_documents(make_docs):
    """Notices wrapped over lines, or in a line with other prose, in the midst of long texts."""
    import textwrap

    prose = " ".join(f"word{i} of the other {i}" for i in range(400))
    wrap = lambda name, width=60: "\n# ".join(textwrap.wrap(license_scan.TEMPLATES[name], width))
    names = ["Apache-2.0-header", "BSD-3-Clause", "GPL-header", "MIT-grant", "MPL-2.0"]
    rows = [(i, f"{prose}\n\n# {wrap(n)}\n\n{prose}\n{prose}") for i, n in enumerate(names)]
    rows += [
        (10, f"{prose} {license_scan.TEMPLATES['BSD-3-Clause']} {prose}"),
        (11, f"{prose}\n{wrap('MIT-grant')}\n{prose}\n{wrap('BSD-3-Clause', 30)}\n{wrap('BSD-3-Clause', 30)}\n{prose}"),
        (12, f"{prose}\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n{prose}"),
        (13, f"{prose}\nReleased under the MIT License.\nBye\n{prose}"),
        (14, f"{wrap('MIT-grant')}\n{wrap('BSD-3-Clause', 30)}"),
    ]
    got = pairs(license_scan.scan_licenses(make_docs(rows + rows[1:2])), "doc_id", "unit", "license", "dice")
    mit, bsd = (len(license_scan.template_bigrams(license_scan.TEMPLATES[n])) for n in ("MIT-grant", "BSD-3-Clause"))
    after = 2 + wrap("MIT-grant").count("\n") + 2
    whole = next(v for (d, u, *_, v) in got if (d, u) == (14, 0))
    want = Counter({(i, 3, n, 1.0): 1 for i, n in enumerate(names)})
    want += Counter([(1, 3, "BSD-3-Clause", 1.0), (10, 1, "BSD-3-Clause", 1.0), (11, 2, "MIT-grant", 1.0)])
    want += Counter([(11, after, "BSD-3-Clause", 1.0), (11, after + 1 + wrap("BSD-3-Clause", 30).count("\n"), "BSD-3-Clause", 1.0)])
    want += Counter([(12, 2, "GPL-3.0", 1.0), (13, 2, "MIT", 1.0), (14, 0, "MIT-grant", whole)])
    want += Counter([(14, 2 + wrap("MIT-grant").count("\n"), "BSD-3-Clause", 1.0)])
    assert 2 * mit / (2 * mit + bsd + 1) == pytest.approx(whole, abs=0.03)
    header = {k: n for k, n in got.items() if k[0] == 0 and k[2] == "Apache-2.0"}
    assert len(header) <= 1 and all(k[1] == 3 for k in header)  # its first line is near the short notice
    assert got - Counter(header) == want


def test_fingerprints(odd_docs):
    got = fingerprints.fingerprint_with_edit(odd_docs).collect()
    order = sorted(texts(odd_docs), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in order)
    by_id = {r["doc_id"]: r for r in got}
    for (d, t), (_, after) in zip(order, order[1:]):
        if d is None or d == 6 or [x for x, _ in order].count(d) > 1:
            continue  # ties are ordered by a hash
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert by_id[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {by_id[2]["fingerprint"]}


def test_prefix_hashes():
    import random

    rnd = random.Random(5)
    for _ in range(200):
        a = "".join(rnd.choice("ab😀") for _ in range(rnd.randint(0, 60)))
        cut = rnd.randint(0, len(a))
        b = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 5))) + a[cut:] + "z"
        x, y = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
        for _ in range(10):
            i, j = rnd.randint(0, len(a)), rnd.randint(0, len(b))
            want = 0
            while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
                want += 1
            assert x.extension(i, y, j) == want
        near = fingerprints.likeness(x.fingerprint(), y.fingerprint())
        assert 0 <= near <= 1 and near == fingerprints.likeness(y.fingerprint(), x.fingerprint())
        assert fingerprints.likeness(x.fingerprint(), x.fingerprint()) == 1


def test_every_letter_has_a_vector_of_its_own():
    """Texts whose letters are 101 code points apart are unlike; many letters fit."""
    import numpy as np

    profiler = language_id.Profiler()
    text = "\u4e00\u4e8c\u56db \u4e03\u516b\u4e5d\u5341"
    moved = "".join(c if c == " " else chr(ord(c) + 101) for c in text)
    one, other = (profiler.bundle(*profiler.trigrams(t)) for t in (text, moved))
    assert abs(one @ other) / np.linalg.norm(one) / np.linalg.norm(other) < 0.3
    everything = "".join(map(chr, range(0x4E00, 0x5E00)))
    first = profiler.bundle(*profiler.trigrams(everything))
    # drawn by code point: the same in a worker that met the letters in another order
    again = language_id.Profiler()
    again.bundle(*again.trigrams(everything[::-1]))
    assert (again.bundle(*again.trigrams(everything)) == first).all()


def test_likeness_counts_every_block():
    """By brute force: blocks equal at the same place, the remainder too between texts of one length."""
    import random

    rnd = random.Random(9)
    for _ in range(300):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 300)))
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            b[rnd.randrange(len(b))] = rnd.choice("abcd")
        b = "".join(b) + "x" * rnd.choice([0, 0, 1, 40])
        block = 1
        while max(len(a), len(b)) > fingerprints.MAX_BLOCKS * block:
            block *= 2
        same = sum(
            len(a[i : i + block])
            for i in range(0, len(a), block)
            if a[i : i + block] == b[i : i + block] and (i + block <= len(a) or len(a) == len(b))
        )
        x, y = (fingerprints.PrefixHashes(t).fingerprint() for t in (a, b))
        assert fingerprints.likeness(x, y) == pytest.approx(same / max(len(a), len(b)))
    long = "x" * 3100  # 24 blocks of 128 and a remainder of 28
    x, y = (fingerprints.PrefixHashes(t).fingerprint() for t in (long, "y" + long[1:]))
    assert fingerprints.likeness(x, y) == 1 - 128 / 3100


def test_piece_cache_counts_bytes():
    calls = []

    def ids(piece):
        calls.append(piece)
        return piece.encode() * 4

    cache = common.PieceCache(ids, limit=1 << 20)
    for i in range(3000):
        assert cache[f"{i} " + "z" * 1000] == ids(f"{i} " + "z" * 1000)
    held = sum(cache.ENTRY + 4 * len(k) + len(v) for kept in (cache, cache.old) for k, v in kept.items())
    assert 1 << 20 < held <= 2 << 20
    before = len(calls)
    assert cache["q" * 9000] == cache["q" * 9000] and len(calls) == before + 2  # too long to be kept
    assert cache["word"] == cache["word"] and len(calls) == before + 3


@pytest.mark.parametrize("window", [16, 23, 50, 201])
def test_passages_any_window(make_docs, window):
    import random

    rnd = random.Random(window)
    shared = ["".join(rnd.choice("ab ") for _ in range(n)) for n in (window - 1, window, window + 9, 3 * window)]
    texts = ["".join(rnd.choice(shared + ["é%d" % rnd.randrange(9)]) for _ in range(rnd.randint(0, 6))) for _ in range(40)]
    docs = make_docs(list(enumerate(texts)))
    got = passage_dedup.passage_report(docs, window=window, batch_size=7).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute.repeats(texts, window)


@pytest.mark.parametrize("window", [0, 15, 4096])
def test_passages_window_out_of_range(make_docs, window):
    with pytest.raises(ValueError, match="window must be"):
        passage_dedup.passage_report(make_docs([(1, "x" * 9000)]), window=window)


@pytest.mark.parametrize("tile", [4096, 3])
def test_passages(make_docs, tile):
    import random

    rnd = random.Random(6)
    prose = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    shared, line = prose(400), prose(230)
    rows = [(i, prose(rnd.randint(0, 300)) + shared[rnd.randint(0, 190) :] + prose(rnd.randint(0, 300))) for i in range(25)]
    rows += [(100 + i, prose(50) + line + prose(50)) for i in range(12)]
    rows += [(200, prose(40) * 30), (201, "a" * 700), (202, None), (203, ""), (None, prose(500)), (None, None)]
    rows += [(204, prose(199)), (204, prose(600)), (205, line[:199]), (206, line[:200])]
    twin = prose(450)
    rows += [(300, twin), (300, twin), (301, twin[:210] + "X" + twin[211:])]
    docs = make_docs(rows)
    want = Counter((d, *r) for (d, _), r in zip(rows, brute.repeats([t for _, t in rows])))
    got = passage_dedup.passage_report(docs, tile=tile, batch_size=7)
    assert pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    left = passage_dedup.drop_passages(docs, tile=tile)
    assert left.columns == docs.columns
    for r in left.collect():
        assert r["n_chars"] == len(r["text"] or "")
    assert pairs(left, "doc_id").total() == len(rows)


def test_passages_copies(make_docs, monkeypatch):
    """Thousands of copies of a text: each of its contexts is searched once."""
    import random

    rnd = random.Random(7)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    copied = prose(500)
    rows = [(i, copied) for i in range(3000)]
    rows += [(5000 + i, prose(100) + copied[50 : 300 + i] + prose(100)) for i in range(5)] + [(6000, prose(400))]
    searched = []
    search = passage_dedup._search

    def counted(contexts, *how):
        searched.extend((r["gram"], r["context"]) for r in contexts.select("gram", "context").collect())
        return search(contexts, *how)

    monkeypatch.setattr(passage_dedup, "_search", counted)
    got = passage_dedup.passage_report(make_docs(rows))
    want = Counter((d, *r) for (d, _), r in zip(rows, brute.repeats([t for _, t in rows])))
    assert pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert searched and len(searched) == len(set(searched))


def test_chat(spark):
    rows = [
        (1, 0, "user", "a <| b <\\| c \\<\\\\|"),
        (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n"),
        (2, 0, "assistant", None),
        (2, None, None, "x"),
        (3, 0, "user\n<|im_start|>%0A", ""),
        (None, 0, "user", "q"),
        (None, 0, "user", "q"),
        (4, 0, "system", ""),
        (4, 1, "user", "long " * 50_000),
        (4, 2, "assistant", "é😀"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "'x' AS turns", "'y' AS segments", "1 AS valid"
    )
    got = chat_format.format_chats(df)
    got = got.withColumn("back", chat_format.parse_chats(F.col("formatted")))
    got = got.withColumn("learned", chat_format.loss_text(F.col("segments")))
    seen = {r["conv_id"]: r for r in got.collect()}
    for c in (1, 2, 3, 4, None):
        own = sorted(
            ((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c)
        )
        assert [tuple(x) for x in seen[c]["back"]] == [(r, x) for _, _, r, x in own]
        assert seen[c]["learned"] == "".join(x for _, _, r, x in own if r == "assistant")
    assert [seen[c]["valid"] for c in (1, 2, 3, 4, None)] == [True, False, False, True, False]


def test_token_files(odd_docs):
    spark = odd_docs.sparkSession
    path = scratch_path(spark, "t")
    file = P.path("word_bpe_49k.json")
    token_files.write_token_files(odd_docs, path, file, 2)
    got = token_files.read_token_files(spark, path).collect()
    words = Tokenizer.from_file(file)
    want = Counter(
        (d, bytes(b"".join(i.to_bytes(4, "little") for i in [*words.encode(t or "", add_special_tokens=False).ids, 2])))
        for d, t in texts(odd_docs)
    )
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    assert [r["doc_id"] or 0 for r in got] == sorted(r["doc_id"] or 0 for r in got)


def test_word_tokenizer():
    """Random strings of odd parts, and bounded memory: the ids of the library's plain call."""
    import random

    file = P.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(file), token_files.WordTokenizer(file, limit=40_000)
    rng = random.Random(7)
    signs = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "a", "Don't", "e\u0301", "\u00e9", "\u0130"]
    signs += ["漢字", " ", "\n", "\t", "  ", "123", "!!", "word", "x" * 100, "'s", "ß", "\u0301", ".", "_", "Hello", "\u1e9e"]
    lines = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(6000)] + ["a <|endoftext|> b"]
    ids = [list(memoryview(i).cast("I")) for i in words.encode(lines)]
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in lines]
    assert ids[-1] == [320, 49407, 321]
    assert all(len(p) <= token_files.LONG_PART for p in [*words.known, *words.known.older])


def test_word_tokenizer_other_file():
    """A file with other steps before its merges goes through the library alone."""
    file = P.path("byte_bpe_50k.json")
    library, words = Tokenizer.from_file(file), token_files.WordTokenizer(file)
    lines = ["Two  Words", " x<|endoftext|>", "", None, "é\n\n"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in lines]
    assert not words.by_parts and [list(memoryview(i).cast("I")) for i in words.encode(lines)] == want


def test_embeddings(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(60)]
    for i in range(60, 160):
        base = np.array(rows[i % 7][1])
        rows.append((i, (base + rng.normal(size=16) * 0.05).tolist(), rows[i % 7][2]))
    rows += [(500 + i, rows[0][1], 0) for i in range(5)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, rows[0][1], None)]
    rows += [(605, [None] * 16, 0), (606, [float("inf")] * 16, 0), (607, [1.0, 2.0], 0), (608, [2.0, 4.0], 0), (500, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr(
        "*", "1 AS copies", "2 AS list", "3 AS vector"
    )
    links = brute.links(rows, 0.98)
    degree = Counter(i for p in links for i in p)
    comp = brute.components(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        least[comp[i]] = min(r[0], least.get(comp[i], r[0]))
    want = Counter((r[0], degree[i], least[comp[i]], r[0] == least[comp[i]]) for i, r in enumerate(rows))
    small = dict(HOME=8, VISITORS=16)
    for lists in (None, 9):
        got = embedding_dedup.link_embeddings(df, 0.98, lists)
        assert pairs(got, "vec_id", "n_links", "component_id", "kept") == want
    for k, v in small.items():
        setattr(embedding_dedup, k, v)
    try:
        assert pairs(embedding_dedup.link_embeddings(df, 0.98, 2), "vec_id", "n_links", "component_id", "kept") == want
    finally:
        embedding_dedup.HOME, embedding_dedup.VISITORS = 1024, 8192
    lone = embedding_dedup.link_embeddings(spark.createDataFrame([(None, [1.0], 1)], df.schema[:3]), 0.98).first()
    assert lone["n_links"] == 0 and lone["kept"]


def test_empty_tables(spark, make_docs, tmp_path):
    none = make_docs([(1, "x")]).where("doc_id > 1")
    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0
    assert language_id.drop_foreign(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert byte_bpe.encode_texts(none, BPE, P.PATTERN, F.col("doc_id")).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert fingerprints.fingerprint_with_edit(none).count() == 0
    assert passage_dedup.passage_report(none).count() == 0
    path = scratch_path(spark, "t")
    token_files.write_token_files(none, path, P.path("word_bpe_49k.json"), 2)
    assert token_files.read_token_files(spark, path).count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(chats).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.link_embeddings(vectors).count() == 0


def test_pipeline_odd_rows(odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(docs.sparkSession, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before, name
    assert docs.count() > 0


def test_drop_foreign_by_size(make_docs):
    """Short and long texts of an unlearned script go; clean texts of the same sizes stay."""
    import random

    rng = random.Random(9)
    words = {
        "en": "the of and to in that was with for his they this have from which there were their been would about".split(),
        "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    }
    rows = [(i, " ".join(rng.choices(words[la], k=rng.choice([8, 30, 200]))), la) for i, la in enumerate(["en", "de"] * 150)]
    script = [chr(c) for c in range(0x0531, 0x0557)] + [chr(c) for c in range(0x10D0, 0x10F1)]
    foreign = [(1000 + k, " ".join("".join(rng.choices(script, k=6)) for _ in range(n)), None) for k, n in enumerate([8, 8, 30, 200, 2000])]
    none = [(2000, "", "en"), (2001, None, "de"), (2002, "123 ...", None)]
    ids = Counter(r["doc_id"] for r in language_id.drop_foreign(make_docs(rows + foreign + none)).collect())
    assert not [i for i in ids if i >= 2000]
    assert not {1002, 1003, 1004} & set(ids)
    clean = sum(1 for i in ids if i < 1000)
    assert clean == len(rows) and set(ids.values()) == {1}
