"""Every registered query against a brute-force version or DuckDB, on whole small tables."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import brute
from vigil.llm.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def documents(columns="doc_id, text, lang, source"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    got = rows(spark, name)
    assert sorted(got[0]) == sorted(names)
    assert sorted([tuple(tidy(r[n]) for n in names) for r in got], key=repr) == sorted(
        [tuple(map(tidy, r)) for r in want.fetchall()], key=repr
    )


def test_op1_near_targets(spark):
    got = rows(spark, "op1_mix_sources")
    docs = {d: (len(brute.WORD.findall(t or "")), s) for d, t, _, s in documents()}
    sizes = defaultdict(int)
    for n, s in docs.values():
        sizes[s] += n
    want = brute.targets(dict(sizes))
    taken, longest = Counter(), Counter()
    for r in got:
        size, source = docs[r["doc_id"]]
        assert r["size"] == size and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source], rel=1e-12)
        assert r["taken"] in [k * size for k in range(4)]
        taken[source] += r["taken"]
        longest[source] = max(longest[source], size)
    assert len(got) == len(docs)
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)


def test_op2_held_out_accuracy(spark):
    lang = {d: la for d, _, la, _ in documents()}
    got = rows(spark, "op2_language_id")
    assert {r["doc_id"] for r in got} == set(lang)
    for r in got:
        assert r["held_out"] == (brute.crc(str(r["doc_id"])) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op3_brute_force(spark):
    vectors = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    links = brute.links(vectors, 0.98)
    degree = Counter(i for pair in links for i in pair)
    comp = brute.components(range(len(vectors)), links)
    want = {(v[0], degree[i], vectors[comp[i]][0], comp[i] == i) for i, v in enumerate(vectors)}
    got = rows(spark, "op3_embedding_dedup")
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == want


def test_op4_brute_force(spark):
    docs = sorted(documents())
    fps = [brute.fingerprint(t) for _, t, *_ in docs]
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)) <= 2
    comp = brute.components(range(len(docs)), np.argwhere(near).tolist())
    want = {(d[0], f"{fps[i]:016x}", docs[comp[i]][0]) for i, d in enumerate(docs)}
    got = rows(spark, "op4_simhash")
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == want


def test_op5_tiktoken(spark):
    import base64

    ranks = {
        base64.b64decode(a): int(b)
        for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))
    }
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for d, t, *_ in documents():
        ids = enc.encode_ordinary(t or "")
        want.add((d, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())))
    got = rows(spark, "op5_byte_bpe")
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_op7_brute_force(spark):
    docs = sorted(documents(), reverse=True)
    got = {r["doc_id"]: r for r in rows(spark, "op7_fingerprints")}
    assert len(got) == len(docs)
    by_text = {}
    for i, (d, t, *_) in enumerate(docs):
        t, after = t or "", docs[(i + 1) % len(docs)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        r = got[d]
        assert r["n_chars"] == n
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1
        if t and t != edited:
            assert 0.3 <= r["near_edited"] < 1
    assert len(set(by_text.values())) == len(by_text)


def test_op8_brute_force(spark):
    docs = documents()
    want = {(d[0], *r) for d, r in zip(docs, brute.repeats([d[1] for d in docs]))}
    got = rows(spark, "op8_suffix_dedup")
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_op9_brute_force(spark):
    chats = defaultdict(list)
    for c, _, role, text in sorted(
        duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    ):
        chats[c].append((role, text or ""))
    chats[-1] = [(r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for c, turns in chats.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want.add((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    got = rows(spark, "op9_chat_format")
    assert {(r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want


def test_op10_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, start = set(), 0
    for d, t, *_ in sorted(documents()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.add((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = rows(spark, "op10_token_files")
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
