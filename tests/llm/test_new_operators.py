"""Word runs, Merkle manifest and token shards against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import sha, word_runs as plain_runs, words
from test_llm_operators import as_rows, odd_rows, table  # noqa: F401

from plumbline.llm import lm_trie, merkle, token_shards, tokens, word_runs
from plumbline.runtime import scratch_dir


def run_report(doc_id, ws):
    found = plain_runs(ws)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


KEYS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic(seed, n):
    rng, out = random.Random(seed), []
    for k in range(n):
        ws = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.choice("abc" if k % 2 else "abcdefghij") for _ in range(rng.randint(1, 7))]
            ws += (unit * 12)[:rng.randint(1, len(unit) * rng.randint(2, 11))]
        out.append(" ".join(ws))
    return out


def overwritten(doc_id, ws):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not ws:
        return ws
    a = h // 10 % len(ws)
    p = 1 + (len(ws) - a) // (3 + h // 10 % 8)
    return [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]


def test_word_runs(spark, odd_rows):  # noqa: F811
    rows = [r for r in odd_rows if r[0] != 43] + list(enumerate(periodic(1, 150), 1000))
    rows += [(2000 + k, " ".join(random.Random(k).choice("ab") for _ in range(120))) for k in range(20)] + [(3000, "x " * 700), (3001, "x y " * 3 + "x"), (3002, "x y " * 4), (3003, "x " * 5)]
    got = word_runs.find(table(spark, rows)).collect()
    assert as_rows(got, KEYS) == sorted((run_report(i, words(t)) for i, t in rows), key=repr)
    got = word_runs.report(table(spark, rows)).collect()
    assert as_rows(got, KEYS) == sorted((run_report(i, overwritten(i, words(t))) for i, t in rows), key=repr)


def test_runs_of_a_very_long_text(spark, odd_rows):  # noqa: F811
    rows = [(43, dict(odd_rows)[43][:12_000]), (44, "a b c " * 60_000), (45, "tick " * 100_000)]
    got = {r.doc_id: r for r in word_runs.find(table(spark, rows)).collect()}
    assert (got[44].n_runs, got[44].start, got[44].length, got[44].period, got[44].exponent_milli) == (1, 0, 180_000, 3, 60_000_000)
    assert (got[45].n_runs, got[45].length, got[45].period) == (1, 100_000, 1) and got[45].collapsed_sha256 == sha("tick")
    assert as_rows([got[43]], KEYS) == [run_report(43, words(rows[0][1]))]


def test_new_operators_of_empty_tables(spark):
    empty = table(spark, [], 1)
    assert word_runs.report(empty).collect() == [] and merkle.manifest(empty).collect() == [] and token_shards.report(empty).collect() == []


def plain_tree(hashes, fanout):
    """Root, and per leaf its siblings (before, after) level by level."""
    level, home, sides = list(hashes), list(range(len(hashes))), [[] for _ in hashes]
    while len(level) > 1:
        for leaf, at in enumerate(home):
            run = at // fanout * fanout
            sides[leaf].append(("".join(level[run:at]), "".join(level[at + 1:run + fanout])))
            home[leaf] = at // fanout
        level = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], sides


def plain_manifest(rows, fanout):
    def leaf(r, more=0):
        values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    held = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        held[lang] = plain_tree([leaf(r) for r in groups[lang]], fanout)
    root, above = plain_tree([held[v][0] for v in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        subroot, sides = held[lang]
        for r, own in zip(groups[lang], sides):
            path = own + above[k]
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf(r, 1 if struck else 0)
            for before, after in path:
                now = sha(before + now + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in path)), now, now == root))
    return out


@pytest.mark.parametrize("fanout", [2, 3])
def test_merkle_manifest(spark, fanout):
    rng = random.Random(fanout)
    rows = [(k, f"text é {k}" if k % 9 else None, rng.choice(["en", "en", "en", "de", None, "é"]), "s" if k % 4 else None, k if k % 5 else None) for k in range(-40, 110)]
    rows += [(None, "x", "en", None, 1), (None, "y", "en", None, None), (7, "again", "en", "s", 5), (7, "again", "en", "s", 5), (500, "", "alone", "", 0), (501, "", "", "", 0)]
    full = [dict(doc_id=a, text=b, lang=c, source=d, n_chars=e, h="x", pos=1, n=2, path="y") for a, b, c, d, e in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h string, pos int, n int, path string").repartition(5)
    got = merkle.manifest(docs, fanout).collect()
    assert as_rows(got, ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) == sorted(plain_manifest(rows, fanout), key=repr)
    assert {r.verified for r in got} == {True, False}


def test_one_leaf_is_its_own_root(spark):
    got = merkle.manifest(table(spark, [(1, "one", "s")], 1)).collect()
    assert len(got) == 1 and got[0].leaf == got[0].subroot == got[0].root and got[0].proof_sha256 == sha("")


def byte_encoder():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("remembered", [1000, 5])
def test_byte_level_encoder_equals_whole_texts(odd_rows, remembered):  # noqa: F811
    import public_tokenizers as public

    rng = random.Random(remembered)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "½", "'s", "'", "!", "\xa0", "\x85", "’", "€", "ß", "_", "<|endoftext|>", "中", "\x1c", "…"]
    texts = [t or "" for _, t in odd_rows] + ["".join(rng.choice(alphabet[:18] if k % 4 else alphabet) for _ in range(60)) for k in range(300)]
    coder, plain = tokens.ByteLevelEncoder(public.path("byte_bpe_50k.json"), remembered), byte_encoder()
    for _ in range(2):
        assert [c.tolist() for c in coder.encode_many([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    words_coder = tokens.WordEncoder(public.path("word_bpe_49k.json"), remembered)
    whole = words_coder.tokenizer
    assert [c.tolist() for c in words_coder.encode_many([t.encode() for t in texts])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("size", [token_shards.SHARD, 500])
def test_token_shards(spark, odd_rows, size):  # noqa: F811
    import public_tokenizers as public

    rows = [*odd_rows, *((7, f"many of one key {k}") for k in range(300)), (-5, "before"), (-5, "before"), (1 << 62, "large")]
    plain = byte_encoder()
    coded = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    shards = token_shards.write(table(spark, rows), scratch_dir(spark, "shards"), public.path("byte_bpe_50k.json"), size)
    got = token_shards.read_back(shards).collect()
    assert as_rows(got, ("doc_id", "n_tokens", "ids_crc32")) == sorted(((i, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in coded), key=repr)
    got.sort(key=lambda r: r.start)
    ends = np.cumsum([r.n_tokens for r in got]).tolist()
    assert [r.start for r in got] == [0, *ends[:-1]]
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is None, i or 0))
    asked = [40, 7, -5, 1 << 62, 43, 6000, -6, None, 41, 41]
    wanted = spark.createDataFrame([(i,) for i in asked], "doc_id long")
    found = token_shards.lookup(shards, wanted).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == sorted((i, c) for i, c in coded if i is not None and i in asked)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 700, 20_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        image = token_shards.Shard.image(keys, np.ones(len(keys), np.int64), np.arange(len(keys)))
        held = token_shards.Shard(image)
        slots = token_shards._slots(keys, held.sizes, held.bits, held.ranks)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        first, count = held.find(keys)
        assert (first == np.arange(len(keys))).all() and (count == 1).all()
        assert held.find(np.setdiff1d(rng.integers(-(1 << 62), 1 << 62, 3000), keys))[1].sum() == 0
    with pytest.raises(ValueError):
        token_shards.Shard(hashlib.sha256().digest() * 4)


def test_language_model_looks_a_part_up_at_once(monkeypatch):
    """However many packets a part comes in, its tokens meet the trie in groups of about WAITING; the sums are those of packets scored one by one."""
    texts = pa.table({"did": list(range(400)), "text": [" ".join(random.Random(k).choices("abcdefghij", k=30)) for k in range(400)]}).to_batches()[0]
    totals = lm_trie.Totals(tokens=12_000, kinds=11, ends=400)
    monkeypatch.setattr(lm_trie, "TEXTS", 1000)
    packets = list(lm_trie._pairs(1, totals)(iter([texts])))
    calls, scores = [], lm_trie.Trie.scores

    def seen(self, context, at, known, owner, word):
        calls.append(len(owner))
        return scores(self, context, at, known, owner, word)

    monkeypatch.setattr(lm_trie.Trie, "scores", seen)
    found = {}
    for waiting in (1 << 20, 2000, 1):
        monkeypatch.setattr(lm_trie, "WAITING", waiting)
        calls.clear()
        rows = [r for b in lm_trie._score(1, totals)(iter(packets)) for r in b.to_pylist()]
        sums = [(lm_trie._risen(r["did"], np.int64).tolist(), lm_trie._sums_of(r["sums"]).tolist()) for r in rows if r["kind"] == 1]
        alone = sorted(x for r in rows if r["kind"] == 2 for x in zip(lm_trie._risen(r["did"], np.int64).tolist(), lm_trie.unplanes(r["word"] + bytes(3 * (len(r["word"]) // 5)), np.uint64).tolist()))
        found[waiting] = len(calls), sums, alone
    assert len(packets) > 20
    assert found[1 << 20][0] == 1 and 1 < found[2000][0] < len(packets) and found[1][0] == len(packets)
    assert found[1 << 20][1:] == found[2000][1:] == found[1][1:]
    assert sum(s[3] for s in found[1][1][0][1]) == 400 * 31


def test_next_words_are_united_as_they_double(monkeypatch):
    """Packets of next words wait until they are as many as those united before, so that they are not sorted anew for each packet."""
    rng = np.random.default_rng(3)
    packets = [np.unique(rng.integers(0, 1 << 42, 200).astype(np.uint64)) for _ in range(300)]
    batches = [lm_trie.record_batch([[0, lm_trie._rising(p)]], lm_trie._NEXT) for p in packets]
    sorted_, union = [], lm_trie._union
    monkeypatch.setattr(lm_trie, "_union", lambda parts: sorted_.append(sum(map(len, parts))) or union(parts))
    monkeypatch.setattr(lm_trie, "WAITING", 500)
    rows = [r for b in lm_trie._count_next(iter(batches)) for r in b.to_pylist()]
    every = np.unique(np.concatenate(packets))
    assert {r["place"]: r["kinds"] for r in rows} == dict(zip(*(x.tolist() for x in np.unique(every >> np.uint64(40), return_counts=True))))
    assert 1 < len(sorted_) and sum(sorted_) < 4 * sum(map(len, packets))
