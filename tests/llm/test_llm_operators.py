"""Training-data operators against plain versions: planted repeats, nulls, ties, repeated rows, empty tables, clashing columns."""

import random
import zlib

import numpy as np
import pytest
from brute import byte_repeats, contaminated, fingerprint, language_model, lower, near_groups, sha, style_tree, without_boilerplate, word_repeats, words
from compare import difference, duck
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bytes as raw
from plumbline.llm import (components, decontamination, elias_fano, html_tree, line_dedup, lm_trie, near_copies, packing, quality_rules, simhash, substring_dedup, suffix_repeats,
                           token_counts, tokens)
from plumbline.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, drop string, fp int, did string, bucket double, label string, at string, word string"
ROW = dict.fromkeys(("row", "h", "drop", "fp", "did", "bucket", "label", "at", "word"))


def table(spark, rows, parts=3):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names the operators use inside."""
    full = [{"doc_id": r[0], "text": r[1], "lang": None, "source": r[2] if len(r) > 2 else None, "n_chars": None if r[1] is None else len(r[1]), **ROW, "row": "x"} for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def planted(seed, n=60, alphabet="abcd é", joiner=""):
    rng = random.Random(seed)
    base = [joiner.join(rng.choice(alphabet) for _ in range(400)) for _ in range(4)]
    texts = []
    for _ in range(n):
        cuts = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 250)
            cuts.append(rng.choice(base)[a:a + rng.randint(20, 250)] + rng.choice(["", "x", " yy ", "\n"]))
        texts.append("".join(cuts))
    return texts


@pytest.fixture(scope="module")
def odd_rows():
    """Null and empty texts, a null id, repeated rows, ties, a very long text, blanks and marks of many kinds."""
    texts = planted(1, 30)
    rows = list(enumerate(texts))
    vocabulary = ["alpha", "beta", "gamma", "de", "the", "of"]
    rng = random.Random(2)
    long_text = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    rows += [(40, None), (41, ""), (42, " \t\n\x0b\x0c\r "), (43, long_text), (44, long_text[50_000:51_000]), (45, "A" * 3000), (46, "ab" * 700), (None, texts[3]), (None, None),
             (47, texts[3]), (48, "İ ﬁ ½ ́x   　 z   \x1c q \0 end"), (49, "Don't 'S it's <|endoftext|> 12 34"), (5, texts[5]), (50, "one two three"), (51, "one two three")]
    return rows


EMPTY = [(n, f) for n, f in (
    ("op2", lambda d: suffix_repeats.dedup(d)), ("op4", lambda d: line_dedup.report(d)), ("op5", lambda d: simhash.report(d)), ("op6", lambda d: lm_trie.score(d)),
    ("op7", lambda d: quality_rules.report(d)), ("op8", lambda d: packing.pack_documents(d)), ("op9", lambda d: substring_dedup.dedup(d)), ("op10", lambda d: token_counts.report(d)))]


@pytest.mark.parametrize("name,operator", EMPTY)
def test_empty_table(spark, name, operator):
    assert operator(table(spark, [], 1)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), duck(SMALL), ORACLES[name]) is None


def as_rows(found, keys):
    return sorted((tuple(r[k] for k in keys) for r in found), key=repr)


@pytest.mark.parametrize("slab", [2 << 20, 1500])
def test_byte_repeats(spark, odd_rows, slab, monkeypatch):
    monkeypatch.setattr(suffix_repeats, "SLAB", slab)
    rows = [r for r in odd_rows if r[0] != 43]
    got = as_rows(suffix_repeats.dedup(table(spark, rows)).collect(), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == sorted(((i, *b) for (i, _), b in zip(rows, byte_repeats(rows))), key=repr)


def test_byte_repeat_spans_rebuild_the_text(spark, odd_rows):
    rows = odd_rows[:30]
    for r in suffix_repeats.dedup(table(spark, rows), with_spans=True).collect():
        text, kept, at = (rows[r.doc_id][1] or "").encode(), b"", 0
        for s in r.spans:
            kept, at = kept + text[at:s.first], s.end
        assert sha(kept + text[at:]) == r.kept_sha256


def test_intervals_are_the_common_prefix_tree():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randint(2, 9)
        shared, extra = [rng.randint(0, 4) for _ in range(n - 1)], [rng.randint(0, 5) for _ in range(n - 1)]
        want = set()
        for a in range(n):
            for b in range(a + 1, n):
                outside = max(shared[a - 1] if a else 0, shared[b] if b < n - 1 else 0)
                if min(shared[a:b]) > outside:
                    want.add((a, b, min(shared[a:b]), outside, min(extra[a:b])))
        assert set(suffix_repeats.intervals(shared, extra)) == want


@pytest.mark.parametrize("slab", [2 << 20, 1500])
def test_word_repeats(spark, odd_rows, slab, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLAB", slab)
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(80)) for _ in range(4)]
    rows = [*odd_rows, *((100 + k, " ".join(rng.choice(base)[(a := 2 * rng.randint(0, 60)):a + 2 * rng.randint(5, 60)] for _ in range(3))) for k in range(40))]
    got = as_rows(substring_dedup.dedup(table(spark, rows)).collect(), ("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == sorted(((i, *b) for (i, _), b in zip(rows, word_repeats(rows))), key=repr)


ITEMS = [(7, "alpha beta gamma de the of alpha beta gamma de the of"), (8, "One TWO three"), (9, None), (10, ""), (None, "q end"), (11, "İ"), (12, "the of the of the of the of the of")]


@pytest.mark.parametrize("block", [16 << 20, 10])
def test_decontamination(spark, odd_rows, block):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.find(table(spark, odd_rows), benchmark, block).collect()
    want = contaminated(odd_rows, ITEMS)
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_words, sum(s.last - s.first for s in r.spans), list(r.items)) for r in got), key=key) == sorted(
        ((i, n, sum(hit), items) for (i, _), (n, hit, items) in zip(odd_rows, want)), key=key)


def test_decontamination_without_items(spark, odd_rows):
    report = decontamination.report(table(spark, odd_rows), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(report) == len(odd_rows) and not any(r.contaminated for r in report)
    assert {r.items_sha256 for r in report} == {sha("")}


def test_decontaminated_texts(spark, odd_rows):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = table(spark, odd_rows)
    clean = decontamination.clean(docs, benchmark)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[50] == "" and texts[40] is None and texts[0] == odd_rows[0][1] and len(texts) == len({i for i, _ in odd_rows})
    assert not any(any(hit) for _, hit, _ in contaminated([(1, t) for t in texts.values()], ITEMS))


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(0)
    for sigma in (1, 2, 5):
        text = np.append(rng.integers(0, sigma + 1, 300), 0)
        index = decontamination.FMIndex(text)
        for size in (1, 2, 4):
            patterns = rng.integers(1, sigma + 1, (20, size))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(len(text) - size + 1) if (text[i:i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_line_dedup(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lines = [rng.choice(["All rights reserved.", "menu", f"own {i}", f"own {i}", "", "  "]) for _ in range(rng.randint(0, 6))]
        rows.append((i if i != 9 else None, "\n".join(lines) if i % 11 else None, rng.choice(["a", "b", None])))
    rows += [(70, "menu", "tiny"), (70, "menu", "tiny"), (71, "", "tiny")]
    docs = table(spark, rows)
    got = line_dedup.clean(docs)
    assert got.columns == docs.columns
    want = without_boilerplate([(i, s, t) for i, t, s in rows])
    assert sorted(((r.doc_id, r.source, r.text, r.n_chars) for r in got.collect()), key=repr) == sorted(((i, s, t, None if t is None else len(t)) for (i, _, s), t in zip(rows, want)), key=repr)


def test_copies_of_a_document_are_no_boilerplate(spark):
    rows = [(i, "first line\nsecond line\nthird line" if i < 6 else f"own {i}\nAll rights reserved.", "a") for i in range(60)]
    rows += [(100 + i, None if i % 2 else "one\ntwo", None) for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.clean(table(spark, rows), copies_once=True).collect()}
    assert got == {i: t and t.replace("\nAll rights reserved.", "") for i, t, _ in rows}
    kept = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, table(spark, rows), SMALL).collect()}
    assert kept == got
    counted = {r.doc_id: r.text for r in line_dedup.clean(table(spark, rows)).collect()}
    assert counted == {i: None if t is None else "" if t[:3] in ("fir", "one") else got[i] for i, t, _ in rows}


def test_simhash(spark, odd_rows):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    rows = [*odd_rows, *((200 + k, " ".join(w if rng.random() > 0.01 else "zz" for w in base)) for k in range(40))]
    got = simhash.report(table(spark, rows)).collect()
    fps = [fingerprint(t) for _, t in rows]
    group = near_groups(fps)
    ids = [min((i for (i, _), g in zip(rows, group) if g == own and i is not None), default=None) for own in group]
    assert as_rows(got, ("doc_id", "fingerprint", "component_id")) == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, ids)), key=repr)
    docs = table(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    stay = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert stay == sorted({c for c in ids if c is not None})


def test_gray_index_with_parted_nodes(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps)[:6]:
        for _ in range(60):
            f ^= 1 << rng.randint(0, 63)
            fps.add(f)
    fps = sorted(fps)
    leaves = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    labels = {r.node: r.label for r in components.components(simhash.links(leaves, node=20)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [labels.get(f, f) for f in signed]
    want = near_groups(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(400)) and got[1001] == got[1000] == 1000
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_language_model(spark, odd_rows):
    rows = [r for k, r in enumerate(odd_rows) if r[0] is not None and r[0] not in {i for i, _ in odd_rows[:k]}] + [(None, "null id")]
    rows += [(300 + k, t) for k, t in enumerate(planted(9, 40, ["alpha ", "beta ", "gamma ", "x "]))]
    want = language_model(rows)
    got = lm_trie.score(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total), r
        assert abs(r.base_score - base) <= 1e-6 * max(1, abs(base)) and abs(r.score - score) <= 0.07 * n, (r, score)


def test_language_model_does_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(k, " ".join("often one" if rng.random() < 0.7 else rng.choice("abcdefgh") for _ in range(60))) for k in range(60)]
    rows += [(k, "often a often b often c often one often new") for k in range(60, 120)]
    rows = [r for r in rows if r[0] < 60 or zlib.crc32(str(r[0]).encode()) % 10 == 0]
    want, got, before = language_model(rows), {}, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(lm_trie, "PER_TASK", 500)  # two buckets are cut further, fifty are not
    try:
        for parts in (2, 50):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got[parts] = {r.doc_id: (r.base_score, r.score) for r in lm_trie.score(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {i for i, _ in rows if i >= 60} and {i: s for i, (_, s) in got[2].items()} == {i: s for i, (_, s) in got[50].items()}
    assert all(abs(s - want[i][5]) <= 0.07 * want[i][1] for i, (_, s) in got[50].items())


def test_frequent_contexts_have_few_parts(spark):
    """A context is cut by the shard's share of the tokens, so all parts together are at most one per quarter share and context."""
    docs = table(spark, [(k, "often " * 200 + f"word{k}") for k in range(60)])
    rows, buckets = docs.select(F.col("doc_id").alias("did"), "text"), 4
    words = rows.mapInArrow(lm_trie._count_words(buckets), lm_trie._WORDS_SQL).repartitionById(buckets, "bucket").mapInArrow(lm_trie._merge_words, lm_trie._WORDS_SQL)
    totals = lm_trie._with_followers(rows, lm_trie._totals(words, buckets), buckets)
    assert totals.limit == totals.tokens // (4 * buckets) and len(totals.often) == 1 and isinstance(totals.followers, dict)
    assert 1 < len(totals.parts()[0]) <= 4 * buckets + len(totals.often)


def test_language_model_of_repeated_rows(spark):
    rows = [(1, "a b c a b"), (2, "a b d"), (2, "a b d"), (3, "b c")]
    got = sorted((r.doc_id, r.n_tokens) for r in lm_trie.score(table(spark, rows)).collect())
    assert got == [(1, 6), (2, 4), (2, 4), (3, 3)]


def test_language_model_of_texts_that_share_an_id(spark):
    """The rows get what they would get under ids of their own on the same side of the hold-out."""
    texts = ["a b d", "c c", "a b a b", "c c", "x y z", "", None, "a b"]
    mine = [(i, t) for i, t in zip([2, 2, 2, 2, None, None, None, 3], texts)] + [(1, "a b c a b")]
    side = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    free = {s: [k for k in range(100, 1000) if side(k) == s] for s in (True, False)}
    apart = [(free[side(i)].pop(), t) for i, t in mine]
    found, want = lm_trie.score(table(spark, mine)).collect(), lm_trie.score(table(spark, apart)).collect()
    facts = lambda rows: sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in rows)
    assert facts(found) == facts(want)
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=repr) == sorted(((i, len((t or "").split()) + 1) for i, t in mine), key=repr)


def test_language_model_beats_words_alone_on_held_out(spark):
    got = [r for r in lm_trie.score(spark.read.parquet(f"{SMALL}/documents.parquet")).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in [(0, 10), (1, 0), (5, 3), (1000, 1 << 40), (3000, 5000), (2000, (1 << 64) - 1)]:
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        held = elias_fano.EliasFano(values, top)
        assert (held.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 200, dtype=np.uint64, endpoint=True)])
        at, equal = held.successor(asked, np.zeros(len(asked), np.int64), np.full(len(asked), n))
        assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def plain_signals(text):
    ws, lines = words(text), (text or "").split("\n")
    own = [x for x in lines if words(x)]
    windows = {}
    for i in range(len(ws) - 7):
        windows.setdefault(tuple(ws[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered)


def test_quality_rules(spark, odd_rows):
    rows = [*odd_rows, (60, "the of and to a in is it " * 9), (61, "x\nx\n \n\nx y\n"), (62, "the ### of $$ and\n" * 12)]
    got = quality_rules.report(table(spark, rows)).collect()
    assert as_rows(got, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == sorted(((i, *plain_signals(t)) for i, t in rows), key=repr)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    docs = table(spark, rows)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def encoder():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


def test_packing(spark, odd_rows):
    rows = [*odd_rows, *((400 + k, "the of " * n) for k, n in enumerate(range(10, 4000, 90)))]
    got = packing.pack_documents(table(spark, rows)).collect()
    plain, want = encoder(), []
    for i, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert as_rows(got, ("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_many_chunks_pack_as_well(spark):
    rng = random.Random(8)
    sizes = [rng.randint(1, 4095) for _ in range(700)]
    pieces = spark.createDataFrame([(k, 0, 0, s, 0) for k, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, chunk=25).collect()
    assert sorted(r.doc_id for r in got) == list(range(700)) and len({r.sequence_id for r in got}) <= 1.08 * sum(sizes) / 4096


def test_evolution_keeps_every_item_once():
    rng = random.Random(9)
    sizes = [rng.choice([1365, 1366, 2048, 2047, 700, 3000]) for _ in range(120)]
    one = packing.evolve(sizes, 1, [])
    two = packing.evolve(sizes, 2, [one.bins, one.bins])
    for p in (one, two):
        assert sorted(i for b in p.bins for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 4096 for b in p.bins)
    assert len(two.bins) <= len(one.bins)


@pytest.mark.parametrize("remembered", [400_000, 5])
def test_word_encoder_equals_whole_texts(odd_rows, remembered):
    import public_tokenizers as public

    coder, plain = tokens.WordEncoder(public.path("word_bpe_49k.json"), remembered), encoder()
    texts = [t or "" for _, t in odd_rows]
    for _ in range(2):
        assert [c.tolist() for c in coder.encode_many([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts(spark, odd_rows):
    import public_tokenizers as public

    coder = tokens.ByteEncoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rows = [(*r, "src é") for r in odd_rows]
    got = token_counts.report(table(spark, rows)).collect()
    want = []
    for i, text, source in rows:
        whole = " ".join((source, "", text or ""))
        ids = coder.encode(whole.encode()).tolist()
        parts = [("source", 0, source + " "), ("lang", 0, " ")] + [("text", k, x) for k, x in enumerate((text or "").split("\n"))]
        lines = [(f, k, x + "\n" if f == "text" and k < (text or "").count("\n") else x) for f, k, x in parts]
        if text and text.endswith("\n"):
            lines.pop()
        home = [j for j, (_, _, x) in enumerate(lines) for _ in x]
        count, at = [0] * len(lines), 0
        bytes_before = np.cumsum([0] + [len(c.encode()) for c in whole])
        for token in ids:
            a, b = at, at + int(coder.n_bytes[token])
            at = b
            chars = range(int(np.searchsorted(bytes_before, a, "right")) - 1, max(int(np.searchsorted(bytes_before, a, "right")), int(np.searchsorted(bytes_before, b, "right")) - 1))
            held = [home[c] for c in chars]
            count[max(sorted(set(held)), key=held.count)] += 1
        want += [(i, f, k, n) for (f, k, _), n in zip(lines, count)]
    assert as_rows(got, ("doc_id", "field", "line", "n_tokens")) == sorted(want, key=repr)


PAGE = """<html><body class="no-sidebar"><header><a href=/>Home</a><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><main>
<article class="post"><header><h1>Title &amp; more</h1><p>By X</p></header><p>One<br>two &nbsp; three<ul><li>a <b>b</b><li>c</ul><pre>x
 y</pre><table><tr><td>1<td>2<tr><td>3</table><div class="share-buttons">Share</div><form>f<input name=q></form><p hidden>no</p></article>
<section class="comments"><article class="comment">c1</article></section></main><aside>side</aside><footer>foot</footer><script>var a="<p>x</p>"</script></body>"""


def test_pages():
    low = frozenset()
    assert html_tree.blocks(html_tree.parse(PAGE), low) == ["Title & more", "One two three", "a b", "c", "x y", "1", "2", "3"]
    for page, want in (("", []), ("<", ["<"]), ("<p", []), ("plain &lt;b&gt;", ["plain <b>"]), ("<!-- open", []), ("<script>x", []), ("</p></div>a<p>b", ["a", "b"]),
                       ("<div><ul><li><a href=1>x</a><li><a>y</a></ul>text</div>", ["text"])):
        assert html_tree.blocks(html_tree.parse(page), low) == want
    assert html_tree.blocks(html_tree.parse("<div>" * 3000 + "x" + '<a "' * 3000), low)[0].startswith("x")


def test_style_tree_takes_out_what_a_site_repeats(spark):
    rng = random.Random(0)
    pages = [(i, f"https://site.example/{i}", f"<body><div class='top'>Welcome to the site</div><div class='text'><p>{' '.join(rng.choice('abcdefgh') * 3 for _ in range(30))}</p></div><div class='end'>Bye</div>", 1) for i in range(12)]
    pages += [(50, None, None, 1), (51, "odd", "", 1), (52, "https://other.example/", "<div class='top'>Welcome to the site</div>", 1), (0, *pages[0][1:])]
    got = html_tree.extract(spark.createDataFrame(pages, "page_id int, url string, html string, low int").repartition(2))
    rows = got.collect()
    assert len(rows) == len(pages) and dict(got.dtypes)["page_id"] == "int"
    for r in rows:
        if r.page_id < 12:
            assert r.text.count(" ") == 29 and "Welcome" not in r.text and "Bye" not in r.text
        else:
            assert r.text == ("Welcome to the site" if r.page_id == 52 else "")
        assert r.n_chars == len(r.text)
    assert html_tree.extract(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []


@pytest.mark.parametrize("page,want", [
    ("<div class='site has-sidebar'><article><p>a</p></article><div class='sidebar'>b</div></div>", ["a"]),
    ("<form><article><p>a</p></article></form>", ["a"]),
    ("<form><main><p>a</p></main></form>", ["a"]),
    ("<main><div class='has-sidebar'><article>a</article></div></main>", ["a"]),
    ("<main><article>a</article><div class='related-posts'><article>b</article></div></main>", ["a"]),
    ("<div class='has-sidebar'><article>a</article><aside><article>b</article></aside></div>", ["a"]),
    ("<form><div class='text'><p>a long text</p></div></form>", ["a long text"]),
    ("<div>a long text</div><form>find</form><div class='share-buttons'>share</div>", ["a long text"]),
    ("<article><p>a long text</p><div class='comment-list'>an even longer thread of comments</div></article>", ["a long text"]),
])
def test_what_holds_the_article_stays(page, want):
    assert html_tree.blocks(html_tree.parse(f"<body>{page}</body>"), frozenset()) == want


def test_an_article_crawled_often_keeps_its_text(spark):
    rng = random.Random(1)
    articles = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) for _ in range(6)]
    pages = [(i, "https://often.example/x", f"<body><div class='top'>Welcome</div><article><h2>Summary</h2><p>{articles[i % 6]}</p></article></body>") for i in range(30)]
    pages += [(100 + i, "https://alike.example/x", "<body><div class='text'><p>The same page each time</p></div></body>") for i in range(30)]
    pages += [(200 + i, "https://plain.example/x", f"<body><div class='top'>Welcome</div><div class='text'><p>{articles[i % 6]}</p></div></body>") for i in range(30)]
    for r in html_tree.extract(spark.createDataFrame(pages, "page_id int, url string, html string").repartition(3)).collect():
        if 100 <= r.page_id < 200:
            assert r.text == "The same page each time"
        else:
            assert r.text == ("Summary\n\n" if r.page_id < 100 else "") + articles[r.page_id % 100 % 6]


def test_hashes_do_not_depend_on_the_place():
    text = "one two three one two three".encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, rows = raw.word_spans(data, np.array([0, 3, 3, len(data)]))
    assert rows.tolist() == [0, 1, 1, 6] and [text[a:b].decode() for a, b in zip(starts, ends)] == "one two three one two three".split()
    found = raw.span_hashes(data, starts, ends)
    assert (found[:3] == found[3:]).all() and len(set(found.tolist())) == 3
    windows = raw.window_hashes(found, 3)
    assert windows[0] == windows[3] and len(set(windows.tolist())) == 3
    assert len(raw.rolling_hashes(data, 100)) == 0
    assert lower("ÀAZ") == "Àaz"


LONG = "One long sentence of the story. Another long sentence of the story. A third one follows here."


@pytest.mark.parametrize("page,want", [
    (f"<div class=content><p>{LONG}</p></div><div class='comment-list'>{LONG * 3}</div>", [LONG]),
    (f"<div class=content><p>{LONG}</p></div><div class='cookie-bar'>{LONG * 3}</div>", [LONG]),
    (f"<div class=content><p>{LONG}</p></div><div class='left-sidebar'>{LONG * 3}</div>", [LONG]),
    (f"<div class=content>{LONG}</div><div class='comment-list'>{LONG * 3}</div>", [LONG]),
    (f"<div class='no-comments with-menu'><p>{LONG}</p></div>", [LONG]),
    (f"<div class='content-sidebar-wrap'><p>{LONG}</p></div>", [LONG]),
    (f"<div class='text'>{LONG * 2}</div><article class=card>teaser one</article><article class=card>teaser two</article>", [LONG * 2]),
    (f"<div class='text'>{LONG * 2}</div><article>teaser one</article><article>teaser two</article>", [LONG * 2]),
    (f"<div><p>{LONG}</p><p><a href=1>Foo</a> and <a href=2>Bar baz</a></p></div>", [LONG, "Foo and Bar baz"]),
    (f"<article><p class='ad-lib'>{LONG}</p></article>", [LONG]),
    ("<article><p>Press <label>this key</label> now.</p><label>Name</label></article>", ["Press this key now."]),
    (f"<main><article><p>{LONG}</p></article><div id=responses><article>a comment</article></div></main>", [LONG]),
])
def test_only_the_article_comes_through(page, want):
    assert html_tree.blocks(html_tree.parse(f"<body>{page}</body>"), frozenset()) == want


def test_importance_equals_brute_force(spark):
    rng = random.Random(21)
    pages = []
    for i in range(90):
        host = rng.choice(["a.example", "b.example", "c.example"])
        side = "".join(f"<{t}>{rng.choice('xyz')}</{t}>" for t in rng.choices(["li", "p"], k=rng.randint(1, 3)))
        pages.append((host, f"<body><div class='top'>{rng.choice(['Hello', 'Hello', 'Welcome'])}</div><div id='side'>{side}</div><div class='text'><p>{rng.random() if i % 3 else 'same'}</p></div></body>"))
    pages += pages[:20]
    frame = spark.createDataFrame([(i, f"https://{h}/{i}", page) for i, (h, page) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = {r.host: set(r.low) for r in html_tree.unimportant(frame).collect()}
    want = style_tree(pages)
    assert got == want and any(want.values())


def jaccard_groups(texts, least=0.8):
    """Group number of each text under links of Jaccard similarity over five-word shingles, and all linked pairs of different texts."""
    sets = []
    for t in texts:
        ws = [lower(w) for w in words(t)]
        n = min(5, len(ws))
        sets.append({tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if ws else set())
    parent, pairs = list(range(len(texts))), []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
                pairs.append((j, i))
    return [find(i) for i in range(len(texts))], pairs


def test_near_copies_are_decided_by_similarity(spark, odd_rows):
    rng = random.Random(31)
    rows = [r for r in odd_rows if r[0] != 43]
    for k in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 300))]
        for copy in range(3):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
            rows.append((1000 + 3 * k + copy, " ".join(own)))
    docs = table(spark, rows)
    found = {}
    for r in near_copies.groups(docs).collect():
        found.setdefault((r.doc_id, r.node), r.label)
    label = dict(zip([(i, t or "") for i, t in rows], [None] * len(rows)))
    hashes = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) as h").collect()}
    got = [found[(i, hashes[t or ""])] for i, t in rows]
    want, pairs = jaccard_groups([t or "" for _, t in rows])
    joined = sum(got[a] == got[b] for a, b in pairs)
    assert joined >= 0.9 * len(pairs) and len(pairs) > 80 and label
    home = {}
    assert all(home.setdefault(g, w) == w for g, w in zip(got, want)), "a group holds texts that no chain of links joins"
    kept = near_copies.keep_one(docs).collect()
    assert near_copies.keep_one(docs).columns == docs.columns
    groups = {}
    for (i, _), g in zip(rows, got):
        groups.setdefault(g, set()).add(i)
    names = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert names == sorted(min(x for x in ids if x is not None) for ids in groups.values() if ids - {None})
    assert near_copies.keep_one(table(spark, [], 1)).collect() == []
