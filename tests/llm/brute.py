"""Plain versions of the training-data operators over dictionaries or lists of (doc_id, text), for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = (1 << 63) - 1


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(doc_id):
    return LAST if doc_id is None else doc_id


def byte_repeats(rows, length=100):
    """Per row: n_bytes, n_removed, n_spans, kept_sha256."""
    texts = [(order(i), (t or "").encode()) for i, t in rows]
    first = {}
    for did, text in texts:
        for i in range(len(text) - length + 1):
            key = text[i:i + length]
            first[key] = min(first.get(key, (did, i)), (did, i))
    out = []
    for did, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if first[text[i:i + length]] < (did, i):
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((len(text), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), sha(kept)))
    return out


def word_repeats(rows, width=13):
    """Per row: n_words, n_removed, kept_sha256."""
    texts = [(order(i), words(t)) for i, t in rows]
    first = {}
    for did, ws in texts:
        for i in range(len(ws) - width + 1):
            key = tuple(ws[i:i + width])
            first[key] = min(first.get(key, did), did)
    out = []
    for did, ws in texts:
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i:i + width])] < did:
                gone[i:i + width] = [True] * width
        out.append((len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g))))
    return out


def contaminated(rows, items, width=10):
    """Per row: n_words, hit flags, items found."""
    phrases = defaultdict(set)
    for item, text in items:
        ws = BENCH_WORD.findall(lower(text))
        size = min(width, len(ws))
        for i in range(len(ws) - size + 1) if ws else ():
            phrases[tuple(ws[i:i + size])].add("null" if item is None else str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for _, text in rows:
        ws = BENCH_WORD.findall(lower(text))
        hit, found = [False] * len(ws), set()
        for size in sizes:
            for i in range(len(ws) - size + 1):
                if (own := phrases.get(tuple(ws[i:i + size]))):
                    hit[i:i + size] = [True] * size
                    found |= own
        out.append((len(ws), hit, sorted(found)))
    return out


def fingerprint(text):
    ws = words(lower(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def near_groups(fps, distance=4):
    """Group number of each fingerprint: the place of the first member."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def language_model(rows, discount=0.75):
    """doc_id -> (held_out, n_tokens, n_known, N, base, unquantised score)."""
    uni, bi, texts = Counter(), Counter(), {}
    for i, text in rows:
        ws = words(lower(text)) + ["\0end"]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        texts[i] = held, ws
        if not held:
            uni.update(ws)
            bi.update(zip(["\0start", *ws], ws))
    n, v = sum(uni.values()), len(uni)
    total, kinds = Counter(), Counter()
    for (a, _), c in bi.items():
        total[a] += c
        kinds[a] += 1
    alone = {w: (uni[w] + 0.1) / (n + 0.1 * (v + 1)) for _, ws in texts.values() for w in ws}
    out = {}
    for i, (held, ws) in texts.items():
        score = 0.0
        for a, b in zip(["\0start", *ws], ws):
            c = bi[a, b]
            score += math.log10((c - discount) / total[a] if c else (min(1, discount * kinds[a] / total[a]) if total[a] else 1) * alone[b])
        out[i] = held, len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10(alone[w]) for w in ws), score
    return out


def without_boilerplate(rows, percent=5, min_pages=5):
    """rows of (doc_id, source, text) -> kept texts."""
    total, pages = Counter(s for _, s, _ in rows), Counter()
    for _, s, t in rows:
        pages.update({(s, x) for x in (t or "").split("\n") if WORD.search(x)} if t is not None else ())
    drop = {k for k, n in pages.items() if n >= min_pages and 100 * n > percent * total[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in drop) for _, s, t in rows]


def word_runs(ws, periods=4, shortest=6):
    """(start, length, period) of every run, by start and period."""
    n, found = len(ws), []
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            if ws[i] != ws[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and ws[j] == ws[j + p]:
                j += 1
            size = j - i + p
            if size >= max(shortest, periods * p) and not any(all(ws[k] == ws[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                found.append((i, size, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def style_tree(pages, least=0.6, decay=0.9, min_pages=5):
    """{host: unimportant paths} of (host, html) pages by the entropy formulas, over plain dictionaries; equal pages of a host are one."""
    from plumbline.llm.html_tree import BLOCK, Element, lay_paths, own_text, parse

    nodes = {}
    for host, page in sorted(set(pages)):
        styles, texts = {}, {}
        for e in lay_paths(parse(page)):
            if e.tag in BLOCK:
                tags = [c.tag for c in e.children if isinstance(c, Element)]
                styles.setdefault(e.path, set()).add(tuple(t for k, t in enumerate(tags) if not k or t != tags[k - 1]))
                if own_text(e):
                    texts.setdefault(e.path, set()).add(own_text(e))
        for path, seen in styles.items():
            node = nodes.setdefault((host, path), [0, Counter(), Counter()])
            node[0] += 1
            node[1].update(seen)
            node[2].update(texts.get(path, ()))
    low = {}
    for (host, path), (m, styles, texts) in nodes.items():
        if m < min_pages or not texts:
            continue
        content = 1 - sum(math.log(n) for n in texts.values()) / (len(texts) * math.log(m))
        # an element kind may stand several times on a page, so shares need not add up to one
        presentation = (math.log(m) - sum(n * math.log(n) for n in styles.values()) / m) / math.log(m)
        if (1 - decay) * presentation + decay * content < least - 1e-9:
            low.setdefault(host, set()).add(path)
    return low
